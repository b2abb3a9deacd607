"""Packed token matrices: best-fit-decreasing rows with segment lengths and positions that restart.

Documents are encoded with an end id; overlong ones are cut into pieces without loss. Pieces are dealt by a hash of
their row number to groups of about ``GROUP_TOKENS`` tokens, so neither a long document nor a hot
source fills one group, and each group is packed best-fit-decreasing: a segment tree over free capacities finds the
tightest row. A row of the result is one row of the matrix.

Defined cases: NULL and empty texts are the end id alone. Rows that repeat are packed each. NULL ids are packed like others. An
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skycolumn.llm.best_fit import best_fit_decreasing
from skycolumn.llm.encode import encode_rows

CAPACITY = 2048
END_ID = 49407
PAD_ID = 49406
GROUP_TOKENS = 1 << 20
# Bytes of text per token, for the number of groups only.
BYTES_PER_TOKEN = 3


def token_pieces(docs: DataFrame, capacity: int, end_id: int, doc_id: str, text: str) -> DataFrame:
    """(doc_id, piece, start, length, ids): ids as little-endian unsigned 16-bit integers."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(key, ids: bytes) -> list[tuple]:
        whole = np.frombuffer(ids + end, "<u4")
        if whole.max() > 0xFFFF:
            raise ValueError("rows hold ids of 16 bits; this vocabulary has larger ones")
        short = whole.astype("<u2")
        return [(key, k, a, min(capacity, len(short) - a), short[a:a + capacity].tobytes()) for k, a in enumerate(range(0, len(short), capacity))]

    return encode_rows(docs, doc_id, text, cut, "doc_id any, piece int, start long, length int, ids binary")


def _rows(capacity: int, pad_id: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        bins, offsets, loads = best_fit_decreasing(group["length"].to_numpy(np.int64), capacity)
        order, number = np.lexsort((offsets, bins)), int(group["group"].iloc[0]) << 24
        lengths = group["length"].to_numpy(np.int64)[order]
        doc_ids, pieces, starts, ids = (group[c].to_numpy()[order] for c in ("doc_id", "piece", "start", "ids"))
        cuts = np.searchsorted(bins[order], np.arange(len(loads) + 1)).tolist()
        steps, padding, out = np.arange(capacity, dtype="<u2").tobytes(), np.full(capacity, pad_id, dtype="<u2").tobytes(), []
        for bin_, (a, b) in enumerate(zip(cuts, cuts[1:])):
            used, n = 2 * int(loads[bin_]), lengths[a:b]
            positions = b"".join([steps[:2 * k] for k in n.tolist()]) + bytes(2 * capacity - used)
            out.append((number + bin_, used // 2, b"".join(ids[a:b]) + padding[used:], [0, *np.cumsum(n).tolist()], positions,
                        doc_ids[a:b].tolist(), pieces[a:b].tolist(), starts[a:b].tolist()))
        return pd.DataFrame(out, columns=["sequence_id", "n_tokens", "ids", "cu_seqlens", "position_ids", "doc_ids", "pieces", "starts"])

    return run


def packed_rows(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, pad_id: int = PAD_ID, group_tokens: int = GROUP_TOKENS,
                doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per packed sequence: ids (binary, ``capacity`` unsigned 16-bit integers, padded), n_tokens, cu_seqlens, position_ids
    (binary, 16-bit, restarting at each segment), and the doc_ids, pieces and starts of its segments."""
    volume = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`").cast("string"))).alias("b"), F.count(F.lit(1)).alias("n")).first()
    groups = 1 + ((volume["b"] or 0) // BYTES_PER_TOKEN + volume["n"]) // group_tokens
    made = token_pieces(docs, capacity, end_id, doc_id, text)
    keyed = made.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    kind = made.schema["doc_id"].dataType.simpleString()
    return keyed.groupBy("group").applyInPandas(_rows(capacity, pad_id), "sequence_id long, n_tokens int, ids binary, cu_seqlens array<int>, "
                                                f"position_ids binary, doc_ids array<{kind}>, pieces array<int>, starts array<long>")


def write_packed(docs: DataFrame, path: str, **options) -> None:
    """The matrices as Parquet: each row group is a block of matrix rows with its segment lengths and positions."""
    packed_rows(docs, **options).write.parquet(path)


def ids_of(column: Column) -> Column:
    """The ids of a row as integers, from their two bytes each."""
    code = lambda i: F.conv(F.hex(F.substring(column, i, 1)), 16, 10).cast("int")
    return F.transform(F.sequence(F.lit(0), (F.octet_length(column) / 2).cast("int") - 1), lambda i: code(2 * i + 1) + 256 * code(2 * i + 2))
