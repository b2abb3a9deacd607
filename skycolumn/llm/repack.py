"""Best-fit packing certified by lower bounds; groups with gaps exchange documents and are packed again.

1. Documents are encoded; only those longer than ``capacity`` are cut, into pieces of ``capacity`` tokens and a rest.
2. Pieces are dealt to groups of about ``GROUP`` pieces. A group is packed best-fit-decreasing, and dual feasible
   functions give a proven least number of bins for its pieces. Where the packing meets the bound only its
   emptiest bin is opened again (it can only be saved together with other groups); where there is a gap all bins with free room are.
3. The pieces of opened bins are dealt to new, fewer groups and packed again, until the number of bins meets the bound of
   the whole table, one group has packed all that is open, at most one bin is open, or after ``MOST_ROUNDS`` rounds. Each round writes
   its tables. A round that needs more bins than the one before for the same pieces is dropped: they keep their places, and the
   next round deals them anew.

Every row carries the certificate of the whole result: ``n_sequences`` and ``bound``, the proven least number. Where they are equal
nothing is left to save.

The bound of the table needs only the number of pieces of each length, at most ``capacity`` rows.

Defined cases: NULL and empty texts are the end id alone. Rows that repeat are packed each. NULL ids are packed like others. An
empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skycolumn.llm.best_fit import best_fit_decreasing, lower_bound
from skycolumn.llm.encode import encode_rows
from skycolumn.session import cut_lineage

CAPACITY = 2048
GROUP = 5000
MOST_ROUNDS = 8
END = np.array([0], dtype="<u4").tobytes()


def pieces(docs: DataFrame, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's ids and the end id, cut at multiples of ``capacity``."""

    def cut(key, ids: bytes) -> list[tuple]:
        ids += END
        step = 4 * capacity
        parts = [ids[a:a + step] for a in range(0, len(ids), step)]
        return [(key, k, k * capacity, len(p) // 4, zlib.crc32(p)) for k, p in enumerate(parts)]

    return encode_rows(docs, doc_id, text, cut, "doc_id any, piece int, start long, length long, ids_crc32 long")


def _pack(capacity: int, last: bool):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        lengths = group["length"].to_numpy(np.int64)
        bins, offsets, loads = best_fit_decreasing(lengths, capacity)
        gap = len(loads) - lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        opened = loads < capacity
        if last:
            opened[:] = False
        elif gap == 0 and opened.any():
            opened &= np.arange(len(loads)) == loads.argmin()
        return group.assign(bin=bins, offset=offsets, opened=opened[bins], gap=gap)

    return run


def pack(items: DataFrame, capacity: int = CAPACITY, group: int = GROUP, rounds: int = MOST_ROUNDS) -> DataFrame:
    """``items`` (a written table) with a column ``length`` of 1..capacity; adds sequence_id, offset, n_sequences and bound."""
    names = items.columns
    lengths = np.zeros(capacity + 1, dtype=np.int64)
    for row in items.groupBy("length").count().collect():  # at most one row for each length
        lengths[row["length"]] = row["count"]
    bound = lower_bound(lengths, capacity)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)
    schema += ", group long, bin long, offset long, opened boolean, gap long"
    # ``best`` holds the places so far of the pieces still open, in ``best_bins`` bins.
    active, n, done, sealed, best, best_bins = items, int(lengths.sum()), [], 0, None, 0
    for level in range(rounds):
        groups = max(1, math.ceil(n / group))
        last = groups == 1 or level == rounds - 1
        keyed = active.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(level)), F.lit(groups)))
        result = cut_lineage(keyed.groupBy("group").applyInPandas(_pack(capacity, last), schema))
        numbered = result.withColumn("sequence_id", F.lit(level).cast("long") * (1 << 58) + F.col("group") * (1 << 24) + F.col("bin"))
        heads = result.filter("offset = 0").groupBy().agg(F.sum(F.when(F.col("opened"), 1).otherwise(0)).alias("open"), F.count(F.lit(1)).alias("all")).first()
        opened, all_bins = heads["open"] or 0, heads["all"]
        if best is not None and all_bins > best_bins:
            if last:
                break
            continue
        if last or sealed + all_bins <= bound or opened <= 1:
            best, best_bins = numbered, all_bins
            break
        done.append(numbered.filter("NOT opened"))
        sealed += all_bins - opened
        best, best_bins = numbered.filter("opened"), opened
        active = result.filter("opened").select(*names)
        n = active.count()
    certificate = F.lit(sealed + best_bins).cast("long").alias("n_sequences"), F.lit(int(bound)).cast("long").alias("bound")
    return functools.reduce(DataFrame.unionByName, [d.select(*names, "sequence_id", "offset") for d in [*done, best]]).select("*", *certificate)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, n_sequences, bound."""
    return pack(cut_lineage(pieces(docs, capacity, doc_id, text)), capacity)
