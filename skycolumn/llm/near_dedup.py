"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full sets, union-find.

1. One pass over the texts gives each document the size and a 128-bit fingerprint of its shingle set and the hashes of
   ``BANDS`` bands of its signature. In SuperMinHash every element of a set draws one permutation of the
   signature's places and a rank for each place; step t offers values in [t, t + 1), so a document stops as soon as
   all its places are below the next step (long texts after one or two steps).
2. Equal sets collapse to the smallest id. Buckets with two or more sets give star edges to their smallest member; the components of
   these edges are the candidate groups. A pair at the threshold misses every band with probability (1 - 0.8^6)^40 < 6e-6.
3. Candidate groups are dealt out in pairs of chunks of bounded size, so a group of any size is spread over many
   tasks. A task compares signatures, then full shingle sets, skips pairs that its own union-find has already
   joined, and returns only the links that joined something: no list of all pairs exists anywhere.
4. Components of the links; copies of a set take the component of the set.

Defined cases: NULL or empty texts have no shingles and are linked with nothing. Rows that repeat an id count as one
document whose texts are all compared. Rows with a NULL id keep a NULL component and are kept. An empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skycolumn.llm.common import ROW, packed, slices
from skycolumn.llm.components import connected_components
from skycolumn.llm.shingles import mix, shingle_sets
from skycolumn.session import cut_lineage

BANDS, ROWS = 40, 6
PLACES = BANDS * ROWS
BATCH_CHARS = 500_000
# Members of a chunk: a sixteenth of the group within these limits; shingles of a chunk.
CHUNK_LEAST, CHUNK_MOST, CHUNK_SHINGLES = 128, 2048, 500_000
# Signatures agree in less than the threshold minus this only with negligible probability (five standard deviations).
SLACK = 0.14
# Up to this many pairs a task skips the signatures and compares sets at once.
FEW_PAIRS = 300


def signatures(sets: list[np.ndarray], places: int = PLACES) -> np.ndarray:
    """SuperMinHash of non-empty sets: one row of ``places`` values, step in the high and rank in the low 32 bits."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    best = np.full((len(sets), places), np.iinfo(np.uint64).max, dtype=np.uint64)
    if not sizes.sum():
        return best
    flat = best.reshape(-1)
    items = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = None
    for step in range(places):
        draw = mix(items + np.uint64((step + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        pick = step + ((draw >> np.uint64(32)) * np.uint64(places - step) >> np.uint64(32)).astype(np.int64)
        value = (draw & np.uint64(0xFFFFFFFF)) | np.uint64(step << 32)
        if order is None:
            place = pick
        else:
            row = np.arange(len(items))
            place = order[row, pick].astype(np.int64)
            order[row, pick] = order[:, step]
        np.minimum.at(flat, owner * places + place, value)
        active = best.max(axis=1) >= np.uint64((step + 1) << 32)
        active &= sizes > 0
        if not active.any():
            break
        if order is None:
            keep = active[owner]
            items, owner, pick = items[keep], owner[keep], pick[keep]
            order = np.tile(np.arange(places, dtype=np.uint16), (len(items), 1))
            order[np.arange(len(items)), pick] = 0
        elif (keep := active[owner]).sum() * 2 < len(items):
            items, owner, order = items[keep], owner[keep], order[keep]
    return best


def band_hashes(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    with np.errstate(over="ignore"):
        cells = signature.reshape(len(signature), bands, rows)
        out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(signature), bands)).copy()
        for k in range(rows):
            out = mix(out * np.uint64(0xD6E8FEB86659FD93) + cells[:, :, k])
    return out.view(np.int64)


def _describe(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts, BATCH_CHARS):
                sets = shingle_sets(texts[a:b], size)
                some = [i for i, s in enumerate(sets) if len(s)]
                bands: list = [None] * len(sets)
                if some:
                    for i, row in zip(some, band_hashes(signatures([sets[i] for i in some]))):
                        bands[i] = row
                with np.errstate(over="ignore"):
                    marks = [(int(s.sum(dtype=np.uint64)), int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))) for s in sets]
                to_long = lambda v: v - (1 << 64) if v >= 1 << 63 else v
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([to_long(m[0]) for m in marks], pa.int64()), pa.array([to_long(m[1]) for m in marks], pa.int64()),
                    pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "f1", "f2", "bands"])

    return run


class Forest:
    """Union-find over the members of one task."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.parent[max(i, j)] = min(i, j)
        return i != j


def _candidates(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, least: float) -> Iterator[tuple[int, int]]:
    """Pairs (member of left, member of right) whose signatures agree enough, the most similar first."""
    marks = (signatures(sets) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    found = []
    for i in left:
        later = right[right > i] if left is right else right
        if len(later):
            agree = (marks[later] == marks[i]).sum(axis=1)
            hit = agree >= least * PLACES
            found.append(np.stack([agree[hit], np.full(int(hit.sum()), i), later[hit]]))
    pairs = np.concatenate(found, axis=1)
    for k in np.argsort(-pairs[0], kind="stable"):
        yield int(pairs[1, k]), int(pairs[2, k])


def _links(size: int, percent: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["chunk", "doc_id"], kind="stable").reset_index(drop=True)
        texts = group["text"].tolist()
        sets = [s for a, b in slices(texts, BATCH_CHARS) for s in shingle_sets(texts[a:b], size)]
        ids, chunk = group["doc_id"].tolist(), group["chunk"].to_numpy()
        # Rows of one chunk alone compare among themselves, rows of two chunks across.
        low, high = int(group["lo"].iloc[0]), int(group["hi"].iloc[0])
        full = np.array([i for i, s in enumerate(sets) if len(s)], dtype=np.int64)
        left = full[chunk[full] == low]
        right = left if low == high else full[chunk[full] == high]
        forest, links, kept = Forest(len(ids)), [], {}

        def as_set(i: int) -> set:
            if i not in kept:
                kept[i] = set(sets[i].tolist())
            return kept[i]

        if len(left) * len(right) <= FEW_PAIRS:
            pairs: Iterator[tuple[int, int]] = ((int(i), int(j)) for i in left for j in (right[right > i] if left is right else right))
        else:
            pairs = _candidates(sets, left, right, percent / 100 - SLACK) if len(left) and len(right) else iter(())
        for i, j in pairs:
            small, large = sorted((len(sets[i]), len(sets[j])))
            if 100 * small < percent * large or forest.find(i) == forest.find(j):
                continue
            common = len(as_set(i) & as_set(j))
            if 100 * common >= percent * (small + large - common):
                forest.join(i, j)
                links.append((ids[i], ids[j]))
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    return run


def describe(docs: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """(doc_id, n_shingles, f1, f2, bands) of each row, written to a table."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return cut_lineage(rows.mapInArrow(_describe(size), "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>"))


def similarity_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id reachable), kept (it is that id)."""
    described = describe(docs, doc_id, text, size)
    mark = ["n_shingles", "f1", "f2"]
    named = described.filter("doc_id IS NOT NULL AND n_shingles > 0")
    sets = cut_lineage(named.groupBy(*mark).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    # Rows that repeat an id join the texts of that id.
    repeated = named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id")
    same_id = (named.join(repeated, "doc_id").select("doc_id", *mark).join(sets.select(*mark, "rep"), mark)
               .select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    reps = sets.select(F.col("rep").alias("doc_id"), *mark)
    bands = (named.join(reps, ["doc_id", *mark], "left_semi").dropDuplicates(["doc_id", *mark])
             .select("doc_id", "n_shingles", F.explode("bands").alias("band")))
    crowded = bands.groupBy("band").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("band", "first")
    stars = bands.join(crowded, "band").filter("doc_id <> first").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    candidates = connected_components(stars)
    members = cut_lineage(candidates.unionByName(candidates.select(F.col("component").alias("id"), "component").distinct()))
    sized = members.join(sets.select(F.col("rep").alias("id"), "n_shingles"), "id").groupBy("component").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("total"))
    wide = F.least(F.lit(CHUNK_MOST), F.greatest(F.lit(CHUNK_LEAST), F.ceil(F.col("n") / 16)))
    sized = sized.select("component", F.ceil(F.greatest(F.col("n") / wide, F.col("total") / CHUNK_SHINGLES)).cast("int").alias("chunks"))
    placed = (members.join(sized, "component")
              .withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(7)), F.col("chunks")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))))
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    dealt = (rows.join(placed, "id").select(F.col("id").alias("doc_id"), "text", "component", "chunk",
                                            F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi")))
    links = dealt.groupBy("component", "lo", "hi").applyInPandas(_links(size, percent), "a long, b long")
    joined = connected_components(links.unionByName(same_id))
    # From the set back to its documents: only sets with copies or links need a row.
    by_set = (sets.join(joined.withColumnRenamed("id", "rep"), "rep", "left").filter("copies > 1 OR component IS NOT NULL")
              .select(*mark, F.coalesce("component", "rep").alias("component")))
    return (described.select("doc_id", *mark).join(by_set, mark, "left")
            .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")))
            .select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, the smallest id; of rows that repeat an id one stays. Columns as they were."""
    groups = similarity_groups(docs, doc_id, text, size, percent).filter("doc_id IS NOT NULL")
    flags = (groups.groupBy(F.col("doc_id").alias("_id")).agg(F.count(F.lit(1)).alias("_rows"), F.min("kept").alias("_kept"))
             .filter("_rows > 1 OR NOT _kept"))
    rows = docs.select(packed(docs), F.col(f"`{doc_id}`").cast("long").alias("_own")).join(flags, F.col("_own") == F.col("_id"), "left")
    rows = rows.filter(F.coalesce(F.col("_kept"), F.lit(True)))
    once = rows.filter("_rows > 1").groupBy("_own").agg(F.min_by(ROW, F.xxhash64(ROW)).alias(ROW)).select(f"{ROW}.*")
    return rows.filter("_rows IS NULL").select(f"{ROW}.*").unionByName(once)
