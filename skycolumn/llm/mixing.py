"""Mixing sources to target weights: temperature, then budgeted block permutations.

1. Token totals by source (summed before the shuffle). The weight of a source is its share to the power ``exponent``, normalised; 1 keeps the
   shares, 0 makes all sources equal. Entropy falls and the largest repetition falls as the exponent grows, so
   bisection finds the least exponent in [0, 1] that reaches the target entropy without repeating any source more
   than allowed. Each step is one aggregate over the table of sources at a fan of exponents; the sources never leave it.
2. A source of n tokens with a share of the budget of b tokens is passed b / n times: whole epochs and a part of one.
   Its documents lie in hash blocks of about ``BLOCK_TOKENS`` tokens; an epoch is a permutation of the blocks (by hash of epoch and block) and of
   the documents in a block. Whole epochs need no order. For the part, blocks are taken in order while the budget
   lasts and the block at the edge is cut in its own order. Running sums use two levels (ranges of
   the order, then blocks within the edge range), so no task sees all blocks of a hot source.

Tokens are words ``[^\\x20\\x09-\\x0D]+``, one at least for each document.

Defined cases: NULL source is a source of its own. NULL and empty texts count one token. Rows that repeat are separate documents.
An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skycolumn.llm.common import ROW, null_safe, packed
from skycolumn.session import cut_lineage

# Target entropy as a share of the entropy of equal weights; most passes of any source; budget as a multiple of all tokens.
ENTROPY = 0.97
REPEATS = 4.0
BUDGET = 1.0
BLOCK_TOKENS = 100_000
RANGES = 1024
FAN = 17
STEPS = 5


def word_count(text: Column) -> Column:
    return F.greatest(F.lit(1), F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+"))).cast("long")


def source_weights(totals: DataFrame, budget: float | None = BUDGET, entropy: float = ENTROPY, repeats: float = REPEATS) -> DataFrame:
    """``totals`` (_source, _tokens), a written table; adds _weight (sums to 1) and _passes (budgeted tokens over tokens).

    Without a budget it is the least that passes every source once.
    """
    sums = totals.agg(F.sum("_tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).first()
    total, n = sums["tokens"] or 0, sums["n"]
    if not total:
        return totals.withColumn("_weight", F.lit(0.0)).withColumn("_passes", F.lit(0.0))
    share = F.col("_tokens") / F.lit(float(total))
    low, high = 0.0, 1.0
    for _ in range(STEPS):
        fan = [low + (high - low) * i / (FAN - 1) for i in range(FAN)]
        # For each exponent a: z = sum of share^a, h = sum of share^a log share^a, and the largest share^(a - 1).
        found = totals.agg(*[f for i, a in enumerate(fan) for f in (
            F.sum(F.pow(share, F.lit(a))).alias(f"z{i}"), F.sum(F.pow(share, F.lit(a)) * a * F.log(share)).alias(f"h{i}"),
            F.max(F.pow(share, F.lit(a - 1.0))).alias(f"r{i}"), F.max(F.pow(share, F.lit(1.0 - a))).alias(f"m{i}"))]).first()
        fits = [math.log(found[f"z{i}"]) - found[f"h{i}"] / found[f"z{i}"] >= entropy * math.log(n) - 1e-12 for i in range(FAN)]
        spent = [found[f"z{i}"] * found[f"m{i}"] if budget is None else budget for i in range(FAN)]
        allowed = [spent[i] * found[f"r{i}"] / found[f"z{i}"] <= max(repeats, budget or 1.0) + 1e-12 for i in range(FAN)]
        # The largest exponent that reaches the entropy; repetition may push it up.
        meets = max([i for i in range(FAN) if fits[i]], default=0)
        least = min([i for i in range(FAN) if allowed[i]], default=FAN - 1)
        if least > meets:  # repetition decides: the least allowed exponent lies below
            low, high = fan[max(0, least - 1)], fan[least]
            exponent = high
        else:
            low, high = fan[meets], fan[min(FAN - 1, meets + 1)]
            exponent = low
    last = totals.agg(F.sum(F.pow(share, F.lit(exponent))).alias("z"), F.max(F.pow(share, F.lit(1.0 - exponent))).alias("m")).first()
    z = last["z"]
    budget = z * last["m"] if budget is None else budget
    weight = F.pow(share, F.lit(exponent)) / F.lit(z)
    return totals.withColumn("_weight", weight).withColumn("_passes", weight * F.lit(budget * total) / F.col("_tokens"))


def mixture(docs: DataFrame, source: str = "source", text: str = "text", budget: float | None = BUDGET, entropy: float = ENTROPY,
            repeats: float = REPEATS, seed: int = 11, carry: list[str] | None = None) -> DataFrame:
    """(``_row``, _source, _tokens, _weight, _whole, _block, _last, _copies): how often each document is taken.

    ``_copies`` counts its epochs, 0 for a document beyond the budget; ``_last`` tells whether the part of an epoch took
    it. ``_row`` holds the columns ``carry``, all without it.
    """
    # The place of a row in its source comes from a hash of the whole row; equal rows are told apart by their number.
    kept = packed(docs if carry is None else docs.select(*[f"`{c}`" for c in carry]))
    rows = docs.select(kept, null_safe(F.col(f"`{source}`")).alias("_source"),
                       word_count(F.col(f"`{text}`").cast("string")).alias("_tokens"), F.monotonically_increasing_id().alias("_number"),
                       F.xxhash64(kept, F.lit(seed)).alias("_draw"))
    rows = cut_lineage(rows)
    totals = cut_lineage(rows.groupBy("_source").agg(F.sum("_tokens").alias("_total")).withColumnRenamed("_total", "_tokens"))
    plan = cut_lineage(source_weights(totals, budget, entropy, repeats)
                       .withColumn("_blocks", F.ceil(F.col("_tokens") / BLOCK_TOKENS).cast("long"))
                       .withColumn("_whole", F.floor(F.col("_passes") + 1e-9).cast("int"))
                       .withColumn("_rest", F.round(F.greatest(F.lit(0.0), F.col("_passes") - F.col("_whole")) * F.col("_tokens")).cast("long"))
                       .select("_source", "_weight", "_blocks", "_whole", "_rest"))
    order = F.xxhash64("_source", "_block", F.col("_whole"), F.lit(seed))
    placed = rows.join(plan, "_source").withColumn("_block", F.pmod("_draw", "_blocks")).withColumn("_order", order)
    placed = placed.withColumn("_range", F.pmod(F.shiftrightunsigned("_order", 20), F.lit(RANGES)))
    # First level: ranges of the order of blocks. Each row of `blocks` is one block.
    blocks = cut_lineage(placed.groupBy("_source", "_range", "_order", "_block", "_rest").agg(F.sum("_tokens").alias("_sum")))
    before = lambda keys, by: Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    running = lambda window: F.coalesce(F.sum("_sum").over(window), F.lit(0))
    ranges = (blocks.groupBy("_source", "_range", "_rest").agg(F.sum("_sum").alias("_sum"))
              .withColumn("_start", running(before(["_source"], ["_range"]))).filter("_start < _rest"))
    cut = (ranges.select("_source", "_range", "_start").join(blocks, ["_source", "_range"])
           .withColumn("_begin", F.col("_start") + running(before(["_source", "_range"], ["_order", "_block"]))).filter("_begin < _rest"))
    taken = cut_lineage(cut.select("_source", "_block", F.col("_begin"), (F.col("_begin") + F.col("_sum") > F.col("_rest")).alias("_edge")))
    # Second level: documents of the one block at the edge of each source's budget.
    inside = before(["_source", "_block"], ["_mixed", "_number"])
    edge = (placed.join(taken.filter("_edge"), ["_source", "_block"])
            .select("_source", "_block", "_number", F.xxhash64("_draw", "_whole", F.lit(seed)).alias("_mixed"), "_tokens", "_begin", "_rest")
            .withColumn("_at", F.col("_begin") + F.coalesce(F.sum("_tokens").over(inside), F.lit(0))))
    edge = cut_lineage(edge.filter("_at < _rest").select("_number", F.lit(True).alias("_hit")))
    whole = taken.select("_source", "_block", F.col("_edge").alias("_cut"))
    out = placed.join(whole, ["_source", "_block"], "left").join(edge, "_number", "left")
    last = F.col("_cut").isNotNull() & (~F.col("_cut") | F.coalesce(F.col("_hit"), F.lit(False)))
    return out.withColumn("_last", last).withColumn("_copies", F.col("_whole") + last.cast("int"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents: each row as often as it is taken, columns as they were."""
    taken = mixture(docs, **options).filter("_copies > 0")
    return taken.withColumn("_epoch", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(f"{ROW}.*")
