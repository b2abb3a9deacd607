"""Quality rules: text statistics and robust multivariate outliers (minimum covariance determinant).

Everything is built from DataFrame functions. Per document:

* words are ``[^\\x20\\x09-\\x0D]+``; ``n_repeat_words`` counts the words inside 3-word windows that occur at
  least twice in the text. Windows are found by sorting (hash prefix, position) packed into one LONG, and
  neighbours of equal prefix are compared word by word, so the cost is n log n for a text of n words;
* the base rule fails texts of fewer than ``min_words`` words or with more than half of the words repeated;
* the texts that pass are described by a transformed vector (``VECTOR``). For each language and source the
  minimum covariance determinant estimate is found by concentration steps from two deterministic starts
  (median and MAD; largest coordinate), all groups at once: a step is a join with the small table of estimates
  and a grouped sum, both combined before the shuffle, so a group with a third of all rows is no hot spot.
  Texts with a squared Mahalanobis distance above ``CUTOFF`` are rejected.

Defined cases: a NULL or empty text has no words and fails the base rule. NULL language or source is a group of
its own. Groups under ``MIN_GROUP`` texts are pooled by language; where the pool is smaller too nothing is
rejected beyond the base rule. Repeated rows each count. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skycolumn.llm.common import ROW, let, null_safe, packed
from skycolumn.session import cut_lineage

MIN_WORDS = 50
MIN_GROUP = 40
# Share of a group that the estimate is taken from.
CORE = 0.75
STEPS = 5
# Variables of the vector and the standard deviation, given the variables before, that is at least assumed for each. Word length and
# the share of symbols (to log(101)) are natural logarithms; repeats are angles (``_angle``), to about 1.5. Each variable alone can reach CUTOFF.
VECTOR = {"v_length": 0.05, "v_symbols": 0.30, "v_lines": 0.09, "v_repeats": 0.09}
# Quantiles of the chi-squared distribution with four degrees of freedom: 0.99999 and 0.5.
CUTOFF = 28.47
MEDIAN_CHI2 = 3.357
# Factor that makes a median absolute deviation a standard deviation.
MAD = 1.4826

SPACE = "[\\x20\\x09-\\x0D]"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeat_words(words: Column, n: Column) -> Column:
    """Words covered by 3-word windows that are found twice or more."""
    one = F.lit(1).cast("long")

    def window(i: Column) -> list[Column]:
        return [F.get(words, i + k) for k in range(3)]

    def count(mask: Column) -> Column:
        """``mask``: the low bits that hold a position."""
        high = F.bitwise_not(mask)
        keys = F.transform(F.sequence(F.lit(0), n - 3),
                           lambda i: F.xxhash64(*window(i)).bitwiseAND(high).bitwiseOR(i.cast("long")))

        def same(x: Column, y: Column) -> Column:
            i, j = x.bitwiseAND(mask).cast("int"), y.bitwiseAND(mask).cast("int")
            met = x.bitwiseAND(high) == y.bitwiseAND(high)
            for a, b in zip(window(i), window(j)):
                met = met & (a == b)
            return F.coalesce(met, F.lit(False))

        def places(s: Column) -> Column:
            hit = F.filter(s, lambda x, k: same(x, F.get(s, k + 1)) | same(x, F.get(s, k - 1)))
            return F.sort_array(F.transform(hit, lambda x: x.bitwiseAND(mask).cast("int")))

        def covered(p: Column) -> Column:
            steps = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(p), F.lit(1))), F.lit(0),
                                lambda acc, k: acc + F.least(F.lit(3), F.coalesce(F.get(p, k) - F.get(p, k - 1), F.lit(3))))
            return F.when(F.size(p) == 0, F.lit(0)).otherwise(steps)

        return let(let(F.sort_array(keys), places), covered)

    mask = F.call_function("shiftleft", one, F.ceil(F.log2(n + F.lit(1.0))).cast("int")) - one
    return F.when(n < 4, F.lit(0)).otherwise(let(mask, count))


def _angle(k: Column, n: Column) -> Column:
    """The angle whose squared sine is the share k / n, less that of none: its sampling noise does not depend on the share, and one
    repeat among few lines or words weighs as little as such a share is sure. 0 for no repeats, whatever n."""
    part = lambda x: F.asin(F.sqrt(F.least((x + 0.375) / (n + 0.75), F.lit(1.0))))
    return part(k) - part(F.lit(0.0))


def add_statistics(docs: DataFrame, text: str, prefix: str = "") -> DataFrame:
    """Adds the base columns (LONG), the vector and ``base_failed``, all with ``prefix``."""
    name = lambda c: f"{prefix}{c}"
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    # Two projections: what several expressions use must be computed once.
    trimmed = F.regexp_replace(whole, f"^{SPACE}+|{SPACE}+$", "")
    out = docs.withColumn(name("words"), F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{SPACE}+")))
    out = out.withColumn(name("lines"), F.filter(F.split(whole, "\n"), lambda x: x.rlike("[^\x20\x09-\x0D]")))
    words, lines = F.col(name("words")), F.col(name("lines"))
    out = (out.withColumn(name("n_words"), F.size(words).cast("long"))
           .withColumn(name("word_chars"), F.length(F.array_join(words, "")).cast("long"))
           .withColumn(name("n_symbols"), F.length(F.regexp_replace(whole, "[^#*$%&|<>]+", "")).cast("long"))
           .withColumn(name("n_lines"), F.size(lines).cast("long"))
           .withColumn(name("n_dup_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"))
           .withColumn(name("n_repeat_words"), _repeat_words(words, F.size(words)).cast("long"))
           .drop(name("words"), name("lines")))
    n, chars = F.col(name("n_words")), F.col(name("word_chars"))
    share = lambda part, whole: F.log1p(F.coalesce(F.try_divide(100 * F.col(name(part)), whole), F.lit(0.0)))
    return (out.withColumn(name("base_failed"), (n < MIN_WORDS) | (100 * F.col(name("n_repeat_words")) > 50 * n))
            .withColumn(name("v_length"), F.log(F.greatest(F.coalesce(F.try_divide(chars, n), F.lit(1.0)), F.lit(1.0))))
            .withColumn(name("v_symbols"), share("n_symbols", chars))
            .withColumn(name("v_lines"), _angle(F.col(name("n_dup_lines")), F.col(name("n_lines"))))
            .withColumn(name("v_repeats"), _angle(F.col(name("n_repeat_words")), n)))


def _distance(vector: list[Column], low: str = "l", centre: str = "m") -> Column:
    """Squared Mahalanobis distance by forward substitution in the Cholesky factor of the covariance."""
    y: list[Column] = []
    for i, v in enumerate(vector):
        left = v - F.col(f"{centre}{i}")
        for j in range(i):
            left = left - F.col(f"{low}{i}{j}") * y[j]
        y.append(left / F.col(f"{low}{i}{i}"))
    return sum((x * x for x in y[1:]), y[0] * y[0])


def _factored(sums: DataFrame, floors: list[float], keys: list[str]) -> DataFrame:
    """Means, Cholesky factor and determinant of the covariance from the moments of each group."""
    p = len(floors)
    out = sums
    for i in range(p):
        out = out.withColumn(f"m{i}", F.col(f"s{i}") / F.col("n"))
    for i in range(p):
        for j in range(i + 1):
            value = F.col(f"s{i}_{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")
            for k in range(j):
                value = value - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            # A bound, not a term: where the data vary more, the floor has no part in the estimate.
            value = F.sqrt(F.greatest(value, F.lit(floors[i] ** 2))) if i == j else value / F.col(f"l{j}{j}")
            out = out.withColumn(f"l{i}{j}", value)
    log_det = sum((F.log(F.col(f"l{i}{i}")) for i in range(1, p)), F.log(F.col("l00"))) * 2
    return out.select(*keys, "n", *[f"m{i}" for i in range(p)], *[f"l{i}{j}" for i in range(p) for j in range(i + 1)],
                      log_det.alias("log_det"))


def mcd_estimates(points: DataFrame, keys: list[str], vector: list[str], floors: list[float],
                  core: float = CORE, steps: int = STEPS) -> DataFrame:
    """One row per group: the minimum covariance determinant estimate (means ``m*``, factor ``l**``, ``scale``)."""
    x, p, on = [F.col(v) for v in vector], len(vector), [*keys, "_start"]
    # Deterministic starts: distances from median and MAD, as a sum of squares and as the largest coordinate.
    middle = cut_lineage(points.groupBy(*keys).agg(*[F.percentile_approx(c, 0.5, 1000).alias(f"c{i}") for i, c in enumerate(x)]))
    spread = cut_lineage(points.join(middle, keys).groupBy(*keys)
              .agg(*[F.percentile_approx(F.abs(c - F.col(f"c{i}")), 0.5, 1000).alias(f"a{i}") for i, c in enumerate(x)]))
    starts = cut_lineage(middle.join(spread, keys))
    z = [(c - F.col(f"c{i}")) / (MAD * F.col(f"a{i}") + F.lit(floors[i])) for i, c in enumerate(x)]
    both = F.array(sum((a * a for a in z[1:]), z[0] * z[0]), F.greatest(*[F.abs(a) for a in z]))
    measured = points.join(starts, keys).select(*keys, *vector, F.posexplode(both).alias("_start", "_d"))
    estimates = None
    for _ in range(steps + 1):
        if estimates is not None:
            measured = points.withColumn("_start", F.explode(F.array(F.lit(0), F.lit(1)))).join(estimates, on).select(*on, *vector, _distance(x).alias("_d"))
        # Written, so that its known size decides how it is joined; the points need not move to meet a few rows.
        radius = cut_lineage(measured.groupBy(*on).agg(F.percentile_approx("_d", core, 1000).alias("_r")))
        inside = measured.join(radius, on).filter("_d <= _r")
        sums = inside.groupBy(*on).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(x)],
                                       *[F.sum(x[i] * x[j]).alias(f"s{i}_{j}") for i in range(p) for j in range(i + 1)])
        estimates = cut_lineage(_factored(sums, floors, on))
    best = cut_lineage(estimates.groupBy(*keys).agg(F.min_by(F.struct(*estimates.columns[len(on):]), F.struct("log_det", "_start")).alias("e")).select(*keys, "e.*"))
    # The core has less spread than the group: the median distance is brought up to its expected value.
    median = cut_lineage(points.join(best, keys).select(*keys, _distance(x).alias("_d")).groupBy(*keys).agg(F.percentile_approx("_d", 0.5, 1000).alias("_m")))
    return cut_lineage(best.join(median, keys).withColumn("scale", F.greatest(F.lit(1.0), F.col("_m") / MEDIAN_CHI2)).drop("_m", "n", "log_det"))


def judge(rows: DataFrame, language: str, source: str, prefix: str = "") -> DataFrame:
    """``rows`` as ``add_statistics`` leaves them, written to a table; adds ``kept`` and ``distance``."""
    name = lambda c: f"{prefix}{c}"
    vector, floors = [name(v) for v in VECTOR], list(VECTOR.values())
    keyed = rows.withColumn(name("k0"), null_safe(F.col(language))).withColumn(name("k1"), null_safe(F.col(source)))
    passed = keyed.filter(~F.col(name("base_failed")))
    counts = passed.groupBy(name("k0"), name("k1")).agg(F.count(F.lit(1)).alias(name("n"))).filter(F.col(name("n")) >= MIN_GROUP)
    large = cut_lineage(counts.select(name("k0"), name("k1"), F.lit(True).alias(name("own"))))
    keys = [name("g0"), name("g1")]
    grouped = (keyed.join(large, [name("k0"), name("k1")], "left")
               .withColumn(keys[0], F.col(name("k0"))).withColumn(keys[1], F.when(F.col(name("own")), F.col(name("k1"))).otherwise(F.lit("*"))))
    points = cut_lineage(grouped.filter(~F.col(name("base_failed"))).select(*keys, *vector))
    enough = cut_lineage(points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MIN_GROUP).select(*keys))
    estimates = mcd_estimates(points.join(enough, keys, "left_semi"), keys, vector, floors)
    estimates = estimates.withColumnsRenamed({c: name(f"e_{c}") for c in estimates.columns if c not in keys})
    distance = _distance([F.col(v) for v in vector], name("e_l"), name("e_m")) / F.col(name("e_scale"))
    out = grouped.join(estimates, keys, "left").withColumn(name("distance"), distance)
    out = out.withColumn(name("kept"), ~F.col(name("base_failed")) & F.coalesce(F.col(name("distance")) <= CUTOFF, F.lit(True)))
    return out.drop(*keys, name("k0"), name("k1"), name("own"), *[c for c in out.columns if c.startswith(name("e_"))])


def classify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per document: its id, the base columns, ``base_failed``, ``distance`` and ``kept``."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"),
                       F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{source}`").cast("string").alias("source"))
    rows = cut_lineage(add_statistics(rows, "text").drop("text"))
    return judge(rows, "lang", "source").select("doc_id", *BASE, "base_failed", "distance", "kept")


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The documents that the rules keep, with all their columns as they were."""
    rows = docs.select(packed(docs), F.col(f"`{text}`").alias("_t"), F.col(f"`{lang}`").cast("string").alias("_lang"), F.col(f"`{source}`").cast("string").alias("_source"))
    rows = cut_lineage(add_statistics(rows, "_t", "_q_").drop("_t"))
    return judge(rows, "_lang", "_source", "_q_").filter("_q_kept").select(f"{ROW}.*")
