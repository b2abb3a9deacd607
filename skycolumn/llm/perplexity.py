"""Quality classifier: interpolated modified Kneser-Ney model of trusted text, perplexity per document, thresholds by language.

The model is that of ``word_model``: word 3-grams as 64-bit hashes over the spelling of words in code points, nothing folded.
All trusted texts are counted but the held-out fifth, which sets the thresholds. The surprise of a text's words is divided by
its number of characters.

* Decide. The excess of a text's mean surprise over the median of its language's held-out trusted texts is divided by its expected
  noise, sqrt(1/n + 1/``STEADY``) for n characters, so that short and long texts share a scale. It may not exceed the ``QUANTILE`` quantile
  of these values among the held-out texts of the language. That quantile is widened by its own sampling error, ``SURE`` / root of
  their number, and drawn to that of all held-out texts by ``SHARED`` texts; both vanish as the held-out texts grow.

Languages with less than ``LEAST`` trusted symbols, NULL, and those after the ``LANGUAGES`` largest use the model and the thresholds of all
trusted text.
Defined cases: NULL and empty texts have no perplexity and are rejected. Rows that repeat an id are judged each by its
text. A very long text is scored in parts whose sums are added. Without any trusted text nothing with a word is
rejected. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skycolumn.llm import word_model
from skycolumn.llm.common import null_safe
from skycolumn.llm.word_model import POOL
from skycolumn.session import cut_lineage

HELD_OUT = 5
LEAST = 20_000
LANGUAGES = 1000
# Characters beyond which a text's mean gets no steadier.
STEADY = 10_000
QUANTILE, SURE, SHARED = 0.98, 2.0, 50
# Bits of the map of trusted ids that sifts texts before they are joined: at most 2^17 words of 64 bits are broadcast.
SIEVE_BITS = 1 << 23


def sift(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose ``id`` is in ``ids``. A bit map of fixed size drops nearly all others before any text moves."""
    bit = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(SIEVE_BITS))
    shift = lambda name, value, by: F.call_function(name, value, by.cast("int"))
    word, place = F.floor(bit / 64).cast("int"), bit.bitwiseAND(F.lit(63).cast("long"))
    words = cut_lineage(ids.select(word.alias("_word"), shift("shiftleft", F.lit(1).cast("long"), place).alias("_bit"))
                        .groupBy("_word").agg(F.bit_or("_bit").alias("_bits")))
    hit = shift("shiftright", F.col("_bits"), place).bitwiseAND(F.lit(1).cast("long")) == 1
    sifted = rows.join(F.broadcast(words), (word == F.col("_word")) & hit, "left_semi")
    return sifted.join(ids.select("id"), "id", "left_semi")


def judge(docs: DataFrame, trusted_ids: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per distinct (id, text) and language: id, mark (hash of the text), lang, n_symbols, perplexity, limit, kept."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("mark"), null_safe(F.col(f"`{lang}`")).alias("lang"),
                       F.col(f"`{text}`").cast("string").alias("text"))
    trusted = cut_lineage(trusted_ids.select(F.col(trusted_ids.columns[0]).alias("id")).filter("id IS NOT NULL").distinct())
    trusted = trusted.withColumn("held_out", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(HELD_OUT)) == 0)
    sizes = rows.select("id", "lang", F.length("text").alias("c"))
    total = sizes.agg(F.sum("c").alias("c")).first()["c"] or 0
    named = [r["lang"] for r in sizes.join(trusted.filter("NOT held_out"), "id").groupBy("lang").agg(F.sum("c").alias("c")).filter((F.col("c") >= LEAST) & (F.col("lang") != ""))
             .orderBy(F.col("c").desc(), "lang").limit(LANGUAGES).collect()]
    known = F.col("lang").isin(named) if named else F.lit(False)
    rows = rows.withColumn("lang", F.when(known, F.col("lang")).otherwise(F.lit("=" + POOL)))
    scored = word_model.score(rows, sift(rows, trusted.filter("NOT held_out")).select("lang", "text"), total)
    scored = scored.withColumn("mean", F.try_divide("surprise", "n"))
    held = scored.join(trusted.filter("held_out").select("id"), "id", "left_semi").filter("n > 0")
    held = held.withColumn("own", F.lit(True)).unionByName(held.filter(F.col("lang") != "=" + POOL).withColumn("lang", F.lit("=" + POOL)).withColumn("own", F.lit(False)))
    middle = held.groupBy("lang").agg(F.percentile_approx("mean", 0.5, 10000).alias("middle"), F.count(F.lit(1)).alias("c"))
    scaled = held.join(middle, "lang").withColumn("z", (F.col("mean") - F.col("middle")) / F.sqrt(1 / F.col("n") + F.lit(1 / STEADY)))
    widened = lambda c: F.greatest(F.lit(0.0), F.percentile_approx("z", QUANTILE, 10000)) * (1 + SURE / F.sqrt(c))
    limits = cut_lineage(scaled.groupBy("lang", "middle", "c").agg(widened(F.col("c")).alias("upper")))
    shared = scaled.filter("own").agg(widened(F.greatest(F.lit(1), F.count(F.lit(1)))).alias("upper")).first()["upper"]
    # A language without held-out texts takes the limits of all, two numbers.
    pool = limits.filter(F.col("lang") == "=" + POOL).first()
    of_all = lambda c: F.lit(pool[c] if pool else None).cast("double")
    limits = limits.withColumn("upper", (F.col("c") * F.col("upper") + SHARED * F.lit(shared).cast("double")) / (F.col("c") + SHARED)).drop("c")
    out = scored.join(F.broadcast(limits), "lang", "left")  # one row per named language
    limit = F.coalesce("middle", of_all("middle")) + F.coalesce("upper", of_all("upper")) * F.sqrt(F.try_divide(F.lit(1.0), "n") + F.lit(1 / STEADY))
    return out.select("id", "mark", F.expr("substring(lang, 2)").alias("lang"), F.col("n").alias("n_symbols"), F.exp("mean").alias("perplexity"),
                      F.exp(limit).alias("limit"), ((F.col("n") > 0) & F.coalesce(F.col("mean") <= limit, F.lit(True))).alias("kept"))


def trusted_of(labels: DataFrame) -> DataFrame:
    """Ids of documents labelled good and not toxic."""
    return labels.filter("quality = 1 AND coalesce(toxic, 0) = 0").select("doc_id")


def keep_fluent(docs: DataFrame, trusted_ids: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents that the classifier keeps, with their columns as they were."""
    gone = judge(docs, trusted_ids, doc_id, text, lang).filter(~F.col("kept")).select(F.col("id").alias("_id"), F.col("mark").alias("_mark")).distinct()
    same: Column = F.col(f"`{doc_id}`").eqNullSafe(F.col("_id")) & (F.xxhash64(F.col(f"`{text}`")) == F.col("_mark"))
    return docs.join(gone, same, "left_anti")
