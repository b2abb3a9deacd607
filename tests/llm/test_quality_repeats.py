"""Each variable of the outlier rule can reject alone: repeated lines and repeated phrases in groups that have none."""

import random

import pytest
from pyspark.sql import functions as F

from skycolumn.llm import quality_rules


def lines(rng, n):
    return [" ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(8)) for _ in range(n)]


@pytest.fixture(scope="module")
def judged(spark):
    rng, rows = random.Random(5), []

    def add(source, text):
        rows.append((len(rows), text, "en", source))

    def doubled(n, k):
        once = lines(rng, n)
        return "\n".join(once + once[:k])

    def phrase(n, k):
        """k copies of one phrase of six words among n lines; no line is found twice."""
        said = " ".join(w + "x" for w in lines(rng, 1)[0].split()[:6])
        return "\n".join(line + (f" {said} {i}q" if i < k else "") for i, line in enumerate(lines(rng, n)))

    for _ in range(200):
        add("clean", "\n".join(lines(rng, rng.randint(10, 30))))
    for _ in range(5):
        add("clean", doubled(10, 3))  # 23 % of the lines, 46 % of the words
    for _ in range(5):
        add("clean", phrase(16, 8))
    for _ in range(200):
        add("loose", doubled(20, rng.randint(1, 5)))  # at most 20 % of the lines, 40 % of the words
    return rows, quality_rules.classify(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()


def test_planted_repeats(judged):
    _, got = judged
    rows = {r.doc_id: r for r in got}
    assert not any(rows[i].base_failed for i in range(410))
    assert all(rows[i].kept for i in range(200))
    assert not any(rows[i].kept for i in range(200, 210))
    assert all(rows[i].n_dup_lines == 0 for i in range(205, 210))


def test_usual_repeats_are_kept(judged):
    _, got = judged
    assert [(r.n_dup_lines, r.distance) for r in got if r.doc_id >= 210 and not r.kept] == []


def test_lines_alone(spark):
    """Half of the lines doubled, or 45 % of the words in repeated windows, and nothing else."""
    points = spark.range(400).selectExpr("'en' AS g0", "'s' AS g1", "1.7D + (id % 7) * 0.01D AS v_length", "0D AS v_symbols", "0D AS v_lines", "0D AS v_repeats")
    names, floors = list(quality_rules.VECTOR), list(quality_rules.VECTOR.values())
    estimate = quality_rules.mcd_estimates(points, ["g0", "g1"], names, floors)
    far = "SELECT 'en' AS g0, 's' AS g1, 1.73D AS v_length, 0D AS v_symbols, asin(sqrt(0.5D)) AS v_lines, 0D AS v_repeats UNION ALL SELECT 'en', 's', 1.73D, 0D, 0D, asin(sqrt(0.45D))"
    d = spark.sql(far).join(estimate, ["g0", "g1"]).select((quality_rules._distance([F.col(v) for v in names]) / F.col("scale")).alias("d")).collect()
    assert len(d) == 2 and all(r.d > quality_rules.CUTOFF for r in d)
