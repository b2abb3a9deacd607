"""Encoding against the plain tokenizer; packing, matrices and histograms against plain counts."""

import random
import zlib

import numpy as np
import pytest

from skycolumn.llm import length_histogram, repack, token_matrix
from skycolumn.llm.best_fit import best_fit_decreasing, lower_bound
from skycolumn.llm.encode import WordIds, tokenizer_path

SCHEMA = "doc_id long, text string, offset int, sequence_id string"


@pytest.fixture(scope="module")
def encoder():
    return WordIds(tokenizer_path())


def plain_ids(encoder, text):
    return encoder.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_encoder(encoder):
    rng = random.Random(1)
    pool = ["a", "B", "é", "É", "'s", "'LL", "1", "½", " ", "\n", "́", "!", "#", "ß", "­", "Σ", "\t", "<|", "|>", "İ", "\x85", "日", "\x1c", "\x7f"]
    texts = ["".join(rng.choices(pool, k=rng.randint(0, 15))) for _ in range(2000)] + ["<|endoftext|> a<|startoftext|>b", "long " * 300_000 + "end"]
    for t in texts:
        assert encoder.encode(t) == np.array(plain_ids(encoder, t), "<u4").tobytes()


def documents(spark):
    rng = random.Random(6)
    rows = [(i, " ".join("".join(rng.choices("aeiou rstln.", k=rng.randint(1, 9))) for _ in range(rng.choice([3, 40, 400]))), 1, "x") for i in range(120)]
    rows += [(500, None, 1, "x"), (501, "", 1, "x"), (502, "word " * 9000, 1, "x"), (None, "no id", 1, "x"), rows[0], rows[0]]
    return rows, spark.createDataFrame(rows, SCHEMA)


def test_repack(spark, encoder):
    rows, docs = documents(spark)
    got = repack.pack_documents(docs).collect()
    want = []
    for i, t, *_ in rows:
        ids = np.array([*plain_ids(encoder, t), 0], "<u4")
        want += [(i, k, a, len(ids[a:a + 2048]), zlib.crc32(ids[a:a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in got)
    check_places([(r.sequence_id, r.offset, r.length) for r in got], 2048)
    assert len({r.sequence_id for r in got}) == lower_bound(np.bincount([r.length for r in got], minlength=2049), 2048)


def check_places(places, capacity):
    ends = {}
    for sequence, offset, length in sorted(places):
        assert offset == ends.get(sequence, 0)
        ends[sequence] = offset + length
    assert max(ends.values()) <= capacity


def test_exchange_between_groups(spark, tmp_path):
    rng = random.Random(8)
    lengths = [rng.choice([3, 7, 30, 45, 52, 61, 99]) for _ in range(900)]
    items = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "item long, length long")
    got = repack.pack(items, capacity=100, group=60).collect()
    assert sorted(r.item for r in got) == list(range(900))
    check_places([(r.sequence_id, r.offset, r.length) for r in got], 100)
    bound = lower_bound(np.bincount(lengths, minlength=101), 100)
    assert bound <= len({r.sequence_id for r in got}) <= 1.03 * bound + 1
    assert {(r.n_sequences, r.bound) for r in got} == {(len({r.sequence_id for r in got}), bound)}


@pytest.mark.parametrize("rounds", [8, 2])
def test_a_worse_round_is_dropped(spark, monkeypatch, rounds):
    rng = random.Random(12)
    lengths = [rng.choice([3, 7, 30, 45, 52, 61, 99]) for _ in range(900)]
    items = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "item long, length long")
    real, seen = repack._pack, []

    def spoiled(capacity, last):
        seen.append(last)
        plain = real(capacity, last)
        if len(seen) != 2:
            return plain

        def one_each(part):
            return plain(part).assign(bin=range(len(part)), offset=0, opened=not last)

        return one_each

    first_round = repack.pack(items, capacity=100, group=20, rounds=1).select("sequence_id").distinct().count()
    monkeypatch.setattr(repack, "_pack", spoiled)
    got = repack.pack(items, capacity=100, group=20, rounds=rounds).collect()
    assert sorted(r.item for r in got) == list(range(900)) and (len(seen) > 2 if rounds > 2 else len(seen) == 2)
    check_places([(r.sequence_id, r.offset, r.length) for r in got], 100)
    n = len({r.sequence_id for r in got})
    assert n <= first_round
    assert {(r.n_sequences, r.bound) for r in got} == {(n, lower_bound(np.bincount(lengths, minlength=101), 100))}


def test_bound_is_never_above_the_best():
    def best(items, capacity):
        def place(k, bins):
            if k == len(items):
                return len(bins)
            found = len(items)
            for i in range(len(bins)):
                if bins[i] + items[k] <= capacity:
                    found = min(found, place(k + 1, bins[:i] + [bins[i] + items[k]] + bins[i + 1:]))
            return min(found, place(k + 1, bins + [items[k]]))

        return place(0, [])

    rng = random.Random(4)
    for _ in range(60):
        items = [rng.randint(1, 20) for _ in range(6)]
        least = best(items, 20)
        assert lower_bound(np.bincount(items, minlength=21), 20) <= least <= len(best_fit_decreasing(np.array(items), 20)[2])
    assert lower_bound(np.bincount([11] * 7, minlength=21), 20) == 7


def test_best_fit_is_tightest():
    rng = random.Random(9)
    lengths = np.array([rng.randint(1, 50) for _ in range(900)])
    _, _, loads = best_fit_decreasing(lengths, 64)
    free = []
    for n in sorted(lengths.tolist(), reverse=True):
        fit = [f for f in free if f >= n]
        if fit:
            free.remove(min(fit))
            free.append(min(fit) - n)
        else:
            free.append(64 - n)
    assert sorted(64 - loads) == sorted(free)


def test_matrix_round_trip(spark, encoder):
    rows, docs = documents(spark)
    got = token_matrix.packed_rows(docs, group_tokens=5000).collect()
    found = {}
    for r in got:
        ids, positions = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == len(positions) == 2048 and r.cu_seqlens[-1] == r.n_tokens and set(ids[r.n_tokens:]) <= {token_matrix.PAD_ID}
        for a, b, i, k, s in zip(r.cu_seqlens, r.cu_seqlens[1:], r.doc_ids, r.pieces, r.starts):
            assert positions[a:b].tolist() == list(range(b - a)) and s == k * 2048
            found.setdefault((i, k), []).append(ids[a:b].tolist())
    for i, t, *_ in rows:
        want, k, joined = [*plain_ids(encoder, t), token_matrix.END_ID], 0, []
        while (i, k) in found:
            joined += found[i, k][0]
            k += 1
        assert joined == want
    assert len(found[0, 0]) == 3


def test_histogram(spark, encoder):
    rows, docs = documents(spark)
    lengths = sorted(len(plain_ids(encoder, t)) + 1 for _, t, *_ in rows)
    histogram = length_histogram.length_histogram(length_histogram.encoded_lengths(docs))
    got = {r.context: r for r in histogram.collect()}
    assert sorted(got) == sorted(set(lengths))
    for n, r in got.items():
        assert r.n_docs == lengths.count(n) and r.n_tokens == n * r.n_docs
        assert r.docs_from == sum(x >= n for x in lengths) and r.tokens_from == sum(x for x in lengths if x >= n)
        assert r.truncated_tokens == sum(min(x, n) for x in lengths)
        assert r.quantile == pytest.approx(sum(x <= n for x in lengths) / len(lengths))
    limits = {r.limit: r for r in length_histogram.at_limits(histogram, [1, 50, 10**6]).collect()}
    for n, r in limits.items():
        assert (r.docs_over, r.truncated_tokens) == (sum(x > n for x in lengths), sum(min(x, n) for x in lengths))


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert repack.pack_documents(docs).collect() == []
    assert token_matrix.packed_rows(docs).collect() == []
    assert length_histogram.length_histogram(length_histogram.encoded_lengths(docs)).collect() == []


def test_ids_beyond_two_bytes(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    with pytest.raises(Exception, match="16 bits"):
        token_matrix.packed_rows(docs, end_id=70_000).collect()
