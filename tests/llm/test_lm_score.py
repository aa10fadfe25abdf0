"""The language model against an exact one: the same formula with counts as they are, by dictionaries."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.llm import lm_score as L

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
END = object()


def words_of(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), END]


def exact_scores(rows, min_pair):
    """(score, tokens) of each row; learned from rows that are not held out."""
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    tokens = [words_of(t) for _, t in rows]
    train = [w for w, h in zip(tokens, held) if not h]
    one = Counter(w for ws in train for w in ws)
    two = Counter(p for ws in train for p in zip([END, *ws], ws))
    total, kinds, after = sum(one.values()), len(one), defaultdict(float)
    for (v, _), n in two.items():
        after[v] += n - 0.75 if n >= min_pair else 0

    def p(v, w):
        alone = (one[w] + 1) / (total + kinds + 1)
        if not after[v]:
            return alone
        n = two[v, w]
        return (n - 0.75) * (n >= min_pair) / one[v] + (1 - after[v] / one[v]) * alone

    return [(sum(math.log10(p(v, w)) for v, w in zip([END, *ws], ws)), len(ws)) for ws in tokens]


@pytest.mark.parametrize("min_pair", [1, 2, 3])
def test_scores_are_near_those_of_an_exact_model(spark, min_pair):
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    table = table.union(spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (None, "one two one two")], "doc_id long, text string"))
    rows = [(r["doc_id"], r["text"]) for r in table.collect()]
    want = dict(zip([i for i, _ in rows], exact_scores(rows, min_pair)))
    got = {r["doc_id"]: r for r in L.score_texts(table, min_pair=min_pair).collect()}
    apart = np.array([(got[i]["score"] - s) / n for i, (s, n) in want.items()])
    assert all(got[i]["n_tokens"] == n for i, (_, n) in want.items())
    # Levels lie at most a factor of 2^(1/4) apart; a rest, a word before and a word make three of them for a token.
    assert np.abs(apart).max() < 3 * math.log10(2**0.25) and abs(apart.mean()) < 0.075, (np.abs(apart).max(), apart.mean())


@pytest.mark.parametrize("min_pair", [1, 2])
def test_probabilities_after_a_word_sum_to_one_at_most(min_pair):
    rng = np.random.default_rng(2)
    for trial in range(20):
        kinds = int(rng.integers(3, 60))
        toks = rng.integers(1, 1 << 63, kinds, dtype=np.uint64)[(rng.zipf(1.3, 3000) - 1) % kinds]
        toks = np.append(toks, L.END)
        words, one = np.unique(toks, return_counts=True)
        before = L.words_before(toks, np.array([0, len(toks)]))
        pairs = Counter(zip(before.tolist(), toks.tolist()))
        sums = Counter()
        for (v, _), n in pairs.items():
            if n >= min_pair:
                sums[v] += int(L.UNIT * L.floor_of(L.level(np.array([n]), min_pair), min_pair)[0] - L.DISCOUNT)
        m = L.Model(None, L.Few(words[:0]), len(toks), len(words), words, one, min_pair)
        every = np.append(words, np.uint64(12345))  # all words, and one that was never seen
        levels_of = lambda f, x: L.level(np.array([f(k) for k in x]))
        for v in every:
            n = len(every)
            asked = L.Asked(every, np.arange(n), np.full(n, np.flatnonzero(every == v)[0]), np.arange(n), np.arange(n), np.full(n, np.flatnonzero(every == v)[0]))
            count = dict(zip(words.tolist(), one.tolist()))
            after = np.array([sums[int(w)] for w in every])
            told = L.Levels(
                levels_of(lambda w: count.get(int(w), 0), every),
                np.where(after > 0, L.rest_levels(np.array([count.get(int(w), 1) for w in every]), after), 0),
                L.level(np.array([pairs[int(v), int(w)] for w in every]), min_pair),
            )
            assert m.probabilities(asked, told).sum() <= 1 + 1e-12


def test_levels_and_their_counts():
    for least in (1, 2, 3, 5, 9, 33):
        n = np.arange(least, 5000)
        low = L.floor_of(L.level(n, least), least)
        assert (L.level(n, least) >= 1).all() and (low <= n).all() and (n < low * 2**0.25 + 1).all()
        assert (L.level(np.arange(least), least) <= 1).all() and L.level(np.array([0]), least)[0] == 0
    n = np.arange(1, 5000)
    assert (L.most_of(L.level(n)) >= n).all() and (L.level(L.most_of(L.level(n))) == L.level(n)).all()


def test_range_count_follows_the_texts_and_changes_no_score(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    a, b, c = (L.score_texts(table, range_bytes=n, max_filter_bytes=most).select("doc_id", "base_score", "n_known", F.round("score", 3).alias("score")).toPandas().sort_values("doc_id") for n, most in ((1 << 30, 1 << 28), (20_000, 1 << 28), (20_000, 1)))
    assert (a.n_known.values == b.n_known.values).all() and np.allclose(a.base_score, b.base_score)
    assert np.abs(a.score.values - b.score.values).max() < 0.01 * np.abs(a.score.values).max()  # other false hits of the filter
    assert np.allclose(b.score, c.score)


def test_hot_words_are_spread_and_counted(spark):
    """One word follows another in half of all pairs, so that it is hot wherever documents are looked at."""
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(x for w in rng.integers(0, 300, 60) for x in ("the", f"w{w}"))) for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = exact_scores(rows, 2)
    got = {r["doc_id"]: r["score"] for r in L.score_texts(table, range_bytes=10_000).collect()}
    apart = np.array([(got[i] - s) / n for i, (s, n) in enumerate(want)])
    assert np.abs(apart).max() < 0.15
    blocks = list(L._count(iter([pa.RecordBatch.from_arrays([pa.array([t for _, t in rows])], ["text"])]), 16, L.Few(L.tokens(*next(L.text_blocks(pa.array(["the"])))[1:])[0][:1])))
    sizes = Counter()
    for b in blocks:
        for r, kind, h in zip(b["range"].to_pylist(), b["kind"].to_pylist(), b["hashes"].to_pylist()):
            sizes[r] += len(h) if kind == "p" else 0
    assert max(sizes.values()) < 0.25 * sum(sizes.values())
