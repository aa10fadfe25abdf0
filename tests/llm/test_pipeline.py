"""Each stage of the pipeline against brute force over rows with repeated, shared and null ids."""

import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as C

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """A folder with a small benchmark."""
    at = tmp_path_factory.mktemp("sf")
    rng = np.random.default_rng(8)
    items = [(k, " ".join(f"item{k}x{j}" for j in rng.permutation(20))) for k in range(3)] + [(7, None), (8, ""), (None, "good day")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), [t for k, t in items if k is not None and t]


@pytest.fixture(scope="module")
def rows(sf):
    rng = np.random.default_rng(9)
    english = lambda n: " ".join(rng.choice("the of and house river walked slowly under green light morning old stone bridge water child".split(), n))
    a, b, x, long = english(60), english(70), english(30), english(400)
    words = long.split()
    near = [" ".join([*words[:k], f"new{k}", *words[k + 1 :]]) for k in (50, 150, 390)]
    leaked = f"{english(20)} {' '.join(sf[1][1].split()[4:12])} {english(20)}"
    almost = f"{english(20)} {' '.join(sf[1][1].split()[4:11])} {english(20)}"
    found = [(3, a), (5, a), (5, b), (9, b), (4, x), (4, x), (None, a), (None, a), (None, None), (6, ""), (6, " \t"), (2, "123 456"), (7, b.replace(" ", "  "))]
    found += [(20, long), *((k, t) for k, t in zip((21, 19, None), near)), (21, near[0]), (30, leaked), (30, almost), (None, leaked), (31, leaked.upper()), (32, "one two"), (33, "one two")]
    return [(i, t, "en", f"s{n % 2}", n) for n, (i, t) in enumerate(found)]


def stage(name, spark, rows, sf):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    after = dict(C.STAGES)[name](spark, docs, sf[0])
    assert after.columns == docs.columns
    return Counter(tuple(r) for r in after.collect())


def first_of(group):
    return min(group, key=lambda r: (r[0] is None, r[0] or 0, r[4]))


def test_language_goes_by_text(spark, rows, sf):
    got = stage("language_id", spark, rows, sf)
    want = Counter(r for r in rows if re.search(r"[A-Za-z]", r[1] or ""))
    assert got == want


def test_exact_keeps_one_row_of_a_text(spark, rows, sf):
    groups = {}
    for r in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or ""), []).append(r)
    got = stage("exact_dedup", spark, rows, sf)
    assert sum(got.values()) == len(groups) and set(got.values()) == {1}
    for group in groups.values():
        (kept,) = [r for r in group if r in got]
        assert kept[0] == first_of(group)[0]


def test_near_keeps_one_row_of_a_component(spark, rows, sf):
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (r[1] or "").translate(LOWER))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    label = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(i):
                if sets[i] and 100 * len(sets[i] & sets[j]) >= C.NEAR_PERCENT * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
    got = stage("near_dedup", spark, rows, sf)
    groups = [[r for r, s, k in zip(rows, sets, label) if k == c and s] for c in set(label)]
    groups = [g for g in groups if g]
    assert any(len(g) > 3 for g in groups)
    for group in groups:
        kept = [r for r in group if r in got]
        assert len(kept) == 1 and kept[0][0] == first_of(group)[0]
    assert all(r in got for r, s in zip(rows, sets) if not s) and sum(got.values()) == len(groups) + sum(not s for s in sets)


def test_benchmark_drops_rows_with_a_window(spark, rows, sf):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {tuple(w[k : k + 8]) for t in sf[1] for w in [word.findall(t.translate(LOWER))] for k in range(len(w) - 7)}

    def leaks(text):
        w = word.findall((text or "").translate(LOWER))
        return any(tuple(w[k : k + 8]) in windows for k in range(len(w) - 7))

    want = Counter(r for r in rows if not leaks(r[1]))
    assert 0 < len(rows) - sum(want.values()) < len(rows) and stage("decontaminate", spark, rows, sf) == want


def test_empty_tables_stay_empty(spark, sf):
    for name, _ in C.STAGES[:-1]:
        assert not stage(name, spark, [], sf)


def test_extra_columns_with_clashing_names(spark, rows, sf):
    docs = spark.createDataFrame([(*r, 1, 2, "x") for r in rows[:6]], f"{SCHEMA}, row long, digest long, other string").withColumnRenamed("other", "TEXT")
    for name, f in C.STAGES[:-1]:
        after = f(spark, docs, sf[0])
        assert after.columns == docs.columns and 0 < after.count() <= 6
