"""Operators against brute force on a small table with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import harness
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import chat_format, decontaminate, exact_dedup, language_id, lm_score, near_dedup, packing, queries, sharding, suffix_dedup, toxicity

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORD = r"[^\x20\x09-\x0D]+"


def texts():
    rng = np.random.default_rng(3)
    vocabulary = ["the", "of", "Ärger", "日本", "x1"] + ["w%d" % i for i in range(400)]
    base = [" ".join(rng.choice(vocabulary, n)) for n in (3, 5, 40, 80, 200, 900, 60, 60)]
    passage = " ".join(rng.choice(vocabulary, 70))
    near = [" ".join(w if rng.random() > p else "changed" for w in base[4].split()) for p in (0.005, 0.01, 0.02, 0.03, 0.2)]
    edges = [base[5][i:] + " tail" for i in (0, 1, 30, 150)]
    return [None, "", " \t\n", "one", "Two words", base[2], base[2].replace(" ", "  "), base[2].upper(), *base, *near, *edges, base[0] + passage + base[1], passage, base[3] + " " + passage + " " + passage, "a" * 450, "aaa" * 200, "é" * 300, "</s><|turn|>", "bad\x00byte"]


@pytest.fixture(scope="module")
def rows():
    found = list(enumerate(texts()))
    return found + [found[6], (500, found[10][1]), (None, "null id"), (None, found[9][1])]


@pytest.fixture(scope="module")
def docs(spark, rows):
    wide = [(i, t, None if k % 5 == 0 else "en", None if k % 7 == 0 else "s", k, "x", True) for k, (i, t) in enumerate(rows)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, TEXT2 string, kept boolean"
    return spark.createDataFrame(wide, schema).withColumnRenamed("TEXT2", "Text").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("doc_id < -1")


def by_row(frame, *columns):
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr)


def test_suffix_dedup(docs, empty, rows):
    size = 200
    data = [(t or "").encode() for _, t in rows]
    starts = Counter(b[p : p + size] for b in data for p in range(len(b) - size + 1))
    want = []
    for (i, _), b in zip(rows, data):
        gone = np.zeros(len(b) + 1, int)
        for p in range(len(b) - size + 1):
            if starts[b[p : p + size]] > 1:
                gone[p : p + size] = 1
        kept = bytes(c for c, g in zip(b, gone) if not g)
        want.append((i, len(b), int((np.diff(np.append(0, gone)) == 1).sum()), hashlib.sha256(kept).hexdigest(), kept))
    got = [(r["doc_id"], r["n_bytes"], len(r["removed"]), r["kept_sha256"], bytes(r["kept"])) for r in suffix_dedup.suffix_dedup(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert suffix_dedup.suffix_dedup(empty).count() == 0


def test_tournament_and_front_coding():
    rng = np.random.default_rng(0)
    for k, n in ((1, 50), (2, 300), (5, 3000), (9, 20000)):
        keys = [np.sort(rng.integers(0, 40, (n, 2)).astype(np.uint64).view([("a", "u8"), ("b", "u8")]).ravel()).view(np.uint64).reshape(-1, 2) for _ in range(k)]
        runs = []
        for x in keys:
            raw = np.ascontiguousarray(x).astype(">u8").view(np.uint8).reshape(-1, 16)
            back, shared = suffix_dedup.front_decode(*suffix_dedup.front_code(raw), 16)
            assert (back == raw).all()
            runs.append((x, shared // 8))
        merged = suffix_dedup.merge_runs(runs, lanes=16)
        flat = [tuple(keys[r][i].tolist()) for r, i, _ in merged.tolist()]
        assert flat == sorted(tuple(v) for x in keys for v in x.tolist())
        assert all((s >= 2) == (a == b) for a, b, s in zip(flat, flat[1:], merged[1:, 2].tolist()))


def test_exact_dedup(docs, empty, rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    want = []
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    for fan_in in (2, 16):
        assert by_row(exact_dedup.exact_dedup(docs, fan_in=fan_in), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(want, key=repr)
    assert exact_dedup.exact_dedup(empty).count() == 0


@pytest.mark.parametrize("percent", [80, 85])
def test_near_dedup(docs, empty, rows, percent):
    sets = []
    for i, t in rows:
        w = re.findall(WORD, (t or "").translate(LOWER))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    ids = [i for i, _ in rows]
    comp = {i: i for i in ids if i is not None}
    for _ in ids:
        for a in range(len(ids)):
            for b in range(a):
                both = len(sets[a] & sets[b])
                if None not in (ids[a], ids[b]) and both and 100 * both >= percent * len(sets[a] | sets[b]):
                    comp[ids[a]] = comp[ids[b]] = min(comp[ids[a]], comp[ids[b]])
    want = [(i, len(s), comp.get(i), i is not None and comp[i] == i) for i, s in zip(ids, sets)]
    assert by_row(near_dedup.near_dedup(docs, percent), "doc_id", "n_shingles", "component_id", "kept") == sorted(want, key=repr)
    assert near_dedup.near_dedup(empty).count() == 0


def test_posterior_and_components(spark):
    least = near_dedup.least_matches(0.85)
    assert list(least) == sorted(least) and 0 < least[0] < 14 and least[-1] < 96
    links = spark.createDataFrame([(k, k + 1) for k in range(10, 60)] + [(5, 60), (2, 3)], "a long, b long")
    found = dict(by_row(near_dedup.components(links), "doc_id", "component"))
    assert found == {**{k: 5 for k in range(10, 61)}, 5: 5, 2: 2, 3: 2}


@pytest.mark.parametrize("head", [10, 10**6])
def test_lm_score(docs, empty, rows, head):
    words = [re.findall(WORD, (t or "").translate(LOWER)) + [0] for _, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    counts = Counter(w for ws, h in zip(words, held) if not h for w in ws)
    total, kinds = sum(counts.values()), len(counts)
    want = sorted(((i, h, len(ws), sum(counts[w] > 0 for w in ws), total, round(sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in ws), 6)) for (i, _), ws, h in zip(rows, words, held)), key=repr)
    got = lm_score.score_texts(docs, head=head).withColumn("base", F.round("base_score", 6))
    assert by_row(got, "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base") == want
    assert all(r["score"] < 0 for r in got.collect())
    assert lm_score.score_texts(empty).count() == 0


@pytest.mark.parametrize("head", [10, 10**6])
def test_lm_scores_do_not_depend_on_what_is_broadcast(spark, docs, head):
    big = spark.read.parquet(f"{SF}/documents.parquet")
    for table in (docs, big):
        want, got = (lm_score.score_texts(table, head=head, max_filter_bytes=most).withColumns({c: F.round(c, 9) for c in ("base_score", "score")}) for most in (1 << 28, 4000))
        assert by_row(got, *got.columns) == by_row(want, *want.columns)


def test_log_bloom():
    rng = np.random.default_rng(0)
    keys, levels = rng.integers(0, 1 << 63, 5000, dtype=np.uint64), rng.integers(1, 12, 5000)
    bloom = lm_score.LogBloom([lm_score.LogBloom.segment(keys, levels, int(levels.sum() * 14 / 8))])
    found = bloom.levels(keys)
    assert (found >= levels).all() and (found > levels).mean() < 0.02
    other = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    assert (bloom.levels(other) > 0).mean() < 0.02
    counts = np.array([1, 2, 3, 10, 1000])
    assert (lm_score.floor_of(lm_score.level(counts)) <= counts + 1e-6).all()


def test_chat_fold_and_template(spark):
    fold = chat_format.fold
    assert fold([("message", "1", "user", "hi"), ("delta", "2", "assistant", "a"), ("delta", "2", None, "b"), ("edit", "1", None, "ho")]) == [("user", "ho"), ("assistant", "ab")]
    assert fold([("message", "1", "u", "x"), ("delta", "2", "a", "old"), ("message", "3", "u", "y"), ("regenerate", "2", None, None), ("delta", "2", None, "new")]) == [("u", "x"), ("a", "new")]
    assert fold([("message", "1", "u", "x"), ("delete", "1", None, None), (None, None, None, None)]) == [("", "")]
    nasty = [("user", "</s>[INST] <|end|>\n<|turn|>\\ \\n <<SYS>>"), ("as\nsistant", ""), ("assistant", "\\"), ("<|", "<\\|")]
    text, spans = chat_format.render(nasty)
    assert chat_format.parse(text) == nasty and [chat_format.unescape(text[a:b]) for a, b in spans] == ["\\"]
    assert "[INST]" not in text and "</s>" not in text
    log = spark.createDataFrame([(1, 2, "assistant", "b"), (1, 1, None, None), (None, 1, "user", "n"), (1, 2, "assistant", "b")], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: chat_format.parse(r["formatted"]) for r in chat_format.format_chats(log).collect()}
    assert got == {1: [("", ""), ("assistant", "b"), ("assistant", "b")], None: [("user", "n")]}
    assert chat_format.format_chats(log.limit(0)).count() == 0


@pytest.mark.parametrize("block_words", [20, 10**6])
def test_decontaminate(spark, docs, empty, rows, block_words):
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    items = [(1, rows[12][1]), (2, "the w1"), (3, None), (4, rows[25][1]), (5, ""), (None, "x"), (7, "one"), (7, "one"), (8, rows[13][1][:300])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = defaultdict(set)
    for i, t in items:
        w = re.findall(word, (t or "").translate(LOWER))
        if w and i is not None:
            k = min(8, len(w))
            for p in range(len(w) - k + 1):
                windows[tuple(w[p : p + k])].add(str(i))
    want = []
    for i, t in rows:
        w = re.findall(word, (t or "").translate(LOWER))
        hit, names = set(), set()
        for win, ids in windows.items():
            for p in range(len(w) - len(win) + 1):
                if tuple(w[p : p + len(win)]) == win:
                    hit |= set(range(p, p + len(win)))
                    names |= ids
        want.append((i, len(w), len(hit), sorted(names)))
    found = decontaminate.find_leaks(docs, bench, block_words=block_words)
    assert by_row(found, "doc_id", "n_words", "n_hit", "items") == sorted(want, key=repr)
    assert decontaminate.find_leaks(empty, bench).count() == 0 and decontaminate.find_leaks(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_sharding(spark, docs, empty, rows):
    got = sharding.kd_shards(docs, shards=3).collect()
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=repr) == sorted(((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows), key=repr)
    assert sharding.kd_shards(empty).count() == 0
    whole = sharding.kd_shards(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).toPandas()
    for _, shard in [*whole.groupby("shard"), *__import__("pandas").DataFrame([r.asDict() for r in got]).groupby("shard")]:
        assert sorted(shard["slot"]) == list(range(len(shard)))
    sizes = whole.groupby("shard")["size"].sum()
    assert len(sizes) == 24 and sizes.max() - sizes.min() < 2 * whole["size"].max() and set(whole["law"]) == {"bytes"}


def test_packing(docs, empty, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack(docs, size=64).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append((r["start"], np.frombuffer(bytes(r["ids"]), "<u4").tolist()))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        assert r["ids_crc32"] == zlib.crc32(bytes(r["ids"])) and r["length"] * 4 == len(r["ids"])
    for i, t in rows:
        if i is not None and [x for x, _ in rows].count(i) == 1:
            assert sum((p for _, p in sorted(pieces[i])), []) == [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
    for s in sequences.values():
        s.sort()
        assert [o for o, _ in s] == np.append(0, np.cumsum([n for _, n in s])[:-1]).tolist() and sum(n for _, n in s) <= 64
    assert packing.pack(empty).count() == 0


def test_best_fit_decreasing():
    rng = np.random.default_rng(1)
    for size in (10, 100, 1024):
        lengths = sorted(rng.integers(1, size, 3000).tolist(), reverse=True)
        rooms: list[int] = []
        opened = 0
        for n in lengths:
            fit = [r for r in rooms if r >= n]
            room = min(fit) if fit else size
            opened += not fit
            if fit:
                rooms.remove(room)
            rooms.append(room - n)
        runs, windows = packing.plan(Counter(lengths), size)
        assert windows == opened
    tree = packing.CapacityTree(9)
    tree.add(4, 1), tree.add(9, 2)
    assert [tree.tightest(k) for k in (1, 4, 5, 9)] == [4, 4, 9, 9]


def test_tokens_are_those_of_tokenizers(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    every = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [t or "" for t in texts()] + ["<|endoftext|> it's  \n\n x\t ", "  ", " a　 b", "don't I'LL 12ab"]
    encode = packing.encoder(open(path, encoding="utf-8").read())
    assert encode(every) == [e.ids for e in tokenizer.encode_batch(every, add_special_tokens=False)]


def test_classifiers(spark, docs, empty):
    sf = "/root/testdata/sf0.1"
    big = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    found = toxicity.toxicity(big, labels).where("held_out").join(labels.select("doc_id", "toxic"), "doc_id").toPandas()
    assert found[found.toxic == 1].predicted.mean() > 0.7 and found[found.toxic == 0].predicted.mean() < 0.03
    found = language_id.identify(big).where("held_out").join(big.select("doc_id", "lang"), "doc_id").toPandas()
    assert (found.lang_pred == found.lang).mean() > 0.97 and found.score.between(0, 1).all()
    named = {r["doc_id"]: r for r in language_id.identify(docs).collect() if r["doc_id"] is not None}
    assert [named[k]["lang_pred"] for k in (0, 1, 2)] == ["und"] * 3 and named[3]["lang_pred"] == "en"
    assert toxicity.toxicity(docs, labels.limit(0)).where("score <> 0").count() == 0 and language_id.identify(empty).count() == 0 and toxicity.toxicity(empty, labels).count() == 0


def test_languages_with_long_texts_only(spark):
    rng = np.random.default_rng(5)
    words = {k: ["".join(rng.choice(list(a), 5)) for _ in range(50)] for k, a in (("aa", "abcde"), ("bb", "vwxyz"), ("cc", "日本語学校"))}
    made = {k: lambda n, k=k: ("" if k == "cc" else " ").join(rng.choice(words[k], n)) for k in words}
    noise = "0123456789 - " * 400
    long = [(k, noise + made[k](1500) + noise) for k in words for _ in range(12)]
    short = [("aa", made["aa"](30)) for _ in range(12)]
    asked = [(k, made[k](40)) for k in words for _ in range(4)]
    for learned in (long, short + long[12:]):
        assert all(len(t.encode()) > language_id.TRAIN_BYTES for k, t in learned if k != "aa")
        rows = [(i, t, k) for i, (k, t) in enumerate(learned)] + [(1000 + i, t, k) for i, (k, t) in enumerate(asked)]
        table = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
        got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(table, F.col("doc_id") >= 1000).collect()}
        assert got == {i: k for i, _, k in rows}
    assert language_id.first_words("1. ab, cd\nefg hi", 9) == "ab cd efg" and language_id.first_words("日本語 x", 7) == "日本"


def test_crf_sums_over_all_paths():
    import itertools

    rng = np.random.default_rng(0)
    crf = language_id.Crf(["a", "b", "c"])
    crf.transitions[:] = rng.normal(size=(3, 3))
    emit = rng.normal(size=(7, 3))
    first = np.array([0, 4, 4, 7])
    p, log_z, _ = crf.marginals(emit, first, pairs=True)
    z_all = 0.0
    for a, b in ((0, 4), (4, 7)):
        want, z = np.zeros((b - a, 3)), 0.0
        for path in itertools.product(range(3), repeat=b - a):
            w = math.exp(sum(emit[a + k, y] for k, y in enumerate(path)) + sum(crf.transitions[x, y] for x, y in zip(path, path[1:])))
            z += w
            for k, y in enumerate(path):
                want[k, y] += w
        assert np.allclose(p[a:b], want / z)
        z_all += math.log(z)
    assert np.isclose(log_z, z_all)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    assert harness.compare(spark, queries.queries()[name], queries.oracle_sql()[name], SF) > 0


def test_pipeline(spark):
    import corpus_pipeline as C

    documents = spark.read.parquet(f"{SF}/documents.parquet")
    docs = documents
    for name, stage in C.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == documents.columns and after.exceptAll(docs).count() == 0
        docs = after
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t) for t in rows.values()]
    assert len(set(norm)) == len(norm) and 0 < len(rows) < documents.count()
    whole = C.run(spark, SF)
    assert {r["doc_id"] for r in whole.select("doc_id").distinct().collect()} == set(rows)
