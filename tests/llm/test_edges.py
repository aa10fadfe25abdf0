"""Cases at the edges: big and null ids, long words, hot groups in several blocks, both ways of a join, events, labels."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.llm import chat_format, common, exact_dedup, language_id, near_dedup, packing, sharding, suffix_dedup, toxicity

SF = "/root/testdata/sf0.001"
WORDS = [f"w{k}" for k in range(500)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS, n))


def thue_morse(n):
    return np.array([bin(k).count("1") % 2 for k in range(n)])


# ---- words -------------------------------------------------------------------------------------


def test_long_words_of_the_thue_morse_sequence_differ():
    for n in (64, 127, 128, 512, 1024, 2048, 4096):
        one, other = ("".join("ab"[k ^ flip] for k in thue_morse(n)) for flip in (0, 1))
        buf = np.frombuffer(f"{one} {other} {one}".encode(), np.uint8)
        hashes, first = common.word_hashes(buf, np.array([0]), np.array([len(buf)]), common.NOT_SPACE)
        assert len(hashes) == 3 and hashes[0] == hashes[2] != hashes[1]
    words = np.array([3, 5], np.uint64)
    for n in (1024, 2048):
        both = np.concatenate([words[thue_morse(n)], words[1 - thue_morse(n)]])
        grams, _ = common.gram_hashes(both, np.array([0, n, 2 * n]), 1 << 40)
        assert grams[0] != grams[1]


def test_a_shared_folder_must_be_named_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())
    Context.master = "local-cluster[2,1,1024]"
    with pytest.raises(RuntimeError):
        common.shared_dir(Session())


# ---- exact and near dedup ----------------------------------------------------------------------


def test_exact_dedup_of_big_ids_beside_null_ones(spark):
    big = (1 << 53) + 1
    rows = [(big + 2 * k, f"text {k % 40}") for k in range(50)] + [(None, f"text {k}") for k in range(50)] + [(-(1 << 63), "least"), ((1 << 63) - 1, "least"), ((1 << 63) - 1, "most"), (None, "none"), (None, "none")]
    want = []
    for i, t in rows:
        ids = [j for j, u in rows if u == t]
        keep = min((j for j in ids if j is not None), default=None)
        want.append((i, keep, len(ids), i == keep))
    for parts, fan_in in ((1, 16), (5, 2)):
        table = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got = exact_dedup.exact_dedup(table, fan_in=fan_in).select("doc_id", "keep_id", "group_size", "kept").collect()
        assert Counter(map(tuple, got)) == Counter(want)


def test_near_dedup_with_a_bucket_of_several_blocks(spark, monkeypatch):
    """Texts around the threshold that share buckets without being of one component."""
    rng = np.random.default_rng(12)
    base = prose(rng, 120).split()
    rows = []
    for k in range(60):
        words = list(base)
        for at in rng.choice(120, int(rng.integers(1, 6)), replace=False):
            words[at] = f"x{k}y{at}"
        rows.append((k, " ".join(words)))
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    label = list(range(60))
    for _ in range(60):
        for a in range(60):
            for b in range(a):
                if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    assert 1 < len(set(label)) < 60
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    monkeypatch.setattr(near_dedup, "BROADCAST_ROWS", 0)
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == dict(enumerate(label))


# ---- suffix dedup ------------------------------------------------------------------------------


@pytest.mark.parametrize("spread", [1, 20_000])
def test_suffix_dedup_does_not_depend_on_what_is_broadcast(spark, monkeypatch, spread):
    table = spark.read.parquet(f"{SF}/documents.parquet").repartition(5)
    want = Counter(map(tuple, suffix_dedup.suffix_dedup(table).select("doc_id", "n_bytes", "kept_sha256").collect()))
    monkeypatch.setattr(suffix_dedup, "SEED_ROWS", 0)
    monkeypatch.setattr(suffix_dedup, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(suffix_dedup, "SPREAD_CLASSES", spread)
    monkeypatch.setattr(suffix_dedup, "PART_WINDOWS", 2000)
    assert Counter(map(tuple, suffix_dedup.suffix_dedup(table).select("doc_id", "n_bytes", "kept_sha256").collect())) == want


def test_windows_of_very_long_texts_are_scanned_in_pieces(monkeypatch):
    rng = np.random.default_rng(6)
    data = [rng.integers(97, 101, n).astype(np.uint8) for n in (20_000, 150, 9_000, 200, 4_095, 4_096)]
    starts, lens = np.append(0, np.cumsum([len(x) for x in data]))[:-1], np.array([len(x) for x in data])
    whole = suffix_dedup.anchored_runs(np.concatenate(data), starts, lens)
    monkeypatch.setattr(suffix_dedup, "_POS", np.uint64((1 << 12) - 1))
    pieces = suffix_dedup.anchored_runs(np.concatenate(data), starts, lens)
    for found in (whole, pieces):
        covered = Counter((int(d), int(f) + k) for d, f, n in zip(*found[:3]) for k in range(int(n)))
        assert covered == Counter((d, k) for d, n in enumerate(lens) for k in range(max(0, n - 199)))


# ---- chats -------------------------------------------------------------------------------------


def test_events_of_a_log_are_folded_on_spark(spark):
    log = [
        (1, 1, "message", "m1", "user", "hi"), (1, 2, "delta", "m2", "assistant", "an"), (1, 3, "delta", "m2", None, "swer"), (1, 4, "edit", "m1", None, "hello"),
        (1, 5, "regenerate", "m2", None, None), (1, 6, "delta", "m2", None, "better"), (1, 7, "message", "m3", "user", "bye"), (1, 8, "delete", "m3", None, None),
        (2, None, None, None, "user", "first"), (2, 1, "message", None, "assistant", None), (2, 1, "message", None, "assistant", None), (None, 1, "delta", "x", None, "lone"),
    ]
    table = spark.createDataFrame([(*r, 5, "z") for r in log], "conv_id long, turn long, what string, which string, role string, text string, seq long, other string").withColumnRenamed("other", "kind")
    got = chat_format.format_chats(table.repartition(4), kind_col="what", message_col="which")
    read = {r["conv_id"]: (r["n_turns"], chat_format.parse(r["formatted"]), [r["formatted"][s["begin"] : s["end"]] for s in r["loss_spans"]]) for r in got.collect()}
    assert read == {
        1: (2, [("user", "hello"), ("assistant", "better")], ["better"]),
        2: (3, [("user", "first"), ("assistant", ""), ("assistant", "")], ["", ""]),
        None: (1, [("", "lone")], []),
    }
    with pytest.raises(Exception, match="unknown kind"):
        chat_format.format_chats(spark.createDataFrame([(1, 1, "sing", "user", "la")], "conv_id long, turn long, what string, role string, text string"), kind_col="what").collect()


# ---- sharding ----------------------------------------------------------------------------------


def test_shards_are_those_of_a_kd_tree(spark):
    """Every cut lies along the widest dimension, as near to the wanted bytes as rows allow."""
    rng = np.random.default_rng(21)
    rows = [(int(i), prose(rng, int(n)), str(rng.choice(["en", "de"])) if k % 3 else "en", f"s{int(rng.integers(5))}") for k, (i, n) in enumerate(zip(rng.integers(0, 10**6, 400), rng.zipf(1.5, 400).clip(1, 300)))]
    one = [(7, "same", "en", "s1")] * 300  # repeated rows, which may be cut apart
    flat = [(k, prose(rng, 20), "en", "s1") for k in range(200)]  # constant language and source
    for data, shards in ((rows, 7), (one, 4), (flat, 5)):
        got = sharding.kd_shards(spark.createDataFrame(data, "doc_id long, text string, lang string, source string").repartition(3), shards=shards).collect()
        left = Counter(data)
        by_id = {}
        for r in data:
            by_id.setdefault((r[0], len(r[1].encode()) + 8, zlib.crc32(r[1].encode())), []).append(r)
        points = []
        for g in got:
            r = by_id[g["doc_id"], g["size"], g["text_crc32"]].pop()
            left[r] -= 1
            points.append((g["shard"], g["size"], (g["size"], zlib.crc32(r[2].encode()), zlib.crc32(r[3].encode()), r[0] - min(d[0] for d in data))))
        assert not +left and len(points) == len(data)
        spans = [max(1, max(p[2][d] for p in points) - min(p[2][d] for p in points)) for d in range(4)]

        def check(node, first, k):
            if k == 1 or not node:
                return
            low, high = ([p for p in node if (p[0] < first + k // 2) == side] for side in (True, False))
            width = [(max(p[2][d] for p in node) - min(p[2][d] for p in node)) / spans[d] for d in range(4)]
            d = width.index(max(width))
            if low and high:
                assert max(p[2][d] for p in low) <= min(p[2][d] for p in high)
            total = sum(p[1] for p in node)
            assert abs(sum(p[1] for p in low) - total * (k // 2) / k) <= max(p[1] for p in node) + total / 100 + (total / 50 if data is one else 0)
            check(low, first, k // 2), check(high, first + k // 2, k - k // 2)

        check(points, 0, shards)


# ---- packing -----------------------------------------------------------------------------------


def test_special_tokens_are_those_of_tokenizers_by_default(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = ["x <|endoftext|> y", "<|endoftext|>", "a  <|endoftext|>  b\n<|endoftext|><|endoftext|>", "<|endoftext", "it's<|endoftext|>'s \t ", " <|endoftext|>"]
    encode = packing.encoder(open(path, encoding="utf-8").read())
    assert encode(texts) == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    got = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: np.frombuffer(bytes(r["ids"]), "<u4").tolist() for r in got} == {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}


# ---- classifiers -------------------------------------------------------------------------------


def test_a_document_is_the_weighted_average_of_its_words():
    rng = np.random.default_rng(3)
    m = toxicity.SubwordSoftmax()
    m.known[:] = rng.random(len(m.known)) < 0.7
    m.values, m.weights = (np.where(m.known, rng.normal(size=len(m.known)), 0) for _ in range(2))
    texts = ["one two two three", "", "4 5 w0rd ärger!", "x " * 500 + "rare"]

    def told(text, column):
        (_, buf, starts, lens), = common.text_blocks(pa.array([text]))
        bags = toxicity._bags(buf, starts, lens)
        size = max(1, int(m.known[bags.feature].sum()))
        return column[bags.feature].sum() / size

    (_, buf, starts, lens), = common.text_blocks(pa.array(texts))
    got = m.average(toxicity._bags(buf, starts, lens), len(texts))
    for text, x in zip(texts, got):
        words = re.findall(r"[0-9A-Za-zä]+", text)
        weight = [np.exp(told(w, m.weights)) for w in words]
        assert np.isclose(x, sum(a * told(w, m.values) for a, w in zip(weight, words)) / sum(weight) if words else 0)


def test_labels_that_repeat_conflict_or_lack(spark):
    rng = np.random.default_rng(14)
    texts = [(k, (prose(rng, 30) + (" awfulword" if k % 4 == 0 else ""))) for k in range(240)] + [(None, "awfulword"), (500, None), (501, ""), (502, "awfulword " + "w1 " * 300), (503, "awfulword " + "w1 " * 200_000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    marks = [(k, int(k % 4 == 0)) for k in range(240)]
    marks += [(k, 0) for k in range(0, 240, 4)] + [(k, None) for k in range(240)] + [(None, 1), (9999, 1)] + marks[:50]
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    assert all(got[k]["predicted"] == (k % 4 == 0) for k in range(240)) and got[None]["predicted"] == 1 and got[502]["predicted"] == 1
    assert got[500]["score"] == got[501]["score"] and all(0 <= r["score"] <= 1 for r in got.values())
    for only, want in ((1, 1.0), (0, 0.0)):
        one = toxicity.toxicity(docs, labels.where(F.col("toxic") == only).where("doc_id % 4 = 0") if only else labels.where("doc_id % 4 = 1 AND toxic = 0"))
        assert {r["score"] for r in one.collect()} == {want}


def test_words_of_switched_text_get_their_own_language():
    rng = np.random.default_rng(2)
    words = {k: ["".join(rng.choice(list(a), 5)) for _ in range(60)] for k, a in enumerate(("abcde", "vwxyz", "mnopq"))}
    texts = [" ".join(rng.choice(words[k % 3], 25)) for k in range(90)]
    many, y = language_id.chains(texts, [k % 3 for k in range(90)])
    assert len(many) == 90 + int(90 * language_id.SWITCHED) and len(y) == sum(len(t.split()) for t in many)
    assert all(w in words[k] for w, k in zip(" ".join(many).split(), y))
    crf = language_id.Crf(["a", "v", "m"]).fit(many, y)
    asked = [int(k) for k in np.repeat(rng.integers(0, 3, 12), 6)]
    text = " ".join(rng.choice(words[k]) for k in asked)
    (_, buf, starts, lens), = common.text_blocks(pa.array([text]))
    data, begin, back, first, _ = language_id.distinct_words(buf, starts, lens)
    p, _, _ = crf.marginals(crf.emissions(data, begin)[back], first)
    assert (p.argmax(axis=1) == asked).mean() > 0.95
    off = crf.transitions[~np.eye(3, dtype=bool)]
    assert (np.diag(crf.transitions)[:, None] > off).all() and off.max() - off.min() < np.abs(crf.transitions).max()
    assert language_id.chains([], [])[0] == [] and language_id.chains(["", "ab"], [0, 1])[1].tolist() == [1]


def test_max_langs_keeps_the_most_frequent(spark):
    rows = [(k, f"aaa bbb a{k}", "aa") for k in range(20)] + [(100 + k, f"zzz yyy z{k}", "zz") for k in range(30)] + [(200, "mmm nnn", "mm")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language_id.identify(table, F.lit(False), max_langs=2).collect()} == {"aa", "zz"}
    repeated = spark.createDataFrame([(1, "aaa bbb", "aa")] * 50 + [(2, "zzz yyy", "zz"), (None, "zzz", "zz"), (None, "zzz", "zz")], "doc_id long, text string, lang string")
    assert Counter(r["lang_pred"] for r in language_id.identify(repeated, F.lit(False)).collect()) == {"aa": 50, "zz": 3}
