"""Language identification of code-switched text by a linear-chain conditional random field.

Every word of a text gets a language. A word's features are its prefixes and suffixes, its byte n-grams and itself
(the lexicon), hashed; transitions between the languages of neighbouring words are learned with them by maximum
likelihood in NumPy. Forward-backward over the whole text gives each word's probabilities; their sums over a text
say how many of its words are in each language. The text's language is that of most words, the score its share.

Forward-backward runs in lockstep over all texts of a block, longest first, so a step is a few NumPy operations.

Training uses at most `per_lang` labelled texts of each language, those with the smallest hash of their id and text,
first of the texts of `train_bytes` bytes or fewer. Where a language has too few of these, longer ones follow in the same
order, each by its first words, as many as train_bytes bytes hold (of a longer word, its beginning); what is not in words
takes no room. So every language with a text that has words is learned, the `max_langs` most frequent if there are more:
a parameter that bounds the model. This bounded sample is the only thing that is sampled. It is chosen in one pass over
keys, of which a partition sends per_lang for each language, and fetched in a second. As labels are of whole texts, one
chain in four is made of short runs of words from texts of several languages, so that transitions between languages
are learned too.

Defined results: texts that are null or have no letter get `und` and score 0; so does every text if nothing can be
learned; languages are the distinct labels seen in training; null ids hash like the empty text; repeated rows get a
row each; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod, pick, text_blocks, written
from .subwords import Adam, affixes, distinct_words, subwords

HELD_MODULUS, HELD_REST = 4, 2
PER_LANG, TRAIN_BYTES, MAX_LANGS, SWITCHED = 200, 4000, 1000, 0.25
BUCKETS, STEPS, RATE, DECAY = 1 << 16, 40, 0.1, 1e-5
GRAMS, AFFIXES = (2, 3), (1, 2, 3, 4)
BLOCK_BYTES = 3 << 20
_WORDS = re.compile(rb"[A-Za-z\x80-\xff]+")


def features(data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, word) of the distinct words, sorted by word."""
    a, b = subwords(data, begin, GRAMS, BUCKETS), affixes(data, begin, AFFIXES, BUCKETS)
    feature, word = np.concatenate([a[0], b[0] + BUCKETS]), np.concatenate([a[1], b[1]])
    order = np.argsort(word, kind="stable")
    return feature[order], word[order]


class Crf:
    def __init__(self, langs: list[str]):
        k = len(langs)
        self.langs = langs
        self.weights = np.zeros((2 * BUCKETS, k), np.float64)
        self.transitions = np.zeros((k, k))

    def emissions(self, data: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Log potentials of the distinct words: means over their features."""
        feature, word = features(data, begin)
        n = len(begin) - 1
        size = np.maximum(np.bincount(word, minlength=n), 1)
        return np.stack([np.bincount(word, weights=self.weights[feature, k], minlength=n) / size for k in range(len(self.langs))], axis=1) * SCALE

    def marginals(self, emit: np.ndarray, first: np.ndarray, pairs: bool = False):
        """(probabilities of each word's languages, log likelihood's normaliser, expected transitions). emit: of all words in order."""
        counts = np.diff(first)
        order = np.argsort(-counts, kind="stable")
        counts, start = counts[order], first[:-1][order]
        top = emit.max(axis=1, keepdims=True)
        e = np.exp(emit - top)
        t = np.exp(self.transitions)
        alpha, log_z = np.empty_like(e), top.sum()
        steps = int(counts[0]) if len(counts) else 0
        alive = np.searchsorted(-counts, -np.arange(steps), "left")  # texts longer than the step
        state = None
        for i in range(steps):
            at = start[: alive[i]] + i
            state = e[at] if i == 0 else (state[: alive[i]] @ t) * e[at]
            norm = state.sum(axis=1, keepdims=True)
            state = state / norm
            log_z += np.log(norm).sum() if pairs else 0.0
            alpha[at] = state
        expected = np.zeros_like(t)
        beta = np.ones((len(counts), e.shape[1]))
        for i in range(steps - 1, -1, -1):
            n = alive[i]
            at = start[:n] + i
            here = alpha[at]
            p = here * beta[:n]
            p /= p.sum(axis=1, keepdims=True)
            if i:
                ahead = e[at] * beta[:n]
                if pairs:
                    before = alpha[at - 1]
                    joint = before[:, :, None] * t[None] * ahead[:, None, :]
                    expected += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
                back = ahead @ t.T
                beta[:n] = back / back.sum(axis=1, keepdims=True)
            alpha[at] = p  # alpha at a step is not needed below it
        return alpha, log_z, expected

    def fit(self, texts: list[str], y: np.ndarray) -> Crf:
        """y: the language of each word of the texts, in order."""
        _, buf, starts, lens = next(iter(text_blocks(pa.array(texts), 1 << 40)))
        data, begin, back, first, _ = distinct_words(buf, starts, lens)
        feature, word = features(data, begin)
        kinds, k = len(begin) - 1, len(self.langs)
        size = np.maximum(np.bincount(word, minlength=kinds), 1)
        used, where = np.unique(feature, return_inverse=True)
        w = self.weights[used]
        gold = np.zeros((kinds, k))
        np.add.at(gold, (back, y), 1)
        follows = np.ones(len(y), bool)
        follows[first[:-1][np.diff(first) > 0]] = False
        follows = np.flatnonzero(follows)
        gold_t = np.full((k, k), 0.5)
        np.add.at(gold_t, (y[follows - 1], y[follows]), 1)
        adam = Adam(w, self.transitions, rate=RATE)
        total = max(len(back), 1)
        for _ in range(STEPS):
            emit = np.stack([np.bincount(word, weights=w[where, j], minlength=kinds) / size for j in range(k)], axis=1) * SCALE
            p, _, expected = self.marginals(emit[back], first, pairs=True)
            g = np.stack([np.bincount(back, weights=p[:, j], minlength=kinds) for j in range(k)], axis=1) - gold
            g = g * (SCALE / size)[:, None]
            g_w = np.stack([np.bincount(where, weights=g[word, j], minlength=len(used)) for j in range(k)], axis=1)
            adam.step(g_w / total + DECAY * w, (expected - gold_t) / total + 1e-4 * self.transitions)
        self.weights[used] = w
        return self

    def shares(self, buf: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Expected words of each text in each language."""
        data, begin, back, first, _ = distinct_words(buf, starts, lens)
        out = np.zeros((len(starts), len(self.langs)))
        full = np.flatnonzero(np.diff(first))
        if len(full):
            p, _, _ = self.marginals(self.emissions(data, begin)[back], first)
            out[full] = np.add.reduceat(p, first[:-1][full], axis=0)
        return out


SCALE = 8.0


def _has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def first_words(text: str, most: int = TRAIN_BYTES) -> str:
    """The first words of a text, with a space between them, that fit most bytes; the beginning of the first if it is longer."""
    out, room = [], most
    for found in _WORDS.finditer(text.encode()):
        if out and found.end() - found.start() > room:
            break
        out.append(found.group()[:room])
        room -= len(out[-1]) + 1
        if room <= 0:
            break
    return b" ".join(out).decode("utf-8", "ignore")


def _spans(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """(lang, turn, doc_id, text): of long texts their first words."""
    for batch in batches:
        texts = [first_words(t, most) if long else t for t, long in zip(batch.column("text").to_pylist(), batch.column("long").to_pylist(), strict=True)]
        names = ["lang", "turn", "doc_id"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(texts, pa.string())], [*names, "text"])


def chains(texts: list[str], labels: list[int], switched: float = SWITCHED, seed: int = 3) -> tuple[list[str], np.ndarray]:
    """The texts and, for a part of them, mixtures: 3 to 10 runs of 3 to 12 words, each of any text; and the label of each word."""
    words = [_WORDS.findall(t.encode()) for t in texts]
    y = [np.full(len(w), k) for w, k in zip(words, labels, strict=True)]
    rng, full, out = np.random.default_rng(seed), [i for i, w in enumerate(words) if w], list(texts)
    by_label = [[i for i in full if labels[i] == k] for k in sorted({labels[i] for i in full})]
    for _ in range(int(switched * len(full)) if len(by_label) > 1 else 0):
        runs = []
        for _ in range(int(rng.integers(3, 11))):
            own = by_label[rng.integers(len(by_label))]
            i = own[rng.integers(len(own))]
            at, n = int(rng.integers(len(words[i]))), int(rng.integers(3, 13))
            runs.append((words[i][at : at + n], labels[i]))
        out.append(b" ".join(w for run, _ in runs for w in run).decode("utf-8", "replace"))
        y.append(np.repeat([k for _, k in runs], [len(run) for run, _ in runs]))
    return out, np.concatenate(y) if y else np.zeros(0, np.int64)


def _sample(train: DataFrame, per_lang: int, train_bytes: int, max_langs: int) -> list:
    """(lang, text) of the texts to learn from; train: doc_id, text, lang."""
    langs = train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs).select("lang")
    wordy = train.where(F.col("text").rlike(r"[A-Za-z]|[^\x00-\x7F]")).join(F.broadcast(langs), "lang").withColumns({"long": F.octet_length("text") > train_bytes, "turn": F.xxhash64("doc_id", "text")})
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("long", "turn", "doc_id"))  # partitions rank their own rows first
    chosen = wordy.select("lang", "long", "turn", "doc_id").withColumn("rank", rank).where(F.col("rank") <= per_lang)
    chosen = written(chosen.select("lang", "turn", F.col("doc_id").alias("chosen_id")).distinct(), "language-sample")
    found = wordy.join(F.broadcast(chosen), ["lang", "turn"]).where(F.col("doc_id").eqNullSafe(F.col("chosen_id"))).select("lang", "turn", "doc_id", "long", "text")  # per_lang x max_langs rows
    kind = train.schema["doc_id"].dataType.simpleString()
    texts = found.mapInArrow(lambda it: _spans(it, train_bytes), f"lang string, turn long, doc_id {kind}, text string").dropDuplicates(["lang", "turn", "doc_id"])
    return sorted((r["lang"], r["text"]) for r in texts.collect())  # per_lang texts of train_bytes for each language


def identify(
    docs: DataFrame, held_out=None, per_lang: int = PER_LANG, train_bytes: int = TRAIN_BYTES, max_langs: int = MAX_LANGS,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> DataFrame:
    """One row per row of docs: id, held_out, lang_pred, score. held_out: a condition on doc_id whose rows are not learned from."""
    spark = docs.sparkSession
    texts = pick(docs, doc_id=id_col, text=text_col, lang=lang_col)
    held = held_out if held_out is not None else crc_mod("doc_id", HELD_MODULUS) == HELD_REST
    rows = _sample(texts.where(~held & F.col("lang").isNotNull() & F.col("text").isNotNull()), per_lang, train_bytes, max_langs)
    model = None
    if rows:
        langs = sorted({lang for lang, _ in rows})
        model = Crf(langs).fit(*chains([t for _, t in rows], [langs.index(lang) for lang, _ in rows]))
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for row, buf, starts, lens in text_blocks(batch.column("text"), BLOCK_BYTES):
                n = len(starts)
                lettered = [_has_letter(t.as_py()) for t in batch.column("text").slice(row, n)]
                names, scores = ["und"] * n, [0.0] * n
                if m is not None:
                    shares = m.shares(buf, starts, lens)
                    total = shares.sum(axis=1)
                    best = shares.argmax(axis=1)
                    for i in np.flatnonzero(np.array(lettered) & (total > 0)).tolist():
                        names[i], scores[i] = m.langs[best[i]], min(1.0, float(shares[i, best[i]] / total[i]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, n), batch.column("held_out").slice(row, n), pa.array(names), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", "text", held.alias("held_out")).mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op9_language_id": op9_language_id}
ORACLES: dict[str, str] = {}
