"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in NumPy.

A word's bag holds its byte n-grams and itself; the bag's embeddings are averaged, so unseen misspellings and
inflections share most of their vector with words that were seen. A document is the average of its words' vectors,
each occurrence weighted by the exponential of one more linear function of its vector, and that average goes through
a linear softmax. The weights start equal; with them learned, a few words of a long text are not averaged away.
Embeddings, weights and softmax are trained together by full-batch steps of Adam, first on sums over all words of a
document divided by the root of their number, so that all words get a turn, then on the averages, which give the
score. Last, a logistic curve is fitted to the averages' logits.

Training uses at most `per_class` labelled rows of each class, those with the smallest hash of their id, and of longer
texts the first `train_chars` characters; this bounded sample is the only thing that is sampled. The learned prior is
that of all training labels.

Defined results: null and empty texts have no words and get the score of the bias alone; rows without a label, or a
null one, are scored and never trained on; of repeated labels of an id the largest counts; with labels of one class
only, or none, the score is that class's (0 if there is none) ; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, crc_mod, pick, text_blocks
from .subwords import Adam, distinct_words, subwords

HELD_MODULUS, HELD_REST = 5, 0
PER_CLASS, TRAIN_CHARS, DIM, BUCKETS = 1000, 32_000, 8, 1 << 18
SUM_STEPS, MEAN_STEPS, RATE, DECAY = 60, 120, 0.03, 1e-5
SIZES = (3, 4, 5)
LEAST_ROWS = 8


class SubwordSoftmax:
    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.embedding = rng.normal(0, 0.01, (BUCKETS, DIM))
        self.softmax = rng.normal(0, 0.35, (DIM, 2))
        self.attention = np.zeros(DIM)
        self.known = np.zeros(BUCKETS, bool)
        #: Of each feature what its embedding gives: as a logit of class 1 through the softmax, and as a log weight.
        self.values = self.weights = np.zeros(BUCKETS)
        self.curve = np.zeros(2)  # slope and offset

    def fit(self, texts: list[str], labels: np.ndarray, prior: float) -> SubwordSoftmax:
        bags = [_bags(buf, starts, lens) for _, buf, starts, lens in text_blocks(pa.array(texts, pa.string()), 1 << 40)][0]
        kinds, y = bags.kinds, labels.astype(float)
        rows = np.bincount(bags.back, minlength=kinds)
        self.known = np.bincount(bags.feature, weights=rows[bags.word], minlength=BUCKETS) >= LEAST_ROWS
        seen = self.known[bags.feature]
        feature, word = bags.feature[seen], bags.word[seen]
        size = np.maximum(np.bincount(word, minlength=kinds), 1)
        used, where = np.unique(feature, return_inverse=True)
        emb, w, b, q = self.embedding[used], self.softmax, np.zeros(2), self.attention
        weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
        root = np.sqrt(np.maximum(bags.words, 1))

        def means(x: np.ndarray) -> np.ndarray:
            return np.bincount(word, weights=x[where], minlength=kinds) / size

        def to_features(g: np.ndarray) -> np.ndarray:
            return np.bincount(where, weights=(g / size)[word], minlength=len(used))

        adam = Adam(emb, w, b, q, rate=RATE)
        for step in range(SUM_STEPS + MEAN_STEPS):
            across = w[:, 1] - w[:, 0]
            value = means(emb @ across)
            if step < SUM_STEPS:
                z = np.bincount(bags.doc, weights=(bags.count * value[bags.back]), minlength=len(y)) / root
            else:
                share = bags.shares(means(emb @ q), len(y))
                z = np.bincount(bags.doc, weights=share * value[bags.back], minlength=len(y))
            p = 1 / (1 + np.exp(-np.clip(z + b[1] - b[0], -30, 30)))
            g = weight * (p - y)
            if step < SUM_STEPS:
                g_word, g_share = np.bincount(bags.back, weights=bags.count * (g / root)[bags.doc], minlength=kinds), np.zeros(kinds)
            else:
                g_word = np.bincount(bags.back, weights=g[bags.doc] * share, minlength=kinds)
                g_share = np.bincount(bags.back, weights=g[bags.doc] * share * (value[bags.back] - z[bags.doc]), minlength=kinds)
            g_value, g_weight = to_features(g_word), to_features(g_share)
            g_w = emb.T @ g_value
            adam.step(g_value[:, None] * across + g_weight[:, None] * q + DECAY * emb, np.stack([-g_w, g_w], axis=1), np.array([-g.sum(), g.sum()]), emb.T @ g_weight)
        self.embedding[used] = emb
        self.values = np.where(self.known, self.embedding @ (w[:, 1] - w[:, 0]), 0.0)
        self.weights = np.where(self.known, self.embedding @ q, 0.0)
        x = self.average(bags, len(y))
        mean, spread = x.mean(), max(x.std(), 1e-9)
        curve, weights = np.array([1.0, 0.0]), np.where(y == 1, prior / (y == 1).sum(), (1 - prior) / (y == 0).sum())
        adam, x = Adam(curve, rate=0.1), (x - mean) / spread
        for _ in range(300):
            g = weights * (1 / (1 + np.exp(-np.clip(curve[0] * x + curve[1], -30, 30))) - y)
            adam.step(np.array([(g * x).sum(), g.sum()]) + 1e-4 * curve)
        self.curve = np.array([curve[0] / spread, curve[1] - curve[0] * mean / spread])
        return self

    def average(self, bags: Bags, n: int) -> np.ndarray:
        """Of each document its averaged embedding as a logit; 0 without words."""
        size = np.maximum(np.bincount(bags.word, weights=self.known[bags.feature], minlength=bags.kinds), 1)
        value, weight = (np.bincount(bags.word, weights=x[bags.feature], minlength=bags.kinds) / size for x in (self.values, self.weights))
        return np.bincount(bags.doc, weights=bags.shares(weight, n) * value[bags.back], minlength=n)

    def score(self, buf: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
        x = self.average(_bags(buf, starts, lens), len(starts))
        return 1 / (1 + np.exp(-np.clip(self.curve[0] * x + self.curve[1], -30, 30)))


class Bags(NamedTuple):
    """Subwords of the distinct words, and how often each word is in each document."""

    feature: np.ndarray
    word: np.ndarray
    doc: np.ndarray
    back: np.ndarray
    count: np.ndarray
    words: np.ndarray
    kinds: int

    def shares(self, weight: np.ndarray, n: int) -> np.ndarray:
        """What part each word has in the average of its document; weight: the words' log weights."""
        log = np.clip(weight, -50, 50)[self.back]
        top = np.full(n, -np.inf)
        np.maximum.at(top, self.doc, log)
        share = self.count * np.exp(log - top[self.doc])
        return share / np.bincount(self.doc, weights=share, minlength=n)[self.doc]


def _bags(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> Bags:
    data, begin, back, first, _ = distinct_words(buf, starts, lens, ALNUM)
    kinds = len(begin) - 1
    feature, word = subwords(data, begin, SIZES, BUCKETS)
    doc = np.repeat(np.arange(len(starts)), np.diff(first))
    once, count = np.unique(doc * np.int64(max(kinds, 1)) + back, return_counts=True)
    return Bags(feature, word, once // max(kinds, 1), once % max(kinds, 1), count, np.diff(first), kinds)


def toxicity(docs: DataFrame, labels: DataFrame, held_out=None, per_class: int = PER_CLASS, train_chars: int = TRAIN_CHARS, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """One row per row of docs: id, held_out, score, predicted. held_out: a condition on doc_id whose rows are not learned from."""
    spark = docs.sparkSession
    texts = pick(docs, doc_id=id_col, text=text_col)
    held = held_out if held_out is not None else crc_mod("doc_id", HELD_MODULUS) == HELD_REST
    marks = pick(labels, doc_id=label_id_col, toxic=label_col).where(~held & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    marks = marks.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    turn = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = marks.where("toxic = 1").orderBy(*turn).limit(per_class).union(marks.where("toxic = 0").orderBy(*turn).limit(per_class))
    sample = texts.join(F.broadcast(chosen), "doc_id").select(F.substring("text", 1, train_chars).alias("text"), "toxic").dropDuplicates().orderBy("toxic", F.xxhash64("text")).limit(2 * per_class).toArrow()  # 2 x per_class rows of train_chars
    y = sample["toxic"].to_numpy()
    if 0 < y.sum() < len(y):
        prior = counts.get(1, 0) / (counts.get(0, 0) + counts.get(1, 0))
        model = SubwordSoftmax().fit([t or "" for t in sample["text"].to_pylist()], y, prior)
        model.embedding = np.zeros((0, DIM))  # workers need the values only
    else:
        model = float(len(y) and y[0])
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for row, buf, starts, lens in text_blocks(batch.column("text")):
                p = np.full(len(starts), m) if isinstance(m, float) else m.score(buf, starts, lens)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, len(starts)), batch.column("held_out").slice(row, len(starts)), pa.array(p)], ["doc_id", "held_out", "score"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    scored = texts.withColumn("held_out", held).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op8_toxicity": op8_toxicity}
ORACLES: dict[str, str] = {}
