"""MinHash near-dedup with sequential Bayesian verification.

1. Texts with the same words are one class; its row with the smallest id represents it, so copies cost nothing more.
2. Representatives get a MinHash signature of their distinct word shingles; signatures are banded. At 24 bands of 4
   a pair at similarity 0.85 shares no band with probability 2e-8, at 0.8 with 3e-6.
3. Each bucket links its members to one of them, chosen by a hash that differs from band to band, so a large group
   of near copies makes a star in each band, not all pairs.
4. Candidates are verified in sequence: batches of the two signatures are compared, and after each the posterior of
   the similarity (uniform prior) is asked; a pair goes once the threshold is less likely than `miss`. The survivors
   are verified exactly on full shingle sets; those that pass are links.
5. Connected components of the links. A bucket whose members, its star's center aside, are of several components has
   its cross pairs compared too, in blocks of at most BLOCK members, or about BLOCK_BYTES, that carry their shingle
   sets: the same sequence of batches, then exact verification on the spot, and only links that join components found so far are emitted. A
   pair is looked at in the first band that it shares. So every pair that shares a band is within one component or
   was compared, though a hot bucket never emits its pairs.

Components are found by hooking and shortcutting with min labels over tables in the shared folder.

Defined results: null and empty texts have no shingles and link with nothing, equal ones neither; a text of fewer
words than a shingle is one shingle; rows with a null id have a null component, are never kept, and link nothing;
rows with equal ids and different texts are linked each by its own text; an empty
table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, broadcast_if_small, gram_hashes, mix, pick, text_blocks, word_hashes, written

SHINGLE, BANDS, ROWS, BATCH = 5, 24, 4, 16
MISS = 1e-7
BLOCK, BLOCK_BYTES = 2048, 32 << 20
BROADCAST_ROWS = 1_000_000
_HASHES = BANDS * ROWS
_rng = np.random.default_rng(7)
_XOR = _rng.integers(0, 1 << 63, _HASHES, dtype=np.uint64)
_MUL = _rng.integers(0, 1 << 63, _HASHES, dtype=np.uint64) | np.uint64(1)


def shingle_sets(buf, starts, lens, n: int = SHINGLE):
    """(sorted distinct shingle hashes, where each document's begin with the total at the end, digest of each document's words)."""
    words, first = word_hashes(buf, starts, lens, NOT_SPACE)
    grams, begin = gram_hashes(words, first, n)
    doc = np.repeat(np.arange(len(starts)), np.diff(begin))
    order = np.lexsort((grams, doc))
    grams = grams[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    counts = np.bincount(doc[new], minlength=len(starts))
    digest, _ = gram_hashes(mix(words), first, 1 << 40)  # all words of a document as one
    return grams[new], np.append(0, np.cumsum(counts)), digest


def signatures(grams: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """MinHash values, 32 bits each, of every non-empty set; rows of empty sets are zero."""
    full = np.flatnonzero(np.diff(begin))
    out = np.zeros((len(begin) - 1, _HASHES), np.uint32)
    if len(full):
        for k in range(_HASHES):
            out[full, k] = np.minimum.reduceat(((grams ^ _XOR[k]) * _MUL[k]) >> np.uint64(32), begin[full]).astype(np.uint32)
    return out


def _sign(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, buf, starts, lens in text_blocks(batch.column("text")):
            grams, begin, digest = shingle_sets(buf, starts, lens, n)
            counts = np.diff(begin)
            full = counts > 0
            where = np.full(len(starts), -1)
            where[full] = np.arange(full.sum())
            d1 = np.where(full, digest[np.maximum(where, 0)] if len(digest) else 0, 0).astype(np.uint64)
            sums = np.zeros(len(starts), np.uint64)
            if full.any():
                sums[full] = np.add.reduceat(mix(grams ^ np.uint64(0xABCDEF123)), begin[:-1][full])
            sig = signatures(grams, begin)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(row, len(starts)), pa.array(counts, pa.int64()), pa.array(d1.view(np.int64)), pa.array(sums.view(np.int64)), pa.array([s.tobytes() for s in sig], pa.binary())],
                ["doc_id", "n_shingles", "d1", "d2", "sig"],
            )


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, band, bucket, turn): turn orders a bucket's members, in each band another way."""
    for batch in batches:
        n = batch.num_rows
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(n, BANDS, ROWS).astype(np.uint64)
        bucket = np.zeros((n, BANDS), np.uint64)
        for r in range(ROWS):
            bucket = mix(bucket ^ (sig[:, :, r] + np.uint64((r + 1) << 40)))
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
        turn = mix(ids.view(np.uint64)[:, None] ^ mix(np.arange(1, BANDS + 1, dtype=np.uint64))[None, :])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(ids, BANDS)), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), n)), pa.array(bucket.ravel().view(np.int64)), pa.array(turn.ravel().view(np.int64))],
            ["doc_id", "band", "bucket", "turn"],
        )


@lru_cache(maxsize=8)
def least_matches(threshold: float, miss: float = MISS) -> tuple[int, ...]:
    """For 16, 32, ... compared values the least number of matches with P(similarity >= threshold | matches) >= miss.

    With a uniform prior the posterior is Beta(matches + 1, misses + 1); its tail is a binomial sum.
    """
    from math import comb

    out = []
    for n in range(BATCH, _HASHES + 1, BATCH):
        def tail(m: int) -> float:
            return sum(comb(n + 1, j) * threshold**j * (1 - threshold) ** (n + 1 - j) for j in range(m + 1))
        out.append(next(m for m in range(n + 1) if tail(m) >= miss))
    return tuple(out)


def survive(a: np.ndarray, b: np.ndarray, threshold: float, miss: float = MISS) -> np.ndarray:
    """Positions of the pairs of signature rows that no batch prunes."""
    live, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for k, least in enumerate(least_matches(threshold, miss)):
        part = slice(k * BATCH, (k + 1) * BATCH)
        matches = matches + (a[live, part] == b[live, part]).sum(axis=1)
        stay = matches >= least
        live, matches = live[stay], matches[stay]
    return live


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), _HASHES)


def _prune(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        stay = survive(_matrix(batch.column("sig_a")), _matrix(batch.column("sig_b")), threshold)
        yield batch.select(["a", "b"]).take(pa.array(stay))


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, buf, starts, lens in text_blocks(batch.column("text")):
            grams, begin, _ = shingle_sets(buf, starts, lens, n)
            blobs = [grams[begin[i] : begin[i + 1]].tobytes() for i in range(len(starts))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, len(starts)), pa.array(blobs, pa.binary())], ["doc_id", "grams"])


def _verify(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for i, (x, y) in enumerate(zip(batch.column("grams_a").to_pylist(), batch.column("grams_b").to_pylist(), strict=True)):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                continue
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= percent * (len(x) + len(y) - both):
                keep.append(i)
        yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))


def _cross(group: pd.DataFrame, threshold: float, percent: int) -> pd.DataFrame:
    """Links between different components, between two blocks of a bucket (or within one); none that others imply."""
    sig = np.frombuffer(b"".join(group["sig"]), np.uint32).reshape(len(group), _HASHES)
    sets = [np.frombuffer(g, np.uint64) for g in group["grams"]]
    sizes = np.array([len(s) for s in sets])
    ids, side, band = group["doc_id"].to_numpy(), group["side"].to_numpy(), int(group["band"].iloc[0])
    _, comp = np.unique(group["component"].to_numpy(), return_inverse=True)
    left, right = np.flatnonzero(side != 2), np.flatnonzero(side != 1)
    out = []
    for i in left:
        other = right[(comp[right] != comp[i]) & ((side[right] == 2) | (right > i))]
        other = other[100 * np.minimum(sizes[other], sizes[i]) >= percent * np.maximum(sizes[other], sizes[i])]
        if not len(other):
            continue
        other = other[survive(np.broadcast_to(sig[i], (len(other), _HASHES)), sig[other], threshold)]
        if band and len(other):  # pairs that share an earlier band are looked at there
            early = (sig[other, : band * ROWS] == sig[i, : band * ROWS]).reshape(len(other), band, ROWS).all(axis=2).any(axis=1)
            other = other[~early]
        if not len(other):
            continue
        every = np.concatenate([sets[j] for j in other])
        at = np.minimum(np.searchsorted(sets[i], every), sizes[i] - 1)
        both = np.add.reduceat((sets[i][at] == every).astype(np.int64), np.append(0, np.cumsum(sizes[other])[:-1]))
        for j in other[100 * both >= percent * (sizes[other] + sizes[i] - both)]:
            if comp[i] != comp[j]:
                out.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
                comp[comp == comp[j]] = comp[i]
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(doc_id, component): the smallest id reachable over links (a, b), for every id in them.

    Each round, nodes take the least label around them and labels are shortcut through their own label's label;
    labels are aggregated before they are exchanged and joins on a hot node split, as its rows are on the other side.
    """
    edges = written(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), f"{name}-edges")
    labels = written(edges.groupBy(F.col("a").alias("doc_id")).agg(F.least(F.min("b"), F.first("a")).alias("component")), f"{name}-labels")
    while True:
        around = edges.join(labels, edges.b == labels.doc_id).groupBy("a").agg(F.min("component").alias("near"))
        hooked = labels.join(around, labels.doc_id == around.a, "left").select("doc_id", "component", F.least("component", F.coalesce("near", "component")).alias("new"))
        # The old label's node takes the new label as well, which hooks whole trees at once.
        pushed = hooked.where(F.col("new") < F.col("component")).groupBy(F.col("component").alias("root")).agg(F.min("new").alias("pushed"))
        hooked = hooked.join(pushed, F.col("doc_id") == F.col("root"), "left").select("doc_id", "component", F.least("new", F.coalesce("pushed", "new")).alias("new"))
        hooked = written(hooked, f"{name}-labels")
        parent = hooked.select(F.col("doc_id").alias("p"), F.col("new").alias("grand"))
        short = hooked.join(parent, F.col("new") == F.col("p"), "left").select("doc_id", "component", F.least("new", F.coalesce("grand", "new")).alias("new"))
        short = written(short, f"{name}-labels")
        labels = short.select("doc_id", F.col("new").alias("component"))
        if short.where("new <> component").isEmpty():
            return labels


def near_dedup(docs: DataFrame, percent: int = 85, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id, kept; links: 100 * intersection >= percent * union."""
    threshold = percent / 100
    texts = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    signed = written(texts.mapInArrow(lambda it: _sign(it, shingle), "doc_id long, n_shingles long, d1 long, d2 long, sig binary"), "near-signed")
    real = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = written(real.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "near-classes")
    reps = real.join(classes.select(F.col("rep").alias("doc_id"), "d1", "d2", "n_shingles"), ["doc_id", "d1", "d2", "n_shingles"])
    reps = written(reps.select("doc_id", "sig").dropDuplicates(["doc_id", "sig"]), "near-reps")
    banded = written(reps.mapInArrow(_bands, "doc_id long, band int, bucket long, turn long"), "near-bands")
    stars = banded.groupBy("band", "bucket").agg(F.min_by("doc_id", "turn").alias("center"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = written(stars, "near-buckets")
    pairs = banded.join(stars, ["band", "bucket"]).where("doc_id <> center").select(F.least("doc_id", "center").alias("a"), F.greatest("doc_id", "center").alias("b")).distinct()

    left, right = reps.select(F.col("doc_id").alias("a"), F.col("sig").alias("sig_a")), reps.select(F.col("doc_id").alias("b"), F.col("sig").alias("sig_b"))
    pairs = pairs.join(left, "a").join(right, "b").select("a", "b", "sig_a", "sig_b").mapInArrow(lambda it: _prune(it, threshold), "a long, b long")
    pairs = written(pairs, "near-pairs")

    def sets_of(ids: DataFrame, name: str) -> DataFrame:
        ids = written(ids.distinct(), f"{name}-wanted")
        sets = texts.join(broadcast_if_small(ids, BROADCAST_ROWS), "doc_id", "left_semi").mapInArrow(lambda it: _sets(it, shingle), "doc_id long, grams binary")
        return written(sets, f"{name}-sets")

    sets = sets_of(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")), "near-star")
    joined = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("grams").alias("grams_a")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("grams").alias("grams_b")), "b")
    links = written(joined.select("a", "b", "grams_a", "grams_b").mapInArrow(lambda it: _verify(it, percent), "a long, b long"), "near-links")
    labels = components(links, "near-first")
    # Buckets that still hold several components; the pairs of their centers have been looked at.
    placed = banded.join(stars.where("n > 2"), ["band", "bucket"]).where("doc_id <> center").join(labels, "doc_id", "left")
    placed = written(placed.select("band", "bucket", "n", "doc_id", F.coalesce("component", "doc_id").alias("component")), "near-placed")
    mixed = placed.groupBy("band", "bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("band", "bucket")
    mixed = written(placed.join(mixed, ["band", "bucket"]), "near-mixed")
    sets = sets_of(mixed.select("doc_id"), "near-mixed")
    weights = mixed.join(sets.select("doc_id", (F.octet_length("grams") + 4 * _HASHES).alias("bytes")), "doc_id").groupBy("band", "bucket").agg(F.sum("bytes").alias("bytes"))
    blocks = mixed.join(weights, ["band", "bucket"]).withColumn("blocks", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int"))
    blocks = blocks.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    blocks = blocks.join(reps.join(sets, "doc_id"), "doc_id").select(
        "band", "bucket", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "doc_id", "component", "sig", "grams",
        F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2).alias("side"),
    )
    more = written(blocks.groupBy("band", "bucket", "x", "y").applyInPandas(lambda g: _cross(g, threshold, percent), "a long, b long"), "near-more")
    labels = components(links.union(more), "near-all")
    classes = written(classes.join(labels, classes.rep == labels.doc_id, "left").select("d1", "d2", "n_shingles", F.coalesce("component", "rep").alias("component")), "near-labelled")
    alone = signed.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component"))
    linked = real.select("doc_id", "d1", "d2", "n_shingles").join(classes, ["d1", "d2", "n_shingles"]).select("doc_id", "n_shingles", "component")
    return linked.union(alone).select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("component") == F.col("doc_id"), F.lit(False)).alias("kept"))


def op3_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), percent=85)


QUERIES = {"op3_near_dedup": op3_near_dedup}
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLES = {
    "op3_near_dedup": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + least(5, len(w)) - 1], ' ') AS g
              FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS p FROM w WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        links AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
        edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON r.c = e.a)
        SELECT d.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.c) AS component_id, d.doc_id = min(r.c) AS kept
        FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN reach r ON r.doc_id = d.doc_id GROUP BY d.doc_id"""
}
