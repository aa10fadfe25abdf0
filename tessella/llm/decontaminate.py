"""Benchmark decontamination by a prefix-filtered set join.

An item's windows (8 consecutive words; a shorter item is one window) are sets of 3-word shingles. For a document to
contain a window, all shingles must be there, so at threshold 1 the necessary prefix of a window is its rarest
shingle alone. Rarity is the number of occurrences over all documents, counted in a first pass for the shingles of
the benchmark only. The second pass joins each document's shingles with the prefixes; the shingle's place in the
window and in the document fix where the window would have to begin, which prunes by position and length; then the
window is verified word by word. The benchmark's side of the join is broadcast in blocks of at most BLOCK_WORDS
words; each block is one pass over the documents and their hits are merged per document, so a benchmark of any
size works and nothing of the documents is shuffled for one block.

Words are kept as 64-bit hashes; shingles and windows are compared by those of their words.

Defined results: null and empty texts have no words and no hits; an item without words, or null, never occurs; a
repeated item id counts once; null item ids are ignored; repeated documents get a row each; an empty benchmark
leaves all documents clean; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, gram_hashes, pick, text_blocks, word_hashes, written

WINDOW, SHINGLE, BLOCK_WORDS = 8, 3, 4_000_000


def _item_windows(batches: Iterator[pa.RecordBatch], window: int, shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, buf, starts, lens in text_blocks(batch.column("text")):
            words, first = word_hashes(buf, starts, lens, ALNUM)
            items, out = [], []
            for i in range(len(starts)):
                w = words[first[i] : first[i + 1]]
                size = min(window, len(w))
                for at in range(len(w) - size + 1 if size else 0):
                    items.append(row + i)
                    out.append(w[at : at + size].view(np.int64).tolist())
            ids = batch.column("item_id").take(pa.array(items, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(out, pa.list_(pa.int64()))], ["item_id", "words"])


class Index:
    """Windows of a block of the benchmark; shingles of windows of a few words are the whole window."""

    def __init__(self, windows: list[tuple[list[int], list[str]]], shingle: int):
        self.sizes = np.array([len(w) for w, _ in windows], np.int64)
        self.items = [ids for _, ids in windows]
        longest = max(map(len, (w for w, _ in windows)), default=0)
        self.words = np.zeros((len(windows), longest), np.uint64)
        self.shingles: list[tuple[int, np.ndarray]] = []
        self.shingle = shingle
        for i, (w, _) in enumerate(windows):
            self.words[i, : len(w)] = np.array(w, np.int64).view(np.uint64)
        first = np.append(0, np.cumsum(self.sizes))
        flat = self.words[np.arange(longest)[None, :] < self.sizes[:, None]] if len(windows) else np.zeros(0, np.uint64)
        self.grams, self.begin = gram_hashes(flat, first, shingle)
        self.lengths = np.minimum(self.sizes, shingle)  # words of a window's shingles
        self.known = np.unique(self.grams)
        self.key = self.window = self.place = None

    def order(self, seen: np.ndarray) -> None:
        """seen: occurrences over all documents of each shingle in known. Keeps each window's rarest."""
        count = seen[np.searchsorted(self.known, self.grams)]
        rank = np.lexsort((self.grams, count, np.repeat(np.arange(len(self.sizes)), np.diff(self.begin))))
        pick_ = rank[self.begin[:-1]]
        place = pick_ - self.begin[:-1]
        by = np.argsort(self.grams[pick_], kind="stable")
        self.key, self.window, self.place = self.grams[pick_][by], by, place[by]

    def hits(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, first word, window) of each occurrence."""
        docs, ats, wins = [], [], []
        for length in np.unique(self.lengths):
            grams, begin = gram_hashes(words, first, int(length), whole_if_short=False)
            if not len(grams):
                continue
            left, right = np.searchsorted(self.key, grams, "left"), np.searchsorted(self.key, grams, "right")
            found = np.flatnonzero(right > left)
            n = (right - left)[found]
            entry = np.repeat(left[found], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = np.repeat(found, n)
            doc = np.searchsorted(begin, at, "right") - 1
            word = first[doc] + at - begin[doc] - self.place[entry]
            win = self.window[entry]
            ok = (self.lengths[win] == length) & (word >= first[doc]) & (word + self.sizes[win] <= first[doc + 1])  # position and length
            doc, word, win = doc[ok], word[ok], win[ok]
            same = np.ones(len(win), bool)
            for j in range(self.words.shape[1]):
                live = same & (j < self.sizes[win])
                same[live] = words[word[live] + j] == self.words[win[live], j]
            docs.append(doc[same]), ats.append(word[same] - first[doc[same]]), wins.append(win[same])
        if not docs:
            return (np.zeros(0, np.int64),) * 3
        return np.concatenate(docs), np.concatenate(ats), np.concatenate(wins)


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, shingle: int, block_words: int) -> Iterator[Index]:
    items = pick(benchmark, item_id=item_col, text=text_col).select(F.col("item_id").cast("string").alias("item_id"), "text").where(F.col("item_id").isNotNull())
    windows = items.mapInArrow(lambda it: _item_windows(it, window, shingle), "item_id string, words array<long>")
    windows = written(windows.groupBy("words").agg(F.sort_array(F.collect_set("item_id")).alias("items")), "benchmark-windows")
    words = windows.agg(F.coalesce(F.sum(F.size("words") + F.size("items")), F.lit(0))).first()[0]
    blocks = max(1, -(-words // block_words))
    for b in range(blocks):
        part = windows if blocks == 1 else windows.where(F.pmod(F.hash("words"), F.lit(blocks)) == b)
        yield Index([(r["words"], r["items"]) for r in part.toLocalIterator()], shingle)


_SPANS = "n_words long, spans array<struct<begin:long,end:long>>, items array<string>"


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
               window: int = WINDOW, shingle: int = SHINGLE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per row of docs: id, n_words, n_hit, spans (words inside occurrences, merged), items (ids with occurring windows)."""
    spark = docs.sparkSession
    texts = pick(docs, doc_id=id_col, text=text_col)

    def count(batches, index):
        total = np.zeros(len(index.known), np.int64)
        for batch in batches:
            for _, buf, starts, lens in text_blocks(batch.column(0)):
                words, first = word_hashes(buf, starts, lens, ALNUM)
                for length in np.unique(index.lengths):
                    grams, _ = gram_hashes(words, first, int(length), whole_if_short=False)
                    at = np.searchsorted(index.known, grams)
                    at[at == len(index.known)] = 0
                    total += np.bincount(at[index.known[at] == grams], minlength=len(index.known))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["shingle", "n"])

    def search(batches, index):
        for batch in batches:
            for row, buf, starts, lens in text_blocks(batch.column("text")):
                words, first = word_hashes(buf, starts, lens, ALNUM)
                doc, at, win = index.hits(words, first)
                spans: list[list] = [[] for _ in starts]
                items: list[set] = [set() for _ in starts]
                for d, a, w in sorted(zip(doc.tolist(), at.tolist(), win.tolist(), strict=True)):
                    items[d].update(index.items[w])
                    end = a + int(index.sizes[w])
                    if spans[d] and a <= spans[d][-1]["end"]:
                        spans[d][-1]["end"] = max(end, spans[d][-1]["end"])
                    else:
                        spans[d].append({"begin": a, "end": end})
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(row, len(starts)), pa.array(np.diff(first)), pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
                    ["doc_id", "n_words", "spans", "items"],
                )

    passes = []
    for index in _blocks(benchmark, item_col, item_text_col, window, shingle, block_words):
        sent = spark.sparkContext.broadcast(index)
        seen = np.zeros(len(index.known), np.int64)
        if len(seen):
            counted = texts.select("text").mapInArrow(lambda it, sent=sent: count(it, sent.value), "shingle long, n long")
            for r in counted.groupBy("shingle").agg(F.sum("n").alias("n")).toLocalIterator():  # bounded by the block
                seen[r["shingle"]] = r["n"]
        index.order(seen)
        sent = spark.sparkContext.broadcast(index)
        doc_type = texts.schema["doc_id"].dataType.simpleString()
        passes.append((sent, doc_type))
    if len(passes) == 1:
        sent, kind = passes[0]
        found = texts.mapInArrow(lambda it: search(it, sent.value), f"doc_id {kind}, {_SPANS}")
    else:
        keyed = texts.withColumn("key", F.xxhash64("text"))
        keyed = written(keyed.groupBy("doc_id", "key").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies")), "leak-texts")
        packed = keyed.select(F.struct("doc_id", "key", "copies").alias("doc_id"), "text")
        kind = packed.schema["doc_id"].dataType.simpleString()
        parts = [packed.mapInArrow(lambda it, sent=sent: search(it, sent.value), f"doc_id {kind}, {_SPANS}") for sent, _ in passes]
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        found = every.groupBy("doc_id").agg(F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        merged = """aggregate(spans, cast(array() as array<struct<begin:bigint,end:bigint>>), (acc, x) ->
            if(size(acc) > 0 and x.begin <= element_at(acc, -1).end,
               concat(slice(acc, 1, size(acc) - 1), array(named_struct('begin', element_at(acc, -1).begin, 'end', greatest(element_at(acc, -1).end, x.end)))),
               concat(acc, array(x))))"""
        found = found.withColumn("spans", F.expr(merged)).select(F.col("doc_id.doc_id").alias("doc_id"), "n_words", "spans", "items", F.explode(F.sequence(F.lit(1), F.col("doc_id.copies").cast("int"))).alias("copy")).drop("copy")
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["begin"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), "spans", "items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_items: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs its leaks and whether it is contaminated: windows of min_items items or more occur."""
    found = find_leaks(docs, benchmark, id_col, text_col)
    return found.withColumn("contaminated", F.size("items") >= min_items)


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), min_items=2)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


QUERIES = {"op6_decontaminate": op6_decontaminate}
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLES = {
    "op6_decontaminate": rf"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
        win AS (SELECT DISTINCT item, least(8, len(w)) AS k, array_to_string(w[p:p + least(8, len(w)) - 1], ' ') AS gram
                FROM (SELECT item, w, unnest(range(1, len(w) - least(8, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT k FROM win),
        grams AS (SELECT doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') AS gram
                  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, sizes WHERE len(w) >= k)),
        hit AS (SELECT g.doc_id, g.p, g.k, win.item FROM grams g JOIN win USING (k, gram)),
        covered AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hit) GROUP BY doc_id),
        named AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
        SELECT d.doc_id, len(d.w) AS n_words, coalesce(covered.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items,
               sha256(coalesce(named.items, '')) AS items_sha256, coalesce(named.n, 0) >= 2 AS contaminated
        FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)"""
}
