"""Packing by best-fit decreasing, with a segment tree indexed by remaining capacity.

Documents are tokenised, an end id is appended, and those longer than a window are first cut into full windows; what
is left of each is a piece of 1 to size - 1 tokens. Best-fit decreasing looks only at lengths, so it is run on
their histogram: pieces of one length go, longest first, into the tightest open windows, found by a segment tree over
remaining capacities, and windows that are alike are handled as ranges of window numbers. That yields the packing
that the piece-by-piece algorithm would, from at most `size` numbers, however many documents there are. Each run of
the resulting plan says: pieces number a to b of this length go to these windows at this offset. A piece's number
among those of its length comes from counts by partition of the written piece table and its rank there, so no
task gathers all pieces of a common length.

Token ids: the vocabulary is a byte-level BPE file of the tokenizers library. Its ranks are its ids, so tiktoken's
encoder computes the same ids several times faster; files of another kind go through tokenizers itself. A string of a
special token in a text becomes that token's id, as tokenizers does by default.

Defined results: null and empty texts are one piece that holds the end id only; null and repeated ids are rows like
any other; an empty table gives an empty table.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, pick, written

SIZE = 1024
COUNT_ROWS = 2_000_000
#: Fixed value: the pattern by which byte-level BPE splits a text if its file says no other.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


@lru_cache(maxsize=2)
def encoder(file: str):
    """A function from a list of texts to their ids; file: the content of a tokenizers JSON file."""
    spec = json.loads(file)
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
    if plain:
        byte_of = _byte_of()
        added = spec.get("added_tokens", [])
        special = {t["content"]: t["id"] for t in added}
        bare = not any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip"))  # these take what is around them
        ranks = {bytes(byte_of[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [model["vocab"][a + b] for a, b in merges]
        if bare and made == sorted(made):  # merges are tried in the order of the ids they make
            import tiktoken

            enc = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
            return lambda texts: [enc.encode(t, allowed_special="all") for t in texts]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(file)
    return lambda texts: [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


class CapacityTree:
    """A segment tree over capacities 0..size: counts open windows and finds the tightest that fits."""

    def __init__(self, size: int):
        self.base = 1 << size.bit_length()
        self.count = [0] * (2 * self.base)

    def add(self, capacity: int, n: int) -> None:
        at = self.base + capacity
        while at:
            self.count[at] += n
            at >>= 1

    def tightest(self, least: int) -> int | None:
        """The smallest capacity >= least of an open window."""
        at = self.base + least
        if self.count[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.count[at + 1]:
                at += 1
                while at < self.base:
                    at = 2 * at + (not self.count[2 * at])
                return at - self.base
            at >>= 1
        return None


def plan(histogram: dict[int, int], size: int = SIZE) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best-fit decreasing of histogram[length] pieces. Returns runs and the number of windows.

    A run (length, first piece, first window, pieces a window, offset): from that piece on, the pieces of this length
    fill that window and those after it, so many each, from the offset on.
    """
    tree = CapacityTree(size)
    ranges: dict[int, list[tuple[int, int]]] = {}  # capacity: (first window, windows)
    runs: list[tuple[int, int, int, int, int]] = []
    windows = 0

    def keep(capacity: int, first: int, n: int) -> None:
        if n and capacity:
            ranges.setdefault(capacity, []).append((first, n))
            tree.add(capacity, n)

    for length in sorted((k for k, n in histogram.items() if n), reverse=True):
        piece, left = 0, histogram[length]
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity, first, n = size, windows, -(-left // (size // length))
                windows += n
            else:
                first, n = ranges[capacity].pop()
                tree.add(capacity, -n)
            each = capacity // length
            full, rest = divmod(min(left, n * each), each)
            runs.append((length, piece, first, each, size - capacity))
            keep(capacity - each * length, first, full)
            if rest:
                keep(capacity - rest * length, first + full, 1)
            keep(capacity, first + full + bool(rest), n - full - bool(rest))
            piece += full * each + rest
            left -= full * each + rest
    return runs, windows


_PIECES = "doc_id {}, start long, length int, doc_tokens long, ids binary, within long, run int"


def _pieces(batches: Iterator[pa.RecordBatch], file: str, size: int, end_id: int, run_of) -> Iterator[pa.RecordBatch]:
    encode, run = encoder(file), run_of()
    made = np.zeros(size + 1, np.int64)  # pieces of each length so far
    for batch in batches:
        texts, ids_column = batch.column("text"), batch.column("doc_id")
        nbytes = 0
        first = 0
        rows = texts.to_pylist()
        for i in range(len(rows) + 1):
            if i < len(rows) and nbytes < 1 << 20:
                nbytes += len(rows[i] or "")
                continue
            if i > first:
                at, start, length, total, blobs = [], [], [], [], []
                for j, ids in enumerate(encode([t or "" for t in rows[first:i]]), first):
                    ids.append(end_id)
                    blob = np.array(ids, "<u4").tobytes()
                    for s in range(0, len(ids), size):
                        at.append(j), start.append(s), length.append(min(size, len(ids) - s)), total.append(len(ids)), blobs.append(blob[4 * s : 4 * (s + size)])
                n, within = len(at), []
                for k in length:
                    within.append(made[k])
                    made[k] += 1
                yield pa.RecordBatch.from_arrays(
                    [ids_column.take(pa.array(at, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(total, pa.int64()), pa.array(blobs, pa.binary()), pa.array(within, pa.int64()), pa.array([run] * n, pa.int32())],
                    ["doc_id", "start", "length", "doc_tokens", "ids", "within", "run"],
                )
            first, nbytes = i, len(rows[i] or "") if i < len(rows) else 0


def _run_id() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _read_file(spark: SparkSession, path: str) -> str:
    """On the driver; paths with a scheme are read by Spark."""
    if "://" in path:
        return bytes(spark.read.format("binaryFile").load(path).first()["content"]).decode()
    with open(path, encoding="utf-8") as f:
        return f.read()


def pack(docs: DataFrame, size: int = SIZE, end_id: int = 0, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, doc_tokens, ids (little-endian unsigned 32-bit), ids_crc32, sequence_id, offset.

    The pieces of a sequence by offset are its tokens, with nothing between them; what is left is padding.
    """
    spark = docs.sparkSession
    file = spark.sparkContext.broadcast(_read_file(spark, tokenizer or public_tokenizers.path("byte_bpe_50k.json")))  # a vocabulary: some MB
    texts = pick(docs, doc_id=id_col, text=text_col)
    pieces = texts.mapInArrow(lambda it: _pieces(it, file.value, size, end_id, _run_id), _PIECES.format(texts.schema["doc_id"].dataType.simpleString()))
    pieces = written(pieces, "pieces")
    counts = written(pieces.groupBy("length", "run").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most size rows
    runs, _ = plan({k: n for k, n in histogram.items() if k < size}, size)
    fulls = histogram.get(size, 0)
    if fulls:
        runs = [(n, p, w + fulls, e, o) for n, p, w, e, o in runs] + [(size, 0, 0, 1, 0)]
    before = F.sum("n").over(Window.partitionBy("length").orderBy("run")) - F.col("n")  # a row for each run
    firsts = counts.select("length", "run", before.alias("before"))
    ranked = pieces.withColumn("ids_crc32", F.crc32("ids"))
    ranked = ranked.join(broadcast_if_small(firsts, COUNT_ROWS), ["length", "run"]).withColumn("piece", F.col("before") + F.col("within"))
    # The plan has some runs for each length: arrays by length, searched by the piece's number.
    by_length: dict[int, list] = {}
    for n, *rest in sorted(runs):
        by_length.setdefault(n, []).append(tuple(rest))
    table = spark.createDataFrame(
        [(n, [r[0] for r in rs], [dict(zip(("piece", "window", "each", "offset"), r, strict=True)) for r in rs]) for n, rs in by_length.items()],
        "length int, begins array<long>, runs array<struct<piece:long,window:long,each:long,offset:long>>",
    )
    found = ranked.join(F.broadcast(table), "length")
    run = F.expr("element_at(runs, size(filter(begins, b -> b <= piece)))")
    found = found.withColumn("hit", run).withColumn("nth", F.col("piece") - F.col("hit.piece"))
    return found.select(
        "doc_id", "start", F.col("length").cast("long").alias("length"), "doc_tokens", "ids", "ids_crc32",
        (F.col("hit.window") + F.expr("nth div hit.each")).alias("sequence_id"), (F.col("hit.offset") + F.expr("nth % hit.each") * F.col("length")).alias("offset"),
    )


def op10_packing(spark, sf_dir: str) -> DataFrame:
    packed = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


QUERIES = {"op10_packing": op10_packing}
ORACLES: dict[str, str] = {}
