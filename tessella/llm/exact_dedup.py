"""Exact dedup by a tree-merge of sorted digest runs.

Every input partition makes a run: its digests in order, each once, with the smallest id and the number of rows.
Runs are exchanged in binomial rounds. In each round FAN_IN neighbouring runs meet in one task for each range of
digests, which merges them: equal neighbours become one, verified by a second checksum and the length of the
text, and the smallest identifier is retained. Ranges keep every merge small however many runs there are, and a
text that a third of all rows share enters an exchange once for each run at most. What was found goes back down to
the rows by (run, digest), so that the rows of one text are spread over as many tasks as they came from.

Defined results: a null text counts as empty; null ids sort after all others and keep_id is null only if all ids of
a group are null; of repeated rows (same id and text) all are marked kept, since they have the id that stays; an
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, written

FAN_IN = 16
WHITE = r"[\x20\x09-\x0D]+"
_RUN = "range int, run long, digest binary, length long, check long, keep_id long, size long"


_KEYS = ["range", "run", "digest", "length", "check"]
_SCHEMA = pa.schema([("range", pa.int32()), ("run", pa.int64()), ("digest", pa.binary()), ("length", pa.int64()), ("check", pa.int64()), ("keep_id", pa.int64()), ("size", pa.int64())])
_MOST = np.iinfo(np.int64).max


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (range, run, digest, length, check): merge equal neighbours, across batches as well.

    Ids stay 64-bit integers; whether one is null is told by a mask beside them.
    """
    carry = None
    for batch in batches:
        rows = pa.Table.from_batches([batch]).cast(_SCHEMA)
        rows = (rows if carry is None else pa.concat_tables([carry, rows])).combine_chunks()
        n = rows.num_rows
        if not n:
            continue
        new = np.zeros(n, bool)
        new[0] = True
        for key in _KEYS:  # the digest finds a text, length and check verify it
            column = rows[key].combine_chunks()
            new[1:] |= pc.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        begin = np.flatnonzero(new)
        null = rows["keep_id"].combine_chunks().is_null().to_numpy(zero_copy_only=False)
        ids = pc.fill_null(rows["keep_id"].combine_chunks(), _MOST).to_numpy(zero_copy_only=False)
        least = pa.array(np.minimum.reduceat(ids, begin), mask=np.logical_and.reduceat(null, begin))
        out = rows.take(pa.array(begin))
        out = out.set_column(5, _SCHEMA.field("keep_id"), least).set_column(6, _SCHEMA.field("size"), pa.array(np.add.reduceat(rows["size"].to_numpy(), begin)))
        carry = out.slice(out.num_rows - 1)
        yield from out.slice(0, out.num_rows - 1).to_batches()
    if carry is not None:
        yield from carry.to_batches()


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256 (of the text with white space runs as one space)."""
    spark = docs.sparkSession
    text = F.regexp_replace(F.coalesce("text", F.lit("")), WHITE, " ")
    keyed = pick(docs, doc_id=id_col, text=text_col).select("doc_id", text.alias("text"))
    keyed = keyed.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.unhex(F.sha2("text", 256)).alias("digest"),
        F.octet_length("text").cast("long").alias("length"),
        F.xxhash64("text").alias("check"),
        F.spark_partition_id().cast("long").alias("run"),
    )
    rows = written(keyed, "exact-rows")
    last = rows.agg(F.max("run")).first()[0]
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    span = F.pmod(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), F.lit(ranges)).cast("int")
    # The first merge is that of a partition's own rows: Spark combines them before the exchange.
    runs = rows.groupBy("run", "digest", "length", "check").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("size"))
    runs = runs.select(span.alias("range"), "run", "digest", "length", "check", "keep_id", "size")
    own = runs.select("run", "digest", "length", "check")
    width = 1
    while width <= (last or 0) or width == 1:
        runs = runs.withColumn("run", F.expr(f"run div {fan_in}"))
        runs = runs.repartition(ranges, "range", "run").sortWithinPartitions("range", "run", "digest", "length", "check")
        runs = runs.mapInArrow(_merge, _RUN)
        width *= fan_in
    found = runs.select("digest", "length", "check", "keep_id", "size")
    key = ["digest", "length", "check"]
    back = own.join(found, key)
    out = rows.join(back, ["run", *key])
    return out.select(
        "doc_id", "keep_id", F.col("size").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op2_exact_dedup": op2_exact_dedup}
ORACLES = {
    "op2_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY norm)"""
}
