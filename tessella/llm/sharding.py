"""Sharding by a k-d tree whose cuts are distributed weighted medians; DataFrame functions only.

The points are rows of metadata (size, language, source, id), their weights are bytes. All nodes of a level are cut
together: one aggregation finds each node's spread along every dimension, as a part of the whole table's; the widest
is cut where the bytes to its left are to those to its right as the leaves there are. The cut is found by
histograms of BINS cells, each narrowing the search to the cell that holds it, so the driver sees at most
leaves x BINS sums however many rows there are. A coordinate carries a hash of the row in its low bits: a value that
a third of all rows share can still be cut, and hot sources or groups of equal texts do not make a shard heavy. The
low bits say nothing of a spread: a dimension in which a node is constant is cut only if all are.
Leaves are cut until each stands for the target bytes (all bytes / shards), so the law is `bytes`.

Slots are ranks within a shard: counted over many small cells of each shard, whose first slots follow from sums.

Defined results: a null text has no bytes (size 8) and crc32 0; null ids, languages and sources are points like any
other; rows equal in every column differ in the lowest bits only, by where they are stored, and may be cut apart; an
empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pick, written

BINS = 4096
DIMS = 4
#: Bits of a row's hash, and below them bits of its place, for repeated rows.
LOW_BITS, PLACE_BITS = 30, 8
#: A cell that holds less than this part of a shard is cut no finer.
TOLERANCE = 1 / 4096


def _coordinate(value: Column) -> Column:
    """A value below 2^32 above LOW_BITS bits of the row's hash."""
    return F.shiftleft(value, LOW_BITS).bitwiseOR(F.col("tie"))


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of integers as a plan of literals."""
    fields = [f.split() for f in schema.split(", ")]
    values = ", ".join(f"({', '.join(f'CAST({v} AS {dict(long="BIGINT").get(t, t)})' for v, (_, t) in zip(r, fields, strict=True))})" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(n for n, _ in fields)})")


def _cut_points(points: DataFrame, jobs: dict[int, dict]) -> dict[int, int]:
    """For each node its cut: rows whose coordinate is below it go left. jobs: dimension, low, high, wanted bytes."""
    spark = points.sparkSession
    state = {n: {"dim": j["dim"], "low": j["low"], "high": j["high"] + 1, "before": 0} for n, j in jobs.items()}
    cuts: dict[int, int] = {}
    while state:
        for s in state.values():
            s["step"] = max(1, -(-(s["high"] - s["low"]) // BINS))
        if list(jobs) == [0]:  # the root is all of the table
            s = state[0]
            asked = points.withColumns({"dim": F.lit(s["dim"]), "low": F.lit(s["low"]), "step": F.lit(s["step"])})
        else:
            asked = points.join(F.broadcast(_table(spark, [(n, s["dim"], s["low"], s["step"]) for n, s in state.items()], "node int, dim int, low long, step long")), "node")
        cells = asked.withColumn("at", F.element_at("coords", F.col("dim") + 1) - F.col("low"))
        cells = cells.where(F.col("at") >= 0).select("node", "size", F.expr("at div step").alias("cell")).where(F.col("cell") < BINS)
        sums: dict[int, dict[int, int]] = {n: {} for n in state}
        for r in cells.groupBy("node", "cell").agg(F.sum("size").alias("bytes")).collect():  # at most nodes x BINS rows
            sums[r["node"]][r["cell"]] = r["bytes"]
        for n, s in list(state.items()):
            reached, cell = s["before"], 0
            for cell in sorted(sums[n]):
                if reached + sums[n][cell] >= jobs[n]["want"]:
                    break
                reached += sums[n][cell]
            start = s["low"] + cell * s["step"]
            stop = min(s["high"], start + s["step"])
            if s["step"] == 1 or sums[n][cell] <= jobs[n]["tolerance"]:
                want = jobs[n]["want"]
                cuts[n] = stop if reached + sums[n][cell] - want <= want - reached else start
                del state[n]
            else:
                s.update(low=start, high=stop, before=reached)
    return cuts


def kd_shards(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", overhead: int = 8) -> DataFrame:
    """One row per row of docs: id, size (UTF-8 bytes + overhead), text_crc32, law, shard, slot, grown_shard (null)."""
    spark = docs.sparkSession
    rows = pick(docs, doc_id=id_col, text=text_col, lang=lang_col, source=source_col)
    text = F.coalesce("text", F.lit("")).cast("binary")
    points = rows.select(
        "doc_id", (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.crc32(F.coalesce("lang", F.lit("")).cast("binary")).alias("lang"), F.crc32(F.coalesce("source", F.lit("")).cast("binary")).alias("source"),
    )
    place = F.xxhash64(F.monotonically_increasing_id()).bitwiseAND((1 << PLACE_BITS) - 1)
    content = F.xxhash64("doc_id", "size", "text_crc32", "lang", "source").bitwiseAND((1 << LOW_BITS) - (1 << PLACE_BITS))
    points = written(points.withColumn("tie", content.bitwiseOR(place)), "shard-points")
    bounds = points.agg(F.min("doc_id"), F.max("doc_id"), F.sum("size"), F.count(F.lit(1))).first()
    id_shift = max(0, (bounds[1] - bounds[0]).bit_length() - 32) if bounds[0] is not None else 0
    order = F.coalesce(F.shiftright(F.col("doc_id") - F.lit(bounds[0] or 0).cast("long"), id_shift), F.lit(0))
    coords = (F.least("size", F.lit((1 << 32) - 1)), F.col("lang"), F.col("source"), order)
    points = points.select("doc_id", "size", "text_crc32", F.array(*map(_coordinate, coords)).alias("coords"), F.lit(0).alias("node"))
    total = bounds[2] or 0
    tolerance = int(total / shards * TOLERANCE)
    leaves, whole = {0: (0, shards)}, None  # node: its first shard and how many it stands for
    while total and (open_ := {n: v for n, v in leaves.items() if v[1] > 1}):
        spread = points.groupBy("node").agg(F.sum("size").alias("bytes"), *[f(F.shiftright(F.col("coords")[i], LOW_BITS)).alias(f"{p}{i}") for i in range(DIMS) for f, p in ((F.min, "low"), (F.max, "high"))])
        found = {r["node"]: r for r in spread.collect()}  # a row for each node
        whole = whole or [max(1, found[0][f"high{i}"] - found[0][f"low{i}"]) for i in range(DIMS)]
        jobs, after = {}, {n: v for n, v in leaves.items() if v[1] == 1}
        for n, (first, k) in open_.items():
            after[2 * n + 1], after[2 * n + 2] = (first, k // 2), (first + k // 2, k - k // 2)
            if r := found.get(n):
                widest = max(range(DIMS), key=lambda i: (r[f"high{i}"] - r[f"low{i}"]) / whole[i])
                jobs[n] = {"dim": widest, "low": r[f"low{widest}"] << LOW_BITS, "high": (r[f"high{widest}"] + 1 << LOW_BITS) - 1, "want": r["bytes"] * (k // 2) // k, "tolerance": tolerance}
        cuts = _cut_points(points, jobs)
        if list(jobs) == [0]:
            points = points.withColumn("node", F.when(F.col("coords")[jobs[0]["dim"]] >= cuts[0], 2).otherwise(1))
        else:
            table = _table(spark, [(n, jobs[n]["dim"], c) for n, c in cuts.items()], "node int, dim int, cut long")
            right = (F.element_at("coords", F.col("dim") + 1) >= F.col("cut")).cast("int")
            points = points.join(F.broadcast(table), "node", "left").select(
                "doc_id", "size", "text_crc32", "coords", F.when(F.col("cut").isNull(), F.col("node")).otherwise(2 * F.col("node") + 1 + right).alias("node"))
        leaves = after
    places = _table(spark, [(n, first) for n, (first, _) in leaves.items()], "node int, shard int")
    points = points.join(F.broadcast(places), "node")
    cells = max(16, min(4096, (bounds[3] or 0) // (shards * 200_000)))
    placed = points.select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(cells)).cast("int").alias("cell"))
    placed = written(placed, "shard-placed")
    counts = placed.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))  # shards x cells rows at most: 98,304
    firsts = counts.select("shard", "cell", (F.sum("n").over(Window.partitionBy("shard").orderBy("cell")) - F.col("n")).alias("first_slot"))
    within = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "size")) - 1
    return placed.withColumn("within", within).join(F.broadcast(firsts), ["shard", "cell"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first_slot") + F.col("within")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op7_kd_sharding(spark, sf_dir: str) -> DataFrame:
    return kd_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op7_kd_sharding": op7_kd_sharding}
ORACLES: dict[str, str] = {}
