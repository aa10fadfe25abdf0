"""From raw documents to packed training sequences: each stage keeps or drops whole rows, the last one packs.

A stage gets what its predecessor kept as docs and returns the columns of documents. Decisions are made for rows, not
for ids, so repeated and null ids are filtered like all others. What is decided by a text alone (language, benchmark)
goes by the text's digest: rows with equal texts share their fate. Where one row of a group stays, rows are numbered
first, in a written table; it is the one with the smallest doc_id (null last), of repeated rows any single one.

Defined results: null and empty texts have no letter and are rejected by the first stage; the others keep one of them
(exact) or all (near copies: texts without words are no group); an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import broadcast_if_small, written
from tessella.llm.decontaminate import decontaminate
from tessella.llm.exact_dedup import exact_dedup
from tessella.llm.language_id import identify
from tessella.llm.near_dedup import near_dedup
from tessella.llm.packing import pack

#: A text in which no language has this share of the words is rejected, as is one without letters.
LEAST_SHARE = 1 / 3
NEAR_PERCENT = 80
REJECTED_ROWS = 1_000_000


def _plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns c0, c1, ..., and which of them the columns of documents are: names of extra columns can't clash."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]), {n: f"c{docs.columns.index(n)}" for n in ("doc_id", "text", "lang")}


def _without(rows: DataFrame, key: str, rejected: DataFrame, names: list[str], name: str) -> DataFrame:
    rejected = written(rejected.select(F.col("doc_id").alias("rejected")).distinct(), name)
    return rows.join(broadcast_if_small(rejected, REJECTED_ROWS), rows[key] == rejected["rejected"], "left_anti").drop(key).toDF(*names)


def _by_text(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    rows, at = _plain(docs)
    return rows.withColumn("digest", F.sha2(F.coalesce(at["text"], F.lit("")), 256)), at


def _by_row(docs: DataFrame, name: str) -> tuple[DataFrame, dict[str, str]]:
    rows, at = _plain(docs)
    return written(rows.withColumn("row", F.monotonically_increasing_id()), name), at


def _others(rows: DataFrame, id_column: str, groups: DataFrame) -> DataFrame:
    """The rows (doc_id) that leave their groups (doc_id, group), whose ids are row numbers."""
    ids = rows.select(F.col("row").alias("doc_id"), F.col(id_column).alias("named"))
    order = F.struct(F.col("named").isNull(), "named", "doc_id")
    stays = groups.join(ids, "doc_id").groupBy("group").agg(F.min(order)["doc_id"].alias("stays"))
    return groups.join(stays, "group").where("doc_id <> stays")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, at = _by_text(docs)
    found = identify(rows, id_col="digest", text_col=at["text"], lang_col=at["lang"])
    return _without(rows, "digest", found.where((F.col("lang_pred") == "und") | (F.col("score") < LEAST_SHARE)), docs.columns, "rejected-language")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, at = _by_row(docs, "rows-exact")
    found = exact_dedup(rows, id_col="row", text_col=at["text"]).where("group_size > 1")
    groups = written(found.select("doc_id", F.col("keep_id").alias("group")), "groups-exact")
    return _without(rows, "row", _others(rows, at["doc_id"], groups), docs.columns, "rejected-exact")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, at = _by_row(docs, "rows-near")
    found = near_dedup(rows, percent=NEAR_PERCENT, id_col="row", text_col=at["text"]).where("n_shingles > 0")
    found = written(found.select("doc_id", F.col("component_id").alias("group"), "kept"), "groups-near")
    several = broadcast_if_small(written(found.where("NOT kept").select("group").distinct(), "several-near"), REJECTED_ROWS)
    return _without(rows, "row", _others(rows, at["doc_id"], found.join(several, "group", "left_semi")), docs.columns, "rejected-near")


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, at = _by_text(docs)
    found = decontaminate(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="digest", text_col=at["text"])
    return _without(rows, "digest", found.where("contaminated"), docs.columns, "rejected-benchmark")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontaminate", benchmark_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the language model nor best-fit decreasing; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
