"""JSON-lines and Parquet tables: strict scans, done-id scans that tolerate a missing file, appends and rebuilds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amphora.functions.text import point_id
from amphora.schema import ARTICLE, DECISION, EXTRACTION


def read_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Every line has to parse."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return read_strict(spark, path, ARTICLE)


def read_extractions(spark: SparkSession, path: str) -> DataFrame:
    return read_strict(spark, path, EXTRACTION)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def done_ids(spark: SparkSession, path: str) -> DataFrame:
    """Distinct chunk ids of an extraction file; none if it doesn't exist. Blank lines are skipped."""
    if not exists(spark, path):
        return spark.createDataFrame([], "chunk_id string")
    return spark.read.schema(EXTRACTION).json(path).select("chunk_id").where("chunk_id is not null").distinct()


def decisions(spark: SparkSession, path: str) -> DataFrame:
    if not exists(spark, path):
        return spark.createDataFrame([], DECISION)
    return spark.read.schema(DECISION).json(path).where("pair is not null")


def count_lines(spark: SparkSession, path: str) -> int:
    """The lines of a file or folder that aren't blank; 0 if there is none."""
    return spark.read.text(path).where(F.trim("value") != "").count() if exists(spark, path) else 0


def write_corpus(articles: DataFrame, path: str) -> None:
    articles.write.mode("overwrite").json(path)


def append(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def rebuild_vectors(chunks: DataFrame, vector: F.Column, path: str) -> None:
    """Replace the vector table: the chunk columns, a name-based point id and the vector."""
    chunks.withColumns({"point_id": point_id(F.col("chunk_id")), "vector": vector}).write.mode("overwrite").parquet(path)
