"""Reciprocal rank fusion of ranked lists, and hybrid results with the lists that found them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from amphora.schema import HYBRID_K, RRF_K


def rrf(lists: DataFrame, k: int = RRF_K, key: str = "chunk_id") -> DataFrame:
    """(query_id, key, score) of (query_id, list_id, rank, key, weight): the weighted sum of 1 / (k + rank).

    A null weight is 1; an id twice in one list scores twice.
    """
    part = F.coalesce(F.col("weight"), F.lit(1.0)) / (F.lit(k) + F.col("rank")).cast("double")
    return lists.groupBy("query_id", key).agg(F.round(F.sum(part), 12).alias("score"))


def ranked(scored: DataFrame, k: int | None, key: str = "chunk_id") -> DataFrame:
    """Add ``rank``: by score, ties by id in string order; the first k if given."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col(key).cast("string"))
    out = scored.withColumn("rank", F.row_number().over(w))
    return out if k is None else out.where(F.col("rank") <= k)


def hybrid(vector_hits: DataFrame, keyword_hits: DataFrame, k: int = HYBRID_K, weights: tuple[float, float] = (1.0, 1.0), key: str = "chunk_id") -> DataFrame:
    """(query_id, key, score, found_by, rank) from two pools (query_id, key, rank): V, B or V+B says which pool holds a hit."""
    lists = vector_hits.select("query_id", key, "rank", F.lit("V").alias("list_id"), F.lit(weights[0]).alias("weight")).unionByName(
        keyword_hits.select("query_id", key, "rank", F.lit("B").alias("list_id"), F.lit(weights[1]).alias("weight"))
    )
    by = lists.groupBy("query_id", key).agg(F.bool_or(F.col("list_id") == "V").alias("v"), F.bool_or(F.col("list_id") == "B").alias("b"))
    tag = F.when(F.col("v") & F.col("b"), "V+B").when(F.col("v"), "V").otherwise("B")
    return ranked(rrf(lists, key=key).join(by, ["query_id", key]).withColumn("found_by", tag).drop("v", "b"), k, key)


def overlap(a: DataFrame, b: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Ids that both lists of a query hold."""
    return a.select("query_id", key).intersect(b.select("query_id", key))
