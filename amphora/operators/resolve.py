"""Finding names of one thing: candidate pairs by shared tokens and by vectors, limited to hubs, minus decided ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amphora.functions.text import name_tokens
from amphora.schema import HUB_DEGREE, MAX_BLOCK

PAIR = ["type", "a_name", "b_name"]


def token_block_pairs(node_table: DataFrame, max_block: int = MAX_BLOCK) -> DataFrame:
    """(type, a_name, b_name), a_name < b_name: nodes of one type sharing a name token.

    A token's block is counted first, and blocks of more than ``max_block`` nodes are left out before the join: such tokens
    don't tell names apart. So a block emits at most max_block * (max_block - 1) / 2 pairs.
    """
    tokens = node_table.select("name", "type", F.explode(name_tokens(F.col("name"))).alias("token"))
    sizes = tokens.groupBy("type", "token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(2, max_block)).select("type", "token")
    kept = tokens.join(sizes, ["type", "token"])
    a, b = kept.withColumnRenamed("name", "a_name"), kept.withColumnRenamed("name", "b_name")
    return a.join(b, ["type", "token"]).where("a_name < b_name").select(*PAIR).distinct()


def hubs(degree_table: DataFrame, least: int = HUB_DEGREE) -> DataFrame:
    return degree_table.where(F.col("degree") >= least).select("type", "name")


def candidate_pairs(name_pairs: DataFrame, vector_pairs: DataFrame, hub_table: DataFrame) -> DataFrame:
    """Pairs of either kind with at least one end among the hubs."""
    every = name_pairs.select(*PAIR).union(vector_pairs.select(*PAIR)).distinct()
    a = every.join(hub_table.withColumnRenamed("name", "a_name"), ["type", "a_name"], "left_semi").select(*PAIR)
    b = every.join(hub_table.withColumnRenamed("name", "b_name"), ["type", "b_name"], "left_semi").select(*PAIR)
    return a.union(b).distinct()


def pending_pairs(candidates: DataFrame, decided: DataFrame) -> DataFrame:
    """Candidates without a decision; ``decided`` has its ends in order."""
    done = decided.where("a_type = b_type").select(F.col("a_type").alias("type"), "a_name", "b_name")
    return candidates.join(done, PAIR, "left_anti")


def resume_pending(work: DataFrame, done: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Work whose key isn't among the done ones."""
    return work.join(done.select(key).distinct(), key, "left_anti")
