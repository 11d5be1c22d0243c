"""The stored graph: merges of new records and links into versioned tables, as often as one likes with the same result.

A merge reads the newest version of a table and writes the next one beside it, so readers of the old version aren't
disturbed and a failed merge leaves nothing half written (a version counts once its success marker is there).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amphora.operators import graph
from amphora.operators.ordering import dense_order
from amphora.schema import NODE_TYPES, RELATION_TYPES
from amphora.sources.files import exists


_RECORD, _LOADS = 100_000, 1_000_000_000_000_000  # places in a record and in a load; room for ten thousand million records a load


def newest(spark: SparkSession, path: str) -> int:
    """The number of the newest complete version; 0 if there is none. Versions are found by doubling, then halving."""
    there = lambda n: exists(spark, f"{path}/v{n}/_SUCCESS")
    if not there(1):
        return 0
    high = 1
    while there(high * 2):
        high *= 2
    low, high = high, high * 2
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if there(middle) else (low, middle)
    return low


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    n = newest(spark, path)
    return spark.read.schema(schema).parquet(f"{path}/v{n}") if n else spark.createDataFrame([], schema)


def _merge(path: str, new: DataFrame, combine: Callable[[DataFrame], DataFrame], keys: list[str]) -> None:
    """The next version of a table, laid out by its keys: ranges of (name, type) in files, sorted, so that a look-up of a node reads the row groups that can hold it.

    That is what an index of the pair is for in a database; it is remade with every version.
    """
    spark = new.sparkSession
    n = newest(spark, path)
    every = spark.read.parquet(f"{path}/v{n}").unionByName(new) if n else new
    combine(every).repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(f"{path}/v{n + 1}")


def load_records(records: DataFrame, path: str) -> DataFrame:
    """Merge extraction records into ``path``/node_chunks and ``path``/edge_chunks; the counts (entities, relations, skipped_relations) of mentions.

    Names are taken as the records hold them. An entity needs a known type; a relation needs a known type and both names among the record's entities, of which
    the last one of a name gives the type. Loading a record again changes nothing but the counts. First sight is the time of loading, then the order of the chunks, then the place in the record.
    """
    spark = records.sparkSession
    base = (newest(spark, f"{path}/node_chunks") + 1) * _LOADS
    # records are numbered in the order of their chunks (by article, then place), so that first sight inside a load is that order
    place = lambda n: F.expr(f"try_cast(split_part(chunk_id, ':', {n}) as bigint)")
    keys = records.select("chunk_id").distinct().withColumns({"_a": place(1), "_b": place(2)})
    numbers = dense_order(keys, ["_a", "_b", "chunk_id"]).select("chunk_id", (F.lit(base) + F.col("ord") * _RECORD).alias("at"))
    e = graph.explode_entities(records).where(F.col("name").isNotNull() & F.col("type").isin(NODE_TYPES)).join(numbers, "chunk_id").withColumn("mention_id", F.col("ord").cast("bigint") + F.col("at")).drop("at")
    r = records.select("chunk_id", F.posexplode("relations").alias("ord", "r")).join(numbers, "chunk_id").select("chunk_id", (F.col("ord").cast("bigint") + F.col("at")).alias("relation_id"), "r.source", "r.relation", "r.target", "r.description")
    typed = graph.resolve_endpoints(r, e)
    ok = F.coalesce(F.col("relation").isin(list(RELATION_TYPES)), F.lit(False)) & F.col("source_type").isNotNull() & F.col("target_type").isNotNull()
    counts = graph.load_counts(r, e)
    told = typed.where(ok).groupBy(*graph.EDGE, "chunk_id", F.coalesce("description", F.lit("")).alias("description")).agg(F.min("relation_id").alias("seen"))
    _merge(f"{path}/node_chunks", graph.node_chunks(e), lambda t: t.groupBy("name", "type", "chunk_id").agg(F.min("seen").alias("seen")), ["name", "type"])
    _merge(f"{path}/edge_chunks", told, lambda t: t.groupBy(*graph.EDGE, "chunk_id", "description").agg(F.min("seen").alias("seen")), ["source", "source_type"])
    return counts


def link_same_as(links: DataFrame, path: str) -> None:
    """Merge links (a_name, a_type, b_name, b_type, canonical): one a pair whichever way round, the last canonical holds; ends that are no nodes are left out."""
    spark = links.sparkSession
    a, b = F.struct(F.col("a_name").alias("n"), F.col("a_type").alias("t")), F.struct(F.col("b_name").alias("n"), F.col("b_type").alias("t"))
    ends = links.where("a_name <> b_name or a_type <> b_type").select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y"), "canonical")
    pairs = ends.select(F.col("x.n").alias("a_name"), F.col("x.t").alias("a_type"), F.col("y.n").alias("b_name"), F.col("y.t").alias("b_type"), "canonical")
    node = read(spark, f"{path}/node_chunks", "name string, type string").select("name", "type").distinct()
    for side in ("a", "b"):
        pairs = pairs.join(node.toDF(f"{side}_name", f"{side}_type"), [f"{side}_name", f"{side}_type"], "left_semi")
    turn = newest(spark, f"{path}/same_as") + 1
    keys = ["a_name", "a_type", "b_name", "b_type"]
    _merge(f"{path}/same_as", pairs.select(*keys, "canonical").withColumn("turn", F.lit(turn)), lambda t: t.groupBy(*keys).agg(F.max(F.struct("turn", "canonical")).alias("x")).select(*keys, "x.canonical", "x.turn"), keys)
