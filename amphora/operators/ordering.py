"""Dense corpus order and first-seen distinct rows, without a global window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amphora.session import materialize


def dense_order(df: DataFrame, by: list[str], name: str = "ord") -> DataFrame:
    """Number rows 1, 2, ... in the order of ``by``: range partitions are numbered apart and shifted by the sizes before them.

    Only a size per partition reaches the driver. The table is sorted and written, so give it the columns of the order and a key, no texts.
    """
    marked = materialize(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_id", 33)
    sizes = sorted((r.p, r.n) for r in marked.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    pairs, total = [], 0
    for p, n in sizes:
        pairs += [F.lit(p), F.lit(total)]
        total += n
    if not pairs:
        return marked.withColumn(name, F.col("_id")).drop("_id")
    offset = F.create_map(*pairs)[part].cast("bigint")
    return marked.withColumn(name, offset + F.col("_id").bitwiseAND((1 << 33) - 1) + 1).drop("_id")


def first_distinct(df: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The first row of each key, and of these the first ``n``."""
    others = [c for c in df.columns if c != key and c not in order]
    first = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*order, *others)).alias("x"))
    return first.select(key, "x.*").orderBy(*order, key).limit(n)
