"""Connected components of links: bounded tasks shrink a forest level by level until one task can finish it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amphora.session import forget, materialize


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labels of all links of one task: each id with the smallest id it is linked to."""
    leader: dict = {}

    def lead(x):
        path = []
        while (up := leader.setdefault(x, x)) != x:
            path.append(x)
            x = up
        for p in path:
            leader[p] = x
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = lead(a), lead(b)
            if x != y:
                leader[max(x, y)] = min(x, y)
    ids = list(leader)
    if ids:
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([lead(x) for x in ids])], names=["id", "label"])


def contract(links: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
    """One level of contraction: (a, c), every id of the links with the id it goes on as, and the links (a, b) between those.

    Each id gets a random rank, drawn anew at every level, and joins the neighbour of the least rank (itself, if none is less). What joined one
    neighbour goes on as the smallest of its ids. At a random order the ids that go on are half of all in expectation, on chains as on stars,
    so the levels grow with the logarithm of the ids, whatever their numbering. Degrees are aggregated in part before they
    are shuffled, and the joins have one unique side, so that a hub's skewed part can be split.
    """
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    rank = lambda c: F.struct(F.xxhash64(c, F.lit(level)).alias("r"), F.col(c).alias("x"))
    joined = materialize(both.groupBy("a").agg(F.min(rank("b")).alias("m")).select("a", F.least(rank("a"), "m")["x"].alias("m")), "joined")
    names = joined.groupBy("m").agg(F.min("a").alias("c"))
    goes_on = materialize(joined.join(names, "m").select("a", "c"), "goes_on")
    forget(joined)
    x, y = goes_on.withColumnRenamed("c", "x"), goes_on.select(F.col("a").alias("b"), F.col("c").alias("y"))
    rest = links.join(x, "a").join(y, "b").where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
    return goes_on, rest


def shrink(links: DataFrame, bound: int, thin: Callable[[DataFrame, int], DataFrame] | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """(links, levels): links of (a, b) contracted until they are at most ``bound``, and what every level renamed.

    ``thin`` reduces the links of one level inside bounded tasks, given how many such tasks are needed.
    """
    levels: list[DataFrame] = []
    now = materialize(links, "links")
    while (n := now.count()) > bound:
        if thin:
            thinner = materialize(thin(now, -(-n // bound)), "links")
            forget(now)
            now = thinner
        goes_on, rest = contract(now, len(levels))
        rest = materialize(rest, "links")
        forget(now)
        levels.append(goes_on)
        now = rest
    return now, levels


def unfold(labels: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(id, label) of all ids from the labels (id, label) of the last level."""
    for goes_on in reversed(levels):
        deeper = labels.select(F.col("id").alias("c"), F.col("label").alias("deep"))
        labels = materialize(goes_on.join(deeper, "c", "left").select(F.col("a").alias("id"), F.coalesce("deep", "c").alias("label")), "labels")
        forget(goes_on)
    return labels


def component_labels(links: DataFrame, bound: int = 1_000_000) -> DataFrame:
    """(id, label): every id of the links (a, b) with the smallest id of its component.

    Links are contracted level by level until at most ``bound`` are left, which one task finishes; each level is written to the shared
    folder. Ids may be of any orderable type; a link of an id to itself makes it a component of its own.
    """
    kind = links.schema["a"].dataType.simpleString()
    rest, levels = shrink(links.select("a", "b").distinct(), bound)
    return unfold(rest.repartition(1).mapInArrow(_solve, f"id {kind}, label {kind}"), levels)  # at most ``bound`` links
