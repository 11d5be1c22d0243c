"""Groups from pairwise matches: union-find inside bounded edge partitions, spanning forests merged upwards.

Method. Nodes get dense-ordered ids by a range-partitioned sort on (name, type), so the smallest id of a group is its
smallest node. Every edge partition runs union-find and keeps only its spanning forest (node -> smallest node). The
forests are merged upwards: each level scatters the edges that are left over partitions of at most ``bound`` edges, runs union-find in each
and contracts the spanning forests by one step of random hooking, which halves the nodes in expectation, on a chain as on a star. When one
partition holds what is left, its union-find gives the global components, and the levels are unfolded. There are about log2(edges / bound)
levels, and no task ever holds more than ``bound`` edges.

Scale. Ids are longs; repeated pairs vanish before the ids are joined; a hub with a third of all edges is
spread over partitions by its edges' hash, and its minimum is a partial aggregate. Nothing is collected but counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amphora.operators.components import shrink, unfold
from amphora.session import materialize

_EDGE = "a bigint, b bigint"


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the edges as stars: every node but the smallest of its component, with that smallest."""
    ids, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(ids)))
    for x, y in zip(inv[: len(a)].tolist(), inv[len(a) :].tolist(), strict=True):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x < y:
            parent[y] = x
        elif y < x:
            parent[x] = y
    for x in range(len(parent)):  # parents are smaller, so theirs are final
        parent[x] = parent[parent[x]]
    root = ids[np.array(parent, dtype=np.int64)] if len(ids) else ids
    keep = root != ids
    return ids[keep], root[keep]


def _forest(step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fa, fb, n = [], [], 0

        def merge() -> None:
            nonlocal fa, fb, n
            x, y = union_find(np.concatenate(fa), np.concatenate(fb))
            fa, fb, n = [x], [y], 0

        for batch in batches:
            fa.append(batch.column(0).to_numpy())
            fb.append(batch.column(1).to_numpy())
            n += batch.num_rows
            if n >= step:  # keep only the forest of what has been read
                merge()
        if fa:
            merge()
            for i in range(0, len(fa[0]), 100_000):
                yield pa.RecordBatch.from_pydict({"a": pa.array(fa[0][i : i + 100_000]), "b": pa.array(fb[0][i : i + 100_000])})

    return run


def forest(edges: DataFrame, step: int = 500_000) -> DataFrame:
    return edges.mapInArrow(_forest(step), _EDGE)


def min_labels(edges: DataFrame, bound: int = 2_000_000) -> DataFrame:
    """(a, b): every node that isn't the smallest of its component, with that smallest. Edges are pairs of longs."""
    scattered = lambda e, parts: forest(e.repartition(parts, F.xxhash64("a", "b")))
    rest, levels = shrink(forest(edges.select("a", "b").where("a <> b")), bound, scattered)
    labels = forest(rest.repartition(1), bound)  # at most ``bound`` edges
    if not levels:
        return labels
    return unfold(labels.toDF("id", "label"), levels).where("id <> label").toDF("a", "b")


def decision_nodes(resolutions: DataFrame) -> DataFrame:
    """The two entries of every pair that has exactly two, as (an, at, bn, bt, ...)."""
    p = resolutions.where(F.size("pair") == 2)
    node = lambda i, j: F.get(F.get("pair", F.lit(i)), F.lit(j))
    return p.select(node(0, 0).alias("an"), node(0, 1).alias("at"), node(1, 0).alias("bn"), node(1, 1).alias("bt"), "same", "canonical", "decided_at", "decision_id")


def ordered_nodes(pairs: DataFrame) -> DataFrame:
    """(id, name, type): distinct nodes; ids ascend with (name, type)."""
    ends = pairs.select(F.col("an").alias("name"), F.col("at").alias("type")).unionByName(pairs.select(F.col("bn").alias("name"), F.col("bt").alias("type")))
    return materialize(
        ends.distinct().repartitionByRange("name", "type").sortWithinPartitions("name", "type").select(F.monotonically_increasing_id().alias("id"), "name", "type"),
        "nodes",
    )


def groups(resolutions: DataFrame, bound: int = 2_000_000) -> DataFrame:
    """(id, name, type, group): every node with the id of the smallest node of its group.

    Nodes are the entries of pairs with exactly two entries, whatever ``same`` says; only ``same = true`` links. Null
    or shorter or longer pairs hold no node; a null name or type is a value of its own and sorts first; a node paired
    with itself is a node, not a link. An empty table gives no rows.
    """
    pairs = decision_nodes(resolutions)
    nodes = ordered_nodes(pairs)
    links = pairs.where("same").select("an", "at", "bn", "bt").distinct()
    na = nodes.select(F.col("id").alias("a"), F.col("name").alias("n1"), F.col("type").alias("t1"))
    nb = nodes.select(F.col("id").alias("b"), F.col("name").alias("n2"), F.col("type").alias("t2"))
    edges = (
        links.join(na, F.col("an").eqNullSafe(F.col("n1")) & F.col("at").eqNullSafe(F.col("t1")))
        .join(nb, F.col("bn").eqNullSafe(F.col("n2")) & F.col("bt").eqNullSafe(F.col("t2")))
        .where("a <> b").select("a", "b")
    )
    labels = min_labels(edges, bound).select(F.col("a").alias("id"), F.col("b").alias("root"))
    return materialize(nodes.join(labels, "id", "left").select("id", "name", "type", F.coalesce("root", "id").alias("group")), "groups")


def group_names(grouped: DataFrame) -> DataFrame:
    """(name, type, group_name, group_type): the group's smallest node spelt out.

    Only members of groups of at least two are joined; a node alone is its own group.
    """
    heads = grouped.where("id = group").select(F.col("id").alias("group"), F.col("name").alias("group_name"), F.col("type").alias("group_type"))
    own = grouped.where("id = group").select("name", "type", F.col("name").alias("group_name"), F.col("type").alias("group_type"))
    rest = grouped.where("id <> group").join(heads, "group").select("name", "type", "group_name", "group_type")
    return own.unionByName(rest)
