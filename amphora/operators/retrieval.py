"""From questions to passages over the graph: spans to seeds, bounded neighbourhoods, candidate chunks, context."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from amphora.functions.text import normalize_name, snippet
from amphora.operators.components import component_labels
from amphora.operators.graph import EDGE
from amphora.schema import EDGE_CAP, HOPS
from amphora.session import materialize

_SEP = "\x01"


def node_key(name: str, type_: str) -> F.Column:
    return F.concat_ws(_SEP, name, type_)


def link_spans(spans: DataFrame, node_table: DataFrame) -> DataFrame:
    """(query_id, name, type): nodes whose normalized name equals a span's; all types of the name, unmatched spans vanish."""
    wanted = spans.select("query_id", normalize_name(F.col("span")).alias("norm")).where("norm <> ''").distinct()
    named = node_table.select("name", "type", normalize_name(F.col("name")).alias("norm"))
    return wanted.join(named, "norm").select("query_id", "name", "type").distinct()


def variant_labels(same_as: DataFrame) -> DataFrame:
    """(node, label) of nodes in same-as links of any length; other nodes are their own variant."""
    links = same_as.select(node_key("a_name", "a_type").alias("a"), node_key("b_name", "b_type").alias("b"))
    return component_labels(links).select(F.col("id").alias("node"), "label")


def _labelled(df: DataFrame, column: str, labels: DataFrame, name: str) -> DataFrame:
    return df.join(labels.withColumnRenamed("node", column), column, "left").withColumn(name, F.coalesce("label", column)).drop("label")


def _claim_in_order(cap: int | None):
    """Nodes of a query's frontier take their edges one after another; an edge cut by one node's cap may go to a later one."""

    def claim(frame: pd.DataFrame) -> pd.DataFrame:
        taken, rows = set(), []
        for _, own in frame.sort_values(["node", "chunks", "edge"], ascending=[True, False, True]).groupby("node", sort=True):
            free = own[~own["edge"].isin(taken)].drop_duplicates("edge")
            free = free if cap is None else free.head(cap)
            taken.update(free["edge"])
            rows.append(free)
        return pd.concat(rows)[["query_id", "edge", "node", "other", "chunks"]]

    return claim


def neighborhood(seeds: DataFrame, edge_table: DataFrame, same_as: DataFrame, hops: int = HOPS, cap: int = EDGE_CAP, in_order: bool = True) -> DataFrame:
    """(query_id, hop, node, edge key, chunks): edges within ``hops`` of a query's seeds, once each at the shallowest hop.

    Every name of a node counts as the node. From the second hop on a node keeps its ``cap`` edges with the most chunks (then by key).
    The nodes of a frontier choose one after another, in the order of their keys, so that an edge taken by an earlier node doesn't use up a later
    one's cap; that gathers a query's candidate edges of one hop in one task, so it is for bounded questions. The far end of an edge enters the
    next frontier unless it was visited; between two names of one node the stored target is the far end.

    Without ``in_order`` the nodes choose apart, all in the cluster: an edge that several nodes of the frontier keep goes to the smallest of them.
    The two agree unless the cap binds on an edge that two frontier nodes reach.
    """
    labels = materialize(variant_labels(same_as), "variants")
    keyed = edge_table.select(*EDGE, "chunks", node_key("source", "source_type").alias("s"), node_key("target", "target_type").alias("t"), F.concat_ws(_SEP, *EDGE).alias("edge"))
    keyed = materialize(_labelled(_labelled(keyed, "s", labels, "sl"), "t", labels, "tl"), "keyed")
    away = keyed.select("edge", "chunks", F.col("sl").alias("near"), F.col("t").alias("other"))
    back = keyed.where("sl <> tl").select("edge", "chunks", F.col("tl").alias("near"), F.col("s").alias("other"))
    incident = away.unionByName(back)
    visited = materialize(seeds.select("query_id", node_key("name", "type").alias("node")).distinct(), "frontier")
    frontier, kept = visited, None
    for hop in range(1, hops + 1):
        near = _labelled(frontier, "node", labels, "near")
        found = near.join(incident, "near").select("query_id", "node", "edge", "chunks", "other")
        if kept is not None:
            found = found.join(kept.select("query_id", "edge"), ["query_id", "edge"], "left_anti")
        if in_order:
            sorted_out = found.groupBy("query_id").applyInPandas(_claim_in_order(cap if hop > 1 else None), found.select("query_id", "edge", "node", "other", "chunks").schema)
        if hop > 1 and not in_order:
            w = Window.partitionBy("query_id", "node").orderBy(F.desc("chunks"), "edge")
            found = found.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= cap).drop("_k")
        claimed = sorted_out if in_order else found.groupBy("query_id", "edge").agg(F.min("node").alias("node"), F.min_by("other", "node").alias("other"), F.first("chunks").alias("chunks"))
        claimed = materialize(claimed.withColumn("hop", F.lit(hop)), "hop")
        kept = claimed if kept is None else kept.unionByName(claimed)
        if hop < hops:
            frontier = materialize(claimed.select("query_id", F.col("other").alias("node")).distinct().join(visited, ["query_id", "node"], "left_anti"), "frontier")
            visited = visited.unionByName(frontier)
    return kept.select("query_id", "hop", "node", "edge", "chunks").join(keyed.select("edge", *EDGE), "edge")


def candidate_chunks(traversed: DataFrame, edge_chunk_table: DataFrame) -> DataFrame:
    """(query_id, chunk_id, ord): the chunks of the traversed edges in order of first sight."""
    first = F.min(F.struct("hop", "node", (-F.col("chunks")).alias("n"), "edge", "seen")).alias("first")
    seen = traversed.join(edge_chunk_table, EDGE).groupBy("query_id", "chunk_id").agg(first)
    w = Window.partitionBy("query_id").orderBy("first.hop", "first.node", "first.n", "first.edge", "first.seen", "chunk_id")
    return seen.select("query_id", "chunk_id", F.row_number().over(w).alias("ord"))


def hit_lines(hits: DataFrame, decimals: int = 3, width: int = 200, found_by: bool = False) -> DataFrame:
    """(query_id, rank, head, body): a hit for a terminal, "[score] title  (chunk_id)" with the lists that found it if asked, and a snippet."""
    head = [F.format_string(f"[%.{decimals}f]", F.col("score"))]
    if found_by:
        head.append(F.format_string(" [%3s]", F.col("found_by")))
    head.append(F.format_string(" %s  (%s)", F.coalesce("title", F.lit("")), F.col("chunk_id")))
    return hits.select("query_id", "rank", F.concat(*head).alias("head"), F.concat(F.lit("    "), snippet(F.col("text"), width)).alias("body"))


def graph_only(passages: DataFrame, hits: DataFrame) -> DataFrame:
    """Passages whose article title no hit of the query has."""
    return passages.join(hits.select("query_id", "title").distinct(), ["query_id", "title"], "left_anti")


def context_block(hits: DataFrame, start: int = 1) -> DataFrame:
    """(query_id, context): numbered passages "[i] (title) text" parted by blank lines; ``rank`` orders a query's few hits."""
    line = F.format_string("[%d] (%s) %s", F.col("rank") + (start - 1), F.coalesce("title", F.lit("")), F.coalesce("text", F.lit("")))
    lines = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n\n").alias("context"))


def source_lines(hits: DataFrame, graph_only_ids: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, line): "  [i] title (chunk_id)", with a mark on passages only the graph found."""
    line = F.format_string("  [%d] %s (%s)", F.col("rank"), F.coalesce("title", F.lit("")), F.col("chunk_id"))
    if graph_only_ids is None:
        return hits.select("query_id", "rank", line.alias("line"))
    marked = hits.join(graph_only_ids.select("query_id", "chunk_id").distinct().withColumn("only", F.lit("  <- graph-only")), ["query_id", "chunk_id"], "left")
    return marked.select("query_id", "rank", F.concat(line, F.coalesce("only", F.lit(""))).alias("line"))
