"""The knowledge graph: validation, nodes, edges and their provenance, degrees, links between names of one thing.

Provenance stays in long form, a row per node or edge and chunk with the order of first sight: no list of a name that
holds a third of all mentions is ever collected. Bounded heads of such lists come from ``head_of``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from amphora.functions.text import sanitize_name
from amphora.schema import MAX_DESCRIPTIONS, NODE_TYPES, RELATION_TYPES, allowed_triples

EDGE = ["source", "source_type", "relation", "target", "target_type"]


def explode_entities(records: DataFrame) -> DataFrame:
    """Extraction records (entities, relations nested) to mentions (chunk_id, title, ord, name, type, description)."""
    return records.select("chunk_id", "title", F.posexplode("entities").alias("ord", "e")).select("chunk_id", "title", "ord", "e.name", "e.type", "e.description")


def sanitize_entities(mentions: DataFrame) -> DataFrame:
    return mentions.withColumn("name", sanitize_name(F.col("name")))


def entity_reason(name: Column, type_: Column, node_types: list[str] = NODE_TYPES) -> Column:
    """Why an entity is rejected; null for a valid one."""
    return F.when(sanitize_name(name) == "", "missing name").when(~F.coalesce(type_.isin(node_types), F.lit(False)), "unknown node type")


def validate_entities(mentions: DataFrame) -> DataFrame:
    """Add ``reason``: null, "missing name" or "unknown node type"; the first rule that fails counts."""
    return mentions.withColumn("reason", entity_reason(F.col("name"), F.col("type")))


def valid_mentions(mentions: DataFrame) -> DataFrame:
    return sanitize_entities(mentions).where(entity_reason(F.col("name"), F.col("type")).isNull())


def declared_types(valid: DataFrame) -> DataFrame:
    """(chunk_id, name, type): of several types of a name in one chunk the last one counts."""
    return valid.groupBy("chunk_id", "name").agg(F.max_by("type", F.struct("ord", "mention_id")).alias("type"))


def resolve_endpoints(relations: DataFrame, valid: DataFrame) -> DataFrame:
    """Add ``source_type`` and ``target_type``: null where the chunk declares no such entity."""
    types = declared_types(valid)
    for end in ("source", "target"):
        t = types.select("chunk_id", F.col("name").alias(f"{end}_key"), F.col("type").alias(f"{end}_type"))
        relations = relations.withColumn(f"{end}_key", sanitize_name(F.col(end))).join(t, ["chunk_id", f"{end}_key"], "left").drop(f"{end}_key")
    return relations


def validate_relations(relations: DataFrame, valid: DataFrame, relation_types: dict = RELATION_TYPES) -> DataFrame:
    """Add the endpoint types and ``reason``: null or the first rule that fails."""
    triple = F.concat_ws("\x01", "relation", "source_type", "target_type")
    reason = (
        F.when(~F.coalesce(F.col("relation").isin(list(relation_types)), F.lit(False)), "unknown relation type")
        .when(F.col("source_type").isNull() | F.col("target_type").isNull(), "endpoint not declared")
        .when(~triple.isin(["\x01".join(t) for t in allowed_triples(relation_types)]), "endpoint type violates schema")
    )
    return resolve_endpoints(relations, valid).withColumn("reason", reason)


def reject_summary(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(kind, reason, rejects) of validated entities and relations."""
    both = entities.select(F.lit("entity").alias("kind"), "reason").unionByName(relations.select(F.lit("relation").alias("kind"), "reason"))
    return both.where("reason is not null").groupBy("kind", "reason").agg(F.count(F.lit(1)).alias("rejects"))


def node_chunks(valid: DataFrame) -> DataFrame:
    """(name, type, chunk_id, seen): each chunk of a node once, with the order of first sight."""
    return valid.groupBy("name", "type", "chunk_id").agg(F.min("mention_id").alias("seen"))


def nodes(valid: DataFrame) -> DataFrame:
    """(name, type, chunks, first_chunk, seen): merging the same mentions again changes nothing."""
    seen = node_chunks(valid)
    return seen.groupBy("name", "type").agg(F.count("chunk_id").alias("chunks"), F.min_by("chunk_id", "seen").alias("first_chunk"), F.min("seen").alias("seen"))


def edge_chunks(valid_relations: DataFrame) -> DataFrame:
    return valid_relations.groupBy(*EDGE, "chunk_id").agg(F.min("relation_id").alias("seen"))


def edge_descriptions(valid_relations: DataFrame) -> DataFrame:
    return valid_relations.groupBy(*EDGE, F.coalesce("description", F.lit("")).alias("description")).agg(F.min("relation_id").alias("seen"))


def edges(valid_relations: DataFrame) -> DataFrame:
    """(edge key, chunks, descriptions, first_description): directed, merged on the five-part key."""
    chunks = edge_chunks(valid_relations).groupBy(*EDGE).agg(F.count("chunk_id").alias("chunks"))
    told = edge_descriptions(valid_relations).groupBy(*EDGE).agg(F.count("description").alias("descriptions"), F.min_by("description", "seen").alias("first_description"))
    return chunks.join(told, EDGE)


def head_of(long: DataFrame, keys: list[str], value: str, order: list, n: int) -> DataFrame:
    """(keys, values): the first ``n`` values of each key in order. The rank filter prunes before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    first = long.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n)
    return first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", value))), lambda x: x[value]).alias("values"))


def node_descriptions(mentions: DataFrame, n: int = MAX_DESCRIPTIONS) -> DataFrame:
    """(name, type, values): the first descriptions of a node, repeated ones kept, a missing one as empty."""
    long = mentions.select("name", "type", "mention_id", F.coalesce("description", F.lit("")).alias("description"))
    return head_of(long, ["name", "type"], "description", ["mention_id"], n)


def load_counts(relations: DataFrame, valid: DataFrame, relation_types: dict = RELATION_TYPES) -> DataFrame:
    """(entities, relations, skipped_relations): mentions loaded; endpoint types aren't checked again at loading."""
    ok = F.coalesce(F.col("relation").isin(list(relation_types)), F.lit(False)) & F.col("source_type").isNotNull() & F.col("target_type").isNotNull()
    r = resolve_endpoints(relations, valid).agg(F.count_if(ok).alias("relations"), F.count_if(~ok).alias("skipped_relations"))
    return valid.agg(F.count(F.lit(1)).alias("entities")).crossJoin(F.broadcast(r))  # one row each


def graph_counts(node_table: DataFrame, edge_table: DataFrame, same_as: DataFrame) -> DataFrame:
    """(nodes, edges, same_as_links): one row."""
    one = [node_table.agg(F.count(F.lit(1)).alias("nodes")), edge_table.agg(F.count(F.lit(1)).alias("edges")), same_as.agg(F.count(F.lit(1)).alias("same_as_links"))]
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), one)  # one row each


def degrees(node_table: DataFrame, edge_table: DataFrame) -> DataFrame:
    """(name, type, degree): incident distinct edges; a self-loop counts once, nodes without edges have 0."""
    ends = edge_table.select(F.col("source").alias("name"), F.col("source_type").alias("type")).unionByName(
        edge_table.where("source <> target or source_type <> target_type").select(F.col("target").alias("name"), F.col("target_type").alias("type"))
    )
    counted = ends.groupBy("name", "type").agg(F.count(F.lit(1)).alias("degree"))
    return node_table.select("name", "type").join(counted, ["name", "type"], "left").fillna(0, ["degree"])


def decided_pairs(decisions: DataFrame) -> DataFrame:
    """Decisions as (a_name, a_type, b_name, b_type, ...) with the ends in order; pairs without two full entries are left out."""
    two = decisions.where((F.size("pair") == 2) & (F.size(F.get("pair", F.lit(0))) == 2) & (F.size(F.get("pair", F.lit(1))) == 2))
    s = F.array_sort("pair")
    at = lambda i, j: F.get(F.get(s, F.lit(i)), F.lit(j))
    return two.select(at(0, 0).alias("a_name"), at(0, 1).alias("a_type"), at(1, 0).alias("b_name"), at(1, 1).alias("b_type"), "same", "canonical", "decided_at", "decision_id")


def same_as_links(decisions: DataFrame, node_table: DataFrame) -> DataFrame:
    """(a_name, a_type, b_name, b_type, canonical): confirmed pairs whose two ends are nodes, once each; the last canonical holds."""
    last = F.max_by(F.struct("canonical"), F.struct(F.coalesce("decided_at", F.lit("0001-01-01").cast("timestamp")), "decision_id"))
    links = decided_pairs(decisions).where("same and not (a_name = b_name and a_type = b_type)").groupBy("a_name", "a_type", "b_name", "b_type").agg(last.alias("x"))
    ends = node_table.select("name", "type")
    for side in ("a", "b"):
        links = links.join(ends.toDF(f"{side}_name", f"{side}_type"), [f"{side}_name", f"{side}_type"], "left_semi")
    return links.select("a_name", "a_type", "b_name", "b_type", "x.canonical")
