"""Record types, the closed vocabulary and the default parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ARTICLE = "pageid bigint, title string, url string, categories array<string>, text string"
CHUNK = "chunk_id string, pageid bigint, title string, url string, chunk_index int, text string"
ENTITY = "struct<name:string,type:string,description:string>"
RELATION = "struct<source:string,relation:string,target:string,description:string>"
EXTRACTION = f"chunk_id string, title string, entities array<{ENTITY}>, relations array<{RELATION}>"
DECISION = "pair array<array<string>>, same boolean, canonical string"

# fixed values: node types, and relation types with the types they lead from and to
NODE_TYPES = ["Person", "Place", "Organization", "Event", "Law", "Concept"]
RELATION_TYPES = {
    "RULED": (["Person", "Organization"], ["Place", "Organization"]),
    "MEMBER_OF": (["Person"], ["Organization"]),
    "PART_OF": (["Organization", "Place"], ["Organization", "Place"]),
    "LOCATED_IN": (["Place", "Event", "Organization"], ["Place"]),
    "ISSUED": (["Person"], ["Law"]),
    "GRANTED": (["Law", "Person"], ["Concept"]),
    "FOUNDED": (["Person"], ["Place", "Organization"]),
    "PARTICIPATED_IN": (["Person", "Organization"], ["Event"]),
    "SUCCEEDED": (["Person"], ["Person"]),
    "INFLUENCED": (NODE_TYPES, NODE_TYPES),
}

# what the types mean; the wording is this engine's own and a parameter of the prompts
NODE_MEANINGS = {
    "Person": "one named human being, whatever the office or trade", "Place": "somewhere on a map: a town, a province, a river, a region", "Organization": "a body people belong to: an assembly, a troop, a guild, a rank of society",
    "Event": "something that happened at a time: a war, a battle, a disaster, a reign", "Law": "one particular statute, decree or code", "Concept": "an idea, a right, a custom or an institution in general",
}
RELATION_MEANINGS = {
    "RULED": "the source had power over the target", "MEMBER_OF": "the source belonged to the target", "PART_OF": "the source is a part of the target", "LOCATED_IN": "the source lies or took place in the target",
    "ISSUED": "the source made the target law", "GRANTED": "the source gave the target as a right or a standing", "FOUNDED": "the source brought the target into being", "PARTICIPATED_IN": "the source took part in the target",
    "SUCCEEDED": "the source came after the target in the same place", "INFLUENCED": "the source changed or shaped the target",
}

CHUNK_SIZE, CHUNK_OVERLAP = 1600, 240
SEPARATORS = ("\n\n", ". ", " ", "")
RRF_K, HYBRID_K, HYBRID_POOL, KEYWORD_K = 60, 5, 30, 5
HOPS, EDGE_CAP, TOP_PASSAGES = 2, 10, 6
THETA, MAX_BLOCK, HUB_DEGREE, MAX_DESCRIPTIONS = 0.90, 5, 2, 3
NORM_EPSILON = 1e-9


def allowed_triples(relation_types: dict = RELATION_TYPES) -> list[tuple[str, str, str]]:
    """(relation, source type, target type): what the vocabulary allows."""
    return [(r, s, t) for r, (sources, targets) in relation_types.items() for s in sources for t in targets]


def vocabulary(spark: SparkSession, relation_types: dict = RELATION_TYPES) -> DataFrame:
    """The allowed triples as a table; the size is that of the vocabulary (56 rows by default), so it may be broadcast."""
    return spark.createDataFrame(allowed_triples(relation_types), "relation string, source_type string, target_type string")


def endpoints_label(types: list[str]) -> str:
    return "any" if set(types) == set(NODE_TYPES) else " | ".join(types)


def node_types_block(meanings: dict = NODE_MEANINGS) -> str:
    """The node types as text for prompts, each with its meaning."""
    return "\n".join(["Node types:", *(f"- {t}: {meanings[t]}" for t in NODE_TYPES)])


def vocabulary_block(relation_types: dict = RELATION_TYPES, meanings: dict = RELATION_MEANINGS) -> str:
    """The vocabulary as text for prompts: types and relations with their meanings, relations with the types they lead from and to."""
    edges = ["Relation types:", *(f"- {r} ({endpoints_label(s)} -> {endpoints_label(t)}): {meanings.get(r, '')}".rstrip(": ") for r, (s, t) in relation_types.items())]
    return "\n".join([node_types_block(), "", *edges])
