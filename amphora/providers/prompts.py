"""Prompts as Column expressions; the wording is a parameter of each builder's default."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from amphora.schema import MAX_DESCRIPTIONS, NODE_TYPES, RELATION_TYPES, node_types_block, vocabulary_block

NL = "\n"


ENTITY_TASK = "List what the passage names, each with one type and a sentence that says what the passage tells about it."
RELATION_TASK = "Relate the listed entities where the passage says so. Use the relation types below and the names as listed, both ends from the list."


def entity_prompt(text: Column, head: str = f"{ENTITY_TASK}{NL}{node_types_block()}") -> Column:
    return F.concat(F.lit(f"{head}{NL}Passage:{NL}"), text)


def relation_prompt(text: Column, entities: Column, head: str | None = None) -> Column:
    """``entities`` is an array of (name, type, ...) structs; they are listed one a line."""
    listed = F.array_join(F.transform(entities, lambda e: F.concat(F.lit("- "), e["name"], F.lit(" — "), e["type"])), NL)
    return F.concat(F.lit(f"{head or RELATION_TASK + NL + vocabulary_block()}{NL}Entities:{NL}"), listed, F.lit(f"{NL}Passage:{NL}"), text)


def decision_prompt() -> Column:
    """Of (type, a_name, a_told, b_name, b_told): at most the first three descriptions a side."""

    def side(letter: str) -> list[Column]:
        told = F.array_join(F.transform(F.slice(f"{letter}_told", 1, MAX_DESCRIPTIONS), lambda x: F.concat(F.lit("- "), x)), NL)
        return [F.lit(f"{NL}{letter.upper()}: "), F.col(f"{letter}_name"), F.lit(NL), F.coalesce(told, F.lit(""))]

    return F.concat(F.lit("Are these the same "), F.col("type"), F.lit("?"), *side("a"), *side("b"))


def query_entities_prompt(question: Column) -> Column:
    return F.concat(F.lit(f"Name what the question asks about ({', '.join(NODE_TYPES).lower()}), each by its shortest name.{NL}Question: "), question)


def answer_prompt(question: Column, context: Column, graph_context: Column | None = None) -> Column:
    parts = [F.lit(f"Answer from the numbered context only, and cite [n].{NL}Context:{NL}"), context]
    if graph_context is not None:
        parts += [F.lit(f"{NL}{NL}From the graph:{NL}"), graph_context]
    return F.concat(*parts, F.lit(f"{NL}{NL}Question: "), question, F.lit(f"{NL}Answer:"))


# what the replies to each prompt hold
REPLIES = {
    "entities": "entities array<struct<name:string,type:string,description:string>>",
    "relations": "relations array<struct<source:string,relation:string,target:string,description:string>>",
    "same": "same boolean, canonical_name string",
    "query_entities": "entities array<string>",
}


def _object(**properties: dict) -> dict:
    return {"type": "object", "properties": properties, "required": list(properties), "additionalProperties": False}


def _texts(*names: str, **closed: list[str]) -> dict:
    """An object of text fields; ``closed`` fields take only the given values."""
    return _object(**{n: {"type": "string"} | ({"enum": closed[n]} if n in closed else {}) for n in names})


def reply_schema(task: str, names: list[str] | None = None) -> dict:
    """The JSON schema that a reply must keep to. The ends of relations are closed to ``names``, the entities of the passage."""
    string = {"type": "string"}
    if task == "entities":
        return _object(entities={"type": "array", "items": _texts("name", "type", "description", type=NODE_TYPES)})
    if task == "relations":
        return _object(relations={"type": "array", "items": _texts("source", "relation", "target", "description", source=names or [], target=names or [], relation=list(RELATION_TYPES))})
    if task == "same":
        return _object(same={"type": "boolean"}, canonical_name=string)
    if task == "query_entities":
        return _object(entities={"type": "array", "items": string})
    raise ValueError(f"no schema for {task}")


def keeps_to(value: object, schema: dict) -> bool:
    """Whether a decoded reply keeps to a schema of the kind above."""
    kind = schema["type"]
    if kind == "object":
        inner = schema["properties"]
        return isinstance(value, dict) and set(value) == set(schema["required"]) and all(keeps_to(value[k], v) for k, v in inner.items())
    if kind == "array":
        return isinstance(value, list) and all(keeps_to(v, schema["items"]) for v in value)
    return isinstance(value, bool if kind == "boolean" else str) and value in schema.get("enum", [value])


def parse_reply(reply: Column, task: str) -> Column:
    """The typed reply; null for one that isn't JSON."""
    return F.from_json(reply, REPLIES[task])
