"""Language models behind a small interface, called from Arrow batches; the default is rule-based and needs no network.

``HttpModel`` talks to a chat endpoint that takes JSON schemas, ``LocalModel`` to a local generator. A worker loads its model once. Jobs keep to a
rate: a cluster's rate is divided by the tasks that share it.
"""

from __future__ import annotations

import json
import os
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amphora.schema import ENTITY, RELATION, node_types_block, vocabulary_block

ATTEMPTS, REQUESTS_PER_MINUTE = 3, 450


class Model(Protocol):
    """``complete`` gives the reply to a prompt; ``task`` is entities, relations, same, query_entities or answer. A model with the attribute ``takes_schema``
    is given the JSON schema of the reply as well."""

    def complete(self, prompt: str, task: str, temperature: float) -> str: ...


class Unreachable(OSError):
    """A request failed for good."""


def post_json(url: str, body: dict, headers: dict[str, str] | None = None, timeout: float = 120.0, retries: int = 5, pause: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> object:
    """The open reply to a JSON request. Lost connections and the states 408, 409, 429 and 5xx are tried again with doubled pauses, other errors raised at once."""
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **(headers or {})})
    for n in range(retries + 1):
        try:
            return urllib.request.urlopen(request, timeout=timeout)
        except urllib.error.HTTPError as e:
            if n == retries or not (e.code in (408, 409, 429) or e.code >= 500):
                raise Unreachable(f"{e.code} from {url}") from e
        except OSError as e:
            if n == retries:
                raise Unreachable(f"{type(e).__name__} from {url}") from e
        sleep(min(pause * 2**n, 8.0))
    raise Unreachable(url)


class HttpModel:
    """A chat endpoint: ``url`` takes messages and a strict JSON schema. The key is read from the environment of the worker, so it isn't shipped with the plan."""

    takes_schema = True

    def __init__(self, url: str, model: str, key_variable: str = "LLM_API_KEY", timeout: float = 120.0, retries: int = 5) -> None:
        self.url, self.model, self.key_variable, self.timeout, self.retries = url, model, key_variable, timeout, retries

    def complete(self, prompt: str, task: str, temperature: float, schema: dict | None = None) -> str:
        body: dict = {"model": self.model, "messages": [{"role": "user", "content": prompt}], "temperature": temperature}
        if schema:
            body["response_format"] = {"type": "json_schema", "json_schema": {"name": task, "strict": True, "schema": schema}}
        key = os.environ.get(self.key_variable, "")
        with post_json(self.url, body, {"Authorization": f"Bearer {key}"} if key else {}, self.timeout, self.retries) as r:
            return json.load(r)["choices"][0]["message"]["content"]


class LocalModel:
    """A local generator: ``url`` takes a prompt and replies with JSON lines, which are joined as they come; ``on_piece`` sees each."""

    def __init__(self, url: str, model: str, timeout: float = 900.0, stream: bool = False, on_piece: Callable[[str], None] | None = None) -> None:
        self.url, self.model, self.timeout, self.stream, self.on_piece = url, model, timeout, stream, on_piece

    def complete(self, prompt: str, task: str, temperature: float) -> str:
        body = {"model": self.model, "prompt": prompt, "stream": self.stream, "options": {"temperature": temperature}}
        with post_json(self.url, body, timeout=self.timeout, retries=0) as r:
            return join_stream((line.decode() for line in r), self.on_piece)


class Throttle:
    """Spaces calls evenly. A worker gets its share of the rate, so the cluster as a whole keeps to it."""

    def __init__(self, per_minute: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.gap, self.clock, self.sleep, self.next = 60.0 / per_minute, clock, sleep, 0.0

    def wait(self) -> None:
        now = self.clock()
        if self.next > now:
            self.sleep(self.next - now)
        self.next = max(now, self.next) + self.gap


def ask_json(model: Model, prompt: str, task: str, attempts: int = ATTEMPTS, throttle: Throttle | None = None, names: list[str] | None = None) -> dict:
    """The reply as JSON. Only replies that aren't JSON are asked for again, more freely; other errors are raised at once.

    A model that takes schemas is held to the one of the task; ``names`` closes the ends of relations.
    """
    from amphora.providers.prompts import reply_schema

    extra = {"schema": reply_schema(task, names)} if getattr(model, "takes_schema", False) else {}
    for n in range(attempts):
        if throttle:
            throttle.wait()
        try:
            return json.loads(model.complete(prompt, task, 0.0 if n == 0 else 0.4, **extra))
        except json.JSONDecodeError:
            if n == attempts - 1:
                raise
    raise ValueError("no attempts")


class RuleModel:
    """Deterministic stand-in: capitalised phrases are entities, typed by their words; names alike but for looks are the same."""

    cues = (("Law", ("lex",)), ("Event", ("siege", "battle", "revolt", "fire", "treaty", "synod", "muster", "games")), ("Organization", ("guild", "college", "company", "order", "council", "legion", "board", "assembly", "brotherhood")))

    def _entities(self, passage: str) -> list[dict]:
        found = dict.fromkeys(re.findall(r"\b[A-Z][\w-]+(?: (?:of |and )?[A-Z][\w-]+)+", passage))
        out = []
        for name in found:
            first = name.split()[0].lower()
            kind = next((k for k, words in self.cues if first in words), "Person")
            out.append({"name": name, "type": kind, "description": f"{name} is named in the passage."})
        return out

    def complete(self, prompt: str, task: str, temperature: float) -> str:
        passage = prompt.split("Passage:\n", 1)[-1]
        if task == "entities":
            return json.dumps({"entities": self._entities(passage)})
        if task == "relations":
            known = re.findall(r"^- (.+) — (\w+)$", prompt, re.M)
            people, events = [n for n, t in known if t in ("Person", "Organization")], [n for n, t in known if t == "Event"]
            return json.dumps({"relations": [{"source": p, "relation": "PARTICIPATED_IN", "target": e, "description": f"{p} and {e} share a passage."} for p in people[:1] for e in events]})
        if task == "same":
            names = re.findall(r"^[AB]: (.+)$", prompt, re.M)
            keys = [sorted(re.findall(r"\w+", n.lower())) for n in names]
            same = len(keys) == 2 and keys[0] == keys[1]
            return json.dumps({"same": same, "canonical_name": max(names, key=len) if same else ""})
        if task == "query_entities":
            return json.dumps({"entities": [e["name"] for e in self._entities(prompt.split("Question: ", 1)[-1])]})
        return f"See [1]. {passage[:80]}"


class Hopeless(RuntimeError):
    """Many failures and not one success: the endpoint is down."""


class Watch:
    """Counts a task's successes and failures. After ``limit`` failures without a success the rest of the task isn't asked any more."""

    def __init__(self, limit: int | None) -> None:
        self.limit, self.good, self.bad = limit, 0, 0

    def down(self) -> bool:
        return self.limit is not None and self.good == 0 and self.bad >= self.limit

    def seen(self, failure: str | None) -> None:
        self.good, self.bad = self.good + (failure is None), self.bad + (failure is not None)


SKIPPED = "skipped: the endpoint is down"


def _failure(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"[:500]


def extract_one(model: Model, chunk_id: str, title: str | None, text: str, throttle: Throttle | None = None) -> dict:
    """The record of one chunk: entities first, then relations among their distinct names in the order of mention."""
    from amphora.providers.prompts import ENTITY_TASK, RELATION_TASK

    keep = lambda x, keys: {k: None if x.get(k) is None else str(x[k]) for k in keys}
    asked = ask_json(model, f"{ENTITY_TASK}\n{node_types_block()}\nPassage:\n{text}", "entities", throttle=throttle)
    entities = [keep(e, ("name", "type", "description")) for e in asked["entities"]]
    for e in entities:
        e["name"] = (e["name"] or "").replace('"', "").strip()
    types: dict[str, str | None] = {}
    for e in entities:
        if e["name"]:
            types.setdefault(e["name"], e["type"])
    relations = []
    if types:  # without names there is nothing to relate
        listed = "\n".join(f"- {name} — {type_}" for name, type_ in types.items())
        found = ask_json(model, f"{RELATION_TASK}\n{vocabulary_block()}\nEntities:\n{listed}\nPassage:\n{text}", "relations", throttle=throttle, names=list(types))
        relations = [keep(r, ("source", "relation", "target", "description")) for r in found["relations"]]
    return {"chunk_id": chunk_id, "title": title, "entities": entities, "relations": relations, "failure": None}


def _extract(load: Callable[[], Model], per_minute: float | None, limit: int | None):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, watch = load(), Watch(limit)
        throttle = Throttle(per_minute) if per_minute else None
        for frame in frames:
            out = []
            for chunk_id, title, text in zip(frame["chunk_id"], frame["title"], frame["text"], strict=True):
                none = {"chunk_id": chunk_id, "title": title, "entities": [], "relations": []}
                if watch.down():
                    out.append(none | {"failure": SKIPPED})
                    continue
                try:
                    row = extract_one(model, chunk_id, title, text, throttle)
                except Exception as e:  # a failed chunk is a row, so that the rest of the batch is kept
                    row = none | {"failure": _failure(e)}
                watch.seen(row["failure"])
                out.append(row)
            yield pd.DataFrame(out, columns=["chunk_id", "title", "entities", "relations", "failure"])

    return run


def _share(rows: DataFrame, per_minute: float | None, tasks: int | None) -> tuple[DataFrame, float | None]:
    """The rows in ``tasks`` tasks, and the part of the rate each of them has; as many tasks as there are without a number."""
    if tasks:
        rows = rows.coalesce(tasks)
    if not per_minute:
        return rows, None
    n = tasks or rows.rdd.getNumPartitions()
    return rows, per_minute / max(n, 1)


def extract(chunks: DataFrame, load: Callable[[], Model] = RuleModel, per_minute: float | None = None, tasks: int | None = None, limit: int | None = None) -> DataFrame:
    """(chunk_id, title, entities, relations, failure): two passes a chunk, one model a worker. ``tasks`` share the rate ``per_minute``; a task that failed
    ``limit`` times without a success asks no more."""
    rows, share = _share(chunks.select("chunk_id", "title", "text").where("text is not null"), per_minute, tasks)
    return rows.mapInPandas(_extract(load, share, limit), f"chunk_id string, title string, entities array<{ENTITY}>, relations array<{RELATION}>, failure string")


def _ask(load: Callable[[], Model], task: str, columns: list[str], read: Callable[[dict], dict], fields: list[str], per_minute: float | None = None, limit: int | None = None):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, watch = load(), Watch(limit)
        throttle = Throttle(per_minute) if per_minute else None
        for frame in frames:
            replies = []
            for prompt in frame["prompt"]:
                if watch.down():
                    replies.append(dict.fromkeys(fields) | {"failure": SKIPPED})
                    continue
                try:
                    replies.append(read(ask_json(model, prompt, task, throttle=throttle)) | {"failure": None})
                except Exception as e:
                    replies.append(dict.fromkeys(fields) | {"failure": _failure(e)})
                watch.seen(replies[-1]["failure"])
            new = pd.DataFrame(replies, columns=[*fields, "failure"], index=frame.index)
            yield pd.concat([frame[columns], new], axis=1)

    return run


def decide_same(pairs: DataFrame, load: Callable[[], Model] = RuleModel, per_minute: float | None = None, tasks: int | None = None, limit: int | None = None) -> DataFrame:
    """Decisions (type, a_name, b_name, same, canonical, failure) for prompted pairs; rate and limit as in ``extract``."""
    read = lambda r: {"same": bool(r["same"]), "canonical": str(r.get("canonical_name") or "")}
    columns = ["type", "a_name", "b_name"]
    rows, share = _share(pairs.select(*columns, "prompt"), per_minute, tasks)
    return rows.mapInPandas(_ask(load, "same", columns, read, ["same", "canonical"], share, limit), "type string, a_name string, b_name string, same boolean, canonical string, failure string")


def query_entities(questions: DataFrame, load: Callable[[], Model] = RuleModel) -> DataFrame:
    """(query_id, span) of (query_id, query): what a question names."""
    from amphora.providers.prompts import query_entities_prompt

    asked = questions.select(F.col("query_id").cast("bigint").alias("query_id"), query_entities_prompt(F.col("query")).alias("prompt"))
    read = lambda r: {"spans": [str(x) for x in r["entities"]]}
    out = asked.mapInPandas(_ask(load, "query_entities", ["query_id"], read, ["spans"]), "query_id bigint, spans array<string>, failure string")
    return out.select("query_id", F.explode("spans").alias("span"))


def answer(prompts: DataFrame, load: Callable[[], Model] = RuleModel) -> DataFrame:
    """(query_id, answer) of (query_id, prompt)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in frames:
            yield pd.DataFrame({"query_id": frame["query_id"], "answer": [model.complete(p, "answer", 0.0) for p in frame["prompt"]]})

    return prompts.select(F.col("query_id").cast("bigint").alias("query_id"), "prompt").mapInPandas(run, "query_id bigint, answer string")


def join_stream(lines: Iterator[str], on_piece: Callable[[str], None] | None = None) -> str:
    """The text of a reply streamed as JSON lines: blank lines are skipped, a line with ``done`` ends it; ``on_piece`` sees the pieces as they come."""
    parts = []
    for line in lines:
        if not line.strip():
            continue
        piece = json.loads(line)
        parts.append(piece.get("response", ""))
        if on_piece and parts[-1]:
            on_piece(parts[-1])
        if piece.get("done"):
            break
    return "".join(parts)
