"""Articles to overlapping chunks: paragraphs are packed greedily, long ones split at sentences, words, characters."""

from __future__ import annotations

import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from amphora.schema import CHUNK_OVERLAP, CHUNK_SIZE, SEPARATORS
from amphora.session import spread


def _runs(text: str, a: int, b: int, mark: str, size: int) -> list[tuple[int, int]]:
    """Spans of text[a:b] that end at a mark or at b: each as long as ``size`` allows, or a single part that is longer."""
    marks = [a + m.start() for m in re.finditer(re.escape(mark), text[a:b])]
    begins, ends = [a, *(m + len(mark) for m in marks)], [*marks, b]
    spans, i = [], 0
    while i < len(begins):
        last = max(bisect_right(ends, begins[i] + size) - 1, i)  # the furthest part that ends within reach
        if ends[i] > begins[i]:
            spans.append((begins[i], ends[last]))
            i = last + 1
        else:  # an empty part begins no span
            i += 1
    return spans


def split_units(text: str, size: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Paragraphs of at most ``size`` characters; longer ones are cut at the finest separator needed.

    A separator between two units is lost; one inside a unit stays. Cuts are positions: the ends of the parts are
    searched for the last one within reach, and a span still too long goes on to the next separator.
    """
    units: list[str] = []
    for paragraph in text.split(separators[0]):
        body = paragraph.strip()
        open_ = [(0, len(body), 1)] if body else []
        while open_:
            a, b, level = open_.pop()
            if b - a <= size:
                units.append(body[a:b])
            elif not separators[level]:
                units.extend(body[i : min(i + size, b)] for i in range(a, b, size))
            else:
                open_.extend((x, y, level + 1) for x, y in reversed(_runs(body, a, b, separators[level], size)))
    return units


def pack_units(units: list[str], size: int) -> list[str]:
    """Neighbouring units joined by blank lines as long as they fit."""
    bodies: list[list[str]] = []
    room = -1
    for u in units:
        if bodies and len(u) + 2 <= room:
            bodies[-1].append(u)
            room -= len(u) + 2
        else:
            bodies.append([u])
            room = size - len(u)
    return ["\n\n".join(b) for b in bodies]


def tail_of(body: str, overlap: int) -> str:
    """What the next chunk repeats of a body."""
    if overlap <= 0:
        return ""
    if len(body) <= overlap:
        return body
    tail = body[-overlap:]
    return tail[tail.find(" ") + 1 :]


def chunk_text(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> list[str]:
    """Chunks of at most size + overlap + 2 characters; an overlap of 0 repeats nothing."""
    bodies = pack_units(split_units(text, size), size)
    before = ["", *(tail_of(b, overlap) for b in bodies[:-1])]
    return [f"{t}\n\n{b}" if t else b for t, b in zip(before, bodies, strict=True)] if bodies else []


def chunk_column(size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP):
    """The chunker as an Arrow-batched function of a text column."""

    @pandas_udf("array<string>")
    def chunks(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: chunk_text(t, size, overlap) if t is not None else [])

    return chunks


def chunk_documents(articles: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """(chunk_id, pageid, title, url, chunk_index, text); null and blank texts give no chunk."""
    split = spread(articles.select("pageid", "title", "url", "text")).withColumn("parts", chunk_column(size, overlap)("text"))
    rows = split.select("pageid", "title", "url", F.posexplode("parts").alias("chunk_index", "text"))
    return rows.select(F.concat_ws(":", "pageid", "chunk_index").alias("chunk_id"), "pageid", "title", "url", "chunk_index", "text")
