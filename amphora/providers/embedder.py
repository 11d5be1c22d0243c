"""Embedders: text columns to vector columns. The default needs no model and is the same on every machine."""

import hashlib
import re
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf


class Embedder(Protocol):
    """``mode`` is query, passage or plain: models may treat a question and a passage differently."""

    dim: int

    def column(self, text: Column, mode: str = "plain") -> Column: ...


class HashingEmbedder:
    """Signed feature hashing of lower-cased words: the first byte of a word's MD5 gives its place, the next half byte its sign."""

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim

    def column(self, text: Column, mode: str = "plain") -> Column:
        dim = self.dim

        @pandas_udf("array<double>")
        def embed(texts: pd.Series) -> pd.Series:
            known: dict[str, tuple[int, float]] = {}
            out = []
            for t in texts:
                v = [0.0] * dim
                for w in re.findall(r"\w+", t.lower()) if t else ():
                    at = known.get(w)
                    if at is None:
                        h = hashlib.md5(w.encode("utf-8", "surrogatepass"), usedforsecurity=False).hexdigest()
                        at = known[w] = (int(h[:2], 16) % dim, 1.0 if int(h[2], 16) < 8 else -1.0)
                    v[at[0]] += at[1]
                out.append(v)
            return pd.Series(out)

        return embed(text)


class FunctionEmbedder:
    """Wraps a model loader: ``load()`` runs once a Python worker and returns a function from (texts, mode) to vectors."""

    def __init__(self, load, dim: int) -> None:
        self.load, self.dim = load, dim

    def column(self, text: Column, mode: str = "plain") -> Column:
        load = self.load

        @pandas_udf("array<double>")
        def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for texts in batches:
                yield pd.Series([[float(x) for x in v] for v in model(texts.fillna("").tolist(), mode)])

        return embed(text)
