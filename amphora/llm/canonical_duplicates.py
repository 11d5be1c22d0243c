"""Duplicates hidden by formatting: recursive radix partitioning of canonical bytes, per-bucket tries.

Method. Distinct (type, name) rows carry canonical bytes: the lower-cased words in sorted order, then the type. Buckets
are byte prefixes; a prefix that holds more than ``bucket_rows`` rows is split by further bytes until every bucket
fits. Each bucket is counted in a trie whose terminal counters hold the number of stored names, their copies and
the smallest name.

Scale. Copies collapse before the first shuffle. A bucket holds at most ``bucket_rows`` rows however large the table is. The oversized
prefixes of a depth are a table (at most rows/bucket_rows of them), joined to the rows that are still open; nothing but the number of
open rows reaches the driver, and only rows of oversized prefixes go on to the next depth. Bytes can't split a bucket
whose rows are all one key; such a bucket is split by a salt of the stored name, as many ways as its rows need, its tries are merged by
key, and the members find their record through the same salted cells, so a key holding a third of all rows is never
in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amphora.session import blank, materialize

_BURST = 32
_OUT = "cell string, key string, kept string, names bigint, copies bigint"
_DEPTHS = (1, 2, 4, 6, 8, 12, 16, 24, 32, 64, 128)  # bytes of a prefix; the last resort is the whole key


class Trie:
    """A burst trie over bytes: leaves are small containers of suffixes, which burst into 256-way nodes.

    Every terminal holds the counters [stored names, copies, smallest name].
    """

    def __init__(self) -> None:
        self.root: list = [None, {}]  # terminal counters, {suffix: counters} until it bursts into {byte: node}
        self.burst: set[int] = set()

    @staticmethod
    def _count(at: list | None, name: str, copies: int) -> list:
        if at is None:
            return [1, copies, name]
        at[0] += 1
        at[1] += copies
        if name < at[2]:
            at[2] = name
        return at

    def add(self, key: bytes, name: str, copies: int) -> None:
        node, i = self.root, 0
        while id(node) in self.burst:
            if i == len(key):
                node[0] = self._count(node[0], name, copies)
                return
            nxt = node[1].get(key[i])
            if nxt is None:
                nxt = node[1][key[i]] = [None, {}]
            node, i = nxt, i + 1
        rest = key[i:]
        if not rest:
            node[0] = self._count(node[0], name, copies)
            return
        node[1][rest] = self._count(node[1].get(rest), name, copies)
        if len(node[1]) > _BURST:
            self._split(node)

    def _split(self, node: list) -> None:
        children: dict[int, list] = {}
        for suffix, counters in node[1].items():
            child = children.setdefault(suffix[0], [None, {}])
            if len(suffix) == 1:
                child[0] = counters
            else:
                child[1][suffix[1:]] = counters
        node[1] = children
        self.burst.add(id(node))

    def terminals(self) -> Iterator[tuple[bytes, list]]:
        stack = [(b"", self.root)]
        while stack:
            prefix, node = stack.pop()
            if node[0] is not None:
                yield prefix, node[0]
            for k, x in node[1].items():
                if id(node) in self.burst:
                    stack.append((prefix + bytes([k]), x))
                else:
                    yield prefix + k, x


def _tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by cell; one trie at a time is in memory."""
    cell, trie = None, Trie()

    def flush() -> pa.RecordBatch:
        rows = [(cell, k.decode("utf-8", "surrogatepass"), c[2], c[0], c[1]) for k, c in trie.terminals()]
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)],
            names=["cell", "key", "kept", "names", "copies"],
        )

    for b in batches:
        for c, key, name, n in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            if c != cell:
                if cell is not None:
                    yield flush()
                cell, trie = c, Trie()
            trie.add(key.encode("utf-8", "surrogatepass"), name, n)
    if cell is not None:
        yield flush()


def canonical_words(name: F.Column) -> F.Column:
    """The lower-cased words (runs of letters and digits) in sorted order."""
    return F.array_join(F.array_sort(F.regexp_extract_all(F.lower(name), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))), " ")


def _prefix(depth: int) -> F.Column:
    return F.hex(F.substring(F.encode("key", "utf-8"), 1, depth))


def radix_cells(rows: DataFrame, bucket_rows: int) -> DataFrame:
    """Add ``cell``: the shortest prefix of ``key`` that fits, or the whole key and a salt where a single key doesn't."""
    if rows.count() <= bucket_rows:
        return rows.withColumn("cell", F.lit(""))
    columns, open_, ready = rows.columns, rows, None
    for depth in (*_DEPTHS, None):
        prefix = F.hex(F.encode("key", "utf-8")) if depth is None else _prefix(depth)
        here = open_.withColumn("p", prefix)
        over = here.groupBy("p").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket_rows)
        marked = materialize(here.join(over, "p", "left"), "radix")
        # a prefix shorter than its depth is a key that ended: its rows are all one key
        whole = F.lit(True) if depth is None else F.length("p") < 2 * depth
        salt = F.concat(F.lit("#"), F.pmod(F.xxhash64("name"), F.ceil(F.col("n") / F.lit(bucket_rows))).cast("string"))
        done = marked.where(F.col("n").isNull() | whole).withColumn("cell", F.when(F.col("n").isNull(), F.col("p")).otherwise(F.concat("p", salt)))
        done = done.select(*columns, "cell")
        ready = done if ready is None else ready.unionByName(done)
        open_ = marked.where(F.col("n").isNotNull() & ~whole).select(*columns)
        if open_.isEmpty():
            break
    return ready


def collapse_formatting(extractions: DataFrame, bucket_rows: int = 20_000) -> DataFrame:
    """(type, name, kept_name, names, copies): every stored name with the record it collapses into.

    Names of one type are one record if their lower-cased words agree, each as often, in any order; ``kept_name`` is
    the smallest stored name, ``names`` how many stored names the record has, ``copies`` how many rows.
    Blank names are left out; a null type is a type of its own; names without any word are one record.
    """
    members = (
        extractions.where(~blank(F.col("name"))).groupBy("type", "name").agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("key", F.concat(canonical_words(F.col("name")), F.lit("\x01"), F.coalesce(F.col("type"), F.lit("\x02"))))
    )
    members = materialize(radix_cells(materialize(members, "names"), bucket_rows), "cells")
    parts = (
        members.select("cell", "key", "name", "copies").repartition("cell").sortWithinPartitions("cell")
        .mapInArrow(_tries, _OUT)
    )
    # a key in several salted cells: a row per cell, so at most ``salts`` rows
    records = parts.groupBy("key").agg(F.min("kept").alias("kept_name"), F.sum("names").alias("names"), F.sum("copies").alias("all_copies"), F.collect_list("cell").alias("cells"))
    by_cell = records.select("key", "kept_name", "names", "all_copies", F.explode("cells").alias("cell"))
    return members.join(by_cell, ["cell", "key"]).select("type", "name", "kept_name", "names", F.col("all_copies").alias("copies"))
