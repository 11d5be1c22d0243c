"""Frequency of every distinct term: sorted runs of (term, record) pairs, merged by a range-partitioned sort.

Method. Every task sorts its (term, record) pairs and scans the runs: a run of equal terms gives the occurrences,
the changes of record inside it the distinct records. The sorted runs are written once to the shared folder, then
range-partitioned by term and sorted externally by Spark, and a second run-length scan over each sorted partition adds up the runs of
equal terms. Words of texts and whole values go the same way.

Scale. A term that is in every record reaches the second sort once per run, not once per occurrence, so a hot term
is a handful of rows. A record is in one task when the runs are built (a text), or a pair of value and record is (a value), so
distinct records add up without any set being held. Nothing is collected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amphora.session import blank, materialize

WORD = re.compile(r"\w+")
_RUNS = "field string, term string, occurrences bigint, records bigint"


def _scan(terms: pa.Array, record: np.ndarray, weight: np.ndarray, field: str) -> pa.RecordBatch:
    """Sort pairs by (term, record) and run-length scan them into one row per term."""
    enc = pc.dictionary_encode(terms)
    codes = np.asarray(enc.indices).astype(np.int64)
    words = enc.dictionary
    if len(words) == 0:
        return pa.RecordBatch.from_pydict(
            {"field": pa.array([], pa.string()), "term": pa.array([], pa.string()), "occurrences": pa.array([], pa.int64()), "records": pa.array([], pa.int64())}
        )
    order = np.argsort(codes * (int(record.max(initial=0)) + 2) + record + 1, kind="stable")  # records are -1 and up
    c, r, w = codes[order], record[order], weight[order]
    new_term = np.r_[True, c[1:] != c[:-1]]
    new_pair = new_term | np.r_[True, r[1:] != r[:-1]]
    starts = np.flatnonzero(new_term)
    occ = np.add.reduceat(w, starts)
    rec = np.add.reduceat((new_pair & (r >= 0)).astype(np.int64), starts)
    return pa.RecordBatch.from_pydict(
        {
            "field": pa.array([field] * len(starts), pa.string()),
            "term": words.take(pa.array(c[starts])),
            "occurrences": pa.array(occ, pa.int64()),
            "records": pa.array(rec, pa.int64()),
        }
    )


def _text_runs(field: str, run_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms: list[str] = []
        lengths: list[int] = []

        def flush() -> pa.RecordBatch:
            rec = np.repeat(np.arange(len(lengths), dtype=np.int64), lengths)
            return _scan(pa.array(terms, pa.string()), rec, np.ones(len(terms), np.int64), field)

        for b in batches:
            for text in b.column(0).to_pylist():
                found = WORD.findall(text.lower())
                terms += found
                lengths.append(len(found))
                if len(terms) >= run_tokens:
                    yield flush()
                    terms, lengths = [], []
        if terms:
            yield flush()

    return run


def text_runs(df: DataFrame, record: str, text: str, field: str = "text", run_tokens: int = 2_000_000) -> DataFrame:
    """Sorted runs of the terms of a text column; a record id counts once, null texts and null ids not at all."""
    once = df.where(F.col(text).isNotNull() & F.col(record).isNotNull()).groupBy(F.col(record).alias("r")).agg(F.min(text).alias("t"))
    return once.select("t").mapInArrow(_text_runs(field, run_tokens), _RUNS)


def _value_runs(field: str, run_pairs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            terms = pa.chunked_array([b.column(0) for b in held]).combine_chunks()
            records = pc.dictionary_encode(pa.chunked_array([b.column(1) for b in held]).combine_chunks())
            at = np.asarray(records.indices.fill_null(-1)).astype(np.int64)  # a null record is an occurrence in none
            return _scan(terms, at, np.concatenate([b.column(2).to_numpy() for b in held]), field)

        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= run_pairs:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    return run


def value_runs(df: DataFrame, record: str, value: str, field: str = "name", run_pairs: int = 2_000_000) -> DataFrame:
    """Sorted runs of whole values: every non-blank row is an occurrence, records are distinct non-null record ids.

    Pairs are pre-aggregated and hashed on (value, record), so a value or a record holding a third of all rows
    is spread over all tasks; each task sorts its pairs and scans their runs.
    """
    pairs = df.where(~blank(F.col(value))).groupBy(F.col(value).alias("term"), F.col(record).cast("string").alias("r")).agg(F.count(F.lit(1)).alias("n"))
    return pairs.select("term", "r", "n").mapInArrow(_value_runs(field, run_pairs), _RUNS)


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run-length scan of rows sorted by (field, term): equal neighbours become one row, also across batches."""
    last: tuple | None = None
    for b in batches:
        if not b.num_rows:
            continue
        field, term = (pc.dictionary_encode(b.column(c)) for c in (0, 1))
        f, t = np.asarray(field.indices), np.asarray(term.indices)
        starts = np.flatnonzero(np.r_[True, (f[1:] != f[:-1]) | (t[1:] != t[:-1])])
        at = pa.array(starts)
        sums = [np.add.reduceat(b.column(c).to_numpy(), starts) for c in (2, 3)]
        fields, terms = b.column(0).take(at), b.column(1).take(at)
        head = (fields[0].as_py(), terms[0].as_py())
        if last is not None and last[:2] == head:
            sums[0][0] += last[2]
            sums[1][0] += last[3]
        elif last is not None:
            yield _rows_of([last])
        yield pa.RecordBatch.from_arrays([fields[:-1], terms[:-1], pa.array(sums[0][:-1]), pa.array(sums[1][:-1])], names=["field", "term", "occurrences", "records"])
        last = (fields[-1].as_py(), terms[-1].as_py(), int(sums[0][-1]), int(sums[1][-1]))
    if last is not None:
        yield _rows_of([last])


def _rows_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["field", "term", "occurrences", "records"])


def merge_runs(runs: DataFrame) -> DataFrame:
    """Range partition and sort the runs by term, then scan each partition: a range holds all rows of its terms."""
    ordered = runs.repartitionByRange("field", "term").sortWithinPartitions("field", "term")
    return ordered.select("field", "term", "occurrences", "records").mapInArrow(_add_up, _RUNS)


def term_frequencies(chunks: DataFrame, extractions: DataFrame) -> DataFrame:
    """(field, term, occurrences, records, total): every distinct term of chunks.text and value of extractions.name.

    ``total`` is the number of records of the field. Null or blank values, null record ids and empty tables
    contribute nothing; extra columns are ignored.
    """
    names = value_runs(extractions, "chunk_id", "name")
    runs = materialize(text_runs(chunks, "chunk_id", "text").unionByName(names), "runs")
    n_text = chunks.where(F.col("text").isNotNull()).agg(F.countDistinct("chunk_id").alias("total")).select(F.lit("text").alias("field"), "total")
    n_name = extractions.where(~blank(F.col("name"))).agg(F.countDistinct("chunk_id").alias("total")).select(F.lit("name").alias("field"), "total")
    return merge_runs(runs).join(F.broadcast(n_text.unionByName(n_name)), "field")  # two rows


def marked(freq: DataFrame, rare_below: int = 3, common_above: float = 0.1) -> DataFrame:
    """Terms too rare (fewer than ``rare_below`` occurrences) or too common (in more than a share of records)."""
    mark = F.when(F.col("occurrences") < rare_below, "rare").when(F.col("records") > F.col("total") * F.lit(common_above), "common")
    return freq.withColumn("mark", mark).where("mark is not null")
