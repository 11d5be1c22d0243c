"""Resumable jobs: each run takes what isn't done yet, appends what succeeds and leaves failures for the next run.

Work goes in parts of ``part`` rows, and each part's successes are appended before the next part is asked, so a crash loses at most the replies of the
part under way. Every task keeps to its share of the rate, and stops asking when nothing works; a part without any success and with many failures ends the run.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amphora.operators.resolve import resume_pending
from amphora.providers.model import REQUESTS_PER_MINUTE, Hopeless, Model, RuleModel, decide_same, extract
from amphora.session import forget, materialize
from amphora.sources import files
from amphora.streaming import graph_tables

FAILURES_TO_STOP = 20
NothingWorks = Hopeless


@dataclass
class Counters:
    """What a run did: rows asked for, successes and failures, and what the successes hold."""

    pending: int = 0
    successes: int = 0
    failures: int = 0
    entities: int = 0
    relations: int = 0
    confirmed: int = 0

    def add(self, row) -> None:
        for f in fields(self):
            if f.name in row:
                setattr(self, f.name, getattr(self, f.name) + (row[f.name] or 0))


def _in_parts(pending: DataFrame, key: list[str], part: int, ask: Callable[[DataFrame], DataFrame], counts: list, append: Callable[[DataFrame], None], limit: int, progress: Callable[[Counters], None] | None) -> Counters:
    """Ask part by part; append each part's successes at once, count, and stop if nothing works."""
    pending = materialize(pending, "pending")
    done = Counters(pending=pending.count())
    parts = max(1, -(-done.pending // part))
    ok = F.col("failure").isNull()
    for n in range(parts if done.pending else 0):
        made = materialize(ask(pending.where(F.pmod(F.xxhash64(*key), F.lit(parts)) == n)), "replies")
        row = made.agg(F.count_if(ok).alias("successes"), F.count_if(~ok).alias("failures"), *counts).first().asDict()
        if row["successes"]:
            append(made.where(ok))
        forget(made)
        done.add(row)
        if progress:
            progress(done)
        if done.successes == 0 and done.failures >= limit:
            forget(pending)
            raise Hopeless(f"{done.failures} failures and no success")
    forget(pending)
    return done


def run_batch(
    chunks: DataFrame, out: str, load: Callable[[], Model] = RuleModel, limit: int = FAILURES_TO_STOP, per_minute: float | None = REQUESTS_PER_MINUTE, tasks: int | None = None, part: int = 500,
    progress: Callable[[Counters], None] | None = None,
) -> Counters:
    """Extract the chunks not yet in ``out``. The rate counts for models that go over a network; ``RuleModel`` needs none."""
    pending = resume_pending(chunks.select("chunk_id", "title", "text").where("text is not null"), files.done_ids(chunks.sparkSession, out))
    rate = None if load is RuleModel else per_minute
    sums = [F.sum(F.when(F.col("failure").isNull(), F.size(c))).alias(c) for c in ("entities", "relations")]
    return _in_parts(pending, ["chunk_id"], part, lambda df: extract(df, load, rate, tasks, limit), sums, lambda df: files.append(df.drop("failure"), out), limit, progress)


def stream_extraction(spark: SparkSession, chunk_dir: str, schema: str, out: str, checkpoint: str, load: Callable[[], Model] = RuleModel, limit: int = FAILURES_TO_STOP) -> None:
    """New chunk files since the last call, as a stream that ends when all are taken. A restarted batch skips what it had appended."""
    stream = spark.readStream.schema(schema).json(chunk_dir)
    query = stream.writeStream.foreachBatch(lambda batch, _: run_batch(batch, out, load, limit) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def run_decisions(
    prompted: DataFrame, out: str, load: Callable[[], Model] = RuleModel, limit: int = FAILURES_TO_STOP, per_minute: float | None = REQUESTS_PER_MINUTE, tasks: int | None = None, part: int = 500,
    progress: Callable[[Counters], None] | None = None, graph: str | None = None,
) -> Counters:
    """Decide prompted pairs (type, a_name, b_name, prompt) that ``out`` doesn't hold, and append (pair, same, canonical).

    With ``graph``, the path of a stored graph, all confirmed decisions of ``out`` are linked there afterwards, those of earlier runs as well.
    """
    spark = prompted.sparkSession
    done = files.decisions(spark, out).select(F.array_sort("pair").alias("pair"))
    pair = F.array_sort(F.array(F.array("a_name", "type"), F.array("b_name", "type")))
    pending = prompted.withColumn("pair", pair).join(done, "pair", "left_anti").drop("pair")
    rate = None if load is RuleModel else per_minute
    append = lambda df: files.append(df.select(pair.alias("pair"), "same", "canonical"), out)
    found = _in_parts(pending, ["type", "a_name", "b_name"], part, lambda df: decide_same(df, load, rate, tasks, limit), [F.count_if("same").alias("confirmed")], append, limit, progress)
    if graph:
        relink(spark, out, graph)
    return found


def relink(spark: SparkSession, out: str, graph: str) -> None:
    """Link every confirmed decision of ``out`` in the stored graph; linking again changes nothing."""
    same = files.decisions(spark, out).where("same").select(F.array_sort("pair").alias("p"), "canonical").where(F.size("p") == 2)
    at = lambda i, j: F.get(F.get("p", F.lit(i)), F.lit(j))
    graph_tables.link_same_as(same.select(at(0, 0).alias("a_name"), at(0, 1).alias("a_type"), at(1, 0).alias("b_name"), at(1, 1).alias("b_type"), "canonical"), graph)


def progress_of(spark: SparkSession, out: str, total: int | None = None, chunks: DataFrame | None = None) -> tuple[int, int]:
    """(done, total): the records of an extraction file (0 without a file) against the chunks to do."""
    return files.count_lines(spark, out), total if total is not None else chunks.where("text is not null").select("chunk_id").distinct().count()


def drive(run: Callable[[], object], done: Callable[[], int], total: int, stalled_rounds: int = 5, cool_off: float = 180.0, sleep: Callable[[float], None] = time.sleep) -> bool:
    """Run until ``done()`` reaches ``total``; False after ``stalled_rounds`` rounds in a row without growth.

    Errors of a round are a pause, not the end. The first round has nothing to compare with and never counts as stalled.
    """
    last, stalled = None, 0
    while True:
        try:
            run()
        except Exception:  # the next round takes up what is left
            sleep(cool_off)
        n = done()
        if n >= total:
            return True
        stalled = stalled + 1 if last is not None and n <= last else 0
        last = n
        if stalled >= stalled_rounds:
            return False
