"""Exact vector search: top k of many queries in blocks, reranking of candidate lists, pairs above a threshold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from amphora.functions.vectors import cosine
from amphora.operators.topk import Best
from amphora.schema import NORM_EPSILON, THETA, TOP_PASSAGES
from amphora.session import spread


def usable(vector: str, dim: int) -> F.Column:
    v = F.col(vector)
    return (F.size(v) == dim) & F.exists(v, lambda x: x != 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x))


def _matrix(values: list | np.ndarray) -> np.ndarray:
    x = np.array(values, np.float64)
    return x / (np.linalg.norm(x, axis=1, keepdims=True) + NORM_EPSILON)


def _local_topk(qids: np.ndarray, q: np.ndarray, k: int, step: int = 200):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(qids), k + 1)  # the own hit is left out later
        for b in batches:
            if not b.num_rows:
                continue
            ids, flat = b.column(0).to_numpy(), b.column(1).flatten().to_numpy(zero_copy_only=False)
            sorted_ = np.argsort(ids, kind="stable")
            ids, x = ids[sorted_], _matrix(flat.reshape(b.num_rows, -1)[sorted_])
            for at in range(0, len(qids), step):
                for i, scores in enumerate(q[at : at + step] @ x.T, at):
                    best.add(i, scores, ids)
        yield from best.rows(("query_id", "id", "score"), pa.array(qids))

    return run


def vector_topk(table: DataFrame, queries: DataFrame, k: int, dim: int = 64, key: str = "vec_id", vector: str = "vector", block: int = 20_000, own_hits: bool = False) -> DataFrame:
    """(query_id, id, score, rank): exact cosine top k; ties go to the smaller id. Unless ``own_hits``, a query is a row of the table and isn't its own hit.

    The stated queries (query_id, vector) meet all rows in one map over the table, as long as they are at most about ``block`` (10 MB), and in a map a block
    beyond that; a task returns k rows a query, and one more. Unusable vectors on either side are left out.
    """
    rows = spread(table.where(usable(vector, dim) & F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(vector).alias("v")))
    asked = queries.where(usable("vector", dim)).select("query_id", "vector")
    n = asked.count()
    blocks = max(1, -(-n // block) * (2 if n > block else 1))
    out = None
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect()  # bounded by the block
        if part:
            run = _local_topk(np.array([r.query_id for r in part]), _matrix([r.vector for r in part]), k)
            hits = rows.mapInArrow(run, "query_id bigint, id bigint, score double")
            out = hits if out is None else out.unionByName(hits)
    if out is None:
        return table.sparkSession.createDataFrame([], "query_id bigint, id bigint, score double, rank int")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = (out if own_hits else out.where("query_id <> id")).withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= k)


def rerank(candidates: DataFrame, m: int = TOP_PASSAGES) -> DataFrame:
    """Of (query_id, id, ord, query_vector, vector) the m nearest of each query as (query_id, id, rank); ties keep the candidates' order."""
    scored = candidates.select("query_id", "id", "ord", F.round(cosine(F.col("query_vector"), F.col("vector")), 9).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "ord")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= m).select("query_id", "id", "rank")


def _block_pairs(theta: float):
    """Rows (cell, side, id, vector), sorted by (cell, side), to pairs at least ``theta`` alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, sides = None, ([], [])

        def work() -> Iterator[pa.RecordBatch]:
            (left, right) = sides
            kind, i, j = (cell or "\x01\x01").split("\x01")[-3:]
            if not left or (not right and (kind != "h" or i != j)):  # a block meets itself only in a cell of its own
                return
            a = np.array([i for i, _ in left])
            x = _matrix([v for _, v in left])
            b, y = (a, x) if not right else (np.array([i for i, _ in right]), _matrix([v for _, v in right]))
            for at in range(0, len(a), 1_000):
                i, j = np.nonzero(x[at : at + 1_000] @ y.T >= theta)
                p, q = a[at : at + 1_000][i], b[j]
                keep = p < q if not right else p != q
                yield pa.RecordBatch.from_pydict({"a": pa.array(np.minimum(p, q)[keep]), "b": pa.array(np.maximum(p, q)[keep])})

        for batch in batches:
            for c, s, i, v in zip(*(batch.column(n).to_pylist() for n in range(4)), strict=True):
                if c != cell:
                    yield from work()
                    cell, sides = c, ([], [])
                sides[s].append((i, v))
        yield from work()

    return run


def _reach(pivots: np.ndarray, widest: np.ndarray | None, angle: float):
    """Rows (g, id, v) to (g, id, v, cell, home): home cells only, or every cell that may hold a vector within ``angle``.

    Angles between directions obey the triangle inequality: what lies within ``angle`` of a vector is no further from the vector's pivots than that, so a
    cell whose widest member is nearer to its pivot than that difference can't hold it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(2).to_pylist())
            away = np.arccos(np.clip(x @ pivots.T, -1, 1))
            home = away.argmin(1)
            if widest is None:
                yield pa.RecordBatch.from_pydict({"cell": pa.array(home.astype(np.int32)), "away": pa.array(away[np.arange(len(home)), home])})
                continue
            near = away <= widest[None, :] + angle + 1e-6
            near[np.arange(len(home)), home] = True
            r, c = np.nonzero(near & (np.arange(len(pivots))[None, :] <= home[:, None]))  # a pair meets in the smaller of its two home cells
            rows = pa.array(r)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(rows), b.column(1).take(rows), b.column(2).take(rows), pa.array(c.astype(np.int32)), pa.array(c == home[r])], names=["g", "id", "v", "cell", "home"]
            )

    return run


def threshold_pairs(table: DataFrame, theta: float = THETA, dim: int = 64, key: str = "vec_id", group: str = "type", vector: str = "vector", block: int = 4_000, pivots: int = 256) -> DataFrame:
    """(a, b), a < b: ids of one group whose cosine is at least ``theta``, exactly.

    Every vector has the nearest of at most ``pivots`` sampled directions (one a block of the table) for its home; it travels to the cells whose members can
    lie within the angle, and to no others (a bound by the triangle inequality, so no pair is lost). A cell of a group is cut into blocks of about ``block``
    vectors, and each pair of blocks is one matrix product in one task: a group holding a third of all rows is many tasks, and only pairs above the
    threshold leave them. On vectors without any clusters the cells can't be told apart, and the work grows with the square of a group, as exactness asks.
    """
    rows = table.where(usable(vector, dim) & F.col(key).isNotNull()).select(F.coalesce(group, F.lit("")).alias("g"), F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    rows = spread(rows)
    n = rows.count()
    # a vector has at most half as many copies as there are pivots, so there are no more of them than blocks would make
    pivots = int(min(pivots, max(1, -(-n // block))))
    share = min(1.0, 4.0 * pivots / max(n, 1))
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000) + 1).select("v").limit(pivots).collect()  # the documented bound
    sample = sample or rows.select("v").limit(1).collect()
    if not sample:
        return rows.select(F.col("id").alias("a"), F.col("id").alias("b")).where("false")
    if len(sample) == 1:  # a single cell is everyone's home
        met = rows.select("g", "id", "v", F.lit(0).alias("cell"), F.lit(True).alias("home"))
    else:
        center, angle = _matrix([r.v for r in sample]), float(np.arccos(np.clip(theta, -1, 1)))
        widest = np.zeros(len(center))
        for r in rows.mapInArrow(_reach(center, None, angle), "cell int, away double").groupBy("cell").agg(F.max("away").alias("w")).collect():  # a row a pivot
            widest[r.cell] = r.w
        met = rows.mapInArrow(_reach(center, widest, angle), "g string, id bigint, v array<double>, cell int, home boolean")
    sizes = met.groupBy("g", "cell", "home").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("n"))
    sizes = sizes.groupBy("g", "cell").agg(F.max(F.when(F.col("home"), F.col("n"))).alias("homes"), F.coalesce(F.max(F.when(~F.col("home"), F.col("n"))), F.lit(0)).alias("guests")).where("homes is not null")
    own = met.join(sizes, ["g", "cell"])
    name = lambda kind, i, j: F.concat_ws("\x01", "g", "cell", F.lit(kind), i, j)
    mine = F.pmod(F.xxhash64("id"), F.col("homes")).cast("int")
    # homes meet homes: the pairs of blocks; guests meet homes: every block of guests with every block of homes
    home = own.where("home").withColumn("own", mine)
    among = home.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("homes") - 1))).select(name("h", F.least("own", "other"), F.greatest("own", "other")).alias("cell_name"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "id", "v")
    hosts = home.where("guests > 0").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("guests") - 1))).select(name("g", F.col("own"), F.col("other")).alias("cell_name"), F.lit(0).alias("side"), "id", "v")
    guests = own.where("not home").withColumns({"own": F.pmod(F.xxhash64("id"), F.col("guests")).cast("int"), "other": F.explode(F.sequence(F.lit(0), F.col("homes") - 1))})
    guests = guests.select(name("g", F.col("other"), F.col("own")).alias("cell_name"), F.lit(1).alias("side"), "id", "v")
    cells = among.unionByName(hosts).unionByName(guests).withColumnRenamed("cell_name", "cell")
    return cells.repartition("cell").sortWithinPartitions("cell", "side").mapInArrow(_block_pairs(theta), "a bigint, b bigint")
