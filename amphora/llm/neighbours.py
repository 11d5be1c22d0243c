"""Most similar vectors for every vector: an inverted multi-index searched by its own vectors.

Method. Unit vectors are cut into two halves, and each half is quantised by its own k-means: a pair of centroids is a cell.
A query walks the cells in the order of summed distance with a heap (multi-sequence traversal over the two sorted
centroid lists) until the cells hold enough entries; the entries of these cells, and of no others, are reranked by exact cosine.

Accuracy. The codebooks grow with the square root of the vectors (``cells``), and so does the number of entries a query asks
for (4 * sqrt(n), at least ``enough``); the share of the collection that a query scores falls as the collection grows. ``exact`` walks all
cells and so misses nothing.

Scale. The codebooks are fitted on at most ``fit_rows`` vectors; every vector is indexed and every vector is a query. What the
driver and the tasks share is the codebooks and the cell counts, at most 2 x 1,024 x 32 floats and 1,024 x 1,024 counts.
The grid of cells, its centroids ordered so that near ones are neighbours, is cut into tiles of at most ``shard_rows``
entries; a query travels once to every tile that holds cells of its walk. A single cell with more entries is cut into blocks that all
its queries visit, so one cell may hold a third of all vectors. Equal directions collapse to their six
smallest ids before the search, which decides ties exactly and keeps a group of copies from meeting itself.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from amphora.session import materialize, spread


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.argmax(x @ c.T - (c * c).sum(1) / 2, axis=1)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), len(c))])
    return c.astype(np.float32)


def _rows(batch: pa.RecordBatch, column: int, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(column).to_pylist()), np.float32).reshape(-1, dim)


def ordered(c: np.ndarray) -> np.ndarray:
    """The centroids in an order that keeps near ones together: halved again and again along the widest direction."""

    def halve(at: np.ndarray) -> np.ndarray:
        if len(at) <= 2:
            return at
        x = c[at] - c[at].mean(0)
        along = x @ np.linalg.svd(x, full_matrices=False)[2][0]
        at = at[np.argsort(along, kind="stable")]
        return np.concatenate([halve(at[: len(at) // 2]), halve(at[len(at) // 2 :])])

    return c[halve(np.arange(len(c)))]


def tiles(counts: np.ndarray, shard_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(tile of every cell, blocks of every tile): rectangles of cells halved until they hold at most ``shard_rows`` entries or are one cell."""
    total = np.zeros((counts.shape[0] + 1, counts.shape[1] + 1), np.int64)
    total[1:, 1:] = counts.cumsum(0).cumsum(1)
    tile, blocks = np.zeros(counts.shape, np.int32), []
    stack = [(0, counts.shape[0], 0, counts.shape[1])]
    while stack:
        i0, i1, j0, j1 = stack.pop()
        n = total[i1, j1] - total[i0, j1] - total[i1, j0] + total[i0, j0]
        if n <= shard_rows or (i1 - i0 == 1 and j1 - j0 == 1):
            tile[i0:i1, j0:j1] = len(blocks)
            blocks.append(max(1, -(-int(n) // shard_rows)))
        elif i1 - i0 >= j1 - j0:
            along = total[i0 + 1 : i1, j1] - total[i0 + 1 : i1, j0] - total[i0, j1] + total[i0, j0]
            m = i0 + 1 + int(np.argmin(np.abs(along - n / 2)))
            stack += [(i0, m, j0, j1), (m, i1, j0, j1)]
        else:
            along = total[i1, j0 + 1 : j1] - total[i0, j0 + 1 : j1] - total[i1, j0] + total[i0, j0]
            m = j0 + 1 + int(np.argmin(np.abs(along - n / 2)))
            stack += [(i0, i1, j0, m), (i0, i1, m, j1)]
    return tile, np.array(blocks, np.int64)


def traverse(d1: np.ndarray, d2: np.ndarray, counts: list[list[int]], enough: int) -> list[tuple[int, int]]:
    """The cells (i, j) that hold entries, in the order of summed distance, until they hold ``enough`` entries.

    Every row of the two sorted lists has its next pair in the heap; a row is opened when the one before it leaves its first pair.
    """
    o1, o2 = np.argsort(d1).tolist(), np.argsort(d2).tolist()
    s1, s2 = d1[o1].tolist(), d2[o2].tolist()
    heap, out, total, rows, columns = [(s1[0] + s2[0], 0, 0)], [], 0, len(s1), len(s2)
    while heap and total < enough:
        _, a, b = heapq.heappop(heap)
        n = counts[o1[a]][o2[b]]
        if n:
            out.append((o1[a], o2[b]))
            total += n
        if b == 0 and a + 1 < rows:
            heapq.heappush(heap, (s1[a + 1] + s2[0], a + 1, 0))
        if b + 1 < columns:
            heapq.heappush(heap, (s1[a] + s2[b + 1], a, b + 1))
    return out


def _assign(c1: np.ndarray, c2: np.ndarray, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = dim // 2
        for b in batches:
            if not b.num_rows:
                continue
            x = _rows(b, 1, dim)
            i = np.argmax(x[:, :half] @ c1.T - (c1 * c1).sum(1) / 2, axis=1).astype(np.int32)
            j = np.argmax(x[:, half:] @ c2.T - (c2 * c2).sum(1) / 2, axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(i), pa.array(j)], names=["id", "v", "i", "j"])

    return run


def _visits(c1: np.ndarray, c2: np.ndarray, counts: np.ndarray, tile: np.ndarray, blocks: np.ndarray, enough: int, dim: int):
    """Rows (id, v) to (shard, id, v, cells, asks): a row for every block of every tile that holds cells of the walk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half, plain, of, parts, wide = dim // 2, counts.tolist(), tile.tolist(), blocks.tolist(), counts.shape[1]
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                b = batch.slice(at, 2_000)
                x = _rows(b, 1, dim)
                d1 = (c1 * c1).sum(1) - 2 * x[:, :half] @ c1.T
                d2 = (c2 * c2).sum(1) - 2 * x[:, half:] @ c2.T
                take, shard, cells = [], [], []
                for n in range(b.num_rows):
                    by_tile: dict[int, list[int]] = {}
                    for i, j in traverse(d1[n], d2[n], plain, enough):
                        by_tile.setdefault(of[i][j], []).append(i * wide + j)
                    for t, found in by_tile.items():
                        for k in range(parts[t]):
                            take.append(n)
                            shard.append(t << 32 | k)
                            cells.append(found)
                at_rows = pa.array(take, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard, pa.int64()), b.column(0).take(at_rows), b.column(1).take(at_rows), pa.array(cells, pa.list_(pa.int32())), pa.array([True] * len(take))],
                    names=["shard", "id", "v", "cells", "asks"],
                )

    return run


def _rerank(k: int, dim: int):
    """Rows come sorted by (shard, asks): the entries of a shard, then its queries, answered in batches, cell by cell."""
    spare = k + 3

    def answer(index: dict[int, tuple[np.ndarray, np.ndarray]], qi: np.ndarray, qv: np.ndarray, cells: pa.Array) -> pa.RecordBatch:
        flat = cells.flatten().to_numpy()
        asker = np.repeat(np.arange(len(qi)), np.diff(cells.offsets.to_numpy()))
        order = np.argsort(flat, kind="stable")
        flat, asker = flat[order], asker[order]
        cuts = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1], True]) if len(flat) else np.zeros(1, np.int64)
        best = np.full((len(qi), spare), -9.0, np.float32)
        who = np.full((len(qi), spare), -1, np.int64)
        where = np.zeros((len(qi), spare), np.int64)
        every = np.concatenate([v for _, v in index.values()]) if index else np.zeros((0, dim), np.float32)
        first = dict(zip(index, np.cumsum([0, *(len(v) for _, v in index.values())])[:-1].tolist(), strict=True))
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            cell = int(flat[a])
            if cell not in index:
                continue
            ei, ev = index[cell]
            for at in range(0, z - a, max(1, 4_000_000 // len(ei))):
                q = asker[a + at : min(z, a + at + max(1, 4_000_000 // len(ei)))]
                s = qv[q] @ ev.T
                s[qi[q][:, None] == ei[None, :]] = -9.0
                n = s.shape[1]
                both = np.concatenate([best[q], s], axis=1)
                top = np.argpartition(-both, spare - 1, axis=1)[:, :spare]
                best[q] = np.take_along_axis(both, top, 1)
                who[q] = np.take_along_axis(np.concatenate([who[q], np.broadcast_to(ei, (len(q), n))], axis=1), top, 1)
                where[q] = np.take_along_axis(np.concatenate([where[q], np.broadcast_to(first[cell] + np.arange(n), (len(q), n))], axis=1), top, 1)
        r, c = np.nonzero((who >= 0) & (best > -8))
        exact = np.einsum("nd,nd->n", qv[r].astype(np.float64), every[where[r, c]].astype(np.float64)) if len(r) else np.zeros(0)
        return pa.RecordBatch.from_arrays([pa.array(qi[r], pa.int64()), pa.array(who[r, c], pa.int64()), pa.array(exact, pa.float64())], names=["q", "e", "cos"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, index = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            shard, asks = b.column(0).to_numpy(), b.column(4).to_numpy(zero_copy_only=False)
            bid, v = b.column(1).to_numpy(), _rows(b, 2, dim)
            cuts = [*np.flatnonzero(np.r_[True, (shard[1:] != shard[:-1]) | (asks[1:] != asks[:-1])]).tolist(), b.num_rows]
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                if shard[a] != now:
                    now, held, index = shard[a], [], None
                if not asks[a]:
                    held.append((b.column(3).slice(a, z - a).flatten().to_numpy(), bid[a:z], v[a:z]))
                    continue
                if index is None:
                    cell, ids, vecs = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros((0, dim), np.float32))
                    order = np.argsort(cell, kind="stable")
                    cell, ids, vecs = cell[order], ids[order], vecs[order]
                    ends = [*np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]).tolist(), len(cell)] if len(cell) else [0]
                    index = {int(cell[x]): (ids[x:y], vecs[x:y]) for x, y in zip(ends[:-1], ends[1:], strict=True)}
                yield answer(index, bid[a:z], v[a:z], b.column(3).slice(a, z - a))

    return run


def unit_vectors(table: DataFrame, dim: int, key: str = "vec_id", vector: str = "vector") -> DataFrame:
    """(id, v): usable vectors, of ``dim`` components, none null or NaN, not all zero, as unit-length binary floats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column(1).to_pylist(), np.float64).reshape(-1, dim)
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            flat = x.astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in flat], pa.binary())], names=["id", "v"])

    v = F.col(vector)
    ok = (F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)) & F.exists(v, lambda x: x != 0) & F.col(key).isNotNull()
    return spread(table.where(ok).select(F.col(key).cast("bigint").alias(key), vector)).mapInArrow(run, "id bigint, v binary")


def similar_pairs(
    table: DataFrame, k: int = 5, dim: int = 64, fit_rows: int = 20_000, enough: int = 800, shard_rows: int = 10_000, salts: int = 32, exact: bool = False, cells: int | None = None
) -> DataFrame:
    """(a, b, cos) with a < b: pairs of usable vectors one of which is among the ``k`` most similar of the other.

    Ties go to the smaller id. Unusable vectors (null, short, all zero, with null components) and null ids are left out; repeated
    rows count once; fewer than two usable vectors give no rows. ``exact`` scores all pairs; ``cells`` fixes the centroids of a half.
    """
    every = materialize(unit_vectors(table, dim).dropDuplicates(["id"]), "unit")
    n = every.count()
    # equal directions (to 5 decimals) keep their k + 1 smallest ids; the salt splits a large group first
    coarse = every.mapInArrow(_coarse(dim), "id bigint, v binary, h bigint")
    few = Window.partitionBy("h", "salt").orderBy("id")
    whole = Window.partitionBy("h").orderBy("id")
    ranked = coarse.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts))).withColumn("r", F.row_number().over(few)).where(F.col("r") <= k + 1)
    reps = materialize(ranked.withColumn("r", F.row_number().over(whole)).where(F.col("r") <= k + 1).select("id", "v", "h", "r"), "reps")
    m = reps.count()
    copies = coarse.select("id", "h").join(reps.select("h", F.col("id").alias("e"), "r").where(F.col("r") <= k), "h").join(reps.select("id"), "id", "left_anti") if m < n else None

    share = min(1.0, 1.3 * fit_rows / max(m, 1))
    sample = reps.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000)).select("v").limit(fit_rows).collect()  # the documented bound of the fit
    if not sample:
        return every.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("cos")).where("false")
    x = np.frombuffer(b"".join(r.v for r in sample), np.float32).reshape(-1, dim)
    cells = cells or int(np.clip(np.sqrt(m) / 3, 4, 1_024))
    enough = m if exact else max(enough, int(4 * np.sqrt(m)))
    c1, c2 = ordered(kmeans(x[:, : dim // 2], cells)), ordered(kmeans(x[:, dim // 2 :], cells))
    index = materialize(reps.select("id", "v").mapInArrow(_assign(c1, c2, dim), "id bigint, v binary, i int, j int"), "index")
    counts = np.zeros((len(c1), len(c2)), np.int64)
    for r in index.groupBy("i", "j").count().collect():  # at most 1,024 x 1,024
        counts[r.i, r.j] = r["count"]
    tile, blocks = tiles(counts, shard_rows)
    entries = index.mapInArrow(_places(tile, blocks), "shard bigint, id bigint, v binary, cells array<int>, asks boolean")
    asks = index.select("id", "v").mapInArrow(_visits(c1, c2, counts, tile, blocks, enough, dim), "shard bigint, id bigint, v binary, cells array<int>, asks boolean")
    near = entries.unionByName(asks).repartition("shard").sortWithinPartitions("shard", "asks").mapInArrow(_rerank(k, dim), "q bigint, e bigint, cos double")
    best = near.groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("cos")).alias("d"), "e"))), 1, k).alias("best"))  # k + 3 a visited tile
    pairs = best.select("q", F.explode("best").alias("x")).select("q", F.col("x.e").alias("e"), (-F.col("x.d")).alias("cos"))
    if copies is not None:
        pairs = pairs.unionByName(copies.select(F.col("id").alias("q"), "e", F.lit(1.0).alias("cos")))
    return pairs.groupBy(F.least("q", "e").alias("a"), F.greatest("q", "e").alias("b")).agg(F.max("cos").alias("cos"))


def _places(tile: np.ndarray, blocks: np.ndarray):
    """Rows (id, v, i, j) of the index to the entries of the shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids, i, j = (b.column(c).to_numpy() for c in (0, 2, 3))
            t = tile[i, j].astype(np.int64)
            block = (ids * np.int64(0x9E3779B97F4A7C1 | 1) >> np.int64(33) & np.int64(0x3FFFFFFF)) % blocks[t]
            cell = pa.array((i.astype(np.int32) * tile.shape[1] + j).astype(np.int32))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32)), cell)
            yield pa.RecordBatch.from_arrays([pa.array(t << 32 | block), b.column(0), b.column(1), lists, pa.array(np.zeros(b.num_rows, bool))], names=["shard", "id", "v", "cells", "asks"])

    return run


def _coarse(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import blake2b

        for b in batches:
            x = np.round(_rows(b, 1, dim).astype(np.float64), 5) + 0.0 if b.num_rows else []
            h = [int.from_bytes(blake2b(r.tobytes(), digest_size=8).digest(), "little", signed=True) for r in x]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(h, pa.int64())], names=["id", "v", "h"])

    return run
