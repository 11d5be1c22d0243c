"""Mixing sources to target weights: Pfair scheduling of source blocks.

Method. A source's stream is its documents in a fixed hash order, pass after pass, and it is cut into blocks of equal size in
tokens; a document that reaches past the end of a block goes on in the source's next block. The k-th block of a source with weight w is
released at slot floor((k-1)/w) and due at ceil(k/w); of the released
blocks the one due first is placed next (earliest deadline first), so that after every slot each source is less than one
block away from its share. All blocks are full, so the same holds in tokens.

Size. The mix is as large as the target shares allow: the total at which the scarcest source, every document used
``max_repeats`` times, still fills its share. ``total_tokens`` asks for another size; sources that can't fill their
share then give all they may, and the rest is divided among the others by weight. Sources without tokens have no share; the reported
target stays that of the table, the shares wanted are those of the sources present. The size of a block is
``block_tokens``, or the ten-thousandth part (``slots``) of a mix for which that is more.

Scale. Documents are mapped to token counts, and only (doc_id, source, size) goes on. A stream position is the offset of the document's
hash bucket plus a running sum inside the bucket; the offsets are running sums over at most ``_BUCKETS`` buckets a source, so a
source holding a third of all documents is spread over its buckets. What reaches the driver is a sum for every source of the targets; the schedule
has at most ``slots`` entries.
"""

from __future__ import annotations

import base64
import heapq
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from amphora.session import blank, materialize, spread

_BUCKETS = 4_096


def _vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def _count(path: str, pattern: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        rx = pattern
        if rx is None:
            import public_tokenizers

            rx = public_tokenizers.PATTERN
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("mix", pat_str=rx, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            n = [len(enc.encode_ordinary(t)) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["doc_id", "source", "n_tokens"])

    return run


def token_sizes(documents: DataFrame, tokenizer: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, source, n_tokens) of documents with a source and a non-blank text, one row a doc_id."""
    docs = documents.where(F.col("doc_id").isNotNull() & F.col("source").isNotNull() & ~blank(F.col("text"))).select("doc_id", "source", "text")
    sized = spread(docs).mapInArrow(_count(tokenizer or _vocabulary(), pattern), "doc_id bigint, source string, n_tokens bigint")
    return sized.groupBy("doc_id").agg(F.min("source").alias("source"), F.max("n_tokens").alias("n_tokens"))


def wanted_tokens(have: dict[str, int], share: dict[str, float], repeats: dict[str, int], total: float | None) -> dict[str, float]:
    """Tokens each source gives."""
    there = {s for s in share if have.get(s, 0) > 0 and share[s] > 0 and repeats[s] > 0}
    if not there:
        return {}
    cap = {s: have[s] * repeats[s] for s in there}
    weight = sum(share[s] for s in there)
    if total is None:
        total = min(cap[s] * weight / share[s] for s in there)
    out: dict[str, float] = {}
    open_, left = set(there), float(total)
    while open_:
        weight = sum(share[s] for s in open_)
        full = {s for s in open_ if share[s] / weight * left >= cap[s]}
        if not full:
            out |= {s: share[s] / weight * left for s in open_}
            break
        out |= {s: float(cap[s]) for s in full}
        left = max(0.0, left - sum(cap[s] for s in full))
        open_ -= full
    return out


def pfair(weights: dict[str, float], slots: int) -> list[tuple[str, int]]:
    """The source and block number (from 0) of every slot, by earliest deadline first among released blocks."""
    total = sum(weights.values())
    w = {s: x / total for s, x in weights.items() if x > 0}
    future = [(0, math.ceil(1 / x - 1e-9), s, 0) for s, x in w.items()]
    heapq.heapify(future)
    ready: list[tuple[int, float, str, int]] = []
    out = []
    for t in range(slots):
        while future and future[0][0] <= t:
            _, due, s, k = heapq.heappop(future)
            heapq.heappush(ready, (due, -w[s], s, k))
        if not ready:  # rounding: nothing is released yet, the next block comes early
            _, due, s, k = heapq.heappop(future)
            ready.append((due, -w[s], s, k))
        _, _, s, k = heapq.heappop(ready)
        out.append((s, k))
        heapq.heappush(future, (math.floor((k + 1) / w[s] + 1e-9), math.ceil((k + 2) / w[s] - 1e-9), s, k + 1))
    return out


def plan_blocks(have: dict[str, int], share: dict[str, float], repeats: dict[str, int], total: float | None, slots: int, block_tokens: int) -> tuple[int, list[tuple[str, int]]]:
    """(tokens of a block, the source and block number of every slot): full blocks that no source's cap falls short of."""
    wanted = wanted_tokens(have, share, repeats, total)
    all_tokens = sum(wanted.values())
    if all_tokens < 1:
        return 0, []
    n = int(max(1, min(slots, all_tokens // block_tokens)))
    order = pfair(wanted, n)
    size = int(all_tokens // n)
    for s in wanted:
        used = sum(1 for x, _ in order if x == s)
        if used:
            size = min(size, have[s] * repeats[s] // used)
    return size, order if size else []


def mix(
    documents: DataFrame, targets: DataFrame, total_tokens: float | None = None, slots: int = 10_000, block_tokens: int = 256, tokenizer: str | None = None, pattern: str | None = None
) -> DataFrame:
    """(slot, doc_id, copy, source, first_token, n_tokens): the pieces of documents that fill the slots, whole blocks in the order of the mix.

    ``copy`` counts the uses of a document from 0, ``first_token`` is where the piece begins in it. Documents without source, text or doc_id and
    sources without target take no part; null or non-positive shares and repeats
    count as none; of several rows for one source the largest share holds. Empty tables give no rows.
    """
    sizes = token_sizes(documents, tokenizer, pattern).where("n_tokens > 0")
    spark = documents.sparkSession
    empty = "slot bigint, doc_id bigint, copy bigint, source string, first_token bigint, n_tokens bigint"
    rows = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("w"), F.max("max_repeats").alias("r")).collect()  # the given targets
    share, repeats = {r.source: float(r.w or 0) for r in rows}, {r.source: int(r.r or 0) for r in rows}
    sizes = materialize(sizes.join(targets.select("source").distinct(), "source"), "sizes")
    buckets = int(min(_BUCKETS, max(1, sizes.count() // 20_000)))
    placed = sizes.withColumns({"bucket": F.pmod(F.xxhash64("doc_id"), F.lit(buckets)), "h": F.xxhash64("doc_id", F.lit(1))})
    sums = materialize(placed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("n")), "sums")
    have = {r.source: r.n for r in sums.groupBy("source").agg(F.sum("n").alias("n")).collect()}  # a row for a source of the targets
    size, order = plan_blocks(have, share, repeats, total_tokens, slots, block_tokens)
    if not order:
        return spark.createDataFrame([], empty)
    at: dict[str, list[int]] = {}
    for slot, (s, _) in enumerate(order):
        at.setdefault(s, []).append(slot)
    schedule = spark.createDataFrame([(s, have[s], len(at[s]) * size, at[s]) for s in at], "source string, have bigint, give bigint, slots array<bigint>")
    before = F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select("source", "bucket", F.coalesce(before, F.lit(0)).alias("off"))
    inside = F.sum("n_tokens").over(Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1))
    start = placed.withColumn("inside", F.coalesce(inside, F.lit(0))).join(offsets, ["source", "bucket"]).select("doc_id", "source", "n_tokens", (F.col("off") + F.col("inside")).alias("start"))
    # a document is used once a pass as long as the pass reaches it within what the source gives
    long = F.lit(size).cast("bigint")
    uses = F.when(F.col("give") > F.col("start"), F.floor((F.col("give") - F.col("start") - 1) / F.col("have")) + 1).otherwise(0)
    used = start.join(F.broadcast(schedule), "source").withColumn("uses", uses).where("uses > 0").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("uses") - 1)))  # at most ``slots`` numbers
    used = used.withColumn("a", F.col("start") + F.col("copy") * F.col("have")).withColumn("z", F.least(F.col("a") + F.col("n_tokens"), "give"))
    block = F.explode(F.sequence(F.floor(F.col("a") / long), F.floor((F.col("z") - 1) / long)))
    pieces = used.withColumn("block", block).withColumns({"from": F.greatest("a", F.col("block") * long), "to": F.least("z", (F.col("block") + 1) * long)})
    return pieces.select(
        F.get("slots", F.col("block").cast("int")).alias("slot"), "doc_id", "copy", "source", (F.col("from") - F.col("a")).alias("first_token"), (F.col("to") - F.col("from")).alias("n_tokens")
    )


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, tokens, documents, most_uses, share): what the mix reaches, for every target."""
    per_doc = mixed.groupBy("source", "doc_id").agg(F.sum("n_tokens").alias("tokens"), (F.max("copy") + 1).alias("uses"))
    got = per_doc.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("uses").alias("most_uses"))
    total = got.agg(F.sum("tokens").alias("total"))
    wide = targets.select("source", "target_share", "max_repeats").join(got, "source", "left").crossJoin(F.broadcast(total))  # one row
    return wide.select(
        "source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"),
        F.coalesce("most_uses", F.lit(0)).alias("most_uses"), F.round(F.coalesce(F.col("tokens") / F.col("total"), F.lit(0.0)), 6).alias("share"),
    )
