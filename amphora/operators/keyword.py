"""BM25 over chunks for many queries at once: tokens, term weights, top k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from amphora.functions.text import tokenize
from amphora.operators.topk import Best
from amphora.schema import KEYWORD_K
from amphora.session import materialize, spread

K1, B, EPSILON = 1.5, 0.75, 0.25


def tokens_of(docs: DataFrame, key: str = "chunk_id", text: str = "text", order: str = "ord") -> DataFrame:
    """(key, ord, tokens): a row per document."""
    return docs.select(key, F.col(order).alias("ord"), tokenize(F.col(text)).alias("tokens"))


def term_weights(tokens: DataFrame, n_docs: DataFrame) -> DataFrame:
    """(term, df, idf): inverse document frequency; negative weights are lifted to a share of the average of all terms.

    ``n_docs`` is a one-row table (n).
    """
    df = tokens.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n_docs))  # one row
    raw = df.select("term", "df", (F.log(F.col("n") - F.col("df") + F.lit(0.5)) - F.log(F.col("df") + F.lit(0.5))).alias("raw"))
    floor = raw.agg((F.avg("raw") * F.lit(EPSILON)).alias("floor"))
    return raw.crossJoin(F.broadcast(floor)).select("term", "df", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf"))


def _scorer(ids: pa.Array, k: int, avgdl: float, terms: list[str], begins: np.ndarray, of: np.ndarray, weight: np.ndarray):
    """Maps (ord, tokens) to the k best documents of each question; question i has the terms ``of`` and weights from ``begins[i]`` up to ``begins[i + 1]``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, known = Best(len(ids), k), pa.array(terms, pa.string())
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            numbers, lists = b.column(0).to_numpy(), b.column(1)
            sorted_ = np.argsort(numbers, kind="stable")
            place = np.empty(n, np.int64)
            place[sorted_], numbers = np.arange(n), numbers[sorted_]
            length = np.diff(lists.offsets.to_numpy())
            term = pc.index_in(lists.flatten(), value_set=known).fill_null(-1).to_numpy()
            row = np.repeat(place, length)[term >= 0]
            cell, tf = np.unique(term[term >= 0].astype(np.int64) * n + row, return_counts=True)  # by term, then by number
            term, row = np.divmod(cell, n)
            part = tf * (K1 + 1) / (tf + K1 * ((1 - B) + B * length[sorted_][row] / avgdl))
            edges = np.searchsorted(term, np.arange(len(terms) + 1))
            scores = np.empty(n)
            for i in range(len(ids)):
                scores.fill(0.0)
                for x in range(begins[i], begins[i + 1]):
                    own = slice(edges[of[x]], edges[of[x] + 1])
                    scores[row[own]] += weight[x] * part[own]  # a document is there once a term
                best.add(i, scores, numbers)
        yield from best.rows(("query_id", "ord", "score"), ids)

    return run


def first_unscored(queries: DataFrame, scored: DataFrame, k: int) -> DataFrame:
    """(query_id, ord): the first ``k`` numbers 1, 2, ... that no row of ``scored`` (query_id, ord) of the query holds.

    The t-th of them is t plus the held numbers with fewer than t free ones before; what a query keeps for that are at most k counts.
    """
    w = Window.partitionBy("query_id").orderBy("ord")
    free = scored.withColumn("free", F.col("ord") - F.row_number().over(w)).where(F.col("free") < k)
    counts = free.groupBy("query_id", "free").agg(F.count(F.lit(1)).alias("n")).groupBy("query_id").agg(F.collect_list(F.struct("free", "n")).alias("held"))
    numbered = queries.select("query_id").distinct().join(counts, "query_id", "left").withColumn("t", F.explode(F.sequence(F.lit(1), F.lit(k))))
    before = F.aggregate(F.coalesce("held", F.array()), F.lit(0).cast("bigint"), lambda s, x: s + F.when(x["free"] < F.col("t"), x["n"]).otherwise(0))
    return numbered.select("query_id", (F.col("t") + before).alias("ord"))


def search(tokens: DataFrame, weights: DataFrame, averages: DataFrame, docs: DataFrame, queries: DataFrame, k: int = KEYWORD_K, key: str = "chunk_id", block: int = 20_000) -> DataFrame:
    """(query_id, key, score, rank) over a stored index: ``tokens`` (ord, tokens), ``weights`` (term, idf), ``averages`` (avgdl), ``docs`` (key, ord).

    The stated questions, as long as they are at most about ``block``, meet all documents in one map over the tokens, and in a map a block beyond that. A question
    and a document that share a term are never a row: a word such as "of" is in every text, so those would be questions times documents. A task returns k rows a
    question. Documents without a shared term score 0 and come in corpus order, before documents that score below 0. A query term counts as often as the query has it.
    """
    spark, kind = tokens.sparkSession, queries.schema["query_id"].dataType
    asked = queries.select("query_id").distinct()
    terms = queries.select("query_id", F.explode(tokenize(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    weighed = terms.join(weights.select("term", "idf"), "term").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("term", (F.col("times") * F.col("idf")).alias("weight")))).alias("weighed"))
    asked = materialize(asked.join(weighed, "query_id", "left"), "asked")
    of_averages = averages.first()
    n, rows = asked.count(), spread(tokens.select("ord", "tokens"))
    blocks = max(1, -(-n // block) * (2 if n > block else 1))
    schema, out = f"query_id {kind.simpleString()}, ord bigint, score double", None
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect()  # bounded by the block
        if part and of_averages and of_averages.avgdl is not None:
            at = {t: i for i, t in enumerate(sorted({x.term for r in part for x in r.weighed or ()}))}
            begins = np.cumsum([0, *(len(r.weighed or ()) for r in part)])
            of, weight = np.array([at[x.term] for r in part for x in r.weighed or ()], np.int64), np.array([x.weight for r in part for x in r.weighed or ()], np.float64)
            run = _scorer(pa.array([r.query_id for r in part], to_arrow_type(kind)), k, of_averages.avgdl or 1.0, list(at), begins, of, weight)
            found = rows.mapInArrow(run, schema)
            out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], schema)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "ord")
    ranked = out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.join(docs.select(key, "ord"), "ord").select("query_id", key, "score", "rank")


def averages_of(tokens: DataFrame) -> DataFrame:
    """(n, avgdl), one row: all documents count, also those without a word."""
    return tokens.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("tokens")).alias("avgdl"))


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int = KEYWORD_K, key: str = "chunk_id", text: str = "text", order: str = "ord") -> DataFrame:
    """(query_id, chunk_id, score, rank): the k best documents of each query, ties in corpus order, without a stored index.

    ``order`` numbers the documents 1, 2, ... without gaps. An empty corpus or query table gives no rows; a query without
    words gets the first k documents.
    """
    tokens = materialize(tokens_of(docs.where(F.col(text).isNotNull()), key, text, order), "tokens")
    averages = materialize(averages_of(tokens), "averages")
    return search(tokens, term_weights(tokens, averages.select("n")), averages, tokens.select(key, "ord"), queries, k, key)
