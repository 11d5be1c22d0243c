import math

import numpy as np

import pytest
from pyspark.sql import functions as F

from amphora.operators import fusion, graph, keyword, ordering, resolve, retrieval, similarity
from amphora.operators.components import component_labels


def test_bm25_pads_with_zeros(spark):
    docs = spark.createDataFrame(
        [("1:0", "The senate met in the forum.", 1), ("2:0", "Gladiators fought in the arena.", 2), ("3:0", "Rulers issued a denarius, a silver coin.", 3)], "chunk_id string, text string, ord bigint"
    )
    asked = spark.createDataFrame([(1, "denarius coin"), (2, "nothing here"), (3, "")], "query_id bigint, query string")
    got = {(r.query_id, r["rank"]): (r.chunk_id, r.score) for r in keyword.bm25_topk(docs, asked, 2).collect()}
    assert got[1, 1][0] == "3:0" and got[1, 2] == ("1:0", 0.0) and got[2, 1][0] == "1:0" and got[3, 2][0] == "2:0"
    assert keyword.bm25_topk(docs.limit(0), asked, 2).count() == 0


def test_bm25_formula(spark):
    texts = ["a b b c", "a c", "a d d d e", "f"]
    docs = spark.createDataFrame([(str(i), t, i + 1) for i, t in enumerate(texts)], "chunk_id string, text string, ord bigint")
    words = [t.split() for t in texts]
    df = {w: sum(w in x for x in words) for x in words for w in x}
    raw = {w: math.log(4 - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    avg = sum(raw.values()) / len(raw)
    idf = {w: x if x >= 0 else 0.25 * avg for w, x in raw.items()}
    avgdl = sum(map(len, words)) / 4
    q = ["a", "b", "b"]
    want = [sum(idf[t] * x.count(t) * 2.5 / (x.count(t) + 1.5 * (0.25 + 0.75 * len(x) / avgdl)) for t in q) for x in words]
    got = {r.chunk_id: r.score for r in keyword.bm25_topk(docs, spark.createDataFrame([(1, "a b b")], "query_id bigint, query string"), 4).collect()}
    assert all(abs(got[str(i)] - w) < 1e-6 for i, w in enumerate(want))


def test_vector_topk(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [1.0])]
    t = spark.createDataFrame(rows, "vec_id bigint, vector array<double>")
    q = t.where("vec_id = 1").select(F.col("vec_id").alias("query_id"), "vector")
    got = [(r.id, r["rank"]) for r in similarity.vector_topk(t, q, 5, dim=2).orderBy("rank").collect()]
    assert got == [(2, 1), (3, 2)]
    assert similarity.vector_topk(t, q.limit(0), 5, dim=2).count() == 0


@pytest.mark.parametrize("block", [2, 100])
def test_threshold_pairs(spark, block):
    rows = [(1, "P", [1.0, 0.0]), (2, "P", [1.0, 0.02]), (3, "P", [0.0, 1.0]), (4, "Q", [1.0, 0.0]), (5, "Q", [1.0, 0.0]), (6, "Q", None), (7, None, [1.0, 0.0])]
    t = spark.createDataFrame(rows, "vec_id bigint, type string, vector array<double>")
    assert {(r.a, r.b) for r in similarity.threshold_pairs(t, 0.9, dim=2, block=block).collect()} == {(1, 2), (4, 5)}


def test_rerank_keeps_order_on_ties(spark):
    rows = [(1, i, o, [1.0, 0.0], v) for i, o, v in ((10, 2, [1.0, 0.0]), (11, 1, [2.0, 0.0]), (12, 3, [0.0, 1.0]))]
    df = spark.createDataFrame(rows, "query_id bigint, id bigint, ord bigint, query_vector array<double>, vector array<double>")
    assert [r.id for r in similarity.rerank(df, 2).orderBy("rank").collect()] == [11, 10]


@pytest.mark.parametrize(
    ("lists", "weights", "order"),
    [((("A", "B", "C"), ("C", "D", "A")), (None, None), "ACBD"), ((("A", "B"), ("D", "E")), (None, None), "ADBE"), ((("A",), ("D",)), (1.0, 0.5), "AD")],
)
def test_rrf(spark, lists, weights, order):
    rows = [(1, n, r, c, w) for n, (ids, w) in enumerate(zip(lists, weights, strict=True)) for r, c in enumerate(ids, 1)]
    df = spark.createDataFrame(rows, "query_id bigint, list_id int, rank int, chunk_id string, weight double")
    assert "".join(r.chunk_id for r in fusion.ranked(fusion.rrf(df), None).orderBy("rank").collect()) == order


def test_hybrid_tags(spark):
    hits = lambda ids: spark.createDataFrame([(1, c, r) for r, c in enumerate(ids, 1)], "query_id bigint, chunk_id string, rank int")
    got = {r.chunk_id: r.found_by for r in fusion.hybrid(hits("AB"), hits("BC")).collect()}
    assert got == {"A": "V", "B": "V+B", "C": "B"}
    assert [r.chunk_id for r in fusion.overlap(hits("AB"), hits("BC")).collect()] == ["B"]


MENTION = "mention_id bigint, chunk_id string, ord int, name string, type string, description string"
REL = "relation_id bigint, chunk_id string, source string, relation string, target string, description string"


def graph_of(spark):
    mentions = spark.createDataFrame(
        [
            (1, "1:0", 0, "Caracalla", "Person", "ruler"), (2, "1:0", 1, ' "citizenship" ', "Concept", None), (3, "1:0", 2, "Rome", "Place", ""), (4, "1:0", 3, "Rome", "Organization", "body"),
            (5, "2:0", 0, "Rome", "Place", "city"), (6, "2:0", 1, "", "Place", None), (7, "2:0", 2, "Nero", "Emperor", None), (8, "2:0", 3, None, None, None), (9, "2:0", 4, "Rome", "Place", "city"),
        ],
        MENTION,
    )
    relations = spark.createDataFrame(
        [
            (1, "1:0", "Caracalla", "GRANTED", "citizenship", "edict"), (2, "1:0", "Caracalla", "RULED", "Rome", None), (3, "1:0", "Caracalla", "CONQUERED", "Rome", None), (4, "1:0", "Caracalla", "GRANTED", "Rome", None),
            (5, "2:0", "Nero", "RULED", "Rome", None), (6, "1:0", "Caracalla", "GRANTED", "citizenship", "again"), (7, None, None, None, None, None),
        ],
        REL,
    )
    return mentions, relations


def test_validation(spark):
    mentions, relations = graph_of(spark)
    reasons = {r.mention_id: r.reason for r in graph.validate_entities(mentions).collect()}
    assert reasons == {1: None, 2: None, 3: None, 4: None, 5: None, 6: "missing name", 7: "unknown node type", 8: "missing name", 9: None}
    judged = graph.validate_relations(relations, graph.valid_mentions(mentions))
    reasons = {r.relation_id: r.reason for r in judged.collect()}
    assert reasons == {1: None, 2: None, 3: "unknown relation type", 4: "endpoint type violates schema", 5: "endpoint not declared", 6: None, 7: "unknown relation type"}
    assert judged.where("relation_id = 2").first().target_type == "Organization"  # the last type of the name in the chunk


def test_graph_tables(spark):
    mentions, relations = graph_of(spark)
    valid = graph.valid_mentions(mentions)
    nodes = {(r.name, r.type): r.chunks for r in graph.nodes(valid.unionAll(valid)).collect()}
    assert nodes == {("Caracalla", "Person"): 1, ("citizenship", "Concept"): 1, ("Rome", "Place"): 2, ("Rome", "Organization"): 1}
    kept = graph.validate_relations(relations, valid).where("reason is null")
    edges = {(r.relation, r.target): (r.chunks, r.descriptions, r.first_description) for r in graph.edges(kept).collect()}
    assert edges == {("GRANTED", "citizenship"): (1, 2, "edict"), ("RULED", "Rome"): (1, 1, "")}
    degrees = {(r.name, r.type): r.degree for r in graph.degrees(graph.nodes(valid), graph.edges(kept)).collect()}
    assert degrees[("Caracalla", "Person")] == 2 and degrees[("Rome", "Place")] == 0
    counts = graph.load_counts(relations, valid).first()
    assert (counts.entities, counts.relations, counts.skipped_relations) == (6, 4, 3)
    told = {(r.name, r.type): r["values"] for r in graph.node_descriptions(valid, 2).collect()}
    assert told[("Rome", "Place")] == ["", "city"]


def test_self_loop_counts_once(spark):
    edges = spark.createDataFrame([("A", "Person", "INFLUENCED", "A", "Person")], "source string, source_type string, relation string, target string, target_type string")
    nodes = spark.createDataFrame([("A", "Person"), ("B", "Person")], "name string, type string")
    assert {r.name: r.degree for r in graph.degrees(nodes, edges).collect()} == {"A": 1, "B": 0}


def test_same_as(spark):
    nodes = spark.createDataFrame([("A", "P"), ("B", "P")], "name string, type string")
    rows = [
        ([["B", "P"], ["A", "P"]], True, "old", "2024-01-01", 1), ([["A", "P"], ["B", "P"]], True, "new", "2024-01-02", 2), ([["A", "P"], ["C", "P"]], True, "x", "2024-01-01", 3), (None, True, "x", None, 4),
        ([["A", "P"]], True, "x", None, 5), ([["A", "P"], ["A", "P"]], True, "x", None, 6), ([["A", "P"], ["B", "P"]], None, "x", None, 7),
    ]
    d = spark.createDataFrame(rows, "pair array<array<string>>, same boolean, canonical string, d string, decision_id bigint").withColumn("decided_at", F.to_timestamp("d"))
    assert [tuple(r) for r in graph.same_as_links(d, nodes).collect()] == [("A", "P", "B", "P", "new")]


def test_token_blocks(spark):
    rows = [("Roman Empire", "Organization"), ("Roman Republic", "Organization"), ("Roman army", "Organization"), ("Roman Senate", "Organization"), ("Empire", "Organization"), ("Rome", "Place"), ("Rome", "Concept"), ("", "Place")]
    got = {(r.a_name, r.b_name) for r in resolve.token_block_pairs(spark.createDataFrame(rows, "name string, type string"), 3).collect()}
    assert got == {("Empire", "Roman Empire")}


def test_candidates_and_pending(spark):
    pairs = lambda *x: spark.createDataFrame([("P", *p) for p in x] or [], "type string, a_name string, b_name string")
    hubs = spark.createDataFrame([("P", "0")], "type string, name string")
    got = resolve.candidate_pairs(pairs(("0", "1")), pairs(("1", "2")), hubs)
    assert [(r.a_name, r.b_name) for r in got.collect()] == [("0", "1")]
    both = resolve.candidate_pairs(pairs(("0", "1")), pairs(("1", "2")), spark.createDataFrame([("P", "1")], "type string, name string"))
    assert both.count() == 2
    decided = spark.createDataFrame([("0", "P", "1", "P")], "a_name string, a_type string, b_name string, b_type string")
    assert [(r.a_name, r.b_name) for r in resolve.pending_pairs(both, decided).collect()] == [("1", "2")]


EDGE = "source string, source_type string, relation string, target string, target_type string, chunks bigint"
SAME = "a_name string, a_type string, b_name string, b_type string, canonical string"


def hood(spark, seeds, edges, same=(), **kw):
    s = spark.createDataFrame([(1, n, "P") for n in seeds] or [], "query_id bigint, name string, type string")
    e = spark.createDataFrame([(a, "P", "R", b, "P", n) for a, b, n in edges], EDGE)
    v = spark.createDataFrame([(a, "P", b, "P", None) for a, b in same] or [], SAME)
    return {(r.hop, r.source, r.target) for r in retrieval.neighborhood(s, e, v, **kw).collect()}


def test_neighborhood(spark):
    assert hood(spark, ["A"], [("A", "B", 1), ("B", "C", 1)], hops=1) == {(1, "A", "B")}
    assert hood(spark, ["A"], [("A", "B", 1), ("B", "C", 1)], hops=2) == {(1, "A", "B"), (2, "B", "C")}
    assert hood(spark, ["C"], [("E", "S", 1)], same=[("C", "E")], hops=1) == {(1, "E", "S")}
    fan = [("A", "B", 1)] + [("B", f"P{i}", i) for i in range(5)]
    assert hood(spark, ["A"], fan, hops=2, cap=2) == {(1, "A", "B"), (2, "B", "P4"), (2, "B", "P3")}
    assert hood(spark, ["A"], [("A", "A", 1)], hops=2) == {(1, "A", "A")}
    assert hood(spark, ["X"], fan, hops=2) == set() and hood(spark, [], fan) == set()


def test_neighborhood_against_model(spark):
    import random

    rng = random.Random(4)
    names = [f"n{i:02d}" for i in range(14)]
    edges = sorted({(rng.choice(names), rng.choice(names)) for _ in range(24)})
    seen, frontier, visited, want = set(), {"n00"}, {"n00"}, set()
    for hop in (1, 2):
        found = {e for e in edges if e not in seen and (e[0] in frontier or e[1] in frontier)}
        seen |= found
        want |= {(hop, *e) for e in found}
        nxt = set()
        for a, b in found:
            node = min(n for n in (a, b) if n in frontier)
            nxt.add(b if a == node else a)
        frontier = nxt - visited
        visited |= frontier
    assert hood(spark, ["n00"], [(*e, 1) for e in edges], hops=2, cap=100) == want


def test_link_spans(spark):
    nodes = spark.createDataFrame([("Roman citizenship", "Concept"), ("roman  Citizenship!", "Law"), ("Rome", "Place")], "name string, type string")
    spans = spark.createDataFrame([(1, "Roman citizenship"), (1, "nobody"), (1, None), (1, "  ")], "query_id bigint, span string")
    assert {r.name for r in retrieval.link_spans(spans, nodes).collect()} == {"Roman citizenship", "roman  Citizenship!"}


def test_graph_only_and_context(spark):
    passages = spark.createDataFrame([(1, "1:0", "T", "x", 1), (1, "2:0", "U", "y", 2)], "query_id bigint, chunk_id string, title string, text string, rank int")
    hits = spark.createDataFrame([(1, "T")], "query_id bigint, title string")
    only = retrieval.graph_only(passages, hits)
    assert [r.chunk_id for r in only.collect()] == ["2:0"]
    assert retrieval.context_block(passages, 3).first().context == "[3] (T) x\n\n[4] (U) y"
    assert [r.line for r in retrieval.source_lines(passages, only).orderBy("rank").collect()] == ["  [1] T (1:0)", "  [2] U (2:0)  <- graph-only"]


def test_dense_order(spark):
    df = spark.createDataFrame([(i * 7 % 50,) for i in range(50)], "x bigint").repartition(6)
    assert all(r.ord == r.x + 1 for r in ordering.dense_order(df, ["x"]).collect())
    assert ordering.dense_order(df.limit(0), ["x"]).count() == 0


@pytest.mark.parametrize("bound", [12, 1000])
def test_components(spark, bound):
    links = [("a", "b"), ("b", "c"), ("x", "y"), ("z", "z")] + [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(30)]
    got = {r.id: r.label for r in component_labels(spark.createDataFrame(links, "a string, b string"), bound).collect()}
    assert got["c"] == "a" and got["y"] == "x" and got["z"] == "z" and got["p030"] == "p000"


def test_claims_in_order(spark):
    # B and C reach the shared edge; B takes its best two, and C's cap isn't used up by what B took
    edges = [("A", "B", 1), ("A", "C", 1), ("B", "C", 9), ("B", "X", 8), ("C", "Y", 7), ("C", "Z", 6)]
    assert hood(spark, ["A"], edges, hops=2, cap=2) == {(1, "A", "B"), (1, "A", "C"), (2, "B", "C"), (2, "B", "X"), (2, "C", "Y"), (2, "C", "Z")}
    assert hood(spark, ["A"], edges, hops=2, cap=2, in_order=False) == {(1, "A", "B"), (1, "A", "C"), (2, "B", "C"), (2, "B", "X"), (2, "C", "Y")}


def test_hit_lines(spark):
    df = spark.createDataFrame([(1, 1, "1:0", "T", "a \n b", 0.12345, "V")], "query_id bigint, rank int, chunk_id string, title string, text string, score double, found_by string")
    assert retrieval.hit_lines(df, 4, 180, found_by=True).first()[2:] == ("[0.1235] [  V] T  (1:0)", "    a b...") or retrieval.hit_lines(df).first().head == "[0.123] T  (1:0)"


def test_threshold_pairs_over_cells_and_blocks(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(12, 64))
    x = np.concatenate([c + rng.normal(scale=0.25, size=(30, 64)) for c in centers] + [rng.normal(size=(60, 64))])
    kinds = ["a", "b", None]
    rows = [(i, kinds[i % 3], [float(c) for c in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame([*rows, (900, "a", None), (901, "a", [0.0] * 64), (902, "a", [1.0])], "vec_id bigint, type string, vector array<float>")
    f = x.astype(np.float32).astype(np.float64)
    u = f / (np.linalg.norm(f, axis=1, keepdims=True) + 1e-9)
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(u @ u.T >= 0.9, 1)), strict=True) if i % 3 == j % 3}
    for block, pivots in ((7, 40), (50, 6), (4_000, 256)):
        got = [(r.a, r.b) for r in similarity.threshold_pairs(df, block=block, pivots=pivots).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert similarity.threshold_pairs(df.limit(0)).count() == 0


def test_first_unscored(spark):
    scored = [(1, o) for o in (1, 2, 4, 7, 8)] + [(2, 3)]
    asked = spark.createDataFrame([(1,), (2,), (3,)], "query_id bigint")
    got = keyword.first_unscored(asked, spark.createDataFrame(scored, "query_id bigint, ord bigint"), 4).collect()
    assert sorted(tuple(r) for r in got) == [(1, 3), (1, 5), (1, 6), (1, 9), (2, 1), (2, 2), (2, 4), (2, 5), (3, 1), (3, 2), (3, 3), (3, 4)]


def test_keyword_search_has_no_nested_loop(spark):
    docs = spark.createDataFrame([(f"{i}:0", "road stone", i + 1) for i in range(5)] + [("9:0", "toll", 6)], "chunk_id string, text string, ord bigint")
    out = keyword.bm25_topk(docs, spark.createDataFrame([(1, "toll"), (2, ""), (3, "road road")], "query_id bigint, query string"), 3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
    got = {}
    for r in out.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    assert got[1][0] == "9:0" and got[1][1:] == ["0:0", "1:0"] and got[2] == ["0:0", "1:0", "2:0"]


def test_questions_with_a_common_word_are_no_rows_a_document(spark):
    n, asked = 3_000, 40
    docs = spark.range(n).select(F.concat("id", F.lit(":0")).alias("chunk_id"), F.concat(F.lit("of the road of w"), F.pmod("id", F.lit(97)), F.lit(" w"), F.col("id") % 61).alias("text"), (F.col("id") + 1).alias("ord"))
    queries = spark.range(asked).select(F.col("id").alias("query_id"), F.concat(F.lit("of w"), "id").alias("query"))
    tracker = spark.sparkContext._jsc.sc().statusStore()
    before = {s.stageId() for s in _stages(tracker)}
    got = {}
    for r in keyword.bm25_topk(docs, queries, 5).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.chunk_id, r.score)
    moved = [s.shuffleWriteRecords() + s.outputRecords() for s in _stages(tracker) if s.stageId() not in before]
    assert max(moved) < 2 * n  # 40 questions share "of" with 3,000 documents
    words = [f"of the road of w{i % 97} w{i % 61}".split() for i in range(n)]
    df = {w: sum(w in set(x) for x in words) for w in {w for x in words for w in x}}
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    for q in range(asked):
        part = lambda t, x: (raw[t] if raw[t] >= 0 else floor) * x.count(t) * 2.5 / (x.count(t) + 1.5)  # noqa: E731, all lengths are the average
        want = sorted((-round(sum(part(t, x) for t in ("of", f"w{q}") if t in df), 9), i) for i, x in enumerate(words))[:5]
        assert [got[q][k][0] for k in range(1, 6)] == [f"{i}:0" for _, i in want]
        assert all(abs(got[q][k][1] + s) < 1e-6 for k, (s, _) in enumerate(want, 1))


def _stages(tracker):
    found = tracker.stageList(None, False, False, spark_doubles(), None)
    return [found.apply(i) for i in range(found.size())]


def spark_doubles():
    from pyspark import SparkContext

    gateway = SparkContext._active_spark_context._gateway
    return gateway.new_array(gateway.jvm.double, 0)


def test_vector_topk_returns_few_rows_a_task(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(-2, 3, size=(4_000, 4)).astype(float)
    x[np.all(x == 0, axis=1)] = 1.0
    t = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, vector array<double>").coalesce(1)
    q = t.where("vec_id % 400 = 0").select(F.col("vec_id").alias("query_id"), "vector")
    hits = list(similarity._local_topk(np.arange(10), similarity._matrix(x[::400]), 5)(iter([b for at in range(0, 4_000, 500) for b in _batches(x, at)])))
    assert sum(b.num_rows for b in hits) == 60  # 5 and one more for each of 10 questions, whatever ties
    got = {(r.query_id, r["rank"]): r.id for r in similarity.vector_topk(t, q, 5, dim=4).collect()}
    u = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-9)
    for i in range(0, 4_000, 400):
        s = np.round(u @ u[i], 9)
        want = [j for j in np.lexsort((np.arange(4_000), -s)) if j != i][:5]
        assert [got[i, k] for k in range(1, 6)] == want


def _batches(x, at):
    import pyarrow as pa

    part = x[at : at + 500]
    return [pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(part))), pa.array(part.tolist(), pa.list_(pa.float64()))], names=["id", "v"])]


def test_rerank_of_a_question_whose_words_cancel_out(spark, compare, tmp_path):
    from amphora.plans.catalog import QUERIES, SQL

    chunks = [("100:0", 100, 0, "Lex Medazebonia", "Lex Medazebonia was a law."), ("200:0", 200, 0, "Road tolls", "Road tolls were paid in coin."), ("300:0", 300, 0, "Lex", "Lex Medazebonia")]
    spark.createDataFrame(chunks, "chunk_id string, pageid bigint, chunk_index int, title string, text string").coalesce(1).toPandas().to_parquet(tmp_path / "chunks.parquet")
    spark.createDataFrame([(c[1], c[3]) for c in chunks], "pageid bigint, title string").toPandas().to_parquet(tmp_path / "corpus.parquet")
    got, want = compare(spark, QUERIES["rerank"], SQL["rerank"], tmp_path)
    assert got == want and {r[1] for r in got} == {"200", "300"}  # the two words of question 100 have one place and opposite signs
