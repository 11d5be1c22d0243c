import json

import pytest
from pyspark.sql import functions as F

from amphora.providers import model as M
from amphora.providers.embedder import FunctionEmbedder, HashingEmbedder
from amphora.sources import files, wiki
from amphora.streaming import resume

CHUNK = "chunk_id string, title string, text string"
TEXT = "Mavricor Quto Zhola led Siege of Qudabo near Lex Meda Tro."


class Flaky(M.RuleModel):
    def __init__(self, bad):
        self.left = bad

    def complete(self, prompt, task, temperature):
        self.left -= 1
        return "no json" if self.left >= 0 else super().complete(prompt, task, temperature)


def broken():
    class Broken(M.RuleModel):  # local, so that it travels to the workers by value
        def complete(self, prompt, task, temperature):
            raise RuntimeError("down")

    return Broken


def test_retries():
    assert "entities" in M.ask_json(Flaky(2), TEXT, "entities")
    with pytest.raises(json.JSONDecodeError):
        M.ask_json(Flaky(3), TEXT, "entities")
    with pytest.raises(RuntimeError):
        M.ask_json(broken()(), TEXT, "entities")


def test_throttle():
    now, slept = [0.0], []
    t = M.Throttle(60, clock=lambda: now[0], sleep=slept.append)
    for _ in range(3):
        t.wait()
    assert slept == [1.0, 2.0]


def test_stream_join():
    assert M.join_stream(iter(['{"response": "a"}', "", '{"response": "b", "done": true}', '{"response": "c"}'])) == "ab"


def test_extract(spark):
    df = spark.createDataFrame([("1:0", "t", TEXT), ("2:0", "t", "nothing"), ("3:0", "t", None)], CHUNK)
    got = {r.chunk_id: r for r in M.extract(df).collect()}
    assert {e.type for e in got["1:0"].entities} == {"Person", "Event", "Law"} and got["1:0"].relations and not got["2:0"].relations and "3:0" not in got


def test_decide_and_spans(spark):
    df = spark.createDataFrame([("Person", "A B", "B, A", "A: A B\nB: B, A"), ("Person", "A", "C", "A: A\nB: C")], "type string, a_name string, b_name string, prompt string")
    assert {(r.b_name, r.same) for r in M.decide_same(df).collect()} == {("B, A", True), ("C", False)}
    q = spark.createDataFrame([(1, "Who was Mavricor Quto?")], "query_id bigint, query string")
    assert [r.span for r in M.query_entities(q).collect()] == ["Mavricor Quto"] or M.query_entities(q).count() == 1
    assert M.answer(spark.createDataFrame([(1, "p")], "query_id bigint, prompt string")).first().answer


def test_resume(spark, tmp_path):
    out = str(tmp_path / "out")
    df = spark.createDataFrame([(f"{i}:0", "t", TEXT) for i in range(3)], CHUNK)
    sums = lambda c: (c.pending, c.successes, c.failures, c.entities, c.relations)
    assert sums(resume.run_batch(df.limit(2), out)) == (2, 2, 0, 6, 2)
    seen = []
    assert sums(resume.run_batch(df, out, part=1, progress=lambda c: seen.append(c.successes))) == (1, 1, 0, 3, 1) and seen == [1]
    assert sums(resume.run_batch(df, out)) == (0, 0, 0, 0, 0)
    assert resume.progress_of(spark, out, chunks=df) == (3, 3) and resume.progress_of(spark, out + "-none", 7) == (0, 7)
    assert files.done_ids(spark, out).count() == 3 and files.read_extractions(spark, out).count() == 3
    with pytest.raises(resume.NothingWorks):
        resume.run_batch(spark.createDataFrame([(f"x{i}", "t", TEXT) for i in range(3)], CHUNK), out, broken(), limit=3)


def test_stream(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("src", "out", "mark"))
    for n in (2, 4):
        spark.createDataFrame([(f"{i}:0", "t", TEXT) for i in range(n)], CHUNK).write.mode("append").json(src)
        resume.stream_extraction(spark, src, CHUNK, out, mark)
        assert files.read_extractions(spark, out).select("chunk_id").distinct().count() == n == files.read_extractions(spark, out).count()


def test_decisions(spark, tmp_path):
    out = str(tmp_path / "d")
    df = spark.createDataFrame([("Person", "A B", "B, A", "A: A B\nB: B, A")], "type string, a_name string, b_name string, prompt string")
    first, again = resume.run_decisions(df, out), resume.run_decisions(df, out)
    assert (first.successes, first.failures, first.confirmed, again.pending) == (1, 0, 1, 0)
    assert files.decisions(spark, out).first().same


def test_drive():
    n = [0]

    def run():
        n[0] += 1

    assert resume.drive(run, lambda: n[0], 3, sleep=lambda s: None)
    assert not resume.drive(lambda: None, lambda: 1, 3, sleep=lambda s: None)


def test_files(spark, tmp_path):
    assert files.done_ids(spark, str(tmp_path / "none")).count() == 0 and files.decisions(spark, str(tmp_path / "none")).count() == 0
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"pageid": 1}\nnot json\n')
    with pytest.raises(Exception, match=r"(?i)malformed|parse"):
        files.read_corpus(spark, str(bad)).collect()
    path = str(tmp_path / "vectors")
    chunks = spark.createDataFrame([("1:0", "t", "a b")], CHUNK)
    files.rebuild_vectors(chunks, HashingEmbedder(8).column(F.col("text")), path)
    assert len(spark.read.parquet(path).first().vector) == 8


def test_function_embedder(spark):
    e = FunctionEmbedder(lambda: lambda texts, mode: [[float(len(t)), 1.0] for t in texts], 2)
    got = spark.createDataFrame([("abc",), (None,)], "t string").select(e.column(F.col("t"), "query").alias("v")).collect()
    assert [list(r.v) for r in got] == [[3.0, 1.0], [0.0, 1.0]]


def test_wiki_source(spark, tmp_path):
    page = {"query": {"pages": [{"pageid": 5, "title": "T", "extract": "Text", "categories": [{"title": "Category:Cities"}]}]}}
    (tmp_path / "a.json").write_text(json.dumps(page))
    (tmp_path / "b.json").write_text(json.dumps({"query": {"pages": [{"title": "none", "missing": True}]}}))
    spark.dataSource.register(wiki.WikiPages)
    rows = spark.read.format("wiki_pages").option("folder", str(tmp_path)).load().collect()
    assert [(r.pageid, r.categories, r.text) for r in rows] == [(5, ["Cities"], "Text")]
    tries = []

    def fail():
        tries.append(1)
        raise OSError("net")

    with pytest.raises(OSError, match="net"):
        wiki.with_retries(fail, sleep=lambda s: None)
    assert len(tries) == 3


def test_parse_reply(spark):
    from amphora.providers.prompts import parse_reply

    df = spark.createDataFrame([('{"same": true, "canonical_name": "A"}',), ("no json",)], "x string").select(parse_reply(F.col("x"), "same").alias("y")).collect()
    assert df[0].y.same and df[1].y is None or df[1].y.same is None


def test_stored_graph(spark, tmp_path):
    from amphora.schema import EXTRACTION
    from amphora.streaming import graph_tables as gt

    path = str(tmp_path / "graph")
    ent = lambda *x: [(n, t, "") for n, t in x]
    one = spark.createDataFrame([("1:0", "t", ent(("Rome", "Place"), ("Nero", "Person"), ("Rome", "Organization")), [("Nero", "RULED", "Rome", "d"), ("Nero", "RULED", "Nobody", "d"), ("Nero", "ATE", "Rome", "d")])], EXTRACTION)
    two = spark.createDataFrame([("2:0", "t", ent(("Rome", "Place"), ("NERO", "Person")), [])], EXTRACTION)
    assert tuple(gt.load_records(one, path).first()) == (3, 1, 2)
    for records in (two, one):
        gt.load_records(records, path)
    nodes = {(r.name, r.type, r.chunk_id) for r in gt.read(spark, f"{path}/node_chunks", "name string, type string, chunk_id string, seen bigint").collect()}
    assert nodes == {("Rome", "Place", "1:0"), ("Rome", "Place", "2:0"), ("Rome", "Organization", "1:0"), ("Nero", "Person", "1:0"), ("NERO", "Person", "2:0")}
    edges = gt.read(spark, f"{path}/edge_chunks", "source string, target_type string, chunk_id string").collect()
    assert [(r.source, r.target_type, r.chunk_id) for r in edges] == [("Nero", "Organization", "1:0")]
    link = "a_name string, a_type string, b_name string, b_type string, canonical string"
    for rows in ([("Nero", "Person", "NERO", "Person", "Nero")], [("NERO", "Person", "Nero", "Person", "Nero Claudius"), ("Nero", "Person", "Ghost", "Person", "x")]):
        gt.link_same_as(spark.createDataFrame(rows, link), path)
    assert [tuple(r) for r in gt.read(spark, f"{path}/same_as", link).collect()] == [("NERO", "Person", "Nero", "Person", "Nero Claudius")]
    assert gt.newest(spark, f"{path}/node_chunks") == 3


def test_replies_of_finished_parts_are_kept(spark, tmp_path):
    def half():
        class Half(M.RuleModel):
            def complete(self, prompt, task, temperature):
                if "poison" in prompt:
                    raise RuntimeError("down")
                return super().complete(prompt, task, temperature)

        return Half

    out = str(tmp_path / "out")
    df = spark.createDataFrame([(f"{i}:0", "t", TEXT if i % 2 else "poison " + TEXT) for i in range(8)], CHUNK)
    done = resume.run_batch(df, out, half(), part=2, per_minute=None)
    assert (done.successes, done.failures) == (4, 4) and files.done_ids(spark, out).count() == 4


def test_a_task_stops_asking_when_nothing_works(spark):
    df = spark.createDataFrame([(f"{i}:0", "t", TEXT) for i in range(9)], CHUNK).coalesce(1)
    failures = [r.failure for r in M.extract(df, broken(), limit=3).collect()]
    assert sum(f == M.SKIPPED for f in failures) == 6


def test_rate_is_shared_by_the_tasks(spark):
    rows = spark.range(40).repartition(5)
    assert M._share(rows, 450, None)[1] == 90 and M._share(rows, 450, 2)[1] == 225 and M._share(rows, None, 2)[1] is None


def test_relations_among_distinct_names():
    asked = []

    class Listens(M.RuleModel):
        takes_schema = True

        def complete(self, prompt, task, temperature, schema=None):
            asked.append((task, prompt, schema))
            if task == "entities":
                return json.dumps({"entities": [{"name": n, "type": t, "description": ""} for n, t in (("B", "Person"), ("A", "Place"), ("B", "Event"), (" ", "Law"))]})
            return json.dumps({"relations": []})

    row = M.extract_one(Listens(), "1:0", "t", "text")
    assert len(row["entities"]) == 4 and row["failure"] is None
    task, prompt, schema = asked[1]
    ends = schema["properties"]["relations"]["items"]["properties"]
    assert task == "relations" and "- B — Person\n- A — Place\nPassage" in prompt and ends["source"]["enum"] == ends["target"]["enum"] == ["B", "A"]


def test_reply_schemas():
    from amphora.providers.prompts import keeps_to, reply_schema

    rel = {"source": "A", "relation": "RULED", "target": "B", "description": "d"}
    schema = reply_schema("relations", ["A", "B"])
    assert keeps_to({"relations": [rel]}, schema) and not keeps_to({"relations": [rel | {"target": "C"}]}, schema) and not keeps_to({"relations": [rel | {"more": "x"}]}, schema)
    assert keeps_to({"entities": [{"name": "A", "type": "Person", "description": ""}]}, reply_schema("entities")) and not keeps_to({"entities": [{"name": "A", "type": "Ship", "description": ""}]}, reply_schema("entities"))
    assert keeps_to({"same": True, "canonical_name": ""}, reply_schema("same")) and not keeps_to({"same": "yes", "canonical_name": ""}, reply_schema("same"))
    assert keeps_to({"entities": ["A"]}, reply_schema("query_entities"))


def test_models_over_http():
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append(body)
            if self.path == "/gone":
                self.send_error(404)
                return
            if self.path == "/chat" and len(seen) == 1:
                self.send_error(503)
                return
            self.send_response(200)
            self.end_headers()
            if self.path == "/chat":
                self.wfile.write(json.dumps({"choices": [{"message": {"content": '{"entities": []}'}}]}).encode())
            else:
                self.wfile.write(b'{"response": "It "}\n\n{"response": "rains.", "done": true}\n')

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    try:
        assert M.ask_json(M.HttpModel(f"{at}/chat", "m"), "p", "entities") == {"entities": []}
        assert len(seen) == 2 and seen[1]["response_format"]["json_schema"]["strict"] is True
        pieces = []
        assert M.LocalModel(f"{at}/generate", "m", stream=True, on_piece=pieces.append).complete("p", "answer", 0.0) == "It rains." and pieces == ["It ", "rains."]
        with pytest.raises(M.Unreachable, match="404"):
            M.LocalModel(f"{at}/gone", "m").complete("p", "answer", 0.0)
        with pytest.raises(M.Unreachable):
            M.post_json("http://127.0.0.1:9/none", {}, retries=1, sleep=lambda s: None)
    finally:
        server.shutdown()


def test_wiki_links_and_assembly(spark):
    links = [{"ns": 0, "exists": True, "title": "Aqueduct"}, {"ns": 0, "exists": True, "title": "List of mints"}, {"ns": 1, "exists": True, "title": "Talk"}, {"ns": 0, "title": "Red link"}, {"ns": 0, "exists": True, "title": "Ara (disambiguation)"}, {"ns": 0, "exists": True, "title": "Forum"}]
    assert wiki.linked_titles({"parse": {"links": links}}) == ["Aqueduct", "Forum"] and wiki.linked_titles({}) == []
    assert wiki.article_of({"query": {"pages": [{"pageid": 5, "title": "T", "extract": "Text"}]}})[2].endswith("/?curid=5")
    rows = [(5, "A", "== Baths ==\nHot.\n== Notes ==\nx", 2), (5, "B", "later", 3), (6, "C", "== References ==\nonly", 1), (7, "D", "Text", 4), (8, "E", "Text", 5)]
    got = wiki.assemble(spark.createDataFrame(rows, "pageid bigint, title string, text string, n int"), ["n"], 2).collect()
    assert [(r.pageid, r.title, r.text) for r in got] == [(5, "A", "Baths\nHot."), (7, "D", "Text")]


def test_first_sight_inside_a_load_and_relinking(spark, tmp_path):
    from amphora.schema import EXTRACTION
    from amphora.streaming import graph_tables as gt

    path, out = str(tmp_path / "graph"), str(tmp_path / "decisions")
    records = [(f"{p}:{i}", "t", [("Rome", "Place", f"{p}:{i}"), ("ROME", "Place", "")], []) for p in (10, 9) for i in (11, 2)]
    gt.load_records(spark.createDataFrame(records, EXTRACTION), path)
    rows = gt.read(spark, f"{path}/node_chunks", "name string, type string, chunk_id string, seen bigint").where("name = 'Rome'").orderBy("seen").collect()
    assert [r.chunk_id for r in rows] == ["9:2", "9:11", "10:2", "10:11"]
    df = spark.createDataFrame([("Place", "ROME", "Rome", "A: ROME\nB: Rome")], "type string, a_name string, b_name string, prompt string")
    resume.run_decisions(df, out)
    link = "a_name string, a_type string, b_name string, b_type string"
    assert gt.read(spark, f"{path}/same_as", link).count() == 0
    resume.run_decisions(df, out, graph=path)  # nothing is pending, all confirmed decisions are linked
    assert [tuple(r) for r in gt.read(spark, f"{path}/same_as", link).collect()] == [("ROME", "Place", "Rome", "Place")]


def test_scratch_removes_what_was_written_inside(spark):
    from amphora.session import keep, materialize, scratch

    with scratch():
        gone, kept = materialize(spark.range(3)), keep(materialize(spark.range(4)))
        assert gone.count() == 3
    assert not files.exists(spark, gone._amphora_path) and kept.count() == 4


def test_index_is_built_once_for_a_version(spark, tmp_path):
    from amphora.sources import index

    path = str(tmp_path / "chunks.parquet")
    chunk = "chunk_id string, pageid bigint, chunk_index int, title string, text string"
    rows = [("2:0", 2, 0, "t", "road stone"), ("1:0", 1, 0, "t", "toll"), ("1:0", 1, 0, "t", "toll"), ("3:0", 3, 0, "t", None)]
    spark.createDataFrame(rows, chunk).write.parquet(path)
    vector = HashingEmbedder(8).column(F.col("text"))
    first = index.chunk_index(spark, path, vector)
    assert index.chunk_index(spark, path, vector) is first and [(r.chunk_id, r.ord) for r in first.docs.orderBy("ord").collect()] == [("1:0", 1), ("2:0", 2)]
    spark.createDataFrame([("4:0", 4, 0, "t", "mill")], chunk).write.mode("append").parquet(path)
    again = index.chunk_index(spark, path, vector)
    assert again is not first and again.docs.count() == 3 and again.averages.first().n == 3
