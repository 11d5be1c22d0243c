"""Every core query over the tables of a folder, and its SQL equivalent."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amphora.functions import text as T
from amphora.operators import chunking, fusion, graph, keyword, ordering, resolve, retrieval, similarity
from amphora.providers import prompts as P
from amphora.providers.embedder import HashingEmbedder
from amphora.schema import CHUNK_OVERLAP, CHUNK_SIZE, NODE_TYPES, RELATION_TYPES, THETA, allowed_triples, node_types_block, vocabulary_block
from amphora.session import load, materialize, spread
from amphora.sources.index import ChunkIndex, chunk_index

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        def run(spark: SparkSession, d: str) -> DataFrame:
            out = f(spark, d)
            return out.withColumns({c: F.col(c).cast("bigint") for c, t in out.dtypes if t == "int" and c in ("rank", "ord")})

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- pieces of SQL ----
W = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
WORDS = r"[\p{L}\p{N}_]+"


def s_strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{W}+|{W}+$', '', 'g')"


def s_collapse(x: str) -> str:
    return s_strip(rf"regexp_replace({x}, '{W}+', ' ', 'g')")


def s_norm(x: str) -> str:
    not_word = r"[^\p{L}\p{N}_" + W[1:]
    return "lower(" + s_collapse(rf"regexp_replace({x}, '{not_word}', ' ', 'g')") + ")"


def s_cos(a: str, b: str) -> str:
    return f"list_dot_product({a}, {b}) / ((sqrt(list_dot_product({a}, {a})) + 1e-9) * (sqrt(list_dot_product({b}, {b})) + 1e-9))"


def s_list(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


S_DOCS = """docs AS (SELECT chunk_id, min(pageid) AS pageid, min(chunk_index) AS chunk_index, min(title) AS title, min(text) AS text
    FROM chunks WHERE text IS NOT NULL AND chunk_id IS NOT NULL GROUP BY chunk_id),
doc AS (SELECT *, row_number() OVER (ORDER BY pageid, chunk_index, chunk_id) AS ord FROM docs)"""
S_ASK = "ask AS (SELECT pageid AS query_id, min(title) AS query FROM corpus WHERE pageid % 100 = 0 AND title IS NOT NULL GROUP BY pageid)"
S_BM25 = rf"""{S_DOCS}, {S_ASK},
tok AS (SELECT chunk_id, ord, unnest(regexp_extract_all(lower(text), '{WORDS}')) AS term FROM doc),
len AS (SELECT chunk_id, ord, len(regexp_extract_all(lower(text), '{WORDS}')) AS length FROM doc),
st AS (SELECT count(*) AS n, avg(length) AS avgdl FROM len),
tf AS (SELECT chunk_id, term, count(*) AS tf FROM tok GROUP BY ALL),
raw AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS raw FROM tf, st GROUP BY term),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN (SELECT avg(raw) * 0.25::DOUBLE FROM raw) ELSE raw END AS idf FROM raw),
qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(regexp_extract_all(lower(query), '{WORDS}')) AS term FROM ask) GROUP BY ALL),
sc AS (SELECT query_id, chunk_id, sum(times * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / avgdl))) AS s
    FROM qt JOIN tf USING (term) JOIN idf USING (term) JOIN len USING (chunk_id), st GROUP BY ALL),
kw AS (SELECT query_id, chunk_id, title, score, rank FROM (SELECT a.query_id, d.chunk_id, d.title, round(coalesce(s, 0), 9) AS score,
    row_number() OVER (PARTITION BY a.query_id ORDER BY round(coalesce(s, 0), 9) DESC, d.ord) AS rank FROM ask a CROSS JOIN doc d LEFT JOIN sc ON sc.query_id = a.query_id AND sc.chunk_id = d.chunk_id) WHERE rank <= 30)"""
S_EMBED = rf"""_D AS (SELECT _K, (16 * strpos('0123456789abcdef', md5(w)[1]) + strpos('0123456789abcdef', md5(w)[2]) - 17) % 64 AS dim, CASE WHEN strpos('01234567', md5(w)[3]) > 0 THEN 1 ELSE -1 END AS x
    FROM (SELECT _K, unnest(regexp_extract_all(lower(_T), '{WORDS}')) AS w FROM _F)),
_V AS (SELECT _K, dim, sum(x)::DOUBLE AS x FROM _D GROUP BY ALL),
_N AS (SELECT _K, sqrt(sum(x * x)) + 1e-9 AS norm FROM _V GROUP BY _K HAVING sum(x * x) > 0)"""


def s_embed(prefix: str, key: str, text: str, table: str) -> str:
    return S_EMBED.replace("_D", f"{prefix}d").replace("_V", f"{prefix}v").replace("_N", f"{prefix}n").replace("_K", key).replace("_T", text).replace("_F", table)


S_COSINES = f"""{s_embed('q', 'query_id', 'query', 'ask')}, {s_embed('c', 'chunk_id', 'text', 'doc')},
dots AS (SELECT query_id, chunk_id, sum(a.x * b.x) AS dot FROM qv a JOIN cv b USING (dim) GROUP BY ALL),
cosn AS (SELECT query_id, chunk_id, round(coalesce(dot, 0) / (qn.norm * cn.norm), 9) AS score FROM qn CROSS JOIN cn LEFT JOIN dots USING (query_id, chunk_id))"""
S_VHITS = f"""{S_COSINES},
vh AS (SELECT query_id, chunk_id, title, score, rank FROM (SELECT query_id, chunk_id, d.title, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, d.ord) AS rank FROM cosn JOIN doc d USING (chunk_id)) WHERE rank <= 30)"""
S_HYBRID = f"""{S_BM25}, {S_VHITS},
li AS (SELECT query_id, chunk_id, rank, 'V' AS l FROM vh UNION ALL SELECT query_id, chunk_id, rank, 'B' FROM kw),
fu AS (SELECT query_id, chunk_id, round(sum(1 / (60 + rank)::DOUBLE), 12) AS score, CASE WHEN bool_or(l = 'V') AND bool_or(l = 'B') THEN 'V+B' WHEN bool_or(l = 'V') THEN 'V' ELSE 'B' END AS found_by
    FROM li GROUP BY ALL),
hy AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM fu) WHERE rank <= 5)"""
S_VALID = f"""men AS (SELECT * REPLACE ({s_strip("replace(coalesce(name, ''), chr(34), '')")} AS name) FROM extractions),
valid AS (SELECT * FROM men WHERE name <> '' AND type IN ({s_list(NODE_TYPES)})),
decl AS (SELECT chunk_id, name, max_by(type, ord::BIGINT * 1000000000000 + mention_id) AS type FROM valid GROUP BY ALL),
ends AS (SELECT r.*, s.type AS source_type, t.type AS target_type FROM relations r
    LEFT JOIN decl s ON s.chunk_id = r.chunk_id AND s.name = {s_strip("replace(coalesce(r.source, ''), chr(34), '')")}
    LEFT JOIN decl t ON t.chunk_id = r.chunk_id AND t.name = {s_strip("replace(coalesce(r.target, ''), chr(34), '')")}),
judged AS (SELECT *, CASE WHEN relation IS NULL OR relation NOT IN ({s_list(list(RELATION_TYPES))}) THEN 'unknown relation type' WHEN source_type IS NULL OR target_type IS NULL THEN 'endpoint not declared'
    WHEN (relation || '>' || source_type || '>' || target_type) NOT IN ({s_list(['>'.join(t) for t in allowed_triples()])}) THEN 'endpoint type violates schema' END AS reason FROM ends),
rel AS (SELECT * REPLACE ({s_strip("replace(coalesce(source, ''), chr(34), '')")} AS source, {s_strip("replace(coalesce(target, ''), chr(34), '')")} AS target) FROM judged WHERE reason IS NULL),
node AS (SELECT DISTINCT name, type FROM valid),
edge AS (SELECT source, source_type, relation, target, target_type, count(DISTINCT chunk_id) AS chunks, count(DISTINCT coalesce(description, '')) AS descriptions, min_by(coalesce(description, ''), relation_id) AS first_description FROM rel GROUP BY ALL)"""
S_DEGREE = """deg AS (SELECT name, type, count(e.n) AS degree FROM node LEFT JOIN (SELECT source AS n, source_type AS t FROM edge UNION ALL SELECT target, target_type FROM edge WHERE source <> target OR source_type <> target_type) e
    ON e.n = name AND e.t = type GROUP BY ALL)"""
S_BLOCK = f"""tk AS (SELECT DISTINCT name, type, unnest(list_filter(string_split({s_norm('name')}, ' '), lambda w: w <> '' AND w NOT IN ({s_list(T.NAME_STOPWORDS)}))) AS token FROM node),
bl AS (SELECT type, token FROM tk GROUP BY ALL HAVING count(*) BETWEEN 2 AND 5),
np AS (SELECT DISTINCT a.type, a.name AS a_name, b.name AS b_name FROM bl JOIN tk a USING (type, token) JOIN tk b USING (type, token) WHERE a.name < b.name)"""
S_EMB = f"""nv AS (SELECT vec_id, coalesce(type, '') AS type, name, list_transform(vector, lambda x: x::DOUBLE) AS v FROM node_vectors WHERE len(vector) = 64 AND list_max(list_transform(vector, lambda x: abs(x))) > 0),
ep AS (SELECT DISTINCT a.type, least(a.name, b.name) AS a_name, greatest(a.name, b.name) AS b_name FROM nv a JOIN nv b ON a.type = b.type AND a.vec_id < b.vec_id
    WHERE {s_cos('a.v', 'b.v')} >= 0.9::DOUBLE AND a.name <> b.name)"""
S_CAND = f"""{S_VALID}, {S_DEGREE}, {S_BLOCK}, {S_EMB},
hub AS (SELECT name, type FROM deg WHERE degree >= 2),
cand AS (SELECT * FROM (SELECT * FROM np UNION SELECT * FROM ep) p WHERE EXISTS (SELECT 1 FROM hub h WHERE h.type = p.type AND (h.name = p.a_name OR h.name = p.b_name)))"""
S_DECIDED = """two AS (SELECT list_sort(pair) AS p, same, canonical, decided_at, decision_id FROM resolutions WHERE len(pair) = 2 AND len(pair[1]) = 2 AND len(pair[2]) = 2),
decided AS (SELECT p[1][1] AS a_name, p[1][2] AS a_type, p[2][1] AS b_name, p[2][2] AS b_type, same, canonical, decided_at, decision_id FROM two)"""
S_SAME = f"""{S_DECIDED},
lnk AS (SELECT a_name, a_type, b_name, b_type, max_by(row(canonical), row(coalesce(decided_at, TIMESTAMP '0001-01-01'), decision_id)) AS canonical FROM decided
    WHERE same AND NOT (a_name = b_name AND a_type = b_type) GROUP BY ALL),
sa AS (SELECT * FROM lnk WHERE EXISTS (SELECT 1 FROM node n WHERE n.name = a_name AND n.type = a_type) AND EXISTS (SELECT 1 FROM node n WHERE n.name = b_name AND n.type = b_type))"""
S_LABEL = """ln AS (SELECT a_name || chr(1) || a_type AS a, b_name || chr(1) || b_type AS b FROM sa),
ln2 AS (SELECT a, b FROM ln UNION SELECT b, a FROM ln),
reach AS (SELECT a, a AS b FROM ln2 UNION SELECT reach.a, ln2.b FROM reach JOIN ln2 ON reach.b = ln2.a),
lab AS (SELECT a AS node, min(b) AS label FROM reach GROUP BY a)"""
S_SEEDS = f"seeds AS (SELECT DISTINCT query_id, name, type FROM ask JOIN node ON {s_norm('query')} = {s_norm('name')} WHERE {s_norm('query')} <> '')"
S_HOPS = """ke AS (SELECT e.*, source || chr(1) || source_type AS s, target || chr(1) || target_type AS t, source || chr(1) || source_type || chr(1) || relation || chr(1) || target || chr(1) || target_type AS edge FROM edge e),
kl AS (SELECT ke.*, coalesce(x.label, s) AS sl, coalesce(y.label, t) AS tl FROM ke LEFT JOIN lab x ON x.node = s LEFT JOIN lab y ON y.node = t),
inc AS (SELECT edge, chunks, sl AS near, t AS other FROM kl UNION ALL SELECT edge, chunks, tl, s FROM kl WHERE sl <> tl),
f1 AS (SELECT DISTINCT query_id, name || chr(1) || type AS node FROM seeds),
h1 AS (SELECT query_id, i.edge, min(f.node) AS node, min_by(other, f.node) AS other, any_value(chunks) AS chunks, 1 AS hop FROM f1 f LEFT JOIN lab l ON l.node = f.node JOIN inc i ON i.near = coalesce(l.label, f.node) GROUP BY query_id, i.edge),
f2 AS (SELECT DISTINCT query_id, other AS node FROM h1 WHERE (query_id, other) NOT IN (SELECT query_id, node FROM f1)),
c2 AS (SELECT query_id, f.node, i.edge, other, chunks, row_number() OVER (PARTITION BY query_id, f.node ORDER BY chunks DESC, i.edge) AS k
    FROM f2 f LEFT JOIN lab l ON l.node = f.node JOIN inc i ON i.near = coalesce(l.label, f.node) WHERE (query_id, i.edge) NOT IN (SELECT query_id, edge FROM h1)),
h2 AS (SELECT query_id, edge, min(node) AS node, any_value(chunks) AS chunks, 2 AS hop FROM c2 WHERE k <= 10 GROUP BY query_id, edge),
nb AS (SELECT h.query_id, h.hop, h.node, h.edge, h.chunks, source, source_type, relation, target, target_type FROM (SELECT query_id, edge, node, chunks, hop FROM h1 UNION ALL SELECT query_id, edge, node, chunks, hop FROM h2) h JOIN kl USING (edge)),
ec AS (SELECT source, source_type, relation, target, target_type, chunk_id, min(relation_id) AS seen FROM rel GROUP BY ALL),
cc AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY hop, node, n, edge, seen, chunk_id) AS ord FROM (
    SELECT query_id, ec.chunk_id, nb.hop, nb.node, -nb.chunks AS n, nb.edge, seen, row_number() OVER (PARTITION BY query_id, ec.chunk_id ORDER BY nb.hop, nb.node, -nb.chunks, nb.edge, seen) AS k
    FROM nb JOIN ec USING (source, source_type, relation, target, target_type)) WHERE k = 1)"""
S_GRAPH = f"{S_VALID}, {S_SAME}, {S_LABEL}, {S_ASK}, {S_SEEDS}, {S_HOPS}"
S_RANKED = """ps AS (SELECT * FROM (SELECT cc.query_id, cc.chunk_id, d.title, d.text, row_number() OVER (PARTITION BY cc.query_id ORDER BY score DESC, cc.ord) AS rank
    FROM cc JOIN doc d USING (chunk_id) JOIN cosn USING (query_id, chunk_id)) WHERE rank <= 6)"""
S_PASS = f"{S_GRAPH}, {S_DOCS}, {S_COSINES}, {S_RANKED}"


# ---- frames that several queries share ----


_EMBEDDER = HashingEmbedder()


def _index(spark: SparkSession, d: str) -> ChunkIndex:
    return chunk_index(spark, f"{d}/chunks.parquet", _EMBEDDER.column(F.col("text"), "passage"), "hashing")


def _ask(spark: SparkSession, d: str) -> DataFrame:
    """The stated questions: the title of every article whose id is divisible by 100."""
    return load(spark, d, "corpus").where("pageid % 100 = 0 and title is not null").groupBy(F.col("pageid").alias("query_id")).agg(F.min("title").alias("query"))


def _valid(spark: SparkSession, d: str) -> DataFrame:
    return graph.valid_mentions(load(spark, d, "extractions"))


def _relations(spark: SparkSession, d: str) -> DataFrame:
    judged = graph.validate_relations(load(spark, d, "relations"), _valid(spark, d)).where("reason is null")
    return judged.withColumns({e: T.sanitize_name(F.col(e)) for e in ("source", "target")})


def _same_as(spark: SparkSession, d: str) -> DataFrame:
    return graph.same_as_links(load(spark, d, "resolutions"), graph.nodes(_valid(spark, d)))


def _keyword_hits(spark: SparkSession, d: str, k: int) -> DataFrame:
    x = _index(spark, d)
    return keyword.search(x.tokens, x.weights, x.averages, x.docs, _ask(spark, d), k).join(x.docs.select("chunk_id", "title"), "chunk_id")


def _asked_vectors(spark: SparkSession, d: str) -> DataFrame:
    return _ask(spark, d).select("query_id", _EMBEDDER.column(F.col("query"), "query").alias("vector"))


def _vector_hits(spark: SparkSession, d: str, k: int) -> DataFrame:
    x = _index(spark, d)
    hits = similarity.vector_topk(x.vectors, _asked_vectors(spark, d), k, key="ord", own_hits=True)
    return hits.join(x.docs.select(F.col("ord").alias("id"), "chunk_id", "title"), "id").select("query_id", "chunk_id", "title", "score", "rank")


def _hybrid(spark: SparkSession, d: str) -> DataFrame:
    return fusion.hybrid(_vector_hits(spark, d, 30), _keyword_hits(spark, d, 30))


@dataclass
class _Graph:
    """The graph of a folder: mentions and relations are validated once and written, and everything else reads those."""

    valid: DataFrame
    relations: DataFrame
    nodes: DataFrame
    edges: DataFrame


def _graph(spark: SparkSession, d: str) -> _Graph:
    valid = materialize(_valid(spark, d).select("chunk_id", "name", "type", "ord", "mention_id"), "valid")
    judged = graph.validate_relations(load(spark, d, "relations"), valid).where("reason is null")
    relations = materialize(judged.withColumns({e: T.sanitize_name(F.col(e)) for e in ("source", "target")}), "relations")
    return _Graph(valid, relations, graph.nodes(valid), graph.edges(relations))


def _neighborhood(spark: SparkSession, d: str, g: _Graph) -> DataFrame:
    """The form that SQL can state: every node of a frontier keeps its own best edges."""
    seeds = retrieval.link_spans(_ask(spark, d).withColumnRenamed("query", "span"), g.nodes)
    return retrieval.neighborhood(seeds, g.edges, graph.same_as_links(load(spark, d, "resolutions"), g.nodes), in_order=False)


def _rerank_rows(spark: SparkSession, d: str, candidates: DataFrame) -> DataFrame:
    """Candidates (query_id, chunk_id, ord) with the vectors of both sides; a question or chunk whose words cancel out has no direction and no rows."""
    asked = _asked_vectors(spark, d).withColumnRenamed("vector", "query_vector")
    rows = candidates.select("query_id", "chunk_id", "ord").join(_index(spark, d).vectors.select("chunk_id", "vector"), "chunk_id")
    rows = rows.join(asked, "query_id").where(similarity.usable("query_vector", _EMBEDDER.dim) & similarity.usable("vector", _EMBEDDER.dim))
    return rows.select("query_id", F.col("chunk_id").alias("id"), "ord", "query_vector", "vector")


def _passages(spark: SparkSession, d: str) -> DataFrame:
    g = _graph(spark, d)
    candidates = retrieval.candidate_chunks(_neighborhood(spark, d, g), graph.edge_chunks(g.relations))
    best = similarity.rerank(_rerank_rows(spark, d, candidates)).withColumnRenamed("id", "chunk_id")
    return best.join(_index(spark, d).docs.select("chunk_id", "title"), "chunk_id")


def _with_text(spark: SparkSession, d: str, hits: DataFrame) -> DataFrame:
    return hits.join(_index(spark, d).texts, "chunk_id")


# ---- scans and text ----


@query("SELECT pageid, title, url, array_to_string(list_transform(categories, lambda c: coalesce(c, '')), '|') AS categories, length(text) AS chars FROM corpus")
def scan_corpus(spark, d):
    return load(spark, d, "corpus").select("pageid", "title", "url", F.array_join("categories", "|", "").alias("categories"), F.length("text").cast("bigint").alias("chars"))


@query("SELECT count(*) AS articles, sum(length(text))::BIGINT AS chars FROM corpus")
def corpus_totals(spark, d):
    return load(spark, d, "corpus").agg(F.count(F.lit(1)).alias("articles"), F.sum(F.length("text")).alias("chars"))


@query("""SELECT pageid, title FROM (SELECT pageid, title, fetched_at, row_number() OVER (PARTITION BY pageid ORDER BY fetched_at NULLS FIRST, title NULLS FIRST) AS k FROM corpus WHERE pageid IS NOT NULL)
WHERE k = 1 ORDER BY fetched_at, pageid LIMIT 40""")
def dedup_first_n(spark, d):
    return ordering.first_distinct(load(spark, d, "corpus").select("pageid", "fetched_at", "title"), "pageid", ["fetched_at"], 40).select("pageid", "title")


@query(f"""SELECT pageid, title FROM corpus WHERE pageid >= 0 AND url IS NOT NULL AND NOT contains(title, '(disambiguation)')
AND NOT ({' OR '.join(f"starts_with(title, '{p}')" for p in T.SKIPPED_TITLE_PREFIXES)})""")
def link_filter(spark, d):
    c = load(spark, d, "corpus")
    return c.where(T.wanted_link(F.when(F.col("pageid") >= 0, 0).otherwise(1), F.col("url").isNotNull(), F.col("title"))).select("pageid", "title")


@query(rf"""WITH r AS (SELECT row_number() OVER () AS rid, pageid, fetched_at, title, text FROM corpus),
l AS (SELECT rid, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS line FROM r WHERE text IS NOT NULL),
h AS (SELECT rid, i, lower({s_strip(rf"regexp_extract(line, '^=={W}*([^=].*?){W}*=+{W}*$', 1)")}) AS t FROM l WHERE regexp_matches(line, '^==($|[^=])') ),
b AS (SELECT rid, i, t <> '' AND len(list_filter(list_transform(regexp_split_to_array(t, '{W}+and{W}+|{W}*[,&]{W}*'), lambda p: {s_strip('p')}), lambda p: p <> '')) > 0
    AND len(list_filter(list_transform(regexp_split_to_array(t, '{W}+and{W}+|{W}*[,&]{W}*'), lambda p: {s_strip('p')}), lambda p: p <> '' AND p NOT IN ({s_list(T.BOILERPLATE_SECTIONS)}))) = 0 AS bp FROM h),
cut AS (SELECT b.rid, min(i) AS cutat FROM b LEFT JOIN (SELECT rid, max(i) AS last FROM b WHERE NOT bp GROUP BY rid) k ON k.rid = b.rid WHERE bp AND i > coalesce(last, 0) GROUP BY b.rid),
kept AS (SELECT l.rid, string_agg(line, chr(10) ORDER BY i) AS t FROM l LEFT JOIN cut ON cut.rid = l.rid WHERE cutat IS NULL OR i < cutat GROUP BY l.rid),
c AS (SELECT rid, {s_strip(rf"regexp_replace(regexp_replace(regexp_replace(t, '(?m)^(=+){W}*(.+?){W}*=+{W}*$', '\2', 'g'), '<[a-zA-Z/][^>' || chr(10) || ']*>', '', 'g'), chr(10) || '{{3,}}', chr(10) || chr(10), 'g')")} AS t FROM kept)
SELECT pageid, fetched_at, r.title, CASE WHEN r.text IS NULL THEN NULL ELSE coalesce(c.t, '') END AS clean FROM r LEFT JOIN c USING (rid)""")
def clean_extract(spark, d):
    return load(spark, d, "corpus").select("pageid", "fetched_at", "title", T.clean_extract(F.col("text")).alias("clean"))


@query(r"SELECT pageid, fetched_at, title, regexp_replace(text, '<[a-zA-Z/][^>' || chr(10) || ']*>', '', 'g') AS stripped FROM corpus")
def strip_tags(spark, d):
    return load(spark, d, "corpus").select("pageid", "fetched_at", "title", T.strip_tags(F.col("text")).alias("stripped"))


@query(rf"""WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM corpus), h AS (SELECT DISTINCT lower({s_strip(rf"regexp_extract(line, '^==+{W}*(.+?){W}*=+{W}*$', 1)")}) AS heading FROM l WHERE starts_with(line, '=='))
SELECT heading, len(list_filter(list_transform(regexp_split_to_array(heading, '{W}+and{W}+|{W}*[,&]{W}*'), lambda p: {s_strip('p')}), lambda p: p <> '')) > 0
AND len(list_filter(list_transform(regexp_split_to_array(heading, '{W}+and{W}+|{W}*[,&]{W}*'), lambda p: {s_strip('p')}), lambda p: p <> '' AND p NOT IN ({s_list(T.BOILERPLATE_SECTIONS)}))) = 0 AS boilerplate FROM h WHERE heading <> ''""")
def boilerplate_heading(spark, d):
    lines = load(spark, d, "corpus").select(F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").startswith("=="))
    h = lines.select(F.lower(T.strip(F.regexp_extract("line", rf"(?Ud)^==+{T.SPACE}*(.+?){T.SPACE}*=+{T.SPACE}*$", 1))).alias("heading")).where("heading <> ''").distinct()
    return h.select("heading", T.is_boilerplate(F.col("heading")).alias("boilerplate"))


def s_fold(parts: str, mark: str) -> str:
    """Greedy joining of structs (t, o) by a mark: closed parts (o false) and what would grow too long begin anew."""
    grown = f"length(acc[len(acc)].t) + {len(mark)} + length(x[1].t) <= {CHUNK_SIZE}"
    whole = f"acc[len(acc)].o AND x[1].o"
    return f"""list_filter(list_reduce({parts}, lambda acc, x: CASE WHEN {whole} AND acc[len(acc)].t = '' THEN list_concat(acc[1:len(acc) - 1], x)
    WHEN {whole} AND {grown} THEN list_append(acc[1:len(acc) - 1], {{'t': acc[len(acc)].t || '{mark}' || x[1].t, 'o': true}}) ELSE list_concat(acc, x) END), lambda u: u.t <> '')"""


S_HARD = f"CASE WHEN length(w) > {CHUNK_SIZE} THEN list_transform(range(0, length(w), {CHUNK_SIZE}), lambda i: {{'t': substring(w, i + 1, {CHUNK_SIZE}), 'o': false}}) ELSE [{{'t': w, 'o': true}}] END"
S_UNITS = f"""r AS (SELECT row_number() OVER () AS rid, pageid, title, url, fetched_at, text FROM corpus WHERE text IS NOT NULL),
pa AS (SELECT rid, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS pk, {s_strip("unnest(string_split(text, chr(10) || chr(10)))")} AS p FROM r),
se AS (SELECT rid, pk, generate_subscripts(string_split(p, '. '), 1) AS sk, unnest(string_split(p, '. ')) AS s FROM pa WHERE length(p) > {CHUNK_SIZE}),
sw AS (SELECT rid, pk, sk, s, CASE WHEN length(s) > {CHUNK_SIZE} THEN list_transform({s_fold(f"list_transform(string_split(s, ' '), lambda w: {S_HARD})", ' ')}, lambda u: {{'t': u.t, 'o': false}}) ELSE [{{'t': s, 'o': true}}] END AS parts FROM se),
lg AS (SELECT rid, pk, list(parts ORDER BY sk) AS parts FROM sw GROUP BY ALL),
un AS (SELECT rid, pk, 0::BIGINT AS uk, p AS u FROM pa WHERE p <> '' AND length(p) <= {CHUNK_SIZE}
    UNION ALL SELECT rid, pk, generate_subscripts(us, 1), unnest(us).t FROM (SELECT rid, pk, {s_fold('parts', '. ')} AS us FROM lg)),
units AS (SELECT rid, row_number() OVER (PARTITION BY rid ORDER BY pk, uk) - 1 AS unit, u FROM un)"""


@query(f"""WITH {S_UNITS},
ul AS (SELECT rid, list([{{'t': u, 'o': true}}] ORDER BY unit) AS parts FROM units GROUP BY rid),
bo AS (SELECT rid, {s_fold('parts', chr(10) * 2)} AS bs FROM ul),
ch AS (SELECT rid, generate_subscripts(bs, 1) - 1 AS k, unnest(bs).t AS body FROM bo),
tl AS (SELECT rid, k, body, lag(CASE WHEN length(body) <= {CHUNK_OVERLAP} THEN body WHEN strpos(right(body, {CHUNK_OVERLAP}), ' ') > 0 THEN substring(right(body, {CHUNK_OVERLAP}), strpos(right(body, {CHUNK_OVERLAP}), ' ') + 1)
    ELSE right(body, {CHUNK_OVERLAP}) END) OVER (PARTITION BY rid ORDER BY k) AS tail FROM ch)
SELECT pageid || ':' || k AS chunk_id, pageid, title, url, k::INTEGER AS chunk_index, CASE WHEN coalesce(tail, '') <> '' THEN tail || chr(10) || chr(10) || body ELSE body END AS text FROM tl JOIN r USING (rid)""")
def chunk_documents(spark, d):
    return chunking.chunk_documents(load(spark, d, "corpus"))


@query(f"WITH {S_UNITS} SELECT pageid, fetched_at, unit::INTEGER AS unit, u AS text FROM units JOIN r USING (rid)")
def chunk_units(spark, d):
    """Units longer than nothing, with the production size: the packing's input."""
    units = F.pandas_udf(lambda s: s.map(lambda t: chunking.split_units(t, CHUNK_SIZE) if t is not None else []), "array<string>")
    rows = spread(load(spark, d, "corpus").select("pageid", "fetched_at", "text")).withColumn("u", units("text"))
    return rows.select("pageid", "fetched_at", F.posexplode("u").alias("unit", "text"))


@query(f"""SELECT chunk_id, indexed_at, CASE WHEN length(text) <= {CHUNK_OVERLAP} THEN text WHEN strpos(right(text, {CHUNK_OVERLAP}), ' ') > 0
THEN substring(right(text, {CHUNK_OVERLAP}), strpos(right(text, {CHUNK_OVERLAP}), ' ') + 1) ELSE right(text, {CHUNK_OVERLAP}) END AS tail FROM chunks""")
def overlap_tail(spark, d):
    return load(spark, d, "chunks").select("chunk_id", "indexed_at", T.overlap_tail(F.col("text"), CHUNK_OVERLAP).alias("tail"))


@query(rf"""SELECT chunk_id, indexed_at, len(regexp_extract_all(lower(text), '{WORDS}'))::BIGINT AS tokens, len(list_distinct(regexp_extract_all(lower(text), '{WORDS}')))::BIGINT AS terms,
md5(array_to_string(regexp_extract_all(lower(text), '{WORDS}'), ' ')) AS digest FROM chunks WHERE text IS NOT NULL""")
def tokenize(spark, d):
    t = load(spark, d, "chunks").where("text is not null").withColumn("ts", T.tokenize(F.col("text")))
    return t.select("chunk_id", "indexed_at", F.size("ts").cast("bigint").alias("tokens"), F.size(F.array_distinct("ts")).cast("bigint").alias("terms"), F.md5(F.array_join("ts", " ").cast("binary")).alias("digest"))


@query(f"SELECT DISTINCT name, {s_norm('name')} AS normalized FROM extractions WHERE name IS NOT NULL")
def normalize_name(spark, d):
    return load(spark, d, "extractions").where("name is not null").select("name").distinct().select("name", T.normalize_name(F.col("name")).alias("normalized"))


@query(f"""SELECT DISTINCT name, array_to_string(list_sort(list_distinct(list_filter(string_split({s_norm('name')}, ' '), lambda w: w <> '' AND w NOT IN ({s_list(T.NAME_STOPWORDS)})))), ' ') AS tokens
FROM extractions WHERE name IS NOT NULL""")
def name_tokens(spark, d):
    return load(spark, d, "extractions").where("name is not null").select("name").distinct().select("name", F.array_join(F.array_sort(T.name_tokens(F.col("name"))), " ").alias("tokens"))


@query(f"SELECT chunk_id, indexed_at, substring({s_collapse('text')}, 1, 200) || '...' AS snippet FROM chunks")
def snippet(spark, d):
    return load(spark, d, "chunks").select("chunk_id", "indexed_at", T.snippet(F.col("text")).alias("snippet"))


@query(f"""WITH h AS (SELECT chunk_id, indexed_at, sha1(unhex('{T.URL_NAMESPACE}') || chunk_id::BLOB) AS h FROM chunks WHERE chunk_id IS NOT NULL)
SELECT chunk_id, indexed_at, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || ['8','9','a','b'][(strpos('0123456789abcdef', h[17]) - 1) % 4 + 1] || h[18:20] || '-' || h[21:32] AS point_id FROM h""")
def point_id(spark, d):
    return load(spark, d, "chunks").where("chunk_id is not null").select("chunk_id", "indexed_at", T.point_id(F.col("chunk_id")).alias("point_id"))


# ---- retrieval ----


@query(f"WITH {S_BM25} SELECT term, df, round(idf, 9) AS idf FROM idf")
def bm25_idf(spark, d):
    return _index(spark, d).weights.select("term", "df", F.round("idf", 9).alias("idf"))


@query(f"WITH {S_BM25} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM kw WHERE rank <= 5")
def bm25_topk(spark, d):
    return _keyword_hits(spark, d, 5).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH v AS (SELECT vec_id AS id, list_transform(vector, lambda x: x::DOUBLE) AS v FROM node_vectors WHERE len(vector) = 64 AND list_max(list_transform(vector, lambda x: abs(x))) > 0)
SELECT query_id, id, round(score, 6) AS score, rank FROM (SELECT q.id AS query_id, e.id, round({s_cos('q.v', 'e.v')}, 9) AS score, row_number() OVER (PARTITION BY q.id ORDER BY round({s_cos('q.v', 'e.v')}, 9) DESC, e.id) AS rank
FROM v q JOIN v e ON q.id % 100 = 0 AND q.id <> e.id) WHERE rank <= 5""")
def vector_topk(spark, d):
    table = load(spark, d, "node_vectors")
    asked = table.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "vector")
    return similarity.vector_topk(table, asked, 5).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {S_BM25}, {S_COSINES} SELECT query_id, id, rank FROM (SELECT kw.query_id, kw.chunk_id AS id, row_number() OVER (PARTITION BY kw.query_id ORDER BY c.score DESC, kw.rank) AS rank
FROM kw JOIN cosn c USING (query_id, chunk_id)) WHERE rank <= 6""")
def rerank(spark, d):
    """The keyword pool of 30 chunks a question, reranked by vectors."""
    return similarity.rerank(_rerank_rows(spark, d, _keyword_hits(spark, d, 30).withColumnRenamed("rank", "ord")))


@query(f"""WITH {S_BM25}, {S_VHITS},
li AS (SELECT query_id, chunk_id, rank, 1.0::DOUBLE AS w FROM vh UNION ALL SELECT query_id, chunk_id, rank, 0.5::DOUBLE FROM kw)
SELECT query_id, chunk_id, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT query_id, chunk_id, round(sum(w / (60 + rank)::DOUBLE), 12) AS score FROM li GROUP BY ALL)""")
def rrf_fuse(spark, d):
    """The whole vector and keyword pools of a question, the keyword list with half the weight."""
    lists = _vector_hits(spark, d, 30).select("query_id", "chunk_id", "rank", F.lit(1.0).alias("weight")).unionByName(_keyword_hits(spark, d, 30).select("query_id", "chunk_id", "rank", F.lit(0.5).alias("weight")))
    return fusion.ranked(fusion.rrf(lists), None).withColumn("score", F.round("score", 9))


@query(f"WITH {S_HYBRID} SELECT query_id, chunk_id, round(score, 9) AS score, found_by, rank FROM hy")
def hybrid_search(spark, d):
    return _hybrid(spark, d).withColumn("score", F.round("score", 9))


@query(f"WITH {S_HYBRID} SELECT query_id, chunk_id FROM vh INTERSECT SELECT query_id, chunk_id FROM kw")
def search_overlap(spark, d):
    return fusion.overlap(_vector_hits(spark, d, 30), _keyword_hits(spark, d, 30))


# ---- the graph ----


@query(f"SELECT mention_id, {s_strip(chr(114) + 'eplace(coalesce(name, ' + chr(39) * 2 + '), chr(34), ' + chr(39) * 2 + ')')} AS name FROM extractions")
def sanitize_entities(spark, d):
    return graph.sanitize_entities(load(spark, d, "extractions")).select("mention_id", "name")


@query(f"""WITH {S_VALID} SELECT mention_id, CASE WHEN name = '' THEN 'missing name' WHEN type IS NULL OR type NOT IN ({s_list(NODE_TYPES)}) THEN 'unknown node type' END AS reason FROM men""")
def validate_entities(spark, d):
    return graph.validate_entities(load(spark, d, "extractions")).select("mention_id", "reason")


@query(f"WITH {S_VALID} SELECT relation_id, source_type, target_type, reason FROM judged")
def validate_relations(spark, d):
    return graph.validate_relations(load(spark, d, "relations"), _valid(spark, d)).select("relation_id", "source_type", "target_type", "reason")


@query(f"""WITH {S_VALID}, e AS (SELECT CASE WHEN name = '' THEN 'missing name' WHEN type IS NULL OR type NOT IN ({s_list(NODE_TYPES)}) THEN 'unknown node type' END AS reason FROM men)
SELECT 'entity' AS kind, reason, count(*) AS rejects FROM e WHERE reason IS NOT NULL GROUP BY reason UNION ALL SELECT 'relation', reason, count(*) FROM judged WHERE reason IS NOT NULL GROUP BY reason""")
def reject_summary(spark, d):
    mentions = load(spark, d, "extractions")
    return graph.reject_summary(graph.validate_entities(mentions), graph.validate_relations(load(spark, d, "relations"), graph.valid_mentions(mentions)))


@query(f"WITH {S_VALID} SELECT name, type, count(DISTINCT chunk_id) AS chunks, min_by(chunk_id, mention_id) AS first_chunk, min(mention_id) AS seen FROM valid GROUP BY name, type")
def graph_nodes(spark, d):
    return graph.nodes(_valid(spark, d))


@query(f"WITH {S_VALID} SELECT name, type, chunk_id, min(mention_id) AS seen FROM valid GROUP BY ALL")
def graph_node_chunks(spark, d):
    return graph.node_chunks(_valid(spark, d))


@query(f"WITH {S_VALID} SELECT * FROM edge")
def graph_edges(spark, d):
    return graph.edges(_relations(spark, d))


@query(f"WITH {S_VALID} SELECT source, source_type, relation, target, target_type, chunk_id, min(relation_id) AS seen FROM rel GROUP BY ALL")
def graph_edge_chunks(spark, d):
    return graph.edge_chunks(_relations(spark, d))


@query(f"WITH {S_VALID}, {S_SAME} SELECT (SELECT count(*) FROM node) AS nodes, (SELECT count(*) FROM edge) AS edges, (SELECT count(*) FROM sa) AS same_as_links")
def graph_counts(spark, d):
    return graph.graph_counts(graph.nodes(_valid(spark, d)), graph.edges(_relations(spark, d)), _same_as(spark, d))


@query(f"""WITH {S_VALID} SELECT (SELECT count(*) FROM valid) AS entities, count(*) FILTER (relation IN ({s_list(list(RELATION_TYPES))}) AND source_type IS NOT NULL AND target_type IS NOT NULL) AS relations,
count(*) FILTER (NOT coalesce(relation IN ({s_list(list(RELATION_TYPES))}) AND source_type IS NOT NULL AND target_type IS NOT NULL, false)) AS skipped_relations FROM ends""")
def graph_load_counts(spark, d):
    return graph.load_counts(load(spark, d, "relations"), _valid(spark, d))


@query(f"WITH {S_VALID}, {S_DEGREE} SELECT name, type, degree FROM deg")
def node_degree(spark, d):
    return graph.degrees(graph.nodes(_valid(spark, d)), graph.edges(_relations(spark, d)))


@query(f"""WITH {S_VALID} SELECT name, type, string_agg(description, ' / ' ORDER BY k) AS descriptions FROM (SELECT name, type, coalesce(description, '') AS description, row_number() OVER (PARTITION BY name, type ORDER BY mention_id) AS k FROM valid)
WHERE k <= 3 GROUP BY name, type""")
def node_descriptions(spark, d):
    return graph.node_descriptions(_valid(spark, d)).select("name", "type", F.array_join("values", " / ").alias("descriptions"))


@query(f"""WITH {S_VALID} SELECT name, type, CASE WHEN x = '' THEN name ELSE name || ' — ' || x END AS representative FROM (SELECT name, type, max_by(coalesce(description, ''), length(coalesce(description, ''))::BIGINT * 1000000000000 - mention_id) AS x FROM valid GROUP BY name, type)""")
def entity_rep(spark, d):
    text = F.coalesce("description", F.lit(""))
    best = _valid(spark, d).groupBy("name", "type").agg(F.max_by(text, F.struct(F.length(text), -F.col("mention_id"))).alias("x"))
    return best.select("name", "type", F.when(F.col("x") == "", F.col("name")).otherwise(F.concat_ws(" — ", "name", "x")).alias("representative"))


# ---- resolution ----


@query(f"WITH {S_VALID}, {S_BLOCK} SELECT * FROM np")
def token_block_pairs(spark, d):
    return resolve.token_block_pairs(graph.nodes(_valid(spark, d)))


def _vector_pairs(spark, d):
    vectors = load(spark, d, "node_vectors")
    pairs = similarity.threshold_pairs(vectors, THETA)
    name = vectors.select("vec_id", "name", F.coalesce("type", F.lit("")).alias("type"))
    ends = pairs.join(name.select(F.col("vec_id").alias("a"), F.col("name").alias("x"), "type"), "a").join(name.select(F.col("vec_id").alias("b"), F.col("name").alias("y")), "b")
    return ends.where("x <> y").select("type", F.least("x", "y").alias("a_name"), F.greatest("x", "y").alias("b_name")).distinct()


@query(f"WITH {S_EMB} SELECT * FROM ep")
def embedding_pairs(spark, d):
    return _vector_pairs(spark, d)


def _candidates(spark, d):
    g = _graph(spark, d)
    node_table, edge_table = g.nodes, g.edges
    return resolve.candidate_pairs(resolve.token_block_pairs(node_table), _vector_pairs(spark, d), resolve.hubs(graph.degrees(node_table, edge_table)))


@query(f"WITH {S_CAND} SELECT * FROM cand")
def candidate_pairs(spark, d):
    return _candidates(spark, d)


@query(f"WITH {S_CAND}, {S_DECIDED} SELECT * FROM cand c WHERE NOT EXISTS (SELECT 1 FROM decided p WHERE p.a_name = c.a_name AND p.b_name = c.b_name AND p.a_type = c.type AND p.b_type = c.type)")
def pending_pairs(spark, d):
    return resolve.pending_pairs(_candidates(spark, d), graph.decided_pairs(load(spark, d, "resolutions")))


@query("SELECT DISTINCT chunk_id FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM relations r WHERE r.chunk_id = c.chunk_id)")
def resume_pending(spark, d):
    """Chunks whose second pass (relations) is still to come."""
    return resolve.resume_pending(load(spark, d, "chunks").select("chunk_id").distinct(), load(spark, d, "relations"))


@query(f"WITH {S_VALID}, {S_SAME} SELECT a_name, a_type, b_name, b_type, canonical[1] AS canonical FROM sa")
def same_as_links(spark, d):
    return _same_as(spark, d)


@query(f"WITH RECURSIVE {S_VALID}, {S_SAME}, {S_LABEL} SELECT split_part(node, chr(1), 1) AS name, split_part(node, chr(1), 2) AS type, split_part(label, chr(1), 1) AS label_name, split_part(label, chr(1), 2) AS label_type FROM lab")
def same_as_components(spark, d):
    part = lambda c, n: F.split_part(F.col(c), F.lit("\x01"), F.lit(n))
    return retrieval.variant_labels(_same_as(spark, d)).select(part("node", 1).alias("name"), part("node", 2).alias("type"), part("label", 1).alias("label_name"), part("label", 2).alias("label_type"))


# ---- questions over the graph ----


@query(f"WITH {S_VALID}, {S_ASK}, {S_SEEDS} SELECT * FROM seeds")
def link_spans(spark, d):
    return retrieval.link_spans(_ask(spark, d).withColumnRenamed("query", "span"), graph.nodes(_valid(spark, d)))


@query(f"WITH RECURSIVE {S_GRAPH} SELECT query_id, hop, source, source_type, relation, target, target_type, chunks FROM nb")
def graph_neighborhood(spark, d):
    return _neighborhood(spark, d, _graph(spark, d)).select("query_id", "hop", *graph.EDGE, "chunks")


@query(f"WITH RECURSIVE {S_GRAPH} SELECT query_id, chunk_id, ord FROM cc")
def candidate_chunks(spark, d):
    g = _graph(spark, d)
    return retrieval.candidate_chunks(_neighborhood(spark, d, g), graph.edge_chunks(g.relations))


@query(f"WITH RECURSIVE {S_PASS} SELECT query_id, chunk_id, rank FROM ps")
def graph_passages(spark, d):
    return _passages(spark, d).select("query_id", "chunk_id", "rank")


_S_ONLY = S_HYBRID.replace(f"{S_DOCS}, {S_ASK},", "").replace(f"{S_COSINES},", "")


@query(f"WITH RECURSIVE {S_PASS}, {_S_ONLY} SELECT ps.query_id, ps.chunk_id, ps.title FROM ps WHERE NOT EXISTS (SELECT 1 FROM hy JOIN doc USING (chunk_id) WHERE hy.query_id = ps.query_id AND doc.title = ps.title)")
def graph_only(spark, d):
    hits = _hybrid(spark, d).join(_index(spark, d).docs.select("chunk_id", "title"), "chunk_id")
    return retrieval.graph_only(_passages(spark, d), hits).select("query_id", "chunk_id", "title")


@query(f"WITH {S_BM25} SELECT query_id, string_agg('[' || rank || '] (' || coalesce(kw.title, '') || ') ' || text, chr(10) || chr(10) ORDER BY rank) AS context FROM kw JOIN docs USING (chunk_id) WHERE rank <= 5 GROUP BY query_id")
def context_block(spark, d):
    return retrieval.context_block(_with_text(spark, d, _keyword_hits(spark, d, 5)))


@query(f"WITH {S_BM25} SELECT query_id, rank, '  [' || rank || '] ' || coalesce(title, '') || ' (' || chunk_id || ')' AS line FROM kw WHERE rank <= 5")
def source_lines(spark, d):
    return retrieval.source_lines(_keyword_hits(spark, d, 5))


@query(f"WITH {S_BM25} SELECT query_id, rank, printf('[%.3f] %s  (%s)', score, coalesce(kw.title, ''), chunk_id) AS head, '    ' || substring({s_collapse('text')}, 1, 200) || '...' AS body FROM kw JOIN docs USING (chunk_id) WHERE rank <= 5")
def hit_lines(spark, d):
    return retrieval.hit_lines(_with_text(spark, d, _keyword_hits(spark, d, 5)))


def s_text(x: str) -> str:
    """A literal of several lines."""
    return " || chr(10) || ".join("'" + line.replace("'", "''") + "'" for line in x.split("\n"))


@query(f"SELECT DISTINCT chunk_id, {s_text(P.ENTITY_TASK)} || chr(10) || {s_text(node_types_block())} || chr(10) || 'Passage:' || chr(10) || text AS prompt FROM chunks WHERE text IS NOT NULL")
def entity_prompt(spark, d):
    return load(spark, d, "chunks").where("text is not null").select("chunk_id", P.entity_prompt(F.col("text")).alias("prompt")).distinct()


@query(f"""WITH {S_VALID}, {S_DOCS}, fs AS (SELECT chunk_id, name, min_by(type, mention_id) AS type, min(mention_id) AS k FROM valid GROUP BY ALL),
li AS (SELECT chunk_id, string_agg('- ' || name || ' — ' || type, chr(10) ORDER BY k) AS listed FROM fs GROUP BY chunk_id)
SELECT chunk_id, {s_text(P.RELATION_TASK)} || chr(10) || {s_text(vocabulary_block())} || chr(10) || 'Entities:' || chr(10) || listed || chr(10) || 'Passage:' || chr(10) || text AS prompt FROM li JOIN docs USING (chunk_id)""")
def relation_prompt(spark, d):
    """The second pass of every chunk: its distinct names in the order of mention, each with the type it was first given."""
    valid = _valid(spark, d).groupBy("chunk_id", "name").agg(F.min_by("type", "mention_id").alias("type"), F.min("mention_id").alias("k"))
    listed = valid.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("k", "name", "type"))).alias("names"))  # the names of one passage
    texts = load(spark, d, "chunks").where("text is not null and chunk_id is not null").groupBy("chunk_id").agg(F.min("text").alias("text"))
    return listed.join(texts, "chunk_id").select("chunk_id", P.relation_prompt(F.col("text"), F.col("names")).alias("prompt"))


@query(f"""WITH {S_CAND},
ds AS (SELECT name, type, string_agg('- ' || description, chr(10) ORDER BY k) AS told FROM (SELECT name, type, coalesce(description, '') AS description, row_number() OVER (PARTITION BY name, type ORDER BY mention_id) AS k FROM valid) WHERE k <= 3 GROUP BY name, type)
SELECT c.type, a_name, b_name, 'Are these the same ' || c.type || '?' || chr(10) || 'A: ' || a_name || chr(10) || coalesce(x.told, '') || chr(10) || 'B: ' || b_name || chr(10) || coalesce(y.told, '') AS prompt
FROM cand c LEFT JOIN ds x ON x.name = a_name AND x.type = c.type LEFT JOIN ds y ON y.name = b_name AND y.type = c.type""")
def decision_prompt(spark, d):
    told = graph.node_descriptions(_valid(spark, d))
    pairs = _candidates(spark, d)
    for side in ("a", "b"):
        pairs = pairs.join(told.select(F.col("name").alias(f"{side}_name"), "type", F.col("values").alias(f"{side}_told")), [f"{side}_name", "type"], "left")
    return pairs.select("type", "a_name", "b_name", P.decision_prompt().alias("prompt"))
