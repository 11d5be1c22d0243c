"""The training-data queries and, where SQL can state them, the equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amphora.session import load, materialize


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    from amphora.llm.term_counts import marked, term_frequencies

    return marked(term_frequencies(load(spark, d, "chunks"), load(spark, d, "extractions"))).select("field", "term", "mark")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    from amphora.llm.canonical_duplicates import collapse_formatting

    return collapse_formatting(load(spark, d, "extractions")).where("names > 1").select("type", "name", "kept_name")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    from amphora.llm.components import group_names, groups

    return group_names(groups(load(spark, d, "resolutions")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    from amphora.llm.components import groups
    from amphora.llm.survivors import survivors

    resolutions = load(spark, d, "resolutions")
    grouped = groups(resolutions)
    heads = grouped.where("id = group").select("group", F.col("name").alias("group_name"), F.col("type").alias("group_type"))
    kept = survivors(grouped, resolutions, load(spark, d, "extractions")).where("canonical is not null and mention_id is not null")
    return kept.join(heads, "group").select("group_name", "group_type", "canonical", "mention_id")


def p6_values(spark: SparkSession, d: str) -> DataFrame:
    from amphora.llm.components import groups
    from amphora.llm.survivors import claims, true_values

    grouped = groups(load(spark, d, "resolutions"))
    heads = grouped.where("id = group").select("group", F.col("name").alias("group_name"), F.col("type").alias("group_type"))
    kept = true_values(claims(grouped, load(spark, d, "extractions"))).where("p_true >= 0.5")
    return kept.join(heads, "group").select("group_name", "group_type", "value", F.round("p_true", 6).alias("p_true"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    from amphora.llm.name_variants import link_spellings, spelling_pairs

    return spelling_pairs(materialize(link_spellings(load(spark, d, "extractions")), "linked"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    from amphora.llm.leaks import leaked_items

    return leaked_items(load(spark, d, "documents"), load(spark, d, "eval_items"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    from amphora.llm.personal_info import personal_spans

    return personal_spans(load(spark, d, "documents")).select("doc_id", "kind", "value").distinct()


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    from amphora.llm.personal_info import personal_spans, redact

    documents = load(spark, d, "documents")
    return redact(documents, materialize(personal_spans(documents), "personal"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    from amphora.llm.markup import found_kinds

    return found_kinds(load(spark, d, "corpus"))


def p4_clean(spark: SparkSession, d: str) -> DataFrame:
    from amphora.llm.markup import clean_corpus

    return clean_corpus(load(spark, d, "corpus"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    from amphora.llm.neighbours import similar_pairs

    return similar_pairs(load(spark, d, "node_vectors")).select(F.col("a").alias("vec_a"), F.col("b").alias("vec_b"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    from amphora.llm.mixing import mix

    return mix(load(spark, d, "documents"), load(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    from amphora.llm.mixing import mix, shares

    targets = load(spark, d, "mix_targets")
    return shares(materialize(mix(load(spark, d, "documents"), targets), "mix"), targets)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_clean": p4_clean,
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p6_values": p6_values,
    "p7_found": p7_found,
    "p8_found": p8_found,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_redacted": p10_redacted,
}

_COMPONENTS = r"""
two AS (SELECT pair[1][1] AS an, pair[1][2] AS aty, pair[2][1] AS bn, pair[2][2] AS bty, same, canonical, decided_at, decision_id
        FROM resolutions WHERE len(pair) = 2),
node AS (SELECT row_number() OVER (ORDER BY name NULLS FIRST, type NULLS FIRST) AS id, name, type
         FROM (SELECT an AS name, aty AS type FROM two UNION SELECT bn, bty FROM two)),
edge AS (SELECT DISTINCT x.id AS a, y.id AS b FROM two
         JOIN node x ON an IS NOT DISTINCT FROM x.name AND aty IS NOT DISTINCT FROM x.type
         JOIN node y ON bn IS NOT DISTINCT FROM y.name AND bty IS NOT DISTINCT FROM y.type WHERE same),
link AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
reach AS (SELECT id AS a, id AS b FROM node UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
label AS (SELECT a AS id, min(b) AS root FROM reach GROUP BY a),
grp AS (SELECT n.id, n.name, n.type, l.root, h.name AS group_name, h.type AS group_type
        FROM node n JOIN label l ON n.id = l.id JOIN node h ON l.root = h.id)"""

SQL: dict[str, str] = {
    "p1_found": r"""
WITH t AS (SELECT chunk_id AS r, min(text) AS t FROM chunks WHERE text IS NOT NULL AND chunk_id IS NOT NULL GROUP BY chunk_id),
w AS (SELECT r, unnest(regexp_extract_all(lower(t), '[\p{L}\p{N}_]+')) AS term FROM t),
n AS (SELECT chunk_id AS r, name AS term FROM extractions WHERE regexp_matches(name, '[^\s\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]')),
f AS (SELECT 'text' AS field, term, count(*) AS occ, count(DISTINCT r) AS rec, (SELECT count(*) FROM t) AS total FROM w GROUP BY term
      UNION ALL SELECT 'name', term, count(*), count(DISTINCT r), (SELECT count(DISTINCT r) FROM n) FROM n GROUP BY term)
SELECT field, term, CASE WHEN occ < 3 THEN 'rare' ELSE 'common' END AS mark FROM f WHERE occ < 3 OR rec > total * 0.1::DOUBLE""",
    "p2_found": r"""
WITH n AS (SELECT DISTINCT type, name, array_to_string(list_sort(regexp_extract_all(lower(name), '[\p{L}\p{N}]+')), ' ') AS k
           FROM extractions WHERE regexp_matches(name, '[^\s\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]'))
SELECT type, name, kept FROM (SELECT type, name, min(name) OVER (PARTITION BY type, k) AS kept, count(*) OVER (PARTITION BY type, k) AS c FROM n) WHERE c > 1""".replace("name, kept FROM", "name, kept AS kept_name FROM"),
    "p3_found": f"WITH RECURSIVE {_COMPONENTS}\nSELECT name, type, group_name, group_type FROM grp",
    "p6_found": rf"""WITH RECURSIVE {_COMPONENTS},
big AS (SELECT root FROM grp GROUP BY root HAVING count(*) > 1),
c AS (SELECT g.root, trim(canonical) AS canonical, row_number() OVER (PARTITION BY g.root ORDER BY decided_at DESC NULLS LAST, decision_id DESC) AS k
      FROM two JOIN grp g ON an IS NOT DISTINCT FROM g.name AND aty IS NOT DISTINCT FROM g.type WHERE same AND regexp_matches(canonical, '[^\s\x{{85}}\x{{A0}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]')),
m AS (SELECT g.root, mention_id, row_number() OVER (PARTITION BY g.root ORDER BY coalesce(length(description), 0) DESC, extracted_at DESC NULLS LAST, mention_id) AS k
      FROM extractions e JOIN grp g ON e.name = g.name AND e.type = g.type)
SELECT g.group_name, g.group_type, c.canonical, m.mention_id FROM big JOIN grp g ON g.id = big.root
JOIN c ON c.root = big.root AND c.k = 1 JOIN m ON m.root = big.root AND m.k = 1""",
    "p5_found": """
WITH v AS (SELECT vec_id AS id, list_transform(vector, lambda x: x::DOUBLE) AS v FROM node_vectors WHERE len(vector) = 64 AND list_max(list_transform(vector, lambda x: abs(x))) > 0),
u AS (SELECT id, v, sqrt(list_dot_product(v, v)) AS n FROM v),
r AS (SELECT x.id AS q, y.id AS e, row_number() OVER (PARTITION BY x.id ORDER BY list_dot_product(x.v, y.v) / (x.n * y.n) DESC, y.id) AS k FROM u x JOIN u y ON x.id <> y.id)
SELECT DISTINCT least(q, e) AS vec_a, greatest(q, e) AS vec_b FROM r WHERE k <= 5""",
}
