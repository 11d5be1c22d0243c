"""Term counts, formatting duplicates, components and survivors."""

import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from amphora.llm import canonical_duplicates as dup
from amphora.llm import components as comp
from amphora.llm import queries as Q
from amphora.llm import survivors as surv
from amphora.llm import term_counts as terms

FOLDER = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not FOLDER.exists(), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_equals_sql(spark, compare, name):
    got, want = compare(spark, Q.QUERIES[name], Q.SQL[name], FOLDER)
    assert got == want


@pytest.mark.skipif(not FOLDER.exists(), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL)))
def test_query_runs(spark, name):
    assert Q.QUERIES[name](spark, str(FOLDER)).count() > 0


CHUNKS = "chunk_id string, text string, term string, field string, r string"
MENTIONS = "chunk_id string, name string, type string, occurrences bigint, key string, cell string, copies bigint"


def test_terms_edges(spark):
    long = "word " * 30_000
    chunks = spark.createDataFrame([("1:0", "A b, b _x² é", *"tfr"), ("1:0", "A b, b _x² é", *"tfr"), ("2:0", None, *"tfr"), ("3:0", "", *"tfr"), (None, "lost", *"tfr"), ("4:0", long, *"tfr")], CHUNKS)
    names = [("1:0", "Rome"), ("1:0", "Rome"), ("2:0", "Rome"), (None, "Rome"), ("2:0", " "), ("2:0", None), ("3:0", " Rome")]
    mentions = spark.createDataFrame([(c, n, "T", 1, "k", "c", 1) for c, n in names], MENTIONS)
    got = {(r.field, r.term): (r.occurrences, r.records, r.total) for r in terms.term_frequencies(chunks, mentions).collect()}
    assert got == {
        ("text", "a"): (1, 1, 3), ("text", "b"): (2, 1, 3), ("text", "_x²"): (1, 1, 3), ("text", "é"): (1, 1, 3), ("text", "word"): (30_000, 1, 3), ("name", "Rome"): (4, 2, 3), ("name", " Rome"): (1, 1, 3),
    }
    assert terms.term_frequencies(chunks.limit(0), mentions.limit(0)).count() == 0


def test_terms_in_small_runs(spark):
    rng = random.Random(1)
    rows = [(f"{i}", " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(30)))) for i in range(60)]
    df = spark.createDataFrame(rows, "chunk_id string, text string").repartition(5)
    got = {r.term: (r.occurrences, r.records) for r in terms.merge_runs(terms.text_runs(df, "chunk_id", "text", run_tokens=20)).collect()}
    occ, rec = Counter(w for _, t in rows for w in t.split()), Counter(w for _, t in rows for w in set(t.split()))
    assert got == {w: (occ[w], rec[w]) for w in occ}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.binary(min_size=0, max_size=6), st.text("xy", min_size=1, max_size=2), st.integers(1, 3)), max_size=200))
def test_trie_counts(rows):
    trie, want = dup.Trie(), defaultdict(lambda: [0, 0, []])
    for k, n, c in rows:
        trie.add(k, n, c)
        want[k][0] += 1
        want[k][1] += c
        want[k][2].append(n)
    assert {k: tuple(c) for k, c in trie.terminals()} == {k: (a, b, min(n)) for k, (a, b, n) in want.items()}


def brute(names):
    groups = defaultdict(set)
    for n, t in names:
        if n is not None and n.strip():
            groups[t, tuple(sorted(re.findall(r"[^\W_]+", n.lower())))].add(n)
    return {(t, n, min(g)) for (t, _), g in groups.items() for n in g if len(g) > 1}


@pytest.mark.parametrize("bucket_rows", [2, 7, 100_000])
def test_duplicates_against_brute_force(spark, bucket_rows):
    rng = random.Random(2)
    words = ["roma", "Roma", "ROMA", "via", "Via", "romanus", "romana", "é", "É", "a"]
    names = [(rng.choice([" ", ", ", "-", "."]).join(rng.sample(words, rng.randrange(1, 4))) + rng.choice(["", ".", " "]), rng.choice(["P", "Q", None])) for _ in range(300)]
    names += [(f"HOT {'.' * i}", "P") for i in range(40)] + [(None, "P"), (" ", "P"), ("--", "P"), ("!", "P"), ("x" * 400, "Q"), ("X" * 400, "Q"), ("x" * 400 + "y", "Q")]
    df = spark.createDataFrame([("c", n, t, 1, "k", "c", 1) for n, t in names], MENTIONS)
    got = dup.collapse_formatting(df, bucket_rows)
    assert {(r.type, r.name, r.kept_name) for r in got.where("names > 1").collect()} == brute(names)
    hot = got.where("name = 'HOT '").first()
    assert (hot.names, hot.copies) == (40, 40)
    assert dup.collapse_formatting(df.limit(0), bucket_rows).count() == 0


def components(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {x: find(x) for x in up}


@pytest.mark.parametrize("bound", [40, 10_000])
def test_components_against_brute_force(spark, bound):
    rng = random.Random(3)
    edges = [(rng.randrange(150), rng.randrange(150)) for _ in range(120)] + [(i, i + 1) for i in range(500, 560)] + [(700, 700 + i) for i in range(1, 50)]
    edges = [(a, b) for a, b in edges if a != b]
    df = spark.createDataFrame(edges, "a bigint, b bigint").repartition(7)
    want = {x: r for x, r in components(edges).items() if x != r}
    assert {r.a: r.b for r in comp.min_labels(df, bound).collect()} == want


DEC = "decision_id bigint, pair array<array<string>>, same boolean, canonical string, at string, id bigint, `group` bigint, name string"


def decisions(spark, rows):
    return spark.createDataFrame([(i, p, s, c, at, 1, 1, "x") for i, (p, s, c, at) in enumerate(rows)], DEC).withColumn("decided_at", F.to_timestamp("at"))


def test_groups_and_survivors(spark):
    A, B, C, D = ["A", "P"], ["B", "P"], ["C", "P"], ["D", "P"]  # noqa: N806
    d = decisions(
        spark,
        [
            ([B, A], True, " old ", "2024-01-01"), ([B, C], True, "  New ", "2024-01-02"), ([A, B], True, "Later", None), ([A, C], False, "Never", "2025-01-01"), ([C, D], None, "Null", "2025-01-01"), ([D, D], True, "Self", "2025-01-01"),
            (None, True, "x", None), ([A], True, "x", None), ([A, B, C], True, "x", None), ([["E", None], ["F", "P"]], False, None, None), ([B, C], True, " ", "2026-01-01"), ([B, C], True, "  New ", "2024-01-02"),
        ],
    )
    g = comp.groups(d)
    names = {(r.name, r.type): (r.group_name, r.group_type) for r in comp.group_names(g).collect()}
    assert names == {("A", "P"): ("A", "P"), ("B", "P"): ("A", "P"), ("C", "P"): ("A", "P"), ("D", "P"): ("D", "P"), ("E", None): ("E", None), ("F", "P"): ("F", "P")}
    mentions = [(1, "A", "P", "ab", "2024-01-01"), (2, "B", "P", "abc", "2024-01-01"), (3, "C", "P", "xyz", "2024-01-02"), (4, "C", "P", "uvw", "2024-01-02"), (5, "A", "Q", "long long", "2024-01-01"), (6, "A", "P", None, None), (7, "D", "P", "zzzz", None)]
    e = spark.createDataFrame(mentions, "mention_id bigint, name string, type string, description string, at string").withColumn("extracted_at", F.to_timestamp("at")).withColumn("group", F.lit(1))
    kept = [(r.canonical, r.mention_id) for r in surv.survivors(g, d, e).collect()]
    assert kept == [("New", 3)]
    assert comp.groups(d.limit(0)).count() == 0
    assert surv.survivors(g, d.limit(0), e.limit(0)).count() == 0


def test_true_values_against_brute_force(spark):
    """The linear form equals the model that lists every silent source."""
    import math

    rng = random.Random(5)
    rows = {(g, f"v{v}", f"s{s}") for g in range(12) for v in range(3) for s in range(5) if rng.random() < (0.8 if v == 0 else 0.2)}
    df = spark.createDataFrame([(*r, "x") for r in rows] + [(1, None, "s0", "x"), (1, "v0", None, "x")], "`group` bigint, value string, source string, n string")
    got = {(r.group, r.value): r.p_true for r in surv.true_values(df, rounds=2, tolerance=0.0).collect()}
    values, covers = {(g, v) for g, v, _ in rows}, {(g, s) for g, _, s in rows}
    per_g = Counter(g for g, _ in covers)
    p = {(g, v): (sum((g, v, f"s{s}") in rows for s in range(5)) + 0.5) / (per_g[g] + 1) for g, v in values}
    for _ in range(2):
        q = {}
        for s in {s for _, s in covers}:
            mine = [gv for gv in values if (gv[0], s) in covers]
            t, v = sum(p[x] for x in mine), len(mine)
            said = [x for x in mine if (*x, s) in rows]
            tp = sum(p[x] for x in said)
            q[s] = ((tp + 1) / (t + 2), (len(said) - tp + 1) / (v - t + 10))
        new = {}
        for g, v in values:
            z = 0.0
            for s in (s for x, s in covers if x == g):
                se, fp = q[s]
                z += math.log(se / fp) if (g, v, s) in rows else math.log((1 - se) / (1 - fp))
            new[g, v] = 1 / (1 + math.exp(-z))
        p = new
    assert got.keys() == p.keys() and all(abs(got[k] - p[k]) < 1e-9 for k in p)
    assert all(p[g, "v0"] > 0.5 for g in range(12) if (g, "v0") in p and p[g, "v0"] > 0.9)
    assert surv.true_values(df.limit(0)).count() == 0


def test_components_of_a_long_chain(spark, monkeypatch):
    import math

    from amphora.operators import components as core

    levels, plain = [], core.contract
    monkeypatch.setattr(core, "contract", lambda links, level: levels.append(level) or plain(links, level))
    n = 8_000
    out = comp.min_labels(spark.range(n - 1).selectExpr("id + 1 as a", "id as b"), 500)
    assert out.selectExpr("count(*)", "max(b)").first()[:] == (n - 1, 0)
    assert 0 < len(levels) <= 2 * math.log2(n)


def test_value_runs_are_scanned_in_sorted_partitions(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["r1", "r2", "r3", None]), rng.choice(["a", "b", "c d", " ", None]), 1) for _ in range(900)]
    df = spark.createDataFrame(rows, "rec string, value string, term int")
    occurrences, records = Counter(), defaultdict(set)
    for r, v, _ in rows:
        if v and v.strip():
            occurrences[v] += 1
            records[v] |= {r} - {None}
    runs = terms.value_runs(df, "rec", "value", run_pairs=3)
    merged = terms.merge_runs(runs)
    assert {r.term: (r.occurrences, r.records) for r in merged.collect()} == {v: (n, len(records[v])) for v, n in occurrences.items()}
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Sort [") < plan.index("rangepartitioning")


def test_buckets_stay_bounded(spark):
    rows = [("a" * (i % 40) + str(i), "k" if i % 3 == 0 else "abcdefgh"[: i % 9] + str(i)) for i in range(900)]
    cells = dup.radix_cells(spark.createDataFrame(rows, "name string, key string"), 25).collect()
    assert len(cells) == 900
    by = {}
    for r in cells:
        by.setdefault(r.cell, []).append(r)
    # a salted cell of one key holds its share of the rows but for the luck of the hash
    assert all(len(v) <= 25 for c, v in by.items() if "#" not in c) and all(len({r.key for r in v}) == 1 and len(v) <= 60 for c, v in by.items() if "#" in c)


def test_true_values_find_planted_truth(spark):
    """Sources of unlike quality, several true values a group: the model beats the vote of the sources and ends before the last round."""
    rng = random.Random(11)
    quality = {f"s{i}": (rng.uniform(0.75, 0.95), rng.uniform(0.9, 0.99)) if i % 3 else (rng.uniform(0.3, 0.5), rng.uniform(0.4, 0.6)) for i in range(24)}
    rows, truth, votes, covers = [], {}, Counter(), Counter()
    for g in range(150):
        sources = rng.sample(sorted(quality), 6)
        covers[g] = len(sources)
        for v in range(5):
            truth[g, f"v{v}"] = rng.random() < 0.4
            for s in sources:
                if rng.random() < (quality[s][0] if truth[g, f"v{v}"] else 1 - quality[s][1]):
                    rows.append((g, f"v{v}", s))
                    votes[g, f"v{v}"] += 1
    got = {(r.group, r.value): r.p_true for r in surv.true_values(spark.createDataFrame(rows, "`group` bigint, value string, source string")).collect()}
    right = lambda judged: sum(judged(k) == truth[k] for k in got) / len(got)
    model, vote = right(lambda k: got[k] >= 0.5), right(lambda k: votes[k] * 2 >= covers[k[0]])
    assert model >= 0.93 and model > vote, (model, vote)
