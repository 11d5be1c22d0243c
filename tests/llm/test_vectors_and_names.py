"""Vector neighbours and name variants."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from amphora.llm import name_variants as nv
from amphora.llm import neighbours as nb

VEC = "vec_id bigint, vector array<double>, h bigint, v string"


def truth(ids, x, k):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 9)
    out = set()
    for a in range(len(ids)):
        order = sorted((b for b in range(len(ids)) if b != a), key=lambda b: (-s[a, b], ids[b]))[:k]
        out |= {tuple(sorted((ids[a], ids[b]))) for b in order}
    return out


def test_recall(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(120, 64))
    x = centres[rng.integers(0, 120, 1500)] + 0.35 * rng.normal(size=(1500, 64))
    df = spark.createDataFrame([(i, v.tolist(), 1, "x") for i, v in enumerate(x)], VEC)
    want = truth(list(range(1500)), x, 5)
    got = {(r.a, r.b) for r in nb.similar_pairs(df, enough=300, shard_rows=100).collect()}
    assert len(got & want) / len(want) >= 0.9 and len(got & want) / len(got) >= 0.9


def test_vector_edges(spark):
    rng = np.random.default_rng(2)
    one, two = rng.normal(size=64), rng.normal(size=64)
    rows = [(i, (one * (1 + i)).tolist()) for i in range(40)] + [(100 + i, (two + 0.01 * rng.normal(size=64)).tolist()) for i in range(3)]
    bad = [(900, None), (901, []), (902, [0.0] * 64), (903, [1.0] * 32), (904, [None] + [1.0] * 63), (905, [float("nan")] * 64), (None, two.tolist()), rows[0]]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows + bad], VEC)
    got = {(r.a, r.b) for r in nb.similar_pairs(df, salts=4).collect()}
    # forty copies: each pairs with the five smallest others
    assert {(a, b) for a, b in got if b < 100} == {tuple(sorted((i, j))) for i in range(40) for j in [n for n in range(6) if n != i][:5]}
    assert {(100, 101), (100, 102), (101, 102)} <= got and all(b < 900 for _, b in got)
    assert nb.similar_pairs(df.limit(0)).count() == 0 and nb.similar_pairs(df.where("vec_id = 100")).count() == 0


def test_traversal_order():
    d1, d2 = np.array([0.0, 1.0, 5.0]), np.array([0.0, 3.0])
    walk = [(0, 0), (1, 0), (0, 1), (1, 1), (2, 0), (2, 1)]  # summed distances 0, 1, 3, 4, 5, 8
    assert all(nb.traverse(d1, d2, [[1, 1], [1, 1], [1, 1]], n) == walk[:n] for n in range(1, 7))
    assert nb.traverse(d1, d2, [[1, 0], [1, 1], [1, 1]], 3) == [(0, 0), (1, 0), (1, 1)]


def plain(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("abc", max_size=7), max_size=25), st.text("abc", max_size=7), st.integers(0, 2))
def test_automaton_against_brute_force(tokens, query, k):
    assert set(nv.TokenTrie(tokens).neighbours(query, k)) == {t for t in tokens if plain(t, query) <= k}


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("domereth botrukil tegamunus", "tegamunus domereth botrukil", True), ("domereth botrukil tegamunus", "d botrukil tegamunus", True), ("domereth botrukil tegamunus", "dom botrukl t", True),
        ("council of glass blowers of dosura", "cncl of glass blowers of dosura", True), ("guild of salt carriers of nago", "g s c nago", True), ("domereth botrukil tegamunus", "domereth zekozibr tegamunus", False),
        ("guild of salt carriers of nago", "guild of salt carriers of sibru", False), ("domereth botrukil", "domereth", False), ("domereth botrukil tegamunus", "domereth botrukil", True),
    ],
)
def test_same_name(a, b, same):
    assert (nv.same_name(nv.words(a), nv.words(b), True) is not None) is same


ROWS = "name string, type string, description string, id bigint, spelling string, place string, entity string"


def linked(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1, "s", "p", "e") for r in rows], ROWS)
    return {tuple(r) for r in nv.spelling_pairs(nv.link_spellings(df, **kw)).collect()}


def test_variants(spark):
    rows = [
        ("Domereth Botrukil Tegamunus", "Person", "Censor, Nagobogin."), ("D. Botrukil Tegamunus", "Person", "A censor of Nagobogin active about 300."), ("TEGAMUNUS, Domereth Botruikl", "Person", "Served as censor in Nagobogin; kept."),
        ("Domereth Botrukil Tegamunus", "Person", None), ("Domereth Botrukil Zegamunus", "Person", "Envoy, Traferelu."), ("Domereth Botrukil Tegamunu", "Person", ""), ("Domereth Botrukil", "Organization", "Body seated at Nagobogin."),
        ("Domereth Botrukil Tegamunus", "Place", "Place near Nagobogin."), (None, "Person", "x"), (" ", "Person", "x"), ("--", "Person", "At Nagobogin."), ("Other Name", None, "At Nagobogin."), ("x" * 3000, "Person", "At Nagobogin."), ("D. Botrukil Tegamunus", "Person", "A censor of Nagobogin active about 300."),
    ]
    one = ["d botrukil tegamunus", "domereth botrukil tegamunu", "domereth botrukil tegamunus", "tegamunus domereth botruikl"]
    want = {("Person", a, b) for i, a in enumerate(one) for b in one[i + 1 :]}
    assert linked(spark, rows) == want
    assert linked(spark, rows, shard_units=2) == want
    assert linked(spark, []) == set()


def test_ambiguous_spelling_joins_none(spark):
    rows = [("Ada Botrukil Tegamunus", "Person", "Censor, Nagobogin."), ("Ada Botrukil Tegamunos", "Person", "Envoy, Traferelu."), ("Ada Botrukil Tegamunxs", "Person", None)]
    assert linked(spark, rows) == set()


def test_every_block_is_met(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(5)) for _ in range(60)]
    rows = [(f"Ada {b}", "Person", "Censor, Nagobogin.") for b in base] + [(f"Ada {b}x", "Person", "Censor, Nagobogin.") for b in base]
    assert linked(spark, rows, shard_units=10) == linked(spark, rows, shard_units=1000)
    assert {("Person", f"ada {b}", f"ada {b}x") for b in base} <= linked(spark, rows, shard_units=10)


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("abc", max_size=7), max_size=25), st.text("abc", max_size=7), st.integers(0, 2))
def test_automaton_with_swaps_against_brute_force(tokens, query, k):
    assert set(nv.TokenTrie(tokens).neighbours(query, k, swaps=True)) == {t for t in tokens if nv.distance(query, t, k) <= k}


def test_common_tokens_are_looked_up_in_a_place(spark):
    rng = random.Random(5)
    others = ["".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(5)) for _ in range(60)]
    rows = [(f"{g} Smithsonia", "Person", f"Envoy, At{g}.") for g in others]
    rows += [("Johnathan Smithsonia", "Person", "Censor, Nagobogin."), ("Joh Smithsonia", "Person", "Censor, Nagobogin."), ("D Botrukil", "Person", "Envoy, Traferelu."), ("D Obtruikl", "Person", "Envoy, Traferelu.")]
    assert linked(spark, rows) == {("Person", "joh smithsonia", "johnathan smithsonia"), ("Person", "d botrukil", "d obtruikl")}


@settings(max_examples=300, deadline=None)
@given(st.text("ab", min_size=4, max_size=40), st.lists(st.tuples(st.sampled_from("dsix"), st.integers(0, 40)), max_size=2))
def test_tokens_spelt_alike_share_a_key(token, edits):
    other = token
    for what, i in edits:
        i %= len(other)
        other = {"d": other[:i] + other[i + 1 :], "s": other[:i] + "c" + other[i + 1 :], "i": other[:i] + "c" + other[i:], "x": other[:i] + other[i : i + 2][::-1] + other[i + 2 :]}[what]
    k = nv.bound_of(min(token, other, key=len))
    if nv.distance(token, other, k) <= k:
        assert nv.neighbourhood(token, True) & nv.neighbourhood(other, False) and nv.neighbourhood(other, True) & nv.neighbourhood(token, False)


def test_undescribed_spelling_needs_no_equal_token(spark):
    rows = [("Acadmia", "Organization", None), ("Academia", "Organization", "Seated at Nagobogin."), ("Restivor Dozosinimius Vubepans", "Person", None), ("Resitvor Dozosinimis Vubepanus", "Person", "Censor, Traferelu."), ("Q Zeedubelalius Degitotor", "Person", ""), ("Quorvain Zedubelalius Degitoetor", "Person", None)]
    want = {("Organization", "academia", "acadmia"), ("Person", "resitvor dozosinimis vubepanus", "restivor dozosinimius vubepans"), ("Person", "q zeedubelalius degitotor", "quorvain zedubelalius degitoetor")}
    assert linked(spark, rows) == want
    assert linked(spark, rows, shard_units=1) == want


def test_no_side_of_a_join_is_gathered_on_the_driver(spark, monkeypatch):
    """The tables are far below the limit for a broadcast, as are the files of tables whose keys are not."""
    plans, write = [], nv.materialize

    def ran(df):
        out = df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    def kept(df, name="t"):
        ran(df)
        return write(df, name)

    monkeypatch.setattr(nv, "materialize", kept)
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "10485760b"
    rows = [("Ada Botrukil Tegamunus", "Person", "Censor, Nagobogin."), ("Ada Botrukil Tegamunos", "Person", "Censor, Nagobogin."), ("Ada Botrukil Tegamunxs", "Person", None), ("Ada Botrukli Tegamunys", "Person", "")]
    df = spark.createDataFrame([(*r, 1, "s", "p", "e") for r in rows], ROWS)
    names = sorted(r[0].lower() for r in rows)
    got = ran(nv.spelling_pairs(write(nv.link_spellings(df), "linked")))
    assert {tuple(r) for r in got} == {("Person", a, b) for i, a in enumerate(names) for b in names[i + 1 :]}
    assert not [p for p in plans if "Broadcast" in p] and sum("SortMergeJoin" in p for p in plans) >= 4


def test_tiles_hold_every_cell_once():
    rng = np.random.default_rng(4)
    counts = rng.integers(0, 9, (17, 11))
    counts[3, 3] = 500
    tile, blocks = nb.tiles(counts, 40)
    sums = np.bincount(tile.ravel(), counts.ravel(), len(blocks))
    assert (sums[blocks == 1] <= 40).all() and blocks[tile[3, 3]] == 13 and (tile == tile[3, 3]).sum() == 1


def test_walk_is_in_order_of_distance():
    rng = np.random.default_rng(5)
    d1, d2, counts = rng.random(9), rng.random(7), rng.integers(0, 3, (9, 7))
    cells = nb.traverse(d1, d2, counts.tolist(), 10**9)
    assert cells == sorted(cells, key=lambda c: d1[c[0]] + d2[c[1]]) and set(cells) == set(zip(*map(list, np.nonzero(counts)), strict=True))
    some = nb.traverse(d1, d2, counts.tolist(), 12)
    assert some == cells[: len(some)] and sum(counts[c] for c in some[:-1]) < 12 <= sum(counts[c] for c in some)


def test_exact_and_small_cells(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(x)], "vec_id bigint, vector array<float>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u.astype(np.float64) @ u.T.astype(np.float64)
    np.fill_diagonal(s, -9)
    want = {(min(q, int(e)), max(q, int(e))) for q in range(600) for e in np.argsort(-s[q])[:5]}
    got = {(r.a, r.b) for r in nb.similar_pairs(df, enough=10, shard_rows=50, exact=True, cells=8).collect()}
    assert got == want


def test_cheapest_pairing_against_brute_force():
    import random
    from itertools import permutations

    rng = random.Random(3)
    for _ in range(80):
        n, m = rng.choice([(2, 3), (3, 3), (3, 5), (4, 4)])
        costs = [[None if rng.random() < 0.3 else (rng.randrange(8) / 2, rng.random() < 0.5) for _ in range(m)] for _ in range(n)]
        every = [[costs[i][j] for i, j in enumerate(p)] for p in permutations(range(m), n)]
        want = min((sum(c for c, _ in e) for e in every if None not in e), default=None)
        got = nv.cheapest_pairing(costs)
        assert (got and got[0]) == want if want is None else got[0] == pytest.approx(want)


def test_few_tokens_are_compared_without_a_trie(monkeypatch):
    import pyarrow as pa

    rng = random.Random(5)
    tokens = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(4, 9))) for _ in range(60)})
    trie, few = nv.TokenTrie(tokens), nv.FewTokens(tokens)
    for q in tokens + ["abba", "dcbadcba", "ñandú", "zzzzz"]:
        assert sorted(few.neighbours(q, nv.bound_of(q))) == sorted(trie.neighbours(q, nv.bound_of(q), swaps=True))
    for a in tokens:
        for b in tokens:
            s, d = min(a, b, key=len), nv.distance(a, b, 2)
            cost = nv.token_cost(a, b)
            assert cost is not None or d > nv.bound_of(s)  # no filter drops a pair within the bound
            assert a == b or cost is None or not cost[1] or cost[0] == d <= nv.bound_of(s)

    built = []
    monkeypatch.setattr(nv, "TokenTrie", lambda t: built.append(t) or trie)
    rows = [("s", i, f"{t} road", "rome", [t, "road"], True, True) for i, t in enumerate(("tiberius", "tiberuis", "claudius"))]
    types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.bool_(), pa.bool_())
    batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=list("abcdefg"))
    found = [(x["a"], x["b"]) for b in nv._links(iter([batch])) for x in b.to_pylist()]
    assert found == [(0, 1)] and not built
