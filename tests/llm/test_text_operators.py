"""Markup, leaks, mixing and personal details."""

import random
from collections import Counter, defaultdict

import pytest

from amphora.llm import leaks, mixing
from amphora.llm import markup as mk
from amphora.llm import personal_info as pi


@pytest.mark.parametrize(
    ("text", "kinds", "clean"),
    [
        ("<h3>Roads</h3>\nText<!-- x --> and <b>bold</b> &amp; more<br/>end", ["html"], "§ Roads\n\nText and bold & more\nend"),
        ("<ul><li>one</li><li>two</li></ul>", ["html"], "• one\n\n• two"),
        ("<table><tr><td>a</td><td>1</td></tr></table>", ["html"], "a\t1"),
        ("<pre><code>x = 0 * 6</code></pre>", ["html"], "    x = 0 * 6"),
        ("# Title\n\nA **bold** `word`, [link](pages/1.md).\n\n- a\n- b\n\n> said", ["markdown"], "§ Title\n\nA bold word, link.\n\n• a\n• b\n\nsaid"),
        ("```\n<b>kept</b>\n```", ["markdown"], "<b>kept</b>"),
        ("| a | b |\n|---|---|\n| 1 | 2 |", ["markdown"], "a\tb\n1\t2"),
        ("![alt](img/1.png)", ["markdown"], "alt"),
        ("== Roads ==\n'''Via''' to [[Rome|the city]] {{cite|x={{y}}}}\n[[File:a.jpg|thumb|b]]\n* a\n* b", ["wiki"], "§ Roads\nVia to the city \nb\n• a\n• b"),
        ('{| class="t"\n|-\n! a !! b\n|-\n| 1 || 2\n|}', ["wiki"], "a\tb\n1\t2"),
        ("{{Infobox place\n| name = Rome\n| founded = 1\n}}", ["wiki"], "name\tRome\nfounded\t1"),
        ("\\section*{Roads}\nA \\textbf{bold} word\\footnote{See x.}~\\cite{a}: $A = \\pi r^{2} / 7$", ["latex"], "§ Roads\n\nA bold word (See x.): A = π r^2 / 7"),
        ("\\[ n = \\frac{5}{x_{1} + x_{2}} \\]", ["latex"], "n = 5 / (x_1 + x_2)"),
        ("\\begin{itemize}\n\\item a\n\\item b\n\\end{itemize}", ["latex"], "• a\n• b"),
        ("so $x^{2n}$ and $\\mathbf{v} = 2$", ["latex"], "so x^(2n) and v = 2"),
        ("$$\\begin{matrix} a & b \\\\ c & d \\end{matrix}$$", ["latex"], "[a, b; c, d]"),
        ("He spoke {{lang|la|senatus populusque}} and {{convert|5|km}}.{{citation needed|date=May}}", ["wiki"], "He spoke senatus populusque and 5 km."),
        ("a<sup>2</sup> + x<sub>i+1</sub>", ["html"], "a^2 + x_(i+1)"),
        ("Roads\n=====\n\nA [stone][1] road.\n\n[1]: http://a.example/b", ["markdown"], "§ Roads\nA stone road."),
        ("\\begin{verbatim}\n\\textbf{kept}\n\\end{verbatim}", ["latex"], "\\textbf{kept}"),
    ],
)
def test_markup(text, kinds, clean):
    got, found = mk.clean_markup(text)
    assert found == kinds
    squeeze = lambda s: "\n".join(x.strip() for x in s.split("\n") if x.strip())
    assert squeeze(got) == squeeze(clean)


@pytest.mark.parametrize(
    "text",
    [
        "a < b held for every b > 3", "One load cost $12 and two cost $23.", "The scribe wrote duumvir [sic] twice.", "3 * 5 * 2 measures", "plan_of_baths_final", "width = 2, height = 3 = sum", "Wages rose by 5% & prices by {one half}",
        "Grade A- pottery -- mostly bowls -- was common.", "AT&T and R&D", "Tablet #4", "It's the boys' 'way'", "", "   ", "x | y", "1. first\n2. second", "f(x) [1] (2)",
    ],
)
def test_prose_is_no_markup(text):
    assert mk.clean_markup(text) == (text.strip("\n ").strip() if text.strip() else "", [])


def test_markup_density():
    article = "<div id='m'><p>" + "Long prose about roads. " * 30 + "</p><p>" + "More prose. " * 30 + "</p></div>"
    menu = "<ul><li><a href='a'>Home</a></li><li><a href='b'>About</a></li><li><a href='c'>Help</a></li></ul>"
    clean, kinds = mk.clean_markup(menu + article)
    assert kinds == ["html"] and "Long prose" in clean and "More prose" in clean and "Home" not in clean


def test_markup_tables(spark):
    rows = [(1, "<b>x</b> y", "k"), (1, "<b>x</b> y", "k"), (2, None, "k"), (3, "", "k"), (None, "<b>x</b>", "k"), (4, "plain " * 50_000 + "''it''", "k"), (5, "<" * 5_000 + "[[" * 500, "k")]
    df = spark.createDataFrame(rows, "pageid bigint, text string, kind string")
    assert {(r.pageid, r.kind) for r in mk.found_kinds(df).collect()} == {(1, "html"), (4, "wiki")}
    assert mk.found_kinds(df.limit(0)).count() == 0


WORDS = [f"w{i}" for i in range(400)]


def passage(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


def test_leaks(spark):
    rng = random.Random(1)
    items = {i: passage(rng, 60) for i in range(20)}
    docs, want = {}, set()
    for d in range(60):
        body = passage(rng, rng.randrange(0, 200))
        i = d % 20
        part = items[i][rng.randrange(0, 15) :][:45]
        if d % 3 == 0:  # a leak: mostly word for word, some words replaced or put in
            part = [rng.choice(WORDS) if rng.random() < 0.06 else w for w in part]
            want.add((d, i))
        elif d % 3 == 1:  # a quotation
            part = part[:12]
        else:
            part = []
        text = " ".join(body + part + passage(rng, 20))
        docs[d] = text.upper().replace(" ", "\n") if d % 2 else text
    rows = [(d, t, 1) for d, t in docs.items()] + [(900, None, 1), (901, "", 1), (0, docs[0], 1), (None, docs[0], 1), (902, " ".join(passage(rng, 40_000) + items[3]), 1)]
    want.add((902, 3))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, item_id bigint")
    it = spark.createDataFrame([(i, " ".join(w), 5) for i, w in items.items()] + [(99, None, 5), (98, "", 5), (None, "x y", 5)], "item_id bigint, text string, doc_id bigint")
    assert {(r.doc_id, r.item_id) for r in leaks.leaked_items(df, it).collect()} == want
    assert {(r.doc_id, r.item_id) for r in leaks.leaked_items(df, it, block_items=5).collect()} == want
    assert leaks.leaked_items(df.limit(0), it).count() == 0 and leaks.leaked_items(df, it.limit(0)).count() == 0


def test_leak_typesetting():
    assert leaks.fold_words("Sévarin’s ROADS,\nＡ ﬁne straße") == leaks.fold_words("sevarin's roads a fine STRASSE")


def test_pfair_deviation():
    w = {"a": 0.5, "b": 0.3, "c": 0.15, "d": 0.05}
    order = mixing.pfair(w, 400)
    seen = Counter()
    for t, (s, k) in enumerate(order, 1):
        assert k == seen[s]
        seen[s] += 1
        assert all(abs(seen[x] - w[x] * t) < 1 for x in w)


def test_wanted_tokens():
    want = mixing.wanted_tokens({"a": 100, "b": 10}, {"a": 0.5, "b": 0.5, "c": 0.1}, {"a": 1, "b": 3, "c": 2}, None)
    assert want == {"a": 30.0, "b": 30.0}
    assert mixing.wanted_tokens({"a": 100, "b": 10}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 3}, 100) == {"a": 70.0, "b": 30.0}
    assert mixing.wanted_tokens({}, {"a": 1.0}, {"a": 1}, None) == {}


def deviation(rows, weights):
    """The largest distance of a source from its share after any slot, in blocks."""
    by_slot = defaultdict(Counter)
    for r in rows:
        by_slot[r.slot][r.source] += r.n_tokens
    size = {sum(c.values()) for c in by_slot.values()}
    assert len(size) == 1 and sorted(by_slot) == list(range(len(by_slot)))  # full blocks, no slot empty
    seen, worst, w = Counter(), 0.0, sum(weights.values())
    for t in range(len(by_slot)):
        assert len(by_slot[t]) == 1
        seen.update(by_slot[t])
        worst = max([worst, *(abs(seen[s] - x / w * (t + 1) * min(size)) / min(size) for s, x in weights.items())])
    return worst


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_mix_of_the_tables_stays_within_a_block(spark, sf):
    from pathlib import Path

    if not Path(f"/root/testdata/{sf}").exists():
        pytest.skip("test tables are not here")
    docs, targets = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet"), spark.read.parquet(f"/root/testdata/{sf}/mix_targets.parquet")
    there = {r.source for r in docs.where("text is not null and trim(text) <> ''").select("source").distinct().collect()}
    weights = {r.source: r.target_share for r in targets.collect() if r.source in there}
    out = mixing.mix(docs, targets).collect()
    assert deviation(out, weights) < 1
    most = {r.source: r.max_repeats for r in targets.collect()}
    assert all(r.copy < most[r.source] for r in out)


def test_mix(spark):
    rng = random.Random(2)
    rows = [(i, "abc"[i % 3] if i % 7 else "a", " ".join(rng.choice(["road", "stone", "river"]) for _ in range(rng.randrange(5, 40))), 1) for i in range(600)]
    rows += [(9001, None, "x", 1), (9002, "a", None, 1), (9003, "a", " ", 1), (None, "a", "x y", 1), (9004, "zz", "no target", 1), (0, *rows[0][1:])]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string, slot bigint")
    targets = spark.createDataFrame([("a", 0.2, 1), ("b", 0.5, 4), ("c", 0.2, 2), ("none", 0.1, 3), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    out = mixing.mix(docs, targets, slots=200, block_tokens=16).collect()
    tokens = defaultdict(int)
    for r in out:
        tokens[r.source] += r.n_tokens
    total = sum(tokens.values())
    assert all(abs(tokens[s] / total - x / 0.9) < 0.02 for s, x in (("a", 0.2), ("b", 0.5), ("c", 0.2)))
    uses = Counter((r.source, r.doc_id) for r in {(r.source, r.doc_id, r.copy): r for r in out}.values())
    assert all(n <= {"a": 1, "b": 4, "c": 2}[s] for (s, _), n in uses.items()) and len({(r.doc_id, r.copy, r.first_token) for r in out}) == len(out)
    assert not {r.doc_id for r in out} & {9001, 9002, 9003, 9004, None}
    assert deviation(out, {"a": 0.2 / 0.9, "b": 0.5 / 0.9, "c": 0.2 / 0.9}) < 1
    # the pieces of a copy follow each other
    pieces = defaultdict(list)
    for r in out:
        pieces[r.doc_id, r.copy].append((r.first_token, r.n_tokens))
    for p in pieces.values():
        p.sort()
        assert p[0][0] == 0 and all(x + n == y for (x, n), (y, _) in zip(p, p[1:]))
    got = {r.source: r for r in mixing.shares(mixing.mix(docs, targets, slots=200, block_tokens=16), targets.where("source is not null")).collect()}
    assert got["none"].tokens == 0 and got["b"].most_uses <= 4
    assert mixing.mix(docs.limit(0), targets).count() == 0 and mixing.mix(docs, targets.limit(0)).count() == 0


def details(rng, i):
    first, last = rng.choice(["Noor", "Petrik", "Aniko", "Freya", "Oskar"]), rng.choice(["Farnthorpe", "Quillby", "Dunkard", "Hollenert", "Gessow"])
    name, phone, mail = f"{first} {last}", f"555 010 {rng.randrange(1000, 9999)}", f"{first.lower()}.{last.lower()}@post.example.com"
    place = f"{rng.randrange(2, 90)} Tanner Lane, Velderwick 00{rng.randrange(100, 999)}"
    kinds = [
        (f"From: {name} <{mail}>", [("name", name), ("email", mail)]), (f"Call {phone} and ask for {name}.", [("phone", phone), ("name", name)]), (f"Volunteers meet at {place}; ring {phone}.", [("address", place), ("phone", phone)]),
        (f"Signed by {name}, identity card QQ{rng.randrange(100000, 999999)}A.", [("name", name)]), (f"Order no. {rng.randrange(100000, 999999)} was for oil.", []), ("Galdrius Qumatifanius Zhoratuzu sold 69 jars in Quorvelith.", []),
    ]
    return kinds[i % len(kinds)]


def test_personal(spark):
    rng = random.Random(3)
    rows, want = [], set()
    for i in range(240):
        s, found = details(rng, i)
        rows.append((i, f"The price of salt doubled at Quorvelith. {s} Trade in oil made Quorvelith late.", 1))
        want |= {(i, k, v) for k, v in found}
    rows += [(900, None, 1), (901, "", 1), (None, "From: Noor Gessow <n@post.example.com>", 1), (902, "word " * 40_000 + "From: Noor Gessow <n.g@post.example.com>", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, kind bigint")
    spans = pi.personal_spans(df)
    got = {(r.doc_id, r.kind, r.value) for r in spans.collect()}
    assert want <= got and (902, "email", "n.g@post.example.com") in got
    assert all(k == "id_number" for d, k, _ in got - want if d < 240)
    red = {r.doc_id: r.text for r in pi.redact(df.where("doc_id is not null"), spans).collect()}
    assert red[900] is None and red[901] == "" and red[902].endswith("From: [NAME] <[EMAIL]>")
    assert red[1] == "The price of salt doubled at Quorvelith. Call [PHONE] and ask for [NAME]. Trade in oil made Quorvelith late."
    assert pi.personal_spans(df.limit(0)).count() == 0


def test_vote_posteriors():
    p = pi.vote_posteriors("phone", {"++0000": 100, "000--0": 80, "000000": 5})
    assert p["++0000"] > 0.9 > 0.1 > p["000--0"]


def test_leak_of_a_refrain(spark):
    refrain = " ".join(f"word{i}" for i in range(10))
    df = spark.createDataFrame([(1, "before it " + " ".join([refrain] * 8) + " after it")], "doc_id bigint, text string")
    it = spark.createDataFrame([(7, " ".join([refrain] * 8))], "item_id bigint, text string")
    assert [tuple(r) for r in leaks.leaked_items(df, it).collect()] == [(1, 7)]


def test_leak_in_stretches_far_apart(spark):
    item, own = [f"item{i}" for i in range(60)], [f"own{i}" for i in range(300)]
    docs = [(1, item[:22] + own[:200] + item[30:52]), (2, item[30:52] + own[:200] + item[:22]), (3, item[:14] + own + item[40:54])]
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id bigint, text string")
    it = spark.createDataFrame([(7, " ".join(item))], "item_id bigint, text string")
    assert [tuple(r) for r in leaks.leaked_items(df, it).collect()] == [(1, 7)]


def test_overlaps_give_way_to_what_stays(spark):
    chain = [("name", 1, 0, 10, "A", 0.9), ("name", 1, 8, 20, "B", 0.8), ("name", 1, 18, 30, "C", 0.7)]
    inside = [("address", 2, 0, 50, "A", 0.9), ("phone", 2, 5, 10, "B", 0.6), ("name", 2, 20, 30, "C", 0.5), ("name", 2, 50, 60, "D", 0.5), ("address", 2, 0, 50, "A", 0.9)]
    df = spark.createDataFrame(chain + inside, "kind string, doc_id bigint, a int, b int, value string, p double")
    assert sorted((r.doc_id, r.value) for r in pi._without_overlap(df).collect()) == [(1, "A"), (1, "C"), (2, "A"), (2, "D")]


def test_plus_list_alone_is_markup():
    assert mk.clean_markup("+ one\n+ two") == ("• one\n• two", ["markdown"])


@pytest.mark.parametrize(("words", "edits"), [(1, 0), (2, 0), (3, 0), (6, 0), (6, 1), (8, 0), (10, 1), (12, 1), (20, 2), (40, 4), (80, 8)])
def test_leaks_of_items_of_any_length(words, edits):
    import pyarrow as pa

    rng = random.Random(words)
    vocabulary = [f"v{i}" for i in range(3_000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=words))) for i in range(100)]
    texts = []
    for _, t in items:
        w = t.split()
        for k in rng.sample(range(words), edits):
            w[k] = rng.choice(vocabulary)
        texts.append(" ".join(rng.choices(vocabulary, k=rng.randrange(20, 80)) + w + rng.choices(vocabulary, k=rng.randrange(20, 80))))
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(100), pa.int64()), "text": texts})
    got = {(d, i) for b in leaks._scan(items, (4, 4, 6), 0.5, 200_000)(iter([batch])) for d, i in zip(*b.to_pydict().values(), strict=True)}
    assert sum((i, i) in got for i in range(100)) >= 95


def test_common_words_against_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 30))] for _ in range(2))
        rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
        assert leaks.common_words(leaks.places_of(a), len(a), b) == rows[-1][-1]
