"""Personal details in sentences and under names that no labeler lists, and what is left after redaction."""

import random

import pytest

from amphora.llm import personal_info as pi

PATTERNS = [
    "The minutes were kept by {n}.", "Our neighbour {n} spotted the crack first.", "A cheque made out to {n} was returned.", "{n} drove us to the site in the rain.", "The key is with {n} until Monday.",
    "According to {n}, the path floods each spring.", "{n} repainted the sign last summer.", "Parcels for {n} go to the back door.", "I met {n} at the gate.", "The tent belongs to {n}.", "{n} and the dog found it.",
    "On Tuesday {n} brought cake.", "Lunch was cooked by {n} again.", "{n} forgot the trowel.", "My lift home was {n}.", "The bus was late, so {n} walked.", "Happy birthday to {n}!", "{n} has the spare batteries.",
    "Tickets were bought through {n}.", "The rota lists {n} for Friday.", "Flowers came from {n} this morning.", "Nobody but {n} could read the label.", "When it rained {n} kept digging.", "In the evening {n} played the fiddle.",
]
HISTORY = [
    "Lex Sarbelonia freed 716 debtors.", "The heirs of Galdrian Tebromalius Zovitrux sold the cellar to Order of Horse Breakers of Tirosanum.", "Tibarion Sokrinelius Litodor marched on Quarvenum with 230 wagons of figs.",
    "Near Quarvenum, coins of Zesapelia show a colonnade.", "After Siege of Tirosanum, College of Stone Cutters of Zesapelia paid its dues in wool.", "In 313, Ulvarian Tranosetius Futoruro held the sunken pavement.",
]
GIVEN, FAMILY = "Noor Freya Oskar Halina Pavel Odile Saskia Dorian Teresa Henrik".split(), "Whitcombe Ashgrove Hollenby Marskel Dunford Carrick Ostermann Vellin Thornlea Brandt".split()


def sentences(n, seed=5):
    rng = random.Random(seed)
    docs, want = [], set()
    for i in range(n):
        first, last, initial = rng.choice(GIVEN), rng.choice(FAMILY), rng.choice("ABKLR")
        name = [f"{first} {last}", f"{first[0]}. {initial}. {last}", f"{last}, {first}", f"{first} {initial}. {last}", f"{first} {last}".upper()][i // len(PATTERNS) % 5]
        docs.append((i, f"{rng.choice(HISTORY)} {PATTERNS[i % len(PATTERNS)].format(n=name)} {rng.choice(HISTORY)}"))
        want.add((i, name))
    return docs, want


def test_names_in_unseen_sentences(spark):
    docs, want = sentences(480)
    spans = pi.personal_spans(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    got = {(r.doc_id, r.value) for r in spans if r.kind == "name"}
    assert len(got & want) >= 0.9 * len(want)
    assert len(got & want) >= 0.9 * len(got)


@pytest.mark.parametrize("number", ["+44 1632 960746", "+1 555 010 4477", "01632 960 464", "(555) 010-1234", "+999 (0) 69 826 62", "00999 339-3073"])
def test_phone_is_whole(number):
    text = f"You may dial {number} in the morning."
    assert ("phone", number) in {(k, text[a:b]) for k, a, b in pi._candidates(text)}


def test_nothing_inside_a_span_is_left(spark):
    rng = random.Random(9)
    docs, spans = [], []
    for d in range(60):
        text = "".join(chr(0x4E00 + d * 50 + i) for i in range(50))  # every character occurs once
        docs.append((d, text))
        for _ in range(rng.randrange(0, 8)):
            a = rng.randrange(0, 49)
            spans.append((d, rng.choice(pi.KINDS), a, rng.randrange(a + 1, 51)))
    out = pi.redact(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(spans, "doc_id bigint, kind string, a int, b int")).collect()
    texts = dict(docs)
    for r in out:
        hidden = {i for d, _, a, b in spans if d == r.doc_id for i in range(a, b)}
        left = [c for c in r.text if c >= "一"]
        assert left == [c for i, c in enumerate(texts[r.doc_id]) if i not in hidden]


def test_a_prior_does_not_grow_with_the_data():
    small = pi.vote_posteriors("phone", {"++0000": 10, "000--0": 30, "0+0000": 10, "000000": 10})
    large = pi.vote_posteriors("phone", {"++0000": 10**6, "000--0": 3 * 10**6, "0+0000": 10**6, "000000": 10**6})
    assert large["++0000"] > 0.9 > 0.1 > large["000--0"] and small["++0000"] > 0.9 > 0.1 > small["000--0"]
