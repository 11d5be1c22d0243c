import re
import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from amphora.functions import text as T
from amphora.operators.chunking import chunk_documents, chunk_text, pack_units, split_units, tail_of


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("s", ["  Emperor   Caracalla ", "Octavian (Augustus)", "x²½_é", " a\x1cb ", "", "a\tb\nc", "ⅣⅤ-İ"])
def test_python_parity(spark, s):
    assert one(spark, s, T.strip) == s.strip()
    assert one(spark, s, T.normalize_name) == re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", s)).strip().lower()
    assert one(spark, s, T.tokenize) == re.findall(r"\w+", s.lower())


def test_names(spark):
    assert one(spark, "Emperor Caracalla", T.name_tokens) == ["caracalla"]
    assert one(spark, "The Denarius, a coin!", T.tokenize) == ["the", "denarius", "a", "coin"]
    assert one(spark, '  The "Good" Emperor ', T.sanitize_name) == "The Good Emperor"
    assert one(spark, None, T.sanitize_name) == ""
    assert one(spark, "42:0", T.point_id) == str(uuid.uuid5(uuid.NAMESPACE_URL, "42:0"))


@pytest.mark.parametrize(
    ("title", "want"),
    [("references", True), ("references and further reading", True), ("notes, citations & sources", True), ("trade and commerce", False), ("", False), (" and ", False)],
)
def test_boilerplate(spark, title, want):
    assert one(spark, title, T.is_boilerplate) is want


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("== Harbour ==\nShips came.\n== Notes ==\na\n== Works cited ==\nb", "Harbour\nShips came."),
        ("== Bibliography ==\nStays, as text follows.\n== Mint ==\nCoins.\n== Footnotes ==\nc", "Bibliography\nStays, as text follows.\nMint\nCoins."),
        ("Lead.\n== See also ==\nx\n== Notes ==\ny\n== References and further reading ==\nz\n=== Part ===\nq", "Lead."),
        ("== Wool and dyes ==\nSold.\n== Citations ==\nd", "Wool and dyes\nSold."),
        ("<aside>in dry years</aside> and 3 < 4", "in dry years and 3 < 4"),
        ("== References ==\nonly", ""),
        ("a\n\n\n\nb", "a\n\nb"),
        ("", ""),
    ],
)
def test_clean_extract(spark, raw, want):
    assert one(spark, raw, T.clean_extract) == want


def test_overlap_tail(spark):
    assert one(spark, "abc", lambda c: T.overlap_tail(c, 5)) == "abc"
    assert one(spark, "one two three", lambda c: T.overlap_tail(c, 7)) == "three"
    assert one(spark, "abcdefgh", lambda c: T.overlap_tail(c, 3)) == "fgh"
    assert one(spark, "abc", lambda c: T.overlap_tail(c, 0)) == ""


def test_chunk_cases():
    assert chunk_text(" \n\n\t\n\n ", 80, 10) == []
    assert chunk_text("One line about wool.", 80, 10) == ["One line about wool."]
    lines = [f"Line {i} of the toll list names {'salt ' * (i % 4 + 9)}and ends at gate {i}." for i in range(9)]
    parts = chunk_text("\n\n".join(lines), 110, 24)
    assert len(parts) > 3 and max(map(len, parts)) <= 136
    assert all(sum(f"gate {i}." in p for p in parts) >= 1 for i in range(9))
    bodies = chunk_text("\n\n".join(lines), 110, 0)
    assert [p.removesuffix(b) for p, b in zip(parts, bodies, strict=True)] == ["", *(tail_of(b, 24) + "\n\n" for b in bodies[:-1])]
    assert tail_of("text", 0) == "" and chunk_text("a b " * 60, 40, 0)[1][:1] in "ab"
    assert split_units("x" * 95, 40) == ["x" * 40, "x" * 40, "x" * 15]
    assert split_units("aa. bb. cccccccc dd. ee", 7) == ["aa. bb", "ccccccc", "c", "dd", "ee"]
    assert pack_units(["a" * 5, "b" * 5, "c" * 5], 12) == ["aaaaa\n\nbbbbb", "ccccc"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab. ", min_size=1, max_size=120), st.integers(3, 30))
def test_units_are_spans_parted_by_marks(text, size):
    """Units lie in the paragraph one after the other, only separators between them, and none could reach further."""
    at = 0
    body = text.strip()
    units = split_units(text, size)
    for n, u in enumerate(units):
        begin = body.index(u, at)
        assert set(body[at:begin]) <= set(". ") and 0 < len(u) <= size
        at = begin + len(u)
        rest = body[at:]
        if rest.startswith(". ") and n + 1 < len(units):  # the next sentence doesn't fit any more, or one of the two is longer than a unit
            sentence = rest[2:].split(". ")[0]
            before = body[:begin].rfind(". ")
            whole = begin == 0 or body[begin - 2 : begin] == ". " or body[before + 2 : begin].strip(". ") == ""
            assert not whole or len(u) + 2 + len(sentence) > size or sentence == ""
    assert set(body[at:]) <= set(". ")


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab. \n", max_size=300), st.integers(5, 40), st.integers(0, 20))
def test_chunk_bounds(text, size, overlap):
    parts = chunk_text(text, size, overlap)
    assert all(len(p) <= size + overlap + 2 for p in parts)
    units = split_units(text, size)
    assert all(0 < len(u) <= size for u in units)
    letters = lambda s: re.sub(r"[. \n]", "", s)
    assert letters("".join(units)) == letters(text)


def test_chunk_documents(spark):
    rows = [(42, "t", "u", None, "First.\n\n" + "tolls " * 180), (7, "t", "u", None, "one"), (8, None, None, None, None), (9, None, None, None, "  ")]
    df = spark.createDataFrame(rows, "pageid bigint, title string, url string, chunk_id string, text string")
    ids = [r.chunk_id for r in chunk_documents(df, 100, 20).orderBy("pageid", "chunk_index").collect()]
    assert ids[:3] == ["7:0", "42:0", "42:1"] and not any(i.startswith(("8:", "9:")) for i in ids)
