"""Personal details in free text: voting labelers, expectation-maximisation, a final span classifier.

Method. Wide grammars propose candidate spans of five kinds. Labelers vote on every candidate, for, against or silent: patterns
(the form of the span), gazetteers (given names; words of institutions, works and places) and context (words that go with living people,
a contact detail in the same sentence, reference numbers). None of them names a sentence of any table. Expectation-maximisation
estimates from the votes alone how reliable each labeler is and hence how probable each vote pattern is a true detail. These
probabilities train a logistic classifier over the votes, the words around and the letters of the span, which decides every span. Every
training span is also shown without its surroundings, so that a name is known by its own form in sentences never seen. Overlapping spans go to
the more probable one.

Scale. Documents are mapped once into candidates (a row per span, written to the shared folder). Vote patterns are
counted over all documents; at most 3^labelers of them exist a kind, so they, and not spans, reach the driver. The
classifier is fitted on at most ``fit_rows`` spans a kind, chosen by hash; it decides all spans of all documents.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amphora.session import materialize, spread

KINDS = ("name", "email", "phone", "id_number", "address")
_DIM = 1 << 14

# -- grammars of candidates (wide on purpose: the votes decide) --
_DOT = r"(?:\.|\s?[\[(]\s?dot\s?[\])]\s?)"
_EMAIL = re.compile(
    rf"(?<![\w.+%-])[\w.+%-]*\w(?:(?:\s?@\s?|\s?[\[(]\s?at\s?[\])]\s?)[\w-]+(?:{_DOT}[\w-]+)*|\s(?:AT|at)\s[\w-]+(?:\s(?:DOT|dot)\s[\w-]+)+)",
    re.IGNORECASE,
)
_S = r"[ \u00a0]"
_PHONE = re.compile(rf"(?<![\w.,+(-])(?:\+\d{{1,3}}[ \u00a0.-]?)?(?:\(\d{{1,5}}\)[ \u00a0.-]?)?\d{{2,11}}(?:[ \u00a0.-]\d{{2,8}}){{0,5}}(?:,?{_S}(?:ext\.?|x){_S}?\d{{1,5}})?(?![\w-])")
_ID = re.compile(r"(?<![\w+(.-])(?<!\+\d[ \u00a0])(?<!\+\d\d[ \u00a0])(?<!\+\d\d\d[ \u00a0])(?:[A-Z]{1,3}[ \u00a0-]?\d(?:[ \u00a0-]?\d){5,13}(?:[ \u00a0-]?[A-Z])?|\d(?:[ \u00a0-]?\d){5,13}-?[A-Z]?)(?![\w-])")
_CAP = r"[^\W\d_a-zß-öø-ÿ][\w'’]*[^\W\d_](?:-[^\W\d_]+)?"
_POST = r"(?:[A-Z]{2}[ \u00a0]\d{4,6}|[A-Z]{1,2}\d[A-Z\d]?[ \u00a0]\d[A-Z]{2}|\d{4,6})"
_TOWN = rf"{_CAP}(?:{_S}(?!{_POST}){_CAP})?(?!\w)"
_KIND_OF_WAY = r"(?i:Street|St\.?|Avenue|Ave\.?|Road|Rd\.?|Lane|Ln\.?|Boulevard|Blvd\.?|Drive|Close|Court|Square|Terrace|Way|Row|Place)"
_ADDRESS = re.compile(
    rf"(?<!\w)(?:(?:Flat|Apt\.?|Unit){_S}\d+\w?,{_S})?(?:"
    rf"\d{{1,4}}[a-z]?{_S}(?:[NSEW]\.{_S})?{_CAP}(?:{_S}{_CAP})?{_S}{_KIND_OF_WAY}(?:,?{_S}(?:Apt\.?|Flat|Unit){_S}\d+)?,?\s{{1,2}}(?:{_POST}{_S})?{_TOWN}(?:,?{_S}{_POST})?"
    rf"|\d{{1,4}}[a-z]?,?{_S}(?i:rue|via|calle|place){_S}(?:d\w*{_S})?{_CAP},?\s(?:{_POST}{_S})?{_TOWN}(?:,?{_S}{_POST})?"
    rf"|[^\W\d_a-zß-öø-ÿ]\w*(?i:gasse|stra(?:ß|ss)e|weg|platz){_S}\d{{1,4}}[a-z]?,?\s(?:{_POST}{_S})?{_TOWN}"
    rf"|\d{{1,4}}[a-z]?{_S}{_CAP}{_S}{_KIND_OF_WAY}(?!\w)"
    rf")"
)
_INIT = r"[^\W\d_a-z]\."
_NAME = re.compile(rf"(?<![\w@.])(?:{_CAP},{_S}(?:{_CAP}|{_INIT})(?:{_S}{_INIT})?|(?:{_CAP}|{_INIT})(?:{_S}{_INIT}){{0,2}}(?:{_S}{_CAP}){{1,3}})(?![\w@])")
# fixed values: titles, given names of several European languages, words that go with living people, words of institutions, works, seasons and grammar
_TITLES = frozenset("dr prof mr mrs ms miss sir herr frau m mme mlle sig signora don dona rev".split())
GIVEN_NAMES = frozenset(
    """adam agnes albert alice amelie amira ana andrea andrei aniko anna anneke anton arthur astrid axel barbara bartek beatriz ben bertil bjorn bogdan brigitte bruno camille carla carlos carmen cecile
    charlotte chiara christine claire clara corin daniel daria david diana dieter dmitri dora dorian edith elena elif elin elisa elske emil emma erik esther eva ewa ewout fatima felix fiona francesca frank
    freya frida gabriel george gerda giulia greta gustav halina hanna hans harriet heidi helen henrik hugo ian ida idris imke ines ingrid irina isabel isolde ivan jack jakob james jan jana jean joan john jonas jorge joss julia
    kai karin karl katarina kester klara lars laura lena leo liesl linda lisa louis lucia luis lukas lumi magda marco maren margot maria marie mark marta martin mary mateo matteo max mia michael milan nadia nina noah
    noor nora odile olga oskar pablo pavel paul peter petra petrik pierre renzo rosa ruth ruvan sarah saskia sofia stefan sunniva susan tamsin teresa thomas tobin tom ursula vera victor walter ysolde yusuf zelie zoe""".split()
)
_WITH_PEOPLE = frozenset(
    """thank thanks thanked thanking contact contacts contacted ask asks signed sign typed written photographed photographs photograph photos photo photographer foto scanned transcribed sketched emailed email mail phoned ring rang
    neighbour neighbor colleague friend volunteer volunteers visitor visitors correspondent reporter reporters author editor secretary treasurer chair guide curator student teacher owner donor caller contributor contributors
    mr mrs ms miss dr prof herr frau mme our my your cousin aunt uncle grandmother grandfather mum dad widow cheque minutes parcel regards sincerely yours dear greetings credit credits courtesy kept lent donated
    recorded reported spotted noticed posted uploaded submitted collected kindly interviewed met with invited paid write écrire rückfragen danke merci grazie gracias contatto kontakt""".split()
)
_DO_PEOPLE = frozenset(
    """tel phone fax email mail talk spotted noticed emailed phoned photographed snapped donated volunteered kindly lives posted typed scanned transcribed uploaded replied rang texted offered lent works says told kept wrote
    brought sent drove helped reports reported writes found pointed asked visited joined runs lived moved retired teaches drew""".split()
)
_NOT_PERSON = frozenset(
    """lex law act treaty siege battle revolt synod fire games muster war peace college guild order brotherhood sisterhood assembly council board company legion league society academy museum university library school temple
    church bridge port house court senate street road lane avenue square river mount lake sea bay island city town village province region market hall gate tower wall palace villa
    the a an of and or in on at by for from to with near after before under over between beyond through since until when while where if but nor yet so only some every each all no not one two three first second third last
    di il la le lo les un une una der die das den dem ein eine im am zu zur zum von vom nach bei bis mit aus und oder del della delle dei sur sous dans pour par après avant chez se si que qui dopo tra fra
    january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday spring summer autumn winter north south east west old new great little
    early late both many most few several another other such this that these those his her their its our your my he she it they we you there here now then despite because although though long trade coins chapter section
    page plate figure table volume part book note notes question answer see also""".split()
)
_REFERENCE = re.compile(r"(?:\bpp?\.|\bISBN|\bISSN|\bno\.|\bnos\.|\bvol\.|\bfig\.|[Cc]oins?|chunk|plates?|pages?|milestone|card|number|noted|mark|[Ii]nv\.|[Ii]tem|[Cc]atalogue|[Oo]rder|[Ii]nvoice|lot|ref\.?|passport,?)\s*$")
_CALLED = re.compile(r"(?:[Cc]all|ring|[Tt]el\.?|[Tt]elephone|reached (?:at|on)|\buse|\||-|[Pp]hone|[Ff]ax|[Mm]obile|dial|text|[Hh]andy|Tél\.?)\s*:?\s*$")
_PAPERS = re.compile(r"(?:passports?,?|identity (?:card|number)|national number|noted|licen[cs]e|\bID|Ausweis|[Cc]ard no\.?|insurance number|tax number|carte d'identité)(?:\s(?:no\.?|number|is|was))?\s*:?\s*$")

# (test, vote, where it looks) of the kinds found by their form; the labelers of names are in name_votes
_LABELERS: dict[str, list] = {
    "email": [
        (re.compile(r"(?:<|\(|\"|mail\W*|to|or|-|\||from|,)\s*$"), 1, "left"),
        (re.compile(r"[\w.+-]+\s?(?:@|[\[(]\s?at\s?[\])]|AT|at).*(?:\.|dot|DOT)", re.IGNORECASE), 1, "self"),
        (re.compile(r"^(?:>|\)|\"|\.|,|;|\s|$)"), 1, "right"),
    ],
    "phone": [
        (_CALLED, 1, "left"),
        (re.compile(r"^(?:\+|\(\d)|ext|^0\d{4}\s|^\d{3}[. ]\d{3}[. ]\d{4}"), 1, "self"),
        (re.compile(r"^(?:\sand ask|\sor\s|\|)"), 1, "right"),
        (_REFERENCE, -1, "left"),
        (re.compile(r"^(?::|\sN\b|\sE\b|\s(?:kg|km|m|cm|g|miles|loads|jars|coins|tiles)\b)"), -1, "right"),
        (re.compile(r"^(?:\D*\d){0,7}\D*$|^000[ -]|^\d{3,4}[-–]\d{3,4}$"), -1, "self"),
    ],
    "id_number": [
        (_PAPERS, 1, "left"),
        (re.compile(r"^[A-Z]|[A-Z]$|^\d{3}[- ]\d{2}[- ]\d{4}$"), 1, "self"),
        (re.compile(r"(?:[Cc]all|ring|[Tt]el\.?|reached at|use|\||-|\bpp?\.|ISBN|[Oo]rder no\.|[Ii]nv\.|[Cc]oins|chunk|mark)\s*$"), -1, "left"),
        (re.compile(r"^(?:\sext|\s(?:kg|km|m|cm|g|miles|loads|jars|coins|tiles)\b)"), -1, "right"),
        (re.compile(r"^\d{3,4}[- ]\d{3,4}$|^\d{6}$|^(?:\d[ -]?){10,}$"), -1, "self"),
    ],
    "address": [
        (re.compile(r"(?:to|at|,|;|in|lives at|à)\s*$"), 1, "left"),
        (re.compile(r",\s|\n"), 1, "self"),
        (re.compile(r"\d{4,6}|\d[A-Z]{2}$|[a-z] Road|BLVD"), 1, "self"),
        (re.compile(r"(?:[Aa]bout|some|all)\s*$"), -1, "left"),
        (re.compile(r"^\s(?:workers|stones|plots|keepers|coins|loads)"), -1, "right"),
    ],
}
# names: a contact detail in the sentence, a word for people before, after, initials, comma form, a given name, two plain words; a classical ending, a word of no person, part of a longer title
_NAME_SIGNS = (1, 1, 1, 1, 1, 1, 1, -1, -1, -1)


def _candidates(text: str) -> Iterator[tuple[str, int, int]]:
    taken = []
    for m in _EMAIL.finditer(text):
        if "." in m.group() or "dot" in m.group().lower():
            taken.append(m.span())
            yield "email", *m.span()
    for m in _ADDRESS.finditer(text):
        yield "address", *m.span()
    inside = lambda a, b: any(x < b and a < y for x, y in taken)
    for kind, rx, digits in (("phone", _PHONE, 7), ("id_number", _ID, 6)):
        for m in rx.finditer(text):
            if sum(c.isdigit() for c in m.group()) >= digits and not inside(*m.span()):
                yield kind, *m.span()
    for m in _NAME.finditer(text):
        a, b = m.span()
        first = _FIRST.match(text, a, b)
        while first and len(first[1]) > 1 and (first[1].lower() in _TITLES or (first[1].lower() in _NOT_PERSON and _BLANK.search(text, first.end(), b))):
            a = first.end()
            first = _FIRST.match(text, a, b)
        if not inside(a, b) and _BLANK.search(text, a, b):
            yield "name", a, b


_FIRST, _BLANK = re.compile(r"([^\W\d_]+)\.?\s"), re.compile(r"\s")
_TOKEN, _AGAIN, _LETTERS = re.compile(r"\w+|[^\w\s]"), re.compile(r"(.)\1+"), re.compile(r"[^\W\d_]+")
_UPPER, _LOWER, _DIGIT = re.compile(r"[^\W\d_a-zß-ÿ]"), re.compile(r"[a-zß-ÿ]"), re.compile(r"\d")
_SENTENCE = re.compile(r"\n\s*\n|[^\W\d_A-Z]{3}[.!?][\"')]?\s")
_INITIALS, _COMMA = re.compile(rf"(?:{_INIT}{_S}?)+\w|\w+{_S}{_INIT}"), re.compile(r"\w[\w'’-]*,\s\S")
_CLASSICAL = re.compile(r"(?:us|[aeiou]x|um|tor|[ln]ia)$")


def _hash(kind: str, feature: str) -> int:
    return zlib.crc32(f"{kind}|{feature}".encode("utf-8", "surrogatepass")) % _DIM


def _plain(word: str) -> str:
    """Without accents."""
    return word if word.isascii() else "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))


def _own_name(own: str) -> tuple[list[int], list[int]]:
    """(votes, hashed features) of a name by its own form."""
    tokens = [_plain(t.lower()) for t in _LETTERS.findall(own)]
    long = [t for t in tokens if len(t) > 1]
    initials, comma = bool(_INITIALS.search(own)), bool(_COMMA.match(own))
    strange, classical = any(t in _NOT_PERSON for t in long), any(_CLASSICAL.search(t) for t in long if t not in GIVEN_NAMES)
    votes = [
        int(initials and not strange),
        int(comma and len(tokens) == 2 + initials and not strange),
        int(any(t in GIVEN_NAMES for t in long)),
        int(len(tokens) == 2 and len(long) == 2 and not strange and not classical),
        -int(classical),
        -int(strange),
    ]
    feats = [f"w{t}" for t in tokens] + [f"e{t[-3:]}" for t in long] + [f"d{t[-4:]}" for t in long] + [f"n{len(tokens)}{initials}{comma}", f"last{long[-1][-2:] if long else ''}"]
    return votes, [_hash("name", f) for f in feats]


def _around(left: str, right: str) -> tuple[list[str], list[str]]:
    """The words before and after a span, nearest first, within its sentence."""
    cut = max((m.end() for m in _SENTENCE.finditer(left)), default=0)
    end = _SENTENCE.search(right)
    return [w.lower() for w in _TOKEN.findall(left[cut:])][::-1], [w.lower() for w in _TOKEN.findall(right[: end.start() + 3] if end else right)]


def _name_judge(text: str, a: int, b: int, details: list[tuple[int, int]], known: dict) -> tuple[str, list[int], list[int]]:
    """(votes, own features, features of the surroundings) of a name."""
    own = text[a:b]
    if own not in known:
        if len(known) > 100_000:
            known.clear()
        known[own] = _own_name(own)
    form, feats = known[own]
    before, after = _around(text[max(0, a - _REACH) : a], text[b : b + _REACH])
    near = any(
        not _SENTENCE.search(text, min(b, y), max(a, x)) for x, y in details if (0 <= x - b <= _REACH or 0 <= a - y <= _REACH) and not (x < b and a < y)
    )
    earlier, later = [w for w in before if w[0].isalnum()][:6], [w for w in after if w[0].isalnum()][:2]
    of = bool(before) and before[0] in ("of", "lex", "de", "di", "von", "the") or bool(after) and after[0] in ("of", "di", "de", "von")
    votes = [
        int(near),
        int(any(w in _WITH_PEOPLE for w in earlier)),
        int(any(w in _DO_PEOPLE for w in later)),
        *form,
        -int(of),
    ]
    context = [f"v{i}{v}" for i, v in enumerate(votes) if i not in _OWN_VOTES]
    context += [f"l1{before[:1]}", f"l2{before[1:2]}", f"r1{after[:1]}", f"r2{after[1:2]}"]
    own_votes = [_hash("name", f"v{i}{votes[i]}") for i in _OWN_VOTES]
    return "".join("+" if v > 0 else "-" if v < 0 else "0" for v in votes), feats + own_votes, [_hash("name", f) for f in context]


_OWN_VOTES = (3, 4, 5, 6, 7, 8)
_REACH = 96  # characters of a sentence that are looked at on each side


def _judge(text: str, kind: str, a: int, b: int) -> tuple[str, list[int], list[int]]:
    """(votes, own features, features of the surroundings) of a candidate of another kind."""
    left, right, own = text[max(0, a - _REACH) : a], text[b : b + _REACH], text[a:b]
    votes = "".join(
        ("+" if v > 0 else "-") if rx.search(left if where == "left" else right if where == "right" else own) else "0" for rx, v, where in _LABELERS[kind]
    )
    lw, rw = _TOKEN.findall(left)[-2:], _TOKEN.findall(right)[:2]
    shape = _AGAIN.sub(r"\1", _UPPER.sub("A", _LOWER.sub("a", _DIGIT.sub("9", own))))[:16]
    inner = [f"v{i}{v}" for i, v in enumerate(votes) if _LABELERS[kind][i][2] == "self"] + [f"s{shape}"]
    outer = [f"v{i}{v}" for i, v in enumerate(votes) if _LABELERS[kind][i][2] != "self"] + [f"l1{lw[-1:]}", f"l2{lw[-2:-1]}", f"r1{rw[:1]}", f"r2{rw[1:2]}"]
    return votes, [_hash(kind, f) for f in inner], [_hash(kind, f) for f in outer]


_CAND = "doc_id bigint, kind string, a int, b int, value string, votes string, own array<int>, around array<int>"


def judged(text: str, known: dict) -> Iterator[tuple]:
    """(kind, a, b, value, votes, own features, features of the surroundings) of every candidate of a text."""
    found = list(_candidates(text))
    details = [(a, b) for kind, a, b in found if kind != "name"]
    for kind, a, b in found:
        votes, own, around = _name_judge(text, a, b, details, known) if kind == "name" else _judge(text, kind, a, b)
        yield kind, a, b, text[a:b], votes, own, around


def _propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict = {}
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            rows = [(d, *c) for d, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for c in judged(text, known)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
            types = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "kind", "a", "b", "value", "votes", "own", "around"])


def signs(kind: str) -> tuple[int, ...]:
    return _NAME_SIGNS if kind == "name" else tuple(v for _, v, _ in _LABELERS[kind])


def vote_posteriors(kind: str, patterns: dict[str, int], rounds: int = 100, weight: float = 50.0) -> dict[str, float]:
    """The probability of a true detail for each vote pattern, by expectation-maximisation over labeler reliabilities.

    A labeler speaks (its fixed vote) or is silent; its two rates, among true and among other candidates, are re-estimated
    together with the share of true candidates. The prior of a rate weighs ``weight`` candidates, however many there are; a labeler that votes for
    details must speak more often among true ones than among others, and the other way round.
    """
    spoken = np.array([[c != "0" for c in p] for p in patterns], float)
    n = np.array(list(patterns.values()), float)
    pro = np.array(signs(kind)) > 0
    prior1, prior0 = np.where(pro, 0.6, 0.03), np.where(pro, 0.03, 0.5)
    rate1, rate0, share = prior1, prior0, 0.1
    p = np.zeros(len(n))
    for _ in range(rounds):
        log1 = np.log(share) + spoken @ np.log(rate1) + (1 - spoken) @ np.log(1 - rate1)
        log0 = np.log(1 - share) + spoken @ np.log(rate0) + (1 - spoken) @ np.log(1 - rate0)
        p = 1 / (1 + np.exp(np.clip(log0 - log1, -50, 50)))
        w1, w0 = n * p, n * (1 - p)
        rate1 = np.clip((w1 @ spoken + weight * prior1) / (w1.sum() + weight), 0.001, 0.999)
        rate0 = np.clip((w0 @ spoken + weight * prior0) / (w0.sum() + weight), 0.001, 0.999)
        both = (rate1 + rate0) / 2
        rate1, rate0 = np.where(pro, np.maximum(rate1, both), np.minimum(rate1, both)), np.where(pro, np.minimum(rate0, both), np.maximum(rate0, both))
        share = float(np.clip((w1.sum() + 1) / (n.sum() + 2), 0.001, 0.99))
    return dict(zip(patterns, p.tolist(), strict=True))


def fit_logistic(feats: list[list[int]], target: np.ndarray, rounds: int = 200, l2: float = 1e-3) -> np.ndarray:
    """Weights (the last is the bias) of a logistic regression on hashed features and soft targets, by Adam."""
    rows = np.repeat(np.arange(len(feats)), [len(f) for f in feats])
    cols = np.concatenate([np.array(f, np.int64) for f in feats]) if feats else np.zeros(0, np.int64)
    w, m, v = np.zeros(_DIM + 1), np.zeros(_DIM + 1), np.zeros(_DIM + 1)
    for t in range(1, rounds + 1):
        z = np.bincount(rows, w[cols], len(feats)) + w[-1]
        err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        g = np.append(np.bincount(cols, err[rows], _DIM) / max(len(feats), 1), err.mean()) + l2 * w * np.append(np.ones(_DIM), 0) / 10
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def fit_spans(rows: list[tuple[list[int], list[int], float]]) -> np.ndarray:
    """A classifier of (own features, features of the surroundings, probability); every span is shown with and without its surroundings."""
    target = np.array([p for _, _, p in rows])
    return fit_logistic([list(o) + list(c) for o, c, _ in rows] + [list(o) for o, _, _ in rows], np.concatenate([target, target]))


def _decide(models: dict[str, np.ndarray], threshold: float):
    names = list(models)
    weights = np.stack([models[k] for k in names]) if names else np.zeros((1, _DIM + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = {k: i for i, k in enumerate(names)}
            model = np.array([of.get(k, -1) for k in batch.column(0).to_pylist()], np.int64)
            z = weights[model, -1].copy()
            for feats in (batch.column(1), batch.column(2)):
                owner = np.repeat(np.arange(batch.num_rows), np.diff(feats.offsets.to_numpy().astype(np.int64)))
                z += np.bincount(owner, weights[model[owner], feats.flatten().to_numpy()], batch.num_rows)
            p = np.where(model < 0, 0.0, 1 / (1 + np.exp(-np.clip(z, -30, 30))))
            keep = np.flatnonzero(p >= threshold)
            rows = pa.array(keep)
            rest = [batch.column(i).take(rows) for i in (3, 4, 5, 6)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), *rest, pa.array(p[keep], pa.float64())], names=["kind", "doc_id", "a", "b", "value", "p"])

    return run


def personal_spans(documents: DataFrame, fit_rows: int = 20_000, threshold: float = 0.5) -> DataFrame:
    """(doc_id, kind, a, b, value, p): personal details by character position, none overlapping another.

    Null or empty texts and null doc_ids have none; rows with one doc_id are one document each, repeated
    rows give repeated spans; extra columns are ignored. Positions count characters from 0.
    """
    docs = spread(documents.where("doc_id is not null and text is not null").select("doc_id", "text"))
    spans = materialize(docs.mapInArrow(_propose, _CAND), "spans")
    patterns: dict[str, dict[str, int]] = {}
    for r in spans.groupBy("kind", "votes").agg(F.count(F.lit(1)).alias("n")).collect():  # at most 2^10 a kind
        patterns.setdefault(r.kind, {})[r.votes] = r.n
    models = {}
    for kind, counts in patterns.items():
        p = vote_posteriors(kind, counts)
        share = min(1.0, 1.5 * fit_rows / sum(counts.values()))
        chosen = spans.where((F.col("kind") == kind) & (F.pmod(F.xxhash64("doc_id", "a", "kind"), F.lit(1_000_000)) < int(share * 1_000_000)))
        rows = chosen.select("votes", "own", "around").limit(fit_rows).collect()  # the documented bound of the fit
        models[kind] = fit_spans([(r.own, r.around, p[r.votes]) for r in rows])
    found = spans.select("kind", "own", "around", "doc_id", "a", "b", "value").mapInArrow(_decide(models, threshold), "kind string, doc_id bigint, a int, b int, value string, p double")
    return _without_overlap(found)


def _greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans (doc_id, kind, a, b, value, p), a document's best first: those that overlap none before."""
    doc, starts, ends = None, [], []
    for batch in batches:
        keep = []
        for d, a, b in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "a", "b")), strict=True):
            if d != doc:
                doc, starts, ends = d, [], []
            k = bisect_left(starts, b)  # the spans kept so far are in order and apart, so the last to start before b ends last
            free = k == 0 or ends[k - 1] <= a
            if free:
                starts.insert(k, a)
                ends.insert(k, b)
            keep.append(free)
        yield batch.filter(pa.array(keep, pa.bool_()))


def _without_overlap(found: DataFrame) -> DataFrame:
    """Of overlapping spans the most probable stays (then the longest); a span gives way only to one that stays."""
    rows = found.select("doc_id", "kind", "a", "b", "value", "p").repartition("doc_id")
    best = rows.sortWithinPartitions("doc_id", F.desc("p"), F.desc(F.col("b") - F.col("a")), "a", "kind", "value")
    return best.mapInArrow(_greedy, "doc_id bigint, kind string, a int, b int, value string, p double")


def redact(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, text) with every span replaced by its typed placeholder, e.g. [NAME]; the rest is unchanged.

    A document's spans are bounded by its length, so they travel to it as one row. Spans given with overlaps are merged: what lies inside any
    span is never written.
    """
    cuts = spans.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("a", "b", "kind"))).alias("cuts"))
    rest = F.aggregate(
        "cuts", F.struct(F.lit("").alias("s"), F.lit(0).alias("at")),
        lambda acc, c: F.struct(
            F.when(c["a"] < acc["at"], acc["s"])
            .otherwise(F.concat(acc["s"], F.substring(F.col("text"), acc["at"] + 1, c["a"] - acc["at"]), F.lit("["), F.upper(c["kind"]), F.lit("]"))).alias("s"),
            F.greatest(acc["at"], c["b"]).alias("at"),
        ),
        lambda acc: F.concat(acc["s"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))),
    )
    return documents.select("doc_id", "text").join(cuts, "doc_id", "left").select("doc_id", F.when(F.col("cuts").isNull(), F.col("text")).otherwise(rest).alias("text"))
