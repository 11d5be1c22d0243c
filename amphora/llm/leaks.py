"""Evaluation texts leaking into documents: CGK random walks, bit-sampling LSH over windows, exact verification.

Method. A window of words is embedded by the CGK random walk: at every step the walk writes the word under its
pointer and moves on or stays by a random bit of (step, word), so that windows a few word edits apart are a few
positions apart in Hamming distance. Keys sampled from those positions (several walks, several samples each) find
windows of documents that may repeat a window of an item; the passage is then verified exactly: the words it has in common with the item in order
(an edit distance, by bit-parallel dynamic programming) must be enough, and aligned it is kept if it
covers at least half of the item's words in connected stretches; passages far apart in a document count together.

Windows are sized by the item: as wide as the half of it that has to be there, in five classes up to 16 words; an item
of fewer than four words is one window. Only the classes that the items have are computed.

Scale. Documents are only mapped: no shuffle, so copies and long texts cost their words and nothing else. Windows of whole texts
start at every quarter of a window; an item's windows start at every word, so a passage may begin anywhere. The
items are the stated query set: they are held against all documents in blocks of at most ``block_items`` (the
proven bound of what a task holds: about 16 bytes for each key of a word), one map over the documents a block.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amphora.session import spread

_WORD = re.compile(r"\w+")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def fold_words(text: str) -> list[str]:
    """Words however they are typeset: case, accents, width and ligatures folded, punctuation and line ends dropped."""
    text = text.casefold()
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text.replace("­", "")) if not unicodedata.combining(c))
    return _WORD.findall(text)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_WIDTHS = (4, 6, 8, 12, 16)


def width_of(words: int) -> int:
    """The words of an item's windows: the widest class that fits into half of the item; all of a tiny item."""
    return words if words < _WIDTHS[0] else max(w for w in _WIDTHS if w <= max(_WIDTHS[0], words // 2))


class Walks:
    """The random walks and samples; equal for items and documents."""

    def __init__(self, window: int, walks: int, samples: int, sampled: int) -> None:
        rng = np.random.default_rng(20_240_301)
        self.window, self.steps, self.walks, self.samples = window, 2 * window, walks, samples
        # positions are drawn from the first 1.5 windows: later ones are mostly past the end
        reach = max(1, 3 * window // 2)
        sampled = min(sampled, max(1, window), reach)
        self.at = [[np.sort(rng.choice(reach, sampled, replace=False)) for _ in range(samples)] for _ in range(walks)]
        self.seeds = rng.integers(1, 2**63, size=(walks, self.steps), dtype=np.uint64)
        self.coef = rng.integers(1, 2**63, size=(walks, samples, sampled), dtype=np.uint64) | np.uint64(1)

    def keys(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[np.ndarray]:
        """A key of every window for every (walk, sample); symbols are word hashes, the last one is padding."""
        pad = len(symbols) - 1
        uniq, inv = np.unique(symbols, return_inverse=True)
        inv = inv.astype(np.int32)
        for w in range(self.walks):
            need = max(int(p[-1]) for p in self.at[w]) + 1
            out = [np.zeros(len(starts), np.uint64) for _ in range(self.samples)]
            pos = starts.copy()
            hashed = _mix(uniq + self.seeds[w, 0])
            for j in range(need):
                at = np.where(pos < ends, pos, pad)
                sym = inv[at]
                values = None
                for s in range(self.samples):
                    k = np.searchsorted(self.at[w][s], j)
                    if k < len(self.at[w][s]) and self.at[w][s][k] == j:
                        values = hashed[sym] if values is None else values
                        out[s] += values * self.coef[w, s, k]
                pos = pos + ((_mix(uniq ^ self.seeds[w, j]) >> np.uint64(40)) & np.uint64(1)).astype(np.int64)[sym]
            for s in range(self.samples):
                yield _mix(out[s])


def _hashes(words: list[str], known: dict[str, int]) -> list[int]:
    out = []
    for w in words:
        h = known.get(w)
        if h is None:
            b = w.encode("utf-8", "surrogatepass")
            h = known[w] = zlib.crc32(b) << 31 ^ zlib.adler32(b)
        out.append(h)
    return out


def _windows(texts: list[list[int]], window: int, stride: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols with padding at the end, window starts, window ends, text of each window)."""
    lengths = np.array([len(t) for t in texts], np.int64)
    first = np.concatenate([[0], np.cumsum(lengths)])
    counts = np.where(lengths > 0, np.maximum(lengths - window, 0) // stride + 1, 0)
    owner = np.repeat(np.arange(len(texts)), counts)
    starts = (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)) * stride + first[:-1][owner]
    ends = np.minimum(starts + window, first[1:][owner])
    symbols = np.array([x for t in texts for x in t] + [0], np.uint64)
    return symbols, starts, ends, owner


def _bigrams(h: list[int]) -> list[int]:
    """A number for each pair of neighbouring words."""
    a = np.array(h, np.uint64)
    return (a[:-1] * _ODD + a[1:]).tolist() if len(a) > 1 else []


class Items:
    """The items' words, and by the width of their windows the signatures of these."""

    def __init__(self, rows: list[tuple[int, str]], walks: int, samples: int, sampled: int) -> None:
        self.ids = [i for i, _ in rows]
        words = [fold_words(t) for _, t in rows]
        self.known: dict[str, int] = {}
        self.hashed = [_hashes(w, self.known) for w in words]
        self.pairs = [Counter(_bigrams(h)) for h in self.hashed]
        self.places = [places_of(h) for h in self.hashed]
        self.classes = []
        widths = [width_of(len(h)) for h in self.hashed]
        for width in sorted(set(widths) - {0}):
            walk, of = Walks(width, walks, samples, sampled), np.array([n for n, w in enumerate(widths) if w == width], np.int64)
            symbols, starts, ends, owner = _windows([self.hashed[n] for n in of], width)
            first = np.concatenate([[0], np.cumsum([len(self.hashed[n]) for n in of])])
            offset, owner = (starts - first[owner]).astype(np.int32), of[owner].astype(np.int32)
            tables = []
            for key in walk.keys(symbols, starts, ends):
                order = np.argsort(key, kind="stable")
                maybe = np.zeros(1 << 20, bool)
                maybe[(key & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
                tables.append((key[order], owner[order], offset[order], maybe))
            self.classes.append((walk, tables))

    def candidates(self, texts: list[list[int]]) -> list[tuple[int, int, int]]:
        """(text, item, shift), ordered: windows that share a key; shifts are rounded to windows."""
        first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        found, wide = [np.zeros(0, np.int64)], np.int64(len(self.ids))
        for walk, tables in self.classes:
            symbols, starts, ends, owner = _windows(texts, walk.window, max(1, walk.window // 4))
            if not len(starts):
                continue
            local = starts - first[owner]
            for key, (keys, items, offsets, maybe) in zip(walk.keys(symbols, starts, ends), tables, strict=True):
                hit = np.flatnonzero(maybe[(key & np.uint64((1 << 20) - 1)).astype(np.int64)])
                lo, hi = np.searchsorted(keys, key[hit], "left"), np.searchsorted(keys, key[hit], "right")
                n = hi - lo
                hit, lo, n = hit[n > 0], lo[n > 0], n[n > 0]
                if not len(hit):
                    continue
                row = np.repeat(hit, n)
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
                shift = (local[row] - offsets[at]) // walk.window
                found.append(np.unique(((owner[row] * wide + items[at]) << 24) + shift + (1 << 23)))  # texts of up to 2^23 windows' length
        packed = np.unique(np.concatenate(found))
        pair, shift = packed >> 24, (packed & ((1 << 24) - 1)) - (1 << 23)
        return list(zip((pair // wide).tolist(), (pair % wide).tolist(), shift.tolist(), strict=True))


def places_of(item: list[int]) -> dict[int, int]:
    """The places of every word of an item, as bits."""
    out: dict[int, int] = {}
    for n, x in enumerate(item):
        out[x] = out.get(x, 0) | 1 << n
    return out


def common_words(places: dict[int, int], length: int, passage: list[int]) -> int:
    """The most words an item and a passage have in common in order, exactly, by dynamic programming on the bits of a row.

    That is the edit distance without replacements: insertions and deletions are both lengths minus twice this.
    """
    row = full = (1 << length) - 1
    for x in passage:
        m = places.get(x)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return length - row.bit_count()


def coverage(item: list, passage: list, share: float = 0.5, gap: int = 2, least: int = 6) -> float:
    """The share of the item's words in connected stretches of the passage, in order.

    Matching runs of two words or more join to a stretch across at most ``gap`` differing words on the item's side and twice
    as many on the passage's (words put in between); a stretch has at least ``least`` matching words, or as many as the share of
    the item if that is less. Only matching words and single words replaced inside a stretch are counted.
    """
    least = min(least, max(1, math.ceil(share * len(item))))
    blocks = [b for b in SequenceMatcher(None, item, passage, autojunk=False).get_matching_blocks() if b.size >= min(2, len(item))]
    covered, i = 0, 0
    while i < len(blocks):
        matched, replaced, j = blocks[i].size, 0, i
        while j + 1 < len(blocks):
            a_gap = blocks[j + 1].a - blocks[j].a - blocks[j].size
            b_gap = blocks[j + 1].b - blocks[j].b - blocks[j].size
            if a_gap > gap + 1 or b_gap > 2 * gap + 4:
                break
            j += 1
            matched += blocks[j].size
            replaced += a_gap if a_gap == b_gap == 1 else 0
        if matched >= least:
            covered += matched + min(replaced, matched // 6)
        i = j + 1
    return covered / max(len(item), 1)


def _scan(rows: list[tuple[int, str]], walks: tuple[int, int, int], share: float, batch_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(rows, *walks)
        known = dict(items.known)
        ids: list[int] = []
        texts: list[list[int]] = []

        def enough(i: int, bigrams: set[int]) -> bool:
            """No passage without that covers the share: six of seven covered words match, and runs of two words or more hold a pair for every two."""
            own = items.pairs[i]
            return len(items.hashed[i]) == 1 or sum(own[p] for p in own.keys() & bigrams) >= 3 / 7 * share * len(items.hashed[i]) - 1e-9

        def holds(i: int, passage: list[int]) -> bool:
            item = items.hashed[i]
            return common_words(items.places[i], len(item), passage) >= 6 / 7 * share * len(item) - 1e-9 and coverage(item, passage, share) >= share

        def flush() -> pa.RecordBatch:
            near: dict[tuple[int, int], list[int]] = {}
            for t, i, s in items.candidates(texts):
                near.setdefault((t, i), []).append(s)
            out, of, bigrams, every = set(), -1, [], set()
            for (t, i), shifts in near.items():  # ordered by text
                item, text = items.hashed[i], texts[t]
                w = width_of(len(item))
                if t != of:
                    of, bigrams = t, _bigrams(text)
                    every = set(bigrams)
                if not enough(i, every):
                    continue
                regions: list[list[int]] = []
                for s in shifts:  # in order
                    lo = max(0, (s - 1) * w - len(item) // 8)
                    hi = (s + 2) * w + len(item) * 5 // 4
                    if enough(i, set(bigrams[lo : max(hi - 1, 0)])) and holds(i, text[lo:hi]):
                        out.add((ids[t], items.ids[i]))
                        break
                    if regions and lo <= regions[-1][1]:
                        regions[-1][1] = hi
                    else:
                        regions.append([lo, hi])
                else:
                    # stretches far apart count together, in the item's order; the numbers between keep them apart
                    if len(regions) > 1 and enough(i, {g for lo, hi in regions for g in bigrams[lo : max(hi - 1, 0)]}):
                        if holds(i, [x for lo, hi in regions for x in (*text[lo:hi], *[-1] * 16)]):
                            out.add((ids[t], items.ids[i]))
            ids.clear()
            texts.clear()
            return pa.RecordBatch.from_pydict({"doc_id": pa.array([d for d, _ in out], pa.int64()), "item_id": pa.array([i for _, i in out], pa.int64())})

        n = 0
        for b in batches:
            for d, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                h = _hashes(fold_words(text), known)
                ids.append(d)
                texts.append(h)
                n += len(h)
                if n >= batch_words:
                    yield flush()
                    n = 0
                    if len(known) > 500_000:
                        known = dict(items.known)
        yield flush()

    return run


def leaked_items(
    documents: DataFrame, items: DataFrame, share: float = 0.5, walks: int = 4, samples: int = 4, sampled: int = 6, block_items: int = 50_000, batch_words: int = 200_000
) -> DataFrame:
    """(doc_id, item_id): documents that reproduce at least ``share`` of the words of an item.

    Null or empty texts and items without words match nothing; an item of one word is any text's that has the word; a null doc_id or item_id is
    left out; repeated rows give one row each pair; a document may give away several items. Extra columns are ignored.
    """
    items = items.where("item_id is not null and text is not null").select("item_id", "text")
    docs = spread(documents.where("text is not null and doc_id is not null").select("doc_id", "text"))
    n = items.count()
    blocks = max(1, -(-n // block_items) * (2 if n > block_items else 1))
    out = None
    for k in range(blocks):
        rows = [(r.item_id, r.text) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()]  # at most about block_items
        part = docs.mapInArrow(_scan(rows, (walks, samples, sampled), share, batch_words), "doc_id bigint, item_id bigint")
        out = part if out is None else out.unionByName(part)
    return out.distinct()
