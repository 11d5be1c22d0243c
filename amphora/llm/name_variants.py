"""Variant spellings of names: trie joins with Levenshtein automata, then a check over token orders.

Method. Distinct (type, spelling, place) units are sharded; each shard builds a trie of its units' tokens, and every token
of a unit runs a Levenshtein automaton over the trie to enumerate the tokens within its distance bound. Units that
share a neighbouring token are compared over token-order permutations: each token of the shorter name must
meet a token of the longer one as an equal, a misspelling, an initial, a shortening or a familiar form. Linked
units become groups by union-find over bounded edge partitions.

What tells people apart is the description, so the shard of a unit is the place its descriptions name (capitalised
words after the first). A unit without any description meets units of any place: two of its tokens must be spelt alike
there (one, if it has no more), so it asks in the shards of every two tokens near its own, and each unit stands in the shards
of every two of its tokens. Near tokens come from deletion neighbourhoods over all distinct tokens of the type. It joins the
closest unit; if two places are equally close it joins none.

Scale. Units are distinct before anything is compared, so a spelling holding a third of all rows is one unit. Shards
stream through sorted partitions, one trie at a time. A shard of more than ``shard_units`` units is cut into
blocks; every unit is looked up in the trie of each block, so nothing is dropped and no task holds the shard.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amphora.llm.components import min_labels
from amphora.session import blank, materialize, spread

_SMALL = {"of", "and", "the", "de", "von", "van", "la"}  # words that spellings drop at will
_LONG = 24  # letters beyond which a token is looked up by pieces
_FEW = 64  # tokens up to which a shard needs no trie


class TokenTrie:
    """A trie of tokens, searched by simulating the Levenshtein automaton of a query in machine words."""

    def __init__(self, tokens) -> None:
        self.root: dict = {}
        for t in tokens:
            node = self.root
            for c in t:
                node = node.setdefault(c, {})
            node[""] = t

    def neighbours(self, query: str, k: int, swaps: bool = False) -> list[str]:
        """Tokens within ``k`` insertions, deletions or substitutions of ``query``; with ``swaps`` an adjacent swap is one edit too."""
        masks: dict[str, int] = {}
        for i, c in enumerate(query):
            masks[c] = masks.get(c, 0) | (1 << i)
        accept = 1 << len(query)
        full = (accept << 1) - 1
        start = [(1 << (d + 1)) - 1 & full for d in range(k + 1)]  # after d deletions of the query's first characters
        out, stack = [], [(self.root, start, [0] * (k + 1))]
        while stack:
            node, states, swapped = stack.pop()
            for c, child in node.items():
                if c == "":
                    if states[k] & accept:
                        out.append(child)
                    continue
                m = masks.get(c, 0)
                prev_old = states[0]
                new = (prev_old & m) << 1
                nxt = [new]
                for d in range(1, k + 1):
                    old = states[d]
                    cur = (((old & m) << 1) | prev_old | (prev_old << 1) | (new << 1) | ((swapped[d] & m) << 2)) & full
                    nxt.append(cur)
                    prev_old, new = old, cur
                if nxt[k]:
                    # the second letter of a swap was read before its first: that one must come next
                    begun = [0, *(states[d - 1] & (m >> 1) for d in range(1, k + 1))] if swaps else swapped
                    stack.append((child, nxt, begun))
        return out


def distance(a: str, b: str, k: int) -> int:
    """Edit distance with adjacent swaps as one edit, or k + 1 if it is larger."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > k:
        return k + 1
    before, prev = None, list(range(len(b) + 1))
    for i in range(1, len(a) + 1):
        cur = [i] + [0] * len(b)
        for j in range(1, len(b) + 1):
            cur[j] = min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                cur[j] = min(cur[j], before[j - 2] + 1)
        if min(cur) > k:
            return k + 1
        before, prev = prev, cur
    return prev[-1]


def bound_of(token: str) -> int:
    return 0 if len(token) < 4 else 1 if len(token) < 6 else 2


@lru_cache(100_000)
def letters(token: str) -> int:
    """The set of letters of a token as bits; two letters may share one."""
    out = 0
    for c in token:
        out |= 1 << (ord(c) & 63)
    return out


class FewTokens:
    """A handful of tokens, compared one by one: an edit changes at most two letters of the set, which leaves few for the distance."""

    def __init__(self, tokens) -> None:
        self.held = [(t, len(t), letters(t)) for t in tokens]

    def neighbours(self, query: str, k: int, swaps: bool = True) -> list[str]:
        n, own = len(query), letters(query)
        return [t for t, m, of in self.held if -k <= m - n <= k and (of ^ own).bit_count() <= 2 * k and distance(query, t, k) <= k]


def token_cost(a: str, b: str) -> tuple[float, bool] | None:
    """(cost, whether the tokens are spelt alike) of taking two tokens for one word; None if they can't be."""
    if a == b:
        return 0.0, len(a) > 3
    if len(a) > len(b):
        a, b = b, a
    if len(a) == 1:
        return (0.5, False) if b[0] == a else None
    if b.startswith(a) and len(a) <= 6:  # shortened
        return 0.5, False
    if len(a) <= 6 and len(b) - len(a) >= 2 and (_letters_of(a, b) or (len(a) > 2 and a[:3] in b) or (a[:2] == b[:2] and len(a) <= 4)):
        return 0.8, False  # abbreviated or familiar
    k = bound_of(a)
    if not k or len(b) - len(a) > k or (letters(a) ^ letters(b)).bit_count() > 2 * k:
        return None
    d = distance(a, b, k)
    return (float(d), True) if d <= k else None


def _letters_of(short: str, word: str) -> bool:
    """Whether ``short`` is ``word`` with letters left out, the first one kept."""
    rest = iter(word)
    return short[0] == word[0] and all(c in rest for c in short)


def words(name: str) -> list[str]:
    found = [w for w in name.split(" ") if w]
    return [w for w in found if w not in _SMALL] or found


def cheapest_pairing(costs: list[list[tuple[float, bool] | None]]) -> tuple[float, int] | None:
    """(cost, tokens spelt alike) of the cheapest pairing of every row with a column of its own, by shortest augmenting paths; None if there is none."""
    far, n, m = 1e6, len(costs), len(costs[0])
    price = [[far if c is None else c[0] - 1e-6 * c[1] for c in row] for row in costs]
    up, down, owner = [0.0] * (n + 1), [0.0] * (m + 1), [-1] * (m + 1)
    for i in range(n):
        owner[m], j, least, way, seen = i, m, [far * 9] * (m + 1), [m] * (m + 1), [False] * (m + 1)
        while owner[j] != -1:
            seen[j] = True
            row, step, to = owner[j], far * 9, m
            for k in range(m):
                if not seen[k]:
                    c = price[row][k] - up[row] - down[k]
                    if c < least[k]:
                        least[k], way[k] = c, j
                    if least[k] < step:
                        step, to = least[k], k
            for k in range(m + 1):
                if seen[k]:
                    up[owner[k]] += step
                    down[k] -= step
                else:
                    least[k] -= step
            j = to
        while j != m:
            owner[j] = owner[way[j]]
            j = way[j]
        owner[m] = -1
    pairs = [costs[owner[j]][j] for j in range(m) if owner[j] != -1]
    return None if None in pairs else (sum(c for c, _ in pairs), sum(like for _, like in pairs))


def same_name(a: list[str], b: list[str], both_placed: bool, cost_of=token_cost) -> float | None:
    """The cost of the cheapest pairing of tokens in any order, or None if the names can't be the same.

    Every token of the shorter name has to be met. One token of the longer may stay unmet (a dropped word) if a
    description vouches for the pair and two words are left, otherwise none. At least one longer word must be spelt alike,
    two if nothing vouches and the names have as many.
    """
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > (1 if both_placed and len(a) > 1 else 0):
        return None
    costs = []
    for x in reversed(a):  # places and family names, which differ most, come last
        costs.append([cost_of(x, y) for y in b])
        if not any(costs[-1]):
            return None
    costs.reverse()
    best: list = [None, 0]

    def place(i: int, used: int, cost: float, alike: int) -> None:
        if best[0] is not None and cost >= best[0]:
            return
        if i == len(a):
            best[0], best[1] = cost, alike
            return
        for j in range(len(b)):
            if not used >> j & 1 and costs[i][j] is not None:
                c, like = costs[i][j]
                place(i + 1, used | 1 << j, cost + c, alike + like)

    if len(b) <= 12:
        place(0, 0, 0.0, 0)
    else:  # too many orders to try one by one
        best = list(cheapest_pairing(costs) or best)
    if best[0] is None or best[1] < 1:
        return None
    if not both_placed and best[1] < min(2, len(a)):
        return None
    return best[0] + (len(b) - len(a)) * 0.7


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, id, spelling, place, keys, indexed, probes), sorted by shard, to links (a, b, cost, a_place, b_place).

    Without keys every probe meets the whole shard.
    """
    shard, rows = None, []
    out: list[tuple] = []
    known: dict[tuple[str, str], tuple[float, bool] | None] = {}

    def cost_of(x: str, y: str) -> tuple[float, bool] | None:
        if (x, y) not in known:
            if len(known) >= 200_000:
                known.clear()
            known[x, y] = token_cost(x, y)
        return known[x, y]

    def work() -> None:
        indexed = [(i, words(s), p, k) for i, s, p, k, x, _ in rows if x]
        probes = [(i, words(s), p, k) for i, s, p, k, _, q in rows if q]
        if not probes or not indexed or (len(indexed) == 1 and len(probes) == 1 and indexed[0][0] == probes[0][0]):
            return
        by_token: dict[str, list[int]] = {}
        for n, (_, _w, _p, keys) in enumerate(indexed):
            for t in keys or ():
                by_token.setdefault(t, []).append(n)
        trie = FewTokens(by_token) if len(by_token) <= _FEW else TokenTrie(by_token)
        near: dict[str, list[str]] = {}
        done: set[tuple[int, int]] = set()
        for i, w, p, keys in probes:
            met: set[int] = set(range(len(indexed)) if keys is None else ())
            for t in keys or ():
                if t not in near:
                    near[t] = trie.neighbours(t, bound_of(t), swaps=True)
                for u in near[t]:
                    met.update(by_token[u])
            for n in met:
                j, v, q, _ = indexed[n]
                pair = (i, j) if i < j else (j, i)
                if i == j or pair in done:
                    continue
                done.add(pair)
                cost = same_name(w, v, bool(p) and p == q, cost_of)
                if cost is not None:
                    out.append((*pair, cost, *((p, q) if i < j else (q, p))))

    def flush() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) if out else [[]] * 5
        out.clear()
        types = (pa.int64(), pa.int64(), pa.float64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=["a", "b", "cost", "a_place", "b_place"])

    for b in batches:
        for s, *row in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
            if s != shard:
                work()
                shard, rows = s, []
            rows.append(row)
        if len(out) > 50_000:
            yield flush()
    work()
    yield flush()


def _merged(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join by sorting, which holds neither side on the driver.

    The planner takes the size of a table's files for that of its rows, and for that of all that a map in Arrow makes of
    them; tokens of a few MB, within the limit for a broadcast, have keys of hundreds.
    """
    return left.join(right.hint("merge"), on, how)


def spelling_units(extractions: DataFrame, types: tuple[str, ...] = ("Person", "Organization")) -> DataFrame:
    """(id, type, spelling, place): distinct; a spelling without any described place has one unit with place ''."""
    spelling = F.trim(F.regexp_replace(F.lower("name"), r"[^\p{L}\p{N}]+", " "))
    after_first = F.regexp_replace(F.coalesce("description", F.lit("")), r"^\s*\S+", "")
    place = F.lower(F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(after_first, F.lit(r"(?U)\b\p{Lu}[\p{L}-]+(?: \p{Lu}[\p{L}-]+)*"), F.lit(0)))), "|"))
    named = extractions.where(F.col("type").isin(*types) & ~blank(F.col("name"))).select("type", spelling.alias("spelling"), place.alias("place")).where("spelling <> ''").distinct()
    named = materialize(named, "spellings")
    placed = named.where("place <> ''")
    bare = _merged(named.where("place = ''"), placed, ["type", "spelling"], "left_anti")
    return materialize(placed.unionByName(bare).select(F.xxhash64("type", "spelling", "place").alias("id"), "type", "spelling", "place"), "units")


def _by_place(units: DataFrame, shard_units: int) -> DataFrame:
    """Shards of units of one type and place; a shard too large is cut into blocks, which all its units probe.

    Every token of four letters or more is a key, as only those can be spelt alike.
    """
    placed = units.where("place <> ''")
    sizes = placed.groupBy("type", "place").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / F.lit(shard_units)).cast("int"))
    sized = _merged(placed, sizes, ["type", "place"])
    own = F.pmod("id", "blocks").cast("int")
    block = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    every = F.filter(F.array_distinct(F.split("spelling", " ")), lambda t: F.length(t) > 3)  # same_name wants one of these spelt alike
    return sized.select("type", "place", "spelling", "id", every.alias("keys"), own.alias("own"), block).select(
        F.concat_ws("\x01", "type", "place", "block").alias("shard"), "id", "spelling", "place", "keys", (F.col("own") == F.col("block")).alias("indexed"), F.lit(True).alias("probes")
    )


def neighbourhood(token: str, asks: bool) -> set[str]:
    """Keys of a token: whatever lies within the bound of the shorter of two tokens, swaps included, has a key that the other asks for.

    They are the token with up to its bound of letters left out. Long tokens are cut into five pieces instead, one of
    which two edits leave whole; who asks tries each length of the other and each shift.
    """
    n = len(token)
    lengths = range(n - 2, n + 3) if asks else (n,)
    out: set[str] = set()
    if lengths[0] <= _LONG:
        out = last = {token}
        for _ in range(bound_of(token)):
            last = {t[:i] + t[i + 1 :] for t in last for i in range(len(t))}
            out = out | last
    for m in lengths:
        if m > _LONG:
            cuts = [m * i // 5 for i in range(6)]
            for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                out |= {f"{m} {i} {token[a + d : b + d]}" for d in (range(-2, 3) if asks else (0,)) if a + d >= 0 and b + d <= n}
    return out


def _neighbourhoods(asks: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                part = batch.slice(at, 1_000)
                rows = [(y, t, k) for y, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for k in neighbourhood(t, asks)]
                yield pa.RecordBatch.from_pydict({c: pa.array([r[i] for r in rows], pa.string()) for i, c in enumerate(("type", "t", "key"))})

    return run


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (type, t, u) whose tokens lie within the bound of the shorter."""
    for batch in batches:
        pairs = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
        bounds = ((t, u, bound_of(min(t, u, key=len))) for t, u in pairs)
        yield batch.filter(pa.array([distance(t, u, k) <= k for t, u, k in bounds], pa.bool_()))


def near_tokens(units: DataFrame) -> DataFrame:
    """(type, t, near): each token of four letters or more of the units without a place, with all tokens of the type spelt alike."""
    tokens = units.select("type", F.explode(F.array_distinct(F.split("spelling", " "))).alias("t"), (F.col("place") == "").alias("bare"))
    tokens = materialize(tokens.where(F.length("t") > 3).groupBy("type", "t").agg(F.max("bare").alias("bare")), "tokens")
    schema = "type string, t string, key string"
    asked = tokens.where("bare").select("type", "t").mapInArrow(_neighbourhoods(True), schema)
    held = spread(tokens.select("type", "t")).mapInArrow(_neighbourhoods(False), schema).withColumnRenamed("t", "u")
    met = _merged(asked, held, ["type", "key"]).select("type", "t", "u").distinct()
    return met.mapInArrow(_within, "type string, t string, u string").groupBy("type", "t").agg(F.collect_list("u").alias("near"))


def _pair_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (type, id, spelling, place, near) to (shard, id, spelling, place), a row for every two near tokens; tokens without ``near`` are near themselves."""
    names, types = ("shard", "id", "spelling", "place"), (pa.string(), pa.int64(), pa.string(), pa.string())

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=list(names))

    for batch in batches:
        rows: list[tuple] = []
        for y, i, s, p, near in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
            w = words(s)
            of = {x["t"]: x["near"] for x in near or ()}
            alike = [of.get(x, [x]) for x in w if len(x) > 3]
            if len(w) == 1:
                found = {(u,) for us in alike for u in us}
            else:
                found = {(u, v) if u < v else (v, u) for us, vs in combinations(alike, 2) for u in us for v in vs}
            rows.extend(("\x01".join((y, str(len(w)), *f)), i, s, p) for f in found)
            if len(rows) > 50_000:
                yield flush(rows)
                rows = []
        yield flush(rows)


def _by_alike(units: DataFrame, shard_units: int) -> DataFrame:
    """Shards for units without a place, by the number of words and two tokens (the token of a one-word name).

    Without a place ``same_name`` takes names of as many words with two of them spelt alike, so no pair that it takes is
    missed. Shards that nobody asks in are left out; one too large is cut into blocks, in each of which the askers ask.
    """
    bare = units.where("place = ''")
    near = _merged(bare.select("id", "type", F.explode(F.array_distinct(F.split("spelling", " "))).alias("t")), near_tokens(units), ["type", "t"])
    near = near.groupBy("id").agg(F.collect_list(F.struct("t", "near")).alias("near"))
    schema, columns = "shard string, id bigint, spelling string, place string", ("type", "id", "spelling", "place", "near")
    held = materialize(units.withColumn("near", F.lit(None).cast("array<struct<t:string,near:array<string>>>")).select(*columns).mapInArrow(_pair_shards, schema), "held")
    sizes = held.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / F.lit(shard_units)).cast("int").alias("blocks"))
    asking = materialize(_merged(bare, near, "id").select(*columns), "asking")  # spread would run all before it to count its parts
    asked = materialize(_merged(spread(asking).mapInArrow(_pair_shards, schema), sizes, "shard"), "asked")
    held = _merged(held, asked.select("shard", "blocks").distinct(), "shard").withColumn("block", F.pmod("id", "blocks").cast("int"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    row = lambda df, probes: df.select(
        F.concat_ws("\x01", "shard", "block").alias("shard"), "id", "spelling", "place", F.lit(None).cast("array<string>").alias("keys"), F.lit(not probes).alias("indexed"), F.lit(probes).alias("probes")
    )
    return row(held, False).unionByName(row(asked, True))


def _run(shards: DataFrame) -> DataFrame:
    return shards.repartition("shard").sortWithinPartitions("shard").mapInArrow(_links, "a bigint, b bigint, cost double, a_place string, b_place string")


def same_entity_links(units: DataFrame, shard_units: int = 2_000) -> DataFrame:
    """(a, b) ids of units taken for the same entity."""
    placed = _run(_by_place(units, shard_units)).select("a", "b")
    loose = materialize(_run(_by_alike(units, shard_units)).distinct(), "loose")
    both = loose.where("a_place = '' and b_place = ''").select("a", "b")
    # one side has no place: it joins the closest units, if these are all of one place
    side = loose.where("(a_place = '') <> (b_place = '')").select(
        F.when(F.col("a_place") == "", F.col("a")).otherwise(F.col("b")).alias("bare"), F.when(F.col("a_place") == "", F.col("b")).otherwise(F.col("a")).alias("unit"), F.concat("a_place", "b_place").alias("place"), "cost"
    )
    closest = side.groupBy("bare", "place").agg(F.min(F.struct("cost", "unit")).alias("x"))
    chosen = closest.groupBy("bare").agg(F.min("x.cost").alias("c"), F.min(F.struct("x.cost", "place", "x.unit")).alias("x"), F.sort_array(F.collect_list("x.cost")).alias("costs"))
    chosen = chosen.where((F.size("costs") == 1) | (F.get("costs", F.lit(1)) > F.col("c"))).select(F.least("bare", "x.unit").alias("a"), F.greatest("bare", "x.unit").alias("b"))
    return placed.unionByName(both).unionByName(chosen).distinct()


def link_spellings(extractions: DataFrame, types: tuple[str, ...] = ("Person", "Organization"), shard_units: int = 2_000) -> DataFrame:
    """(type, spelling, entity): every spelling with the id of the entity it belongs to.

    A spelling that two entities share (its descriptions name several places) has one row for each. Other types, blank names
    and names without a letter or digit have none; null descriptions say nothing; repeated rows change nothing.
    """
    units = spelling_units(extractions, types)
    links = materialize(same_entity_links(units, shard_units), "links")
    labels = min_labels(links).select(F.col("a").alias("id"), F.col("b").alias("root"))
    return _merged(units, labels, "id", "left").select("type", "spelling", F.coalesce("root", "id").alias("entity")).distinct()


def spelling_pairs(linked: DataFrame) -> DataFrame:
    """(type, name_a, name_b) with name_a < name_b of one entity: the answer itself lists each pair of its spellings."""
    a = linked.select("type", "entity", F.col("spelling").alias("name_a"))
    b = linked.select("type", "entity", F.col("spelling").alias("name_b"))
    several = linked.groupBy("type", "entity").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("type", "entity")
    return _merged(_merged(a, several, ["type", "entity"]), b, ["type", "entity"]).where("name_a < name_b").select("type", "name_a", "name_b").distinct()
