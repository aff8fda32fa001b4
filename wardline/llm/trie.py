"""Similarity join of short strings of a shard.

Rows lie in shards, such as a town or a token of a place in a town. Their strings are
compared by columns (``edits``); long ones by traversing one trie along another: those of a
shard are a trie; those asked for form a trie as well, walked depth first: each of its
nodes keeps the nodes of the other trie within the edit bound of its prefix (the states
of a Levenshtein automaton), computed from those of its parent, so that common prefixes
are worked out once. A crowded shard is cut: strings within k edits share one of k + 1
segments of one of them at nearly the same place, so that a string meets only the cuts
it can reach.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.edits import BLOCK, Words, ranges, spans
from wardline.operators.skew import split_join
from wardline.session import cut

#: Rows of a shard beyond which it is cut by segments, and rows of a side of a cut that meet in one task.
PART = 8000
#: Pairs of long words of a shard up to which they are looked at one by one before any trie is made.
FEW = 100
#: Rows from which a task compares the shards that it holds.
ROWS = 30_000


class Trie:
    def __init__(self, entries: Iterable[tuple[str, int]]) -> None:
        """``entries``: (string, number); nodes are numbered parents first."""
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        for text, number in entries:
            at = 0
            for c in text:
                to = self.children[at].get(c)
                if to is None:
                    to = self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                at = to
            self.ends[at].append(number)


def _closed(states: dict[int, int], children: list[dict[str, int]], bound: int) -> dict[int, int]:
    """Adds what is reached by characters that only the dictionary has."""
    queue = [s for s, d in states.items() if d < bound]
    for node in queue:
        d = states[node] + 1
        for to in children[node].values():
            if states.get(to, bound + 1) > d:
                states[to] = d
                if d < bound:
                    queue.append(to)
    return states


def trie_join(queries: list[tuple[str, int]], dictionary: list[tuple[str, int]], bound: int) -> Iterator[tuple[int, int, int]]:
    """(query number, dictionary number, edits) of all pairs of strings within ``bound`` edits."""
    words, asked = Trie(dictionary), Trie(queries)
    children = words.children
    stack = [(0, _closed({0: 0}, children, bound))]
    while stack:
        node, states = stack.pop()
        for q in asked.ends[node]:
            for s, d in states.items():
                for w in words.ends[s]:
                    yield q, w, d
        for c, to in asked.children[node].items():
            after: dict[int, int] = {}
            for s, d in states.items():
                if d < bound and after.get(s, bound + 1) > d + 1:
                    after[s] = d + 1
                for label, child in children[s].items():
                    cost = d + (label != c)
                    if cost <= bound and after.get(child, bound + 1) > cost:
                        after[child] = cost
            if after:
                stack.append((to, _closed(after, children, bound)))


class Form(NamedTuple):
    """A string under which a word is asked for or found.

    ``sort``: only strings of one sort are compared. ``edits``: those allowed; for a
    pair the larger of the two counts. ``most``: the largest of all strings of the sort.
    ``cost`` is added to the edits that are reported.
    """

    sort: str
    text: str
    edits: int
    most: int
    asks: bool = True
    cost: int = 0


Forms = Callable[[str], Sequence[Form]]


def near_words(forms: Forms, left: Iterable[str], right: Iterable[str] | None = None) -> dict[tuple[str, str], int]:
    """(left word, right word) and their edits, if some form of one asks for one of the other.

    All forms are found; those that don't ask are found by asking ones of the other side.
    Without ``right`` the left words are compared with each other, both ways round.
    """
    own = right is None
    sides = [[(w, f) for w in words for f in forms(w)] for words in ([left] if own else [left, right])]
    best: dict[tuple[str, str], int] = {}
    for turned in (False, True):
        asked, found = (sides[0], sides[-1]) if not turned else (sides[-1], sides[0])
        if turned:
            if own:
                break
            asked = [(w, f) for w, f in asked if f.asks]
            sorts = {f.sort for _, f in asked}
            found = [(w, f) for w, f in found if not f.asks and f.sort in sorts]
        for sort in {f.sort for _, f in asked if f.asks}:
            q = [(w, f) for w, f in asked if f.asks and f.sort == sort]
            d = [(w, f) for w, f in found if f.sort == sort]
            bound = max((f.edits for _, f in q + d), default=0)
            for i, j, edits in trie_join([(f.text, i) for i, (_, f) in enumerate(q)], [(f.text, j) for j, (_, f) in enumerate(d)], bound):
                (a, x), (b, y) = q[i], d[j]
                pair = (b, a) if turned else (a, b)
                told = edits + max(x.cost, y.cost)
                if edits <= max(x.edits, y.edits) and best.get(pair, told + 1) > told:
                    best[pair] = told
    return best


def bags(forms: Sequence[Form]) -> list[tuple[Counter, dict[str, tuple[int, bool]]]]:
    """The letters of a word's forms, in any order, and for each sort of them the edits allowed and whether one asks."""
    found: dict[str, dict[str, tuple[int, bool]]] = {}
    for f in forms:
        sorts = found.setdefault("".join(sorted(f.text)), {})
        edits, asks = sorts.get(f.sort, (0, False))
        sorts[f.sort] = max(edits, f.edits), asks or f.asks
    return [(Counter(bag), sorts) for bag, sorts in found.items()]


def could_meet(a: list[tuple[Counter, dict]], b: list[tuple[Counter, dict]]) -> bool:
    """Whether the letters of two words leave it open that they are near: each letter that only one has is an edit."""
    for x, x_sorts in a:
        for y, y_sorts in b:
            most = max((max(x_sorts[s][0], y_sorts[s][0]) for s in x_sorts.keys() & y_sorts.keys() if x_sorts[s][1] or y_sorts[s][1]), default=-1)
            if most >= 0 and max((x - y).total(), (y - x).total()) <= most:
                return True
    return False


def cuts(forms: Sequence[Form]) -> tuple[set[str], set[str]]:
    """Keys under which a word lies in a crowded shard as found, and those under which it asks.

    A found string of length n gives its ``most + 1`` segments; an asking one the pieces
    that can be such a segment of a string of each length within reach.
    """
    lie: set[str] = set()
    ask: set[str] = set()
    for form in forms:
        k, size = form.most, len(form.text)
        for i in range(k + 1):
            lie.add(f"{form.sort}{size}.{i}.{form.text[i * size // (k + 1) : (i + 1) * size // (k + 1)]}")
        for length in range(max(0, size - k), size + k + 1) if form.asks else ():
            more = size - length
            for i in range(k + 1):
                start, stop = i * length // (k + 1), (i + 1) * length // (k + 1)
                # i edits at most lie before the segment, or k - i behind it
                for at in range(max(0, start - i, start + more - (k - i)), min(size - (stop - start), start + i, start + more + (k - i)) + 1):
                    ask.add(f"{form.sort}{length}.{i}.{form.text[at : at + stop - start]}")
    return lie, ask


LEFT, RIGHT = 1, 2
_PAIR = ["key_a", "key_b", "edits", "kind_a", "kind_b"]


def _near_long(forms: Forms, left: set[str], right: set[str], long: set[str]) -> dict[tuple[str, str], int]:
    """Near words of two sides of which one is too long for the columns, by traversal; of few only those that could meet."""
    near: dict[tuple[str, str], int] = {}
    for own, other in ((left & long, right), (left - long, right & long)):
        if own and other and len(own) * len(other) <= FEW:
            letters = {w: bags(forms(w)) for w in own | other}
            pairs = [(a, b) for a in own for b in other if could_meet(letters[a], letters[b])]
            own, other = {a for a, _ in pairs}, {b for _, b in pairs}
        if own and other:
            near |= near_words(forms, own, other)
    return near


def _sided(rows: np.ndarray, spot: np.ndarray, word: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows in order of spot and word; (spot * words + word) of the entries that they make, and the start and count of the rows of each."""
    rows = rows[np.argsort(spot[rows] * words + word[rows], kind="stable")]
    entry = spot[rows] * words + word[rows]
    start = np.flatnonzero(np.r_[True, entry[1:] != entry[:-1]])
    return rows, entry[start], start, np.diff(np.r_[start, len(rows)])


def _met(placed: DataFrame, own: bool, forms: Forms, compatible: Callable[[str, str], bool]) -> DataFrame:
    """Near pairs within each ``shard, piece, i, j`` of ``placed``; ``side`` tells whether a row is asked for, found or both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fits = lru_cache(None)(compatible)

        def meet(table: pa.Table) -> Iterator[pa.RecordBatch]:
            """The pairs of whole spots."""
            at = table.column("spot").combine_chunks()
            spot = np.r_[0, np.cumsum(pc.not_equal(at[1:], at[:-1]).to_numpy(zero_copy_only=False))]
            side = table.column("side").to_numpy()
            in_left, in_right = (np.bincount(spot, (side & flag) > 0) for flag in (LEFT, RIGHT))
            whole = (np.bincount(spot, side == LEFT | RIGHT) == np.bincount(spot)) & own
            kept = np.flatnonzero(((in_left > 0) & (in_right > 0) & ((in_left > 1) | ~whole))[spot])
            if not len(kept):
                return
            spot, side, table = spot[kept], side[kept], table.take(pa.array(kept))
            words, kinds, keys = (table.column(c).combine_chunks().dictionary_encode() for c in ("word", "kind", "key"))
            word, kind, key = (c.indices.to_numpy().astype(np.int64) for c in (words, kinds, keys))
            texts, n = words.dictionary.to_pylist(), len(words.dictionary)
            known = Words(texts, forms)
            fit = np.array([[fits(x, y) for y in kinds.dictionary.to_pylist()] for x in kinds.dictionary.to_pylist()], bool)
            if own:
                rank = np.empty(len(keys.dictionary), np.int64)
                rank[pc.sort_indices(keys.dictionary).to_numpy()] = np.arange(len(rank))
            (l_rows, l_entry, l_start, l_count), (r_rows, r_entry, r_start, r_count) = (_sided(np.flatnonzero(side & flag), spot, word, n) for flag in (LEFT, RIGHT))
            l_spot, r_spot = l_entry // n, r_entry // n
            one = whole[l_spot]  # those of a whole spot meet themselves and what comes behind
            first = np.where(one, np.searchsorted(r_entry, l_entry), np.searchsorted(r_spot, l_spot))
            count = np.searchsorted(r_spot, l_spot, "right") - first

            def rows_of(l: np.ndarray, r: np.ndarray, edits: np.ndarray) -> Iterator[pa.RecordBatch]:
                """The pairs of rows of pairs of entries."""
                for wide in spans(l_count[l]):
                    p, x = ranges(l_start[l[wide]], l_count[l[wide]])
                    p = p + wide.start
                    for some in spans(r_count[r[p]], BLOCK // 4):
                        q, y = ranges(r_start[r[p[some]]], r_count[r[p[some]]])
                        pair, a, b = p[some][q], l_rows[x[some][q]], r_rows[y]
                        ok = fit[kind[a], kind[b]]
                        if own:
                            ok &= np.where(one[l[pair]] & (l_entry[l[pair]] == r_entry[r[pair]]), rank[key[a]] < rank[key[b]], key[a] != key[b])
                        pair, a, b = pair[ok], a[ok], b[ok]
                        if own:
                            turned = rank[key[b]] < rank[key[a]]
                            a, b = np.where(turned, b, a), np.where(turned, a, b)
                        if len(pair):
                            told = lambda values, i: values.dictionary.take(pa.array(i))
                            columns = [told(keys, key[a]), told(keys, key[b]), pa.array(edits[pair], pa.int32()), told(kinds, kind[a]), told(kinds, kind[b])]
                            yield pa.RecordBatch.from_arrays(columns, names=_PAIR)

            for span in spans(count):
                l, r = ranges(first[span], count[span])
                l += span.start
                near, edits = known.near(l_entry[l] % n, r_entry[r] % n)
                yield from rows_of(l[near], r[near], edits)
            if known.long.any():
                long, number = {texts[w] for w in np.flatnonzero(known.long)}, {w: i for i, w in enumerate(texts)}
                for s in np.unique(spot[known.long[word]]):
                    sides = [{texts[e % n] for e in entry[np.searchsorted(entry, s * n) : np.searchsorted(entry, s * n + n)]} for entry in (l_entry, r_entry)]
                    near_long = [(s * n + number[a], s * n + number[b], e) for (a, b), e in _near_long(forms, *sides, long).items() if a != b and not (whole[s] and number[a] > number[b])]
                    l, r, edits = np.array(near_long, np.int64).reshape(-1, 3).T
                    yield from rows_of(np.searchsorted(l_entry, l), np.searchsorted(r_entry, r), edits)

        held: list[pa.RecordBatch] = []
        for batch in batches:
            at = batch.column("spot")
            if sum(map(len, held)) + len(batch) >= ROWS and at[0] != at[-1]:
                last = int(np.flatnonzero(pc.not_equal(at[1:], at[:-1]).to_numpy(zero_copy_only=False))[-1]) + 1
                yield from meet(pa.Table.from_batches([*held, batch[:last]]))
                held = [batch[last:]]
            elif len(batch):
                held.append(batch)
        if held:
            yield from meet(pa.Table.from_batches(held))

    tasks = max(int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
    spots = placed.select(F.concat_ws("\x1f", "shard", "piece", "i", "j").alias("spot"), "side", "key", "word", "kind")
    dealt = spots.repartition(tasks, "spot").sortWithinPartitions("spot")  # few bytes, much work: not to be coalesced
    return dealt.mapInArrow(run, "key_a string, key_b string, edits int, kind_a string, kind_b string")


def _near_in_cuts(words: DataFrame, own: bool, forms: Forms, part: int) -> DataFrame:
    """``shard, a, b, edits``: near words of crowded shards, met in the cuts that they reach. ``words``: ``shard, side, word``."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, sides, pieces = [], [], []
            for n, (side, word) in enumerate(zip(batch.column("side").to_pylist(), batch.column("word").to_pylist())):
                lie, ask = cuts(forms(word))
                for piece in lie | ask:
                    both = piece in lie and piece in ask
                    at.append(n)
                    sides.append(side if both or side != LEFT | RIGHT else RIGHT if piece in lie else LEFT)
                    pieces.append(piece)
            taken = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([taken.column("shard"), pa.array(sides, pa.int32()), taken.column("word"), pa.array(pieces, pa.string())], names=["shard", "side", "word", "piece"])

    pieces = words.select("shard", "side", "word").mapInArrow(spread, "shard string, side int, word string, piece string")
    on = lambda side: F.col("side").bitwiseAND(F.lit(side)) > 0
    parts = lambda side: F.ceil(F.count_if(on(side)) / part).cast("int")
    sizes = pieces.groupBy("shard", "piece").agg(parts(LEFT).alias("ls"), parts(RIGHT).alias("rs")).where("ls > 1 or rs > 1")
    met = pieces.join(sizes, ["shard", "piece"], "left")
    dealt = lambda n: F.pmod(F.xxhash64("word"), F.greatest(F.lit(1), F.col(n))).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col(n) - 1)))
    split = met.where("ls is not null")
    placed = met.where("ls is null").withColumns({"i": F.lit(0), "j": F.lit(0)}).drop("ls", "rs")
    placed = placed.unionByName(split.where(on(LEFT)).withColumns({"side": F.lit(LEFT), "i": dealt("ls")}).withColumn("j", every("rs")).drop("ls", "rs"))
    placed = placed.unionByName(split.where(on(RIGHT)).withColumns({"side": F.lit(RIGHT), "j": dealt("rs")}).withColumn("i", every("ls")).drop("ls", "rs"))
    tagged = placed.withColumns({"key": F.concat_ws("\x1f", "shard", "word"), "kind": F.lit("")})
    found = _met(tagged, own, forms, lambda a, b: True).groupBy("key_a", "key_b").agg(F.min("edits").alias("edits"))
    piece = lambda key, n: F.get(F.split(key, "\x1f"), F.lit(n))
    near = found.select(piece("key_a", 0).alias("shard"), piece("key_a", 1).alias("a"), piece("key_b", 1).alias("b"), "edits")
    return near.unionByName(words.select("shard", F.col("word").alias("a"), F.col("word").alias("b"), F.lit(0).alias("edits")).distinct()) if own else near


def near_rows(left: DataFrame, right: DataFrame | None, forms: Forms, compatible: Callable[[str, str], bool], same: Callable[[Column, Column], Column], part: int = PART) -> DataFrame:
    """``key_a, key_b, edits, kind_a, kind_b``: pairs of rows of a shard whose words are near and whose kinds are compatible.

    Rows are ``shard, key, word, kind`` (text without nulls, distinct). ``compatible``
    tells of two kinds in a task, ``same`` of two columns. Without ``right`` pairs of
    different rows of ``left``, the smaller key first. A pair can come several times,
    with different edits. Shards are met whole; in one of more than ``part`` rows the
    distinct words are cut by segments, and the rows of near words joined.
    """
    own = right is None
    sided = lambda rows, side: rows.select("shard", F.lit(side).alias("side"), "key", "word", "kind")
    rows = sided(left, LEFT | RIGHT) if own else sided(left, LEFT).unionByName(sided(right, RIGHT))
    crowded = cut(rows.groupBy("shard").count().where(F.col("count") > part).select("shard"))
    plain = {"piece": F.lit(""), "i": F.lit(0), "j": F.lit(0)}
    if crowded.isEmpty():
        return _met(rows.withColumns(plain), own, forms, compatible)
    few = _met(rows.join(crowded, "shard", "left_anti").withColumns(plain), own, forms, compatible)
    many = rows.join(crowded, "shard", "left_semi")
    near = cut(_near_in_cuts(many.groupBy("shard", "word").agg(F.bit_or("side").alias("side")) if own else many.select("shard", "side", "word").distinct(), own, forms, part))  # read three times
    on = lambda side: many.where(F.col("side").bitwiseAND(F.lit(side)) > 0)
    asked = split_join(near.withColumnRenamed("a", "word"), on(LEFT).drop("side"), ["shard", "word"]).select("shard", F.col("b").alias("word"), "edits", F.col("word").alias("a"), F.col("key").alias("key_a"), F.col("kind").alias("kind_a"))
    pairs = split_join(asked, on(RIGHT).select("shard", "word", F.col("key").alias("key_b"), F.col("kind").alias("kind_b")), ["shard", "word"]).where(same(F.col("kind_a"), F.col("kind_b")))
    if own:
        pairs = pairs.where((F.col("key_a") != F.col("key_b")) & ((F.col("a") != F.col("word")) | (F.col("key_a") < F.col("key_b"))))
        first = F.col("key_a") < F.col("key_b")
        either = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
        pairs = pairs.select(either("key_a", "key_b").alias("key_a"), either("key_b", "key_a").alias("key_b"), "edits", either("kind_a", "kind_b").alias("kind_a"), either("kind_b", "kind_a").alias("kind_b"))
    return few.unionByName(pairs.select(*_PAIR))
