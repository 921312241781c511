"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are brought to one form (lower case, letters and digits, single blanks, one at either end, so that an
item begins and ends where words do). An item of m characters without the outer blanks may differ by k = floor(error_rate * m) edits, so it is split into k + 1 pieces, of which any match holds one unchanged. An
Aho-Corasick automaton of all pieces finds the exact hits in each whole text. Hits are then checked up a binary tree of
the pieces: if a match spends at most k edits over k + 1 pieces, then some unchanged piece has, at every tree node above
it, fewer edits than the node has pieces. The lowest check is a substring test, the upper ones and the last, of the whole
item, are Myers' bit-parallel distance over the window about the hit.

The items are read on the driver in blocks of at most `block_bytes`, each block broadcast and matched in its own pass, so
what is broadcast is bounded however many items there are; documents are never shuffled.

The automaton is built once a worker and block, however many tasks the worker runs.

Defined cases: a null text is empty and matches nothing, as does an item without letters or digits; an item too short for
an edit must occur unchanged, as whole words; a very long text is matched whole; repeated rows are matched each on its own; items that tie are all reported; an empty table on either
side gives no match; columns other than ids and texts aren't read.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from tidestep.llm.common import sliced, texts_of

_BETWEEN = re.compile(r"[\W_]+")


def normal_form(text: str) -> str:
    return _BETWEEN.sub(" ", text.lower()).strip()


class Pattern:
    """A string with its bit masks for Myers' search."""

    def __init__(self, text: str) -> None:
        self.text, self.n, self.masks = text, len(text), defaultdict(int)
        for i, c in enumerate(text):
            self.masks[c] |= 1 << i
        self.masks = dict(self.masks)

    def distance(self, text: str) -> int:
        """The least number of edits between the pattern and any substring of the text."""
        if self.text in text:
            return 0
        n, full, high, get = self.n, (1 << self.n) - 1, 1 << (self.n - 1), self.masks.get
        pv, mv, score, best = full, 0, n, n
        for c in text:
            eq = get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | ~(xh | pv)
            mh = pv & xh
            if ph & high:
                score += 1
            elif mh & high:
                score -= 1
                if score < best:
                    best = score
            ph <<= 1
            pv = ((mh << 1) | ~(xv | ph)) & full
            mv = ph & xv & full
        return best


class Item:
    """A test item: its pieces, and for each piece the tree nodes above it, from the lowest, as (begin, pattern, budget)."""

    def __init__(self, item_id: int, text: str, error_rate: float) -> None:
        self.k = int(error_rate * len(text))
        text = f" {text} "
        self.item_id, self.whole = item_id, Pattern(text)
        m = self.k + 1
        cut = [len(text) * j // m for j in range(m + 1)]
        self.pieces = [(cut[j], text[cut[j] : cut[j + 1]]) for j in range(m)]
        self.above: list[list[tuple[int, Pattern, int]]] = [[] for _ in range(m)]
        self.sibling: list[tuple[int, int, str, str] | None] = [None] * m

        def descend(lo: int, hi: int, top: bool) -> None:
            if hi - lo == 1:
                return
            if not top:
                node = (cut[lo], Pattern(text[cut[lo] : cut[hi]]), hi - lo - 1)
                for j in range(lo, hi):
                    self.above[j].insert(0, node)
            mid = (lo + hi) // 2
            if hi - lo == 2:
                for j, other in ((lo, mid), (mid, lo)):
                    s, half = text[cut[other] : cut[other + 1]], (cut[other + 1] - cut[other]) // 2
                    self.sibling[j] = (cut[other] - cut[j] - 1, cut[other + 1] - cut[j] + 1, s[:half], s[half:])
            descend(lo, mid, False)
            descend(mid, hi, False)

        descend(0, m, True)

    def verify(self, j: int, at: int, text: str) -> int | None:
        """The item's least distance about a hit of piece j at a place in the text, unless the tree rules a match out.

        Hits that begin the item in one stretch of k + 1 places share a window, which holds every match about any of them.
        """
        if s := self.sibling[j]:
            near = text[max(at + s[0], 0) : max(at + s[1], 0)]
            if s[2] not in near and s[3] not in near:  # the sibling has one edit at most
                return None
        start = at - self.pieces[j][0]
        for begin, node, budget in self.above[j]:
            if node.distance(text[max(start + begin - budget, 0) : max(start + begin + node.n + budget, 0)]) > budget:
                return None
        k, first = self.k, self.stretch(start) * (self.k + 1)
        return self.whole.distance(text[max(first - 2 * k, 0) : max(first + self.whole.n + 3 * k, 0)])

    def stretch(self, start: int) -> int:
        return start // (self.k + 1)


class Matcher:
    def __init__(self, items: list[tuple[int, str]], error_rate: float) -> None:
        self.items = [Item(i, n, error_rate) for i, t in items if (n := normal_form(t))]
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for number, item in enumerate(self.items):
            for j, (_, piece) in enumerate(item.pieces):
                places[piece].append((number, j))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()

    def match(self, text: str) -> dict[int, int]:
        """The least distance of each item (by number) that the text holds within its budget."""
        if not self.items:
            return {}
        text = f" {normal_form(text)} "
        found: dict[int, int] = {}
        seen: set[tuple[int, int]] = set()  # the windows that are verified
        for end, (n, where) in self.automaton.iter(text):
            for number, j in where:
                if found.get(number) == 0:
                    continue
                item = self.items[number]
                at = end - n + 1
                start = at - item.pieces[j][0]
                window = number, item.stretch(start)
                if window in seen:
                    continue
                distance = item.verify(j, at, text)
                if distance is not None:
                    seen.add(window)
                    if distance <= item.k:
                        found[number] = min(distance, found.get(number, distance))
        return found


_matchers: dict[str, Matcher] = {}


def matcher_of(key: str, items: list[tuple[int, str]], error_rate: float) -> Matcher:
    """The matcher of a block, kept by the worker while it is in use."""
    if key not in _matchers:
        _matchers.clear()
        _matchers[key] = Matcher(items, error_rate)
    return _matchers[key]


def blocks_of(benchmark: DataFrame, block_bytes: int, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The items, read as a stream, in lists of at most about block_bytes."""
    held, size = [], 0
    for item_id, text in texts_of(benchmark, id_col, text_col).distinct().toLocalIterator():
        if held and size + len(text) > block_bytes:
            yield held
            held, size = [], 0
        held.append((item_id, text))
        size += len(text)
    if held:
        yield held


MATCH = "doc_id long, item_id long, distance long, budget long"


def contaminations(docs: DataFrame, benchmark: DataFrame, error_rate: float = 0.1, block_bytes: int = 8 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, distance, budget): the items that each row's text holds, with the least distance."""
    spark = docs.sparkSession
    texts = texts_of(docs, id_col, text_col)
    names = ["doc_id", "item_id", "distance", "budget"]

    def pass_over(items: list[tuple[int, str]]) -> DataFrame:
        shared, key = spark.sparkContext.broadcast(items), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = matcher_of(key, shared.value, error_rate)
            for b in sliced(batches):
                out: list[list] = [[], [], [], []]
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    for number, distance in matcher.match(text).items():
                        item = matcher.items[number]
                        for column, value in zip(out, (doc_id, item.item_id, distance, item.k), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names)

        return texts.mapInArrow(run, MATCH)

    found = None
    for items in blocks_of(benchmark, block_bytes, "item_id", "text"):
        found = pass_over(items) if found is None else found.unionByName(pass_over(items))
    return found if found is not None else spark.createDataFrame([], MATCH)


def without_items(docs: DataFrame, benchmark: DataFrame, error_rate: float = 0.1, block_bytes: int = 8 << 20) -> DataFrame:
    """The rows, of any columns, whose text holds no item within its budget."""
    spark = docs.sparkSession
    kept, at = docs, docs.columns.index("text")

    def pass_over(rows: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
        shared, key = spark.sparkContext.broadcast(items), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = matcher_of(key, shared.value, error_rate)
            for b in sliced(batches):
                yield b.filter(pa.array([not (t and matcher.match(t)) for t in b.column(at).to_pylist()], pa.bool_()))

        return rows.mapInArrow(run, docs.schema)

    for items in blocks_of(benchmark, block_bytes, "item_id", "text"):
        kept = pass_over(kept, items)
    return kept
