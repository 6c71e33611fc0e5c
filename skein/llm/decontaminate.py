"""Benchmark decontamination by pigeonhole edit matching.

A test item of n characters has an error budget of ``rate * n`` edits, rounded
down, and is cut into budget + 1 pieces. Wherever a text holds the item within its
budget, one piece stands there unchanged; an Aho-Corasick automaton finds all pieces
of a block of items in one pass over a text. A hit climbs a binary tree over the
pieces: a node of m pieces must occur about the hit with at most m - 1 edits, as
some path from an unchanged piece to the whole item does in every true match. What
reaches the top is decided by Myers' bit-parallel distance. Nothing is sampled, no
text is cut, and no length of item is left out: below ten characters the budget is
zero and the item is searched as it stands.

The items are a stated query set held against all rows. They are read in blocks of
a fixed number of characters, so what a task or the driver holds is bounded, however
long the benchmark is; each block is one scan of the documents, whose hits are
stored before the next block is read.

Defined results: null and blank items match nothing; a null text holds nothing; a null
id of a document or an item comes back as null; repeated documents and repeated items
each get their rows; ids may be of any type; an empty table gives an empty table; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from skein.plans.scratch import materialise

RATE = 0.1
BLOCK_CHARS = 1_000_000


def normalise(text: str | None) -> str:
    """Lower case, one space for any run of white space."""
    return " ".join((text or "").lower().split())


def error_budget(length: int, rate: float = RATE) -> int:
    """Edits allowed for an item of that length."""
    return int(length * rate + 1e-9)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """``(offset, piece)``: ``errors + 1`` pieces of about equal length that make up the item."""
    n, cuts = len(item), errors + 1
    edges = [n * i // cuts for i in range(cuts + 1)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:])]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """Least edit distance of ``pattern`` to any part of ``text``, and the end of the first such part."""
    m = len(pattern)
    at: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        at[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text, 1):
        eq = at[c] if c in at else 0
        vertical = eq | minus
        across = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(across | plus))
        down = plus & across
        if up & top:
            score += 1
            # else: the last row is unchanged or falls
        elif down & top:
            score -= 1
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | (full & ~(vertical | up)), up & vertical
        if score < best:
            best, end = score, j
    return best, end


class Matcher:
    """Finds a block of items in texts."""

    def __init__(self, items: list[tuple[object, str]], rate: float = RATE):
        import ahocorasick

        self.items, self.edges, places = [], [], defaultdict(list)
        for key, raw in items:
            item = normalise(raw)
            if item:
                budget = error_budget(len(item), rate)
                cut = pieces(item, budget)
                for j, (_, piece) in enumerate(cut):
                    places[piece].append((len(self.items), j))
                self.items.append((key, item, budget))
                self.edges.append([*(offset for offset, _ in cut), len(item)])
        self.paths: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()

    def path(self, leaves: int, j: int) -> list[tuple[int, int]]:
        """The nodes above leaf ``j``, as ranges of leaves, the smallest first and without the whole."""
        if (leaves, j) not in self.paths:
            nodes, low, high = [], 0, leaves
            while high - low > 1:
                nodes.append((low, high))
                middle = (low + high) // 2
                low, high = (low, middle) if j < middle else (middle, high)
            self.paths[leaves, j] = nodes[:0:-1]
        return self.paths[leaves, j]

    def climbs(self, i: int, j: int, start: int, text: str, known: dict) -> bool:
        """Whether each node above piece ``j`` of item ``i``, which would begin at ``start``, occurs with few enough edits."""
        item, edges = self.items[i][1], self.edges[i]
        for low, high in self.path(len(edges) - 1, j):
            at = (i, low, high, start)
            if at not in known:
                errors, a, b = high - low - 1, edges[low], edges[high]
                part = item[a:b]
                known[at] = text.startswith(part, start + a) if start + a >= 0 else False
                if not known[at]:
                    known[at] = myers(part, text[max(0, start + a - errors) : max(0, start + b + errors)])[0] <= errors
            if not known[at]:
                return False
        return True

    def find(self, text: str) -> list[tuple[object, int, int]]:
        """``(item, distance, end)`` for each item within its budget of some part of the normalised text."""
        if not self.items:
            return []
        windows, whole, known = defaultdict(set), {}, {}
        for last, (size, where) in self.automaton.iter(text):
            for i, j in where:
                if i not in whole:
                    whole[i] = text.find(self.items[i][1])
                start = last + 1 - size - self.edges[i][j]
                if whole[i] < 0 and start not in windows[i] and self.climbs(i, j, start, text, known):
                    windows[i].add(start)
        found = []
        for i, at in sorted(whole.items()):
            key, item, budget = self.items[i]
            if at >= 0:
                found.append((key, 0, at + len(item)))
                continue
            best = (budget + 1, 0)
            for a, b in _joined(sorted(windows[i]), budget, len(item)):
                a = max(0, a)
                distance, end = myers(item, text[a:b])
                best = min(best, (distance, a + end))
            if best[0] <= budget:
                found.append((key, *best))
        return found


def _joined(starts: list[int], budget: int, length: int) -> Iterator[tuple[int, int]]:
    """Windows around sorted starts, overlapping ones joined."""
    a = b = None
    for s in starts:
        low, high = s - budget, s + length + budget
        if b is None or low > b:
            if b is not None:
                yield a, b
            a, b = low, high
        else:
            b = high
    if b is not None:
        yield a, b


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", chars: int = BLOCK_CHARS) -> Iterator[list[tuple[object, str]]]:
    """The items in blocks of at most about ``chars`` characters; the driver holds one partition's rows at a time."""
    held, size = [], 0
    for key, text in benchmark.select(id_col, text_col).where(F.col(text_col).isNotNull()).toLocalIterator():
        if held and size + len(text) > chars:
            yield held
            held, size = [], 0
        held.append((key, text))
        size += len(text)
    if held:
        yield held


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``(doc_id, item_id, distance, end)``, one row per document and item found in it; ``end`` counts normalised characters."""
    kind = benchmark.schema[item_col].dataType
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, item_id {kind.simpleString()}, distance int, end long"
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    held, stored = None, None
    for block in blocks(benchmark, item_col, item_text_col, block_chars):
        if held is not None:
            done = materialise(held, "leaks")
            stored = done if stored is None else stored.unionByName(done)
        held = rows.mapInArrow(_finder(block, rate, to_arrow_type(kind)), schema)
    if held is None:
        return docs.sparkSession.createDataFrame([], schema)
    return held if stored is None else stored.unionByName(held)


def _finder(block: list, rate: float, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(block, rate)
        for b in batches:
            ids, out = b.column("doc_id"), []
            for i, x in enumerate(b.column("text")):
                out += [(i, *hit) for hit in matcher.find(normalise(x.as_py()))]
            take = pa.array([r[0] for r in out], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [ids.take(take), pa.array([r[1] for r in out], type=kind), pa.array([r[2] for r in out], pa.int32()), pa.array([r[3] for r in out], pa.int64())],
                ["doc_id", "item_id", "distance", "end"],
            )

    return run


def keep_clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` in whose text no item is found, with their own columns.

    Rows go or stay where they are read, by their own text whatever their id; no text moves.
    """
    left = None
    for block in blocks(benchmark, item_col, item_text_col, block_chars):
        left = docs if left is None else materialise(left, "clean")
        rows = left.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))
        left = rows.mapInArrow(_without(block, rate), StructType([StructField("row", left.schema)])).select("row.*")
    return docs if left is None else left


def _without(block: list, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(block, rate)
        for b in batches:
            clean = [not matcher.find(normalise(x.as_py())) for x in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("row").filter(pa.array(clean, pa.bool_()))], ["row"])

    return run
