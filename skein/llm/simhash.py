"""SimHash near-duplicates found through Golay-code fuzzy keys.

A 64-bit fingerprint is three segments of 23, 23 and 18 bits (the last padded
with zeros to 23). The binary Golay code (23, 12, 7) is perfect: every word of
23 bits is within 3 of one codeword, its home. A word within 1 of another is
within 4 of that other's home, and a word has only one codeword (leader weight
0 to 2) or six (weight 3) within 4. So a home key on one side and up to six near
keys on the other meet for any two segments that differ in at most one bit.

Three differing bits over three segments leave either a segment with none and
another with at most one (keys A: one exact segment, one fuzzy), or one in each
segment (keys B: two fuzzy segments, and an exact half of the third). Both kinds
of key hold 33 or more bits, so chance meetings stay rare at any size, and every
linked pair meets on at least one key. The join keeps pairs whose fingerprints
differ in 1 to 3 bits.

Copies collapse first: the join is over distinct fingerprints. A fingerprint has
at most 43,744 others within 3 bits however large its group is.

Defined results: a null or blank text has fingerprint zero; rows with equal ids
are rows of their own with one component each; a null id counts for no minimum,
so its component is the least known id linked to it, else null; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.components import connected_components
from skein.plans.scratch import fresh_name, materialise

SEED = 42
#: Generator polynomial of the Golay code (23, 12, 7), x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
RADIUS = 3
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SEGMENTS = ((0, 23), (23, 23), (46, 18))


def shingle_hashes(text: str | None, width: int = 3) -> np.ndarray:
    """XXH64 of each shingle of ``width`` words, ASCII lower-cased, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    f = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([f(joined, SEED)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())
    return np.fromiter((f(joined[a:b], SEED) for a, b in spans), np.uint64, len(words) - width + 1)


@lru_cache(1)
def _spread() -> np.ndarray:
    """For each byte, its bits dealt over the eight bytes of a word, for counting in lanes."""
    return np.array([sum((b >> j & 1) << 8 * j for j in range(8)) for b in range(256)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that over half of the hashes have set."""
    n = len(hashes)
    if not n:
        return 0
    octets = hashes.view(np.uint8).reshape(n, 8)
    lanes, cuts = _spread(), np.arange(0, n, 255)
    counts = np.concatenate([np.add.reduceat(lanes[octets[:, k]], cuts).view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64) for k in range(8)])
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``(doc_id, fp)`` of every whole text; ``fp`` holds the 64 bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((majority(shingle_hashes(x.as_py(), width)) for x in b.column("text")), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, fp long")


@lru_cache(1)
def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(home, near, n_near)``: for each 11-bit syndrome the home's error pattern,
    and the error patterns of all codewords within 4 (six columns, ``n_near`` used).

    A codeword at distance 3 or 4 is the word with such a pattern removed, so the
    tables depend on the syndrome alone.
    """
    rest = np.zeros(23, np.int64)  # the syndrome of each single bit
    for i in range(23):
        x = 1 << i
        for j in range(22, 10, -1):
            if x >> j & 1:
                x ^= GENERATOR << (j - 11)
        rest[i] = x
    home = np.zeros(2048, np.int64)
    near: list[list[int]] = [[] for _ in range(2048)]

    def walk(first: int, pattern: int, syndrome: int, weight: int) -> None:
        if weight <= 3:
            home[syndrome] = pattern
        near[syndrome].append(pattern)
        if weight < 4:
            for i in range(first, 23):
                walk(i + 1, pattern | 1 << i, syndrome ^ int(rest[i]), weight + 1)

    walk(0, 0, 0, 0)
    table, count = np.zeros((2048, 6), np.int64), np.zeros(2048, np.int64)
    for s, patterns in enumerate(near):
        count[s] = len(patterns)
        table[s, : len(patterns)] = patterns
    return home, table, count


@lru_cache(1)
def _syndromes() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and the high 11 bits of a word."""

    def of(x: int) -> int:
        for j in range(22, 10, -1):
            if x >> j & 1:
                x ^= GENERATOR << (j - 11)
        return x

    return np.array([of(x) for x in range(4096)], np.int64), np.array([of(x << 12) for x in range(2048)], np.int64)


def _decode(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the home codeword, indices of up to six near ones, and which are used.

    The code is systematic in its high 12 bits, so these name a codeword.
    """
    low, high = _syndromes()
    s = low[words & 4095] ^ high[words >> 12]
    home, near, count = golay_tables()
    return (words ^ home[s]) >> 11, (words[:, None] ^ near[s]) >> 11, np.arange(6)[None, :] < count[s][:, None]


def fuzzy_keys(fps: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """``(row, key)`` arrays of home keys and of near keys for unsigned fingerprints."""
    n, rows = len(fps), np.arange(len(fps), dtype=np.int64)
    raw = [(fps >> np.uint64(at)).astype(np.int64) & ((1 << size) - 1) for at, size in _SEGMENTS]
    coded = [_decode(x) for x in raw]
    home, near = [], []
    tag = 0
    for i in range(3):
        for j in range(3):
            if i != j:
                base = (tag << 40) | (raw[i] << 12)
                home.append((rows, base | coded[j][0]))
                used = coded[j][2]
                near.append((np.broadcast_to(rows[:, None], (n, 6))[used], (base[:, None] | coded[j][1])[used]))
                tag += 1
    for half in (raw[2] & 511, raw[2] >> 9):
        base = (tag << 40) | (half << 24)
        home.append((rows, base | (coded[0][0] << 12) | coded[1][0]))
        both = coded[0][2][:, :, None] & coded[1][2][:, None, :]
        keys = base[:, None, None] | (coded[0][1][:, :, None] << 12) | coded[1][1][:, None, :]
        near.append((np.broadcast_to(rows[:, None, None], (n, 6, 6))[both], keys[both]))
        tag += 1
    return tuple(tuple(np.concatenate(x) for x in zip(*side)) for side in (home, near))


def _keyed(fps: DataFrame, near: bool, block: int = 20_000) -> DataFrame:
    """``(key, fp)`` rows, in numpy blocks of a fixed number of fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, block):
                fp = b.column("fp").slice(at, block).to_numpy()
                rows, keys = fuzzy_keys(fp.view(np.uint64))[near]
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[rows])], ["key", "near" if near else "home"])

    return fps.select("fp").mapInArrow(run, f"key long, {'near' if near else 'home'} long")


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of distinct fingerprints that differ in at most ``radius`` (0 to 3) bits."""
    if not 0 <= radius <= RADIUS:
        raise ValueError("the keys cover up to 3 differing bits")
    fps = fps.select("fp").where("fp is not null")
    differ = F.bit_count(F.col("home").bitwiseXOR(F.col("near")))
    near = _keyed(fps, True).withColumnRenamed("key", "near_key").hint("merge")  # the plan takes a side for as small as its fingerprints and would send it through the driver
    pairs = _keyed(fps, False).join(near, (F.col("key") == F.col("near_key")) & (differ >= 1) & (differ <= radius))
    return pairs.select(F.least("home", "near").alias("a"), F.greatest("home", "near").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = RADIUS) -> DataFrame:
    """``(doc_id, fp, fingerprint, component_id)`` for every row of ``docs``."""
    marked = materialise(fingerprints(docs, id_col, text_col, width), "fingerprints")
    distinct = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    named = distinct.where("rep is not null")
    pairs = links(distinct, radius)
    # a fingerprint that only rows without an id have stands between others by its own value, so nodes are fingerprints
    components = connected_components(pairs, "a", "b")
    least = components.join(named, F.col("node") == F.col("fp")).groupBy("component").agg(F.min("rep").alias("least"))
    linked = components.select("node", F.col("component").alias("c")).join(least, F.col("c") == F.col("component")).select("node", "least")
    mapped = distinct.join(linked, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("of"), F.coalesce("least", "rep").alias("component_id"))
    mapped = materialise(mapped, "mapped")  # a stored side: the join below can then split a fingerprint that very many rows share
    return marked.join(mapped, F.col("fp") == F.col("of")).select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row for each component: that of its least id, with its own columns.

    Of rows that share this id, the one with the least hash of all its columns stays, so a
    rerun keeps the same one; of rows alike in every column one stays. A component without
    any id can't be named and is dropped.
    """
    key, of, n = (fresh_name(docs, x) for x in ("key", "of", "n"))
    hashed = docs.withColumn(key, F.xxhash64(*docs.columns))
    named = hashed.select(F.struct(F.col(id_col).isNull().alias("lacks"), F.col(id_col).alias("id"), F.col(key).alias("key")).alias("id"), F.col(text_col).alias("text"))
    heads = near_duplicates(named, "id", "text", **options).where("doc_id = component_id and not doc_id.lacks")
    heads = materialise(heads.groupBy(F.col("doc_id").alias(of)).agg(F.count("*").alias(n)), "heads")  # stored, so its size is known
    met = (F.col(id_col) == F.col(f"{of}.id")) & (F.col(key) == F.col(f"{of}.key"))
    once = hashed.join(heads.where(F.col(n) == 1), met, "left_semi")
    alike = hashed.join(heads.where(F.col(n) > 1), met, "left_semi").dropDuplicates([id_col, key])
    return once.unionByName(alike).select(*[once[c] for c in docs.columns])
