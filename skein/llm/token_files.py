"""Token ids in bit-plane shuffled shard files.

A shard file holds the ids of a run of documents in blocks of a fixed number of
ids. A block is transposed: byte planes keep the k-th byte of all its ids
together, bit planes the k-th bit. Each plane is a zstandard frame of its own. An
index of chunks and the documents' lengths follow the blocks, so a reader can
fetch any block alone.

    header  4s magic, u8 version, u8 plane kind (8 byte planes, 1 bit planes), u16 zero, u32 ids in a block
    blocks  zstandard frames, plane after plane
    index   for each block: u64 offset, u32 ids, u8 planes, u32 bytes of each plane
    docs    zstandard frame of an Arrow stream: doc_id, n_tokens
    footer  u64 index offset, u64 docs offset, u32 blocks, u64 ids, 4s magic

Documents are dealt out by ranges of their id, so shards stand in ascending
order; each task sorts, encodes and writes its shard in one pass, under a
temporary name first, so that an attempt that is lost leaves no half file and a
second one writes the same bytes.

Defined results: a null text is empty and gives the end id alone; a null id comes
first; rows with equal ids stand together, ordered by a hash of their text; an
empty table gives no shards and an empty result; other columns are ignored.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.plans.scratch import scratch_path

MAGIC, VERSION = b"SKBP", 1
_HEAD, _FOOT = struct.Struct("<4sBBHI"), struct.Struct("<QQIQ4s")
BLOCK = 1 << 16
#: Flags of pieces that came once; two that share a flag are only kept a little early.
FLAGS = 1 << 22


def split_planes(ids: np.ndarray, bits: bool = False) -> list[bytes]:
    """Planes of unsigned 32-bit ids, lowest first; leading zero planes are left out."""
    octets = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if bits:
        planes = [x.tobytes() for x in np.packbits(np.unpackbits(octets, axis=1, bitorder="little").T, axis=1, bitorder="little")]
    else:
        planes = [octets[:, k].tobytes() for k in range(4)]
    while planes and not any(planes[-1]):
        planes.pop()
    return planes


def join_planes(planes: list[bytes], n: int, bits: bool = False) -> np.ndarray:
    """The ids whose planes these are."""
    if bits:
        rows = np.zeros((32, n), np.uint8)
        for k, x in enumerate(planes):
            rows[k] = np.unpackbits(np.frombuffer(x, np.uint8), count=n, bitorder="little")
        octets = np.packbits(rows.T, axis=1, bitorder="little")
    else:
        octets = np.zeros((n, 4), np.uint8)
        for k, x in enumerate(planes):
            octets[:, k] = np.frombuffer(x, np.uint8)
    return np.ascontiguousarray(octets).view("<u4").reshape(n)


class ShardWriter:
    """Appends documents to a binary stream; memory is a block of ids, an id and a length for each document, and a few bytes for each block."""

    def __init__(self, out, bits: bool = False, block: int = BLOCK, level: int = 3):
        self.out, self.bits, self.block = out, bits, block
        self.pack = zstandard.ZstdCompressor(level=level).compress
        self.parts, self.held, self.ids, self.at = [], 0, 0, _HEAD.size
        self.index, self.docs, self.sizes = [], [], []
        out.write(_HEAD.pack(MAGIC, VERSION, 1 if bits else 8, 0, block))

    def add(self, doc_id, ids: bytes) -> None:
        """One document's ids as little-endian unsigned 32-bit integers."""
        self.docs.append(doc_id)
        self.sizes.append(len(ids) // 4)
        self.parts.append(ids)
        self.held += len(ids) // 4
        if self.held >= self.block:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.parts), "<u4")
        whole = len(ids) if last else len(ids) // self.block * self.block
        for i in range(0, whole, self.block):
            part = ids[i : min(i + self.block, whole)]
            planes = [self.pack(x) for x in split_planes(part, self.bits)]
            self.index.append(struct.pack(f"<QIB{len(planes)}I", self.at, len(part), len(planes), *map(len, planes)))
            for x in planes:
                self.out.write(x)
                self.at += len(x)
        self.ids += whole
        self.parts, self.held = [ids[whole:].tobytes()], len(ids) - whole

    def close(self, id_type: pa.DataType) -> None:
        self._flush(True)
        index, docs = b"".join(self.index), io.BytesIO()
        table = pa.table({"doc_id": pa.array(self.docs, id_type), "n_tokens": pa.array(self.sizes, pa.int64())})
        with pa.ipc.new_stream(docs, table.schema) as w:
            w.write_table(table)
        packed = self.pack(docs.getvalue())
        self.out.write(index + packed + _FOOT.pack(self.at, self.at + len(index), len(self.index), self.ids, MAGIC))


class ShardReader:
    """Random access to a shard through a seekable binary file."""

    def __init__(self, f):
        f.seek(0, 2)
        end = f.tell()
        f.seek(0)
        magic, version, kind, _, self.block = _HEAD.unpack(f.read(_HEAD.size))
        f.seek(end - _FOOT.size)
        index_at, docs_at, blocks, self.n_ids, tail = _FOOT.unpack(f.read(_FOOT.size))
        if magic != MAGIC or tail != MAGIC or version != VERSION:
            raise ValueError("not a shard file of this version")
        self.f, self.bits, self.unpack = f, kind == 1, zstandard.ZstdDecompressor().decompress
        f.seek(index_at)
        raw, p, self.index = f.read(docs_at - index_at), 0, []
        for _ in range(blocks):
            at, n, k = struct.unpack_from("<QIB", raw, p)
            self.index.append((at, n, struct.unpack_from(f"<{k}I", raw, p + 13)))
            p += 13 + 4 * k
        packed = f.read(end - _FOOT.size - docs_at)
        self.docs = pa.ipc.open_stream(self.unpack(packed)).read_all()

    def ids(self, i: int) -> np.ndarray:
        """Block ``i``."""
        at, n, sizes = self.index[i]
        self.f.seek(at)
        return join_planes([self.unpack(self.f.read(s)) for s in sizes], n, self.bits)

    def documents(self) -> Iterator[tuple[object, np.ndarray]]:
        """``(doc_id, ids)`` in order, a block at a time."""
        rest, i = np.empty(0, "<u4"), 0
        for doc, n in zip(self.docs["doc_id"].to_pylist(), self.docs["n_tokens"].to_pylist()):
            parts = [rest]
            have = len(rest)
            while have < n:
                parts.append(self.ids(i))
                have += len(parts[-1])
                i += 1
            if len(parts) > 1:
                rest = np.concatenate(parts)
            yield doc, rest[:n]
            rest = rest[n:]


class Encoder:
    """Ids of whole texts from the tokenizers library.

    Byte-level BPE cuts a text before each single space that stands between two
    other characters and around each single newline, and encodes the pieces apart.
    Pieces recur, so their ids are kept, and only new pieces go to the library,
    many in one call. A piece is kept when it comes a second time: of the first
    time only a flag is set at its hash, as most pieces of a corpus come once. At
    ``limit`` pieces the store becomes the old one, whose pieces move over when they
    recur, so at most twice as many are held; flags are cleared at ``limit`` too. Texts
    with other white space or with special tokens, and tokenizers of another make,
    are encoded whole.
    """

    def __init__(self, path: str, limit: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.limit, self.kept, self.old = Tokenizer.from_file(path), limit, {}, {}
        self.seen, self.n_seen = bytearray(FLAGS), 0
        made = json.loads(self.tokenizer.to_str())
        before = made.get("pre_tokenizer") or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.newline = self._whole("\n") if plain and not made.get("normalizer") else b""
        self.in_pieces = len(self.newline) == 4
        self.stop = int(np.frombuffer(self.newline, "<u4")[0]) if self.in_pieces else None
        self.tails = {"": b""}
        known = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(known.values()) + 1, bool)
        self.opens[[i for t, i in known.items() if t[:1] == "\u0120"]] = True  # the byte-level sign for a space

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    @staticmethod
    def _apart(piece: str) -> bool:
        """Whether the piece (a word, or a newline and a word) has no white space at its ends."""
        word = piece[1:] if piece[:1] == "\n" else piece
        return bool(word) and not word[0].isspace() and not word[-1].isspace()

    def _learn(self, new: list[str]) -> dict[str, bytes | None]:
        """The ids of new pieces, encoded each after a space or with a newline between any two; None marks those that can't stand alone."""
        ask, old, kept, got = [], self.old, self.kept, {}
        for w in new:
            if w in old:
                got[w] = kept[w] = old[w]
            elif not self._apart(w):
                got[w] = None
            elif w[-1] in ".," and w[-2:-1].isalpha() and (core := kept.get(w[:-1])):
                got[w] = core + self._tail(w[-1])
            else:
                ask.append(w)
        for words, spaced in (([w for w in ask if w[0] != "\n"], True), ([w[1:] for w in ask if w[0] == "\n"], False)):
            for at in range(0, len(words), 5000):
                part = words[at : at + 5000]
                text = " " + " ".join(part) if spaced else "\n".join(part)
                ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
                raw = ids.tobytes()
                if spaced:  # a piece begins where a token begins with the space
                    starts = np.flatnonzero(self.opens[ids])
                    for w, p, q in zip(part, (4 * starts).tolist(), [*(4 * starts[1:]).tolist(), len(raw)], strict=True):
                        got[w] = raw[p:q]
                    continue
                p = 0
                for w, q in zip(part, [*np.flatnonzero(ids == self.stop).tolist(), len(ids)], strict=True):
                    got["\n" + w] = self.newline + raw[4 * p : 4 * q]
                    p = q + 1
        seen, n = self.seen, len(self.seen)
        for w, ids in got.items():
            at = hash(w) % n
            if seen[at]:
                kept[w] = ids
            else:
                seen[at] = 1
                self.n_seen += 1
        if self.n_seen > self.limit:
            self.seen, self.n_seen = bytearray(n), 0
        return got

    def _tail(self, text: str) -> bytes:
        if text not in self.tails:
            if len(self.tails) > self.limit:
                self.tails = {"": b""}
            self.tails[text] = self._whole(text)
        return self.tails[text]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if not self.in_pieces:
            return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        if len(self.kept) > self.limit:
            self.old, self.kept = self.kept, {}
        cut, new = [], {}
        get = self.kept.get
        for text in texts:
            body = text.rstrip()
            if any(x in text for x in self.special) or len(text) - len(body) > 64:
                cut.append(None)
                continue
            pieces = body.replace("\n", " \n").split(" ")
            if pieces[0]:
                pieces[0] = "\n" + pieces[0]  # no space before it, like a word after a newline
            after_space = not pieces[0]
            if after_space:
                del pieces[0]
            found, lacking = list(map(get, pieces)), []
            for _ in range(found.count(None)):
                lacking.append(found.index(None, lacking[-1] + 1 if lacking else 0))
                new[pieces[lacking[-1]]] = None
            cut.append((pieces, found, lacking, after_space, text[len(body) :]))
        got = self._learn(list(new)) if new else {}
        out = []
        for text, x in zip(texts, cut):
            if x is None:
                out.append(self._whole(text))
                continue
            pieces, found, lacking, after_space, tail = x
            for i in lacking:
                found[i] = got[pieces[i]]
            # a piece that can't stand alone has None
            if None in found:
                out.append(self._whole(text))
            else:
                ids = b"".join(found)
                out.append((ids if after_space else ids[4:]) + self._tail(tail))
        return out


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, bits: bool = False, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode ``docs`` into shard files below ``path``: one row per shard, in order.

    Returns ``(shard, file, first, n_docs, n_ids)``, with ``first`` the number of
    ids before the shard. Only these rows, one for each range, go to the driver.
    """
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # the third key lets a run of equal rows spread over ranges
    rows = rows.withColumn("hash", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(shards, "doc_id", "hash", "row").sortWithinPartitions("doc_id", "hash").select("doc_id", "text")
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        shard = TaskContext.get().partitionId()
        name, trial = f"{folder}/shard-{shard:06d}.skbp", f"{folder}/_trial-{uuid.uuid4().hex}"
        encoder, n_docs, id_type = _encoder(tokenizer), 0, None
        with store.open_output_stream(trial) as out:
            writer = ShardWriter(out, bits)
            for b in batches:
                id_type = b.schema.field("doc_id").type
                for at in range(0, b.num_rows, 64):
                    part = b.slice(at, 64)
                    for doc, ids in zip(part.column("doc_id").to_pylist(), encoder.encode(part.column("text").to_pylist())):
                        writer.add(doc, ids + end)
                        n_docs += 1
            writer.close(id_type or pa.int64())
        if not n_docs:
            store.delete_file(trial)
            return
        store.move(trial, name)
        yield pa.RecordBatch.from_pydict({"shard": [shard], "file": [name], "n_docs": [n_docs], "n_ids": [writer.ids]}, pa.schema([("shard", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    found = sorted(dealt.mapInArrow(run, "shard int, file string, n_docs long, n_ids long").collect())
    _sweep(spark, path)
    first, index = 0, []
    for shard, file, n_docs, n_ids in found:
        index.append((shard, file, first, n_docs, n_ids))
        first += n_ids
    return spark.createDataFrame(index, "shard int, file string, first long, n_docs long, n_ids long")


def _sweep(spark: SparkSession, path: str) -> None:
    """Delete what lost attempts have left under temporary names."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    store = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for left in store.globStatus(hadoop.Path(f"{path}/_trial-*")) or []:
        store.delete(left.getPath(), False)


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """One encoder for each worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _forget() -> None:
    """Give the encoders' memory back: workers live on beside whatever runs after the shards are written."""
    if _ENCODERS:
        _ENCODERS.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # C libraries without it
            ctypes.CDLL(None).malloc_trim(0)


def read_shards(index: DataFrame, path: str, id_type: str = "bigint") -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, read back from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _forget()
        store, _ = fs.FileSystem.from_uri(path)
        for b in batches:
            for row in b.to_pylist():
                with store.open_input_file(row["file"]) as f:
                    reader, at = ShardReader(f), row["first"]
                    kind, held = reader.docs.schema.field("doc_id").type, []
                    for doc, ids in reader.documents():
                        held.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
                        at += len(ids)
                        if len(held) == 4096:
                            yield _batch(held, kind)
                            held = []
                    yield _batch(held, kind)

    n = max(1, index.count())
    return index.select("shard", "file", "first").repartition(n, "shard").mapInArrow(run, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *[pa.array(c, pa.int64()) for c in columns[1:]]], ["doc_id", "start", "n_tokens", "ids_crc32"])


def round_trip(docs: DataFrame, tokenizer: str, path: str | None = None, **options) -> DataFrame:
    """Write ``docs`` and read the files back."""
    path = path or scratch_path(docs.sparkSession, "tokens")
    index = write_shards(docs, path, tokenizer, **options)
    return read_shards(index, path, docs.schema[options.get("id_col", "doc_id")].dataType.simpleString())


def default_tokenizer() -> str:
    """The public byte-level vocabulary of 50 thousand ids."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
