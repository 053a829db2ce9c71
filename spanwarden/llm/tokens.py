"""Token ids in sorted-string-table shards.

Documents are range-partitioned and sorted by key, encoded with a public tokenizer and appended to
shard files. A shard is: data blocks of about ``BLOCK`` bytes, whose entries share key prefixes with
the entry before them; a sparse index (first key, offset, length, CRC-32 of each block); a Bloom
filter of the keys; a fixed-size footer. ``Shard.get`` finds a key by filter, binary search over the
index, and one block read.

Ids are stored as 2 bytes each where all of an entry fit, else 4 (little-endian).

A text is cut where one space stands between two non-space characters, which is always a boundary
of byte-level pre-tokens, so the pieces' ids are the text's ids; each worker encodes a distinct
piece once (and forgets all when it holds ``CACHED``), many joined by line feeds at a time. Other white
space stays inside pieces.

Shards lie in the folder that the cluster shares. A task writes under a name of its own and renames
at the end, so a repeated task leaves the same file. Defined results: null texts are empty and hold
the end id alone; null keys sort first; rows of one key are ordered by a hash of their text, equal rows as
they were read; repeated rows are entries of their own; a text of any length is one entry; an empty table
gives no shard; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanwarden.llm.common import cut, quoted, shared_path

BLOCK = 64 << 10
SHARD = 128 << 20
CACHED = 2_000_000
#: Pieces that are encoded as one text.
JOINED = 64
END_ID = 2
#: Parts whose shards' offsets are summed at once.
PARTS = 1000
MAGIC = b"SWSST\x00\x01\n"
BITS_PER_KEY, PROBES = 10, 7
_FOOTER = struct.Struct("<QQQQQQ8s")  # index offset and length, filter offset and length, entries, ids
_UNSAFE = re.compile(r"\s | \s|\x00")
_BESIDE = ("  ", " \n", "\n ", " \t", "\t ", " \r", "\r ", " \v", "\v ", " \f", "\f ", "\x00", "\x1c", "\x1d", "\x1e", "\x1f")
#: Beside these a line feed is no piece of its own: white space runs are cut as a whole.
_BESIDE_FEED = ("\n\n", "\n\t", "\t\n", "\n\r", "\r\n", "\n\v", "\v\n", "\n\f", "\f\n")
#: White space beyond ASCII.
_ODD = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search
#: A piece that line feeds around it leave as it is: it holds none, ends with no white space, begins with one space at most.
_LONE = re.compile(r" ?\S(?:[^\n]*\S)?").fullmatch
_open: dict[str, Encoder] = {}


def parted(text: str) -> list[str]:
    """The text in pieces whose ids, one after another, are the text's; whole where a space stands beside other
    white space (or the text holds what marks the cuts)."""
    odd = not text.isascii() and _ODD(text) is not None
    if _UNSAFE.search(text) if odd else any(b in text for b in _BESIDE):
        return [text]
    # a line feed between other characters than white space is a piece
    if "\n" in text and not odd and not any(b in text for b in _BESIDE_FEED):
        text = text.replace("\n", "\x00\n\x00")
    return text.replace(" ", "\x00 ").split("\x00")


class Encoder:
    """A tokenizer with a bounded memory of pieces."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        ids = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        # the id that a line feed gets between pieces, if it is one that parts them
        feed = ids("\n")
        self.feed = feed[0] if len(feed) == 1 and ids("Ab1\n cd,\nx") == [*ids("Ab1"), *feed, *ids(" cd,"), *feed, *ids("x")] else None

    def _encoded(self, texts: list[str]) -> Iterator[np.ndarray]:
        for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            yield np.array(e.ids, "<u4")

    def _learn(self, pieces: list[str]) -> None:
        """Pieces are encoded many at once, with line feeds between them, which costs less than one by one."""
        alone, known = pieces, self.known
        if self.feed is not None:
            together = [p for p in pieces if _LONE(p) and "<|" not in p]
            alone = list(set(pieces).difference(together))
            for i in range(0, len(together), JOINED * 8):
                parts = [together[j : j + JOINED] for j in range(i, min(i + JOINED * 8, len(together)), JOINED)]
                for part, ids in zip(parts, self._encoded(["\n".join(p) for p in parts]), strict=True):
                    data, start = ids.tobytes(), 0
                    ends = [*np.flatnonzero(ids == self.feed).tolist(), len(ids)]
                    for piece, end in zip(part, ends, strict=True):
                        known[piece] = data[4 * start : 4 * end]
                        start = end + 1
        for i in range(0, len(alone), 2000):
            part = alone[i : i + 2000]
            for piece, ids in zip(part, self._encoded(part), strict=True):
                known[piece] = ids.tobytes()

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        pieces = [parted(t) for t in texts]
        if len(self.known) > CACHED:
            self.known.clear()
        self._learn(list(set().union(*pieces).difference(self.known)))
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, p)), "<u4") for p in pieces]


def encoder(path: str) -> Encoder:
    if path not in _open:
        _open[path] = Encoder(path)
    return _open[path]


def key_bytes(key: int | str | None) -> bytes:
    """Bytes that sort as the keys do, null first."""
    if key is None:
        return b"\x00"
    return b"\x01" + (key + (1 << 63)).to_bytes(8, "big") if isinstance(key, int) else b"\x02" + key.encode()


def key_of(data: bytes) -> int | str | None:
    if data[0] == 0:
        return None
    return int.from_bytes(data[1:], "big") - (1 << 63) if data[0] == 1 else data[1:].decode()


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _take(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> Iterator[int]:
    h = xxhash.xxh64_intdigest(key)
    step = (h >> 32) | 1
    for i in range(PROBES):
        yield (h + i * step) % bits


class Writer:
    """Appends entries in key order to one shard."""

    def __init__(self, sink):
        self.sink, self.at = sink, 0
        self.block, self.first, self.last = bytearray(), b"", b""
        self.index: list[tuple[bytes, int, int, int]] = []
        self.keys: list[bytes] = []
        self.ids = 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def add(self, key: bytes, ids: np.ndarray) -> None:
        shared = len(os.path.commonprefix([self.last, key])) if self.block else 0
        if not self.block:
            self.first = key
        wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
        self.block += _varint(shared) + _varint(len(key) - shared) + key[shared:] + bytes([4 if wide else 2]) + _varint(len(ids)) + ids.astype("<u4" if wide else "<u2").tobytes()
        self.last = key
        self.keys.append(key)
        self.ids += len(ids)
        if len(self.block) >= BLOCK:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            data = bytes(self.block)
            self.index.append((self.first, self.at, len(data), zlib.crc32(data)))
            self._put(data)
            self.block.clear()

    def close(self) -> None:
        self._flush()
        index_at = self.at
        self._put(b"".join(_varint(len(k)) + k + struct.pack("<QII", at, n, crc) for k, at, n, crc in self.index))
        filter_at, bits = self.at, max(64, len(self.keys) * BITS_PER_KEY)
        bloom = bytearray((bits + 7) // 8)
        for k in self.keys:
            for p in _probes(k, len(bloom) * 8):
                bloom[p >> 3] |= 1 << (p & 7)
        self._put(bytes(bloom))
        self._put(_FOOTER.pack(index_at, filter_at - index_at, filter_at, len(bloom), len(self.keys), self.ids, MAGIC))


class Shard:
    """A shard opened for reading."""

    def __init__(self, path: str):
        fs, inner = pyarrow.fs.FileSystem.from_uri(path)
        self.file = fs.open_input_file(inner)
        size = self.file.size()
        index_at, index_n, bloom_at, bloom_n, self.entries, self.ids, magic = _FOOTER.unpack(self.file.read_at(_FOOTER.size, size - _FOOTER.size))
        if magic != MAGIC or self.file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"not a shard: {path}")
        data, at = self.file.read_at(index_n, index_at), 0
        self.index: list[tuple[bytes, int, int, int]] = []
        while at < len(data):
            n, at = _take(data, at)
            self.index.append((data[at : at + n], *struct.unpack_from("<QII", data, at + n)))
            at += n + 16
        self.bloom = self.file.read_at(bloom_n, bloom_at)

    def _block(self, i: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, offset, n, crc = self.index[i]
        data = self.file.read_at(n, offset)
        if zlib.crc32(data) != crc:
            raise ValueError("a block's checksum differs")
        at, key = 0, b""
        while at < len(data):
            shared, at = _take(data, at)
            more, at = _take(data, at)
            key = key[:shared] + data[at : at + more]
            width, at = data[at + more], at + more + 1
            count, at = _take(data, at)
            yield key, np.frombuffer(data, "<u2" if width == 2 else "<u4", count, at)
            at += count * width

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for i in range(len(self.index)):
            yield from self._block(i)

    def may_hold(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, len(self.bloom) * 8))

    def get(self, key: int | str | None) -> list[np.ndarray]:
        """The entries of a key."""
        wanted = key_bytes(key)
        out: list[np.ndarray] = []
        if self.may_hold(wanted):
            # entries of one key can begin in the block before the first whose first key is the key
            i = max(bisect.bisect_left([x[0] for x in self.index], wanted) - 1, 0)
            while i < len(self.index) and self.index[i][0] <= wanted:
                out += [ids for k, ids in self._block(i) if k == wanted]
                i += 1
        return out


def _written(it: Iterator[pa.RecordBatch], folder: str, tokenizer: str, shard_bytes: int) -> Iterator[pa.RecordBatch]:
    context = TaskContext.get()
    part, attempt = context.partitionId(), context.taskAttemptId()
    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    encode = encoder(tokenizer)
    out: list[tuple] = []
    writer = temporary = None

    def finish() -> None:
        nonlocal writer
        writer.close()
        writer.sink.close()
        name = f"shard-{part:06d}-{len(out):04d}.sst"
        fs.move(temporary, f"{root}/{name}")
        out.append((f"{folder}/{name}", part, len(out), len(writer.keys), writer.ids))
        writer = None

    for batch in it:
        for i in range(0, len(batch), 200):
            rows = batch.slice(i, 200)
            keys = rows.column("key").to_pylist()
            for key, ids in zip(keys, encode([t or "" for t in rows.column("text").to_pylist()]), strict=True):
                if writer is None:
                    temporary = f"{root}/_part-{part:06d}-{attempt}-{len(out):04d}"
                    fs.create_dir(root, recursive=True)
                    writer = Writer(fs.open_output_stream(temporary))
                writer.add(key_bytes(key), np.append(ids, np.uint32(END_ID)))
                if writer.at + len(writer.block) >= shard_bytes:
                    finish()
    if writer is not None:
        finish()
    columns = list(zip(*out, strict=True)) or [()] * 5
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["path", "part", "number", "entries", "ids"])


def write_shards(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", folder: str | None = None, shard_bytes: int = SHARD) -> DataFrame:
    """Write all documents; return the manifest (path, part, number, entries, ids), in part and number order."""
    folder = folder or shared_path(docs.sparkSession, "shards")
    # equal rows are told apart by where they were read, so that they can be split
    rows = docs.select(F.col(quoted(key)).alias("key"), F.col(quoted(text)).alias("text"), F.xxhash64(F.col(quoted(text))).alias("h"), F.monotonically_increasing_id().alias("at"))
    order = [F.asc_nulls_first("key"), F.asc("h"), F.asc("at")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "text")
    return cut(rows.mapInArrow(partial(_written, folder=folder, tokenizer=tokenizer, shard_bytes=shard_bytes), "path string, part long, number long, entries long, ids long"))


def _footers(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("path", "part", "number")], pa.array([Shard(p).ids for p in batch.column("path").to_pylist()], pa.int64())], names=["path", "part", "number", "ids"])


def _read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for path, at in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
            rows: list[tuple] = []
            for key, ids in Shard(path):
                rows.append((key_of(key), at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                at += len(ids)
                if len(rows) >= 10_000:
                    yield _digest(rows)
                    rows = []
            yield _digest(rows)


def _digest(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def offsets(manifest: DataFrame) -> DataFrame:
    """(path, start): how many ids lie in the shards before each, by the footers of the files.

    Sums run within groups of neighbouring parts, and over the groups.
    """
    ids = manifest.select("path", "part", "number").mapInArrow(_footers, "path string, part long, number long, ids long")
    ids = cut(ids.withColumn("group", F.expr(f"part div {PARTS}")))
    group = W.partitionBy(F.lit(0)).orderBy("group")
    sums = ids.groupBy("group").agg(F.sum("ids").alias("all"))  # a row for PARTS parts
    sums = sums.select(F.col("group").alias("g"), (F.sum("all").over(group) - F.col("all")).alias("before"))
    within = F.sum("ids").over(W.partitionBy("group").orderBy("part", "number")) - F.col("ids")
    return ids.withColumn("within", within).join(sums, F.col("group") == F.col("g")).select("path", (F.col("before") + F.col("within")).alias("start"))


def read_shards(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every entry, read from the files."""
    return offsets(manifest).repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism), "path").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")
