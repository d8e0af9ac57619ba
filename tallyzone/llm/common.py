"""Helpers shared by the training-data operators.

Chunks
------
Several operators make more than one pass over the texts and ask questions
about their words or windows that only the whole corpus can answer. They
work on a *chunk table*: one row per few MB of documents, the documents
packed as a compressed Arrow batch, written once under the shared folder.
A pass over it sends requests ``(bucket, chunk_id, payload)``, buckets by
hash of what is asked; a bucket is answered in one task and the answers go
back to their chunk by ``chunk_id``. Texts are shuffled at most once per
question, and a value that is in every row reaches its bucket once per
chunk, not once per row.
"""

from __future__ import annotations

import ctypes
import struct
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyzone.session import shared_dir

CHUNK_BYTES = 4_000_000
#: Texts that a task works on at a time, and bytes whose words are hashed at a time.
SLICE_BYTES, HASH_BYTES = 1_000_000, 1 << 18
CHUNK_SCHEMA = "chunk_id long, n_bytes long, blob binary"
ANSWER_SCHEMA = "chunk_id long, bucket int, payload binary"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, **options) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Let Python workers of a local session find this package wherever the session was started.

    On a cluster the package comes with ``--py-files`` or the image.
    """
    context, root = spark.sparkContext, str(Path(__file__).parents[2])
    if context.master.startswith("local") and root not in context.environment.get("PYTHONPATH", "").split(":"):
        context.environment["PYTHONPATH"] = ":".join(filter(None, [root, context.environment.get("PYTHONPATH")]))


def mapped(df: DataFrame, function, schema: str) -> DataFrame:
    """``df.mapInArrow`` with the package at hand; a worker hands its free memory back when a task ends."""
    def run(batches):
        yield from function(batches)
        tidy()

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def tidy() -> None:
    """Give what this process has freed back to the machine (where its C library can)."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def crc_remainder(column: str, modulus: int):
    """crc32 of the value as text, modulo ``modulus``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """A text column as a list; null becomes the empty text."""
    return [x or "" for x in batch.column(column).to_pylist()]


def utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def slices(batches: Iterable[pa.RecordBatch], column: str = "text",
           most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of ``column`` (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        group = np.cumsum(lengths.astype(np.int64)) // most
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def to_blob(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_blob(blob) -> pa.RecordBatch:
    return pa.ipc.open_stream(blob).read_next_batch()


def chunk_table(docs: DataFrame, columns: list[str], most: int = CHUNK_BYTES) -> DataFrame:
    """The chunk table of ``docs``, stored; ``text`` is one of ``columns``.

    Chunk ids are given before the write, so every later pass and every
    retry of a lost task sees the same chunks.
    """
    def packed(batches):
        for part in slices(batches, most=most):
            blob = to_blob(part)
            yield pa.record_batch({"n_bytes": pa.array([part.column("text").nbytes], pa.int64()),
                                   "blob": pa.array([blob], pa.binary())})

    rows = mapped(docs.select(*columns), packed, "n_bytes long, blob binary")
    rows = rows.select(F.monotonically_increasing_id().alias("chunk_id"), "n_bytes", "blob")
    return stored(rows, "chunks", compression="uncompressed")


def pack_array(x: np.ndarray) -> bytes:
    """An array as its byte planes, compressed."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()
    return struct.pack("<cq", x.dtype.char.encode(), len(x)) + (
        pa.compress(planes, "zstd", asbytes=True) if len(x) else b"")


def unpack_array(data: bytes) -> np.ndarray:
    char, n = struct.unpack_from("<cq", data)
    dtype = np.dtype(char.decode())
    if not n:
        return np.zeros(0, dtype)
    planes = pa.decompress(data[9:], n * dtype.itemsize, "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(dtype.itemsize, n).T).view(dtype).ravel()


def pack_sorted(x: np.ndarray) -> bytes:
    """A sorted array of unsigned numbers as its differences, compressed."""
    return pack_array(np.diff(x, prepend=x.dtype.type(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    x = unpack_array(data)
    return np.cumsum(x, dtype=x.dtype)


def answers(requests: DataFrame, answer: Callable[[list[bytes]], list[bytes | None]]) -> DataFrame:
    """Answer requests bucket by bucket.

    ``answer`` gets the payloads of a bucket and returns a payload for each,
    or None where there is nothing to say.
    """
    def bucket(table: pa.Table) -> pa.Table:
        replies = answer(table.column("payload").to_pylist())
        tidy()
        out = pa.table({"chunk_id": table.column("chunk_id"), "bucket": table.column("bucket"),
                        "payload": pa.array(replies, pa.binary())})
        return out.filter(pc.is_valid(out.column("payload")))

    ship(requests.sparkSession)
    return requests.groupBy("bucket").applyInArrow(bucket, ANSWER_SCHEMA)


def with_answers(chunks: DataFrame, replies: DataFrame) -> DataFrame:
    """Chunks with ``replies``: list of (bucket, payload), null where there are none.

    A merge join at every size: answers grow with the corpus, so they aren't
    broadcast where they happen to be few.
    """
    by_chunk = replies.groupBy("chunk_id").agg(F.collect_list(F.struct("bucket", "payload")).alias("replies"))
    return chunks.join(by_chunk.hint("merge"), "chunk_id", "left")


class Words(dict):
    """Index of each distinct word (bytes) met, computed columns kept in arrays.

    ``columns`` maps a list of new words to a tuple of arrays. The memory is
    bounded: beyond ``most`` words the table starts anew.
    """

    def __init__(self, columns: Callable[[list[bytes]], tuple[np.ndarray, ...]], most: int = 500_000):
        super().__init__()
        self.columns, self.most, self.fresh, self.arrays = columns, most, [], None

    def __missing__(self, word: bytes) -> int:
        self[word] = index = len(self)
        self.fresh.append(word)
        return index

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, ...]:
        """The columns' values for each of ``words``."""
        if len(self) > self.most:
            self.clear()
            self.fresh, self.arrays = [], None
        index = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.fresh or self.arrays is None:
            new = self.columns(self.fresh)
            self.fresh = []
            if self.arrays is None:
                self.arrays = [np.array(x) for x in new]
                self.used = len(self)
            else:
                grown = []
                for old, add in zip(self.arrays, new):
                    if self.used + len(add) > len(old):
                        room = np.zeros((max(len(self), 2 * len(old)), *old.shape[1:]), old.dtype)
                        room[: self.used] = old[: self.used]
                        old = room
                    old[self.used: self.used + len(add)] = add
                    grown.append(old)
                self.arrays, self.used = grown, len(self)
        return tuple(x[index] for x in self.arrays)


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_VALUES = np.random.default_rng(0x5EED).integers(1, 1 << 63, 256).astype(np.uint64)
_BASE = 0xD1342543DE82EF95


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))


_FORTH, _BACK = _powers(_BASE, 2 * HASH_BYTES), _powers(pow(_BASE, -1, 1 << 64), 2 * HASH_BYTES)


def _pieces(body: bytes) -> Iterator[bytes]:
    """A text cut at white space into about ``HASH_BYTES`` each; a longer word stays whole."""
    at = 0
    while len(body) - at > HASH_BYTES:
        cut = max(body.rfind(c, at, at + HASH_BYTES) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
        if cut < 0:
            after = [p for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r") if (p := body.find(c, at + HASH_BYTES)) >= 0]
            cut = min(after, default=len(body) - 1)
        yield body[at:cut + 1]
        at = cut + 1
    yield body[at:]


def word_hashes(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word ``[^\\x20\\x09-\\x0D]+`` of all texts in order, and how many words each has.

    A word's hash is the difference of two prefix sums over the bytes, so no
    word becomes an object of its own.
    """
    hashes, counts = [np.zeros(0, np.uint64)], np.zeros(len(bodies), np.int64)
    group, owners, size = [], [], 0

    def flush():
        joined = b" ".join([*group, b""])
        body = np.frombuffer(joined, np.uint8)
        edge = np.flatnonzero(np.diff(~_BLANK[body], prepend=False))
        begin, end = edge[::2], edge[1::2]
        forth, back = (_FORTH, _BACK) if len(body) <= len(_FORTH) else (
            _powers(_BASE, len(body)), _powers(pow(_BASE, -1, 1 << 64), len(body)))
        sums = np.zeros(len(body) + 1, np.uint64)
        np.cumsum(_VALUES[body] * forth[:len(body)], out=sums[1:])
        x = (sums[end] - sums[begin]) * back[begin]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        hashes.append(x ^ x >> np.uint64(29))
        first = np.concatenate([[0], np.cumsum([len(g) + 1 for g in group])])
        np.add.at(counts, owners, np.diff(np.searchsorted(begin, first)))

    for i, whole in enumerate(bodies):
        for body in _pieces(whole):
            if group and size + len(body) > HASH_BYTES:
                flush()
                group, owners, size = [], [], 0
            group.append(body)
            owners.append(i)
            size += len(body) + 1
    if group:
        flush()
    return np.concatenate(hashes), counts


def split_all(batch_texts: list[str]) -> tuple[list[bytes], np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of all texts in one list, and how many each text has."""
    lists = [utf8(t).split() for t in batch_texts]
    flat = [w for words in lists for w in words]
    return flat, np.fromiter(map(len, lists), np.int64, len(lists))


def starts(counts: np.ndarray) -> np.ndarray:
    """Exclusive prefix sums with the total at the end."""
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
