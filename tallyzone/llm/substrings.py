"""Removal of repeated word windows, found through fixed-block anchors.

A window is ``WINDOW`` consecutive words of one document; it repeats if its
word sequence also starts anywhere else, and every word that a repeated
window covers goes. With blocks of ``(WINDOW + 1) // 2`` words at multiples
of their own length, each window holds exactly one whole block of its
document, its anchor.

1. Every document's blocks are the index, and every rolling block-long
   window of the corpus probes it. Blocks that nothing else hits end here.
2. Around each hit, the windows that hold the block are extended to whole
   windows, which ask for an equal one; neighbouring repeated windows make
   up the maximal repeats.

Both questions go through the chunk table (see ``common``): a chunk sends
each distinct hash once, so copies and common passages cost a chunk one
entry, no pairs are formed, and the answer to an entry is one bit. Block
hashes are cut to 32 bits within a bucket (a false hit only costs a
question); whole windows are told apart by 64 bits.

Defined results: a null or empty text, and one without words, has none and
loses none; a text of any length is read whole; repeated rows are repeats of each other, each is reported; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyzone.llm.common import (answers, chunk_table, from_blob, mapped, pack_sorted, read_table, starts, stored,
                                  unpack_sorted, with_answers, word_hashes)

WINDOW = 35
BUCKET_WORDS = 4_000_000
BASE = 0x9E3779B97F4A7C15
REQUEST = "bucket int, chunk_id long, payload binary"


def rolling(values: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` values from each position on: differences of prefix sums of a polynomial modulo 2**64."""
    size = len(values)
    if size < n:
        return np.zeros(0, np.uint64)
    powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, BASE, np.uint64)]))
    back = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, pow(BASE, -1, 1 << 64), np.uint64)]))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * powers[:size], dtype=np.uint64)])
    x = (sums[n:] - sums[:-n]) * back[:size - n + 1]
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


class Chunk:
    """The words of a chunk's documents, hashed, with each word's place in its document."""

    def __init__(self, blob):
        self.batch = from_blob(blob)
        self.bodies = [t or b"" for t in self.batch.column("text").cast(pa.binary()).to_pylist()]
        self.values, self.counts = word_hashes(self.bodies)
        self.first = starts(self.counts)
        self.place = np.arange(len(self.values)) - np.repeat(self.first[:-1], self.counts)
        self.room = np.repeat(self.counts, self.counts) - self.place  # words from here to the document's end

    def hashes(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions at which ``n`` words of one document start, and their hashes."""
        at = np.flatnonzero(self.room >= n)
        return at, rolling(self.values, n)[at]


class Question:
    """Which of some keys occur twice: here, or in another chunk."""

    def __init__(self, keys: np.ndarray, asking: np.ndarray, buckets: int, bits: int):
        """``asking``: whose answer is wanted; the others only say that they are there."""
        self.keys, self.inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
        self.local = counts > 1
        wanted = np.zeros(len(self.keys), bool)
        wanted[self.inverse[asking]] = True
        self.bucket = (self.keys >> np.uint64(32)) % np.uint64(buckets)
        self.sent = self.keys & np.uint64((1 << bits) - 1)
        self.order = np.lexsort((self.sent, ~(wanted & ~self.local), self.bucket))
        self.asks = (wanted & ~self.local)[self.order]
        own = self.bucket[self.order]
        self.cuts = [*np.flatnonzero(np.diff(own, prepend=own[:1] + np.uint64(1))).tolist(), len(own)]
        self.kind = np.uint32 if bits <= 32 else np.uint64

    def requests(self) -> Iterator[tuple[int, bytes]]:
        for a, b in zip(self.cuts, self.cuts[1:]):
            own, asks = self.order[a:b], self.asks[a:b]
            n = int(asks.sum())
            first = pack_sorted(self.sent[own[:n]].astype(self.kind))
            yield int(self.bucket[own[0]]), struct.pack("<q", len(first)) + first + pack_sorted(
                self.sent[own[n:]].astype(self.kind))

    def repeated(self, replies: dict[int, bytes]) -> np.ndarray:
        """For each key given: does it repeat?"""
        found = self.local.copy()
        for a, b in zip(self.cuts, self.cuts[1:]):
            own = self.order[a:b]
            if (bits := replies.get(int(self.bucket[own[0]]))) is not None:
                n = int(self.asks[a:b].sum())
                found[own[:n]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)
        return found[self.inverse]


def answer(payloads: list[bytes]) -> list[bytes | None]:
    """A bit for each asking key of each payload: is it in another payload, too?"""
    asks, every = [], []
    for p in payloads:
        (n,) = struct.unpack_from("<q", p)
        asks.append(unpack_sorted(p[8:8 + n]))
        every += [asks[-1], unpack_sorted(p[8 + n:])]
    every = np.concatenate(every)
    every.sort()
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    del every
    out = []
    for keys in asks:
        if len(twice):
            hit = twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys
            out.append(np.packbits(hit).tobytes() if hit.any() else None)
        else:
            out.append(None)
    return out


def anchors(chunk: Chunk, block: int, buckets: int) -> tuple[np.ndarray, np.ndarray, Question]:
    """Positions that start a block-long window, which of them are index blocks, and the question."""
    at, keys = chunk.hashes(block)
    index = chunk.place[at] % block == 0
    return at, index, Question(keys, index, buckets, 32)


def windows(chunk: Chunk, hits: np.ndarray, window: int, block: int, buckets: int) -> tuple[np.ndarray, Question]:
    """Starts of the windows that hold a block at ``hits``, and the question."""
    near = np.zeros(len(chunk.values) + 1, np.int64)
    np.add.at(near, np.maximum(hits - (window - block), chunk.first[:-1][
        np.searchsorted(chunk.first, hits, side="right") - 1] if len(hits) else hits), 1)
    np.add.at(near, hits + 1, -1)
    able = np.cumsum(near)[:-1] > 0
    at = np.flatnonzero(able & (chunk.room >= window))
    keys = rolling(chunk.values, window)[at] if len(at) else np.zeros(0, np.uint64)
    return at, Question(keys, np.ones(len(at), bool), buckets, 64)


def deduplicated(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, n_words, spans, text): ``spans`` are the removed word ranges, ``text`` the kept words."""
    spark, block = docs.sparkSession, (window + 1) // 2
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    chunks = chunk_table(rows, ["id", "text"])
    size = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // 6 // BUCKET_WORDS)

    def request(chunk_id, question, base=0):
        sent = list(question.requests())
        return pa.record_batch({"bucket": pa.array([base + b for b, _ in sent], pa.int32()),
                                "chunk_id": pa.array([chunk_id] * len(sent), pa.int64()),
                                "payload": pa.array([p for _, p in sent], pa.binary())})

    def each(batches):
        for batch in batches:
            replies = batch.column("replies") if "replies" in batch.schema.names else None
            for i in range(batch.num_rows):
                said = replies[i].as_py() if replies is not None else None
                yield (batch.column("chunk_id")[i].as_py(), Chunk(batch.column("blob")[i].as_buffer()),
                       {r["bucket"]: r["payload"] for r in said or ()})

    def ask_anchors(batches):
        for chunk_id, chunk, _ in each(batches):
            yield request(chunk_id, anchors(chunk, block, buckets)[2])

    def hit_windows(chunk, replies):
        at, index, question = anchors(chunk, block, buckets)
        return windows(chunk, at[index & question.repeated(replies)], window, block, buckets)

    def ask_windows(batches):
        for chunk_id, chunk, replies in each(batches):
            yield request(chunk_id, hit_windows(chunk, replies)[1], buckets)

    def remove(batches):
        for _, chunk, replies in each(batches):
            at, question = hit_windows(chunk, {b: p for b, p in replies.items() if b < buckets})
            begin = at[question.repeated({b - buckets: p for b, p in replies.items() if b >= buckets})]
            marks = np.zeros(len(chunk.values) + 1, np.int64)
            marks[begin] += 1
            marks[begin + window] -= 1
            gone = np.cumsum(marks)[:-1] > 0
            spans, kept = [], []
            for body, a, b in zip(chunk.bodies, chunk.first[:-1].tolist(), chunk.first[1:].tolist()):
                own, words = gone[a:b], body.split()
                if own.any():
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], own, [0]]).astype(np.int8)))
                    spans.append([{"start": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2])])
                    words = compress(words, (~own).tolist())
                else:
                    spans.append([])
                kept.append(b" ".join(words))
            yield pa.record_batch({
                "id": chunk.batch.column("id"), "n_words": pa.array(chunk.counts, pa.int64()),
                "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                "text": pa.array(kept, pa.binary()).cast(pa.string())})

    found = stored(answers(mapped(chunks, ask_anchors, REQUEST), answer), "anchors")
    asked = mapped(with_answers(chunks, found), ask_windows, REQUEST)
    repeats = stored(answers(asked, answer), "repeats")
    return mapped(with_answers(chunks, found.unionByName(repeats)), remove,
                  f"id {kind}, n_words long, spans array<struct<start:long,end:long>>, text string")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated windows removed from every document."""
    found = deduplicated(read_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(F.col("id").alias("doc_id"), "n_words", removed.alias("n_removed"),
                        F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"), "spans")
