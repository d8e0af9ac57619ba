"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash of the last eight bytes triggers a piece boundary where its
low ``k`` bits are zero; ``k`` is the least for which a text has at most 64
pieces. Each piece gives one character, and the signature at ``k``, ``k+1``
and ``k+2`` makes the fingerprint ``k:sig:sig:sig``. Boundaries depend on
nearby bytes alone, so an edit changes the characters around it and no
others. Fingerprints are compared at the finest block size both have, by
edit distance: ``1 - distance / longer length``; block sizes further apart
are not comparable and give 0.

Defined results: a null text is the empty text, whose signatures are empty
and equal each other only; equal texts have equal fingerprints; rows with
equal ids follow each other by hash of their text; a null id comes last; an
only document is followed by itself; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyzone.llm.common import mapped, read_table, slices, stored, texts, utf8

LEAST, LEVELS, MOST = 2, 3, 64
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
BASE = 0x9E3779B97F4A7C15
POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(POWERS["up"]) < n:
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            POWERS[name] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, base, np.uint64)]))
    return POWERS["up"][:n], POWERS["down"][:n]


def triggers(data: np.ndarray) -> np.ndarray:
    """Rolling hash of the eight bytes up to each position (zeros before the text)."""
    x = np.concatenate([np.zeros(7, np.uint32), data.astype(np.uint32) + 1])
    for n, factor in ((1, 0x01000193), (2, 0x85EBCA6B), (4, 0xC2B2AE35)):
        x = x[:-n] * np.uint32(factor) + x[n:]
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x2C1B3C6D)
    return x ^ x >> np.uint32(13)


def fingerprint(text: str) -> str:
    data = np.frombuffer(utf8(text), np.uint8)
    if not len(data):
        return f"{LEAST}:::"
    up, down = powers(len(data) + 1)
    x = triggers(data)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(data * up[1:], dtype=np.uint64)])
    at = np.flatnonzero(x & np.uint32((1 << LEAST) - 1) == 0)
    low = x[at]
    level = np.where(low == 0, 32, np.log2((low & -low.astype(np.int64)).clip(1)).astype(np.int64))
    k = LEAST
    while (level >= k).sum() >= MOST:
        k += 1
    out = [str(k)]
    for j in range(k, k + LEVELS):
        ends = at[level >= j] + 1
        if not len(ends) or ends[-1] != len(data):
            ends = np.append(ends, len(data))
        begins = np.concatenate([[0], ends[:-1]])
        piece = (sums[ends] - sums[begins]) * down[begins]
        piece = (piece ^ piece >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        out.append(ALPHABET[(piece >> np.uint64(58)).astype(np.int64)].tobytes().decode())
    return ":".join(out)


def edit_distances(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Edit distances of pairs, at most 64 characters each: bit-parallel over ``a``, all pairs of the list at once."""
    n = len(a)
    la, lb = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    if not n or not lb.max():
        return la
    left = np.frombuffer(b"".join(x.ljust(64, b"\x00") for x in a), np.uint8).reshape(n, 64)
    right = np.frombuffer(b"".join(x.ljust(64, b"\x01") for x in b), np.uint8).reshape(n, 64)
    one = np.uint64(1)
    high = one << np.maximum(la - 1, 0).astype(np.uint64)
    plus, minus, score = np.full(n, ~np.uint64(0)), np.zeros(n, np.uint64), la.copy()
    for j in range(int(lb.max())):
        same = np.packbits(left == right[:, j:j + 1], axis=1, bitorder="little").view(np.uint64).ravel()
        vertical = same | minus
        across = (((same & plus) + plus) ^ plus) | same
        up, down = minus | ~(across | plus), plus & across
        live = j < lb
        score += live * ((up & high) != 0)
        score -= live * ((down & high) != 0)
        up, down = up << one | one, down << one
        plus, minus = down | ~(vertical | up), up & vertical
    return np.where(la == 0, lb, score)


def likeness(pairs: list[tuple[str, str]]) -> np.ndarray:
    """Likeness of pairs of fingerprints, 0 to 1."""
    left, right, comparable = [], [], []
    for x, y in pairs:
        a, b = x.split(":"), y.split(":")
        k = max(int(a[0]), int(b[0]))
        fits = k - min(int(a[0]), int(b[0])) < LEVELS
        comparable.append(fits)
        left.append(a[1 + k - int(a[0])].encode() if fits else b"")
        right.append(b[1 + k - int(b[0])].encode() if fits else b"")
    longest = np.array([max(len(x), len(y)) for x, y in zip(left, right)], np.int64)
    distance = edit_distances(left, right)
    return np.where(comparable, 1 - distance / np.maximum(longest, 1), 0.0)


def edited(text: str, after: str) -> str:
    """``text`` with its last half replaced by as much of the start of ``after`` as there is."""
    half = len(text) // 2
    return text[:len(text) - half] + after[:half]


ROW = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
       "near_edited double, near_next double")
FIELDS = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
          ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()),
          ("near_next", pa.float64())]


def compared(rows: list[tuple]) -> dict[str, pa.Array]:
    """Result columns of (doc_id, text, fingerprint, next text, next fingerprint) rows."""
    bodies = [edited(text, after) for _, text, _, after, _ in rows]
    prints = [fingerprint(t) for t in bodies]
    near = likeness([(r[2], p) for r, p in zip(rows, prints)])
    following = likeness([(r[2], r[4]) for r in rows])
    values = ([r[0] for r in rows], [len(r[1]) for r in rows], [hashlib.sha256(utf8(t)).hexdigest() for t in bodies],
              [r[2] for r in rows], prints, near, following)
    return {name: pa.array(v, kind) for (name, kind), v in zip(FIELDS, values)}


def dealt(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) in ranges of descending id.

    The rows of one id, or without one, are dealt by their texts' hash, and
    equal rows by their place, so no id makes a range of its own.
    """
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"),
                       F.monotonically_increasing_id().alias("row"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), F.col("row")]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("row")


def neighbours(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and its edited text, by descending id.

    The texts are shuffled once, by ranges of the id. A task compares the
    neighbours of its range as they pass; only its first and last text meet
    the next range's, in a second step over two texts of each range.
    """
    ranges = dealt(docs, id, text)
    blank = {name: kind for name, kind in FIELDS}

    def edge(kind, part, doc, body):
        return pa.record_batch({"kind": pa.array([kind], pa.string()), "part": pa.array([part], pa.int32()),
                                "text": pa.array([body], pa.string()),
                                **{n: pa.array([doc if n == "doc_id" else None], t) for n, t in blank.items()}})

    def run(batches):
        part, before = TaskContext.get().partitionId(), None
        for batch in slices(batches):
            ids, bodies = batch.column("doc_id").to_pylist(), texts(batch)
            own = [(d, t, fingerprint(t)) for d, t in zip(ids, bodies)]
            if before is None:
                yield edge("first", part, ids[0], bodies[0])
            else:
                own.insert(0, before)
            before = own[-1]
            done = compared([(*a, *b[1:]) for a, b in zip(own, own[1:])])
            n = len(own) - 1
            yield pa.record_batch({"kind": pa.array([None] * n, pa.string()), "part": pa.array([part] * n, pa.int32()),
                                   "text": pa.array([None] * n, pa.string()), **done})
        if before is not None:
            yield edge("last", part, before[0], before[1])

    found = stored(mapped(ranges, run, f"kind string, part int, text string, {ROW}"), "fingerprints")
    first = found.where("kind = 'first'").select(F.col("part").alias("next"), F.col("text").alias("after"))
    following = Window.orderBy("next")  # a row for each range, no texts
    turn = first.select("next", F.lag("next").over(following).alias("part"),
                        F.max("next").over(Window.partitionBy()).alias("end"))
    turn = turn.select("next", F.coalesce("part", "end").alias("part"))
    last = (found.where("kind = 'last'").select("part", "doc_id", "text").join(turn, "part").join(first, "next")
            .select("doc_id", "text", "after"))

    def ends(batches):
        for batch in batches:
            if batch.num_rows:
                after = texts(batch, "after")
                yield pa.record_batch(compared([(d, t, fingerprint(t), a, fingerprint(a)) for d, t, a in zip(
                    batch.column("doc_id").to_pylist(), texts(batch), after)]))

    names = [name for name, _ in FIELDS]
    return found.where(F.col("kind").isNull()).select(*names).unionByName(mapped(last, ends, ROW))


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and likenesses of every document."""
    return neighbours(read_table(spark, sf_dir, "documents"))
