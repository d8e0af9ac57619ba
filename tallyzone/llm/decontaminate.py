"""Benchmark decontamination by latent semantic retrieval.

1. The texts' normalised words are hashed once and written as a compact
   table; a pass over it counts in how many passages (``PASSAGE`` words)
   each benchmark term occurs, over all documents.
2. A randomised SVD of the TF-IDF passages over the benchmark's terms: a
   Gaussian test matrix, the range ``A^T A G`` summed over all partitions,
   and an orthonormal basis of it. The benchmark's own passages are stacked
   below the corpus with a weight that keeps each of them in the range, so
   an item that the corpus holds once is not lost among frequent terms.
3. Windows of every document, of about each item's length (a sixteenth under
   it to a fifth over it) and at steps of an eighth of it, are embedded by
   running sums at the steps; a
   window is a candidate of an item at a cosine of ``COSINE``, relative to
   that of the item's own text (the latent space keeps a part of it). A
   window's norm counts its benchmark terms only, so foreign words, however
   rare, don't hide a paraphrase. Only windows without any benchmark term are
   left out before the product.
   Beside them, whatever the weights of its terms, an item is a candidate
   where any ``SHINGLE`` words in a row of it are found (all of them if it
   is shorter).
4. Places whose surroundings lack too many of the item's words for the
   subsequence below are left out; that bound loses nothing. The others'
   surroundings are compared with the item by longest common
   subsequence of words, and so is the item's answer (its last sentence, or
   its last quarter); both must hold.

The benchmark is a stated query set, met in blocks of about ``ITEMS`` items
and ``ITEM_BYTES`` of text: what the driver holds and sends is bounded by a
block (its terms x ``RANK``), at any size of the benchmark.

Defined results: a null or empty text, or one without words, has no hit; an
item without words matches nothing; repeated documents are each reported, a
benchmark row that repeats counts once, and items of the same text are each
reported; a document that holds an item several times has one row for it,
with the best figures of its places; a very long text is read in overlapping
segments; an empty corpus or benchmark gives no hits; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tallyzone.llm.common import (
    _BACK, _BASE, _FORTH, HASH_BYTES, _pieces, _powers, mapped, read_table, slices, starts, stored, texts, utf8)

PASSAGE, RANK, BUCKETS, SHINGLE = 64, 64, 1 << 18, 4
COSINE, LCS, ANSWER = 0.6, 0.7, 0.6
#: Items and bytes of item texts that a pass over the corpus asks for.
ITEMS, ITEM_BYTES = 4096, 4_000_000
#: Words that are searched at a time.
SEGMENT = 1 << 14
WORD = regex.compile(r"[\p{L}\p{N}]+")


@cache
def code_values() -> np.ndarray:
    """A number for each code point: 1 for white space, an own one for a letter or digit, 0 for the rest."""
    every = "".join(map(chr, range(0x110000)))
    kept = np.frombuffer("".join(WORD.findall(every)).encode("utf-32-le"), np.uint32)
    out = np.zeros(0x110000, np.uint64)
    out[kept] = np.random.default_rng(0xC0DE).integers(2, 1 << 63, len(kept)).astype(np.uint64)
    out[[9, 10, 11, 12, 13, 32]] = 1
    return out


def plain_hashes(rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word by its lower-cased letters and digits, in order, and how many each text has.

    Words without any are left out. A hash is the difference of two prefix
    sums over the code points that count, so no word becomes an object.
    """
    values = code_values()
    hashes, counts = [np.zeros(0, np.uint32)], np.zeros(len(rows), np.int64)
    group, owners, size = [], [], 0

    def flush():
        joined = "".join(f"{g}\n" for g in group)
        v = values[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
        present = np.flatnonzero(v)
        first = np.searchsorted(present, np.concatenate([[0], np.cumsum([len(g) + 1 for g in group])]))
        v = v[present]
        edge = np.flatnonzero(np.diff(v != 1, prepend=False))
        begin, end = edge[::2], edge[1::2]
        forth, back = (_FORTH, _BACK) if len(v) <= len(_FORTH) else (
            _powers(_BASE, len(v)), _powers(pow(_BASE, -1, 1 << 64), len(v)))
        sums = np.zeros(len(v) + 1, np.uint64)
        np.cumsum(v * forth[:len(v)], out=sums[1:])
        x = (sums[end] - sums[begin]) * back[begin]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        hashes.append(np.maximum(x >> np.uint64(32), np.uint64(1)).astype(np.uint32))
        np.add.at(counts, owners, np.diff(np.searchsorted(begin, first)))

    for i, whole in enumerate(rows):
        pieces = [whole] if len(whole) <= HASH_BYTES else (
            p.decode("utf-8", "surrogatepass") for p in _pieces(utf8(whole)))
        for piece in pieces:
            if group and size + len(piece) > HASH_BYTES:
                flush()
                group, owners, size = [], [], 0
            group.append(piece.lower())
            owners.append(i)
            size += len(piece) + 1
    if group:
        flush()
    return np.concatenate(hashes), counts


def hash_words(new: list[bytes]) -> tuple[np.ndarray]:
    """Hash of each word without case and punctuation; zero for what has no letter or digit."""
    hashes, counts = plain_hashes([w.decode("utf-8", "replace") for w in new])
    out = np.zeros(len(new), np.uint32)
    out[counts > 0] = hashes
    return (out,)


def word_table(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, words): hashes of a document's words (stored)."""
    def run(batches):
        for batch in slices(batches):
            hashed, counts = plain_hashes(texts(batch))
            yield pa.record_batch({"id": batch.column("id"), "words": pa.ListArray.from_arrays(
                pa.array(starts(counts).astype(np.int32)), pa.array(hashed.view(np.int32)))})

    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return stored(mapped(rows, run, f"id {kind}, words array<int>"), "words", compression="zstd")


def lists_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All words of a batch of ``word_table`` and the documents' offsets."""
    column = batch.column("words")
    at = column.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.values.to_numpy(zero_copy_only=False).view(np.uint32)
    return flat[at[0]:at[-1]], at - at[0]


def passages_of(at: np.ndarray, passage: int) -> tuple[np.ndarray, int]:
    """Passage number of every word, documents cut apart; and how many there are."""
    counts = np.diff(at)
    per = -(-counts // passage)
    first = np.repeat(starts(per)[:-1], counts)
    inside = np.arange(at[-1]) - np.repeat(at[:-1], counts)
    return first + inside // passage, int(per.sum())


def document_counts(words: DataFrame, terms: np.ndarray, passage: int) -> tuple[np.ndarray, int]:
    """In how many passages each of ``terms`` is, over all documents; and the passages."""
    shared = words.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        terms = shared.value
        counts, total = np.zeros(len(terms), np.int64), 0
        for batch in batches:
            flat, at = lists_of(batch)
            of, n = passages_of(at, passage)
            hit, term = find_terms(terms, flat)
            key = np.sort(of[hit] * len(terms) + term)
            counts += np.bincount(key[np.diff(key, prepend=-1) != 0] % len(terms), minlength=len(terms))
            total += n
        at = np.flatnonzero(counts)
        yield pa.record_batch({"term": at.astype(np.int64), "n": counts[at]})
        yield pa.record_batch({"term": pa.array([-1], pa.int64()), "n": pa.array([total], pa.int64())})

    rows = mapped(words, run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    at, n = rows.column("term").to_numpy(), rows.column("n").to_numpy()
    counts = np.zeros(len(terms), np.int64)
    counts[at[at >= 0]] = n[at >= 0]
    return counts, int(n[at < 0].sum())


@dataclass
class Benchmark:
    ids: list
    words: list[np.ndarray]
    answers: list[np.ndarray]
    terms: np.ndarray | None  # sorted distinct hashes

    @classmethod
    def read(cls, rows: list[tuple]) -> "Benchmark":
        ids, words, answers = [], [], []
        for item, text in rows:
            text = text or ""
            own = plain_hashes([text])[0]
            if not len(own):
                continue
            last = [s for s in regex.split(r"(?<=[.!?])\s+", text.strip()) if WORD.search(s)][-1]
            tail = plain_hashes([last])[0]
            quarter = max(1, len(own) // 4)
            ids.append(item)
            words.append(own)
            answers.append(tail if 3 <= len(tail) <= len(own) // 2 else own[-quarter:])
        terms = np.unique(np.concatenate(words)) if words else np.zeros(0, np.uint32)
        return cls(ids, words, answers, terms)


def find_terms(terms: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``flat`` of words that are benchmark terms, and their numbers."""
    able = np.zeros(BUCKETS, bool)
    able[terms & (BUCKETS - 1)] = True
    maybe = np.flatnonzero(able[flat & (BUCKETS - 1)])
    if not len(terms):
        return maybe, maybe
    at = np.minimum(np.searchsorted(terms, flat[maybe]), len(terms) - 1)
    hit = terms[at] == flat[maybe]
    return maybe[hit], at[hit]


def rolling(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each position on, as far as there are ``n``."""
    count = max(0, len(words) - n + 1)
    out = np.zeros(count, np.uint64)
    for k in range(n):
        out = (out ^ words[k:k + count]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def shingles_of(items: list[np.ndarray]) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(n, sorted hashes, items, offsets) of all runs of ``n`` words: ``SHINGLE``, or the whole of a shorter item."""
    out = []
    sizes = np.array([min(SHINGLE, len(w)) for w in items])
    for n in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == n)
        hashes = [rolling(items[i], n) for i in own.tolist()]
        counts = np.array([len(h) for h in hashes])
        keys = np.concatenate(hashes)
        order = np.argsort(keys, kind="stable")
        offset = np.arange(len(keys)) - np.repeat(starts(counts)[:-1], counts)
        out.append((n, keys[order], np.repeat(own, counts)[order], offset[order]))
    return out


def shingle_places(shingles, lengths: np.ndarray, flat: np.ndarray, at: np.ndarray):
    """Distinct (document, item, begin, end) where an item would lie by a run of words that it shares."""
    found = [np.zeros((0, 3), np.int64)]
    for n, keys, owner, offset in shingles:
        own = rolling(flat, n)
        able = np.zeros(BUCKETS, bool)
        able[keys & np.uint64(BUCKETS - 1)] = True
        maybe = np.flatnonzero(able[own & np.uint64(BUCKETS - 1)])
        first = np.searchsorted(keys, own[maybe], "left")
        times = np.searchsorted(keys, own[maybe], "right") - first
        k = np.arange(times.sum()) + np.repeat(first - starts(times)[:-1], times)
        where = np.repeat(maybe, times)
        doc = np.searchsorted(at, where, "right") - 1
        found.append(np.column_stack([doc, owner[k], np.maximum(at[doc], where - offset[k])]))
    doc, item, begin = np.unique(np.concatenate(found), axis=0).T
    return doc, item, begin, np.minimum(at[doc + 1], begin + lengths[item])


def range_rows(weights: np.ndarray, test: np.ndarray, term: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(terms, rows) of ``A^T A G`` for a few passages; ``term`` and ``of`` give each word's term and passage (in order).

    A dense product over the terms that these passages have.
    """
    seen = np.zeros(len(weights), bool)
    seen[term] = True
    own = np.flatnonzero(seen)
    column = np.zeros(len(weights), np.int64)
    column[own] = np.arange(len(own))
    row = of - of[0]
    a = np.bincount(row * len(own) + column[term], minlength=(int(row[-1]) + 1) * len(own))
    a = a.reshape(-1, len(own)).astype(np.float32) * weights[own]
    return own, a.T @ (a @ test[own])


def stacked_rows(items: list[np.ndarray], terms: np.ndarray, weights: np.ndarray, test: np.ndarray) -> np.ndarray:
    """``B^T B G`` of the benchmark's own weighted unit rows, item by item: of the size of ``test``."""
    out = np.zeros(test.shape)
    for w in items:
        at, n = np.unique(np.searchsorted(terms, w), return_counts=True)
        row = n * weights[at].astype(np.float64)
        row /= max(np.linalg.norm(row), 1e-9)
        out[at] += np.outer(row, row @ test[at])
    return out


def latent_basis(words: DataFrame, bench: Benchmark, weights: np.ndarray, passage: int, rank: int,
                 seed: int = 3) -> np.ndarray:
    """Orthonormal basis (terms x rank) of the leading right space of the TF-IDF passages."""
    spark = words.sparkSession
    m = len(bench.terms)
    test = np.random.default_rng(seed).normal(size=(m, min(rank, m))).astype(np.float32)
    shared = spark.sparkContext.broadcast((bench.terms, weights, test))

    def run(batches):
        terms, own, g = shared.value
        total = np.zeros(g.shape, np.float64)
        for batch in batches:
            flat, at = lists_of(batch)
            of, n = passages_of(at, passage)
            edges = np.append(np.searchsorted(of, np.arange(0, n, 256)), len(flat))
            for a, b in zip(edges, edges[1:]):
                hit, term = find_terms(terms, flat[a:b])
                if len(hit):
                    rows, part = range_rows(own, g, term, of[a:b][hit])
                    total[rows] += part
        rows = np.flatnonzero(np.abs(total).sum(axis=1))
        yield pa.record_batch({"term": rows, "row": pa.FixedSizeListArray.from_arrays(
            pa.array(total[rows].ravel()), g.shape[1]).cast(pa.list_(pa.float64()))})

    sums = [F.sum(F.col("row")[i]).alias(f"c{i}") for i in range(test.shape[1])]
    found = mapped(words, run, "term long, row array<double>").groupBy("term").agg(*sums).toArrow()
    corpus = np.zeros(test.shape)
    if found.num_rows:
        corpus[found.column("term").to_numpy()] = np.column_stack(
            [found.column(f"c{i}").to_numpy() for i in range(test.shape[1])])
    stacked = stacked_rows(bench.words, bench.terms, weights, test)
    scale = np.linalg.norm(corpus) / max(np.linalg.norm(stacked), 1e-9)
    return np.linalg.qr(corpus + max(1.0, scale) * stacked)[0].astype(np.float32)


def merged(doc: np.ndarray, item: np.ndarray, begin: np.ndarray, end: np.ndarray, cos: np.ndarray):
    """Windows of one document and item that touch, as one place: (doc, item, begin, end, greatest cosine)."""
    order = np.lexsort((begin, item, doc))
    doc, item, begin, end, cos = (x[order] for x in (doc, item, begin, end, cos))
    if not len(order):
        return doc, item, begin, end, cos
    group = np.cumsum((np.diff(doc, prepend=-1) != 0) | (np.diff(item, prepend=-1) != 0))
    most = int(end.max()) + 1
    reach = np.maximum.accumulate(group * most + end) - group * most
    first = np.flatnonzero((np.diff(group, prepend=0) != 0) | (begin > np.append(0, reach[:-1])))
    return doc[first], item[first], begin[first], np.maximum.reduceat(end, first), np.maximum.reduceat(cos, first)


def item_terms(items: list[np.ndarray], terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted item * terms + term of the items' distinct terms, and how often each is in its item."""
    keys = [i * len(terms) + np.searchsorted(terms, w) for i, w in enumerate(items)]
    return np.unique(np.concatenate(keys), return_counts=True)


def words_shared(has: tuple[np.ndarray, np.ndarray], n_terms: int, item: np.ndarray, first: np.ndarray,
                 last: np.ndarray, term: np.ndarray) -> np.ndarray:
    """The item's words that are among ``term[first:last]``, for each place: no common subsequence is longer."""
    keys, times = has
    out = np.zeros(len(item), np.int64)
    for i in range(0, len(item), 1024):
        a, size = first[i:i + 1024], (last - first)[i:i + 1024]
        place = np.repeat(np.arange(len(a)), size)
        wanted = item[i:i + 1024][place] * n_terms + term[np.arange(len(place)) + np.repeat(a - starts(size)[:-1], size)]
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        hit = keys[at] == wanted
        both = np.unique(place[hit] * len(keys) + at[hit])
        out[i:i + 1024] = np.bincount(both // len(keys), weights=times[both % len(keys)], minlength=len(a))
    return out


def lcs(item: np.ndarray, words: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel over the item's words."""
    masks: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        masks[w] = masks.get(w, 0) | 1 << i
    row = (1 << len(item)) - 1
    full = row
    for w in words.tolist():
        if match := masks.get(w):
            both = row & match
            row = ((row + both) | (row - both)) & full
    return len(item) - row.bit_count()


def running_sums(x: np.ndarray, width: int = 16) -> np.ndarray:
    """Sums of the rows before each place, in double precision; blocks of rows, so that whole rows are added at a time."""
    n, d = x.shape
    out = np.zeros((1 + -(-n // width) * width, d))
    out[1:n + 1] = x
    blocks = out[1:].reshape(-1, width, d)
    for k in range(1, width):
        blocks[:, k] += blocks[:, k - 1]
    if len(blocks) > 1:
        blocks += running_sums(blocks[:, -1])[:-1, None]
    return out[:n + 1]


@dataclass
class Search:
    """What a task needs to find the places that may hold an item."""
    bench: Benchmark
    weights: np.ndarray
    own: np.ndarray  # each term's weighted place in the latent space
    items: np.ndarray  # in the latent space, so scaled that an item's own text has the cosine 1
    grids: list  # (step, items, [(steps of a window, first and last of these items)])
    shingles: list
    has: tuple
    cosine: float
    least_lcs: float

    @classmethod
    def of(cls, bench: Benchmark, weights: np.ndarray, basis: np.ndarray, cosine: float = COSINE,
           least_lcs: float = LCS) -> "Search":
        own = basis * weights[:, None]
        items = np.zeros((len(bench.words), basis.shape[1]), np.float32)
        whole = np.zeros(len(bench.words))
        for i, w in enumerate(bench.words):
            _, term = find_terms(bench.terms, w)
            items[i] = own[term].sum(axis=0)
            whole[i] = np.sqrt((weights[term] ** 2).sum())
        length = np.linalg.norm(items, axis=1)
        # Scaled by the part of the item that the latent space keeps.
        items *= (whole / np.maximum(length, 1e-9) ** 2)[:, None].astype(np.float32)
        # Windows of a few lengths, each for the items up to it, in whole steps.
        lengths = np.maximum([len(w) for w in bench.words], 4)
        size = np.ceil(2 ** (np.ceil(np.log2(lengths) * 6 - 1e-9) / 6) - 1e-9)
        step = np.maximum(1, size // 8).astype(int)
        steps = np.floor(size / step + 0.5).astype(int)
        grids = []
        for s in np.unique(step).tolist():
            ids = np.flatnonzero(step == s)
            ids = ids[np.argsort(steps[ids], kind="stable")]
            for i in range(0, len(ids), 256):
                part = ids[i:i + 256]
                q, first = np.unique(steps[part], return_index=True)
                grids.append((s, part, list(zip(q.tolist(), first.tolist(), [*first[1:].tolist(), len(part)]))))
        return cls(bench, weights, own, items, grids, shingles_of(bench.words), item_terms(bench.words, bench.terms),
                   cosine, least_lcs)

    def candidates(self, flat: np.ndarray, at: np.ndarray):
        """(document, item, begin, end, cosine) of the places that may hold an item."""
        terms, items = self.bench.terms, self.items
        hit, term = find_terms(terms, flat)
        square = np.zeros(len(flat), np.float32)
        square[hit] = self.weights[term] ** 2
        mass = starts_float(square)
        before = starts(np.bincount(hit, minlength=len(flat)))
        running = running_sums(np.take(self.own, term, axis=0)).astype(np.float32)
        counts = np.diff(at)
        n_words = np.array([len(w) for w in self.bench.words])
        doc, item, begin, end = shingle_places(self.shingles, n_words, flat, at)
        cos = ((running[before[end]] - running[before[begin]]) * items[item]).sum(axis=1)
        cos /= np.sqrt(np.maximum(mass[end] - mass[begin], 1e-9))
        found = [(doc, item, begin, end, cos)]
        for step, ids, parts in self.grids:
            # A document's grid goes on beyond its end where it has fewer steps than a window.
            per = np.where(counts > 0, np.maximum(-(-counts // step), parts[-1][0]) + 1, 0)
            doc = np.repeat(np.arange(len(counts)), per)
            place = np.minimum(at[doc] + (np.arange(len(doc)) - np.repeat(starts(per)[:-1], per)) * step, at[doc + 1])
            weighed, hits = mass[place], before[place]
            sums = items[ids] @ np.take(running, hits, axis=0).T
            for q, a, b in parts:
                norm = np.sqrt(np.maximum(weighed[q:] - weighed[:-q], 1e-9)).astype(np.float32)
                able = (doc[q:] == doc[:-q]) & (hits[q:] > hits[:-q])
                dot = sums[a:b, q:] - sums[a:b, :-q]
                j, w = np.divmod(np.flatnonzero(dot >= np.where(able, np.float32(self.cosine) * norm, np.inf)), len(norm))
                found.append((doc[w], ids[a + j], place[w], place[w + q], dot[j, w] / norm[w]))
        doc, item, begin, end, cos = merged(*(np.concatenate(x) for x in zip(*found)))
        begin = np.maximum(at[doc], begin - n_words[item] // 2)
        end = np.minimum(at[doc + 1], end + n_words[item] // 2)
        both = words_shared(self.has, len(terms), item, before[begin], before[end], term)
        able = both >= self.least_lcs * n_words[item] - 1e-9
        return zip(*(x[able].tolist() for x in (doc, item, begin, end, cos)))


def segments(flat: np.ndarray, at: np.ndarray, overlap: int, most: int = SEGMENT):
    """(rows, words, offsets): the documents, about ``most`` words at a time.

    A longer document is cut into segments that share ``overlap`` words, so
    that each place up to that length lies whole in one of them.
    """
    rows, parts, size = [], [], 0
    most = max(most, 2 * overlap)
    for row, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
        while a < b:
            part = flat[a:min(b, a + most)]
            if size and size + len(part) > most:
                yield rows, np.concatenate(parts), starts(np.array([len(p) for p in parts]))
                rows, parts, size = [], [], 0
            rows.append(row)
            parts.append(part)
            size += len(part)
            a = b if a + most >= b else a + most - overlap
    if rows:
        yield rows, np.concatenate(parts), starts(np.array([len(p) for p in parts]))


def benchmark_blocks(benchmark: DataFrame, items: int = ITEMS, size: int = ITEM_BYTES) -> Iterator[list[tuple]]:
    """The distinct (item_id, text) of the benchmark in blocks of about ``items`` rows and ``size`` bytes, by hash."""
    rows = benchmark.select("item_id", "text").distinct()
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // items), -(-total // size))
    place = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for k in range(blocks):
        yield [tuple(r) for r in rows.where(place == k).orderBy("item_id", "text").collect()]


def contaminated(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text",
                 cosine: float = COSINE, least_lcs: float = LCS, least_answer: float = ANSWER,
                 items: int = ITEMS) -> DataFrame:
    """(id, item_id, cosine, lcs, answer): a row for each document and item found in it.

    The benchmark is the stated query set, met in blocks of about ``items``.
    """
    kind, item_kind = docs.schema[id].dataType, benchmark.schema["item_id"].dataType
    schema = (f"id {kind.simpleString()}, item_id {item_kind.simpleString()}, "
              "cosine double, lcs double, answer double")
    words, found = None, []
    for rows in benchmark_blocks(benchmark, items):
        bench = Benchmark.read(rows)
        if not bench.ids:
            continue
        if words is None:
            words = word_table(docs, id, text)
        found.append(found_in(words, bench, to_arrow_type(item_kind), schema, cosine, least_lcs, least_answer))
    return reduce(DataFrame.unionAll, found) if found else docs.sparkSession.createDataFrame([], schema)


def found_in(words: DataFrame, bench: Benchmark, item_type: pa.DataType, schema: str, cosine: float,
             least_lcs: float, least_answer: float) -> DataFrame:
    """The rows of ``contaminated`` for a block of the benchmark."""
    counts, passages = document_counts(words, bench.terms, PASSAGE)
    # Every term has a weight, also one of all passages.
    weights = np.log1p(max(passages, 1) / np.maximum(counts, 1)).astype(np.float32)
    basis = latent_basis(words, bench, weights, PASSAGE, RANK)
    shared = words.sparkSession.sparkContext.broadcast(Search.of(bench, weights, basis, cosine, least_lcs))

    def run(batches):
        search = shared.value
        bench = search.bench
        overlap = 4 * max(len(w) for w in bench.words)
        for batch in batches:
            best: dict[tuple[int, int], tuple] = {}
            for rows, flat, at in segments(*lists_of(batch), overlap):
                for doc, item, a, b, cos in search.candidates(flat, at):
                    was = best.get((rows[doc], item), (0.0, (0.0, 0.0)))
                    most = was[1] if was[1] == (1.0, 1.0) else max(was[1], ratios(bench, item, flat[a:b]))
                    best[rows[doc], item] = max(was[0], cos), most
            out = [(row, item, min(1.0, cos), *most) for (row, item), (cos, most) in best.items()
                   if most[0] >= least_lcs and most[1] >= least_answer]
            if out:
                row, item, cos, lcs_part, answer = zip(*out)
                yield pa.record_batch({
                    "id": batch.column("id").take(pa.array(row)),
                    "item_id": pa.array([bench.ids[i] for i in item], item_type),
                    "cosine": pa.array(cos, pa.float64()), "lcs": pa.array(lcs_part, pa.float64()),
                    "answer": pa.array(answer, pa.float64())})

    return mapped(words, run, schema)


def starts_float(x: np.ndarray) -> np.ndarray:
    return np.concatenate([[0.0], np.cumsum(x, dtype=np.float64)])


def ratios(bench: Benchmark, item: int, words: np.ndarray) -> tuple[float, float]:
    """Parts of the item and of its answer that ``words`` have as a subsequence."""
    own, answer = bench.words[item], bench.answers[item]
    return lcs(own, words) / len(own), lcs(answer, words) / len(answer)


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every contaminated document with the benchmark items found in it."""
    found = contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "item_id", F.lit(True).alias("contaminated"),
                        "cosine", "lcs", "answer").distinct()


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the contaminated ones; a null id is judged by its own row."""
    rows = stored(docs.withColumn("_row", F.monotonically_increasing_id()), "documents")
    found = contaminated(rows.select(F.col("_row").alias("doc_id"), "text"), benchmark).select(
        F.col("id").alias("_row")).distinct()
    return rows.join(found, "_row", "left_anti").select(*docs.columns)
