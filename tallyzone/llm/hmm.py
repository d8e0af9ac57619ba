"""Hidden Markov language model over words.

Tokens are the lower-cased (A-Z) words of a text and one end. A word's class
is a hash of its affixes (of all of it if it is short). The model draws a
state, the state a class, and the class a word by the word's share in it:

    P(word | state) = emission[state, class] * (c + 0.5) / (N_class + 0.5 (V_class + 1))

- Counts: every distinct word of a chunk is sent once with its count in the
  training texts; buckets of word hashes sum them over all documents and
  send each chunk its words' totals (see ``common``). The vocabulary is never
  gathered in one place.
- Baum-Welch: each pass goes over all training texts in segments of
  ``SEGMENT`` tokens; expected counts are summed in the tasks, then across
  partitions, and are of a fixed size (states x classes). A segment inside
  a document starts from the average state.
- Scores: the scaled forward recursion over the whole text, its end
  included, so the likelihood is exact. A long document is cut into segments
  whose recursion starts from every state at once and is then chained, which
  gives the same number without as many steps as the text has words.

Defined results: a null text is the empty text, whose one token is the end;
a null id counts as training; a text of any length is scored whole; repeated rows count each; without training
rows every word has probability one under ``base``; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyzone.llm.common import (Words, answers, chunk_table, crc_remainder, from_blob, mapped, pack_array,
                                  pack_sorted, read_table, starts, stored, texts, unpack_array, unpack_sorted, utf8,
                                  with_answers)

STATES, CLASSES, SEGMENT, ROUNDS = 8, 4096, 128, 4
END = CLASSES  # the end's class
LONG, PIECE = 1024, 256
REQUEST = "bucket int, chunk_id long, payload binary"


def word_columns(new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and class of each word."""
    classes = [zlib.crc32(w if len(w) <= 5 else w[:2] + b"~" + w[-3:]) % CLASSES for w in new]
    return (np.fromiter(map(xxhash.xxh64_intdigest, new), np.uint64, len(new)), np.array(classes, np.uint16))


class Chunk:
    """Words of a chunk's documents: hashes, classes, documents' counts and who is held out."""

    def __init__(self, blob, words: Words):
        self.batch = from_blob(blob)
        lists = [utf8(t).lower().split() for t in texts(self.batch)]
        self.counts = np.fromiter(map(len, lists), np.int64, len(lists))
        self.hashes, self.classes = words([w for x in lists for w in x])
        self.held = np.array(self.batch.column("held").to_pylist(), bool)
        self.train = np.repeat(~self.held, self.counts)

    def distinct(self, buckets: int):
        """Distinct words by (bucket, hash): hashes, classes, training counts, cuts between buckets, and each word's number."""
        keys, first, inverse = np.unique(self.hashes, return_index=True, return_inverse=True)
        bucket = (keys >> np.uint64(40)) % np.uint64(buckets)
        order = np.lexsort((keys, bucket))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        counts = np.bincount(inverse, weights=self.train, minlength=len(keys)).astype(np.uint32)
        own = bucket[order]
        cuts = [*np.flatnonzero(np.diff(own, prepend=own[:1] + np.uint64(1))).tolist(), len(own)]
        return keys[order], self.classes[first[order]], counts[order], own, cuts, rank[inverse]


def count_words(payloads: list[bytes]) -> list[bytes]:
    """Totals of each payload's words; a last payload of no chunk gets the sums by class."""
    split = []
    for p in payloads:
        a, b = np.frombuffer(p, np.int64, 2)
        split.append((unpack_sorted(p[16:16 + a]), unpack_array(p[16 + a:16 + a + b]), unpack_array(p[16 + a + b:])))
    keys = np.concatenate([x[0] for x in split])
    distinct, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
    totals = np.bincount(inverse, weights=np.concatenate([x[2] for x in split])).astype(np.int64)
    classes = np.concatenate([x[1] for x in split])[first]
    known = totals > 0
    sums = np.stack([np.bincount(classes[known], weights=totals[known], minlength=CLASSES),
                     np.bincount(classes[known], minlength=CLASSES)]).astype(np.int64)
    at = starts(np.array([len(x[0]) for x in split]))
    replies = [pack_array(totals[inverse[a:b]]) for a, b in zip(at, at[1:])]
    # The first chunk's reply carries the bucket's sums.
    head = pack_array(sums.ravel())
    return [np.array([len(head) if i == 0 else 0], np.int64).tobytes() + (head if i == 0 else b"") + r
            for i, r in enumerate(replies)]


@dataclass
class Hmm:
    start: np.ndarray  # states
    inside: np.ndarray  # states: average occupation, where a segment starts inside a document
    move: np.ndarray  # states x states
    emit: np.ndarray  # classes + 1 x states

    @classmethod
    def begin(cls, shares: np.ndarray, seed: int = 9) -> "Hmm":
        """Sticky states whose emissions are the classes' shares with noise."""
        rng = np.random.default_rng(seed)
        emit = shares[:, None] * np.exp(rng.normal(0, 0.7, (len(shares), STATES)))
        move = np.full((STATES, STATES), 0.05 / (STATES - 1)) + np.eye(STATES) * (0.95 - 0.05 / (STATES - 1))
        even = np.full(STATES, 1 / STATES)
        return cls(even, even, move, emit / emit.sum(axis=0))


def expected(model: Hmm, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Expected counts (start, inside, move, emit) of documents: class ids in a row, ``counts`` of each document."""
    per = -(-counts // SEGMENT)
    at = starts(counts)
    begin = np.concatenate([np.arange(a, b, SEGMENT) for a, b in zip(at, at[1:])] or [np.zeros(0, np.int64)])
    opening = np.zeros(len(begin), bool)
    opening[starts(per)[:-1][per > 0]] = True
    size = np.minimum(SEGMENT, np.repeat(at[1:], per) - begin)
    pad = CLASSES + 1
    emit = np.vstack([model.emit, np.ones(STATES)]).astype(np.float32)
    move = model.move.astype(np.float32)
    start, inside = np.zeros(STATES), np.zeros(STATES)
    moves, emits = np.zeros((STATES, STATES)), np.zeros((CLASSES + 1, STATES))
    for i in range(0, len(begin), 4096):
        b, n = begin[i:i + 4096], size[i:i + 4096]
        steps = int(n.max())
        grid = np.full((steps, len(b)), pad, np.int64)
        live = np.arange(steps)[:, None] < n[None, :]
        grid[live] = ids[(np.arange(steps)[:, None] + b[None, :])[live]]
        alpha = np.empty((steps, len(b), STATES), np.float32)
        scale = np.empty((steps, len(b), 1), np.float32)
        x = np.where(opening[i:i + 4096, None], model.start, model.inside).astype(np.float32)
        for t in range(steps):
            x = (x if t == 0 else x @ move) * emit[grid[t]]
            scale[t] = np.maximum(x.sum(axis=1, keepdims=True), 1e-30)
            x = x / scale[t]
            alpha[t] = x
        beta = np.ones((len(b), STATES), np.float32)
        for t in range(steps - 1, -1, -1):
            if t < steps - 1:
                ahead = emit[grid[t + 1]] * beta / scale[t + 1]
                moves += model.move * (alpha[t].T @ (ahead * live[t + 1][:, None]))
                beta = ahead @ move.T
            alpha[t] *= beta
        first = alpha[0].astype(np.float64)
        start += first[opening[i:i + 4096]].sum(axis=0)
        flat, gamma = grid.ravel(), alpha.reshape(-1, STATES)
        for s in range(STATES):
            emits[:, s] += np.bincount(flat, weights=gamma[:, s], minlength=pad + 1)[:pad]
    inside = emits.sum(axis=0)
    return start, inside, moves, emits


def improved(sums: tuple[np.ndarray, ...], shares: np.ndarray) -> Hmm:
    """The next model: smoothed shares of the expected counts."""
    start, inside, moves, emits = sums
    emits = emits + 0.5 * shares[:, None] * len(shares) / 100
    moves, start, inside = moves + 0.5, start + 0.5, inside + 0.5
    return Hmm(start / start.sum(), inside / inside.sum(), moves / moves.sum(axis=1, keepdims=True),
               emits / emits.sum(axis=0))


def train(words: DataFrame, shares: np.ndarray, rounds: int = ROUNDS) -> Hmm:
    """Baum-Welch over all rows of ``words`` (classes, counts): one job a round."""
    model = Hmm.begin(shares)
    total = CLASSES + 1 + STATES + 2
    for _ in range(rounds):
        now = model

        def run(batches):
            sums = np.zeros((total, STATES))
            for batch in batches:
                for ids, counts in zip(batch.column("classes"), batch.column("counts")):
                    start, inside, moves, emits = expected(
                        now, unpack_array(ids.as_py()).astype(np.int64), unpack_array(counts.as_py()))
                    sums += np.vstack([emits, moves, start[None], inside[None]])
            rows = np.flatnonzero(sums.any(axis=1))
            yield pa.record_batch({"k": rows, **{f"s{s}": sums[rows, s] for s in range(STATES)}})

        names = [f"s{s}" for s in range(STATES)]
        rows = (mapped(words, run, "k long, " + ", ".join(f"{n} double" for n in names))
                .groupBy("k").agg(*[F.sum(n).alias(n) for n in names]).toArrow())
        sums = np.zeros((total, STATES))
        if rows.num_rows:
            sums[rows.column("k").to_numpy()] = np.column_stack([rows.column(n).to_numpy() for n in names])
        c = CLASSES + 1
        model = improved((sums[c + STATES], sums[c + STATES + 1], sums[c:c + STATES], sums[:c]), shares)
    return model


def forward(model: Hmm, first: np.ndarray, ids: np.ndarray, begin: np.ndarray, size: np.ndarray):
    """Last normalised state weights and log likelihoods of runs of ``ids``.

    ``first`` has each run's state weights before its first emission.
    """
    order = np.argsort(-size, kind="stable")
    begin, size, x = begin[order], size[order], first[order].copy()
    logs = np.zeros(len(order))
    steps = int(size[0]) if len(size) else 0
    live = np.searchsorted(-size, -np.arange(steps), side="left")  # runs longer than t
    for t in range(steps):
        n = live[t]
        y = (x[:n] if t == 0 else x[:n] @ model.move) * model.emit[ids[begin[:n] + t]]
        total = np.maximum(y.sum(axis=1), 1e-300)
        x[:n] = y / total[:, None]
        logs[:n] += np.log(total)
    back = np.argsort(order)
    return x[back], logs[back]


def log_likelihood(model: Hmm, ids: np.ndarray, counts: np.ndarray, long: int = LONG, piece: int = PIECE) -> np.ndarray:
    """Natural log likelihood of the class sequence of each document."""
    out, at = np.zeros(len(counts)), starts(counts)[:-1]
    short = np.flatnonzero(counts <= long)
    out[short] = forward(model, np.tile(model.start, (len(short), 1)), ids, at[short], counts[short])[1]
    large = np.flatnonzero(counts > long)
    if len(large):
        begin = [np.arange(at[d], at[d] + counts[d], piece) for d in large]
        size = [np.minimum(piece, at[d] + counts[d] - b) for d, b in zip(large, begin)]
        pieces = np.array([len(b) for b in begin])
        flat_begin, flat_size = np.concatenate(begin), np.concatenate(size)
        # From each state at the end of the piece before: the weights after a move.
        state, logs = forward(model, np.tile(model.move, (len(flat_begin), 1)), ids,
                              np.repeat(flat_begin, STATES), np.repeat(flat_size, STATES))
        state, logs = state.reshape(-1, STATES, STATES), logs.reshape(-1, STATES)
        heads = starts(pieces)[:-1]
        now, total = forward(model, np.tile(model.start, (len(large), 1)), ids, flat_begin[heads], flat_size[heads])
        for j in range(1, int(pieces.max())):  # all documents' j-th pieces at once
            on = np.flatnonzero(pieces > j)
            k = heads[on] + j
            most = logs[k].max(axis=1, keepdims=True)
            new = np.einsum("ds,dst->dt", now[on] * np.exp(logs[k] - most), state[k])
            norm = new.sum(axis=1)
            now[on] = new / norm[:, None]
            total[on] += most[:, 0] + np.log(norm)
        out[large] = total
    return out


def with_ends(classes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class ids with each document's end, and the counts with it."""
    return np.insert(classes.astype(np.int64), np.cumsum(counts), END), counts + 1


def score(docs: DataFrame, held, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score); ``held`` is a condition on ``docs``."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"),
                       F.coalesce(held, F.lit(False)).alias("held"))
    kind = rows.schema["id"].dataType.simpleString()
    chunks = chunk_table(rows, ["id", "text", "held"])
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                  (chunks.agg(F.sum("n_bytes")).first()[0] or 0) // 30_000_000)

    def each(batches):
        words = Words(word_columns)
        for batch in batches:
            for i in range(batch.num_rows):
                yield batch, i, Chunk(batch.column("blob")[i].as_buffer(), words)

    def ask(batches):
        for batch, i, chunk in each(batches):
            keys, classes, counts, own, cuts, _ = chunk.distinct(buckets)
            sent = []
            for a, b in zip(cuts, cuts[1:]):
                parts = pack_sorted(keys[a:b]), pack_array(classes[a:b]), pack_array(counts[a:b])
                sent.append(np.array([len(parts[0]), len(parts[1])], np.int64).tobytes() + b"".join(parts))
            yield pa.record_batch({"bucket": pa.array([int(own[a]) for a in cuts[:-1]], pa.int32()),
                                   "chunk_id": pa.array([batch.column("chunk_id")[i].as_py()] * len(sent), pa.int64()),
                                   "payload": pa.array(sent, pa.binary())})

    totals = stored(answers(mapped(chunks, ask, REQUEST), count_words), "counts")

    def class_sums(batches):
        for batch in batches:
            sums = np.zeros((2, CLASSES), np.int64)
            for payload in batch.column("payload"):
                n = int(np.frombuffer(payload.as_buffer(), np.int64, 1)[0])
                if n:
                    sums += unpack_array(payload.as_py()[8:8 + n]).reshape(2, CLASSES)
            yield pa.record_batch({"k": np.arange(CLASSES), "n": sums[0], "v": sums[1]})

    found = mapped(totals.select("payload"), class_sums, "k long, n long, v long").groupBy("k").agg(
        F.sum("n").alias("n"), F.sum("v").alias("v")).toArrow()
    tokens, distinct = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    if found.num_rows:
        at = found.column("k").to_numpy()
        tokens[at], distinct[at] = found.column("n").to_numpy(), found.column("v").to_numpy()
    ends = rows.where(~F.col("held")).count()
    n_all, v_all = int(tokens.sum()) + ends, int(distinct.sum()) + (ends > 0)

    def classes_of(batches):
        for _, _, chunk in each(batches):
            ids, counts = with_ends(chunk.classes[chunk.train], chunk.counts[~chunk.held])
            if len(counts):
                yield pa.record_batch({"classes": pa.array([pack_array(ids.astype(np.uint16))], pa.binary()),
                                       "counts": pa.array([pack_array(counts)], pa.binary())})

    training = stored(mapped(chunks, classes_of, "classes binary, counts binary"), "classes",
                      compression="uncompressed")
    shares = np.append(tokens + 0.5 * (distinct + 1), ends + 0.5)
    model = train(training, shares / shares.sum())
    in_class = np.log10(tokens + 0.5 * (distinct + 1))
    in_all = np.log10(n_all + 0.5 * (v_all + 1))

    def judge(batches):
        for batch, i, chunk in each(batches):
            replies = {r["bucket"]: r["payload"] for r in batch.column("replies")[i].as_py() or ()}
            keys, classes, _, own, cuts, number = chunk.distinct(buckets)
            c = np.zeros(len(keys), np.int64)
            for a, b in zip(cuts, cuts[1:]):
                data = replies[int(own[a])]
                c[a:b] = unpack_array(data[8 + int(np.frombuffer(data, np.int64, 1)[0]):])
            log_c = np.log10(c + 0.5)
            of = np.repeat(np.arange(len(chunk.counts)), chunk.counts)
            total = lambda x: np.bincount(of, weights=x[number], minlength=len(chunk.counts))
            known = total((c > 0).astype(float)).astype(np.int64) + (ends > 0)
            base = total(log_c - in_all) + np.log10(ends + 0.5) - in_all
            words = total(log_c - in_class[classes])
            states = log_likelihood(model, *with_ends(chunk.classes, chunk.counts)) / np.log(10)
            yield pa.record_batch({
                "id": chunk.batch.column("id"), "held_out": chunk.held, "n_tokens": chunk.counts + 1, "n_known": known,
                "train_tokens": np.full(len(known), n_all), "base_score": base, "score": words + states})

    return mapped(with_answers(chunks, totals), judge, f"id {kind}, held_out boolean, n_tokens long, n_known long, "
                  "train_tokens long, base_score double, score double")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document, learned where crc32(doc_id) mod 5 is not 1."""
    found = score(read_table(spark, sf_dir, "documents"), crc_remainder("doc_id", 5) == 1)
    return found.withColumnRenamed("id", "doc_id")
