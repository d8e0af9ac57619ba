"""Best-fit packing of token pieces by linear grouping.

Lengths of over ``capacity / 4`` are *large*. They are sorted and cut into
groups of equal cardinality (equal lengths stay together), each rounded up
to its longest, which leaves a few sizes. Configurations (multisets of sizes
that fit one sequence) are optimised over them by column generation: a small
linear program whose columns come from a knapsack over the capacity; its
solution is rounded down, and the sizes left over are packed by best fit
with actual counts. Then actual documents take the slots of their group,
and small pieces go best-fit, longest first, into the room that the actual
lengths leave.

All that decides is counts by length, at most ``capacity`` numbers, so the
plan is made on the driver whatever the input's size. Pieces find their
place by rank: a piece's rank in its length (counted in salted parts, so
that a length that most documents have is not one task's work) falls into
one interval of the plan, which names a run of sequences.

Defined results: a null or empty text is the one token 0; a text of any
length is cut whole into pieces; pieces of equal length are alike to the plan
and take their places in the order of the stored rows; repeated rows are packed each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyzone.llm.common import Words, mapped, read_table, slices, starts, stored, texts, utf8

CAPACITY, END, GROUPS = 2048, 0, 192
TOKENIZER = "word_bpe_49k.json"
#: Words whose ids a worker keeps at hand before it starts anew.
CACHED_WORDS = 600_000
PIECES = "doc_id long, row long, piece int, start long, length long, ids_crc32 long"


#: A closing run of ASCII marks: the tokenizer always parts it from a letter or digit before it.
CLOSING = re.compile(rb"(?<=[A-Za-z0-9])([!-/:-@\[-`{-~]+)(?=[\x20\x09-\x0D]|\Z)")


def runs(body: bytes) -> list[bytes]:
    """A text's words, lower case, closing marks apart.

    Letters that a combining mark follows are composed before they are
    lowered, which may differ the other way round: such texts keep theirs.
    """
    if b"\xcc" not in body and b"\xcd" not in body:  # the lead bytes of the marks that ASCII letters compose with
        body = body.lower()
    return CLOSING.sub(rb" \1", body).split()


class Tokens:
    """Token ids of texts, word by word.

    The tokenizer treats what white space separates on its own, so a word's
    ids are the same in every text; they are found once per distinct word.
    It lowers letters and parts a closing run of marks from the letter or digit
    before it, so both are done first (:func:`runs`): fewer words differ.
    Words with a special token's opening go through the tokenizer as a text.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self.tokenizer.encode("\x01", add_special_tokens=False).ids
        self.words = Words(self.encode_words, most=CACHED_WORDS)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0

    def encode_words(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Where each word's ids begin in ``flat``, and how many there are."""
        if self.words.arrays is None:
            self.used = 0
        flats, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for i in range(0, len(new), 8192):
            joined = b" \x01 ".join(new[i:i + 8192]).decode("utf-8", "replace")
            part = joined.split(" \x01 ")
            plain = len(self.mark) == 1 and "<|" not in joined and len(part) == len(new[i:i + 8192])
            if plain:  # one call for all, a mark after each
                (one,) = self.tokenizer.encode_batch_fast([joined + " \x01"], add_special_tokens=False)
                ids = np.array(one.ids, np.uint32)
                ends = np.flatnonzero(ids == self.mark[0])
                plain = len(ends) == len(part)
            if plain:
                flats.append(ids[ids != self.mark[0]])
                counts.append(np.diff(ends, prepend=-1) - 1)
            else:
                lists = [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
                flats += [np.array(x, np.uint32) for x in lists]
                counts.append(np.array([len(x) for x in lists], np.int64))
        found, counts = np.concatenate(flats), np.concatenate(counts)
        total = self.used + len(found)
        if total > len(self.flat):
            grown = np.zeros(2 * total, np.uint32)
            grown[:self.used] = self.flat[:self.used]
            self.flat = grown
        begin = self.used + starts(counts)[:-1]
        self.flat[self.used:total] = found
        self.used = total
        return begin, counts

    def __call__(self, bodies: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        special = {i: self.tokenizer.encode(t, add_special_tokens=False).ids
                   for i, t in enumerate(bodies) if "<|" in t}
        lists = [[] if i in special else runs(utf8(t)) for i, t in enumerate(bodies)]
        begin, counts = self.words([w for x in lists for w in x])
        before = starts(counts)
        ids = self.flat[np.arange(before[-1]) + np.repeat(begin - before[:-1], counts)]
        ends = before[np.cumsum([len(x) for x in lists])] if lists else []
        return [np.array(special[i], np.uint32) if i in special else ids[a:b]
                for i, (a, b) in enumerate(zip([0, *ends[:-1]], ends))]


TOKENS: dict[str, Tokens] = {}  # one for each worker process, kept over its tasks


def tokens_of(path: str) -> Tokens:
    if path not in TOKENS:
        TOKENS[path] = Tokens(path)
    return TOKENS[path]


def cut(docs: DataFrame, path: str | None = None, id: str = "doc_id", text: str = "text",
        capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every document: ids, then the end token, cut after each ``capacity``."""
    path = path or public_tokenizers.path(TOKENIZER)

    def run(batches):
        tokens = tokens_of(path)
        for batch in slices(batches):
            out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for doc, ids in zip(batch.column("doc_id").to_pylist(), tokens(texts(batch))):
                ids = np.append(ids, np.uint32(END)).astype("<u4")
                for piece, at in enumerate(range(0, len(ids), capacity)):
                    own = ids[at:at + capacity]
                    for k, v in zip(out, (doc, piece, at, len(own), zlib.crc32(own.tobytes()))):
                        out[k].append(v)
            yield pa.record_batch({k: pa.array(v, pa.int32() if k == "piece" else pa.int64()) for k, v in out.items()})

    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return mapped(rows, run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def grouped(counts: dict[int, int], groups: int = GROUPS) -> dict[int, int]:
    """Length -> rounded length: groups of equal cardinality in order of length."""
    total, seen, members, out = sum(counts.values()), 0, defaultdict(list), {}
    for length in sorted(counts, reverse=True):
        members[seen * groups // total].append(length)
        seen += counts[length]
    for own in members.values():
        out |= {x: max(own) for x in own}
    return out


def configurations(demand: dict[int, int], capacity: int = CAPACITY, rounds: int = 2000) -> list[tuple[Counter, int]]:
    """Few configurations (sizes and how often) with their counts, meeting ``demand`` exactly.

    Column generation: the master's dual prices come from a basis kept by
    pivoting, new columns from an unbounded knapsack. Rounded down; what is
    left goes by best fit.
    """
    sizes = sorted(demand)
    if not sizes:
        return []
    n, need = len(sizes), np.array([demand[s] for s in sizes], float)
    basis = np.diag([float(capacity // s) for s in sizes])
    inverse = np.linalg.inv(basis)
    for step in range(rounds):
        prices = inverse.sum(axis=0)  # costs of one for each column
        best, take = knapsack(sizes, prices, capacity)
        if best <= 1 + 1e-3:
            break
        column = np.bincount(take, minlength=n).astype(float)
        x, d = inverse @ need, inverse @ column
        ratio = np.where(d > 1e-9, np.maximum(x, 0) / np.where(d > 1e-9, d, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = column
        pivot = inverse[out] / d[out]
        inverse = inverse - np.outer(d, pivot)
        inverse[out] = pivot
        if step % 50 == 49:
            inverse = np.linalg.inv(basis)
    times = np.maximum(inverse @ need, 0)
    plan, left = [], dict(demand)
    for j in np.argsort(-times):
        config = Counter({sizes[i]: int(k) for i, k in enumerate(basis[:, j]) if k})
        m = min([int(times[j] + 1e-6), *(left[s] // k for s, k in config.items())]) if config else 0
        if m > 0:
            plan.append((config, m))
            for s, k in config.items():
                left[s] -= m * k
    return plan + best_fit({s: k for s, k in left.items() if k}, capacity)


def knapsack(sizes: list[int], prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Most valuable multiset of sizes (unbounded) within the capacity."""
    value, chosen = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for i in np.argsort(-prices / np.array(sizes)):
        s, p = sizes[i], prices[i]
        if p <= 0:
            continue
        for a in range(s, capacity + 1, s):  # blocks of s: each reads the one before it
            b = min(a + s, capacity + 1)
            better = value[a - s:b - s] + p
            gain = better > value[a:b] + 1e-12
            value[a:b][gain] = better[gain]
            chosen[a:b][gain] = i
    at, take = int(value.argmax()), []
    best = value[at]
    while chosen[at] >= 0:  # the rest is slack
        take.append(chosen[at])
        at -= sizes[chosen[at]]
    return float(best), np.array(take, int)


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Counter, int]]:
    """Best fit, longest first, on counts: equal bins are moved together."""
    bins: dict[int, list[tuple[Counter, int]]] = defaultdict(list)
    rooms: list[int] = []  # sorted rooms that have bins
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                if capacity not in bins or not bins[capacity]:
                    rooms.append(capacity)
                bins[capacity].append((Counter(), max(1, -(-left // (capacity // size)))))
                continue
            room = rooms[at]
            config, n = bins[room].pop()
            if not bins[room]:
                rooms.pop(at)
            fill = room // size if room == capacity else 1
            m = min(n, left // fill) if left >= fill else 0
            if not m:  # fewer left than fill one bin
                m, fill = 1, left
            if n > m:
                if not bins[room]:
                    rooms.insert(at, room)
                bins[room].append((config, n - m))
            rest = room - fill * size
            if not bins[rest]:
                rooms.insert(bisect_left(rooms, rest), rest)
            bins[rest].append((config + Counter({size: fill}), m))
            left -= m * fill
    return [x for own in bins.values() for x in own]


def ranked(pieces: DataFrame, key: str) -> tuple[DataFrame, dict[int, int]]:
    """``pieces`` with ``rank`` (from 0) in their ``key``, and the counts by key.

    Ranks are counted within salted parts of a key, then moved by what the
    key's parts before hold: no task needs all of a common key.
    """
    spark = pieces.sparkSession
    salts = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = pieces.withColumn("_salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int"))
    sizes = parts.groupBy(key, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    moved = sizes.select(key, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(key, "_salt").orderBy("row")) - 1
    out = (parts.withColumn("_own", own).join(moved, [key, "_salt"])
           .withColumn("rank", F.col("_own") + F.col("_before")).drop("_salt", "_own", "_before"))
    return out, {r[key]: r["n"] for r in sizes.groupBy(key).agg(F.sum("_n").alias("n")).collect()}


class Slots:
    """Intervals of ranks by key, each with the first sequence, the step and the slot: at most a plan's size."""

    def __init__(self):
        self.rows, self.taken = [], defaultdict(int)

    def take(self, key: int, times: int, sequence: int, slot: int, each: int = 1) -> None:
        """The next ``times * each`` pieces of ``key``: ``each`` to a sequence, from ``slot`` on."""
        begin = self.taken[key]
        self.taken[key] += times * each
        self.rows.append((key, begin, begin + times * each, sequence, slot, each))

    def place(self, pieces: DataFrame, key: str) -> DataFrame:
        """``pieces`` (with rank) with ``sequence_id`` and ``slot``, by a look-up in the broadcast plan."""
        plan = defaultdict(list)
        for row in sorted(self.rows):
            plan[row[0]].append(row[1:])
        plan = {k: np.array(v, np.int64) for k, v in plan.items()}
        shared = pieces.sparkSession.sparkContext.broadcast(plan)
        columns = pieces.columns

        def run(batches):
            for batch in batches:
                keys = batch.column(key).to_numpy(zero_copy_only=False)
                rank = batch.column("rank").to_numpy(zero_copy_only=False)
                sequence, slot = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
                for k in np.unique(keys):
                    own, rows = keys == k, shared.value[int(k)]
                    at = rows[np.searchsorted(rows[:, 0], rank[own], side="right") - 1]
                    into = rank[own] - at[:, 0]
                    sequence[own], slot[own] = at[:, 2] + into // at[:, 4], at[:, 3] + into % at[:, 4]
                yield pa.record_batch([*batch.columns, pa.array(sequence), pa.array(slot)],
                                      names=[*columns, "sequence_id", "slot"])

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
        return mapped(pieces, run, f"{schema}, sequence_id long, slot long")


def pack(pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """``pieces`` (any columns with ``length``) with ``sequence_id`` and ``offset``."""
    columns = pieces.columns
    pieces = stored(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    by_length, counts = ranked(pieces, "length")
    by_length = stored(by_length, "pieces")
    floor = capacity // 4
    large = {k: n for k, n in counts.items() if k > floor}
    size_of = grouped(large, groups)
    demand = Counter()
    for k, n in large.items():
        demand[size_of[k]] += n
    members = defaultdict(list)
    for k in sorted(large, reverse=True):
        members[size_of[k]].append([k, large[k]])
    slots, sequence = Slots(), 0
    for config, times in configurations(dict(demand), capacity):
        slot = 0
        for size in sorted(config, reverse=True):
            for _ in range(config[size]):
                # The group's actual lengths, one after the other.
                done = 0
                while done < times:
                    length, left = members[size][0]
                    m = min(left, times - done)
                    slots.take(length, m, sequence + done, slot)
                    done += m
                    members[size][0][1] -= m
                    if not members[size][0][1]:
                        members[size].pop(0)
                slot += 1
        sequence += times
    placed = stored(slots.place(by_length.where(F.col("length") > floor), "length"), "pieces")
    # Small pieces: best fit into the room that is left, by counts of rooms and lengths.
    room = (placed.groupBy("sequence_id").agg((F.lit(capacity) - F.sum("length")).alias("room"),
                                              F.max("slot").alias("last"))
            .withColumnRenamed("sequence_id", "row"))
    rooms, free = ranked(room.where(F.col("room") > 0), "room")
    small = {k: n for k, n in counts.items() if k <= floor}
    fills, extra = Slots(), []
    # Bins of one room are numbered by rank; a virtual id stands for (room, rank) until the join.
    state = [[r, (r, 0), n, 0] for r, n in free.items()]  # room now, first bin (room, rank), bins, slots used
    open_ids = defaultdict(list)
    for r, base, n, used in state:
        open_ids[r].append((base, n, used))
    have = sorted(open_ids)
    fresh = 0
    for size in sorted(small, reverse=True):
        left = small[size]
        while left:
            at = bisect_left(have, size)
            if at == len(have):
                need = -(-left // (capacity // size))
                open_ids[capacity].append(((capacity + 1, fresh), need, 0))
                fresh += need
                if not have or have[-1] != capacity:
                    have.append(capacity)
                continue
            r = have[at]
            (home, first), n, used = open_ids[r].pop()
            if not open_ids[r]:
                have.pop(at)
            fill = capacity // size if r == capacity else 1
            m = min(n, left // fill)
            if not m:
                m, fill = 1, left
            if n > m:
                if not open_ids[r]:
                    have.insert(bisect_left(have, r), r)
                open_ids[r].append(((home, first + m), n - m, used))
            rest = r - fill * size
            if not open_ids[rest]:
                have.insert(bisect_left(have, rest), rest)
            open_ids[rest].append(((home, first), m, used + fill))
            fills.take(size, m, home * (1 << 48) + first, used, fill)
            left -= m * fill
    filled = fills.place(by_length.where(F.col("length") <= floor), "length")
    base = F.shiftright("sequence_id", 48)
    rank = F.col("sequence_id") - F.shiftleft(base, 48)
    filled = filled.withColumn("room", base).withColumn("rank", rank).drop("sequence_id")
    ids = rooms.select("room", "rank", F.col("row").alias("sequence_id"), "last")
    filled = (filled.join(ids, ["room", "rank"], "left")
              .withColumn("sequence_id", F.coalesce("sequence_id", F.col("rank") + F.lit(sequence)))
              .withColumn("slot", F.col("slot") + F.coalesce(F.col("last") + 1, F.lit(0))))
    out = placed.select(*columns, "row", "sequence_id", "slot").unionByName(
        filled.select(*columns, "row", "sequence_id", "slot"))
    before = (Window.partitionBy("sequence_id").orderBy("slot")
              .rowsBetween(Window.unboundedPreceding, -1))
    return out.select(*columns, "sequence_id",
                      F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    return pack(cut(docs, path))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document."""
    return pack_documents(read_table(spark, sf_dir, "documents"))
