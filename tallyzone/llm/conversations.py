"""Repair of damaged conversations by cheapest edits, streamed in turn order.

A conversation is sound if its role initials read ``(s?(ua)+)?`` and no row
is blank, repeated or cut off. The cheapest edits that make it so are found
by dynamic programming over four states: nothing yet, after the system row,
after a user row, after an assistant row.

1. Rows are partitioned by conversation and sorted from the last turn to the
   first. A task carries the four costs to go from one Arrow batch to the
   next and leaves two bytes a row: for each state which edits are cheapest.
   ``BLOCK`` of these pointers at a time are spilled as a row of a table in
   the shared folder, so a conversation of any length needs the memory of
   one block; the block that reaches the first row carries the counts.
2. Rows and pointer blocks are partitioned by conversation and sorted from
   the first turn to the last, a block before the rows it is for. A task
   reads the edits off the pointers, taking the ASCII-least of the cheapest
   at each step, and streams the repaired rows. The state after any run of
   edits is given by the edits and the rows, so no other choice is open.

Edits: Keep 0, Rerole to user or assistant 2, Delete 3 (a must for blank and
repeated rows), Insert an empty user or assistant row 2; a truncated row that
stays adds 1.

Texts are shuffled once and never held: a giant conversation passes through
one task, which the order of its rows and of the digest over them asks for,
in bounded memory but for the audit, its own result. Repeated rows are told
by (role, SHA-256 of the text) in a window of the same partitioning.

Defined results: a null turn comes first, a null role or text is one space (a
null text is blank, a null role is no legal initial); rows of one turn are
taken by role, then by the text's digest; rows without a conversation id are
one conversation; repeated rows are repeats; texts of any length are hashed
piece by row; an empty table gives no rows; columns other than the four named
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyzone.llm.common import read_table, ship, stored, utf8

#: Rows whose pointers make one spilled block: 2 MB.
BLOCK = 1 << 20
#: White space of the word pattern ``[^\x20\x09-\x0D]``.
SPACE = " \t\n\x0b\x0c\r"
NO_WAY = 1 << 40
START, SYSTEM, USER, ASSISTANT = range(4)
FIRST_OF_PAIR = (START, SYSTEM, ASSISTANT)
DELETE, INSERT, KEEP, REROLE = 1, 2, 4, 8  # ASCII order of their initials
DELETE_COST, INSERT_COST, REROLE_COST, CUT_COST = 3, 2, 2, 1
FINE, BLANK, TRUNCATED, DUPLICATE = range(4)  # of equal rows the repeat sorts last
LEGAL = {"su", "ua", "au"}
STATS = ["blank", "duplicate", "truncated", "illegal", "gaps", "cost"]


def next_of_pair(state: int) -> int:
    """The state after a user row where one is due, else after an assistant row."""
    return USER if state in FIRST_OF_PAIR else ASSISTANT


def kept(state: int, initial: str) -> int | None:
    """The state after keeping a row with this initial; None where it can't stand."""
    if initial == "s":
        return SYSTEM if state == START else None
    if (initial == "u" and state in FIRST_OF_PAIR) or (initial == "a" and state == USER):
        return next_of_pair(state)
    return None


def with_inserts(costs: list[int]) -> list[int]:
    """Costs to go if rows may be inserted first; two in a row lead back, so one more round settles them."""
    once = [min(c, INSERT_COST + costs[next_of_pair(q)]) for q, c in enumerate(costs)]
    return [min(c, INSERT_COST + once[next_of_pair(q)]) for q, c in enumerate(once)]


#: Costs to go after the last row.
END = tuple(with_inserts([0, NO_WAY, NO_WAY, 0]))


class Steps(dict):
    """(costs to go, initial, fault) -> (costs before the row less their least, the least, pointers).

    Costs are kept relative, so few keys occur and a row is one lookup.
    """

    def __missing__(self, key):
        after, initial, fault = key
        stay = CUT_COST if fault == TRUNCATED else 0
        row, ways = [], []
        for q in range(4):
            options = {DELETE: DELETE_COST + after[q]}
            if fault in (FINE, TRUNCATED):
                if (to := kept(q, initial)) is not None:
                    options[KEEP] = stay + after[to]
                options[REROLE] = REROLE_COST + stay + after[next_of_pair(q)]
            row.append(min(options.values()))
            ways.append(options)
        costs = with_inserts(row)
        pointers = 0
        for q in range(4):
            ways[q][INSERT] = INSERT_COST + costs[next_of_pair(q)]
            pointers |= sum(edit for edit, cost in ways[q].items() if cost == costs[q]) << 4 * q
        least = min(costs)
        self[key] = value = tuple(c - least for c in costs), least, pointers
        return value


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def conversation_rows(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                      text: str = "text") -> DataFrame:
    """``key, turn, role, text, present`` of a conversations table; nothing else of it is read.

    ``key`` is the conversation id as text, told apart from a missing one.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit("?"))
    return conversations.select(key.alias("key"), F.col(turn).cast("long").alias("turn"), _text(role).alias("role"),
                                _text(text).alias("text"), F.lit(True).alias("present"))


def _digest() -> Column:
    return F.unhex(F.sha2(F.col("text").cast("binary"), 256))


def _classified(rows: DataFrame) -> DataFrame:
    """Rows without their texts: sort key, role initial, fault; partitioned by conversation."""
    end = F.rtrim(F.col("text"), F.lit(SPACE))
    again = F.row_number().over(_window()) > 1
    fault = (F.when(F.col("end") == "", F.lit(BLANK)).when(again, F.lit(DUPLICATE))
             .when(~F.col("end").isin(".", "!", "?"), F.lit(TRUNCATED)).otherwise(F.lit(FINE)))
    return (rows.select("key", "turn", "role", _digest().alias("digest"), F.right(end, F.lit(1)).alias("end"), "present")
            .repartition("key")
            .withColumn("fault", fault)
            .select("key", "turn", F.col("turn").cast("string").alias("turn_text"), "role", "digest", "present",
                    F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1))
                    .otherwise(F.lit("-")).alias("initial"), F.col("fault").cast("int").alias("fault")))


def _window():
    # absent rows apart: they are no one's first occurrence
    return Window.partitionBy("key", "present", "role", "digest").orderBy(F.col("turn").asc_nulls_first())


BLOCK_SCHEMA = ("key string, turn_text string, role string, digest binary, block int, pointers binary, last boolean, "
                + ", ".join(f"{s} string" for s in STATS))
BLOCK_NAMES = [f.split()[0] for f in BLOCK_SCHEMA.split(", ")]


class _Plan:
    """Costs, pointers and counts of one conversation, its rows met from the last to the first."""

    def __init__(self, key: str, steps: Steps, size: int):
        self.key, self.steps, self.size = key, steps, size
        self.costs, self.base = END, 0
        self.pointers, self.block = array("H"), 0
        self.faults, self.illegal, self.after = [0, 0, 0, 0], 0, None
        self.low = self.high = None
        self.turns = 0
        self.at = (None, None, None)

    def add(self, turn: str | None, role: str, digest: bytes, initial: str, fault: int) -> None:
        self.costs, least, pointers = self.steps[self.costs, initial, fault]
        self.base += least
        self.pointers.append(pointers)
        self.at = (turn, role, digest)
        self.faults[fault] += 1
        if self.after is not None and initial + self.after not in LEGAL:
            self.illegal += 1
        self.after = initial
        if turn is not None:
            number = int(turn)
            if self.low is None:
                self.high = number
            if number != self.low:
                self.turns += 1
            self.low = number

    def spilled(self, last: bool) -> tuple:
        """The block of all pointers not yet spilled, in turn order."""
        self.pointers.reverse()
        data, self.pointers = self.pointers.tobytes(), array("H")
        self.block += 1
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        stats = [*(self.faults[f] for f in (BLANK, DUPLICATE, TRUNCATED)), self.illegal, gaps, self.base + self.costs[START]]
        return (self.key, *self.at, self.block, data, last, *(str(s) if last else None for s in stats))


def planned(frames: Iterable[pd.DataFrame], size: int = BLOCK) -> Iterator[pd.DataFrame]:
    """Pointer blocks of conversations whose rows come from the last to the first."""
    steps, plan = Steps(), None
    for frame in frames:
        out = []
        for key, turn, role, digest, present, initial, fault in frame.itertuples(index=False, name=None):
            if plan is None or plan.key != key:
                if plan is not None:
                    out.append(plan.spilled(True))
                plan = _Plan(key, steps, size)
            if present:
                if len(plan.pointers) == size:
                    out.append(plan.spilled(False))
                plan.add(turn, role, digest, initial, fault)
        yield pd.DataFrame(out, columns=BLOCK_NAMES, dtype=object)
    if plan is not None:
        yield pd.DataFrame([plan.spilled(True)], columns=BLOCK_NAMES, dtype=object)


def edits(events: Iterable[tuple]) -> Iterator[tuple]:
    """Edits of conversations in turn order.

    Events are (key, role, text, pointers, stats): pointers for the rows to
    come, or else a row. Yields (key, initial of the edit, role, text), role
    and text None for a deletion, and (key, None, None, stats) once a
    conversation is done.
    """
    key, state, stats, queue, at = None, START, None, [], 0

    def finish():
        at_end = state
        while END[at_end]:
            at_end = next_of_pair(at_end)
            yield key, "I", "user" if at_end == USER else "assistant", ""
        yield key, None, None, stats

    for own, role, text, pointers, counts in events:
        if own != key:
            if key is not None:
                yield from finish()
            key, state, stats, queue, at = own, START, None, [], 0
        if pointers is not None:
            block = array("H")
            block.frombytes(pointers)
            if len(block):
                queue.append(block)
            stats = stats if counts is None else counts
            continue
        ways = queue[0][at]
        at += 1
        if at == len(queue[0]):
            queue.pop(0)
            at = 0
        while True:
            open_ways = ways >> 4 * state & 15
            if open_ways & DELETE:
                yield key, "D", None, None
                break
            if open_ways & INSERT:
                state = next_of_pair(state)
                yield key, "I", "user" if state == USER else "assistant", ""
                continue
            if open_ways & KEEP:
                state = kept(state, role[:1])
                yield key, "K", role, text
            else:
                state = next_of_pair(state)
                yield key, "R", "user" if state == USER else "assistant", text
            break
    if key is not None:
        yield from finish()


def _events(frames: Iterable[pd.DataFrame]) -> Iterator[tuple]:
    for frame in frames:
        for key, role, text, pointers, last, *stats in frame[
                ["key", "role", "text", "pointers", "last", *STATS]].itertuples(index=False, name=None):
            yield key, role, text, pointers, tuple(map(int, stats)) if last else None


def repaired_frames(frames: Iterable[pd.DataFrame], rows: int = 5_000, size: int = 4_000_000) -> Iterator[pd.DataFrame]:
    """The repaired rows, ``position`` from 0 in each conversation, in frames of bounded size."""
    names, out, held, now, position = ["key", "position", "edit", "role", "text"], [], 0, None, 0
    for key, edit, role, text in edits(_events(frames)):
        if key != now:
            now, position = key, 0
        if edit is None or edit == "D":
            continue
        out.append((key, position, edit, role, text))
        position, held = position + 1, held + len(text)
        if len(out) == rows or held > size:
            yield pd.DataFrame(out, columns=names)
            out, held = [], 0
    yield pd.DataFrame(out, columns=names)


def report_frames(frames: Iterable[pd.DataFrame], rows: int = 5_000) -> Iterator[pd.DataFrame]:
    """Counts, cost, audit and digest of the repaired rows of each conversation."""
    names, out = ["key", *STATS, "audit", "repaired_sha256"], []
    audit, digest, empty = [], hashlib.sha256(), True
    for key, edit, role, text in edits(_events(frames)):
        if edit is None:
            out.append((key, *text, "".join(audit), digest.hexdigest()))
            audit, digest, empty = [], hashlib.sha256(), True
            if len(out) == rows:
                yield pd.DataFrame(out, columns=names)
                out = []
            continue
        audit.append(edit)
        if len(audit) == 65_536:
            audit = ["".join(audit)]
        if edit != "D":
            digest.update(utf8(f"{role}:{text}" if empty else f"\n{role}:{text}"))
            empty = False
    yield pd.DataFrame(out, columns=names)


def _streamed(rows: DataFrame) -> DataFrame:
    """Rows and their pointer blocks in turn order, partitioned by conversation; ``rows`` is read twice."""
    spark = rows.sparkSession
    ship(spark)
    backwards = _classified(rows).sortWithinPartitions(
        "key", F.col("turn").desc_nulls_last(), F.col("role").desc(), F.col("digest").desc(),
        F.col("fault").desc()).drop("turn")  # of equal rows of one turn the first is no repeat
    blocks = stored(backwards.mapInPandas(planned, BLOCK_SCHEMA), "pointers")
    kinds = {f.name: f.dataType for f in blocks.schema}
    ours = rows.where("present").select(
        "key", "turn", "role", _digest().alias("digest"), F.lit(0).alias("block"), "text",
        *(F.lit(None).cast(kinds[c]).alias(c) for c in ("pointers", "last", *STATS)))
    theirs = blocks.select("key", F.col("turn_text").cast("long").alias("turn"), "role", "digest",
                           (-F.col("block")).alias("block"), F.lit(None).cast("string").alias("text"),
                           "pointers", "last", *STATS)
    return (ours.unionByName(theirs).repartition("key")
            .sortWithinPartitions("key", F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(),
                                  F.col("digest").asc_nulls_first(), "block")
            .select("key", "role", "text", "pointers", "last", *STATS))


def _named(df: DataFrame, kind: str, name: str) -> DataFrame:
    """``key`` turned back into the conversation id."""
    own = F.when(F.col("key") != "?", F.substring("key", 2, 1 << 30)).cast(kind)
    return df.select(own.alias(name), *[c for c in df.columns if c != "key"])


def repaired(rows: DataFrame, kind: str, conv: str = "conv_id") -> DataFrame:
    """The repaired conversations of :func:`conversation_rows`: ``conv, position, edit, role, text``."""
    out = _streamed(rows).mapInPandas(repaired_frames, "key string, position long, edit string, role string, text string")
    return _named(out, kind, conv)


def report(rows: DataFrame, kind: str, conv: str = "conv_id") -> DataFrame:
    """One row per conversation: counts, cost, audit, digest. ``rows`` without ``present`` only name one."""
    out = _streamed(rows).mapInPandas(
        report_frames, "key string, " + ", ".join(f"{s} long" for s in STATS) + ", audit string, repaired_sha256 string")
    return _named(out, kind, conv)


def damaged(conversations: DataFrame) -> DataFrame:
    """:func:`conversation_rows` damaged by crc32(``conv_id:turn``) % 20; a dropped row stays as not ``present``."""
    rows = conversation_rows(conversations.select("conv_id", "turn", "role", "text"))
    key_fate = F.crc32(F.concat(F.when(F.col("key") == "?", F.lit(" ")).otherwise(F.substring("key", 2, 1 << 30)),
                                F.lit(":"), _text("turn")).cast("binary")) % 20
    rows = rows.withColumn("fate", key_fate.cast("int"))
    text = (F.when(F.col("fate") == 1, F.lit("")).when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", ""))
            .otherwise(F.col("text")))
    times = F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("key", "turn", F.when(F.col("fate") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
                       text.alias("text"), (F.col("fate") != 0).alias("present"), F.explode(times).alias("time")) \
        .drop("time")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and digest of every conversation of the damaged table."""
    table = read_table(spark, sf_dir, "conversations")
    out = report(damaged(table), table.schema["conv_id"].dataType.simpleString())
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
                      "repaired_sha256")
