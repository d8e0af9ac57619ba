"""Conversation repair against a plain version that tries every edit."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import duckdb
import pytest

from tallyzone.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string, fault string, block int, key string"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate == 1:
            text = ""
        if fate == 2:
            text = re.sub("[.!?]", "", text)
        if fate == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(fate, 1)
    return out


def plain_report(rows):
    """Counts, cost, audit and digest of one conversation's rows (turn, role, text)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
    seen, faults = set(), []
    for _, role, text in rows:
        end = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "" if end and end[-1] in ".!?" else "truncated"
        if not end:
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        seen.add((role, text))
        faults.append(fault)

    @lru_cache(None)
    def best(i, said, inserted):
        """Cheapest (cost, audit, roles and texts) of rows i on; ``said``: what the initials so far allow next."""
        options = []
        if i == len(rows) and said in ("any", "u after a"):
            options.append((0, "", ()))
        if inserted < 3:
            for role in ("user", "assistant"):
                if (to := follow(said, role[0])) is not None:
                    cost, audit, out = best(i, to, inserted + 1)
                    options.append((cost + 2, "I" + audit, ((role, ""), *out)))
        if i < len(rows):
            cost, audit, out = best(i + 1, said, 0)
            options.append((cost + 3, "D" + audit, out))
            if faults[i] in ("", "truncated"):
                _, own, text = rows[i]
                for letter, role, extra in (("K", own, 0), ("R", "user", 2), ("R", "assistant", 2)):
                    if (to := follow(said, role[:1])) is not None:
                        cost, audit, out = best(i + 1, to, 0)
                        options.append((cost + extra + (faults[i] == "truncated"), letter + audit, ((role, text), *out)))
        return min(options, key=lambda o: o[:2]) if options else (10 ** 9, "", ())

    def follow(said, initial):
        if said == "any" and initial == "s":
            return "u"
        if said in ("any", "u", "u after a") and initial == "u":
            return "a"
        return "u after a" if said == "a" and initial == "a" else None

    cost, audit, out = best(0, "any", 0)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)


def expected(rows):
    left = {}
    for conv, turn, role, text in plain_damage(rows):
        left.setdefault(conv, []).append((turn, role, text))
    return {conv: plain_report(left.get(conv, [])) for conv in {r[0] for r in rows}}


def asked(spark, rows, tmp_path):
    spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = C.op13_conversation_repair(spark, str(tmp_path)).collect()
    assert len({r[0] for r in got}) == len(got)
    return {r[0]: tuple(r[1:]) for r in got}


def test_random_conversations(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for conv in range(150):
        for turn in sorted(rng.choices([None, *range(9)], k=rng.randint(1, 8)), key=lambda t: (t is not None, t or 0)):
            rows.append((rng.choice([conv, conv, conv, None]), turn,
                         rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "agent", "", None]),
                         rng.choice(["Yes.", "No", "Why?  \n", "", " \t", None, "Ä é.", "more\n", "Go!"])))
    rows = [r for i, r in enumerate(rows) if r[0] is not None or i % 9 == 0]
    assert asked(spark, rows, tmp_path) == expected(rows)


def test_given_conversations(spark):
    path = "/root/testdata/sf0.01"
    rows = duckdb.sql(f"select conv_id, turn, role, text from '{path}/conversations.parquet'").fetchall()
    got = {r[0]: tuple(r[1:]) for r in C.op13_conversation_repair(spark, path).collect()}
    assert got == expected(rows)


def test_empty_table(spark, tmp_path):
    assert asked(spark, [], tmp_path) == {}


def test_repeated_rows_and_clashing_columns(spark, tmp_path):
    rows = [(1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, 1, "assistant", "Ho."), (2, None, None, None)] * 2
    assert asked(spark, rows, tmp_path) == expected(rows)


def test_repaired_rows_and_very_long_text(spark):
    long = "word " * 200_000 + "end."
    table = spark.createDataFrame([(1, 0, "user", long), (1, 1, "user", "A."), (1, 2, "assistant", "B."), (1, 3, "user", "")],
                                  "conv_id long, turn long, role string, text string")
    out = sorted(tuple(r) for r in C.repaired(C.conversation_rows(table), "bigint").collect())
    assert out == [(1, 0, "K", "user", long), (1, 1, "I", "assistant", ""), (1, 2, "K", "user", "A."),
                   (1, 3, "K", "assistant", "B.")]


@pytest.mark.parametrize("size", [1, 2, 5])
def test_spilled_blocks(size):
    """A giant conversation's pointers, spilled in many blocks, give the edits of one block."""
    import pandas as pd

    rng = random.Random(size)
    rows = [(turn // 2, rng.choice(["user", "assistant", "system"]), f"{rng.randint(0, 9)}.") for turn in range(40)]
    rows = sorted(rows, key=lambda r: (r[0], r[1], hashlib.sha256(r[2].encode()).digest()))
    seen, coded = set(), []
    for turn, role, text in rows:
        coded.append(("=1", str(turn), role, hashlib.sha256(text.encode()).digest(), True, role[0],
                      C.DUPLICATE if (role, text) in seen else C.FINE))
        seen.add((role, text))
    names = ["key", "turn_text", "role", "digest", "present", "initial", "fault"]
    backwards = pd.DataFrame(coded[::-1], columns=names)
    frames = [backwards[i:i + 7] for i in range(0, len(backwards), 7)]  # state is carried from frame to frame
    blocks = pd.concat(C.planned(frames, size))
    assert len(blocks) == -(-40 // size)
    events = [(int(b.turn_text), b.role, b.digest, 0, -b.block, ("=1", None, None, b.pointers, (0,) if b.last else None))
              for b in blocks.itertuples()]
    events += [(turn, role, hashlib.sha256(text.encode()).digest(), 1, 0, ("=1", role, text, None, None))
               for turn, role, text in rows]
    events.sort(key=lambda e: e[:5])
    audit = "".join(e[1] for e in C.edits(e[-1] for e in events) if e[1])
    assert audit == plain_report(rows)[-2]
