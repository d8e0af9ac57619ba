import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tallyzone.llm import substrings
from tallyzone.llm.common import pack_sorted, shared_dir, unpack_sorted


def plain(rows, window=35):
    words = [(t or "").encode().split() for _, t in rows]
    counts = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (doc, _), w in zip(rows, words):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if counts[tuple(w[i:i + window])] > 1:
                gone[i:i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((doc, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(500)] + ["é", "a b", "x\x1cy"]
    prose = lambda n: [rng.choice(words) for _ in range(n)]
    shared = [prose(n) for n in (34, 35, 36, 60, 200)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (3, "one")]
    for i in range(60):
        body = prose(rng.randint(0, 150))
        for _ in range(rng.randint(0, 3)):
            passage = rng.choice(shared)
            a = rng.randrange(len(passage))
            at = rng.randint(0, len(body))
            body[at:at] = passage[a:] if rng.random() < 0.3 else passage
        rows.append((10 + i, rng.choice([" ", "\n", " \t "]).join(body)))
    copy = " ".join(prose(50))
    rows += [(200 + i, copy) for i in range(20)]
    rows += [(300, "a " * 500), (301, "a b " * 40), (302, " ".join(prose(40) * 2))]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_counting_all_windows(spark, make, seed, monkeypatch):
    monkeypatch.setattr(substrings, "chunk_table",
                        lambda docs, columns: small_chunks(docs, columns))
    rows = corpus(seed)
    folder = shared_dir(spark, "test")
    make(rows).write.parquet(f"{folder}/documents.parquet")
    found = substrings.op4_substring_dedup(spark, folder).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found) == plain(rows)


def small_chunks(docs, columns):
    from tallyzone.llm.common import chunk_table

    return chunk_table(docs, columns, most=3000)


def test_empty(spark, make):
    assert substrings.deduplicated(make([])).count() == 0


def test_sorted_arrays_round_trip():
    rng = np.random.default_rng(1)
    for kind in (np.uint32, np.uint64):
        for n in (0, 1, 1000):
            x = np.sort(rng.integers(0, np.iinfo(kind).max, n, kind))
            assert (unpack_sorted(pack_sorted(x)) == x).all() and unpack_sorted(pack_sorted(x)).dtype == kind


def test_rolling_hashes_depend_on_the_window_only():
    x = np.random.default_rng(3).integers(0, 2 ** 63, 300).astype(np.uint64)
    y = np.concatenate([x[50:100], x[:50]])
    assert (substrings.rolling(x, 20)[50:81] == substrings.rolling(y, 20)[:31]).all()
    assert len(np.unique(substrings.rolling(x, 20))) == 281


def test_word_hashes_equal_where_words_do():
    from tallyzone.llm import common

    rng = random.Random(8)
    words = [b"a", b"b", b"ab", b"ba", "é".encode(), b"x\x00", b"\x1cq", b"w" * 300_000, *(b"w%d" % i for i in range(300))]
    bodies = [b"", b" \t\n", *(rng.choice([b" ", b"\n", b" \x0b "]).join(rng.choices(words, k=rng.randint(0, 40)))
                               for _ in range(60)), b" ".join(rng.choices(words, k=30)), b"tail " * 120_000]
    hashes, counts = common.word_hashes(bodies)
    flat = [w for b in bodies for w in b.split()]
    assert counts.tolist() == [len(b.split()) for b in bodies]
    by = {}
    for word, h in zip(flat, hashes.tolist()):
        assert by.setdefault(word, h) == h
    assert len(set(by.values())) == len(by)
