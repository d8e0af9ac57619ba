import random
from collections import defaultdict

import numpy as np
import xxhash

from tallyzone.llm import simhash


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for i in range(64):
            ones[i] += h >> i & 1
    return sum(1 << i for i in range(64) if 2 * ones[i] > len(shingles))


def plain_components(fps, ids, radius=4):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i in range(len(fps)):
        least[find(i)].append(ids[i])
    return [min((x for x in least[find(i)] if x is not None), default=None) for i in range(len(fps))]


def near_copies(n, seed=2):
    rng = random.Random(seed)
    base = [" ".join(rng.choices([f"W{i}" for i in range(300)], k=400)) for _ in range(4)]
    out = []
    for _ in range(n):
        words = rng.choice(base).split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = f"n{rng.randrange(1000)}"
        out.append(" ".join(words))
    return out


def test_components_match_all_pairs(spark, make):
    bodies = [None, "", "  \n", "one", "one two", "One\x0btwo", *near_copies(120), "a b c d e"]
    rows = [(1000 - i, t) for i, t in enumerate(bodies)] + [(5, "one"), (5, "one")]
    got = sorted((r["id"], r["fp"] % 2 ** 64, r["component"]) for r in simhash.near_duplicates(make(rows)).collect())
    fps = [plain_fingerprint(t) for _, t in rows]
    roots = plain_components(fps, [i for i, _ in rows])
    assert got == sorted((i, f, c) for (i, _), f, c in zip(rows, fps, roots))


def test_links_at_the_radius_and_split_cells(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2 ** 63, 40).tolist()
    fps = set()
    for b in base:
        for _ in range(8):
            fps.add(b ^ sum(1 << int(i) for i in rng.choice(63, int(rng.integers(0, 6)), replace=False)))
    fps = sorted(fps)
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    want = plain_components(fps, fps)
    for cell in (20_000, 3):  # 3: buckets dealt to triangles of cells
        found = {r["node"]: r["root"] for r in simhash.components(simhash.links(nodes, cell=cell)).collect()}
        assert [found.get(f, f) for f in fps] == want


def test_every_pair_within_the_radius_shares_a_table():
    kept = simhash.masks()
    rng = np.random.default_rng(1)
    for _ in range(2000):
        diff = sum(1 << int(i) for i in rng.choice(64, 4, replace=False))
        assert (kept & np.uint64(diff) == 0).any()


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    assert {r["root"] for r in simhash.components(edges).collect()} == {0}


def test_keep_one(spark, make):
    docs = make([(3, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (9, "other words")])
    out = simhash.keep_one(docs)
    assert sorted(r["doc_id"] for r in out.collect()) == [2, 9] and out.columns == docs.columns
    assert simhash.keep_one(make([])).count() == 0
