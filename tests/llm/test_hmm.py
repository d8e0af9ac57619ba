import math
import random
import zlib
from collections import Counter

import numpy as np

from tallyzone.llm import hmm
from tallyzone.llm.common import shared_dir


def plain_forward(model, ids):
    x, total = model.start.copy(), 0.0
    for t, k in enumerate(ids):
        x = (x if t == 0 else x @ model.move) * model.emit[k]
        total += math.log(x.sum())
        x /= x.sum()
    return total


def random_model(seed=1):
    rng = np.random.default_rng(seed)
    share = lambda *n: rng.dirichlet(np.ones(n[-1]), n[:-1] or None)
    return hmm.Hmm(share(hmm.STATES), share(hmm.STATES), share(hmm.STATES, hmm.STATES),
                   share(hmm.STATES, hmm.CLASSES + 1).T)


def test_likelihood_is_exact_for_short_and_long():
    rng = np.random.default_rng(2)
    model = random_model()
    counts = np.array([1, 2, 7, 128, 129, 300, 1, 64])
    ids = rng.integers(0, hmm.CLASSES + 1, counts.sum())
    at = np.concatenate([[0], np.cumsum(counts)])
    want = [plain_forward(model, ids[a:b]) for a, b in zip(at, at[1:])]
    for long, piece in ((1024, 256), (5, 4), (100, 64)):
        assert np.allclose(hmm.log_likelihood(model, ids, counts, long, piece), want, rtol=1e-9)


def test_expected_counts_raise_the_likelihood():
    rng = np.random.default_rng(3)
    counts = rng.integers(1, 400, 60)
    half = rng.integers(0, 2, 60)
    ids = np.concatenate([rng.integers(50 * h, 50 * h + 50, n) for h, n in zip(half, counts)])
    shares = np.bincount(ids, minlength=hmm.CLASSES + 1) + 0.01
    model = hmm.Hmm.begin(shares / shares.sum())
    likelihoods = []
    for _ in range(4):
        likelihoods.append(hmm.log_likelihood(model, ids, counts).sum())
        sums = hmm.expected(model, ids, counts)
        assert np.isclose(sums[3].sum(), counts.sum(), rtol=1e-3)
        model = hmm.improved(sums, shares / shares.sum())
    assert likelihoods == sorted(likelihoods) and likelihoods[-1] > likelihoods[0] + 100


def corpus(seed=4):
    rng = random.Random(seed)
    pools = [[f"{p}{i}ing" for i in range(60)] for p in ("en", "FR")]
    rows = []
    for i in range(150):
        pool = rng.choice(pools)
        rows.append((i, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 120)))))
    return rows + [(200, None), (201, ""), (202, "never seen words élan"), (203, " ".join(rng.choices(pools[0], k=4000)))]


def test_base_and_model_scores(spark, make):
    rows = corpus()
    folder = shared_dir(spark, "test")
    make(rows).write.parquet(f"{folder}/documents.parquet")
    found = {r["doc_id"]: r for r in hmm.op8_lm_scoring(spark, folder).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
    tokens = {i: [w.decode() for w in (t or "").encode().lower().split()] + ["</s>"] for i, t in rows}
    counts = Counter(w for i in tokens if not held[i] for w in tokens[i])
    n, v = sum(counts.values()), len(counts)
    assert len(found) == len(rows)
    better = 0
    for i, own in tokens.items():
        r = found[i]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (
            held[i], len(own), sum(counts[w] > 0 for w in own), n)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["score"] < 0
        better += r["score"] > r["base_score"]
    assert better > 0.8 * len(rows)


def test_empty_and_untrained(spark, make):
    from pyspark.sql import functions as F
    assert hmm.score(make([]), F.lit(False)).count() == 0
    r = hmm.score(make([(1, "a b")]), F.lit(True)).collect()[0]
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (3, 0, 0, 0.0)
