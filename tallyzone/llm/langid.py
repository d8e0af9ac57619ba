"""Language ID: averaged hashed subword embeddings with a linear softmax.

A text is its lower-cased words; a word has the byte n-grams of ``<word>``,
hashed to ``BUCKETS`` embeddings. The text's vector is the average over all
subwords of all its words, and a linear softmax gives the language. Both are
trained by stochastic gradient descent in numpy on windows drawn from the whole
texts of a bounded, stratified sample of labelled rows; a temperature and a rejection threshold are fitted
on a part of the sample that the training doesn't see.

Defined results: a null text, or one without a letter, is ``und`` with score
0 and is rejected; every other text gets a learned language; repeated rows
are kept; an empty table gives no rows; without any labelled row all texts
are ``und``; texts of any length are read whole; of equally likely languages the
first by name wins; other columns of the input are ignored.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyzone.llm.common import (Words, crc_remainder, mapped, read_table, ship, slices, starts, texts, tidy,
                                  utf8)

BUCKETS, DIM, SIZES = 1 << 16, 16, (1, 2, 3, 4)
#: Bound of the training sample: rows of a language (expected). Words that a worker keeps at hand.
SAMPLE_ROWS, CACHED_WORDS = 1500, 150_000
#: Part of the sample's correct rows that the rejection may lose.
REJECT_RATE = 0.0005
LETTER = regex.compile(r"\p{L}")


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # BUCKETS x langs: embedding times softmax weights
    bias: np.ndarray
    temperature: float
    threshold: float


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every subword of every word, and the word it belongs to (in order)."""
    padded = [b"<" + w + b">" for w in words]
    body = np.frombuffer(b"".join(padded), np.uint8).astype(np.uint64)
    of = np.repeat(np.arange(len(words)), [len(w) for w in padded])
    buckets, owners = [], []
    for n in SIZES:
        if len(body) < n:
            continue
        code = np.full(len(body) - n + 1, n, np.uint64)
        for j in range(n):
            code = code * np.uint64(257) + body[j:len(body) - n + 1 + j]
        inside = of[:len(code)] == of[n - 1:]
        hashed = (code[inside] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
        buckets.append((hashed & np.uint64(BUCKETS - 1)).astype(np.int64))
        owners.append(of[:len(code)][inside])
    if not buckets:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(buckets)[order], owner[order]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def by_text(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of the rows of ``values`` over consecutive runs of ``counts`` rows."""
    out = np.zeros((len(counts), *values.shape[1:]), np.float64)
    full = counts > 0
    if full.any():
        out[full] = np.add.reduceat(values, starts(counts)[:-1][full], axis=0)
    return out


def drawn(body: str, key: int, most: int = 60, times: int = 2) -> list[str]:
    """Windows of 1 to ``most`` words from anywhere in a text, so that short texts are met too; the same for a key."""
    words, rng = utf8(body.lower()).split(), np.random.default_rng(key & 0xFFFFFFFF)
    out = []
    for _ in range(times if words else 0):
        n = int(rng.integers(1, most + 1))
        at = int(rng.integers(0, max(1, len(words) - n + 1)))
        out.append(b" ".join(words[at:at + n]).decode("utf-8", "replace"))
    return out


def train(windows: list[tuple[int, str, str]], epochs: int = 4, batch: int = 32, rate: float = 0.5,
          seed: int = 11) -> Model:
    """Fit on (key of the row, language, text) windows; a fifth of the rows is held back for calibration."""
    rng = np.random.default_rng(seed)
    langs = sorted({lang for _, lang, _ in windows})
    rows, y, fit = [], [], []
    for key, lang, text in sorted(windows):
        rows.append(subwords(utf8(text).split())[0])
        y.append(langs.index(lang))
        fit.append(key % 5 != 0)
    y, fit = np.array(y, np.int64), np.array(fit, bool)
    emb = rng.normal(0, 0.1, (BUCKETS, DIM))
    out, bias = np.zeros((DIM, len(langs))), np.zeros(len(langs))
    ids = np.flatnonzero(fit)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for part in np.array_split(rng.permutation(ids), max(1, len(ids) // batch)):
            if not len(part):
                continue
            counts = np.array([len(rows[i]) for i in part])
            flat = np.concatenate([rows[i] for i in part])
            mean = by_text(emb[flat], counts) / counts[:, None]
            error = softmax(mean @ out + bias)
            error[np.arange(len(part)), y[part]] -= 1
            back = (error @ out.T) / counts[:, None] * step
            out -= step * mean.T @ error / len(part) * 8
            bias -= step * error.mean(axis=0)
            order = np.argsort(flat, kind="stable")
            at = np.flatnonzero(np.diff(flat[order], prepend=-1))
            emb[flat[order][at]] -= np.add.reduceat(np.repeat(back, counts, axis=0)[order], at, axis=0) * 8
    weights = (emb @ out).astype(np.float32)
    model = Model(langs, weights, bias, 1.0, 0.0)
    check = np.flatnonzero(~fit) if (~fit).any() else ids
    if len(check):
        counts = np.array([len(rows[i]) for i in check])
        logits = by_text(weights[np.concatenate([rows[i] for i in check])], counts) / counts[:, None] + bias
        losses = {t: -np.log(softmax(logits / t)[np.arange(len(check)), y[check]] + 1e-12).mean()
                  for t in np.geomspace(0.02, 5, 40)}
        model.temperature = float(min(losses, key=losses.get))
        score = softmax(logits / model.temperature)
        right = score.argmax(axis=1) == y[check]
        if right.any():
            model.threshold = float(min(0.5, np.quantile(score.max(axis=1)[right], REJECT_RATE)))
    return model


def sample(docs: DataFrame, per_lang: int = SAMPLE_ROWS) -> list[tuple[int, str, str]]:
    """Windows of labelled rows for training: about ``per_lang`` rows of each language by hash of the id.

    The only place that looks at less than all rows; the bound keeps the
    driver's share the same at any size. Tasks draw the windows from whole
    texts, the driver gets no text beyond them.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = F.lit(False)
    for lang, n in sorted(counts.items()):
        chosen = chosen | ((F.col("lang") == lang) & (share < min(1.0, per_lang / n)))

    def draw(batches):
        for batch in slices(batches):
            out = [(key, lang, window) for key, lang, body in zip(
                batch.column("key").to_pylist(), batch.column("lang").to_pylist(), texts(batch))
                for window in drawn(body, key)]
            yield pa.record_batch({"key": pa.array([o[0] for o in out], pa.int64()),
                                   "lang": pa.array([o[1] for o in out], pa.string()),
                                   "text": pa.array([o[2] for o in out], pa.string())})

    asked = rows.where(chosen).select(F.xxhash64("doc_id", "text", F.lit(6)).alias("key"), "lang", "text")
    return [tuple(r) for r in mapped(asked, draw, "key long, lang string, text string").collect()]


def fit(docs: DataFrame) -> Model | None:
    """A model from the labelled rows of ``docs`` (doc_id, text, lang); None without any word to learn from."""
    windows = sample(docs)
    return train(windows) if windows else None


class Judge:
    """Languages, scores and rejections of lists of texts under one model."""

    def __init__(self, model: Model | None):
        self.model = model
        self.words = Words(lambda new: (word_logits(new, model),), most=CACHED_WORDS)

    def __call__(self, bodies: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        m = self.model
        pred, score, rejected = ["und"] * len(bodies), np.zeros(len(bodies)), np.ones(len(bodies), bool)
        if m is None or not bodies:
            return pred, score, rejected
        lists = [utf8(t.lower()).split() for t in bodies]
        (values,) = self.words([w for x in lists for w in x])
        sums = by_text(values, np.array([len(x) for x in lists], np.int64))
        p = softmax((sums[:, :-1] / np.maximum(sums[:, -1:], 1) + m.bias) / m.temperature)
        for i, body in enumerate(bodies):
            if LETTER.search(body):
                pred[i], score[i] = m.langs[int(p[i].argmax())], p[i].max()
                rejected[i] = score[i] < m.threshold
        return pred, score, rejected


def predict(docs: DataFrame, model: Model | None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, lang_pred, score, rejected) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        judge = Judge(shared.value)
        for batch in slices(batches):
            pred, score, rejected = judge(texts(batch))
            yield pa.record_batch({"id": batch.column("id"), "lang_pred": pa.array(pred, pa.string()),
                                   "score": score, "rejected": rejected})

    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return mapped(rows, run, f"id {kind}, lang_pred string, score double, rejected boolean")


def word_logits(new: list[bytes], model: Model) -> np.ndarray:
    """Of each word: the summed weights of its subwords by language, then their number."""
    out = np.zeros((len(new), len(model.langs) + 1), np.float32)
    bucket, owner = subwords(new)
    if len(bucket):
        counts = np.bincount(owner, minlength=len(new))
        out[:, :-1] = by_text(model.weights[bucket], counts)
        out[:, -1] = counts
    return out


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(crc_remainder("doc_id", 5) != 0)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned where crc32(doc_id) mod 5 is not 0."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = predict(docs, fit(training_rows(docs)))
    return found.select(F.col("id").alias("doc_id"), F.coalesce(crc_remainder("id", 5) == 0, F.lit(False)).alias("held_out"),
                        "lang_pred", "score", "rejected")


def keep_known(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` without the rows that ``model`` rejects, columns as they were."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def accepted(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        judge = Judge(shared.value)
        for bodies in series:
            parts = [judge(list(bodies.iloc[i:i + 500].fillna("")))[2] for i in range(0, len(bodies), 500)]
            yield pd.Series(~np.concatenate(parts) if parts else [], dtype=bool)
        tidy()

    return docs.where(accepted("text"))
