"""Quality classifier: a sparse ensemble of rules.

Statistics of a text (shares of character kinds, lengths, repetition) are
columns of a table. Small trees are boosted on them; every path from a root
to a node is a rule, a conjunction of comparisons; an L1-penalised logistic
regression over rules and standardised statistics keeps few of them. The
kept ones are compiled into one Spark column expression, which scores all
rows on the JVM.

The fit uses a bounded sample of labelled rows (``SAMPLE``); statistics and
scores cover every row.

Defined results: a null text is the empty text, whose statistics are zero
and which is scored like any other; a text of any length is counted whole; a
score of just 0.5 is the better class; repeated rows are kept; rows that share
an id with several labels train with each; without labels, or with one
class, every score is the share of good labels (0.5 without any); an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyzone.llm.common import crc_remainder, mapped, read_table, slices, stored, texts, utf8

#: Most labelled rows that the fit looks at.
SAMPLE = 20_000
STATISTICS = ("log_chars", "words", "word_length", "upper", "digit", "space", "high", "mark", "end_mark", "symbol",
              "bar", "top_symbol", "distinct", "top_word", "lines", "repeated_lines", "one_letter", "marked_words")
KINDS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "space": b" \t\n\r\x0b\x0c",
         "high": bytes(range(128, 256)), "mark": b",;:'\"-()", "end_mark": b".!?",
         "symbol": b"#$%&*+/<=>@[\\]^_`{}~", "bar": b"|"}
TABLE = np.zeros((256, len(KINDS)))
for _i, _bytes in enumerate(KINDS.values()):
    TABLE[list(_bytes), _i] = 1


def statistics(text: str) -> list[float]:
    data = utf8(text)
    if not data:
        return [0.0] * len(STATISTICS)
    histogram = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    shares = histogram @ TABLE / len(data)
    words = data.split()
    n = len(words)
    if not n:
        return [float(np.log1p(len(data))), 0.0, 0.0, *shares.tolist(), 0.0, *[0.0] * 6]
    counts = Counter(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    symbols = histogram[list(KINDS["symbol"] + KINDS["bar"] + b"!")]
    marked = sum(c for w, c in counts.items() if w[-1] in b"!#$%&*|" and len(w) > 1)
    return [float(np.log1p(len(data))), float(np.log1p(n)), sum(map(len, words)) / n, *shares.tolist(),
            float(symbols.max()) / n, len(counts) / n, max(counts.values()) / n, len(lines) / n,
            1 - len(set(lines)) / len(lines), sum(c for w, c in counts.items() if len(w) == 1) / n, marked / n]


def statistics_table(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, statistics) of every row."""
    def run(batches):
        for batch in slices(batches):
            values = np.array([statistics(t) for t in texts(batch)]).reshape(-1, len(STATISTICS))
            yield pa.record_batch({"id": batch.column("id"), **{s: values[:, i] for i, s in enumerate(STATISTICS)}})

    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return mapped(rows, run, f"id {kind}, " + ", ".join(f"{s} double" for s in STATISTICS))


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above, threshold)


def paths(x: np.ndarray, gradient: np.ndarray, depth: int, least: int, cuts: list[np.ndarray],
          rows: np.ndarray, path: Rule = ()) -> tuple[list[Rule], list[tuple[np.ndarray, float]]]:
    """All paths of one regression tree on the gradient, and its leaves (rows, value)."""
    best, total = None, gradient[rows].sum()
    if depth and len(rows) >= 2 * least:
        base = total ** 2 / len(rows)
        for j, own in enumerate(cuts):
            if not len(own):
                continue
            bins = np.searchsorted(own, x[rows, j], side="left")
            count = np.cumsum(np.bincount(bins, minlength=len(own) + 1))[:-1]
            part = np.cumsum(np.bincount(bins, weights=gradient[rows], minlength=len(own) + 1))[:-1]
            fits = (count >= least) & (len(rows) - count >= least)
            if fits.any():
                gain = np.where(fits, part ** 2 / np.maximum(count, 1)
                                + (total - part) ** 2 / np.maximum(len(rows) - count, 1) - base, -1)
                k = int(gain.argmax())
                if gain[k] > 1e-9 and (best is None or gain[k] > best[0]):
                    best = (gain[k], j, own[k])
    if best is None:
        return [], [(rows, total / max(len(rows), 1))]
    _, j, cut = best
    low = x[rows, j] <= cut
    rules, leaves = [], []
    for above, own in ((False, rows[low]), (True, rows[~low])):
        here = (*path, (j, above, float(cut)))
        more, ends = paths(x, gradient, depth - 1, least, cuts, own, here)
        rules += [here, *more]
        leaves += ends
    return rules, leaves


def candidate_rules(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, seed: int = 5) -> list[Rule]:
    """Distinct rules of boosted trees, each grown on half of the rows."""
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.02, 0.98, 49))) for j in range(x.shape[1])]
    margin, rules = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), {}
    for _ in range(trees):
        gradient = y - 1 / (1 + np.exp(-margin))
        rows = rng.permutation(len(y))[:max(2, len(y) // 2)]
        own, leaves = paths(x, gradient, depth, max(5, len(rows) // 500), cuts, np.sort(rows))
        rules |= dict.fromkeys(own)
        fired = np.zeros(len(y))
        for (r, value), rule in zip(leaves, leaf_rules(own, leaves, x)):
            fired[holds(rule, x)] = value
        margin += 2.0 * fired
    return list(rules)


def leaf_rules(rules: list[Rule], leaves: list, x: np.ndarray) -> list[Rule]:
    """The rules that are leaves, in the leaves' order."""
    inner = {r[:-1] for r in rules}
    return [r for r in rules if r not in inner] or [()] * len(leaves)


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, above, cut in rule:
        out &= (x[:, j] > cut) == above
    return out


@dataclass
class Model:
    bias: float
    rules: list[tuple[Rule, float]] = field(default_factory=list)
    linear: list[tuple[int, float, float, float, float]] = field(default_factory=list)  # j, low, high, mean, weight

    def expression(self) -> Column:
        """The score as a column over the statistics."""
        margin = F.lit(float(self.bias))
        for rule, weight in self.rules:
            test = F.lit(True)
            for j, above, cut in rule:
                column = F.col(STATISTICS[j])
                test = test & ((column > cut) if above else (column <= cut))
            margin = margin + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
        for j, low, high, mean, weight in self.linear:
            bounded = F.least(F.greatest(F.col(STATISTICS[j]), F.lit(low)), F.lit(high))
            margin = margin + F.lit(weight) * (bounded - F.lit(mean))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The same in numpy (for tests)."""
        margin = np.full(len(x), self.bias)
        for rule, weight in self.rules:
            margin += weight * holds(rule, x)
        for j, low, high, mean, weight in self.linear:
            margin += weight * (np.clip(x[:, j], low, high) - mean)
        return 1 / (1 + np.exp(-margin))


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 0.002, steps: int = 400) -> Model:
    """Rules, then lasso logistic weights by accelerated proximal gradient."""
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.5
        return Model(float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    rules = candidate_rules(x, y.astype(float))
    tests = np.column_stack([holds(r, x) for r in rules] or [np.zeros((len(x), 0))]).astype(float)
    support = tests.mean(axis=0)
    kept = (support > 0.002) & (support < 0.998)
    rules, tests, support = [r for r, k in zip(rules, kept) if k], tests[:, kept], support[kept]
    low, high = np.quantile(x, [0.01, 0.99], axis=0)
    clipped = np.clip(x, low, high)
    mean, spread = clipped.mean(axis=0), clipped.std(axis=0)
    spread = np.where(spread > 1e-12, spread, np.inf)
    width = np.concatenate([np.sqrt(support * (1 - support)), spread / 0.4])
    design = np.column_stack([tests - support, clipped - mean]) / width
    rate = 4 * len(y) / max(np.linalg.norm(design, 2) ** 2, 1e-9)
    weight, ahead, momentum = np.zeros(design.shape[1]), np.zeros(design.shape[1]), 1.0
    bias = float(np.log(y.mean() / (1 - y.mean())))
    for _ in range(steps):
        error = 1 / (1 + np.exp(-(design @ ahead + bias))) - y
        bias -= 2 * error.mean()
        step = ahead - rate * (design.T @ error) / len(y)
        new = np.sign(step) * np.maximum(np.abs(step) - rate * penalty, 0)
        following = (1 + np.sqrt(1 + 4 * momentum ** 2)) / 2
        ahead, weight, momentum = new + (momentum - 1) / following * (new - weight), new, following
    weight = weight / width
    n = len(rules)
    model = Model(bias - float(support @ weight[:n]))
    model.rules = [(r, float(w)) for r, w in zip(rules, weight[:n]) if w]
    model.linear = [(j, float(low[j]), float(high[j]), float(mean[j]), float(w))
                    for j, w in enumerate(weight[n:]) if w]
    return model


def train(table: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled rows of the statistics table, by hash of the id.

    A share of the ids is chosen first, about as many as the bound, so tasks send little more than what is used.
    """
    label = F.col("quality").cast("int")
    labelled = labels.select(F.col("doc_id").alias("id"), label.alias("y")).where("y in (0, 1)")
    share = min(1.0, 1.2 * sample / max(1, labelled.count()))
    place = F.xxhash64("id", F.lit(1))
    chosen = labelled.where(F.pmod(place, F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    rows = table.join(chosen, "id").orderBy(place, "id", "y").limit(sample).toArrow()
    x = np.column_stack([rows.column(s).to_numpy() for s in STATISTICS])
    return fit(x, rows.column("y").to_numpy().astype(int))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned where crc32(doc_id) mod 3 is not 1."""
    table = stored(statistics_table(read_table(spark, sf_dir, "documents")), "statistics")
    model = train(table, read_table(spark, sf_dir, "labels").where(crc_remainder("doc_id", 3) != 1))
    held = F.coalesce(crc_remainder("id", 3) == 1, F.lit(False))
    scored = table.select(F.col("id").alias("doc_id"), held.alias("held_out"), model.expression().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
