import random
import zlib

import numpy as np

from tallyzone.llm import quality
from tallyzone.llm.common import shared_dir


def corpus(n=400, seed=6):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.8
        words = [rng.choice(["the", "word", "éte", "Again", "running", "of"]) + str(rng.randrange(20))
                 for _ in range(rng.randint(3, 200))]
        if not good:
            kind = rng.randrange(3)
            words = [w + "&&&" for w in words] if kind == 0 else (
                [w.upper() + "!!" for w in words] if kind == 1 else [x for w in words for x in (w, "|")])
        rows.append((i, " ".join(words) + "."))
        labels.append((i, int(good), 0))
    return rows, labels


def test_held_out_accuracy_and_compiled_scores(spark, make):
    rows, labels = corpus()
    folder = shared_dir(spark, "test")
    make(rows + [(900, None), (901, ""), (902, " \n"), (903, "x" * 300_000)]).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels + [(7777, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int").write.parquet(
        f"{folder}/labels.parquet")
    found = {r["doc_id"]: r for r in quality.op5_quality_classifier(spark, folder).collect()}
    assert len(found) == len(rows) + 4
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(found[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in found)
    right = sum(found[i]["predicted"] == labels[i][1] for i in held)
    assert right / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found.values())

    table = quality.statistics_table(make(rows))
    model = quality.train(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert 0 < len(model.rules) < 200
    pdf = table.withColumn("score", model.expression()).toPandas()
    assert np.allclose(pdf["score"], model.scores(pdf[list(quality.STATISTICS)].to_numpy()))


def test_one_class_and_none(spark, make):
    table = quality.statistics_table(make([(1, "a b"), (2, "c")]))
    schema = "doc_id long, quality int, toxic int"
    for labels in ([], [(1, 1, 0), (2, 1, 0)]):
        model = quality.train(table, spark.createDataFrame(labels, schema))
        assert not model.rules and 0 <= table.select(model.expression()).first()[0] <= 1
    assert quality.statistics_table(make([])).count() == 0


def plain_statistics(text):
    """The statistics counted one character at a time."""
    data = text.encode()
    words, lines = data.split(), [x for x in data.split(b"\n") if x.strip()]
    share = lambda kind: sum(c in kind for c in data) / len(data)
    n, symbols = len(words), b"#$%&*+/<=>@[\\]^_`{}~|!"
    most = max(words.count(w) for w in words)
    return {
        "log_chars": np.log1p(len(data)), "words": np.log1p(n), "word_length": sum(len(w) for w in words) / n,
        "upper": share(range(65, 91)), "digit": share(b"0123456789"), "space": share(b" \t\n\r\x0b\x0c"),
        "high": share(range(128, 256)), "mark": share(b",;:'\"-()"), "end_mark": share(b".!?"),
        "symbol": share(b"#$%&*+/<=>@[\\]^_`{}~"), "bar": share(b"|"),
        "top_symbol": max(data.count(s) for s in symbols) / n, "distinct": len(set(words)) / n, "top_word": most / n,
        "lines": len(lines) / n, "repeated_lines": 1 - len(set(lines)) / len(lines),
        "one_letter": sum(len(w) == 1 for w in words) / n,
        "marked_words": sum(len(w) > 1 and w[-1] in b"!#$%&*|" for w in words) / n}


def test_statistics_match_plain_counts(spark, make):
    rng = random.Random(9)
    pieces = ["the", "été", "A!", "||", "x", "#tag#", "12,5%", "don't", "\n", "\n\n", "\t", "END.", "same line here\n", "日本"]
    rows = [(i, "w " + " ".join(rng.choices(pieces, k=rng.randint(1, 120)))) for i in range(60)]
    found = {r["id"]: r for r in quality.statistics_table(make(rows)).collect()}
    for i, text in rows:
        want = plain_statistics(text)
        assert list(want) == list(quality.STATISTICS)
        assert np.allclose([found[i][s] for s in want], list(want.values()), atol=1e-12), (text, want)
