import math
import random

import numpy as np

from tallyzone.llm import langid

WORDS = {"en": "the of and that with this from which have been".split(),
         "fr": "le les des est une dans pour que avec être".split()}


def corpus(n, seed=1):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choices(WORDS[lang], k=rng.randint(3, 60))), lang)
            for i, lang in enumerate(rng.choices(["en", "fr"], k=n))]


def test_held_out_accuracy_and_edge_cases(spark, make):
    rows = corpus(300)
    docs = make(rows + [(900, None), (901, ""), (902, "12 !?"), (903, "the " * 200_000), (904, "été", None)])
    model = langid.fit(langid.training_rows(docs))
    found = {r["id"]: r for r in langid.predict(docs, model).collect()}
    right = sum(found[i]["lang_pred"] == lang for i, _, lang in rows)
    assert right / len(rows) > 0.97
    for i in (900, 901, 902):
        assert (found[i]["lang_pred"], found[i]["score"], found[i]["rejected"]) == ("und", 0.0, True)
    assert found[903]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in found.values())
    kept = langid.keep_known(docs, model)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert ids == {i for i, r in found.items() if not r["rejected"]} and len(ids) > 290


def test_without_rows_or_labels(spark, make):
    empty = make([])
    assert langid.fit(empty) is None and langid.predict(empty, None).count() == 0
    assert [r["lang_pred"] for r in langid.predict(make([(1, "the", None)]), None).collect()] == ["und"]


def test_scores_match_a_plain_average_of_subwords():
    rng = random.Random(4)
    rows = corpus(200, seed=5)
    model = langid.train([(i, lang, text) for i, text, lang in rows])
    bodies = [text for _, text, _ in rows[:30]] + ["Été à la PLAGE", "x", "日本語 the", "of " * 5000, "les les 12 !?"]
    rng.shuffle(bodies)
    pred, score, rejected = langid.Judge(model)(bodies)
    for body, lang, p, out in zip(bodies, pred, score, rejected):
        total, n = np.zeros(len(model.langs)), 0
        for word in body.lower().encode().split():
            padded = b"<" + word + b">"
            for size in (1, 2, 3, 4):
                for at in range(len(padded) - size + 1):
                    code = size
                    for byte in padded[at:at + size]:
                        code = (code * 257 + byte) % (1 << 64)
                    bucket = (code * 0x9E3779B97F4A7C15 % (1 << 64)) >> 48
                    total, n = total + model.weights[bucket].astype(float), n + 1
        logits = [(t / n + b) / model.temperature for t, b in zip(total, model.bias)]
        odds = [math.exp(x - max(logits)) for x in logits]
        assert lang == model.langs[odds.index(max(odds))]
        assert abs(p - max(odds) / sum(odds)) < 1e-4 and bool(out) == bool(p < model.threshold)
