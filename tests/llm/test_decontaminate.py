import random

import numpy as np

from tallyzone.llm import decontaminate


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    common = ["the", "of", "and", "to"]

    def prose(n):
        return " ".join(rng.choice(common) if rng.random() < 0.4 else rng.choice(vocabulary) for _ in range(n))

    items = [(i, prose(rng.randint(12, 60)) + ". " + prose(8) + ".") for i in range(30)]
    rows, planted = [], set()
    for d in range(200):
        text = prose(rng.randint(5, 400))
        if d % 10 == 0:
            item = rng.randrange(30)
            passage = items[item][1].split()
            if d % 20 == 0:  # a paraphrase: a tenth of the words replaced
                passage = [rng.choice(vocabulary) if rng.random() < 0.1 else w for w in passage]
            words = text.split()
            at = rng.randrange(len(words))
            text = " ".join(words[:at] + [w.upper() for w in passage] + words[at:])
            planted.add((d, item))
        rows.append((d, text))
    return rows, items, planted


def test_planted_passages_are_found_and_clean_ones_left(spark, make):
    rows, items, planted = corpus()
    docs = make(rows + [(900, None), (901, ""), (902, "!!! ...")])
    bench = spark.createDataFrame(items + [(99, None), (98, "..")], "item_id long, text string")
    found = {(r["id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()}
    assert found == planted
    kept = decontaminate.keep_clean(docs, bench)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r[0] for r in rows} - {d for d, _ in planted} | {900, 901, 902}


def test_empty_tables(spark, make):
    bench = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(make([]), bench).count() == 0
    assert decontaminate.contaminated(make([(1, "a")]), none).count() == 0


def test_lcs_matches_dynamic_programming():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a, b = rng.integers(0, 6, rng.integers(1, 30)), rng.integers(0, 6, rng.integers(0, 40))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        assert decontaminate.lcs(a, b) == table[-1, -1]


def test_exact_copies_of_every_length_are_found(spark, make):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(200)]
    items = [(n, " ".join(rng.choice(vocabulary) for _ in range(n))) for n in range(24, 64)]
    other = lambda n: " ".join(f"x{rng.randrange(10**9)}" for _ in range(n))
    rows = [(n, f"{other(rng.randint(70, 90))} {text} {other(rng.randint(70, 90))}") for n, text in items]
    rows += [(100 + i, " ".join(rng.choice(vocabulary) for _ in range(60))) for i in range(100)]
    found = decontaminate.contaminated(make(rows), spark.createDataFrame(items, "item_id long, text string"))
    assert {(n, n) for n, _ in items} <= {(r["id"], r["item_id"]) for r in found.collect()}


def test_an_item_copied_into_a_third_of_short_documents(spark, make):
    rng = random.Random(5)
    item = " ".join(f"c{i}" for i in range(36))
    other = lambda n: " ".join(f"x{rng.randrange(10**9)}" for _ in range(n))
    items = [(0, item), (1, other(30)), (2, other(40)), (3, "brief one")]
    rows = [(i, f"{other(15)} {item} {other(15)}" if i % 3 == 0 else other(55)) for i in range(300)]
    rows += [(900, f"{other(40)} {items[1][1]}"), (901, f"{other(9)} brief one {other(90)}"), (902, "brief " + other(9))]
    found = decontaminate.contaminated(make(rows), spark.createDataFrame(items, "item_id long, text string"))
    want = {(i, 0) for i in range(0, 300, 3)} | {(900, 1), (901, 3)}
    assert {(r["id"], r["item_id"]) for r in found.collect()} == want


def test_paraphrases_by_rare_words_are_found_as_by_brute_force(spark, make):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(1500)]
    prose = lambda n: [rng.choice(vocabulary[:40] if rng.random() < 0.4 else vocabulary) for _ in range(n)]
    items = [(i, " ".join(prose(rng.randint(20, 60)))) for i in range(150)]  # more than dimensions
    rows = []
    for d in range(240):
        share, own = (0.1, 0.2, 0.25, 0.3)[d % 4], items[rng.randrange(150)][1].split()
        new = [f"x{rng.randrange(10**9)}" if rng.random() < share else w for w in own]
        if d % 8 == 2:  # no four words in a row
            new = [f"x{rng.randrange(10**9)}" if i % 4 == 3 else w for i, w in enumerate(own)]
        rows.append((d, " ".join(prose(rng.randint(0, 150)) + new + prose(rng.randint(0, 150)))))
    bench = decontaminate.Benchmark.read(items)
    want = set()
    for d, text in rows:
        words = decontaminate.hash_words(text.encode().split())[0]
        for i in range(150):
            a, b = decontaminate.ratios(bench, i, words)
            if a >= decontaminate.LCS and b >= decontaminate.ANSWER:
                want.add((d, i))
    found = decontaminate.contaminated(make(rows), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r["id"], r["item_id"]) for r in found.collect()}
    assert len(want) > 120 and got <= want and len(got) >= 0.95 * len(want)


def test_merged_places_and_words_shared():
    rng = np.random.default_rng(4)
    doc, item, begin = (rng.integers(0, n, 200) for n in (3, 4, 30))
    begin, cos = begin + 40 * doc, rng.random(200)
    end = begin + rng.integers(1, 5, 200)
    want = []
    for d, i, a, b, c in sorted(zip(doc, item, begin, end, cos)):
        if want and want[-1][:2] == [d, i] and a <= want[-1][3]:
            want[-1][3:] = [max(b, want[-1][3]), max(c, want[-1][4])]
        else:
            want.append([d, i, a, b, c])
    assert [list(x) for x in zip(*decontaminate.merged(doc, item, begin, end, cos))] == want
    items, terms = [rng.integers(0, 9, n) for n in (4, 7, 12)], np.arange(9)
    text = rng.integers(0, 9, 50)
    of, a = rng.integers(0, 3, 60), rng.integers(0, 40, 60)
    b = a + rng.integers(0, 10, 60)
    got = decontaminate.words_shared(decontaminate.item_terms(items, terms), 9, of, a, b, text)
    assert got.tolist() == [int(np.isin(items[i], text[x:y]).sum()) for i, x, y in zip(of, a, b)]


def test_counts_of_terms_in_one_bucket_and_the_benchmark_rows(spark, make):
    terms = np.sort(np.array([5, 5 + (1 << 18), 9], np.uint32))
    words = spark.createDataFrame([(1, [5] * 70), (2, [5, 9]), (3, [5 + (1 << 18), 7])], "id long, words array<int>")
    counts, passages = decontaminate.document_counts(words, terms, 64)
    assert counts.tolist() == [3, 1, 1] and passages == 4
    rng = np.random.default_rng(6)
    items = [rng.choice(terms, n) for n in (3, 8)]
    test, weights = rng.normal(size=(3, 2)), np.array([1, 2, 0.5])
    dense = np.array([[(w == t).sum() for t in terms] for w in items]) * weights
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    got = decontaminate.stacked_rows(items, terms, weights, test)
    assert np.allclose(got, dense.T @ dense @ test)


def plain(text: str) -> list[str]:
    """Words of a text as the docstring has them, one by one."""
    words = [decontaminate.regex.sub(r"[^\p{L}\p{N}]", "", w.lower()) for w in decontaminate.regex.split(r"[ \t-\r]+", text)]
    return [w for w in words if w]


def test_hashes_are_those_of_the_plain_words():
    rng = random.Random(9)
    signs = "aAbBzZ09 \t\n,.-'\"  éÉİΣσß中\U0001f600\ud800́"
    rows = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    rows += ["", "x" * (1 << 19), "Word " * 120_000, "ΣΑΣ σας"]
    hashes, counts = decontaminate.plain_hashes(rows)
    want = [plain(t) for t in rows]
    assert counts.tolist() == [len(w) for w in want]
    of = {}
    for word, h in zip((w for x in want for w in x), hashes.tolist()):
        assert of.setdefault(word, h) == h
    assert len(set(of.values())) == len(of) and 0 not in of.values()


def test_running_sums_and_segments():
    rng = np.random.default_rng(1)
    for n in (0, 1, 15, 16, 17, 300):
        x = rng.normal(size=(n, 3)).astype(np.float32)
        want = np.concatenate([np.zeros((1, 3)), np.cumsum(x.astype(float), axis=0)])
        assert np.allclose(decontaminate.running_sums(x), want)
    counts = rng.integers(0, 200, 40)
    at, flat = np.concatenate([[0], np.cumsum(counts)]), np.arange(counts.sum())
    seen = {}
    for rows, words, edges in decontaminate.segments(flat, at, 10, most=50):
        for k, row in enumerate(rows):
            seen.setdefault(row, []).append(words[edges[k]:edges[k + 1]].tolist())
    for row, (a, b) in enumerate(zip(at, at[1:])):
        parts = seen.get(row, [])
        assert sorted({w for p in parts for w in p}) == list(range(a, b))
        for start in range(a, max(a, b - 9)):
            assert any(set(range(start, min(b, start + 10))) <= set(p) for p in parts)


def test_blocks_of_the_benchmark_long_texts_repeats_and_odd_columns(spark):
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(2000)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, prose(rng.randint(10, 50))) for i in range(24)]
    rows = [(i, f"{prose(80)} {items[i][1]} {prose(80)}", i) for i in range(24)]
    long = prose(60_000).split()
    long[16_380:16_380] = items[3][1].split()  # over the edge of a segment
    long[50_000:50_000] = items[7][1].split()
    rows += [(100, " ".join(long), 0), (100, " ".join(long), 0), (101, None, 0), (102, prose(300), 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(i, t, "x") for i, t in items] + [(0, items[0][1], "x"), (None, None, "x")],
                                  "item_id smallint, text string, cosine string")
    want = sorted([(i, i) for i in range(24)] + 2 * [(100, 3), (100, 7)])
    for size in (decontaminate.ITEMS, 5):
        found = decontaminate.contaminated(docs, bench, items=size)
        assert sorted((r["id"], r["item_id"]) for r in found.collect()) == want
    assert sorted(r["doc_id"] for r in decontaminate.keep_clean(docs, bench).collect()) == [101, 102]
    blocks = list(decontaminate.benchmark_blocks(bench, 5))
    assert len(blocks) == 5 and sum(map(len, blocks)) == 25
