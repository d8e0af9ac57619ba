import hashlib
import random

from tallyzone.llm import fingerprints as fp


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def test_edit_distances():
    rng = random.Random(1)
    word = lambda: bytes(rng.choices(b"ABCD", k=rng.choice([0, 1, 3, 20, 63, 64])))
    pairs = [(word(), word()) for _ in range(300)]
    got = fp.edit_distances([a for a, _ in pairs], [b for _, b in pairs])
    assert got.tolist() == [plain_distance(a, b) for a, b in pairs]


def test_local_edits_change_few_pieces():
    rng = random.Random(2)
    text = " ".join(f"w{rng.randrange(5000)}" for _ in range(2000))
    other = " ".join(f"v{rng.randrange(5000)}" for _ in range(2000))
    own = fp.fingerprint(text)
    assert all(len(s) <= 64 for s in own.split(":")[1:])
    assert fp.likeness([(own, fp.fingerprint(text[:5000] + "EDIT" + text[5000:]))])[0] > 0.9
    assert fp.likeness([(own, fp.fingerprint(other))])[0] < 0.3
    assert fp.likeness([(own, own), ("2:::", "2:::")]).tolist() == [1.0, 1.0]


def test_neighbours_match_one_pass(spark, make):
    rng = random.Random(3)
    prose = lambda n: " ".join(rng.choice(["été", "word", "ing", "x", "日本"]) + str(rng.randrange(99))
                               for _ in range(n))
    rows = [(i * 3, prose(rng.randint(0, 300))) for i in range(80)]
    rows += [(7, None), (8, ""), (10, "a"), (11, "ab"), (1000, prose(20_000)), (13, "same"), (14, "same")]
    found = {r["doc_id"]: r for r in fp.neighbours(make(rows)).collect()}
    order = sorted(rows, reverse=True, key=lambda r: r[0])
    assert len(found) == len(rows)
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        t, after = t or "", after or ""
        body = fp.edited(t, after)
        own = [fp.fingerprint(x) for x in (t, body, after)]
        want = (i, len(t), hashlib.sha256(body.encode()).hexdigest(), own[0], own[1],
                fp.likeness([(own[0], own[1])])[0], fp.likeness([(own[0], own[2])])[0])
        assert tuple(found[i]) == want
    assert fp.edited("abcde", "xyz") == "abcxy" and fp.edited("abcdef", "x") == "abcx"


def test_few_rows_and_repeats(spark, make):
    assert fp.neighbours(make([])).count() == 0
    only = fp.neighbours(make([(4, "abcd")])).collect()
    assert [(r["doc_id"], r["near_next"], r["n_chars"]) for r in only] == [(4, 1.0, 4)]
    assert only[0]["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()
    again = fp.neighbours(make([(4, "abcd"), (4, "abcd"), (None, "x")])).collect()
    assert sorted(str(r["doc_id"]) for r in again) == ["4", "4", "None"]


def test_rows_of_one_id_are_dealt_over_partitions(spark, make):
    from pyspark.sql import functions as F

    from tallyzone.llm import fingerprints as F9

    for rows in ([(7, "same")] * 4000, [(None, f"text {i}") for i in range(4000)]):
        docs = make(rows).repartition(8)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            parts = F9.dealt(docs).groupBy(F.spark_partition_id().alias("p")).count().collect()
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", "true")
        assert len(parts) == 8 and max(r["count"] for r in parts) < 1000
        assert F9.neighbours(docs).count() == 4000


def plain_fingerprint(text):
    """Piecewise hashing one byte at a time, on plain integers."""
    data, mask = text.encode(), (1 << 64) - 1
    if not data:
        return "2:::"

    def rolling(i):
        b = [data[j] + 1 if j >= 0 else 0 for j in range(i - 7, i + 1)]
        for factor in (0x01000193, 0x85EBCA6B, 0xC2B2AE35):
            b = [(x * factor + y) & 0xFFFFFFFF for x, y in zip(b[::2], b[1::2])]
        x = b[0] ^ b[0] >> 15
        x = x * 0x2C1B3C6D & 0xFFFFFFFF
        return x ^ x >> 13

    hashes = [rolling(i) for i in range(len(data))]
    ends = lambda k: [i for i, x in enumerate(hashes) if x % (1 << k) == 0]
    k = next(k for k in range(2, 40) if len(ends(k)) < 64)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    signatures = []
    for level in (k, k + 1, k + 2):
        signature, value, power = "", 0, 0x9E3779B97F4A7C15
        stops = set(ends(level)) | {len(data) - 1}
        for i, byte in enumerate(data):
            value, power = (value + byte * power) & mask, power * 0x9E3779B97F4A7C15 & mask
            if i in stops:
                value = (value ^ value >> 29) * 0xBF58476D1CE4E5B9 & mask
                signature += letters[value >> 58]
                value, power = 0, 0x9E3779B97F4A7C15
        signatures.append(signature)
    return ":".join([str(k), *signatures])


def test_fingerprints_match_hashing_byte_by_byte():
    rng = random.Random(8)
    texts = ["", "a", "ab", "été", "x" * 500, "\x00" * 20, "日本語 " * 90]
    texts += [" ".join(f"w{rng.randrange(400)}é" for _ in range(rng.randint(1, 900))) for _ in range(25)]
    assert [fp.fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]
