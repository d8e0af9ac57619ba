import random

from tallyzone.llm import secrets
from tallyzone.llm.common import shared_dir

PARTS = ["token = \"", "secret:", "API_KEY='", "passwd =", "AKIA", "ABCDEFGHIJKLMNOPQRST", "0123456789abcdef",
         "deadbeef", " ", "\n", "é", "token=token:abcdefgh", "ſecret=abcdefgh", "Bearer abcdefghijklmnopqrstuvwx",
         "-----BEGIN RSA PRIVATE KEY-----", "ghp_abcdefghijklmnop1234", "x"]


def random_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choices(PARTS, k=rng.randint(0, 14))) for _ in range(n)]


def test_base_spans_match_plain_patterns(spark, make):
    bodies = [None, "", *random_texts(150), *random_texts(20)]
    docs = make([(i, t) for i, t in enumerate(bodies)])
    path = shared_dir(spark, "test")
    docs.write.parquet(f"{path}/documents.parquet")
    got = {r["doc_id"]: r for r in secrets.op1_secret_scans(spark, path).collect()}
    assert len(got) == len(bodies)
    for i, t in enumerate(bodies):
        assert (got[i]["n_assign"], got[i]["n_access"], got[i]["n_hex"], got[i]["base_sha256"]) == secrets.base_digest(t)
        assert got[i]["spans"] == ",".join(f"{k}:{a}:{b}" for a, k, b in secrets.find(t or ""))


def test_second_scan_reads_only_unseen_blobs(spark, make):
    ledger = shared_dir(spark, "ledger")
    first = make([(1, "token = abcdefgh"), (2, "token = abcdefgh"), (3, None)])
    assert secrets.scan(first, ledger).count() == 3
    assert secrets.read_ledger(spark, ledger).count() == 2
    again = make([(7, "token = abcdefgh"), (8, "nothing")])
    found = {r["path"]: len(r["findings"]) for r in secrets.scan(again, ledger).collect()}
    assert found == {7: 1, 8: 0}
    assert secrets.read_ledger(spark, ledger).count() == 3


def test_redaction(spark, make):
    bodies = [None, "", "é token = abcdefgh tail", *random_texts(60, 3)]
    docs = make([(i, t) for i, t in enumerate(bodies)])
    out = secrets.redact(docs, shared_dir(spark, "ledger"))
    assert out.columns == docs.columns
    for r in out.collect():
        want = bodies[r["doc_id"]] and secrets.replace_spans(bodies[r["doc_id"]])
        assert r["text"] == want and r["n_chars"] == (None if want is None else len(want))


def test_empty(spark, make):
    assert secrets.redact(make([]), shared_dir(spark, "ledger")).count() == 0


def test_a_blob_twice_in_the_ledger_counts_once(spark, make):
    ledger = shared_dir(spark, "ledger")
    docs = make([(1, "token = abcdefgh"), (2, "token = abcdefgh")])
    assert secrets.scan(docs, ledger).count() == 2
    secrets.read_ledger(spark, ledger).write.mode("append").parquet(ledger + "-copy")
    spark.read.parquet(ledger + "-copy").write.mode("append").parquet(ledger)  # as a second scan at the same time would
    assert sorted(r["path"] for r in secrets.scan(docs, ledger).collect()) == [1, 2]


def test_empty_table_and_very_long_text(spark, make):
    assert secrets.scan(make([]), shared_dir(spark, "ledger")).count() == 0
    long = "word " * 400_000 + "token = abcdefgh"
    (row,) = secrets.scan(make([(1, long)]), shared_dir(spark, "ledger")).collect()
    assert [(f["kind"], f["start"], f["end"]) for f in row["findings"]] == [("assign", 2_000_000, 2_000_016)]
