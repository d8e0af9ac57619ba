"""Secret scans with an incremental blob ledger.

Every version of every path is addressed by the SHA-256 of its text. The
ledger is a table of (blob, rule version) pairs with their findings; a scan
takes the distinct blobs of the input that the ledger does not have under
the current rules, scans each once, appends them, and joins findings back
to all paths that ever held the blob.

Defined results: a null text is the empty text; an empty text has no
findings; a text of any length is scanned whole; equal texts share one blob,
and a blob that two scans appended counts once; repeated rows are kept; an empty
table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyzone.llm.common import mapped, read_table, shared_dir, slices

RULE_VERSION = "1"

#: kind -> (pattern, accepts the match). The first three are the base kinds,
#: matched leftmost and without overlap within a kind; the rest are added.
RULES = {
    "assign": (re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
                          re.IGNORECASE | re.ASCII), lambda m: m.end(2) - m.start(2) >= 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: m.end() - m.start() >= 20),
    "hex": (re.compile(r"[0-9a-f]+"), lambda m: m.end() - m.start() >= 24),
    "pem": (re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"), lambda m: True),
    "jwt": (re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), lambda m: True),
    "vendor": (re.compile(r"(?:ghp_|gho_|ghs_|xoxb-|xoxp-|sk_live_)[A-Za-z0-9_-]{16,}"), lambda m: True),
    "bearer": (re.compile(r"[Bb]earer\x20+[A-Za-z0-9+/_.~-]{20,}"), lambda m: True),
}
BASE = ("assign", "access", "hex")
#: The same matches found faster: a run of hex digits that is too short can't be part of a longer one,
#: and a text without any of a kind's words (lower case) has no match of that kind.
FAST = RULES | {"hex": (re.compile(r"[0-9a-f]{24,}"), lambda m: True)}
GATES = {"assign": ("password", "passwd", "secret", "token", "apikey", "api_key"), "pem": ("private key",),
         "bearer": ("bearer",), "vendor": ("ghp_", "gho_", "ghs_", "xoxb-", "xoxp-", "sk_live_")}
FINDINGS = "array<struct<kind:string,start:int,end:int>>"


def find(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) in code points, by start, then kind as listed."""
    found, lowered = [], text.lower()
    for order, (kind, (pattern, accepts)) in enumerate(FAST.items()):
        if kind in GATES and not any(word in lowered for word in GATES[kind]):
            continue
        found += [(m.start(), order, kind, m.end()) for m in pattern.finditer(text) if accepts(m)]
    return [(start, kind, end) for start, _, kind, end in sorted(found)]


def paths(docs: DataFrame, path: str = "doc_id", text: str = "text") -> DataFrame:
    """(path, blob, text): the content address of each version."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(path).alias("path"), F.sha2(body.cast("binary"), 256).alias("blob"), body.alias("text"))


def scan_blobs(blobs: DataFrame) -> DataFrame:
    """Ledger rows (blob, rule_version, findings) of distinct (blob, text) rows."""
    def scan(batches):
        for batch in slices(batches):
            found = [[{"kind": k, "start": a, "end": b} for a, k, b in find(t)]
                     for t in batch.column("text").to_pylist()]
            yield pa.record_batch({
                "blob": batch.column("blob"),
                "rule_version": pa.array([RULE_VERSION] * len(found), pa.string()),
                "findings": pa.array(found, pa.list_(pa.struct(
                    [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))),
            })

    return mapped(blobs.select("blob", "text"), scan, f"blob string, rule_version string, findings {FINDINGS}")


def scan(docs: DataFrame, ledger: str, path: str = "doc_id", text: str = "text") -> DataFrame:
    """(path, blob, findings) of every row of ``docs``; ``ledger`` is the ledger's folder.

    Only blobs that the ledger lacks under ``RULE_VERSION`` are scanned;
    their rows are appended in one job. A second scan of the same versions
    reads no text beyond its hash.
    """
    spark = docs.sparkSession
    versions = paths(docs, path, text)
    known = read_ledger(spark, ledger)
    unseen = versions
    if known is not None:
        seen = known.where(F.col("rule_version") == RULE_VERSION).select("blob").distinct()
        unseen = versions.join(seen, "blob", "left_anti")
    blobs = unseen.groupBy("blob").agg(F.first("text").alias("text"))
    scan_blobs(blobs).write.mode("append").parquet(ledger)
    found = (read_ledger(spark, ledger)
             .where((F.col("rule_version") == RULE_VERSION) & (F.size("findings") > 0))
             # two scans at once may have appended the same blob
             .groupBy("blob").agg(F.first("findings").alias("findings")))
    return (versions.select("path", "blob").join(found, "blob", "left")
            .withColumn("findings", F.coalesce("findings", F.array().cast(FINDINGS))))


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame | None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.schema(f"blob string, rule_version string, findings {FINDINGS}").parquet(ledger)


def digest(findings):
    """``kind:start:end`` of the findings, comma-joined."""
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(
        ":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every text of ``documents``, through a new ledger."""
    found = scan(read_table(spark, sf_dir, "documents"), shared_dir(spark, "ledger"))
    of = lambda kind: F.filter("findings", lambda f: f["kind"] == kind)
    base = F.filter("findings", lambda f: f["kind"].isin(*BASE))
    return found.select(
        F.col("path").alias("doc_id"),
        *[F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in BASE],
        F.sha2(digest(base).cast("binary"), 256).alias("base_sha256"),
        digest(F.col("findings")).alias("spans"))


def redact(docs: DataFrame, ledger: str) -> DataFrame:
    """``docs`` with each secret replaced by ``[kind]``; overlapping spans are replaced as one.

    ``n_chars``, where there is one, follows the text. Rows without
    findings stay as they are, null texts included.
    """
    address = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    found = (scan(docs.select(F.lit(0).alias("doc_id"), "text"), ledger)
             .where(F.size("findings") > 0).groupBy(F.col("blob").alias("_blob"))
             .agg(F.first("findings").alias("_findings")))
    begin = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))
    text = F.aggregate("_findings", begin, lambda x, f: F.struct(
        F.when(f["start"] >= x["at"], F.concat(
            x["done"], F.substring("text", x["at"] + 1, f["start"] - x["at"]), F.lit("["), f["kind"], F.lit("]")))
        .otherwise(x["done"]).alias("done"), F.greatest(x["at"], f["end"]).alias("at")),
        lambda x: F.concat(x["done"], F.substring("text", x["at"] + 1, F.length("text"))))
    hit = F.col("_findings").isNotNull()
    out = (docs.withColumn("_blob", address).join(found, "_blob", "left")
           .withColumn("text", F.when(hit, text).otherwise(F.col("text"))))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(hit, F.length("text")).otherwise(F.col("n_chars"))
                             .cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def replace_spans(text: str) -> str:
    """``redact`` of one text by the plain way (for tests)."""
    out, at = [], 0
    for start, kind, end in find(text):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def base_digest(text: str | None) -> tuple[int, int, int, str]:
    """The base columns of one text by the plain patterns (for tests)."""
    text, found = text or "", []
    for order, kind in enumerate(BASE):
        pattern, accepts = RULES[kind]
        found += [(m.start(), order, f"{kind}:{m.start()}:{m.end()}") for m in pattern.finditer(text) if accepts(m)]
    words = [x[2] for x in sorted(found)]
    n = [sum(w.startswith(f"{kind}:") for w in words) for kind in BASE]
    return (*n, hashlib.sha256(",".join(words).encode()).hexdigest())
