"""SimHash near-duplicates through covering locality-sensitive hashing.

A fingerprint has one bit per bit of a shingle hash, set if over half of the
shingles' hashes have it set. Two fingerprints link if they differ in at
most ``radius`` bits. Bit ``i`` has a vector ``m(i)`` of ``radius + 1`` bits;
each of the ``2 ** (radius + 1) - 1`` tables has a vector ``v`` and keeps the
bits with ``<m(i), v>`` odd. The vectors of at most ``radius`` differing bits
span at most ``radius`` dimensions, so some ``v`` is orthogonal to all of
them and its table keeps none of those bits: every pair within the radius
collides in some table.

Only distinct fingerprints enter the tables, so exact copies cost one row.
A bucket gives a spanning forest of its links (never all its pairs); a
bucket of over ``cell`` fingerprints is dealt to a triangle of cells, each
with the fingerprints of two parts, which together hold every pair.

Defined results: a null or empty text, and one without words, has the
fingerprint zero and links like any other; a text of any length is read whole;
a bit set in just half of the hashes is 0; repeated rows are kept; of tied
rows the smallest id stays; an empty table gives no rows; other columns of
the input are ignored, a null id never names a component unless all are null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyzone.llm.common import mapped, read_table, shared_dir, slices, stored, texts, utf8

SHINGLE, RADIUS, SEED = 4, 4, 42
CELL = 20_000


def fingerprint(words: list[bytes], shingle: int = SHINGLE) -> int:
    """SimHash of a word sequence (lower-cased by the caller), as an unsigned number."""
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    begins, ends = begins[:n].tolist(), ends[min(shingle, len(words)) - 1:].tolist()
    xxh = xxhash.xxh64_intdigest
    hashes = np.fromiter([xxh(joined[a:b], SEED) for a, b in zip(begins, ends)], np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[i:i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
            axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): ``fp`` is the fingerprint as a signed long."""
    def run(batches):
        for batch in slices(batches):
            fps = np.array([fingerprint(utf8(t).lower().split(), shingle) for t in texts(batch)], np.uint64)
            yield pa.record_batch({"id": batch.column("id"), "fp": pa.array(fps.view(np.int64))})

    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    return mapped(rows, run, "id long, fp long")


def masks(radius: int = RADIUS, bits: int = 64, seed: int = 7) -> np.ndarray:
    """One mask of kept bits per table."""
    m = np.random.default_rng(seed).integers(1, 2 ** (radius + 1), bits)
    return np.array([sum(1 << i for i in range(bits) if bin(int(m[i]) & v).count("1") % 2)
                     for v in range(1, 2 ** (radius + 1))], np.uint64)


def forest(fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints, as index pairs.

    Grown seed by seed: whoever links to a member leaves the rest, so a
    dense group costs about its size, and nothing of size n * n is kept.
    """
    left, a, b = np.arange(len(fps)), [], []
    queue: list[int] = []
    while len(left):
        if not queue:
            queue.append(int(left[0]))
            left = left[1:]
        at = queue.pop()
        near = np.bitwise_count(fps[left] ^ fps[at]) <= radius
        found = left[near]
        a.append(np.full(len(found), at))
        b.append(found)
        queue.extend(found.tolist())
        left = left[~near]
    return (np.concatenate(a), np.concatenate(b)) if a else (left, left)


def links(fps: DataFrame, radius: int = RADIUS, cell: int = CELL) -> DataFrame:
    """(a, b) of distinct fingerprints ``fp``: the links of a spanning forest per bucket."""
    kept = masks(radius)

    def tables(batches):
        for batch in batches:
            x = batch.column("fp").to_numpy(zero_copy_only=False)
            keyed = (x.view(np.uint64)[:, None] & kept[None, :]).view(np.int64)
            yield pa.record_batch({"t": np.tile(np.arange(len(kept), dtype=np.int32), len(x)),
                                   "key": keyed.ravel(), "fp": np.repeat(x, len(kept))})

    rows = mapped(fps.select("fp"), tables, "t int, key long, fp long")
    # Lone fingerprints (most of them) end here; sizes are counted before the shuffle.
    sizes = rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    many = rows.join(sizes, ["t", "key"])
    parts = F.ceil(F.col("n") / F.lit(cell)).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    cells = (many.withColumn("parts", parts).withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .select("t", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp"))

    lists = cells.groupBy("t", "key", "i", "j").agg(F.collect_list("fp").alias("fps")).select("fps")

    def grow(batches):
        for batch in batches:
            column = batch.column("fps")
            x = column.values.to_numpy(zero_copy_only=False).view(np.uint64)
            at = column.offsets.to_numpy(zero_copy_only=False)
            two = at[:-1][np.diff(at) == 2]
            two = two[np.bitwise_count(x[two] ^ x[two + 1]) <= radius]
            a, b = [x[two]], [x[two + 1]]
            for i in np.flatnonzero(np.diff(at) > 2):
                own = x[at[i]:at[i + 1]]
                m, n = forest(own, radius)
                a.append(own[m])
                b.append(own[n])
            yield pa.record_batch({"a": np.concatenate(a).view(np.int64), "b": np.concatenate(b).view(np.int64)})

    return mapped(lists, grow, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): root is the smallest node reachable.

    Alternates large-star and small-star rounds, each a map and a grouping,
    until no edge changes; every round is written to the shared folder. A
    node's neighbours are never gathered: only their minimum is, and it is
    joined back to the edges.
    """
    edges = stored(edges.where("a <> b"), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (both.where("b > a").join(least, "a").where("b <> m")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        large = stored(large, "edges")  # a > b from here on
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = (joined.select("a", F.col("m").alias("b"))
                 .unionByName(joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
                 .distinct())
        edges = stored(small, "edges")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == before:
            return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
        before = state


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    radius: int = RADIUS) -> DataFrame:
    """(id, fp, component) of every row; component is the smallest id reachable over links."""
    prints = stored(fingerprints(docs, id, text, shingle), "fingerprints")
    nodes = stored(prints.groupBy("fp").agg(F.min("id").alias("rep")), "nodes")
    edges = links(nodes, radius)
    # Components over fingerprints; the ids come in once, at the end.
    roots = components(edges).select(F.col("node").alias("fp"), "root")
    rooted = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("rep").alias("component"))
    label = stored(rooted.join(smallest, "root").select("fp", "component"), "labels")
    return prints.join(label, "fp").select("id", "fp", "component")


def op10_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        F.col("component").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id.

    Of rows that repeat the smallest id one stays. A null id counts as the
    component's last choice.
    """
    rows = stored(docs.withColumn("_row", F.monotonically_increasing_id()), "documents")
    keyed = rows.select(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "_row").alias("who"), "text")
    # The id of the operator is the row, so that repeated ids stay apart.
    order = keyed.select(F.col("who._row").alias("doc_id"), "text")
    found = near_duplicates(order)
    first = (found.join(keyed.select(F.col("who._row").alias("id"), "who"), "id")
             .groupBy("component").agg(F.min("who").alias("who")).select(F.col("who._row").alias("_row")))
    return rows.join(first, "_row", "left_semi").select(*docs.columns)
