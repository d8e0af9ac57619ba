import corpus_pipeline
from tallyzone.llm.common import shared_dir, stored
from tests.llm.test_packing import check_packing


def test_stages_take_effect(spark, make):
    from tests.llm.test_decontaminate import corpus
    rows, items, planted = corpus()
    rows = [(i, t, "en") for i, t in rows]
    rows += [(500, rows[1][1], "en"), (501, "!!! 123", "en"), (502, None, "en"),
             (503, rows[2][1] + " token = abcdef123456", "en"), (503, rows[2][1] + " token = abcdef123456", "en")]
    folder = shared_dir(spark, "test")
    make(rows).drop("rank", "blob").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, folder), name)
        seen.append({r["doc_id"] for r in docs.select("doc_id").collect()})
        if name == "secret_scans":
            bodies = [r["text"] for r in docs.collect()]
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert not any("abcdef123456" in t for t in bodies)
    assert not seen[0] & {501, 502} and len(seen[0]) >= 200
    assert 500 not in seen[1] and 1 in seen[1]
    assert not seen[2] & {d for d, _ in planted}
    assert seen[2] == seen[3] == seen[4]
    check_packing(docs.collect(), 2048)
    assert corpus_pipeline.run(spark, folder).count() == docs.count()


def test_empty_tables(spark, make):
    folder = shared_dir(spark, "test")
    make([]).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
    full = shared_dir(spark, "test")  # without items every document is clean
    make([(i, f"the river number {i} runs over {i * i} green stones and {i + 7} roots", "en") for i in range(40)]).write.parquet(
        f"{full}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{full}/benchmark.parquet")
    docs = spark.read.parquet(f"{full}/documents.parquet")
    assert corpus_pipeline.decontamination(spark, docs, full).count() == 40


def test_clashing_columns_nulls_repeats_and_a_long_text(spark, make):
    """Columns of the operators' own names stay as they are through every filtering stage."""
    from tests.llm.test_decontaminate import corpus
    rows, items, planted = corpus(seed=8)
    long_text = " ".join(f"{w}{i}" for i, w in enumerate(("stone river green quiet morning " * 12_000).split()))
    rows = [(i, t, "en") for i, t in rows] + [(600, long_text, "en"), (601, None, None), (602, "", "en"), (None, "a word of a null id", "en"),
                                              (603, rows[3][1], None), (603, rows[3][1], None)]
    folder = shared_dir(spark, "test")
    clash = {"id": "i", "h": "h", "lang_pred": "p", "score": "s", "sequence_id": "q", "piece": "c", "bucket": "b"}
    from pyspark.sql import functions as F
    docs = make(rows)
    docs = docs.withColumns({name: F.lit(value) for name, value in clash.items()})
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, folder), name)
        assert docs.columns == columns
        assert all(r[name_] == value for r in docs.select(*clash).distinct().collect() for name_, value in clash.items())
        kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    assert not kept[0] & {601, 602} and 600 in kept[-1] and None in kept[-1]
    assert 3 in kept[1] and 603 not in kept[1]  # repeated rows and copies: one of them stays
    assert not kept[2] & {d for d, _ in planted}
    assert docs.where("doc_id = 600").first()["text"] == long_text
    name, stage = corpus_pipeline.STAGES[-1]
    pieces = stored(stage(spark, docs, folder), name)
    check_packing(pieces.collect(), 2048)
    assert {r["doc_id"] for r in pieces.select("doc_id").collect()} == kept[-1]
