import corpus_pipeline
import random

COLUMNS = corpus_pipeline.COLUMNS


def test_pipeline_on_a_small_corpus(spark, tmp_path):
    from lodestone.llm import bpe, decontamination, simhash

    rng = random.Random(2)
    say = {"en": ["the", "of", "and", "house", "water", "road"], "de": ["der", "und", "ein", "haus", "wasser", "weg"]}
    prose = lambda lang, n: " ".join(rng.choice(say[lang]) + rng.choice(["", "er", "in", "ung", "est"]) for _ in range(n))
    passage = " ".join(f"item{i}" for i in range(12))
    rows = [(i, prose(lang, 60) + "\nshared footer", lang, "s", 1) for i in range(40) for lang in [("en", "de")[i % 2]]]
    rows += [(100, rows[3][1], "de", "s", 1), (101, rows[3][1], "de", "s", 1), (102, "12 34 !!", "en", "s", 1), (103, None, None, None, None), (104, "", "en", None, None)]
    rows += [(105, prose("en", 40) + " " + passage + " " + prose("en", 40), "en", "s", 1), (None, prose("en", 50), "en", "s", 1), (None, prose("en", 50), "en", "s", 1), (106, prose("de", 20), None, "s", 1), (106, prose("de", 20), None, "s", 1)]
    rows += [rows[-1]]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, sizes = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        sizes.append(docs.count())
        if k < 4:
            assert docs.columns == COLUMNS
    # language: 102, 103 and 104 go. Near duplicates: 100 and 101 are copies of 3; of three rows of id 106, one repeats.
    left = [r for r in rows if r[0] not in (102, 103, 104)]
    assert sizes == [len(left), len(left), len(left) - 3, len(left) - 3, len(left) - 3]
    lines = {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/1").collect()}
    assert lines[3] == rows[3][1].removesuffix("\nshared footer")
    clean = {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/3").collect()}
    assert "item3" not in clean[105] and clean[3] == lines[3] and 100 not in clean
    out = {r.doc_id: r["ids"] for r in docs.collect()}
    model = bpe.load(bpe.vocabulary_path())
    assert out[105] == list(memoryview(model.encode(clean[105])).cast("I"))
    assert sorted(map(repr, (r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()))) == sorted(map(repr, (r.doc_id for r in docs.collect())))


def test_pipeline_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
