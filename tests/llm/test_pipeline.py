"""The whole pipeline over a small corpus with planted cases."""

import corpus_pipeline
from conftest_llm import DOCS, doc_row, prose, words_of

PASSAGE = " ".join(f"passage{k}" for k in range(60))
ITEM = "What holds the red lamp above the old harbour gate? A chain of nine copper rings holds the red lamp there."


def corpus(spark, path):
    clean = [doc_row(k, prose(k, 220), source="ab"[k % 2]) for k in range(90)]
    near = clean[6][1].split(" ")
    near[50], near[150] = "changed", "too"
    rows = [
        *clean, doc_row(200, clean[5][1]), doc_row(201, " ".join(near)),
        doc_row(203, f"{prose(303, 150)} {PASSAGE} {prose(304, 150)}"), doc_row(204, f"{prose(305, 150)} {PASSAGE} {prose(306, 120)}"),
        doc_row(205, f"{prose(307, 150)} {ITEM} {prose(308, 150)}"), doc_row(206, "a " * 300), doc_row(207, prose(309, 10)),
        doc_row(208, None), doc_row(None, prose(310, 200), None, None),
    ]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    marked = [(r[0], 1, 0) for r in rows if r[0] is not None and r[0] < 206]
    spark.createDataFrame(marked, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, "An item that no document holds, with a question and an answer of its own.")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return {r[0]: r for r in rows}


def test_every_stage_takes_effect_and_clean_documents_stay(spark, tmp_path):
    given = corpus(spark, str(tmp_path))
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert docs.columns == [f.name for f in DOCS.fields], name
        docs.write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        kept.append({r.doc_id: r for r in docs.collect()})
    rules, near, passages, leaks, mix = kept
    clean = [k for k in given if k is not None and k < 90]
    assert not {206, 207, 208} & rules.keys() and sum(k not in rules for k in clean) <= 4
    assert rules.keys() - near.keys() == {200, 201} & rules.keys() and {200, 201} & rules.keys()
    assert passages.keys() == near.keys()
    if {203, 204} <= passages.keys():
        assert PASSAGE in passages[203].text and "passage5" not in passages[204].text
        assert words_of(passages[204].text) == [w for w in words_of(given[204][1]) if not w.startswith("passage")]
    assert passages.keys() - leaks.keys() == {205} & passages.keys()
    assert mix.keys() <= leaks.keys() and all(r.mix_passes >= 1 and r.text == leaks[k].text for k, r in mix.items())
    # run() gives what the stages give one after the other
    whole = {r.doc_id: (r.text, r.mix_passes, r.mix_finish) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert whole == {k: (r.text, r.mix_passes, r.mix_finish) for k, r in mix.items()}
