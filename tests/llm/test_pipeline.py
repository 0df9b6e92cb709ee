import random

import corpus_pipeline
from slipstone.llm import neardup

PARTS = {"en": ["tion", "the", "ing", "wh"], "de": ["sch", "keit", "ung", "ü"], "fr": ["eau", "ç", "è", "oi"]}


def documents(spark, extra=False):
    draw = random.Random(8)
    rows = []
    for doc in range(120):
        lang = sorted(PARTS)[doc % 3]
        text = " ".join("".join(draw.choices(PARTS[lang], k=draw.randint(1, 3))) for _ in range(draw.randint(20, 90)))
        rows.append((doc, text, lang, "big" if doc % 4 else "small", len(text)))
    rows += [(200 + i, rows[i][1], rows[i][2], "big", rows[i][4]) for i in range(5)]  # exact copies
    rows += [(300 + i, rows[i][1] + " ung", rows[i][2], "big", rows[i][4] + 4) for i in range(5)]  # near copies
    rows += [(400, None, None, None, None), (401, "", "en", "small", 0), (402, "12 !", None, "big", 4), (None, rows[9][1], "de", "big", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        for name in ("language", "tokens", "use", "uses", "kept"):
            frame = frame.withColumn(name, frame["lang"])
    return frame


def test_stages_keep_columns_and_take_effect(spark):
    docs = documents(spark, extra=True)
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "mix_sources", "piece_samples"]
    known = corpus_pipeline.language_id(spark, docs, "")
    assert known.columns == docs.columns
    ids = {r.doc_id for r in known.collect()}
    assert ids == {r.doc_id for r in docs.collect()} - {400, 401, 402}
    alone = corpus_pipeline.near_dedup(spark, known, "")
    assert alone.columns == docs.columns
    kept = {r.doc_id for r in alone.collect()}
    expected = {r.doc_id for r in neardup.near_duplicates(known).filter("kept").collect()}
    assert kept == expected and None in kept and not kept & set(range(200, 205))
    mixed = corpus_pipeline.mix_sources(spark, alone, "")
    assert mixed.columns == docs.columns
    uses = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert set(uses) == kept and max(uses.values()) >= 2
    last = corpus_pipeline.piece_samples(spark, mixed, "")
    rows = last.collect()
    assert len(rows) == 2 * sum(uses.values()) and all(r.round_trip for r in rows)


def test_run_over_a_folder_and_an_empty_table(spark, tmp_path):
    documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path))
    assert rows.count() > 200 and "ids" in rows.columns
    empty = tmp_path / "none"
    documents(spark).limit(0).write.parquet(f"{empty}/documents.parquet")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
