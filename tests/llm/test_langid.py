import random

from slipstone.llm import langid, queries

PARTS = {"aa": ["tion", "the", "ing", "wh"], "bb": ["sch", "keit", "ung", "ü"], "cc": ["eau", "ç", "è", "oi"]}


def labelled(n=240, seed=1):
    draw = random.Random(seed)
    rows = []
    for doc in range(n):
        lang = sorted(PARTS)[doc % 3]
        words = ["".join(draw.choices(PARTS[lang], k=draw.randint(1, 3))) for _ in range(draw.randint(3, 60))]
        rows.append((doc, " ".join(words), lang, "src"))
    return rows


def test_held_out_accuracy_and_edges(spark, tmp_path):
    rows = labelled() + [
        (900, None, "aa", None), (901, "", None, "src"), (902, "12 34 !!", "bb", "s"), (903, "The " * 60_000, None, None),
        (904, "schkeit", None, None), (None, "tion the ing", "aa", None), (5, "schung keit", "bb", "dup"),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op1_language_id(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id not in (5, None)}
    truth = {r[0]: r[2] for r in rows[:240]}
    held = [r for r in by.values() if r.held_out and r.doc_id < 240]
    assert held and sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    for doc in (900, 901, 902):
        assert (by[doc].lang_pred, by[doc].score, by[doc].rejected) == ("und", 0.0, True)
    assert by[903].lang_pred == "aa" and by[904].lang_pred == "bb"
    assert all(0 <= r.score <= 1 for r in got)


def test_nothing_learned_and_empty_table(spark):
    frame = spark.createDataFrame([(1, "the", None)], "doc_id long, text string, lang string")
    model = langid.fit(frame)
    assert model is None
    row = langid.predict(frame, model, "lang_").select("lang_.*").first()
    assert (row.lang_pred, row.rejected) == ("und", True)
    assert langid.predict(frame.limit(0), model).count() == 0


def test_same_model_from_same_rows_and_chunked_texts_agree():
    rows = [(lang, [text.encode()]) for _, text, lang, _ in labelled(90)]
    plan = langid.TrainingPlan(epochs=30)
    one, two = langid.train(rows, plan), langid.train(rows, plan)
    assert (one.table == two.table).all() and one.temperature == two.temperature
    assert 0 < one.reject_below <= 0.5
    assert one.predict("Keitsch UNG")[0] == "bb"
