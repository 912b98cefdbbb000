import corpus_pipeline
from gatherline.llm.common import saved

SF = "/root/testdata/sf0.001"


def test_stages(spark, odd, no_rows):
    docs = odd.select(*corpus_pipeline.COLUMNS, "size")
    empty = no_rows
    n = {}
    for name, stage in corpus_pipeline.STAGES:
        docs, empty = saved(stage(spark, docs, "")), saved(stage(spark, empty, ""))
        assert empty.count() == 0
        n[name] = docs.count()
        if name != "tokens":
            assert docs.columns == corpus_pipeline.COLUMNS
        if name == "language":  # null, empty and blank texts and digits go
            assert not {r[0] for r in docs.select("doc_id").collect()} & {0, 1, 2, 10}
        if name == "near_dedup":  # equal but for case, three times under one id
            assert [r[0] for r in docs.where("doc_id in (5, 6, 7)").select("doc_id").collect()] == [5]
            assert docs.where("doc_id IS NULL").count() == 0  # 12 of 16 shingles are those of document 5
        if name == "secrets":
            assert [r[0] for r in docs.where("doc_id = 12").select("text").collect()] == ['[secret]"']
    assert {"ids", "decoded", "n_tokens"} <= set(docs.columns) and n["tokens"] == n["mix"]


def test_near_dedup_keeps_one_row_of_a_group(spark):
    words = " ".join(f"w{i}" for i in range(40))
    rows = [(7, words), (7, words), (7, words + " x"), (8, words.upper()), (None, words), (9, "one two three four five six"), (9, "other words of the same id here"), (None, None), (None, None), (3, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()), key=str)
    assert [x for x in got if x[0] == 7] in ([(7, words)], [(7, words + " x")]) and len(got) == 5
    assert [x for x in got if x[0] != 7] == sorted([(3, ""), (9, rows[5][1]), (9, rows[6][1]), (None, None)], key=str)


def test_run(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = corpus_pipeline.run(spark, SF).collect()
    assert got and all(r["n_tokens"] == len(r["ids"]) for r in got)
    for r in got:  # what comes out is made of words that went in, but for masks
        assert set(r["decoded"].replace("[secret]", " ").split()) <= {p for w in docs[r["doc_id"]]["text"].split() for p in (w, *w.split())} or "[secret]" in r["decoded"]
