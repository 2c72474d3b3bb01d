"""Seeds of edited copies of test items."""

from docmill.llm import decontam


def test_a_word_after_every_third_leaves_seeds(spark):
    item = [f"w{k}" for k in range(30)]
    edited = [x for k, w in enumerate(item) for x in ((w, f"x{k}") if k % 3 == 2 else (w,))]
    docs = spark.createDataFrame([(1, " ".join(edited)), (2, " ".join(reversed(item))), (3, " ".join(item))], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {r["doc_id"]: r["score"] for r in decontam.contaminated(docs, bench).collect()}
    assert set(got) == {1, 3} and 0.65 < got[1] < 0.75 and got[3] == 1.0
