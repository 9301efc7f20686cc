import corpus_pipeline
from salesprism.llm import queries
from salesprism.session import stage

from .. import conftest
from .test_bpe import YARDSTICK
from .test_minhash import shingles


def test_every_stage_takes_effect(spark):
    docs = spark.read.parquet(f"{conftest.SMALL}/documents.parquet")
    seen = {}
    for name, apply in corpus_pipeline.STAGES:
        before = docs
        docs = stage(apply(spark, docs, conftest.SMALL), name)
        seen[name] = (before, docs)
        if name != "byte_bpe":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    before, after = seen["language_id"]
    no_letter = {r[0] for r in before.select("doc_id", "text").collect() if not any(c.isalpha() for c in r[1] or "")}
    assert {r[0] for r in before.select("doc_id").collect()} - {r[0] for r in after.select("doc_id").collect()} == no_letter

    before, after = seen["near_dedup"]
    sets = {r[0]: shingles(r[1], 5) for r in before.select("doc_id", "text").collect()}
    kept = [r[0] for r in after.select("doc_id").collect()]
    for n, i in enumerate(kept):
        for j in kept[:n]:
            common = len(sets[i] & sets[j])
            assert not sets[i] or 100 * common < 80 * (len(sets[i]) + len(sets[j]) - common)
    for i in sets.keys() - set(kept):
        assert any(5 * len(sets[i] & s) >= 4 * len(sets[i] | s) for j, s in sets.items() if j != i)

    before, after = seen["pii"]
    assert before.count() == after.count()
    after.write.parquet(f"{(folder := after.inputFiles()[0].rsplit('/', 1)[0])}-again/documents.parquet")
    left = queries.op7_pii(spark, f"{folder}-again").selectExpr("sum(n_email)", "sum(n_ip)").first()
    assert tuple(left) == (0, 0)

    before, after = seen["mixing"]
    copies = after.groupBy("doc_id").count()
    assert copies.where("count > 3").isEmpty() and before.join(copies, "doc_id").count() == copies.count()

    before, after = seen["byte_bpe"]
    assert before.count() == after.count() and after.where("not round_trip").isEmpty()
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    for r in after.limit(40).collect():
        assert r["n_tokens"] == len(YARDSTICK.encode_ordinary(texts[r["doc_id"]]))


def test_language_is_predicted_once(spark):
    """The filter on the found language does not run the prediction again, in a Python worker of its own."""
    docs = spark.createDataFrame(
        [(1, "the cat and the dog", "en", "a", 19), (2, "le chat et le chien", None, "a", 19), (3, "123", "en", "a", 3), (4, None, "en", "a", 0)],
        "doc_id long, text string, lang string, source string, n_chars long")
    found = corpus_pipeline.identify_language(spark, docs, "")
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert {r["doc_id"] for r in found.collect()} == {1, 2}
