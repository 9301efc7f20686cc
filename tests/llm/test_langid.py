"""Language identification: held-out accuracy, odd rows, and the filter against exact sets."""

import zlib

import numpy as np
import pyarrow as pa

from salesprism.llm import langid, queries

from .. import conftest


def test_held_out_accuracy(spark):
    folder = conftest.SMALL.replace("0.001", "0.01")
    truth = {r[0]: (r[1], r[2]) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang", "text").collect()}
    got = queries.op3_language_id(spark, folder).collect()
    assert len(got) == len(truth)
    right = seen = 0
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        lang, text = truth[r["doc_id"]]
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in text or ""))
        if r["held_out"] and lang is not None and r["lang_pred"] != "und":
            seen += 1
            right += r["lang_pred"] == lang
    assert seen and right / seen >= 0.97, (right, seen)


def test_odd_rows(spark):
    a, b, c, d, e, f, g = [i for i in range(60) if zlib.crc32(str(i).encode()) % 4 != 2][:7]
    rows = [(None, "the cat and the dog", "en", "x"), (a, None, "en", "x"), (b, "", None, "x"), (c, "12 !?", "en", "x"),
            (d, "le chat et le chien", "fr", "x"), (d, "le chat et le chien", "fr", "x"), (e, "the " * 400_000, "en", "x"),
            (f, "ωψχ", None, "x"), (g, "t", None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, found string")
    got = {(r["doc_id"], r["lang_pred"]) for r in langid.identify(docs).collect()}
    assert {(a, "und"), (b, "und"), (c, "und"), (d, "fr"), (e, "en")} <= got
    assert {p for i, p in got if i in (f, g)} <= {"en", "fr"}
    assert langid.identify(docs.limit(0)).isEmpty()
    unlabelled = docs.withColumn("lang", docs["lang"].substr(9, 9).try_cast("int").cast("string"))
    assert {(r["lang_pred"], r["score"]) for r in langid.identify(unlabelled).collect()} == {("und", 0.0)}


def test_filter_returns_every_language_that_holds_the_gram():
    rng = np.random.default_rng(1)
    pairs = sorted({(f"l{i % 70}", int(g)) for i, g in enumerate(rng.integers(0, 2**63 - 1, 5000))})
    pairs += [("l0", g) for name, g in pairs[:200] if name != "l0"]
    model = langid.build_model(pairs)
    own = {}
    for name, g in pairs:
        own.setdefault(g, set()).add(name)
    mask = model.lookup(np.array(list(own), np.int64).astype(np.uint64))
    extra = 0
    for col, names in enumerate(own.values()):
        bits = {n for i, n in enumerate(model.languages) if mask[i // 64, col] >> np.uint64(i % 64) & np.uint64(1)}
        assert names <= bits
        extra += len(bits - names)
    expected = model.chance.sum() * len(own)
    assert extra <= 2 * expected + 20


def test_marks_alone_are_no_letters():
    model = langid.build_model([("de", int(g)) for g in langid.grams(["das ist ein haus"])[0]])
    assert model.predict(["\u0301\u0301 \u0308", "haus", "12 \u0301"]) [0] == [langid.UNKNOWN, "de", langid.UNKNOWN]
    assert langid.has_letter([None, "", "\u0301", "e\u0301"]) == [False, False, False, True]


def test_texts_of_a_batch_become_python_s_a_block_at_a_time():
    class Spy(langid.Model):
        most = 0

        def predict(self, texts):
            Spy.most = max(Spy.most, sum(len(t or "") for t in texts))
            return super().predict(texts)

    plain = langid.build_model([("de", 5), ("en", int(langid.grams(["the cat"])[0][0]))])
    model = Spy(plain.languages, plain.slots, plain.chance)
    texts = [None, "", "the cat", "12", *["the cat and the dog " * n for n in range(0, 1000, 7)]]
    got = langid.predictions(model, pa.array(texts)).to_pylist()
    assert [(r["lang"], r["score"]) for r in got] == list(zip(*plain.predict(texts), strict=True))
    assert Spy.most <= langid.BLOCK < sum(len(t or "") for t in texts)
    assert len(langid.predictions(model, pa.array([], pa.string()))) == 0
