import hashlib
import tracemalloc

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from salesprism.llm import bpe, queries

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
YARDSTICK = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TEXTS = [
    "", " ", "a", "It's the dog's  \n\n  end\t.", "x" * 5000, "ab" * 3000 + "é" * 999, "été à la façon 日本語 🙂🙂 1234567",
    "\x1c\x1f\x85  z​", "<|endoftext|>", "a\r\n b　　c   ", "don'T WE'RE 'll'd",
]


@pytest.mark.parametrize("text", TEXTS)
def test_same_ids_as_the_library(text):
    words = bpe.Vocabulary(RANKS, public_tokenizers.PATTERN)
    ids = words.encode(text)
    assert bpe.as_list(ids) == YARDSTICK.encode_ordinary(text)
    assert words.decode(ids) == text.encode()


def test_both_folds_agree():
    for text in TEXTS:
        raw = text.encode()[:200]
        if raw and raw not in RANKS:
            short = bpe.SHORT
            try:
                bpe.SHORT = 10_000
                plain = bpe.fold(raw, RANKS)
            finally:
                bpe.SHORT = short
            assert plain == bpe.fold_long(raw, RANKS)


def test_query_on_nulls_and_repeats(spark, tmp_path):
    rows = [(1, "hello world", 5), (1, "hello world", 5), (None, None, 6), (3, "", 7)]
    spark.createDataFrame(rows, "doc_id long, text string, ids int").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in queries.op1_byte_bpe(spark, str(tmp_path)).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert (None, 0, empty, empty) in got and (3, 0, empty, empty) in got and len(got) == 3
    assert any(r[0] == 1 and r[1] == 2 and r[3] == hashlib.sha256(b"hello world").hexdigest() for r in got)


def test_encoding_is_checked_in_one_pass_with_few_words_kept(spark):
    """The pipeline's last stage runs one Python worker a task, which keeps as many words as it is told."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, None])], "i int, text string")
    coder = queries.tokenizer(spark, most_words=3)
    coded = docs.select("i", coder.encode_and_check(docs.text).alias("c")).select("i", "c.ids", "c.same")
    assert coded._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    for r in coded.collect():
        want = YARDSTICK.encode_ordinary(TEXTS[r.i]) if r.i < len(TEXTS) else []
        assert bpe.as_list(r.ids) == want and r.same
    words = bpe.Vocabulary(RANKS, public_tokenizers.PATTERN, 3)
    for text in TEXTS:
        words.encode(text)
    assert max(len(words.split(t)) for t in TEXTS) >= len(words.known)


def test_memory_of_folding_does_not_follow_the_number_of_words():
    words = bpe.Vocabulary(RANKS, public_tokenizers.PATTERN)
    fresh = [hashlib.md5(b"%d" % i).hexdigest()[:12].encode() for i in range(100_000)]
    few = words.fold_all(fresh[:500])
    tracemalloc.start()
    try:
        out = words.fold_all(fresh)
        now, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert peak - now < 25e6 and out[:500] == few and words.fold_all(fresh[-500:]) == out[-500:]
    assert [bpe.as_list(x) for x in out[::5000]] == [bpe.fold(w, RANKS) for w in fresh[::5000]]


def test_blocks_of_a_batch_go_back_one_by_one(spark, monkeypatch):
    words = bpe.Vocabulary(RANKS, public_tokenizers.PATTERN, 3)
    monkeypatch.setattr(bpe, "BLOCK", 100)
    texts = [*TEXTS, None]
    parts = list(bpe.checked(words, iter([pa.array(texts), pa.array([], pa.string()), pa.array(["a b"])])))
    assert len(parts) > 4
    got = [r for part in parts for r in part.to_pylist()]
    assert [bpe.as_list(r["ids"]) for r in got] == [YARDSTICK.encode_ordinary(t or "") for t in [*texts, "a b"]]
    assert all(r["same"] for r in got)
    # several blocks of one Arrow batch in a worker: rows keep their order
    docs = spark.range(3000).selectExpr("id", "repeat(concat('w', id, ' '), 200) as text").coalesce(1)
    coder = queries.tokenizer(spark, most_words=50)
    rows = docs.select("id", "text", coder.encode_and_check(docs.text).alias("c")).select("id", "text", "c.ids", "c.same").collect()
    assert len(rows) == 3000 and all(r.same for r in rows)
    for r in rows[::500]:
        assert bpe.as_list(r.ids) == YARDSTICK.encode_ordinary(r.text)
