import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from salesprism.llm import runs
from salesprism.llm.queries import op12_periodic_runs

from .. import conftest

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


def plain_runs(words, least=6, times=4):
    """Every stretch extended word by word, for every period."""
    found, n = {}, len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            end = i
            while end + q < n and words[end] == words[end + q]:
                end += 1
            length = end - i + q
            if length >= max(least, times * q):
                found.setdefault((i, length), q)
            i = end + 1
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


def edited(doc_id, words):
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def expected(doc_id, text):
    words = edited(doc_id, (text or "").encode().split())
    found = plain_runs(words)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
    digest = hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in found).encode()).hexdigest()
    kept = hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in dropped)).hexdigest()
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, digest, kept)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=60), max_size=5))
def test_random_words(texts):
    assert runs.find_runs(texts) == [plain_runs(w) for w in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from([b"a", b"b"]), min_size=1, max_size=5), st.integers(1, 12)), max_size=8),
       st.integers(1, 14), st.integers(3, 6))
def test_repeated_pieces(pieces, least, times):
    words = [w for piece, n in pieces for w in piece * n]
    assert runs.find_runs([words, words[::-1]], least, times) == [plain_runs(words, least, times), plain_runs(words[::-1], least, times)]


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{conftest.SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in op12_periodic_runs(spark, conftest.SMALL).collect())
    assert got == sorted(expected(r.doc_id, r.text) for r in docs)
    assert sum(r[1] > 0 for r in got) > 10


def test_edge_rows(spark):
    looping = next(i for i in range(100, 1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    cases = [
        (1, None), (2, ""), (2, ""), (None, "x y " * 9), (None, None), (3, "a b c"), (4, "a " * 6), (5, "a " * 5),
        (6, "A a " * 4), (7, "é é \t" * 7), (8, "a b a b a b a b c a b a b a b a b"), (looping, " ".join(map(str, range(90)))),
        (looping, ""), (looping, "one"), (9, "p q r s " * 3 + "p q r s"), (10, " \n\x0b\f\r\t "), (11, "\x1f " * 8),
    ]
    docs = spark.createDataFrame(cases, DOCS).selectExpr("*", "1 AS runs", "2 AS n_words", "'z' AS start")
    got = [tuple(r) for r in runs.report(runs.detect(docs, runs.looped)).collect()]
    assert sorted(got, key=repr) == sorted((expected(*c) for c in cases), key=repr)


def test_empty_table(spark):
    assert runs.report(runs.detect(spark.createDataFrame([], DOCS))).count() == 0


@pytest.mark.parametrize(("words", "want"), [
    ([b"a"] * 200_000, [(0, 200_000, 1)]),
    ([b"a", b"b"] * 50_000 + [b"c"] + [b"a", b"b", b"c"] * 30_000, [(0, 100_000, 2), (99_998, 90_003, 3)]),
    ([w for i in range(30_000) for w in (b"%d" % i, b"v", b"w", b"x", b"y", b"z")] + [b"v", b"w"] * 10_000, [(180_000, 20_000, 2)]),
])
def test_very_long_texts(words, want):
    assert runs.find_runs([words]) == [want]


def test_squares_of_random_words_are_found():
    rng = random.Random(5)
    words = [b"%d" % rng.randrange(50) for _ in range(3000)]
    for _ in range(30):
        at, q, times = rng.randrange(2800), rng.randrange(1, 12), rng.randrange(3, 9)
        words[at:at + q * times] = words[at:at + q] * times
    assert runs.find_runs([words]) == [plain_runs(words)]
