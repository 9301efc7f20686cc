import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from salesprism.llm import decontam
from salesprism.llm.queries import op13_decontamination
from salesprism.llm.words import Hasher, alphanumeric, raw_bytes

from .. import conftest

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, width=10):
    asked = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            asked.setdefault(tuple(w[i:i + width]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, got = words(text), set(), set()
        for i in range(len(w)):
            for n in {len(a) for a in asked}:
                if i + n <= len(w) and tuple(w[i:i + n]) in asked:
                    hit.update(range(i, i + n))
                    got |= asked[tuple(w[i:i + n])]
        names = sorted(str(g) for g in got if g is not None)
        digest = hashlib.sha256(",".join(names).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(names), digest, bool(hit)))
    return out


def rows(df):
    return [tuple(r)[:6] for r in df.collect()]


def same(got, want):
    return sorted(got, key=repr) == sorted(want, key=repr)


def test_query_equals_brute_force(spark):
    read = lambda t, c: [tuple(r) for r in spark.read.parquet(f"{conftest.SMALL}/{t}.parquet").select(*c).collect()]
    want = brute(read("documents", ["doc_id", "text"]), read("benchmark", ["item_id", "text"]))
    assert same(rows(op13_decontamination(spark, conftest.SMALL)), want)
    assert any(w[5] for w in want) and not all(w[5] for w in want)


PHRASE = "one two three four five six seven eight nine ten eleven"
CASES = [
    (1, f"x {PHRASE.upper()} y"), (2, PHRASE.replace("six", "six six")), (3, None), (4, ""), (5, "..."),
    (None, f"{PHRASE}, {PHRASE}"), (1, "tiny ITEM"), (1, "tiny ITEM"), (7, "tiny"), (8, "item a a a a a a a a a a a a a b"),
    (9, "one two three four five"), (10, "six seven eight nine ten eleven"), (11, "é" * 50 + " ünï " + "É"),
    (12, "w " * 5000 + PHRASE + " v" * 5000), (13, "z" * 100_000),
]
ITEMS = [(1, PHRASE), (2, "Tiny item"), (2, "a " * 12), (None, "ünï É"), (3, None), (4, "--"), (10, PHRASE), (9, "z" * 100_000)]


def test_edge_rows(spark, monkeypatch):
    docs = spark.createDataFrame(CASES, DOCS).selectExpr("*", "1 AS term", "'q' AS places")
    items = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "0 AS block")
    want = brute(CASES, ITEMS)
    index = decontam.build_index(docs)
    assert same(rows(decontam.report(decontam.find(index, items))), want)
    monkeypatch.setattr(decontam, "SLICE", 3)  # several passes give the same
    assert same(rows(decontam.report(decontam.find(index, items))), want)


def test_proximity(spark):
    docs = spark.createDataFrame(CASES, DOCS)
    items = spark.createDataFrame([(1, PHRASE)], "item_id long, text string")
    near = {(r.doc_id, r.n_words): r.n_near for r in decontam.report(decontam.find(decontam.build_index(docs), items)).collect()}
    assert near[2, 12] == 1 and near[1, 13] == 1 and near[9, 5] == 0


def test_no_match_reaches_the_next_document(spark):
    halves = [(i, "one two three four five" if i % 2 else "six seven eight nine ten") for i in range(50)]
    items = spark.createDataFrame([(1, PHRASE)], "item_id long, text string")
    found = decontam.report(decontam.find(decontam.build_index(spark.createDataFrame(halves, DOCS).coalesce(1)), items)).collect()
    assert {(r.n_hit, r.n_near) for r in found} == {(0, 0)}


def test_empty_tables(spark):
    none, items = spark.createDataFrame([], DOCS), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontam.report(decontam.find(decontam.build_index(none), items)).count() == 0
    found = decontam.report(decontam.find(decontam.build_index(spark.createDataFrame(CASES, DOCS)), items.limit(0)))
    assert same(rows(found), brute(CASES, []))


def test_one_common_word_in_many_documents(spark):
    many = [(i, "the " * 40 + f"w{i} " + (PHRASE if i % 3 == 0 else "")) for i in range(600)]
    docs = spark.createDataFrame(many, DOCS).repartition(6)
    items = spark.createDataFrame([(1, PHRASE), (2, "the " * 10)], "item_id long, text string")
    assert same(rows(decontam.report(decontam.find(decontam.build_index(docs), items))), brute(many, [(1, PHRASE), (2, "the " * 10)]))


def test_hashes_do_not_depend_on_place_or_chunk():
    texts = pa.array(["Ab cd  ab,é9", None, "", "cdab ab", "x" * 40, "é9"])
    raw, begins = raw_bytes(texts)
    want = [w for t in texts.to_pylist() for w in words(t)]
    for chunk in (4, 7, 1 << 10):
        first, code = Hasher(alphanumeric(), chunk).words(raw, begins)
        assert len(code) == len(want) and np.all(np.diff(first) > 0)
        assert len(set(zip(want, code.tolist(), strict=True))) == len(set(want)) == len(set(code.tolist()))
