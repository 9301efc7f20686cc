import hashlib
import re

import xxhash

from salesprism.llm import license_scan, queries, spotsigs

from .. import conftest

DOCS = [
    (1, None), (2, ""), (3, "CC BY cc by 4.0 All rights reserved"), (3, "CC BY cc by 4.0 All rights reserved"),
    (None, "the quick brown fox and a lazy sleeping dog"), (7, "🙂 abc the one two three four"),
    (9, "x\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction\nGeneral Public-License"),
]


def frame(spark, tmp_path, rows=DOCS):
    schema = "doc_id long, text string, _words int, signatures string"
    spark.createDataFrame([(*r, 1, "x") for r in rows], schema).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def brute_license(text):
    words = re.findall(license_scan.WORD, "".join(c.lower() if c.isascii() else c for c in text or ""))
    found = [(i, label) for phrase, label in license_scan.PHRASES.items() for i in range(len(words))
             if words[i:i + len(phrase.split())] == phrase.split()]
    return len(words), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None), \
        ",".join(sorted({x for _, x in found}))


def test_license_base_and_templates(spark, tmp_path):
    for folder in (conftest.SMALL, frame(spark, tmp_path)):
        texts = [r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("text").collect()]
        got = queries.op10_license_scan(spark, folder).collect()
        assert sorted(map(str, (tuple(r)[1:6] for r in got))) == sorted(map(str, map(brute_license, texts)))
        for r in got:
            assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    assert {r["labels"] for r in got if r["doc_id"] == 9} == {"gpl,mit"}


def brute_signatures(text):
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    out, chain = set(), []
    for w in reversed(words):
        if w not in spotsigs.ANCHORS:
            chain = [w, *chain[:spotsigs.CHAIN - 1]]
        elif len(chain) == spotsigs.CHAIN:
            out.add((w, *chain))
    if not out and len(words) >= spotsigs.CHAIN:
        return set(zip(*(words[i:] for i in range(spotsigs.CHAIN)), strict=False))
    return out or ({text} if text else set())


def tie(text):
    return int.from_bytes(xxhash.xxh64_digest(text.encode(), 42), "big", signed=True)


def test_fingerprints_against_plain_python(spark, tmp_path):
    for folder in (conftest.SMALL, frame(spark, tmp_path)):
        docs = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
        docs.sort(key=lambda d: (d[0] is None, d[0] or 0, tie(d[1])))
        want = []
        for (i, t), (_, n) in zip(docs, [*docs[1:], docs[0]], strict=True):
            half = len(t) // 2
            e = t[:len(t) - half] + n[:half]
            a, b, c = brute_signatures(t), brute_signatures(e), brute_signatures(n)
            near = [round(len(a & x) / len(a | x), 9) if a | x else 1.0 for x in (b, c)]
            want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), *near))
        got = queries.op8_spotsigs(spark, folder).collect()
        assert sorted(map(str, want)) == sorted(
            str((r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9))) for r in got)


def test_ranges_of_far_off_repeated_and_missing_ids(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(spotsigs, "RANGE_ROWS", 7)
    rows = [(i, f"text {i}") for i in range(300)] + [(10**15, "far off"), (-10**15, "first")]
    rows += [(None, f"no id {i}") for i in range(400)] + [(150, f"again {i}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    cells = spotsigs._ranges(df.select(
        "*", spotsigs.F.coalesce("doc_id", spotsigs.F.lit(spotsigs.LAST)).alias("_key"), spotsigs.F.xxhash64("text").alias("_tie")))
    assert max(r["count"] for r in cells.groupBy("_cell").count().collect()) < 40
    following = {(r["doc_id"], r["text"]): r["next"]["text"] for r in spotsigs.with_next(df).collect()}
    assert len(following) == len(rows)
    walk, text_id = ["first"], {t: i for i, t in rows}
    while len(walk) < len(rows):
        walk.append(following[text_id[walk[-1]], walk[-1]])
    assert len({*walk}) == len(rows) and following[text_id[walk[-1]], walk[-1]] == "first"
    ids = [text_id[t] for t in walk]
    assert ids == sorted(ids, key=lambda i: spotsigs.LAST if i is None else i)


def test_edit_of_a_text_without_anchors_stays_similar(spark, tmp_path):
    rows = [(1, " ".join(f"слово{chr(1072 + i)}" for i in range(30))), (2, "другой короткий текст здесь")]
    got = queries.op8_spotsigs(spark, frame(spark, tmp_path, rows)).where("doc_id = 1").first()
    assert 0 < got["near_edited"] < 1 and got["near_next"] == 0


def test_empty_tables(spark, tmp_path):
    folder = frame(spark, tmp_path, [])
    assert queries.op8_spotsigs(spark, folder).count() == queries.op10_license_scan(spark, folder).count() == 0


def test_pruned_join_finds_all_similar_pairs(spark):
    rows = [(i, sorted({(i // 5) * 100 + k for k in range(20)} ^ {i % 5})) for i in range(50)] + [(99, [])]
    df = spark.createDataFrame(rows, "id long, signatures array<long>")
    got = {(r["a"], r["b"]) for r in spotsigs.similar_pairs(df, df, 0.8).collect()}
    want = {(i, j) for i, a in rows for j, b in rows if a and b and len({*a} & {*b}) >= 0.8 * len({*a} | {*b})}
    assert got == want


def test_license_blocks_are_bounded(spark, tmp_path):
    notice = license_scan.TEMPLATES["unlicense"].split()
    scattered = " filler ".join(f"{w} {'x ' * 40}" for w in notice)
    wrapped = "one two\n# " + "\n# ".join(" ".join(notice[i:i + 3]) for i in range(0, len(notice), 3)) + "\nthree"
    twice = " ".join(notice) + " y" * 50 + " " + " ".join(notice)
    rows = [(1, scattered), (2, wrapped), (3, twice), (4, " ".join(notice[:5]))]
    got = {r["doc_id"]: r for r in queries.op10_license_scan(spark, frame(spark, tmp_path, rows)).collect()}
    n = len(notice)
    assert [got[i]["labels"] for i in (1, 2, 3, 4)] == ["", "unlicense", "unlicense", ""]
    assert [got[i]["score"] for i in (1, 2, 3, 4)] == [0, 1, 1, 0]
    assert got[2]["blocks"] == f"unlicense:2-{n + 2}"
    assert got[3]["blocks"] == f"unlicense:0-{n},unlicense:{n + 50}-{2 * n + 50}"
