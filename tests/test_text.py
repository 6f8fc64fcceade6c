"""Text operators over every page, against brute force."""

import random

import pytest

from leafmill.operators import search
from leafmill.operators.text import PLANS
from leafmill.plans import catalog
from tests.test_oracles import SF


def test_every_page_has_lines_text_and_hits(spark):
    words = []
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("text is not null").collect():
        words += [(r["doc_id"], pos // 10, pos % 10, w) for pos, w in enumerate(r["text"].split(" ")) if pos % 13 != 12 and w.strip(" ")]
    run = catalog.queries()
    lines, pages = {}, {}
    for d, line, _, w in words:
        lines.setdefault((d, line), []).append(w)
        pages.setdefault(d, []).append(w)
    assert any(d % 10 == 0 for d in pages)
    assert {(r["doc_id"], r["line_num"]): r["text"] for r in run["t02_text_lines"](spark, SF).collect()} == {k: " ".join(v) for k, v in lines.items()}
    assert {r["doc_id"]: r["text"] for r in run["t03_page_text"](spark, SF).collect()} == {k: " ".join(v) for k, v in pages.items()}
    hits = sorted((d, line, n, w) for d, line, n, w in words if "tion" in w.lower())
    assert any(d % 10 == 0 for d, *_ in hits)
    assert sorted((r["doc_id"], r["line_num"], r["word_num"], r["text"]) for r in run["t04_search"](spark, SF).collect()) == hits


BOX = "doc_id long, level int, line_num int, word_num int, left_px int, top_px int, width int, height int, text string"


def boxes(spark, texts):
    return spark.createDataFrame([(i // 7, 5 if i % 11 else 4, i // 3, i % 3, i, i, 8, 9, t) for i, t in enumerate(texts)], BOX)


def test_index_finds_what_a_scan_finds(spark, tmp_path):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abAÉé日'%_ß") for _ in range(rng.randint(0, 9))) for _ in range(600)] + [None, " ", "", "İstanbul", "STATION", "aba" * 400] + ["common"] * 300
    df = boxes(spark, texts)
    index = search.build_index(df, parts=3).save(str(tmp_path / "index"))
    terms = ["a", "ab", "aba", "ABA", "abab", "éÉ", "日", "日a'", "%", "_a", "station", "STAT", "zzz", "aba" * 399, "common", "ommo", "istan", "ß%"] + ["".join(rng.choice("abAÉ日") for _ in range(rng.randint(1, 5))) for _ in range(8)]
    for term in terms:
        want = sorted(map(str, search.scan(df, term).collect()))
        assert sorted(map(str, index.search(term).collect())) == want
        low = term.lower()
        assert len(want) == sum(low in t.lower() for i, t in enumerate(texts) if t and t.strip(" ") and i % 11) or not term.isascii()
    assert max(r["n"] for r in index.grams.selectExpr("size(ids) AS n").collect()) <= index.vocabulary.groupBy("part").count().agg({"count": "max"}).first()[0]
    again = search.SearchIndex.open(spark, str(tmp_path / "index"))
    assert again.search("common").count() == sum(t == "common" for i, t in enumerate(texts) if i % 11)
    assert search.build_index(df.limit(0)).search("abc").count() == 0
    with pytest.raises(ValueError):
        index.search("")


def test_pages_without_boxes_get_their_lines(spark):
    words = boxes(spark, ["one", "two"])
    words = words.withColumn("level", words.level * 0 + 5)
    pages = spark.createDataFrame([(0, "one two"), (1, "first\r\nsecond"), (2, " "), (3, None), (10, "tenth")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["x"], r["y"], r["text"]) for r in PLANS["t01_text_layer"].apply(ocr_box=words, documents=pages).collect())
    assert got == [(0, 0.0, 9.0, "one"), (0, 1.0, 10.0, "two"), (1, 1.0, 1.0, "first"), (1, 1.0, 2.2, "second"), (10, 1.0, 1.0, "tenth")]
