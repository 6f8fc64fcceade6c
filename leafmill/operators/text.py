"""Text layers of pages from word boxes."""

from __future__ import annotations

from ..functions.geometry import both
from ..plans.plan import Plan
from . import search

ALL_WORDS = "w AS (SELECT * FROM ocr_word WHERE level = 5 AND trim(text) <> '')"

#: Texts move once, page by page, before they are taken apart into words; the words don't move.
PAGES = (("documents", "doc_id"),)

_LAYER = """w AS (SELECT * FROM ocr_box WHERE level = 5 AND trim(text) <> ''), bare AS (SELECT d.doc_id, d.text FROM documents d WHERE trim(d.text) <> '' AND NOT EXISTS (SELECT 1 FROM w WHERE w.doc_id = d.doc_id))"""
#: The same in Spark, where the pages that have boxes meet the texts, not all boxes.
_LAYER_SPARK = _LAYER.replace(", bare AS", ", boxed AS (SELECT DISTINCT doc_id FROM w), bare AS").replace("FROM w WHERE w.doc_id", "FROM boxed WHERE boxed.doc_id")
_PLACED = "SELECT doc_id, CAST(left_px AS DOUBLE) AS x, CAST(top_px + height AS DOUBLE) AS y, CAST(height AS DOUBLE) AS size, text FROM w WHERE width > 0 AND height > 0 UNION ALL SELECT doc_id, 1e0, round(1 + 1.2e0 * i, 6), 1e0, line FROM l"


def search_plan(term: str) -> Plan:
    """Boxes whose text contains a term, by a look at all of them; search.build_index() is for more than one term."""
    quoted = term.lower().replace("'", "''")
    return Plan(("ocr_word",), f"Pages and boxes of a term ({term}), in any case.", run=lambda ocr_word: search.scan(ocr_word, term),
        duckdb=f"WITH {ALL_WORDS} SELECT doc_id, line_num, word_num, left_px, top_px, text FROM w WHERE contains(lower(text), '{quoted}')")


PLANS = {
    "t01_text_layer": Plan(("ocr_box", "documents"), "Placed words of each page; pages without boxes get the lines of their text, unless it is blank.",
        f"WITH {_LAYER_SPARK}, l AS (SELECT doc_id, posexplode(split(replace(text, '\\r', ''), '\\n')) AS (i, line) FROM bare) {_PLACED}",
        f"WITH {_LAYER}, s AS (SELECT doc_id, string_split(replace(text, chr(13), ''), chr(10)) AS ls FROM bare), l AS (SELECT doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM s) {_PLACED}"),
    "t02_text_lines": Plan(("ocr_word",), "Boxes and text of lines.",
        f"WITH {ALL_WORDS} SELECT doc_id, block_num, par_num, line_num, min(left_px) AS x0, min(top_px) AS y0, max(left_px + width) AS x1, max(top_px + height) AS y1, array_join(transform(array_sort(collect_list(struct(word_num, text))), s -> s.text), ' ') AS text FROM w GROUP BY doc_id, block_num, par_num, line_num",
        f"WITH {ALL_WORDS} SELECT doc_id, block_num, par_num, line_num, min(left_px) AS x0, min(top_px) AS y0, max(left_px + width) AS x1, max(top_px + height) AS y1, string_agg(text, ' ' ORDER BY word_num) AS text FROM w GROUP BY doc_id, block_num, par_num, line_num", dealt=PAGES),
    "t03_page_text": Plan(("ocr_word",), "Readable text of pages.",
        f"WITH {ALL_WORDS} SELECT doc_id, array_join(transform(array_sort(collect_list(struct(block_num, par_num, line_num, word_num, text))), s -> s.text), ' ') AS text FROM w GROUP BY doc_id", f"WITH {ALL_WORDS} SELECT doc_id, string_agg(text, ' ' ORDER BY block_num, par_num, line_num, word_num) AS text FROM w GROUP BY doc_id", dealt=PAGES),
    "t04_search": search_plan("tion"),
    "t04_indexed_search": Plan(("ocr_word",), "The same through an index of character trigrams.", run=lambda ocr_word: search.build_index(ocr_word).search("tion"), duckdb=search_plan("tion").duckdb),
    "t05_missing_text": both(("capture_job",), "Batches with final pages that have no text: not read, failed or skipped.", "SELECT batch_id, sum(CASE WHEN ocr_status <> 'Completed' THEN 1 ELSE 0 END) AS missing, max(CASE WHEN ocr_status IN ('Failed', 'Skipped') THEN 1 ELSE 0 END) = 1 AS flagged FROM capture_job WHERE processing_status = 'Completed' AND export_status <> 'Superseded' GROUP BY batch_id"),
}
