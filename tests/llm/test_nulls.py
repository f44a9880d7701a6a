"""Every operator on rows with nulls in any column, clashing extra columns and repeated texts: defined, and no crash."""

import pytest

from terrapix.llm.decontaminate import decontaminate, digest
from terrapix.llm.exact_dedup import exact_dedup
from terrapix.llm.html_text import html_text
from terrapix.llm.near_dedup import near_dedup
from terrapix.llm.packing import pack
from terrapix.llm.pii import find_pii
from terrapix.llm.ppm import ppm_score
from terrapix.llm.quality import score_quality
from terrapix.llm.suffix_dedup import suffix_dedup
from terrapix.llm.token_counts import token_counts

LONG = "word " * 60_000
ROWS = [(1, "some text", None, 1), (None, "no id", "x", None), (2, None, None, None), (3, "", "y", 0), (4, "some text", None, 1), (5, LONG, None, 1)]
OPERATORS = {
    "suffix": suffix_dedup,
    "tokens": token_counts,
    "packing": pack,
    "near": near_dedup,
    "exact": exact_dedup,
    "ppm": ppm_score,
    "pii": find_pii,
    "quality": lambda df: score_quality(df, df.selectExpr("doc_id", "quality")),
    "leaks": lambda df: digest(decontaminate(df, df.selectExpr("case when quality = 1 then doc_id end as item_id", "text"))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_nulls(spark, name):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, score string, quality int").selectExpr("*", "'z' as n_bytes", "1 as key", "2 as sig", "3 as block", "4 as shard", "5 as kept")
    assert {r.doc_id for r in OPERATORS[name](df).select("doc_id").collect()} == {1, 2, 3, 4, 5}


def test_pages(spark):
    df = spark.createDataFrame([(None, None, None), (1, None, "<p>x</p>")], "page_id long, url string, html string")
    assert {(r.page_id, r.text) for r in html_text(df).collect()} == {(None, ""), (1, "x")}
