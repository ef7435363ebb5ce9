"""Titles and headings cut inside a character reference: each query against its SQL."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "scripts"))
import __spark_entry__ as entry  # noqa: E402
from check import rows_of  # noqa: E402

from siteglass.sources.markup import Page  # noqa: E402

NAMES = ["analysis_record", "extract_headings", "extract_text", "page_scores", "prepared_content", "prepared_with_summary", "trust_and_technical"]


@pytest.fixture(scope="module")
def cut(spark, tmp_path_factory):
    """Titles of about 30 letters and bodies of about 4,000, whose cut reference moves a length over a limit."""
    at = str(tmp_path_factory.mktemp("cut"))

    def page(i: int) -> tuple[int, str, str]:
        head = "T" * (24 + i % 8) + " b" + ("&amp;", "&amp", "&am", "&lt", "&amp;lt;")[i % 5]
        return i, f"https://e.com/de/{i}", (
            f"<html><head><title>{head}</title></head><body><article><h1>{head}</h1>\n<p>{'wor ' * (990 + i % 40)}&amp; &quot;x&quot;</p></article><footer>&copy; x</footer></body></html>"
        )

    spark.createDataFrame([page(i) for i in range(80)], "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    return at


@pytest.mark.parametrize("name", NAMES)
def test_cut_reference_matches_sql(spark, cut, name):
    con = pytest.importorskip("duckdb").connect()
    con.execute(f"create view pages as select * from '{cut}/pages.parquet/*.parquet'")
    frame = entry.queries()[name](spark, cut)
    result = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert rows_of(frame.columns, frame.collect()) == rows_of(columns, result.fetchall())


def test_both_readings_of_a_reference():
    source = '<a href="/x?a=1&amp;b&lt">a&ampb &lt;&#39;&#x41; &nope; &amp</a>'
    html, closed = Page(source), Page(source, closed_references=True)
    assert html.text == "a&b <'A &nope; &" and html.attrs[1]["href"] == "/x?a=1&b<"
    assert closed.text == "a&ampb <'A &nope; &amp" and closed.attrs[1]["href"] == "/x?a=1&b&lt"


@pytest.fixture(scope="module")
def cut_in_text(spark, tmp_path_factory):
    """A reference cut at each of its letters before each kind of tag of the main text."""
    at = str(tmp_path_factory.mktemp("cut_in_text"))
    pieces = [r[:k] for r in ("&amp;", "&quot;", "&lt;", "&copy;") for k in range(1, len(r) + 1)]

    def page(i: int) -> tuple[int, str, str]:
        p = pieces[i % len(pieces)]
        return i, f"https://e.com/de/{i}", (
            f"<html><head><title>T</title></head><body><article><h1>H</h1>\n<p><b>x{p}<br>y{p}<p>z &amp;{p}</p><p>{'wor ' * (985 + i % 30)}{p}</article><footer>&copy; x</footer></body></html>"
        )

    spark.createDataFrame([page(i) for i in range(10 * len(pieces))], "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    return at


@pytest.mark.parametrize("name", ["extract_text", "prepared_content", "prepared_with_summary"])
def test_cut_in_main_text_matches_sql(spark, cut_in_text, name):
    con = pytest.importorskip("duckdb").connect()
    con.execute(f"create view pages as select * from '{cut_in_text}/pages.parquet/*.parquet'")
    frame = entry.queries()[name](spark, cut_in_text)
    result = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert rows_of(frame.columns, frame.collect()) == rows_of(columns, result.fetchall())
