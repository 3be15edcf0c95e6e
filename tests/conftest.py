"""One small Spark session for all tests, and helpers for tables of pages."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata/sf0.001"
_BLOCK = ("type", "level", "text", "original_url", "local_path", "alt_text", "items", "action", "method", "fields", "submit_text", "purpose", "provider", "src", "title", "caption", "headers", "rows", "language", "cite", "kind", "poster", "definitions")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "3g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def block(**values) -> dict:
    """A content block with only some fields set."""
    return dict.fromkeys(_BLOCK) | values


def heading(text, level=1):
    return block(type="heading", level=level, text=text)


def paragraph(text):
    return block(type="paragraph", text=text)


def items(*texts):
    return block(type="list", items=list(texts))


@pytest.fixture(scope="session")
def make_pages(spark):
    """Makes a table like page_data from dicts of some of its columns, with an extra column of a clashing name."""
    from pagemill.schemas import BLOCK

    ddl = (
        "page_id bigint, site string, url string, title string, meta_title string, meta_description string, canonical_url string, language string, meta_robots string, hreflang_alternates array<struct<lang:string,url:string>>, "
        f"nav_links array<struct<text:string,href:string,description:string,role:string>>, footer_blocks array<{BLOCK}>, structured_data array<string>, content_blocks array<{BLOCK}>, internal_links_out array<string>, loaded_at timestamp, text string, label int"
    )
    names = [x.split()[0] for x in ddl.split(", ")]

    def make(*rows):
        names_ = ["page_id", "site", "url", "title", "meta_title", "meta_description", "canonical_url", "language", "meta_robots", "hreflang_alternates", "nav_links", "footer_blocks", "structured_data", "content_blocks", "internal_links_out", "loaded_at", "text", "label"]
        assert set(names) >= {"page_id"}
        return spark.createDataFrame([tuple(r.get(n) for n in names_) for r in rows], ddl)

    return make


def rows_of(df, *columns):
    """Sorted tuples of some columns."""
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
