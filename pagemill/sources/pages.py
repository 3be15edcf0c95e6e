"""Capturing pages: one pass of the extractor over a table of raw HTML, and what is derived from its fields.

Each page is parsed once; only the fields asked for are worked out, as the optimizer can't see into the extractor. Null
HTML is an empty document, a null URL has no base (links stay out); rows are kept as they are.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from pagemill.functions import blocks, urls
from pagemill.functions.tables import CHALLENGES
from pagemill.schemas import PAGE_FIELDS
from pagemill.sources.extract import Page

_META = ("title", "meta_title", "meta_description", "og_image_url", "twitter_card", "meta_robots")
_CALLS = {
    "canonical_url": Page.canonical_url, "language": Page.language, "favicon_url": Page.favicon_url, "logo_url": Page.logo_url, "hreflang_alternates": Page.hreflang_alternates, "nav_links": Page.nav_links,
    "footer_blocks": Page.footer_blocks, "internal_links_out": Page.internal_links, "crawl_links": Page.crawl_links, "stylesheet_urls": Page.stylesheet_urls, "style_text": Page.style_text, "body_text": Page.body_text, "chrome_text": Page.chrome_text,
    "contact_links": Page.contact_links, "social_links": Page.social_links, "addresses": Page.addresses, "organization": Page.organization,
    "structured_data": lambda p: [json.dumps(v, ensure_ascii=False) for v in p.structured()],
}


def extract_page(url: str | None, html: str | None, fields: tuple[str, ...], max_images: int = 100, legacy_container_guard: bool = False) -> dict:
    """Some fields of one page."""
    page = Page(url or "", html or "")
    out = page.meta() if any(f in _META for f in fields) else {}
    for name in fields:
        if name == "content_blocks":
            out[name] = page.content_blocks(max_images, legacy_container_guard)
        elif name not in _META:
            out[name] = _CALLS[name](page)
    return {name: out[name] for name in fields}


def capture(pages: DataFrame, fields: tuple[str, ...] = tuple(PAGE_FIELDS), max_images: int = 100, legacy_container_guard: bool = False, partitions: int | None = None) -> DataFrame:
    """page_id and url of each page of ``pages`` with the fields asked for; ``partitions`` spreads few large files."""
    ddl = "page_id bigint, url string, " + ", ".join(f"{f} {PAGE_FIELDS[f]}" for f in fields)
    kind = _parse_datatype_string(ddl)
    assert isinstance(kind, StructType)
    schema = to_arrow_schema(kind)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                rows = whole.slice(at, 200).to_pylist()
                yield pa.RecordBatch.from_pylist([{"page_id": r["page_id"], "url": r["url"]} | extract_page(r["url"], r["html"], fields, max_images, legacy_container_guard) for r in rows], schema=schema)

    wanted = pages.select("page_id", "url", "html")
    return (wanted.repartition(partitions, "page_id") if partitions else wanted).mapInArrow(work, kind)


def is_challenge(html):
    """Whether a page is a bot challenge in place of content."""
    return F.coalesce(urls.contains_any(F.lower(html), CHALLENGES), F.lit(False))


def derived(captured: DataFrame) -> DataFrame:
    """Captured pages with site, plain text, hash, words, tokens, summary, assets, template signature, category and flags."""
    out = captured.withColumn("site", urls.host(F.col("url"))).withColumn("plain_text", blocks.plain_text()).withColumn("total_words", blocks.total_words())
    out = out.withColumn("content_hash", blocks.content_hash(F.col("plain_text"))).withColumn("token_estimate", F.expr("char_length(plain_text) div 4")).withColumn("summary", blocks.summary())
    out = out.withColumn("page_assets", blocks.assets()).withColumn("signature", blocks.signature()).withColumn("category", blocks.category())
    return out.withColumn("quality_flags", blocks.quality_flags()).withColumn("sections", blocks.sections())
