"""Queries of the core engine and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import blocks, contact, urls
from pagemill.functions.tables import DEFAULT_EXCLUDES
from pagemill.operators import brand, bundle, discover, nested, site
from pagemill.plans import cases, oracle, sinks
from pagemill.runtime import materialise, table
from pagemill.sources.pages import capture, derived, is_challenge

Query = Callable[[SparkSession, str], DataFrame]
_BLOCKS = ("title", "meta_description", "canonical_url", "meta_robots", "content_blocks", "structured_data")


def _raw(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "page_data")


def _facts(s: SparkSession, d: str, *names: str) -> DataFrame:
    return site.page_facts(_raw(s, d), *names)


def _each(s: SparkSession, d: str, *columns) -> DataFrame:
    """page_id and some expressions for each page; rows are narrow before they are shuffled."""
    return _raw(s, d).select("page_id", *columns).dropDuplicates(["page_id"])


def _html(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pages").where(~is_challenge(F.col("html")))


def _captured(s: SparkSession, d: str, *fields: str) -> DataFrame:
    """Captured pages with their site; small inputs of one file are spread over the cores."""
    return capture(_html(s, d), fields, partitions=s.sparkContext.defaultParallelism).withColumn("site", urls.host(F.col("url")))


def category_summary(s: SparkSession, d: str) -> DataFrame:
    """Pages and mean words by site and category, from raw HTML."""
    return site.category_counts(_captured(s, d, "title", "structured_data", "content_blocks"))


def _css(s: SparkSession, d: str) -> DataFrame:
    """The documents that hold a rule of style, as styles of their source."""
    return table(s, d, "documents").where(F.col("text").rlike(r"\{[^{}]*[a-z-]+\s*:[^{}]*\}")).select(F.col("source").alias("site"), F.col("text").alias("css"))


def _url_list(s: SparkSession, d: str) -> DataFrame:
    return _raw(s, d).groupBy("site", "url").agg(F.min("page_id").alias("ord"))


def _sitemaps(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Sitemaps of each site's pages, of about 500 pages each, below an index that also lists itself."""
    pages = _raw(s, d).where("site IS NOT NULL AND url IS NOT NULL").select("site", "url").distinct()
    parts = pages.groupBy("site").agg(F.ceil(F.count("*") / 500).alias("parts"))
    placed = pages.join(parts, "site").withColumn("part", F.pmod(F.xxhash64("url"), F.col("parts")))
    name = lambda part: F.concat(F.lit("https://"), F.col("site"), F.lit("/sitemap-"), part.cast("string"), F.lit(".xml"))
    escaped = F.replace("url", F.lit("&"), F.lit("&amp;"))
    files = placed.groupBy("site", "part").agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_list(F.concat(F.lit("<url><loc>"), escaped, F.lit("</loc></url>"))), ""), F.lit("</urlset>")).alias("body"))
    index_url = F.concat(F.lit("https://"), F.col("site"), F.lit("/sitemap.xml"))
    named = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1), lambda k: F.concat(F.lit("<loc>"), name(k), F.lit("</loc>")))
    index = parts.select("site", F.concat(F.lit("<sitemapindex><loc>"), index_url, F.lit("</loc>"), F.array_join(named, ""), F.lit("</sitemapindex>")).alias("body"))
    both = files.select(name(F.col("part")).alias("url"), "body").unionByName(index.select(index_url.alias("url"), "body"))
    return both, parts.select("site", index_url.alias("url"))


def _robots(s: SparkSession, d: str) -> DataFrame:
    body = "User-agent: *\nDisallow: /shop/\nDisallow: /legal\nDisallow: /blog$\nCrawl-delay: 1.5\n\nDisallow: /\n"
    return _raw(s, d).where("site IS NOT NULL").select("site").distinct().withColumn("body", F.lit(body))


def _edges(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "link_edges").select("site", "src_url", "dst_url", "link_pos")


def _bundles(s: SparkSession, d: str) -> DataFrame:
    """Site bundles as JSON; the captured pages feed many aggregates, so they are written once."""
    captured = materialise(_captured(s, d, *bundle.FIELDS).withColumn("total_words", blocks.total_words()).withColumn("quality_flags", blocks.quality_flags()), "captured")
    out = bundle.site_bundles(captured, table(s, d, "skipped_pages"))
    return out.select("site", "total_pages", F.to_json(F.struct(*(x for x in out.columns if x not in ("site", "total_pages")))).alias("bundle"))


def _enclosed(s: SparkSession, d: str) -> DataFrame:
    """Offers with the products that enclose them, by interval containment of their tables."""
    nodes = nested.node_table(_raw(s, d))
    return nested.contained(nested.type_table(nodes, "Offer"), nested.type_table(nodes, "Product"))


def queries() -> dict[str, Query]:
    """Every core query by name."""
    c = F.col
    return {
        "category_summary": category_summary,
        "p2_found": lambda s, d: nested.found(_raw(s, d)),
        "p2_nodes": lambda s, d: nested.node_table(_raw(s, d)),
        "p2_attributes": lambda s, d: nested.attribute_table(_raw(s, d)),
        "p2_block_attributes": lambda s, d: nested.block_attribute_table(_raw(s, d)),
        **{f"p2_nodes_{t.lower()}": lambda s, d, t=t: nested.type_table(nested.node_table(_raw(s, d)), t) for t in nested.NODE_TYPES},
        "p2_nodes_other": lambda s, d: nested.other_table(nested.node_table(_raw(s, d))),
        # URLs
        "url_canonical": lambda s, d: _raw(s, d).select("page_id", "url", urls.canonical(c("url")).alias("canonical")).distinct(),
        "url_slug": lambda s, d: _raw(s, d).select("page_id", urls.slug(c("url")).alias("slug"), urls.host_slug(c("url")).alias("host_slug")).distinct(),
        "url_priority": lambda s, d: _raw(s, d).select("page_id", urls.priority(c("url")).alias("priority")).distinct(),
        "url_filter": lambda s, d: _raw(s, d).where(urls.allowed(c("url"), DEFAULT_EXCLUDES)).select("page_id", "url").distinct(),
        "url_plan": lambda s, d: site.planned(_url_list(s, d), 50, DEFAULT_EXCLUDES),
        "url_images": lambda s, d: _raw(s, d).select("page_id", F.explode("content_blocks.original_url").alias("url")).where("url IS NOT NULL").select("page_id", "url", urls.asset_path(c("url")).alias("asset")).distinct(),
        # pages, from their blocks
        "page_words": lambda s, d: _each(s, d, blocks.total_words().alias("words")),
        "page_text": lambda s, d: _raw(s, d).select("page_id", blocks.plain_text().alias("t")).select("page_id", blocks.content_hash(c("t")).alias("content_hash"), F.expr("char_length(t) div 4").alias("token_estimate")).dropDuplicates(["page_id"]),
        "page_summary_text": lambda s, d: _each(s, d, blocks.summary().alias("summary")),
        "page_category": lambda s, d: _each(s, d, blocks.category().alias("category")),
        "page_signature": lambda s, d: _each(s, d, blocks.signature().alias("signature")),
        "page_sections": lambda s, d: _each(s, d, blocks.sections().alias("x")).select("page_id", F.inline("x")),
        "page_markdown": lambda s, d: sinks.markdown_pages(_raw(s, d)).dropDuplicates(["page_id"]),
        "page_compact": lambda s, d: sinks.compact(_raw(s, d)).withColumn("headings", F.coalesce(F.array_join("headings", "|"), F.lit(""))).dropDuplicates(["page_id"]),
        "quality_flags": lambda s, d: _facts(s, d, "quality_flags").select("page_id", F.array_join("quality_flags", ",").alias("flags")),
        "quality_flag_counts": lambda s, d: site.flag_counts(_facts(s, d, "quality_flags")),
        "embed_providers": lambda s, d: _raw(s, d).select("page_id", F.explode(F.arrays_zip(c("content_blocks.type").alias("type"), c("content_blocks.src").alias("src"))).alias("b")).where("b.type = 'embed'").select("page_id", c("b.src").alias("src"), blocks.embed_provider(c("b.src")).alias("provider")).distinct(),
        # sites
        "category_counts": lambda s, d: site.category_counts(_facts(s, d, "category", "total_words")),
        "templates": lambda s, d: site.template_counts(_facts(s, d, "signature")),
        "template_pages": lambda s, d: site.template_pages(_facts(s, d, "signature")),
        "hreflang_urls": lambda s, d: site.hreflang_urls(_raw(s, d)),
        "link_inbound": lambda s, d: site.inbound_links(_facts(s, d, "internal_links_out")),
        "edge_inbound": lambda s, d: _edges(s, d).where("src_url <> dst_url").select("site", "src_url", "dst_url").distinct().groupBy("site", "dst_url").agg(F.count("*").alias("sources")),
        "page_summaries": lambda s, d: site.page_summaries(_facts(s, d, "title", "meta_description", "category", "total_words", "block_count", "image_count", "has_form", "primary_heading", "internal_links_out")).drop("title", "meta_description"),
        "site_firsts": lambda s, d: site.first_values(_facts(s, d, "language", "nav_links", "footer_blocks")).select("site", "language", F.array_join("primary_nav.text", "|").alias("primary_nav"), "total_pages"),
        "skip_reasons": lambda s, d: site.skip_reasons(table(s, d, "skipped_pages")),
        "outcome_counts": lambda s, d: site.outcome_counts(_raw(s, d), table(s, d, "skipped_pages")),
        "site_bundles": lambda s, d: _bundles(s, d),
        # contacts
        "document_emails": lambda s, d: table(s, d, "documents").select("doc_id", F.explode(contact.emails_in(c("text"))).alias("email")).groupBy("doc_id", "email").agg(F.count("*").alias("k")),
        "site_contacts": lambda s, d: site.contacts(_captured(s, d, "contact_links", "body_text", "chrome_text", "social_links", "addresses", "organization", "content_blocks")),
        # brand
        "css_colours": lambda s, d: brand.colours(_css(s, d), None),
        "brand_confidence": lambda s, d: brand.confidence(brand.colours(_css(s, d)), brand.fonts(_css(s, d))),
        # discovery
        "crawl_depths": lambda s, d: discover.crawl(_edges(s, d), _edges(s, d).where("site IS NOT NULL").groupBy("site").agg(F.min("src_url").alias("url")), 3, None, DEFAULT_EXCLUDES),
        "robots_allowed": lambda s, d: discover.without_disallowed(_raw(s, d).where("site IS NOT NULL").select("site", "url").distinct(), discover.robots_rules(_robots(s, d))),
        "sitemap_pages": lambda s, d: discover.sitemap_urls(*_sitemaps(s, d)),
        # raw HTML
        "page_title": lambda s, d: _captured(s, d, "title").select("page_id", "title"),
        "page_language": lambda s, d: _captured(s, d, "language").select("page_id", "language"),
        "page_meta": lambda s, d: _captured(s, d, "title", "meta_title", "meta_description", "og_image_url", "twitter_card", "meta_robots", "canonical_url", "favicon_url", "logo_url").drop("url", "site"),
        "page_blocks": lambda s, d: _captured(s, d, "content_blocks").select("page_id", F.posexplode("content_blocks").alias("block_idx", "b")).select("page_id", "block_idx", "b.type", "b.level", "b.text", cases.block_detail(c("b")).alias("detail")),
        "page_links": lambda s, d: _captured(s, d, "internal_links_out").select("page_id", F.posexplode("internal_links_out").alias("link_pos", "url")),
        "page_nav": lambda s, d: _captured(s, d, "nav_links").select("page_id", F.inline("nav_links")),
        "page_footer": lambda s, d: _captured(s, d, "footer_blocks").select("page_id", F.explode("footer_blocks").alias("b")).select("page_id", "b.type", "b.text"),
        "page_derived": lambda s, d: derived(capture(_html(s, d), _BLOCKS, partitions=s.sparkContext.defaultParallelism)).select("page_id", "total_words", "content_hash", "token_estimate", "summary", "category", "signature", F.array_join("quality_flags", ",").alias("quality_flags")),
        "p2_enclosed": lambda s, d: _enclosed(s, d),
        **cases.queries(),
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query name."""
    return oracle.SQL | cases.oracle_sql()
