"""A whole run: from a table of raw pages to the outputs of each site, by one configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.config import EngineConfig
from pagemill.functions import urls
from pagemill.operators import bundle, discover, site
from pagemill.plans import sinks
from pagemill.runtime import materialise
from pagemill.schemas import PAGE_FIELDS
from pagemill.sources.pages import capture, derived, is_challenge


def selected(pages: DataFrame, config: EngineConfig, robots: DataFrame | None = None, sitemaps: DataFrame | None = None, links: DataFrame | None = None) -> DataFrame:
    """The raw pages (page_id, url, html) that a run keeps: one for each canonical URL, filtered and capped by site.

    With ``sitemaps`` (url, body), only pages that a site's ``/sitemap.xml`` leads to; else with ``links`` (site, src_url, dst_url,
    link_pos), only those that a crawl of at most ``max_depth`` levels finds from a site's first page. The order of pages is
    that of page_id. Filters read URLs only and come before the extractor.
    """
    rows = pages.select("page_id", "url").withColumn("site", urls.host(F.col("url")))
    if config.site:
        rows = rows.where(F.col("site") == config.site)
    listed = rows.select("site", "url", F.col("page_id").alias("ord"))
    if sitemaps is not None:
        start = listed.where("site IS NOT NULL").select("site", F.concat(F.regexp_extract("url", r"^([a-z]+://[^/?#]+)", 1), F.lit("/sitemap.xml")).alias("url")).distinct()
        named = discover.sitemap_urls(sitemaps, start)
        listed = listed.join(named.distinct(), ["site", "url"], "left_semi")
    elif links is not None:
        start = listed.where("site IS NOT NULL").groupBy("site").agg(F.min_by("url", "ord").alias("url"))
        found = discover.crawl(links, start, config.max_depth, config.max_pages, config.exclude_patterns)
        listed = listed.join(found.select("site", "url").distinct(), ["site", "url"], "left_semi")
    if robots is not None and config.respect_robots:
        listed = discover.without_disallowed(listed, discover.robots_rules(robots, config.robots_agent))
    kept = site.planned(listed, config.max_pages, config.exclude_patterns, config.include_patterns).select(F.col("ord").alias("page_id"))
    return pages.join(kept.distinct(), "page_id", "left_semi")


def captured_pages(pages: DataFrame, config: EngineConfig) -> DataFrame:
    """Captured and derived pages; without brand mining, styles aren't worked out."""
    fields = config.fields or tuple(f for f in PAGE_FIELDS if f != "crawl_links" and (config.extract_brand or f not in ("style_text", "stylesheet_urls")))
    out = derived(capture(pages, fields, config.max_images_per_page, config.legacy_container_guard, config.partitions))
    if config.drop_unfetched_images:
        out = out.withColumn("content_blocks", F.filter("content_blocks", lambda b: (b["type"] != "image") | (F.coalesce(b["local_path"], F.lit("")) != "")))
    return out


def run(
    spark: SparkSession, pages: DataFrame, config: EngineConfig, robots: DataFrame | None = None, skipped: DataFrame | None = None, stylesheets: DataFrame | None = None, sitemaps: DataFrame | None = None, links: DataFrame | None = None, probes: DataFrame | None = None,
) -> DataFrame:
    """Writes all outputs below ``config.output_dir`` and returns the captured pages.

    A status file says ``incomplete`` until everything is written. Challenge pages count as skipped (bot_protected). ``probes``
    are raw pages (page_id, url, html) that sites gave for addresses that don't exist (``fetch.probe_urls``); with
    ``capture_404`` they are captured apart, as ``error_pages``.
    """
    root = config.output_dir.rstrip("/")
    sinks.mark_status(spark, f"{root}/status", "incomplete")
    chosen = selected(pages, config, robots, sitemaps, links)
    challenged = chosen.where(is_challenge(F.col("html"))).select(urls.host(F.col("url")).alias("site"), "url", F.lit("bot_protected").alias("reason"))
    lost = challenged if skipped is None else challenged.unionByName(skipped.select("site", "url", "reason"))
    found = materialise(captured_pages(chosen.where(~is_challenge(F.col("html"))), config), "captured")
    sinks.write_jsonl(found, f"{root}/scraped")
    if config.site:
        sinks.write_master(found.dropDuplicates(["page_id"]), f"{root}/master")
    if config.split_pages:
        sinks.write_split_pages(found, f"{root}/pages")
    if config.markdown:
        sinks.write_markdown(found, f"{root}/markdown")
    if config.capture_404 and probes is not None:
        sinks.write_jsonl(captured_pages(probes, config).withColumn("is_error_page", F.lit(True)), f"{root}/error_pages")
    sinks.write_rows_as_json(sinks.compact(found), f"{root}/compact")
    summaries = materialise(site.page_summaries(found, config.canonical_links), "summaries")
    sinks.write_rows_as_json(summaries, f"{root}/sitemap")
    listed = pages.select(F.lit(config.site).alias("site"), "url") if config.site else None
    bundles = materialise(bundle.site_bundles(found, lost, stylesheets if config.use_external_css else None, with_brand=config.extract_brand, listed=listed), "bundles")
    sinks.write_rows_as_json(bundles.select("site", "contact.*"), f"{root}/contact")
    if config.extract_brand:
        sinks.write_rows_as_json(bundles.select("site", "favicon_url", "colors", "fonts", "css_variables", "webfonts", "confidence", "logo_url"), f"{root}/brand")
    sinks.write_rows_as_json(bundles, f"{root}/site")
    sinks.write_rows_as_json(lost.where("site IS NOT NULL").distinct(), f"{root}/skipped")
    index = sinks.index_lines(bundles, summaries, lost)
    index.repartition("site").sortWithinPartitions("site", "part", "line_no", "line").select("site", F.col("line").alias("value")).write.mode("overwrite").partitionBy("site").text(f"{root}/index")
    spark.createDataFrame([(sinks.json_schema(sinks.exported(found)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/schema")
    sinks.asset_manifest(spark, root).write.mode("overwrite").json(f"{root}/assets")
    sinks.mark_status(spark, f"{root}/status", "complete")
    return found
