"""Command line: ``python -m pagemill PAGES -o OUTPUT``, where PAGES is a Parquet table of page_id, url and html."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from pagemill.config import EngineConfig
from pagemill.plans.run import run
from pagemill.runtime import materialise
from pagemill.sources import fetch


def parser() -> argparse.ArgumentParser:
    """The options; their defaults are those of ``EngineConfig``."""
    p = argparse.ArgumentParser(prog="pagemill", description="Turns raw web pages into structured site data.")
    p.add_argument("pages", help="Parquet table of raw pages")
    p.add_argument("-u", "--site", help="only this host")
    p.add_argument("-o", "--output", default="output", help="folder of the outputs")
    p.add_argument("-m", "--max-pages", type=int, help="most pages of a site (1,000)")
    p.add_argument("--exclude", action="append", default=[], help="drop URLs with this text")
    p.add_argument("--include", action="append", default=[], help="keep only URLs with one of these texts")
    p.add_argument("--no-default-excludes", action="store_true")
    p.add_argument("--robots", help="Parquet table of robots files (site, body)")
    p.add_argument("--ignore-robots", action="store_true")
    p.add_argument("--stylesheets", help="Parquet table of style sheets (url, css)")
    p.add_argument("--no-fetch-css", action="store_true")
    p.add_argument("--no-extract-brand", action="store_true")
    p.add_argument("--max-images-per-page", type=int, default=100)
    p.add_argument("--split-pages", action="store_true")
    p.add_argument("--markdown", action="store_true")
    p.add_argument("-d", "--max-depth", type=int, default=3, help="levels of a crawl over --links")
    p.add_argument("--links", help="Parquet table of links (site, src_url, dst_url, link_pos): keep what a crawl finds")
    p.add_argument("--sitemaps", help="Parquet table of sitemaps (url, body): keep what they list")
    p.add_argument("--skipped", help="Parquet table of pages that could not be had (site, url, reason)")
    p.add_argument("--capture-404", help="Parquet table of the raw pages of probes")
    p.add_argument("--fetch", action="store_true", help="PAGES is a table of URLs (site, url) to fetch first")
    p.add_argument("-t", "--timeout", type=float, default=30.0, help="seconds a fetch may take")
    p.add_argument("--delay", type=int, default=0, help="milliseconds between the fetches of a host")
    p.add_argument("--user-agent", help="sent with each fetch")
    p.add_argument("--header", action="append", default=[], help="sent with each fetch, as NAME: VALUE")
    p.add_argument("--test-run", action="store_true", help="at most ten pages of a site, unless -m says otherwise")
    p.add_argument("-q", "--quiet", action="store_true", help="log errors only")
    p.add_argument("-v", "--verbose", action="store_true", help="log what the session does")
    p.add_argument("-c", "--partitions", type=int, help="tasks of the extractor")
    return p


def config_of(args: argparse.Namespace) -> EngineConfig:
    """The configuration that the options ask for."""
    return EngineConfig(
        site=args.site, output_dir=args.output, max_pages=args.max_pages or (10 if args.test_run else 1_000), max_depth=args.max_depth, capture_404=args.capture_404 is not None, default_excludes=not args.no_default_excludes, excludes=tuple(args.exclude), includes=tuple(args.include), respect_robots=not args.ignore_robots,
        use_external_css=not args.no_fetch_css, extract_brand=not args.no_extract_brand, max_images_per_page=args.max_images_per_page, split_pages=args.split_pages, markdown=args.markdown, partitions=args.partitions,
    )


def headers_of(args: argparse.Namespace) -> dict[str, str]:
    """Headers of fetches."""
    named = dict(h.split(":", 1) for h in args.header if ":" in h)
    return {k.strip(): v.strip() for k, v in named.items()} | ({"User-Agent": args.user_agent} if args.user_agent else {})


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("pagemill").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR" if args.quiet else "INFO" if args.verbose else "WARN")
    read = lambda path: spark.read.parquet(path) if path else None
    pages, skipped = read(args.pages), read(args.skipped)
    if args.fetch:
        answers = materialise(fetch.fetch(pages, args.delay, args.timeout, headers=headers_of(args)), "fetched")
        pages, missed = fetch.raw_pages(answers), fetch.skipped_pages(answers).select("site", "url", "reason")
        skipped = missed if skipped is None else missed.unionByName(skipped.select("site", "url", "reason"))
    run(spark, pages, config_of(args), robots=read(args.robots), skipped=skipped, stylesheets=read(args.stylesheets), sitemaps=read(args.sitemaps), links=read(args.links), probes=read(args.capture_404))


if __name__ == "__main__":
    main()
