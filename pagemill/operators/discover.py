"""Discovery of pages: robots rules, nested sitemaps and breadth-first crawls over tables of fetched documents.

Loops run one join a level on the driver's plan; only the number of new rows comes back. Frontiers are written tables.
"""

from __future__ import annotations

import html as markup
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import urls
from pagemill.runtime import broadcast_if_small, materialise

ROBOTS = "struct<disallow:array<string>,crawl_delay_ms:bigint>"


def read_robots(body: str | None, agent: str = "pagemill") -> dict:
    """Rules of a robots file for an agent: paths in order and the longest delay.

    A group ends at a blank line or a comment, and the last agent line before its rules decides whom they are for.
    """
    paths: list[str] = []
    delay: int | None = None
    ours = False
    for raw in (body or "").splitlines():
        line = raw.partition("#")[0].strip()
        low = line.lower()
        if low.startswith("user-agent:"):
            name = low[11:].strip()
            ours = name == "*" or agent.lower() in name
        elif not line:
            ours = False
        elif ours:
            rule = re.search(r"disallow:(.*)", line, re.I)
            pause = None if rule else re.search(r"crawl-delay:(.*)", line, re.I)
            if rule and rule[1].strip():
                paths.append(rule[1].strip())
            elif pause:
                try:
                    delay = max(delay or 0, int(float(pause[1].strip()) * 1000))
                except (ValueError, OverflowError):
                    continue
    return {"disallow": paths, "crawl_delay_ms": delay}


def robots_rules(robots: DataFrame, agent: str = "pagemill") -> DataFrame:
    """site, disallow and crawl_delay_ms from a table of robots files (site, body)."""

    @F.pandas_udf(ROBOTS)
    def parse(bodies: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in bodies:
            yield pd.DataFrame([read_robots(b, agent) for b in s], columns=["disallow", "crawl_delay_ms"]).astype({"crawl_delay_ms": "Int64"})

    return robots.select("site", parse("body").alias("r")).select("site", "r.*")


def without_disallowed(url_list: DataFrame, rules: DataFrame) -> DataFrame:
    """URLs (site, url) that no rule of their site covers."""
    joined = url_list.join(broadcast_if_small(rules.select("site", "disallow")), "site", "left")
    return joined.where(~F.coalesce(urls.disallowed(F.col("url"), F.col("disallow")), F.lit(False))).drop("disallow")


def sitemap_urls(sitemaps: DataFrame, start: DataFrame) -> DataFrame:
    """Page URLs below some sitemaps: site, url. ``sitemaps`` holds fetched files (url, body), ``start`` the first ones (site, url).

    Entries whose path ends in ``.xml`` are read as sitemaps themselves, each once; texts and data files are left out; a
    body that is no sitemap stands for its own URL. Rounds end when one finds no new sitemap, however deep they are nested.
    """
    locations = F.regexp_extract_all("body", F.lit(r"(?is)<loc[^>]*>\s*(.*?)\s*</loc>"), F.lit(1))
    is_map = F.lower("body").rlike("<(urlset|sitemapindex)")

    @F.pandas_udf("string")
    def unescape(s: pd.Series) -> pd.Series:
        return s.map(lambda x: markup.unescape(re.sub(r"^<!\[CDATA\[(.*)\]\]>$", r"\1", x)).strip() if x is not None else None)

    bodies = sitemaps.dropDuplicates(["url"])
    todo = materialise(start.select("site", "url").distinct(), "frontier")
    seen, pages = todo, None
    while True:
        read = bodies.join(todo, "url").select("site", "url", F.explode(F.when(is_map, locations).otherwise(F.array("url"))).alias("loc"), is_map.alias("listed"))
        read = materialise(read.select("site", unescape("loc").alias("loc"), "listed"), "entries")
        path = F.lower(F.regexp_replace("loc", r"[?#].*$", ""))
        leaf = read.where(~F.col("listed") | ~path.rlike(r"\.(xml|txt|md|json)$")).select("site", F.col("loc").alias("url"))
        pages = leaf if pages is None else materialise(pages.unionByName(leaf), "pages")
        todo = materialise(read.where(F.col("listed") & path.endswith(".xml")).select("site", F.col("loc").alias("url")).distinct().join(seen, ["site", "url"], "left_anti"), "frontier")
        if todo.isEmpty():
            return pages.distinct()
        seen = materialise(seen.unionByName(todo), "seen")


def crawl(edges: DataFrame, start: DataFrame, max_depth: int = 3, max_pages: int | None = 1_000, excludes=()) -> DataFrame:
    """Pages that a crawl of each site finds: site, url, depth. ``edges`` are links (site, src_url, dst_url, link_pos), ``start`` the first pages.

    Only links to the page's own host that hold no excluded substring are followed; a page at ``max_depth`` is kept but
    not expanded. Of a level, pages come in the order of their first link: by the place of the linking page, then of the link.
    ``max_pages`` (per site) keeps the first ones; None keeps all, and then no order is worked out.
    """
    same = urls.host(F.col("dst_url")) == urls.host(F.col("src_url"))
    links = edges.where(same & urls.allowed(F.col("dst_url"), excludes)).select("site", "src_url", "dst_url", "link_pos")
    links = materialise(links.withColumn("dst_url", F.regexp_replace("dst_url", "#.*$", "")), "links")
    level = materialise(start.select("site", "url").distinct().withColumn("depth", F.lit(0)).withColumn("place", F.lit(0).cast("bigint")), "level")
    seen = level
    for depth in range(1, max_depth + 1):
        out = level.join(links, [level["site"] == links["site"], level["url"] == links["src_url"]]).select(level["site"], F.col("dst_url").alias("url"), "place", "link_pos")
        first = out.groupBy("site", "url").agg(F.min(F.struct("place", "link_pos")).alias("at")).join(seen.select("site", "url"), ["site", "url"], "left_anti")
        if max_pages is None:
            ranked = first.select("site", "url", F.lit(depth).alias("depth"), F.lit(0).cast("bigint").alias("place"))
        else:
            # no more than max_pages of a site's level can be kept
            rank = F.row_number().over(Window.partitionBy("site").orderBy("at", "url")).cast("bigint")
            ranked = first.withColumn("place", rank).where(F.col("place") <= max_pages).select("site", "url", F.lit(depth).alias("depth"), "place")
        level = materialise(ranked, "level")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    if max_pages is None:
        return seen.select("site", "url", "depth")
    rank = F.row_number().over(Window.partitionBy("site").orderBy("depth", "place", "url"))
    return seen.withColumn("rank", rank).where(F.col("rank") <= max_pages).select("site", "url", "depth")
