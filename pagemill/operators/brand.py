"""Brand palettes: colours, fonts, variables and web fonts of each site, from captured pages with ``style_text``.

Ties are broken by the smaller text; sites without styles have no rows; nulls count as empty styles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import style
from pagemill.functions.tables import THEMES


def styles(captured: DataFrame, stylesheets: DataFrame | None = None, most: int = 20, max_bytes: int = 5_000_000) -> DataFrame:
    """Style texts of each site: those of pages, and the first ``most`` external sheets (by URL) they link to, if a table of them (url, css) is given."""
    own = captured.select("site", F.col("style_text").alias("css")).where("css <> ''")
    if stylesheets is None:
        return own
    linked = captured.select("site", F.explode("stylesheet_urls").alias("url")).distinct()
    first = linked.withColumn("rank", F.row_number().over(Window.partitionBy("site").orderBy("url"))).where(F.col("rank") <= most)
    return own.unionByName(first.join(stylesheets.where(F.octet_length("css") < max_bytes), "url").select("site", "css"))


def _top(counts: DataFrame, order: list[Column], most: int | None) -> DataFrame:
    if most is None:
        return counts
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("site").orderBy(*order))).where(F.col("rank") <= most).drop("rank")


def colours(css: DataFrame, most: int | None = 12) -> DataFrame:
    """Colours of each site by number of uses, without those of a theme that is there with three or more."""
    counts = css.select("site", F.explode(style.colours(F.col("css"))).alias("value")).groupBy("site", "value").agg(F.count("*").alias("count"))
    themes = F.broadcast(css.sparkSession.createDataFrame([(k, c) for k, t in enumerate(THEMES) for c in t], "theme int, value string"))
    full = counts.join(themes, "value").groupBy("site", "theme").agg(F.count("*").alias("hits")).where("hits >= 3")
    blocked = full.join(themes, "theme").select("site", "value").distinct()
    return _top(counts.join(blocked, ["site", "value"], "left_anti"), [F.desc("count"), F.col("value")], most)


def fonts(css: DataFrame, most: int | None = 12) -> DataFrame:
    """Fonts of each site by number of uses; weights and styles of a family count together, under its commonest name."""
    raw = css.select("site", F.explode(style.fonts(F.col("css"))).alias("family")).groupBy("site", "family").agg(F.count("*").alias("k"))
    merged = raw.groupBy("site", style.base_family(F.col("family")).alias("base")).agg(F.min_by("family", F.struct(-F.col("k"), "family")).alias("family"), F.sum("k").alias("count"))
    return _top(merged.select("site", "family", "count"), [F.desc("count"), F.col("family")], most)


def variables(css: DataFrame, most: int | None = 24) -> DataFrame:
    """Custom properties of each site by number of uses."""
    counts = css.select("site", F.explode(style.variables(F.col("css"))).alias("v")).groupBy("site", "v.name", "v.value").agg(F.count("*").alias("count"))
    return _top(counts, [F.desc("count"), F.col("name"), F.col("value")], most)


def webfonts(captured: DataFrame) -> DataFrame:
    """Style sheets of web-font providers: site, provider, families, url."""
    url = F.col("url")
    rows = captured.select("site", F.explode("stylesheet_urls").alias("url")).distinct()
    return rows.where(style.webfont_provider(url).isNotNull()).select("site", style.webfont_provider(url).alias("provider"), style.webfont_families(url).alias("families"), "url")


def with_webfonts(found: DataFrame, sheets: DataFrame, most: int | None = 12) -> DataFrame:
    """Fonts with five more uses for each web-font sheet that names them."""
    extra = sheets.select("site", F.explode("families").alias("family"), F.lit(5).cast("bigint").alias("count")).where(~F.lower("family").endswith("-fallback"))
    merged = found.select("site", "family", "count").unionByName(extra).groupBy("site", "family").agg(F.sum("count").alias("count"))
    return _top(merged, [F.desc("count"), F.col("family")], most)


def confidence(top_colours: DataFrame, top_fonts: DataFrame) -> DataFrame:
    """How sure a palette is, by its most used colour and font: high, medium or low."""
    c = top_colours.groupBy("site").agg(F.max("count").alias("c"))
    f = top_fonts.groupBy("site").agg(F.max("count").alias("f"))
    a, b = F.coalesce("c", F.lit(0)), F.coalesce("f", F.lit(0))
    most, least = F.greatest(a, b), F.least(a, b)
    level = F.when((most >= 30) & (least >= 5), "high").when((most >= 10) & (least >= 3), "medium").otherwise("low")
    return c.join(f, "site", "full").select("site", level.alias("confidence"))


def technologies(captured: DataFrame, html: DataFrame | None = None) -> DataFrame:
    """Technologies of each site: by the first three pages' styles, sheets and links, or by the markup of all pages (site, html)."""
    if html is not None:
        each = html.select("site", F.explode(style.frameworks(F.col("html"))).alias("h"))
        return each.groupBy("site", "h.framework", "h.confidence").agg(F.count("*").alias("pages"))
    first = captured.withColumn("rank", F.row_number().over(Window.partitionBy("site").orderBy("page_id"))).where("rank <= 3")
    text = F.concat_ws("\n", F.array_join("stylesheet_urls", "\n"), F.array_join("internal_links_out", "\n"), "style_text")
    joined = first.groupBy("site").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", text.alias("t")))), lambda x: x["t"]), "\n").alias("text"))
    return joined.select("site", F.inline(style.frameworks(F.col("text"))))
