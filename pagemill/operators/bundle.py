"""The bundle of a site: all its aggregates in one row, for export.

Lists that grow with the number of pages (the sitemap, the pages of a template, the URLs of a language) are tables of
their own; the bundle has their counts. Input are captured pages with ``site`` and the fields in ``FIELDS``; sites without some detail have empty lists.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.operators import brand, site

FIELDS = (
    "title", "meta_description", "canonical_url", "meta_robots", "language", "favicon_url", "logo_url", "hreflang_alternates", "nav_links", "footer_blocks", "structured_data", "content_blocks", "internal_links_out", "stylesheet_urls",
    "style_text", "body_text", "chrome_text", "contact_links", "social_links", "addresses", "organization",
)


def _listed(df: DataFrame, alias: str, *columns: str, order: str | None = None) -> DataFrame:
    """The rows of each site as one list of structs, in the order of a number (falling), then of the columns."""
    key = [(-F.col(order)).alias("_order")] if order else []
    rows = df.groupBy("site").agg(F.array_sort(F.collect_list(F.struct(*key, *columns))).alias(alias))
    return rows.select("site", F.transform(alias, lambda x: F.struct(*(x[c].alias(c) for c in columns))).alias(alias))


def brands(captured: DataFrame, stylesheets: DataFrame | None = None, most: int = 12) -> DataFrame:
    """Palettes: colours, fonts, variables, web fonts, confidence, logo and icon of each site."""
    css = brand.styles(captured, stylesheets)
    sheets = brand.webfonts(captured)
    colours, fonts = brand.colours(css, most), brand.with_webfonts(brand.fonts(css, most), sheets, most)
    icons = captured.groupBy("site").agg(F.min_by(F.when(F.col("favicon_url").isNotNull(), F.col("favicon_url")), F.when(F.col("favicon_url").isNotNull(), F.col("page_id"))).alias("favicon_url"))
    out = icons
    for part in (
        _listed(colours, "colors", "value", "count", order="count"), _listed(fonts, "fonts", "family", "count", order="count"), _listed(brand.variables(css, 2 * most), "css_variables", "name", "value", "count", order="count"),
        _listed(sheets, "webfonts", "provider", "families", "url"), brand.confidence(colours, fonts), site.common_logo(captured),
    ):
        out = out.join(part, "site", "left")
    return out


def site_bundles(captured: DataFrame, skipped: DataFrame | None = None, stylesheets: DataFrame | None = None, most: int = 12, with_brand: bool = True, listed: DataFrame | None = None) -> DataFrame:
    """One row per site: pages, language, navigation, footer, contact, brand, technologies, templates, languages, warnings.

    ``listed`` are the URLs (site, url) that a site's sitemap or list named, for the warning that most are another host's.
    """
    contacts = site.contacts(captured)
    contact = contacts.select("site", F.struct(*(c for c in contacts.columns if c != "site")).alias("contact"))
    warnings = site.shell_warnings(captured)
    if skipped is not None:
        warnings = warnings.unionByName(site.partial_warnings(captured, skipped).select("site", "warning"))
    if listed is not None:
        warnings = warnings.unionByName(site.foreign_hosts(listed).select("site", "warning"))
    out = site.first_values(captured).drop("favicon_url")
    if with_brand:
        out = out.join(brands(captured, stylesheets, most), "site", "left").join(_listed(brand.technologies(captured), "frameworks", "framework", "confidence", "evidence"), "site", "left")
    for part in (
        contact, _listed(site.template_counts(captured), "templates", "template_id", "block_pattern", "page_count", "sample_page", order="page_count"), _listed(site.flag_counts(captured), "quality_flags", "flag", "pages", order="pages"),
        _listed(site.hreflang_urls(captured).groupBy("site", "lang").agg(F.count("*").alias("urls")), "hreflang_groups", "lang", "urls"), warnings.groupBy("site").agg(F.array_sort(F.collect_set("warning")).alias("quality_warnings")),
    ):
        out = out.join(part, "site", "left")
    return out
