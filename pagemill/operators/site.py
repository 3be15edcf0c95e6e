"""Aggregates of a site's pages. Every one is per ``site``; ties are broken by the smaller text.

Inputs are captured pages (``capture`` and ``derived``) or tables of the same columns. Redelivered rows are dropped by
``first_delivery``; null sites are a site of their own; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import blocks, contact, urls
from pagemill.runtime import materialise


def first_delivery(page_data: DataFrame) -> DataFrame:
    """One row for each page_id: redelivered rows hold the same page. It shuffles whole rows; see ``page_facts``."""
    return page_data.dropDuplicates(["page_id"])


#: What aggregates need to know of a page, worked out from its blocks.
FACTS = {
    "category": blocks.category, "total_words": blocks.total_words, "block_count": blocks.block_count, "image_count": lambda: blocks.count_of("image"), "has_form": lambda: blocks.count_of("form") > 0,
    "primary_heading": lambda: blocks.first_text("heading"), "signature": blocks.signature, "quality_flags": blocks.quality_flags,
}


def page_facts(page_data: DataFrame, *names: str) -> DataFrame:
    """page_id, site, url and some facts or columns of each page, once. Blocks are reduced to facts before rows are shuffled."""
    wanted = page_data
    if "quality_flags" in names:  # they are told from the words of the blocks
        wanted = wanted.withColumn("total_words", blocks.total_words())
    columns = [fact(wanted, n).alias(n) for n in names]
    return wanted.select("page_id", "site", "url", *columns).dropDuplicates(["page_id"])


def fact(pages: DataFrame, name: str) -> Column:
    """A fact of pages: its expression over the blocks if those are there, else the column of that name."""
    return FACTS[name]() if name in FACTS and "content_blocks" in pages.columns else F.col(name)


def page_summaries(pages: DataFrame, canonical_links: bool = False) -> DataFrame:
    """One row per page: title, category, counts of words, blocks and images, first heading, links out and in."""
    link = urls.canonical(F.col("target")) if canonical_links else F.col("target")
    inbound = inbound_links(pages, link)
    url = F.when(F.lit(canonical_links), urls.canonical(F.col("url"))).otherwise(F.col("url"))
    rows = pages.select(
        "page_id", "site", "url", "title", "meta_description", fact(pages, "category").alias("category"), fact(pages, "total_words").alias("word_count"), *(fact(pages, n).alias(n) for n in ("block_count", "image_count", "has_form", "primary_heading")), F.greatest(F.coalesce(F.size("internal_links_out"), F.lit(0)), F.lit(0)).alias("internal_links_out"), url.alias("key"),
    )
    joined = rows.join(inbound, [rows["site"].eqNullSafe(inbound["link_site"]), rows["key"] == inbound["target"]], "left")
    return joined.select(*[c for c in rows.columns if c != "key"], F.coalesce("internal_links_in", F.lit(0)).alias("internal_links_in"))


def inbound_links(pages: DataFrame, link: Column | None = None) -> DataFrame:
    """How many pages of the site link to each target: link_site, target, internal_links_in."""
    each = pages.select(F.col("site").alias("link_site"), F.explode(F.array_distinct("internal_links_out")).alias("target"))
    return each.withColumn("target", link if link is not None else F.col("target")).groupBy("link_site", "target").agg(F.count("*").alias("internal_links_in"))


def templates(pages: DataFrame) -> DataFrame:
    """Block patterns that two pages of a site or more share, with lists of their pages, for exports of small sites.

    At any size, ``template_counts`` and ``template_pages`` give the same in short rows.
    """
    signed = pages.select("site", "url", fact(pages, "signature").alias("signature")).where("signature <> ''")
    groups = signed.groupBy("site", "signature").agg(F.count("*").alias("page_count"), F.array_sort(F.collect_list("url")).alias("pages"), F.min("url").alias("sample_page")).where("page_count >= 2")
    return groups.select("site", F.concat(F.lit("tpl_"), F.left(F.sha2("signature", 256), F.lit(8))).alias("template_id"), F.split("signature", ",").alias("block_pattern"), "page_count", "pages", "sample_page")


def template_counts(pages: DataFrame) -> DataFrame:
    """The same without the lists of pages, so that a template of any size is one small row."""
    signed = pages.select("site", "url", fact(pages, "signature").alias("signature")).where("signature <> ''")
    groups = signed.groupBy("site", "signature").agg(F.count("*").alias("page_count"), F.min("url").alias("sample_page")).where("page_count >= 2")
    return groups.select("site", F.concat(F.lit("tpl_"), F.left(F.sha2("signature", 256), F.lit(8))).alias("template_id"), F.col("signature").alias("block_pattern"), "page_count", "sample_page")


def template_pages(pages: DataFrame) -> DataFrame:
    """The pages of each template: site, template_id, url."""
    signed = pages.select("site", "url", fact(pages, "signature").alias("signature")).where("signature <> ''")
    many = signed.groupBy(F.col("site").alias("_site"), F.col("signature").alias("_signature")).agg(F.count("*").alias("k")).where("k >= 2")
    joined = signed.join(many, F.col("site").eqNullSafe(F.col("_site")) & (F.col("signature") == F.col("_signature")))
    return joined.select("site", F.concat(F.lit("tpl_"), F.left(F.sha2("signature", 256), F.lit(8))).alias("template_id"), "url")


def hreflang_urls(pages: DataFrame) -> DataFrame:
    """URLs declared for each language of a site: site, lang, url."""
    return pages.select("site", F.explode("hreflang_alternates").alias("a")).select("site", "a.lang", "a.url").distinct()


def hreflang_groups(pages: DataFrame) -> DataFrame:
    """The same with one list for each language, for exports of small sites: site, lang, urls (sorted)."""
    each = hreflang_urls(pages)
    return each.groupBy("site", "lang").agg(F.array_sort(F.collect_list("url")).alias("urls"))


def first_values(pages: DataFrame) -> DataFrame:
    """Per site, the first language, icon, navigation and footer that is there, in order of page_id; the number of pages."""

    def first(name: str, filled: Column) -> Column:
        return F.min_by(F.when(filled, F.col(name)), F.when(filled, F.col("page_id"))).alias(name)

    have = set(pages.columns)
    values = [first("language", F.col("language").isNotNull())]
    values += [first("favicon_url", F.col("favicon_url").isNotNull())] if "favicon_url" in have else []
    values += [first("nav_links", F.coalesce(F.size("nav_links") > 0, F.lit(False))).alias("primary_nav"), first("footer_blocks", F.coalesce(F.size("footer_blocks") > 0, F.lit(False)))]
    return pages.groupBy("site").agg(*values, F.count("*").alias("total_pages"))


def common_logo(pages: DataFrame) -> DataFrame:
    """The logo that most pages of a site show, inline drawings apart."""
    counts = pages.where("logo_url IS NOT NULL AND NOT startswith(logo_url, 'inline-svg://')").groupBy("site", "logo_url").agg(F.count("*").alias("k"))
    return counts.groupBy("site").agg(F.min_by("logo_url", F.struct(-F.col("k"), "logo_url")).alias("logo_url"))


def flag_counts(pages: DataFrame) -> DataFrame:
    """Pages of a site by family of quality flag."""
    each = pages.select("site", F.explode("quality_flags").alias("flag")).select("site", F.split("flag", ":")[0].alias("flag"))
    return each.groupBy("site", "flag").agg(F.count("*").alias("pages"))


def category_counts(pages: DataFrame) -> DataFrame:
    """Pages and mean words of a site by category."""
    rows = pages.select("site", fact(pages, "category").alias("category"), fact(pages, "total_words").alias("words"))
    return rows.groupBy("site", "category").agg(F.count("*").alias("pages"), F.round(F.avg("words"), 2).alias("mean_words"))


# contact


def unique_emails(emails: DataFrame) -> DataFrame:
    """One spelling of each address of a site, one in lower case if there is one: site, email."""
    is_upper = F.col("email").rlike("[A-Z]")
    return emails.where("email IS NOT NULL").groupBy("site", F.lower("email").alias("key")).agg(F.min_by("email", F.struct(is_upper, F.col("email"))).alias("email")).select("site", "email")


def unique_phones(phones: DataFrame) -> DataFrame:
    """One spelling of each number of a site: one with a plus, then the one with most separators: site, phone."""
    phone = F.col("phone")
    rank = F.struct((~F.trim(phone).startswith("+")), F.length(contact.digits(phone)) - F.length(phone), phone)
    keyed = phones.select("site", "phone", contact.canonical_digits(phone).alias("key")).where("key <> ''")
    return keyed.groupBy("site", "key").agg(F.min_by("phone", rank).alias("phone")).select("site", "phone")


def _contact_facts(captured: DataFrame) -> DataFrame:
    """What each page says of contact, of one pass over the pages."""
    forms = F.transform(F.filter("content_blocks", lambda b: (b["type"] == "form") & (b["purpose"] == "contact") & (b["action"] != "")), lambda b: b["action"])
    per_page = captured.select("page_id", "site", contact.page_emails().alias("emails"), contact.page_phones().alias("phones"), "social_links", "addresses", "organization", forms.alias("forms"))
    return materialise(per_page, "contacts")


def _contact_rows(per_page: DataFrame) -> DataFrame:
    named = lambda df, kind, value: df.select("site", F.lit(kind).alias("kind"), value.alias("value"))
    rows = named(unique_emails(per_page.select("site", F.explode("emails").alias("email"))), "email", F.col("email"))
    rows = rows.unionByName(named(unique_phones(per_page.select("site", F.explode("phones").alias("phone")).distinct()), "phone", F.col("phone")))
    others = F.concat(
        F.transform(F.coalesce("social_links", F.array().cast("array<struct<platform:string,url:string>>")), lambda x: F.struct(F.lit("profile").alias("kind"), F.concat(x["platform"], F.lit(" "), x["url"]).alias("value"))),
        _kind_rows("addresses", "address"), _kind_rows("forms", "form"),
    )
    return rows.unionByName(per_page.select("site", F.explode(others).alias("x")).select("site", "x.kind", "x.value").distinct())


def _kind_rows(column: str, kind: str) -> Column:
    return F.transform(F.coalesce(column, F.array().cast("array<string>")), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("value")))


def contact_rows(captured: DataFrame) -> DataFrame:
    """Contact details as rows, for sites of any size: site, kind (email, phone, profile, address or form), value (of a profile, platform and URL)."""
    return _contact_rows(_contact_facts(captured))


def contacts(captured: DataFrame) -> DataFrame:
    """Contact details of each site from captured pages with ``site``, as lists: e-mails, phones, profiles, addresses, organization, form targets."""
    per_page = _contact_facts(captured)
    listed = lambda kind, alias: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("value")))).alias(alias)
    lists = _contact_rows(per_page).groupBy("site").agg(*(listed(k, a) for k, a in (("email", "emails"), ("phone", "phones"), ("profile", "profiles"), ("address", "addresses"), ("form", "contact_form_endpoints"))))
    firsts = per_page.groupBy(F.col("site").alias("_site")).agg(F.min_by("organization", F.when(F.col("organization").isNotNull(), F.col("page_id"))).alias("organization"))
    joined = firsts.join(lists, F.col("_site").eqNullSafe(F.col("site")), "left")
    empty = F.array().cast("array<string>")
    profiles = F.transform(F.coalesce("profiles", empty), lambda x: F.struct(F.substring_index(x, " ", 1).alias("platform"), F.substring_index(x, " ", -1).alias("url")))
    return joined.select(F.col("_site").alias("site"), *(F.coalesce(c, empty).alias(c) for c in ("emails", "phones")), profiles.alias("social_links"), *(F.coalesce(c, empty).alias(c) for c in ("addresses", "contact_form_endpoints")), "organization")


# warnings


def shell_warnings(pages: DataFrame) -> DataFrame:
    """Sites whose pages were captured before they were drawn: at least three pages, 80 % of one short template, few words."""
    totals = pages.select("site", fact(pages, "total_words").alias("words")).groupBy("site").agg(F.count("*").alias("total"), F.expr("sum(words) div count(*)").alias("mean_words")).where("total >= 3 AND mean_words < 50")
    counts = template_counts(pages).withColumn("n", F.size(F.split("block_pattern", ",")))
    hit = counts.join(totals, "site").where("page_count >= 0.8 * total AND n < 5")
    text = F.concat(F.lit("spa_loading_shell:"), F.col("page_count"), F.lit("_of_"), F.col("total"), F.lit("_pages_share_"), F.col("n"), F.lit("_block_template"))
    return hit.groupBy("site").agg(F.min(text).alias("warning"))


def partial_warnings(pages: DataFrame, skipped: DataFrame) -> DataFrame:
    """Sites of which at least half of the attempted pages were skipped: site, skipped, attempted, warning."""
    kept = pages.groupBy("site").agg(F.countDistinct("url").alias("kept"))
    lost = skipped.groupBy("site").agg(F.countDistinct("url").alias("skipped"))
    both = kept.join(lost, "site", "full").select("site", F.coalesce("skipped", F.lit(0)).alias("skipped"), (F.coalesce("kept", F.lit(0)) + F.coalesce("skipped", F.lit(0))).alias("attempted"))
    share = F.col("skipped") * 100 / F.col("attempted")
    return both.where("2 * skipped >= attempted AND skipped > 0").withColumn("warning", F.concat(F.lit("partial_scrape:"), F.round(share).cast("int"), F.lit("%_skipped")))


def skip_reasons(skipped: DataFrame) -> DataFrame:
    """Distinct skipped URLs of each site by reason; null reasons count as render_failed."""
    return skipped.groupBy("site", F.coalesce("reason", F.lit("render_failed")).alias("reason")).agg(F.countDistinct("url").alias("pages"))


def foreign_hosts(links: DataFrame) -> DataFrame:
    """Sites of which at least half of the listed URLs (columns site and url) are on other hosts: share and the commonest of those."""
    host, own = urls.bare_host(F.col("url")), F.regexp_replace(F.lower("site"), r"^www\.", "")
    rows = links.select("site", host.alias("host"), ((host != "") & (host != own) & ~host.endswith(F.concat(F.lit("."), own))).alias("foreign"), (host != own).alias("other"))
    counts = rows.groupBy("site", "host").agg(F.count("*").alias("k"), F.sum(F.col("foreign").cast("int")).alias("f"), F.max("other").alias("other"))
    total = counts.groupBy("site").agg(F.round(100 * F.sum("f") / F.sum("k")).cast("int").alias("percent"), F.min_by(F.when(F.col("other"), F.col("host")), F.when(F.col("other"), F.struct(-F.col("k"), F.col("host")))).alias("top"))
    return total.where("percent >= 50").select("site", "percent", "top", F.concat(F.lit("cross_domain_sitemap:"), "percent", F.lit("%_urls_at_"), F.coalesce("top", F.lit(""))).alias("warning"))


# URL lists


def capped(url_list: DataFrame, max_pages: int) -> DataFrame:
    """The first ``max_pages`` URLs of each site by priority, then in their order; columns site, url, ord."""
    order = Window.partitionBy("site").orderBy("priority", "ord", "url")
    return url_list.withColumn("priority", urls.priority(F.col("url"))).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max_pages).drop("rank")


def planned(url_list: DataFrame, max_pages: int, excludes=(), includes=()) -> DataFrame:
    """URLs to capture: capped, canonical, distinct, then filtered (in this order): site, url, ord."""
    rows = capped(url_list, max_pages).select("site", urls.canonical(F.col("url")).alias("url"), "ord").groupBy("site", "url").agg(F.min("ord").alias("ord"))
    return rows.where(urls.allowed(F.col("url"), excludes, includes))


# joins with what was fetched beside the pages


def with_assets(pages: DataFrame, assets: DataFrame, url: str, path: str) -> DataFrame:
    """Pages with the local path of one of their URLs (``og_image_url``, say), from a table of assets (url, path); null if there is none."""
    found = assets.select(F.col("url").alias("_url"), F.col("path").alias(path)).dropDuplicates(["_url"])
    return pages.join(found, pages[url] == found["_url"], "left").drop("_url")


def outcome_counts(pages: DataFrame, skipped: DataFrame) -> DataFrame:
    """Per site, how many pages were captured, skipped and attempted."""
    rows = pages.select("site", "url", F.lit(1).alias("ok")).unionByName(skipped.select("site", "url", F.lit(0).alias("ok"))).groupBy("site", "url").agg(F.max("ok").alias("ok"))
    return rows.groupBy("site").agg(F.sum("ok").alias("captured"), F.sum(1 - F.col("ok")).alias("skipped"), F.count("*").alias("attempted"))
