"""Outputs of a run: JSON, JSON Lines, Markdown, compact dumps, site bundles, asset manifests, run status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import blocks, urls

#: Fields that stay out of exports.
HIDDEN = ("style_text", "stylesheet_urls", "body_text", "chrome_text", "contact_links", "crawl_links", "signature")


def exported(pages: DataFrame) -> DataFrame:
    """Pages without working fields."""
    return pages.drop(*[c for c in HIDDEN if c in pages.columns])


def write_jsonl(pages: DataFrame, path: str) -> None:
    """One JSON object per page and line."""
    exported(pages).write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def write_master(pages: DataFrame, path: str) -> None:
    """All pages of one site as one JSON document of ``total_pages`` and ``pages``, in one text file; for a run with a site, as one task writes it."""
    out = exported(pages)
    rows = out.select("page_id", F.to_json(F.struct(*out.columns), {"ignoreNullFields": "true"}).alias("value"))
    total, last = rows.agg(F.count("*"), F.max("page_id")).first()
    body = rows.select(F.lit(1).alias("part"), "page_id", F.concat("value", F.when(F.col("page_id") < F.lit(last), ",").otherwise("")).alias("value"))
    ends = pages.sparkSession.createDataFrame([(0, 0, f'{{"total_pages": {total}, "pages": ['), (2, 0, "]}")], "part int, page_id bigint, value string")
    ends.unionByName(body).repartition(1).sortWithinPartitions("part", "page_id").select("value").write.mode("overwrite").text(path)


def write_split_pages(pages: DataFrame, path: str) -> None:
    """One folder of JSON per page, named by its slug, within one per site; equal slugs share a folder, nothing is lost."""
    exported(pages).withColumn("slug", urls.slug(F.col("url"))).write.mode("overwrite").partitionBy("site", "slug").json(path)


def markdown_pages(pages: DataFrame) -> DataFrame:
    """page_id, slug and Markdown of each page."""
    return pages.select("page_id", "site", urls.slug(F.col("url")).alias("slug"), blocks.markdown().alias("markdown"))


def write_markdown(pages: DataFrame, path: str) -> None:
    """One text per page, in folders by site and slug."""
    markdown_pages(pages).select("site", "slug", F.col("markdown").alias("value")).write.mode("overwrite").partitionBy("site", "slug").text(path)


def compact(pages: DataFrame) -> DataFrame:
    """Short rows for small contexts: titles, category, counts and the first twenty headings."""
    headings = F.slice(F.transform(F.filter(F.arrays_zip(F.col("content_blocks.type").alias("type"), F.col("content_blocks.text").alias("text")), lambda b: b["type"] == "heading"), lambda b: b["text"]), 1, 20)
    return pages.select(
        "page_id", "site", "url", "title", blocks.category().alias("category"), "meta_description", blocks.first_text("heading").alias("primary_heading"), blocks.total_words().alias("word_count"), blocks.count_of("image").alias("image_count"),
        (blocks.count_of("form") > 0).alias("has_form"), F.greatest(F.coalesce(F.size("internal_links_out"), F.lit(0)), F.lit(0)).alias("internal_links_out"), headings.alias("headings"),
    )


def write_rows_as_json(df: DataFrame, path: str) -> None:
    """Any small aggregate (contact, brand, site) as JSON, in folders by site."""
    df.write.mode("overwrite").partitionBy("site").json(path)


def json_schema(df: DataFrame) -> str:
    """The schema of an export, derived from its columns."""
    return df.schema.json()


def asset_manifest(spark: SparkSession, root: str) -> DataFrame:
    """path, size_bytes and kind of every file below an output folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("size_bytes"))
    name, folder = F.regexp_extract("path", "([^/]*)$", 1), F.regexp_extract("path", r"/(images|screenshots|pages|markdown|css)/", 1)
    image = F.when(name.startswith("favicon"), "favicon").when(name.startswith("logo"), "logo").when(name.startswith("svg-"), "svg").otherwise("image")
    kind = F.when(folder == "images", image).when(folder == "screenshots", "screenshot").when(folder == "pages", "page-json").when(folder == "markdown", "page-md").when(folder == "css", "stylesheet")
    return files.withColumn("kind", kind).where("kind IS NOT NULL")


#: Parts of an index: its heading, warnings, facts, templates, flags, files, pages.
HEADING, WARNINGS, FACTS, TEMPLATES, FLAGS, FILES, PAGES = range(7)
_FILES = (("scraped", "every page with all blocks, forms and structured data"), ("site", "aggregates of the site"), ("compact", "short rows for small contexts"), ("contact", "e-mails, phones, profiles, addresses"), ("brand", "colours, fonts, variables, icon and logo"), ("index", "this file"))


def _top(column: str, name: str, most: int = 5):
    """The first entries of a list of structs with counts, as text."""
    return F.array_join(F.transform(F.slice(F.coalesce(F.col(column), F.array()), 1, most), lambda x: F.concat(F.lit("`"), x[name], F.lit("` ("), x["count"].cast("string"), F.lit("×)"))), ", ")


def index_lines(bundles: DataFrame, summaries: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """Lines of an index in Markdown for each site: site, part, line_no, line.

    Of a bundle come warnings, facts (the five commonest colours and fonts), templates and flags; of the summaries a row for
    each page, which stay rows, so that no site is one string.
    """
    text = lambda c: F.coalesce(c, F.lit(""))
    have = set(bundles.columns)
    fact = lambda label, value: F.when(text(value) != "", F.concat(F.lit(f"- **{label}**: "), value))
    contact = lambda field: F.array_join(F.col(f"contact.{field}"), ", ")
    bundles = bundles.withColumn("quality_warnings", F.coalesce("quality_warnings", F.array().cast("array<string>")))
    facts = [fact("Site", F.col("site")), fact("Pages", F.col("total_pages").cast("string")), fact("Language", F.col("language"))]
    if "frameworks" in have:
        facts.append(fact("Technologies", F.array_join(F.transform("frameworks", lambda f: F.concat(f["framework"], F.lit(" ("), f["confidence"], F.lit(")"))), ", ")))
    if "colors" in have:
        facts += [fact("Icon", F.col("favicon_url")), fact("Logo", F.col("logo_url")), fact("Top colours", _top("colors", "value")), F.when(F.col("confidence") != "high", F.concat(F.lit("- **Brand confidence**: "), "confidence")), fact("Top fonts", _top("fonts", "family"))]
    facts += [fact("E-mails", contact("emails")), fact("Phones", contact("phones")), fact("Profiles", F.array_join(F.transform("contact.social_links", lambda x: F.concat_ws(": ", x["platform"], x["url"])), " · "))]
    facts.append(F.when((contact("emails") == "") & (contact("phones") == ""), fact("Contact forms", contact("contact_form_endpoints"))))
    warning = lambda w: F.concat(F.lit("> **Warning** "), F.regexp_replace(F.regexp_replace(w, "^[a-z_]+:", ""), "_", " "), F.lit(" ("), F.regexp_extract(w, "^([a-z_]+)", 1), F.lit(")"))
    rule = lambda part, lines: F.transform(lines, lambda x, i: F.struct(F.lit(part).alias("part"), i.cast("bigint").alias("line_no"), x.alias("line")))
    titled = lambda lines, *head: F.when(F.size(lines) > 0, F.concat(F.array(*(F.lit(h) for h in head)), lines)).otherwise(F.array().cast("array<string>"))
    templates = F.transform(F.coalesce("templates", F.array()), lambda t: F.concat(F.lit("| `"), t["template_id"], F.lit("` | "), t["page_count"].cast("string"), F.lit(" | "), t["sample_page"], F.lit(" | `"), t["block_pattern"], F.lit("` |")))
    flags = F.transform(F.coalesce("quality_flags", F.array()), lambda f: F.concat(F.lit("| `"), f["flag"], F.lit("` | "), f["pages"].cast("string"), F.lit(" |")))
    parts = F.flatten(F.array(
        rule(HEADING, F.array(F.concat(F.lit("# Site export: "), "site"))), rule(WARNINGS, F.transform("quality_warnings", warning)), rule(FACTS, F.concat(F.array(F.lit("## At a glance")), F.array_compact(F.array(*facts)))),
        rule(TEMPLATES, titled(templates, "## Page templates", "| Template | Pages | Sample | Blocks |", "| --- | --- | --- | --- |")), rule(FLAGS, titled(flags, "## Quality flags", "| Flag | Pages |", "| --- | --- |")),
        rule(FILES, F.array(F.lit("## Where to look"), *(F.lit(f"- `{name}`: {what}") for name, what in _FILES))),
    ))
    heads = bundles.where("site IS NOT NULL").select("site", F.inline(parts))
    table = summaries.where("site IS NOT NULL").select("site").distinct().select("site", F.lit(PAGES).alias("part"), F.posexplode(F.array(F.lit("## Pages"), F.lit("| URL | Category | Title | Words | Form | Images | Links out | Links in |"), F.lit("| --- | --- | --- | --- | --- | --- | --- | --- |"))).alias("k", "line")).select("site", "part", (F.col("k") - 3).cast("bigint").alias("line_no"), "line")
    cells = ("url", F.concat(F.lit("`"), "category", F.lit("`")), F.replace(text(F.col("title")), F.lit("|"), F.lit("\\|")), F.col("word_count").cast("string"), F.when(F.col("has_form"), "yes").otherwise("—"), *(F.col(c).cast("string") for c in ("image_count", "internal_links_out", "internal_links_in")))
    pages = summaries.where("site IS NOT NULL").select("site", F.lit(PAGES).alias("part"), F.col("page_id").alias("line_no"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
    out = heads.unionByName(table).unionByName(pages)
    if skipped is not None:
        reasons = skipped.where("site IS NOT NULL").groupBy("site", F.coalesce("reason", F.lit("render_failed")).alias("reason")).agg(F.count("*").alias("k"))
        out = out.unionByName(reasons.select("site", F.lit(WARNINGS).alias("part"), F.lit(1_000).cast("bigint").alias("line_no"), F.concat(F.lit("> Skipped pages, "), "reason", F.lit(": "), F.col("k").cast("string")).alias("line")))
        # sites of which nothing was captured have no bundle
        lost = skipped.where("site IS NOT NULL").select("site").distinct().join(bundles.select("site"), "site", "left_anti")
        out = out.unionByName(lost.select("site", F.lit(HEADING).alias("part"), F.lit(0).cast("bigint").alias("line_no"), F.concat(F.lit("# Site export: "), "site", F.lit(" (no page was captured)")).alias("line")))
    return out


def mark_status(spark: SparkSession, path: str, status: str) -> None:
    """A status line in the output folder; written before a run as ``incomplete`` and after it as ``complete``."""
    spark.createDataFrame([(status,)], "value string").coalesce(1).write.mode("overwrite").text(path)
