"""Functions of a page's typed blocks, as column expressions over ``content_blocks`` and the page's metadata.

Null arrays count as empty, null texts as empty texts; lengths that are thresholds are in bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions import urls
from pagemill.functions.tables import CATEGORIES, CURRENCIES, EMBEDS, PARKED_HOSTS, POOR_ALTS

def _blocks(*fields: str) -> Column:
    """Only some fields of the blocks, so that only they are read."""
    return F.arrays_zip(*(F.col(f"content_blocks.{f}").alias(f) for f in ("type", *fields)))


def _strings(column: Column) -> Column:
    return F.coalesce(column, F.array().cast("array<string>"))


def words(text: Column) -> Column:
    """Number of words between white space."""
    return F.coalesce(F.size(F.filter(F.split(text, r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"), lambda w: w != "")), F.lit(0))


def plain_text() -> Column:
    """Headings, paragraphs and list items, one a line."""
    texts = F.transform(_blocks("text", "items"), lambda b: F.when(b["type"].isin("heading", "paragraph"), F.array(b["text"])).when(b["type"] == "list", b["items"]).otherwise(F.array().cast("array<string>")))
    lines = F.filter(F.flatten(F.transform(texts, _strings)), lambda t: t.isNotNull() & (t != ""))
    return F.coalesce(F.regexp_replace(F.array_join(lines, "\n"), r"\s+$", ""), F.lit(""))


def total_words() -> Column:
    """Words of all blocks that have text."""
    text = F.transform(F.filter(_blocks("text"), lambda b: b["type"].isin("heading", "paragraph", "code", "quote")), lambda b: b["text"])
    lists = F.flatten(F.transform(F.filter(_blocks("items"), lambda b: b["type"] == "list"), lambda b: _strings(b["items"])))
    tables = F.filter(_blocks("caption", "headers", "rows"), lambda b: b["type"] == "table")
    cells = F.flatten(F.transform(tables, lambda b: F.concat(F.array(b["caption"]), _strings(b["headers"]), F.flatten(F.transform(F.coalesce(b["rows"], F.array().cast("array<array<string>>")), _strings)))))
    pairs = F.transform(F.filter(_blocks("definitions"), lambda b: (b["type"] == "definitionlist") & b["definitions"].isNotNull()), lambda b: F.concat(F.transform(b["definitions"], lambda d: d["term"]), F.transform(b["definitions"], lambda d: d["description"])))
    parts = F.concat(*(_strings(x) for x in (text, lists, cells, F.flatten(pairs))))
    return F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, t: a + words(t))


def content_hash(text: Column) -> Column:
    """The start of the text's hash; empty without text."""
    return F.when(text == "", "").otherwise(F.left(F.sha2(text, 256), F.lit(16)))


def first_text(kind: str) -> Column:
    """The text of the first block of a type, else null."""
    return F.get(F.transform(F.filter(_blocks("text"), lambda b: b["type"] == kind), lambda b: b["text"]), F.lit(0))


def summary() -> Column:
    """The description, else the first paragraph, else the first heading, cut to 200 characters."""
    found = F.coalesce(F.nullif("meta_description", F.lit("")), F.nullif(first_text("paragraph"), F.lit("")), first_text("heading"), F.lit(""))
    return F.trim(F.left(found, F.lit(200)))


def assets() -> Column:
    """Local files of the page's images, sorted."""
    paths = F.transform(F.filter(_blocks("local_path"), lambda b: (b["type"] == "image") & (b["local_path"] != "")), lambda b: b["local_path"])
    return _strings(F.array_sort(F.array_distinct(paths)))


def signature() -> Column:
    """The pattern of block types, as ``h1,p,img``."""
    short = {"paragraph": "p", "image": "img", "list": "ul", "definitionlist": "dl"}

    def name(b: Column) -> Column:
        out = F.when(b["type"] == "heading", F.concat(F.lit("h"), b["level"].cast("string"))).when(b["type"] == "media", b["kind"])
        for k, v in short.items():
            out = out.when(b["type"] == k, v)
        return out.otherwise(b["type"])

    return F.coalesce(F.array_join(F.transform(_blocks("level", "kind"), name), ","), F.lit(""))


def count_of(kind: str) -> Column:
    """Number of blocks of a type."""
    return F.coalesce(F.size(F.filter(F.col("content_blocks.type"), lambda t: t == kind)), F.lit(0))


def block_count() -> Column:
    """Number of blocks."""
    return F.greatest(F.coalesce(F.size("content_blocks.type"), F.lit(0)), F.lit(0))


def category(title: str = "title") -> Column:
    """The kind of page, by URL, title and first heading; product also by structured data."""
    url, path = F.lower("url"), F.lower(F.coalesce(urls.path(F.col("url")), F.lit("")))
    hay = [path, url, F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(first_text("heading"), F.lit("")))]

    def any_of(needles: tuple[str, ...]) -> Column:
        return urls.contains_any(F.concat_ws("\n", *hay), needles)

    product = F.exists(_strings(F.col("structured_data")), lambda s: F.coalesce(F.lower(F.get_json_object(s, "$.@type")) == "product", F.lit(False)))
    out = F.when(path.isin("", "/"), "home")
    for name, needles in CATEGORIES:
        hit = any_of(needles)
        if name == "blog-index":
            hit = hit | (path == "/blog") | path.endswith("/blog/")
        elif name == "product":
            out = out.when(path.startswith("/blog/") & (path != "/blog/"), "blog-post")
            hit = hit | product
        out = out.when(hit, name)
    return out.otherwise("page")


def embed_provider(src: Column) -> Column:
    """The platform of an embed, by the first known mark in its address."""
    low = F.lower(src)
    return F.coalesce(*(F.when(urls.contains_any(low, marks), name) for name, marks in EMBEDS), F.lit("iframe"))


def quality_flags() -> Column:
    """Flags of search and accessibility, in their order."""
    h1 = F.coalesce(F.size(F.filter(_blocks("level"), lambda b: (b["type"] == "heading") & (b["level"] == 1))), F.lit(0))
    filled = block_count() > 0
    description, title = F.octet_length(F.coalesce("meta_description", F.lit(""))), F.coalesce("title", F.lit(""))
    alts = F.transform(F.filter(_blocks("alt_text"), lambda b: b["type"] == "image"), lambda b: F.coalesce(b["alt_text"], F.lit("")))
    missing = F.coalesce(F.size(F.filter(alts, lambda a: a == "")), F.lit(0))
    poor = F.coalesce(F.size(F.filter(alts, lambda a: (a != "") & (F.trim(F.lower(a)).isin(*POOR_ALTS) | F.trim(F.lower(a)).rlike(r"\.(jpg|jpeg|png|gif|webp|svg)$") | F.trim(a).rlike(r"^[0-9_-]*$")))), F.lit(0))
    embeds = F.filter(_blocks("provider", "src"), lambda b: b["type"] == "embed")
    hosts = F.get(F.filter(F.transform(embeds, lambda b: urls.host(b["src"])), lambda h: h != ""), F.lit(0))
    dead = (F.col("total_words") == 0) & filled & (F.size(embeds) == block_count()) & F.exists(embeds, lambda b: b["provider"] == "iframe")
    parked = dead | (F.coalesce(urls.contains_any(hosts, PARKED_HOSTS), F.lit(False)) & (F.col("total_words") < 50))
    robots = F.coalesce("meta_robots", F.lit(""))
    flags = [
        F.when(filled & (h1 == 0), "no_h1"), F.when(h1 > 1, F.concat(F.lit("multiple_h1:"), h1.cast("string"))),
        F.when(description == 0, "no_meta_description").when(description > 160, "meta_description_too_long").when(description < 50, "meta_description_too_short"),
        F.when(title.isin("", "No title"), "no_title").when(F.octet_length(title) > 70, "title_too_long"), F.when(F.col("canonical_url").isNull(), "no_canonical"),
        F.when(F.contains(robots, F.lit("noindex")) | F.contains(robots, F.lit("none")), "meta_robots_noindex"), F.when(F.contains(robots, F.lit("nofollow")), "meta_robots_nofollow"),
        F.when(missing > 0, F.concat(F.lit("images_missing_alt:"), missing.cast("string"))), F.when(poor > 0, F.concat(F.lit("images_low_quality_alt:"), poor.cast("string"))),
        F.when(filled & (F.col("total_words") < 100), "thin_content"), F.when(parked, "parked_domain"),
    ]
    return F.array_compact(F.array(*flags))


SECTIONS = "array<struct<section_type:string,block_start:int,block_end:int,summary:string>>"


def price_like(text: str) -> bool:
    """Whether a heading is a price: short, with a currency and a digit."""
    low = text.lower()
    return len(text.encode()) <= 40 and any(c in low for c in CURRENCIES) and any("0" <= c <= "9" for c in text)


class Runs:
    """Recurring patterns of a page's blocks; each gives the end of the run that begins at a block, or None."""

    def __init__(self, blocks: list[dict]):
        self.blocks = blocks
        self.kinds = [b["type"] for b in blocks]

    def pairs(self, at: int, first, second) -> int | None:
        end = at
        while end + 1 < len(self.blocks) and first(self.blocks[end]) and second(self.blocks[end + 1]):
            end += 2
        return end if end - at >= 6 else None

    def pricing(self, at: int) -> int | None:
        hits = [k for k in range(at, min(at + 12, len(self.blocks))) if self.kinds[k] == "heading" and price_like(self.blocks[k]["text"] or "")]
        return hits[-1] + 1 if len(hits) >= 3 else None

    def faq(self, at: int) -> int | None:
        return self.pairs(at, lambda b: b["type"] == "heading" and b["level"] in (3, 4) and len((b["text"] or "").encode()) < 200, lambda b: b["type"] == "paragraph")

    def features(self, at: int) -> int | None:
        level = self.blocks[at]["level"] if self.kinds[at] == "heading" else None
        return None if level is None else self.pairs(at, lambda b: b["type"] == "heading" and b["level"] == level, lambda b: b["type"] == "paragraph")

    def team(self, at: int) -> int | None:
        return self.pairs(at, lambda b: b["type"] == "image", lambda b: b["type"] == "heading" and len((b["text"] or "").encode()) < 80)

    def gallery(self, at: int) -> int | None:
        end = at
        while end < len(self.kinds) and self.kinds[end] == "image":
            end += 1
        return end if end - at >= 3 else None

    def at(self, k: int) -> tuple[str, int, str] | None:
        """The pattern that begins at a block: name, end, summary."""
        for name, run, say in (
            ("pricing-grid", self.pricing, None), ("faq", self.faq, lambda n: f"{n // 2} Q&A pairs"), ("features", self.features, lambda n: f"{n // 2} feature items"),
            ("team", self.team, lambda n: f"{n // 2} cards"), ("gallery", self.gallery, lambda n: f"{n} images"),
        ):
            end = run(k)
            if end is not None:
                return name, end, say(end - k) if say else self.summary(k, end)
        return None

    def summary(self, begin: int, end: int) -> str:
        for kind in ("heading", "paragraph"):
            for b in self.blocks[begin:end]:
                if b["type"] == kind:
                    return (b["text"] or "")[:80]
        return ""

    def hero(self) -> int:
        """The end of the opening section, 0 if there is none."""
        if not self.kinds or self.kinds[0] != "heading":
            return 0
        end, images = 1, 0
        while end < min(8, len(self.blocks)):
            b = self.blocks[end]
            images += b["type"] == "image"
            if not (b["type"] == "paragraph" or b["type"] == "image" and images == 1 or b["type"] == "heading" and (b["level"] or 0) >= 4):
                break
            end += 1
        return end if end >= 2 else 0


def find_sections(blocks: list[dict]) -> list[dict]:
    """Sections that cover a page's blocks in order."""
    runs, out, k = Runs(blocks), [], 0

    def put(name: str, end: int, text: str) -> None:
        out.append({"section_type": name, "block_start": k, "block_end": end, "summary": text})

    hero = runs.hero()
    if hero:
        put("hero", hero, runs.summary(0, hero))
        k = hero
    while k < len(blocks):
        found = ("cta", k + 1, "form") if runs.kinds[k] == "form" else ("embed", k + 1, blocks[k]["provider"] or "embed") if runs.kinds[k] == "embed" else runs.at(k)
        if found is None:
            end = k + 1
            while end < len(blocks) and runs.kinds[end] not in ("form", "embed") and runs.at(end) is None:
                end += 1
            found = ("content", end, runs.summary(k, end))
        put(*found)
        k = found[1]
    return out


def sections() -> Column:
    """Sections of each page; greedy, so by Arrow-batched Python over four fields of the blocks."""

    @F.pandas_udf(SECTIONS)
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in series:
            yield s.map(lambda x: find_sections(list(x)) if x is not None else [])

    return run(_blocks("level", "text", "provider"))


def markdown() -> Column:
    """A page as Markdown."""
    text = lambda c: F.coalesce(c, F.lit(""))
    or_ = lambda a, b: F.when(text(a) == "", text(b)).otherwise(a)

    def table(b: Column) -> Column:
        heads = F.when(F.size(_strings(b["headers"])) > 0, F.concat(F.lit("| "), F.array_join(b["headers"], " | ", ""), F.lit(" |\n|"), F.array_join(F.transform(b["headers"], lambda _: F.lit("---")), "|"), F.lit("|\n"))).otherwise("")
        rows = F.transform(b["rows"], lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.replace(text(c), F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |\n")))
        return F.concat(F.when(text(b["caption"]) != "", F.concat(F.lit("**"), b["caption"], F.lit("**\n\n"))).otherwise(""), heads, F.array_join(rows, ""), F.lit("\n"))

    def form(b: Column) -> Column:
        line = lambda f: F.concat(F.lit("> - `"), text(f["name"]), F.lit("` ("), text(f["field_type"]), F.when(f["required"], ", required").otherwise(""), F.lit("): "), or_(f["label"], f["placeholder"]), F.lit("\n"))
        lines = F.array_join(F.transform(b["fields"], line), "")
        return F.concat(F.lit("> **Form** ("), text(b["purpose"]), F.lit(") — "), text(b["method"]), F.lit(" `"), or_(b["action"], F.lit("(no action)")), F.lit("`\n>\n"), text(lines), F.lit("> - submit: **"), text(b["submit_text"]), F.lit("**\n\n"))

    def one(b: Column) -> Column:
        quote = F.concat(F.array_join(F.transform(F.split(F.regexp_replace(text(b["text"]), r"\n$", ""), "\n"), lambda x: F.concat(F.lit("> "), x, F.lit("\n"))), ""), F.when(b["cite"].isNotNull(), F.concat(F.lit("> — <"), b["cite"], F.lit(">\n"))).otherwise(""), F.lit("\n"))
        media = F.concat(F.lit("> **"), text(b["kind"]), F.lit("**: ["), or_(b["title"], b["kind"]), F.lit("]("), text(b["src"]), F.lit(")\n"), F.when(b["poster"].isNotNull(), F.concat(F.lit("> poster: "), b["poster"], F.lit("\n"))).otherwise(""), F.lit("\n"))
        return (
            F.when(b["type"] == "heading", F.concat(F.repeat(F.lit("#"), b["level"]), F.lit(" "), text(b["text"]), F.lit("\n\n"))).when(b["type"] == "paragraph", F.concat(text(b["text"]), F.lit("\n\n")))
            .when(b["type"] == "list", F.concat(F.array_join(F.transform(_strings(b["items"]), lambda i: F.concat(F.lit("- "), text(i), F.lit("\n"))), ""), F.lit("\n")))
            .when(b["type"] == "image", F.concat(F.lit("!["), or_(b["alt_text"], F.lit("image")), F.lit("]("), or_(b["local_path"], b["original_url"]), F.lit(")\n\n"))).when(b["type"] == "form", form(b))
            .when(b["type"] == "embed", F.concat(F.lit("> **Embed** ("), text(b["provider"]), F.lit("): ["), or_(b["title"], b["provider"]), F.lit("]("), text(b["src"]), F.lit(")\n\n"))).when(b["type"] == "table", table(b))
            .when(b["type"] == "code", F.concat(F.lit("```"), text(b["language"]), F.lit("\n"), text(b["text"]), F.lit("\n```\n\n"))).when(b["type"] == "quote", quote).when(b["type"] == "media", media)
            .when(b["type"] == "definitionlist", F.array_join(F.transform(b["definitions"], lambda d: F.concat(F.lit("**"), text(d["term"]), F.lit("**\n: "), text(d["description"]), F.lit("\n\n"))), "")).otherwise("")
        )

    note = lambda name, c: F.when(text(c) != "", F.concat(F.lit(f"<!-- {name}: "), c, F.lit(" -->\n"))).otherwise("")
    head = F.concat(F.lit("# "), text(F.col("title")), F.lit("\n\n<!-- url: "), text(F.col("url")), F.lit(" -->\n"), note("canonical", F.col("canonical_url")), note("lang", F.col("language")), note("description", F.col("meta_description")), F.lit("\n"))
    return F.concat(head, F.coalesce(F.array_join(F.transform("content_blocks", one), ""), F.lit("")))
