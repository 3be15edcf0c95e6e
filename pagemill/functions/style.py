"""Functions of styles: colours, fonts, variables, web fonts, as column expressions. Nulls give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions import urls
from pagemill.functions.tables import CODE_SELECTORS, CSS_VARIABLE, FONT, FONT_WEIGHTS, FRAMEWORKS, GENERIC_FONTS, HEX, HSL, ICON_FONTS, PLAIN_COLOURS, RGB, VITE, WEBFONTS


def code_selector(selector: Column) -> Column:
    """Whether a rule's selector is that of highlighted code."""
    low = F.lower(selector)
    parts = F.split(low, ",")
    short = F.forall(parts, lambda p: F.element_at(F.split(F.trim(p), r"\s+"), -1).rlike(r"^\.[a-z0-9]{1,4}(:.*)?$"))
    return urls.contains_any(low, CODE_SELECTORS) | short


def transparent(colour: Column) -> Column:
    """Whether a colour in lower case shows nothing."""
    flat = F.regexp_replace(colour, r"\s", "")
    return flat.rlike(r"^#.{6}00$") | flat.rlike(r"^rgba\([^,]*,[^,]*,[^,]*,0*(\.0*)?\)$") & ~flat.rlike(r",\)$")


def colours(css: Column) -> Column:
    """Colours of all rules that style no code, in lower case. Rules end at a closing brace, whatever they are nested in."""

    def of_rule(chunk: Column) -> Column:
        opened = F.contains(chunk, F.lit("{"))
        selector = F.when(opened, F.substring_index(chunk, "{", 1)).otherwise("")
        body = F.when(opened, F.regexp_replace(chunk, r"(?s)^[^{]*\{", "")).otherwise(chunk)
        found = F.concat(*(F.regexp_extract_all(body, F.lit(p), F.lit(0)) for p in (HEX, RGB, HSL)))
        kept = F.filter(F.transform(found, F.lower), lambda c: ~c.isin(*PLAIN_COLOURS) & ~transparent(c))
        return F.when(code_selector(selector), F.array().cast("array<string>")).otherwise(kept)

    return F.flatten(F.transform(F.split(css, r"\}"), of_rule))


def brand_font(family: Column) -> Column:
    """Whether a family is a typeface of choice: no generic, generated or icon font."""
    low = F.lower(family)
    generated = low.rlike(r"[-_ ]fallback$") | F.contains(low, F.lit("!important")) | family.startswith("__") | low.rlike("%2c|%3a|%2f") | low.rlike(r"^tk-(.*-)?n\d+$")
    icons = low.rlike(r"[- ]icons?$") | low.rlike("iconic|glyph") | low.rlike(r"^(font ?awesome|material (icons|symbols))") | low.isin(*ICON_FONTS)
    return (family != "") & ~low.isin(*GENERIC_FONTS) & ~family.startswith("var(") & ~family.startswith("--") & ~generated & ~icons & family.rlike(r"^[A-Za-z0-9 \-]{2,40}$")


def fonts(css: Column) -> Column:
    """First families of all font declarations that are brand fonts."""
    first = lambda d: F.regexp_replace(F.trim(F.split(d, ",")[0]), "^[\"']+|[\"']+$", "")
    return F.filter(F.transform(F.regexp_extract_all(css, F.lit(FONT), F.lit(1)), first), brand_font)


def variables(css: Column) -> Column:
    """Custom properties as structs of name and value."""
    whole = F.regexp_extract_all(css, F.lit(CSS_VARIABLE), F.lit(0))
    pairs = F.transform(whole, lambda m: F.struct(F.regexp_extract(m, CSS_VARIABLE, 1).alias("name"), F.trim(F.regexp_extract(m, CSS_VARIABLE, 2)).alias("value")))
    return F.filter(pairs, lambda p: (p["value"] != "") & (F.octet_length(p["value"]) <= 200) & ~p["value"].startswith("data:"))


def base_family(family: Column) -> Column:
    """A family in lower case without trailing words of weight or style (after a space, a hyphen, or in camel case)."""
    words = "|".join(sorted(FONT_WEIGHTS, key=len, reverse=True))
    camel = "|".join(w.capitalize() for w in sorted(FONT_WEIGHTS, key=len, reverse=True))
    pattern = rf"^(.{{3,}}?)(?:[ _-]*(?:[ -](?i:{words})|(?<=[a-z])(?:{camel})))+[ _-]*$"
    base = F.regexp_extract(family, pattern, 1)
    return F.lower(F.when(base == "", family).otherwise(base))


def webfont_provider(url: Column) -> Column:
    """The provider of a web font's style sheet, else null."""
    low = F.lower(url)
    return F.coalesce(*(F.when(urls.contains_any(low, marks), name) for name, marks in WEBFONTS))


def webfont_families(url: Column) -> Column:
    """Families that a style sheet's URL names, sorted."""
    query = F.when(F.contains(url, F.lit("?")), F.regexp_replace(url, r"^[^?]*\?", ""))
    named = F.filter(F.split(query, "&"), lambda p: p.startswith("family="))

    def family(p: Column) -> Column:
        text = F.replace(F.substring(p, F.lit(8), F.length(p)), F.lit("+"), F.lit(" "))
        for code, char in (("3A", ":"), ("2C", ","), ("20", " "), ("2B", "+")):
            text = F.regexp_replace(text, f"(?i)%{code}", char)
        return F.trim(F.split(text, "[:,]")[0])

    found = F.array_sort(F.array_distinct(F.filter(F.transform(named, family), lambda f: f != "")))
    return F.when(webfont_provider(url).isin("google", "bunny"), F.coalesce(found, F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))


def frameworks(text: Column) -> Column:
    """Technologies whose marks a text holds: structs of framework, confidence and evidence."""
    low = F.lower(text)
    has = lambda *needles: urls.contains_any(low, needles)
    hint = lambda name, confidence, evidence: F.struct(F.lit(name).alias("framework"), F.lit(confidence).alias("confidence"), evidence.alias("evidence"))
    hints = []
    for name, confidence, evidence, groups in FRAMEWORKS:
        hit = F.lit(True)
        for needles in groups:
            hit = hit & has(*needles)
        if name == "Ruby on Rails":
            hit = hit | has('name="csrf-token"') & has("rails")
        hints.append(F.when(hit, hint(name, confidence, F.array(F.lit(evidence)))))
        if name == "Gatsby":
            signs = (("/wp-json/", "/wp-json/ REST API endpoint"), ("wp-admin", "wp-admin link"), ('name="generator" content="wordpress', "meta generator=WordPress"), ("wp-emoji", "wp-emoji.js"))
            strong = F.array_compact(F.array(*(F.when(has(n), e) for n, e in signs)))
            seen = F.concat(F.array(F.lit("/wp-content/ or /wp-includes/ asset path")), strong, F.when(has("/wp-content/plugins/elementor"), F.array(F.lit("Elementor plugin asset"))).otherwise(F.array().cast("array<string>")))
            weak = F.array(F.lit("/wp-content/ reference (possibly 3rd-party widget)"))
            hints.append(F.when(has("/wp-content/", "/wp-includes/"), F.when(F.size(strong) > 0, hint("WordPress", "high", seen)).otherwise(hint("WordPress", "low", weak))))
        if name == "Squarespace":
            hints.append(F.when(text.rlike(VITE), hint("Vite", "medium", F.array(F.lit("/assets/<name>-<hash>.{js,css} bundle (Vite/Rollup)")))))
    found = F.array_compact(F.array(*hints))
    value = F.regexp_extract(low, 'name="generator" content="([^"]*)"', 1)
    other = F.when((value != "") & (F.octet_length(value) < 60), F.array(F.struct(value.alias("framework"), F.lit("medium").alias("confidence"), F.array(F.lit('meta name=generator content="…"')).alias("evidence"))))
    return F.when(F.size(found) > 0, found).otherwise(F.coalesce(other, found))
