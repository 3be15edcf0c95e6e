"""Queries on small tables of our own, for operators whose inputs the test data do not hold, with the results they must have.

Each case has literal inputs and literal results; its SQL gives the results alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.config import restore_pattern
from pagemill.functions import blocks, contact, style, urls
from pagemill.operators import brand, site
from pagemill.schemas import BLOCK
from pagemill.sources.pages import capture, is_challenge

# functions of one value: query, function, and inputs (joined by a line break if there are two) with results


def _two(f: Callable[[Column, Column], Column]) -> Callable[[Column], Column]:
    return lambda x: f(F.split(x, "\n")[0], F.split(x, "\n")[1])


VALUES: dict[str, tuple[Callable[[Column], Column], dict[str, str | None]]] = {
    "case_phone": (contact.looks_like_phone, {
        "+43 512 588 0420": "true", "+43 1 588 0420": "false", "(212) 660-9245": "true", "01.46.22.87.15": "true", "212-660-9245": "true", "+44 (0)20 7123 4500": "false", "+44 20 7123 4500": "true", "2031-04-17": "false", "2019-88341": "false", "1998 443120": "false", "12 14 15 17 19 21": "false", "5512340987": "false", "1688123456": "false", "123 4567": "false",
        "21345678 4": "false", "+43 222 333 444": "false", "041   22   18.75": "false", "1699123456 \n   7": "false", "+1 212 660 9245 3": "false",
    }),
    "case_phone_brackets": (contact.balance_brackets, {"212) 660-9245": "(212) 660-9245", "  503) 221-0044 ": "(503) 221-0044", "(503) 221-0044": "(503) 221-0044", "503-221-0044 (": "503-221-0044", "+43 1 588 0420": "+43 1 588 0420"}),
    "case_phone_digits": (contact.canonical_digits, {"+420 731 552 608": "731552608", "+43 1 5880420": "15880420", "731 552 608": "731552608", "+1 (212) 660 9245": "2126609245", "(212) 660-9245": "2126609245", "1 212 660 9245": "2126609245", "00420731552608": "731552608"}),
    "case_email_decode": (contact.decode_mail, {"desk%40mill.example": "desk@mill.example", "a%2Bb%40mill.example": "a+b@mill.example", "x%2ey%40mill.example": "x.y@mill.example", "two%20words%40mill.example": "twowords@mill.example", "q%77z@mill.example": "q%77z@mill.example", "desk@mill.example": "desk@mill.example"}),
    "case_email_host": (_two(contact.of_site), {"desk@mill.example\nhttps://www.mill.example/": "true", "DESK@MILL.EXAMPLE\nhttps://mill.example/": "true", "desk@help.mill.example\nhttps://www.mill.example": "true", "desk@mill.example\nhttps://shop.mill.example/a": "true", "desk@loom.example\nhttps://mill.example": "false", "no address\nhttps://mill.example": "true"}),
    "case_share": (contact.is_share, {"https://twitter.com/intent/tweet?url=a": "true", "https://www.facebook.com/sharer/sharer.php?u=a": "true", "https://www.linkedin.com/sharing/share-offsite/?url=a": "true", "https://twitter.com/mill": "false", "https://www.linkedin.com/company/mill": "false"}),
    "case_image_extension": (urls.image_extension, {"https://m.example/_next/image?url=%2Fcrest.png&w=64": "png", "https://m.example/a/CREST.SVG": "svg", "https://m.example/a.jpeg?v=2": "jpg", "https://m.example/photo": "jpg", "https://m.example/p.webp": "webp", "https://m.example/favicon.ico": "ico"}),
    "case_type_extension": (urls.content_type_extension, {"image/png": "png", "image/jpeg": "jpg", "image/svg+xml": "svg", "image/webp; charset=utf-8": "webp", "image/x-icon": "ico", "text/html": None, "application/pdf": None}),
    "case_tracker": (lambda x: urls.asset_path(x).isNull(), {"https://www.google-analytics.com/c.gif": "true", "https://m.example/pixel.gif": "true", "https://m.example/mill.gif": "false"}),
    "case_included": (lambda x: urls.allowed(x, ("/feed", "?p="), ("/shop", "/about")), {"https://m.example/shop/1": "true", "https://m.example/about": "true", "https://m.example/blog": "false", "https://m.example/shop/feed": "false", "https://m.example/shop?p=3": "false"}),
    "case_base_font": (style.base_family, {"LarchSansBold": "larchsans", "LarchSans": "larchsans", "Larch Sans Medium": "larch sans", "Larch-Italic": "larch", "Larch Bold Italic": "larch", "Bold": "bold", "ABC": "abc"}),
    "case_brand_font": (style.brand_font, {"Larch Sans": "true", "sans-serif": "false", "system-ui": "false", "swiper-icons": "false", "Larch Icons": "false", "Font Awesome 6": "false", "var(--main)": "false", "Larch-Fallback": "false", "__larch_3a": "false", "": "false"}),
    "case_transparent": (style.transparent, {"#a1b2c300": "true", "#a1b2c3": "false", "rgba(1, 2, 3, 0)": "true", "rgba(1,2,3,0.0)": "true", "rgba(1,2,3,0.5)": "false", "rgb(1,2,3)": "false"}),
    "case_code_selector": (style.code_selector, {".hljs-name": "true", "pre code span": "true", ".token.string": "true", ".k": "true", ".hero .title": "false", "body": "false"}),
    "case_webfont_provider": (style.webfont_provider, {"https://fonts.googleapis.com/css?family=Larch": "google", "https://use.typekit.net/a1.css": "adobe", "https://fonts.bunny.net/css?family=larch": "bunny", "https://fonts.cdnfonts.com/css/larch": "cdnfonts", "https://m.example/a.css": None}),
    "case_webfont_families": (lambda x: F.array_join(style.webfont_families(x), "|"), {"https://fonts.googleapis.com/css?family=Larch:wght@400;700&family=Stone+Sans&display=swap": "Larch|Stone Sans", "https://fonts.googleapis.com/css?family=Stone+Sans%3A300%2C400i": "Stone Sans", "https://fonts.bunny.net/css?family=larch": "larch", "https://use.typekit.net/a1.css": ""}),
    "case_framework": (lambda x: F.array_join(F.transform(style.frameworks(x), lambda h: F.concat(h["framework"], F.lit(" "), h["confidence"])), "|"), {
        "https://m.example/_next/static/a.js": "Next.js high", "https://cdn.shopify.com/a.css": "Shopify high", "https://m.example/wp-content/a.css": "WordPress low", "https://m.example/wp-content/a.css https://m.example/wp-json/": "WordPress high", "<div data-v-app>": "Nuxt / Vue high", "/assets/index-B7a9Qz1x.js": "Vite medium",
        '<meta name="generator" content="millpress 3">': "millpress 3 medium", "plain": "",
    }),
    "case_challenge": (is_challenge, {"<title>Just a moment...</title>": "true", "<p>Verifying you are human</p>": "true", "<p>A moment in the mill</p>": "false"}),
    "case_provider": (blocks.embed_provider, {"https://youtu.be/x": "youtube", "https://player.vimeo.com/1": "vimeo", "https://www.google.com/maps/embed": "maps", "https://calendly.com/a": "calendly", "https://m.example/e": "iframe"}),
}


def _of_values(name: str, s: SparkSession) -> DataFrame:
    f, rows = VALUES[name]
    return s.createDataFrame([(k,) for k in rows], "input string").select("input", f(F.col("input")).cast("string").alias("result"))


def _patterns(s: SparkSession) -> DataFrame:
    return s.createDataFrame([(k, restore_pattern(k)) for k in PATTERNS], "input string, result string")


PATTERNS = {"C:/Program Files/Git/shop": "/shop", "C:\\Program Files\\Git\\about": "/about", "D:/other/wp-admin": "/wp-admin", "/shop": "/shop", "?lang": "?lang", "": ""}

# pages of HTML: name, URL, markup, and the values of their fields in order

_URL = "https://mill.example/a/page"
PAGES: dict[str, tuple[str, str, dict[str, list[str]]]] = {
    "meta": (_URL, '<html lang="en"><head><title> The  mill </title><title>Second</title><meta property="og:title" content="First og"><meta property="og:title" content="Last og"><meta name="description" content=""><meta property="og:description" content="From og"><meta name="description" content="From name">'
        '<meta property="og:image" content="/og.png"><meta name="twitter:image" content="/tw.png"><meta name="twitter:card" content="summary"><meta name="robots" content="NoIndex"><link rel="canonical" href="/c"><link rel="shortcut icon" href="/s.ico"><link rel="icon" href="/i.png"><link rel="icon" href="/j.png">'
        '<link rel="alternate" hreflang="DE" href="/de"><link rel="alternate" hreflang="de" href="/de"><link rel="alternate" hreflang="fr" href="/fr"><link rel="stylesheet" href="/a.css"><link rel="stylesheet" href="b.css"><link rel="stylesheet" href="/a.css"></head><body></body></html>',
        {"title": ["The mill"], "meta_title": ["Last og"], "meta_description": ["From og"], "og_image_url": ["/og.png"], "twitter_card": ["summary"], "meta_robots": ["noindex"], "language": ["en"], "canonical_url": ["https://mill.example/c"], "favicon_url": ["https://mill.example/i.png"], "hreflang_alternates": ["de https://mill.example/de", "fr https://mill.example/fr"], "stylesheet_urls": ["https://mill.example/a.css", "https://mill.example/a/b.css"]}),
    "plain": (_URL, "<body><p>short</p></body>", {"title": ["No title"], "meta_title": ["No title"], "meta_description": [""]}),
    "logo": (_URL, '<body><img src="/photo.jpg"><header><a href="/"><img data-src="/logo.png"></a></header></body>', {"title": ["No title"], "meta_title": ["No title"], "meta_description": [""], "logo_url": ["https://mill.example/logo.png"], "internal_links_out": ["https://mill.example/"], "crawl_links": ["https://mill.example/"], "content_blocks": ["image |https://mill.example/photo.jpg "]}),
    "data": (_URL, '<head><script type="application/ld+json">{"@type": "Organization", "name": "Mill", "logo": {"url": "https://mill.example/l.png"}, "address": {"@type": "PostalAddress", "streetAddress": "Weir 4", "addressLocality": "Hull", "addressCountry": "GB"}}</script><script type="application/ld+json">{broken</script></head>',
        {"title": ["No title"], "meta_title": ["No title"], "meta_description": [""], "logo_url": ["https://mill.example/l.png"], "addresses": ["Weir 4, Hull, GB"], "structured_data": ['{"@type": "Organization", "name": "Mill", "logo": {"url": "https://mill.example/l.png"}, "address": {"@type": "PostalAddress", "streetAddress": "Weir 4", "addressLocality": "Hull", "addressCountry": "GB"}}'],
         "organization": ['{"@type": "Organization", "name": "Mill", "logo": {"url": "https://mill.example/l.png"}, "address": {"@type": "PostalAddress", "streetAddress": "Weir 4", "addressLocality": "Hull", "addressCountry": "GB"}}']}),
    "nav": (_URL, '<body><nav><a href="/shop">Shop</a><a href="/shop">Shop</a><a href="/in">Log in</a><a href="#top">Top</a><a href="mailto:a@mill.example">Mail</a><a href="https://instagram.com/mill">Insta</a><a href="/flour"><h3>Flour</h3>Ground on stone</a></nav>'
        '<footer><h4>Visit</h4><p>Weir 4, Hull</p><p>Weir 4, Hull</p><p>Tiny</p><ul><li>One<li>Two</ul><a href="https://twitter.com/intent/tweet?u=1">Share</a><a href="https://twitter.com/mill">T</a></footer><p><a href="/x#part">x</a> <a href="https://other.example/">o</a> <a href="tel:+431588">call</a></p></body>',
        {"title": ["No title"], "meta_title": ["No title"], "meta_description": [""], "nav_links": ["Shop https://mill.example/shop header", "Log in https://mill.example/in utility", "Insta https://instagram.com/mill social", "Flour https://mill.example/flour mega_menu"], "footer_blocks": ["heading Visit|", "paragraph Weir 4, Hull|", "list |One|Two"],
         "internal_links_out": ["https://mill.example/shop", "https://mill.example/in", "https://mill.example/flour", "https://mill.example/x"], "social_links": ["instagram https://instagram.com/mill", "twitter https://twitter.com/mill"], "contact_links": ["mailto:a@mill.example", "tel:+431588"],
         "crawl_links": ["https://mill.example/shop", "https://mill.example/shop", "https://mill.example/in", "https://instagram.com/mill", "https://mill.example/flour", "https://twitter.com/intent/tweet?u=1", "https://twitter.com/mill", "https://mill.example/x", "https://other.example/"]}),
    "text": (_URL, '<body style="color:red"><style>p{margin:0}</style><table bgcolor="c0ffee"><tr><td>one</td><td>two</td></tr></table><p>The mill <b>stands</b>still today.</p><script>var x</script></body>',
        {"title": ["No title"], "meta_title": ["No title"], "meta_description": [""], "style_text": ["p{margin:0}\ncolor:red\nbackground:#c0ffee;\n"], "content_blocks": ["table | / one|two", "paragraph The mill stands still today.|"]}),
    "blocks": (_URL, '<main><h1>Mill</h1><p>Exactly twenty bytes</p><p>Now twenty-one bytes!</p><ul><li>a<ul><li>b</ul></ul><blockquote cite="/q">Too few</blockquote><blockquote>Just enough</blockquote><pre>abc</pre><pre><code class="language-rust">let a;</code></pre><pre class="python">x = 1</pre>'
        '<dl><dt>Oats<dd>Flat<dt>Rye<dd>Dark</dl><table><caption>Loaves</caption><tr><th>Kind<th>Price<tr><td>Rye<td>3</table><table><tr><td>lone</td></tr></table><video poster="/v.png"><source src="/v.mp4"></video><audio src="/a.mp3"></audio><iframe src="about:blank"></iframe><iframe data-src="https://youtu.be/q" title="T"></iframe>'
        '<img src="/1x1.gif"><img src="data:x" data-src="/d.png" alt="D"><img src="/d.png"><figure><img src="/f.png"><figcaption>Cap</figcaption></figure><picture><source srcset="/s.png 100w, /l.png 900w"><img src="/z.png"></picture></main>',
        {"title": ["No title"], "meta_title": ["No title"], "meta_description": [""], "content_blocks": ["heading Mill|", "paragraph Now twenty-one bytes!|", "list |a b|b", "quote Just enough|", "code let a;|rust", "code x = 1|python", "definitionlist |Oats=Flat|Rye=Dark", "table |Kind|Price / Rye|3", "media |video https://mill.example/v.mp4", "media |audio https://mill.example/a.mp3", "embed |youtube https://youtu.be/q",
         "image |https://mill.example/d.png D", "image |https://mill.example/f.png Cap", "image |https://mill.example/l.png "]}),
    "forms": (_URL, '<main><form action="/post" method="post"><label for="n">Name</label><input id="n" name="name"><label>Mail <input type="email" name="mail" required></label><textarea name="message"></textarea><input type="hidden" name="h"><button>Send</button></form><form><input type="search" name="q"></form><form action="/subscribe"><input type="email" name="e"><input type="submit" value="Go"></form>'
        '<form action="/login"><input name="u"><input type="password" name="p"></form><form action="/register"><input type="password" name="p"><button>Register</button></form><form><input name="cc-number"></form><form action="/comment"><textarea name="c"></textarea></form><form><select name="size"><option>A<option>B</select></form></main>',
        {"title": ["No title"], "meta_title": ["No title"], "meta_description": [""], "content_blocks": ["form |POST https://mill.example/post input:name|email:mail|textarea:message contact", "form |GET  search:q search", "form |GET https://mill.example/subscribe email:e newsletter", "form |GET https://mill.example/login input:u|password:p login", "form |GET https://mill.example/register password:p signup", "form |GET  input:cc-number payment", "form |GET https://mill.example/comment textarea:c comment", "form |GET  select:size generic"]}),
    "zones": (_URL, '<body><main><header><h2>Skipped</h2></header><h1>Kept</h1><div aria-hidden="true"><p>Hidden words of some length.</p></div><div class="swiper-slide-duplicate"><p>A cloned slide of some length.</p></div><p>A line long enough to be dropped again.</p><p>A line long enough to be dropped again.</p><p>A line of twenty-five b.</p><p>A line of twenty-five b.</p></main></body>',
        {"title": ["No title"], "meta_title": ["No title"], "meta_description": [""], "content_blocks": ["heading Kept|", "paragraph A line long enough to be dropped again.|", "paragraph A line of twenty-five b.|", "paragraph A line of twenty-five b.|"]}),
    "broken": (_URL, "<p>An unclosed paragraph with <b>bold words<p>and a second one &amp; an entity<ul><li>one<li>two</ul><h2>End", {"title": ["No title"], "meta_title": ["No title"], "meta_description": [""], "content_blocks": ["paragraph An unclosed paragraph with bold words|", "paragraph and a second one & an entity|", "list |one|two", "heading End|"]}),
}
_SINGLE = ("title", "meta_title", "meta_description", "og_image_url", "twitter_card", "meta_robots", "language", "canonical_url", "favicon_url", "logo_url", "style_text", "organization")
_LISTS: dict[str, Callable[[Column], Column]] = {
    "hreflang_alternates": lambda x: F.concat_ws(" ", x["lang"], x["url"]), "nav_links": lambda x: F.concat_ws(" ", x["text"], x["href"], x["role"]), "social_links": lambda x: F.concat_ws(" ", x["platform"], x["url"]), "structured_data": lambda x: x, "addresses": lambda x: x,
    "internal_links_out": lambda x: x, "crawl_links": lambda x: x, "stylesheet_urls": lambda x: x, "contact_links": lambda x: x,
}


def block_detail(b: Column) -> Column:
    """What a block holds beside its level and text, as one string."""
    list_ = lambda x: F.array_join(x, "|", "")
    rows = F.array_join(F.transform(b["rows"], list_), " / ")
    fields = F.array_join(F.transform(b["fields"], lambda f: F.concat(f["field_type"], F.lit(":"), f["name"])), "|")
    return (
        F.when(b["type"] == "list", list_(b["items"])).when(b["type"] == "table", F.concat(list_(b["headers"]), F.lit(" / "), rows)).when(b["type"] == "definitionlist", F.array_join(F.transform(b["definitions"], lambda d: F.concat(d["term"], F.lit("="), d["description"])), "|"))
        .when(b["type"] == "image", F.concat(b["original_url"], F.lit(" "), b["alt_text"])).when(b["type"] == "embed", F.concat(b["provider"], F.lit(" "), b["src"])).when(b["type"] == "media", F.concat(b["kind"], F.lit(" "), b["src"]))
        .when(b["type"] == "code", F.coalesce(b["language"], F.lit(""))).when(b["type"] == "form", F.concat(b["method"], F.lit(" "), b["action"], F.lit(" "), fields)).otherwise("")
    )


def _block_line(b: Column) -> Column:
    purpose = F.when(b["type"] == "form", F.concat(F.lit(" "), b["purpose"])).otherwise("")
    return F.concat(b["type"], F.lit(" "), F.coalesce(b["text"], F.lit("")), F.lit("|"), block_detail(b), purpose)


def _captured_fields(s: SparkSession) -> DataFrame:
    """Fields of the small pages: page, field, pos, value; fields that are null or empty lists have no rows."""
    names = list(PAGES)
    raw = s.createDataFrame([(k, PAGES[n][0], PAGES[n][1]) for k, n in enumerate(names)], "page_id bigint, url string, html string")
    page = capture(raw, (*_SINGLE, *_LISTS, "footer_blocks", "content_blocks"))
    rows = [F.when(F.coalesce(F.col(f), F.lit("") if f == "style_text" else F.lit(None)).isNotNull() & ((F.col(f) != "") | F.lit(f != "style_text")), F.array(F.struct(F.lit(f).alias("field"), F.lit(0).alias("pos"), F.col(f).alias("value")))) for f in _SINGLE]

    def listed(name: str, say: Callable[[Column], Column]) -> Column:
        return F.transform(name, lambda x, i: F.struct(F.lit(name).alias("field"), i.alias("pos"), say(x).alias("value")))

    rows += [listed(f, say) for f, say in {**_LISTS, "footer_blocks": _block_line, "content_blocks": _block_line}.items()]
    every = F.flatten(F.filter(F.array(*rows), lambda x: x.isNotNull()))
    named = F.element_at(F.array(*(F.lit(n) for n in names)), (F.col("page_id") + 1).cast("int"))
    return page.select(named.alias("page"), F.explode(every).alias("x")).select("page", "x.*")


def _captured_rows() -> list[tuple]:
    return [(page, field, pos, value) for page, (_, _, fields) in PAGES.items() for field, values in fields.items() for pos, value in enumerate(values)]


def _capped_images(s: SparkSession) -> DataFrame:
    raw = s.createDataFrame([(1, _URL, "<main>" + "".join(f'<img src="/{k}.png">' for k in range(5)) + "<p>Words after all of the pictures.</p></main>")], "page_id bigint, url string, html string")
    return capture(raw, ("content_blocks",), max_images=3).select(F.posexplode("content_blocks").alias("pos", "b")).select("pos", _block_line(F.col("b")).alias("value"))


# tables of blocks

def _b(kind: str, text: str | None = None, level: int | None = None, **more) -> dict:
    return {"type": kind, "text": text, "level": level, **more}


_H, _P, _I = (lambda t, n=2: _b("heading", t, n)), (lambda t: _b("paragraph", t)), _b("image", original_url="/i.png", local_path="", alt_text="")
BLOCKS: dict[str, tuple[list[dict], list[tuple[str, int, int, str]]]] = {
    "features": ([_H("Mill", 1), _P("Welcome"), *(x for k in "abc" for x in (_H(f"Part {k}"), _P(f"About {k}"))), *(x for k in "abc" for x in (_H(f"Why {k}?", 3), _P(f"Because {k}")))], [("hero", 0, 2, "Mill"), ("features", 2, 8, "3 feature items"), ("faq", 8, 14, "3 Q&A pairs")]),
    "team": ([*(x for k in "abc" for x in (_I, _H(f"Person {k}"))), _I, _I, _I], [("team", 0, 6, "3 cards"), ("gallery", 6, 9, "3 images")]),
    "prices": ([_H("Small $5"), _P("a"), _H("Middle €9"), _P("b"), _H("Large 12 Kč"), _P("c")], [("hero", 0, 2, "Small $5"), ("content", 2, 6, "Middle €9")]),
    "plans": ([_P("Our plans"), _H("Small $5"), _P("a"), _P("b"), _H("Middle €9"), _P("c"), _P("d"), _H("Large 12 Kč"), _P("e")], [("pricing-grid", 0, 8, "Small $5"), ("content", 8, 9, "e")]),
    "calls": ([_P("Some words"), _b("form", purpose="contact"), _b("embed", provider="youtube"), _P("More words")], [("content", 0, 1, "Some words"), ("cta", 1, 2, "form"), ("embed", 2, 3, "youtube"), ("content", 3, 4, "More words")]),
}


def _with_blocks(s: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A table whose last column holds blocks given as dicts."""
    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string(f"{columns}, content_blocks array<{BLOCK}>")
    names = kind["content_blocks"].dataType.elementType.names
    return s.createDataFrame([(*r[:-1], [tuple(b.get(n) for n in names) for b in r[-1]]) for r in rows], kind)


def _sections(s: SparkSession) -> DataFrame:
    return _with_blocks(s, [(n, b) for n, (b, _) in BLOCKS.items()], "name string").select("name", F.inline(blocks.sections()))


_MARKDOWN = [
    (_H("Mill", 3), "### Mill\n\n"), (_P("Words"), "Words\n\n"), (_b("list", items=["a", "b"]), "- a\n- b\n\n"), (_b("image", original_url="/o.png", local_path="", alt_text=""), "![image](/o.png)\n\n"), (_b("image", original_url="/o.png", local_path="images/x.png", alt_text="X"), "![X](images/x.png)\n\n"),
    (_b("table", headers=["a|b", "c"], rows=[["1|2", "3"]]), "| a|b | c |\n|---|---|\n| 1\\|2 | 3 |\n\n"), (_b("code", "x = 1", language="python"), "```python\nx = 1\n```\n\n"), (_b("quote", "one\ntwo", cite="/q"), "> one\n> two\n> — </q>\n\n"), (_b("definitionlist", definitions=[("Oats", "Flat")]), "**Oats**\n: Flat\n\n"),
]


def _markdown(s: SparkSession) -> DataFrame:
    rows = [(k, "T", "https://mill.example/", None, None, None, [b]) for k, (b, _) in enumerate(_MARKDOWN)]
    head = "# T\n\n<!-- url: https://mill.example/ -->\n\n"
    return _with_blocks(s, rows, "case int, title string, url string, canonical_url string, language string, meta_description string").select("case", F.substring(blocks.markdown(), len(head) + 1, 1_000).alias("markdown"))


# sites

_CSS = [
    ("a", ":root{--main: #336699;--gap:4px}body{color:#336699;font-family:'Larch Sans',serif}"), ("a", "@media print{h1{color:#336699;font-family:Larch Sans Bold}}p{color:#c0ffee;background:#fff}.hljs{color:#111213}"), ("a", "i{color:rgba(1,2,3,0);font-family:swiper-icons}"),
    ("b", "/* theme */a{color:#e06c75}b{color:#98c379}c{color:#d19a66}p{color:#123456;background:url(data:x)}"), ("c", ""), (None, "p{color:#abcdef}"),
]
_SHELL = [_I, _I, _H("Loading", 1), _P("Wait")]


def _css(s: SparkSession) -> DataFrame:
    return s.createDataFrame(_CSS, "site string, css string")


def _shells(s: SparkSession) -> DataFrame:
    rows = [(f"s{k}", k, f"https://s.example/{k}", 2, _SHELL) for k in range(10)] + [(f"f{k}", 20 + k, f"https://f.example/{k}", 250, _SHELL) for k in range(10)] + [(f"v{k}", 40 + k, f"https://v.example/{k}", 2, [_H("x")] * (5 + k)) for k in range(5)] + [("o", 60, "https://o.example/", 2, _SHELL)]
    table = _with_blocks(s, rows, "name string, page_id bigint, url string, total_words int").withColumn("site", F.left("name", F.lit(1))).withColumn("signature", blocks.signature()).drop("content_blocks")
    return site.shell_warnings(table)


def _partial(s: SparkSession) -> DataFrame:
    pages = s.createDataFrame([(h, f"https://{h}.example/{k}") for h, n in (("a", 2), ("b", 9), ("c", 3)) for k in range(n)], "site string, url string")
    skipped = s.createDataFrame([(h, f"https://{h}.example/s{k}", "bot_protected") for h, n in (("a", 4), ("b", 1), ("c", 3), ("d", 2)) for k in range(n)], "site string, url string, reason string")
    return site.partial_warnings(pages, skipped)


def _foreign(s: SparkSession) -> DataFrame:
    links = [("a.example", u) for u in ("https://new.example/1", "https://new.example/2", "https://old.example/1", "https://www.a.example/1", "https://x.a.example/1")] + [("b.example", "https://b.example/1"), ("b.example", "https://other.example/1"), ("b.example", "https://www.b.example/2")] + [("c.example", "https://c.example/")]
    return site.foreign_hosts(s.createDataFrame(links, "site string, url string"))


def _phones(s: SparkSession) -> DataFrame:
    return site.unique_phones(s.createDataFrame([("a", "+420731552608"), ("a", "+420 731 552 608"), ("a", "731552608"), ("b", "(212) 660-9245"), ("b", "+1 (212) 660 9245"), ("b", "01.46.22.87.15"), ("c", "")], "site string, phone string"))


def _emails(s: SparkSession) -> DataFrame:
    return site.unique_emails(s.createDataFrame([("a", "DESK@MILL.EXAMPLE"), ("a", "desk@mill.example"), ("a", "Press@Mill.example"), ("b", "desk@mill.example"), ("b", None)], "site string, email string"))


def _contacts(s: SparkSession) -> DataFrame:
    rows = [
        (1, "https://mill.example/contact", '<body><nav><a href="https://instagram.com/mill">I</a></nav><main><p>Write to desk@mill.example or press@loom.example, call (212) 660-9245.</p><p><a href="mailto:Shop%40mill.example?subject=x">m</a><a href="tel:212) 555-0188">t</a></p><form action="/post"><input type="email" name="email"><textarea name="m"></textarea></form></main></body>'),
        (2, "https://mill.example/blog/a", "<body><main><p>Ask author@mill.example or +43 512 588 0420.</p></main><footer><p>desk@mill.example</p></footer></body>"),
        (3, "https://mill.example/privacy", "<body><main><p>Officer: dpo@mill.example, regulator@state.example, +43 512 999 0420.</p></main></body>"),
        (4, "https://loom.example/", "<body><main><p>Nothing here.</p></main></body>"),
    ]
    raw = s.createDataFrame(rows, "page_id bigint, url string, html string")
    out = site.contacts(capture(raw, ("contact_links", "body_text", "chrome_text", "social_links", "addresses", "organization", "content_blocks")).withColumn("site", urls.host(F.col("url"))))
    return out.select("site", F.array_join("emails", "|").alias("emails"), F.array_join("phones", "|").alias("phones"), F.coalesce(F.array_join(F.transform("social_links", lambda x: F.concat_ws(" ", x["platform"], x["url"])), "|"), F.lit("")).alias("social"), F.array_join("contact_form_endpoints", "|").alias("forms"))


def _levels(s: SparkSession) -> DataFrame:
    c = s.createDataFrame([("a", "#1", 40), ("b", "#1", 12), ("c", "#1", 40), ("d", "#1", 2)], "site string, value string, count bigint")
    f = s.createDataFrame([("a", "x", 6), ("b", "x", 3), ("c", "x", 1), ("e", "x", 50)], "site string, family string, count bigint")
    return brand.confidence(c, f)


def _boosted(s: SparkSession) -> DataFrame:
    captured = s.createDataFrame([("a", ["https://fonts.googleapis.com/css?family=Larch", "https://mill.example/a.css"]), ("a", ["https://fonts.googleapis.com/css?family=Larch"]), ("b", ["https://fonts.bunny.net/css?family=stone-fallback"])], "site string, stylesheet_urls array<string>")
    fonts = s.createDataFrame([("a", "Larch", 2), ("a", "Stone", 9), ("b", "Oak", 1)], "site string, family string, count bigint")
    return brand.with_webfonts(fonts, brand.webfonts(captured))


def _logos(s: SparkSession) -> DataFrame:
    return site.common_logo(s.createDataFrame([("a", "/x.png"), ("a", "/y.png"), ("a", "/y.png"), ("a", "inline-svg://logo"), ("a", "inline-svg://logo"), ("a", "inline-svg://logo"), ("b", None), ("c", "/z.png"), ("c", "/k.png")], "site string, logo_url string"))


def _technologies(s: SparkSession) -> DataFrame:
    rows = [("a", 1, ["https://a.example/_next/static/x.css"], [], ""), ("a", 2, [], ["https://a.example/wp-content/x"], ""), ("a", 3, [], [], ""), ("a", 4, ["https://cdn.shopify.com/x.css"], [], ""), ("b", 1, [], [], "plain")]
    found = brand.technologies(s.createDataFrame(rows, "site string, page_id bigint, stylesheet_urls array<string>, internal_links_out array<string>, style_text string"))
    return found.select("site", "framework", "confidence", F.array_join("evidence", "|").alias("evidence"))


def _sheets(s: SparkSession) -> DataFrame:
    captured = s.createDataFrame([("a", "own{}", [f"https://a.example/{k:02}.css" for k in range(25)]), ("a", "", ["https://a.example/00.css"])], "site string, style_text string, stylesheet_urls array<string>")
    sheets = s.createDataFrame([(f"https://a.example/{k:02}.css", f"s{k}{{}}") for k in range(25)], "url string, css string")
    return brand.styles(captured, sheets)


def _assets(s: SparkSession) -> DataFrame:
    pages = s.createDataFrame([(1, "https://mill.example/og.png"), (2, "https://mill.example/none.png"), (3, None)], "page_id bigint, og_image_url string")
    assets = s.createDataFrame([("https://mill.example/og.png", "images/og.png"), ("https://mill.example/og.png", "images/og.png")], "url string, path string")
    return site.with_assets(pages, assets, "og_image_url", "og_image_path").select("page_id", "og_image_path")


def _outcomes(s: SparkSession) -> DataFrame:
    pages = s.createDataFrame([(1, "a", "https://a.example/1", None, ["no_h1", "thin_content"]), (2, "a", "https://a.example/2", "en", ["no_h1", "multiple_h1:2"]), (3, "b", "https://b.example/1", None, [])], "page_id bigint, site string, url string, language string, quality_flags array<string>")
    return site.flag_counts(pages)


#: Queries with the literal rows they give: query, columns with their SQL types, rows.
TABLES: dict[str, tuple[Callable[[SparkSession], DataFrame], str, list[tuple]]] = {
    "case_restored_pattern": (_patterns, "input VARCHAR, result VARCHAR", list(PATTERNS.items())),
    "case_html": (_captured_fields, "page VARCHAR, field VARCHAR, pos INT, value VARCHAR", _captured_rows()),
    "case_image_cap": (_capped_images, "pos INT, value VARCHAR", [*((k, f"image |https://mill.example/{k}.png ") for k in range(3)), (3, "paragraph Words after all of the pictures.|")]),
    "case_sections": (_sections, "name VARCHAR, section_type VARCHAR, block_start INT, block_end INT, summary VARCHAR", [(n, *r) for n, (_, rows) in BLOCKS.items() for r in rows]),
    "case_markdown": (_markdown, "case INT, markdown VARCHAR", [(k, m) for k, (_, m) in enumerate(_MARKDOWN)]),
    "case_colours": (lambda s: brand.colours(_css(s), 2), "site VARCHAR, value VARCHAR, count BIGINT", [("a", "#336699", 3), ("a", "#c0ffee", 1), ("b", "#123456", 1), (None, "#abcdef", 1)]),
    "case_fonts": (lambda s: brand.fonts(_css(s)), "site VARCHAR, family VARCHAR, count BIGINT", [("a", "Larch Sans", 2)]),
    "case_variables": (lambda s: brand.variables(_css(s)), "site VARCHAR, name VARCHAR, value VARCHAR, count BIGINT", [("a", "main", "#336699", 1), ("a", "gap", "4px", 1)]),
    "case_shell": (_shells, "site VARCHAR, warning VARCHAR", [("s", "spa_loading_shell:10_of_10_pages_share_4_block_template")]),
    "case_partial": (_partial, "site VARCHAR, skipped BIGINT, attempted BIGINT, warning VARCHAR", [("a", 4, 6, "partial_scrape:67%_skipped"), ("c", 3, 6, "partial_scrape:50%_skipped"), ("d", 2, 2, "partial_scrape:100%_skipped")]),
    "case_foreign": (_foreign, "site VARCHAR, percent INT, top VARCHAR, warning VARCHAR", [("a.example", 60, "new.example", "cross_domain_sitemap:60%_urls_at_new.example")]),
    "case_unique_phones": (_phones, "site VARCHAR, phone VARCHAR", [("a", "+420 731 552 608"), ("b", "+1 (212) 660 9245"), ("b", "01.46.22.87.15")]),
    "case_unique_emails": (_emails, "site VARCHAR, email VARCHAR", [("a", "desk@mill.example"), ("a", "Press@Mill.example"), ("b", "desk@mill.example")]),
    "case_contacts": (_contacts, "site VARCHAR, emails VARCHAR, phones VARCHAR, social VARCHAR, forms VARCHAR", [("mill.example", "Shop@mill.example|desk@mill.example|dpo@mill.example", "(212) 555-0188|(212) 660-9245|+43 512 588 0420", "instagram https://instagram.com/mill", "https://mill.example/post"), ("loom.example", "", "", "", "")]),
    "case_confidence": (_levels, "site VARCHAR, confidence VARCHAR", [("a", "high"), ("b", "medium"), ("c", "low"), ("d", "low"), ("e", "low")]),
    "case_webfont_boost": (_boosted, "site VARCHAR, family VARCHAR, count BIGINT", [("a", "Stone", 9), ("a", "Larch", 7), ("b", "Oak", 1)]),
    "case_logo": (_logos, "site VARCHAR, logo_url VARCHAR", [("a", "/y.png"), ("c", "/k.png")]),
    "case_technologies": (_technologies, "site VARCHAR, framework VARCHAR, confidence VARCHAR, evidence VARCHAR", [("a", "Next.js", "high", "__NEXT_DATA__ or /_next/static asset path"), ("a", "WordPress", "low", "/wp-content/ reference (possibly 3rd-party widget)")]),
    "case_style_sheets": (_sheets, "site VARCHAR, css VARCHAR", [("a", "own{}"), *(("a", f"s{k}{{}}") for k in range(20))]),
    "case_asset_paths": (_assets, "page_id BIGINT, og_image_path VARCHAR", [(1, "images/og.png"), (2, None), (3, None)]),
    "case_flag_counts": (_outcomes, "site VARCHAR, flag VARCHAR, pages BIGINT", [("a", "no_h1", 2), ("a", "thin_content", 1), ("a", "multiple_h1", 1)]),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every case by name; the data folder is not read."""
    out = {name: lambda s, d, name=name: _of_values(name, s) for name in VALUES}
    return out | {name: lambda s, d, make=make: make(s) for name, (make, _, _) in TABLES.items()}


def _literal(value) -> str:
    if value is None:
        return "NULL"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def _sql(columns: str, rows: list[tuple]) -> str:
    names = [c.split() for c in columns.split(", ")]
    values = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    return "SELECT " + ", ".join(f'CAST("{n}" AS {t}) AS "{n}"' for n, t in names) + f" FROM (VALUES {values}) AS t({', '.join(f'{chr(34)}{n}{chr(34)}' for n, _ in names)})"


def oracle_sql() -> dict[str, str]:
    """The rows of each case."""
    out = {name: _sql("input VARCHAR, result VARCHAR", list(rows.items())) for name, (_, rows) in VALUES.items()}
    return out | {name: _sql(columns, rows) for name, (_, columns, rows) in TABLES.items()}
