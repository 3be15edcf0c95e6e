from pyspark.sql import functions as F

from pagemill.functions import blocks, contact, style
from pagemill.functions.blocks import find_sections
from tests.conftest import block, heading, items, paragraph


def apply(spark, function, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in df.select("i", function(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


GOOD = ["+420 604 550 936", "+1 (415) 555 0123", "+44 20 7946 0958", "604-550-936", "(720) 330-2660", "06.12.34.56.78", "+1 800 222 7890"]
BAD = ["29 30 31 32 34 36", "2025-05-13", "0123456789", "123 456", "2026-45185", "2024 567890", "059   301   71.58", "1762296503 \n       3", "1762296503", "11301667 3", "+1 4155550123 9", "+420 111 222 333", "+1 (555) 555-5555"]


def test_phones(spark):
    assert apply(spark, contact.looks_like_phone, GOOD) == [True] * len(GOOD)
    assert apply(spark, contact.looks_like_phone, BAD) == [False] * len(BAD)


def test_brackets(spark):
    cases = {"718) 486-7422": "(718) 486-7422", "  916) 445-1254  ": "(916) 445-1254", "(415) 555-0123": "(415) 555-0123", "415-555-0123 (": "415-555-0123", ") 718 486": "718 486"}
    assert apply(spark, contact.balance_brackets, cases) == list(cases.values())


def test_digits_for_comparison(spark):
    cases = {"+420 771 231 771": "771231771", "771 231 771": "771231771", "+1 (415) 555 0123": "4155550123", "1-855-496-1110": "8554961110", "0044 20 7946 0958": "2079460958", "+999 12 345 678": "9912345678", "": ""}
    assert apply(spark, contact.canonical_digits, cases) == list(cases.values())


def test_mail(spark):
    cases = {"info%40a.example": "info@a.example", "a%2Bb%40x.example": "a+b@x.example", "a%20b%40x.example": "ab@x.example", "a%99b@x.example": "a%99b@x.example"}
    assert apply(spark, contact.decode_mail, cases) == list(cases.values())
    base = F.lit("https://www.brand.example")
    assert apply(spark, lambda e: contact.of_site(e, base), ["INFO@BRAND.example", "s@help.brand.example", "x@other.example", "no mail"]) == [True, True, False, True]
    assert apply(spark, contact.is_share, ["https://t.example/intent/tweet?x", "https://t.example/me"]) == [True, False]


def test_font_families(spark):
    cases = {"AktivGrotestBold": "aktivgrotest", "Helvetica Bold Italic": "helvetica", "Helvetica-Bold": "helvetica", "Open Sans": "open sans", "Bold": "bold", "BMW": "bmw", "Inter Black": "inter"}
    assert apply(spark, style.base_family, cases) == list(cases.values())


def test_styles(spark):
    css = ".main-box{color:#ABC123;background:rgba(0,0,0,0)} .hljs-x{color:#123456} @media x{.other{color:#fff;color:#00ff0000}.third{color:rgb(1, 2, 3)}} .k1{color:#654321} h1{font-family:'My Font', serif;font-family: inherit;font-family:icomoon} :root{--main: #123; --img: data:x;}"
    assert apply(spark, style.colours, [css, None, ""]) == [["#abc123", "rgb(1, 2, 3)", "#123"], None, []]
    assert apply(spark, style.fonts, [css]) == [["My Font"]]
    assert [[tuple(v) for v in x] for x in apply(spark, style.variables, [css])] == [[("main", "#123")]]


def test_webfonts(spark):
    urls = ["https://fonts.googleapis.com/css?family=Inter:wght@400;700&family=Roboto&display=swap", "https://fonts.bunny.net/css?family=Libre+Franklin%3A300%2C300i", "https://use.typekit.net/x.css", "https://x.example/a.css"]
    assert apply(spark, style.webfont_provider, urls) == ["google", "bunny", "adobe", None]
    assert apply(spark, style.webfont_families, urls) == [["Inter", "Roboto"], ["Libre Franklin"], [], []]


def test_frameworks(spark):
    texts = ['<script id="__NEXT_DATA__">', "/wp-content/x", "/wp-content/plugins/elementor /wp-json/", '<meta name="generator" content="Ghost 5">', "nothing", "/assets/main-CnJ5sBrs.js"]
    found = [[(h.framework, h.confidence, len(h.evidence)) for h in x] for x in apply(spark, style.frameworks, texts)]
    assert found == [[("Next.js", "high", 1)], [("WordPress", "low", 1)], [("WordPress", "high", 3)], [("ghost 5", "medium", 1)], [], [("Vite", "medium", 1)]]


def test_sections():
    long = [heading("Hero"), paragraph("Welcome")] + [b for k in range(3) for b in (heading(f"F{k}", 2), paragraph("d"))] + [b for k in range(3) for b in (heading(f"Q{k}?", 3), paragraph("a"))] + [block(type="form"), block(type="embed", provider="maps"), block(type="image"), block(type="image"), block(type="image"), items("x")]
    found = find_sections(long)
    assert [s["section_type"] for s in found] == ["hero", "features", "faq", "cta", "embed", "gallery", "content"]
    assert found[0]["block_start"] == 0 and found[-1]["block_end"] == len(long)
    assert all(a["block_end"] == b["block_start"] for a, b in zip(found, found[1:], strict=False))
    prices = [paragraph("x"), heading("€9", 2), heading("$29 / mo", 2), items("a"), heading("Pro 99 eur", 2)]
    assert [s["section_type"] for s in find_sections(prices)] == ["pricing-grid"]
    assert find_sections([]) == []


def test_block_columns(make_pages):
    rows = [heading("Hello"), paragraph("World\u00a0wide"), block(type="image", alt_text="", local_path="b.png"), items("a", "b"), block(type="table", headers=["x y"], rows=[["1", "2"]], caption=None), block(type="definitionlist", definitions=[("t", "d e")]), block(type="media", kind="video")]
    df = make_pages({"page_id": 1, "content_blocks": rows, "url": "https://x.example/blog/foo", "title": "T"}, {"page_id": 2})
    a, b = df.select("page_id", blocks.plain_text().alias("t"), blocks.total_words().alias("w"), blocks.signature().alias("s"), blocks.assets().alias("f"), blocks.category().alias("c"), blocks.summary().alias("m")).orderBy("page_id").collect()
    assert tuple(a) == (1, "Hello\nWorld\u00a0wide\na\nb", 12, "h1,p,img,ul,table,dl,video", ["b.png"], "blog-post", "World\u00a0wide")
    assert tuple(b) == (2, "", 0, "", [], "home", "")


def test_categories(make_pages):
    cases = {"/": "home", "/kontakt": "contact", "/gdpr": "legal", "/blog": "blog-index", "/blog/foo": "blog-post", "/products/x": "product", "/services": "service", "/pricing": "pricing", "/x": "page"}
    df = make_pages(*({"page_id": i, "url": "https://x.example" + p, "title": "T"} for i, p in enumerate(cases)))
    assert [r[0] for r in df.orderBy("page_id").select(blocks.category()).collect()] == list(cases.values())
    product = make_pages({"page_id": 1, "url": "https://x.example/x", "structured_data": ['{"@type": "product"}', None, "bad"]})
    assert product.select(blocks.category()).first()[0] == "product"


def test_flags(make_pages):
    rows = [paragraph("tiny"), block(type="image", alt_text=""), block(type="image", alt_text="photo.jpg"), block(type="image", alt_text=" ")]
    df = make_pages({"page_id": 1, "url": "u", "title": "x" * 71, "meta_robots": "noindex, nofollow", "meta_description": "d", "content_blocks": rows}, {"page_id": 2, "title": "No title", "content_blocks": [block(type="embed", provider="iframe", src="https://a.example")]}, {"page_id": 3})
    found = [r[0] for r in df.withColumn("total_words", blocks.total_words()).orderBy("page_id").select(blocks.quality_flags()).collect()]
    assert found[0] == ["no_h1", "meta_description_too_short", "title_too_long", "no_canonical", "meta_robots_noindex", "meta_robots_nofollow", "images_missing_alt:1", "images_low_quality_alt:2", "thin_content"]
    assert found[1] == ["no_h1", "no_meta_description", "no_title", "no_canonical", "thin_content", "parked_domain"]


def test_markdown(make_pages):
    rows = [heading("H", 2), paragraph("P"), items("a", "b"), block(type="image", alt_text="", local_path="", original_url="u"), block(type="table", caption="c", headers=["a|b"], rows=[["x|y", "2"]]), block(type="code", language="sql", text="select"), block(type="quote", text="l1\nl2", cite="z"), block(type="definitionlist", definitions=[("t", "d")]), block(type="embed", provider="maps", src="s", title="")]
    text = make_pages({"page_id": 1, "title": "T", "url": "U", "language": "en", "content_blocks": rows}).select(blocks.markdown()).first()[0]
    assert text == "# T\n\n<!-- url: U -->\n<!-- lang: en -->\n\n## H\n\nP\n\n- a\n- b\n\n![image](u)\n\n**c**\n\n| a|b |\n|---|\n| x\\|y | 2 |\n\n```sql\nselect\n```\n\n> l1\n> l2\n> — <z>\n\n**t**\n: d\n\n> **Embed** (maps): [maps](s)\n\n"
