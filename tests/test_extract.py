import pytest

from pagemill.sources.extract import Page, form_purpose, size, without_repeats
from pagemill.sources.html_tree import parse
from pagemill.sources.pages import capture

URL = "https://shop.example/dir/page"


def page(html):
    return Page(URL, html)


def blocks(html, **options):
    return [{k: v for k, v in b.items()} for b in page(html).content_blocks(**options)]


def test_tree_closes_what_is_left_open():
    root = parse("<p>one<b>two<p>three<ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table>")
    assert [n.text() for n in root.find("p")] == ["one two", "three"]
    assert [n.text() for n in root.find("li")] == ["a", "b"]
    assert [[c.text() for c in r.find("td")] for r in root.find("tr")] == [["1", "2"], ["3"]]


def test_tree_raw_text_and_entities():
    root = parse("<title>a <b>b</b> &amp; c</title><script>if (a) { '</p>' }</script><body>x &middot y<br/>z")
    assert next(root.find("title")).text() == "a <b>b</b> & c"
    assert "</p>" in "".join(next(root.find("script")).texts())
    assert next(root.find("body")).text() == "x · y z"


@pytest.mark.parametrize("html", ["", "   ", "<", "<p", "plain text", "<!DOCTYPE", "</div></p>", "<![if x]>", "\x00"])
def test_any_text_is_a_page(html):
    p = page(html)
    assert p.meta()["title"] == "No title"
    assert p.nav_links() == [] and p.footer_blocks() == []


def test_meta():
    m = page('<html lang="de"><head><title>T</title><meta property="og:title" content="A"><meta property="og:title" content="B"><meta name="description" content="d"><meta property="og:description" content="e"><meta name="robots" content="NoIndex"><meta name="twitter:image" content=" i "></head>')
    assert m.meta() == {"title": "T", "meta_title": "B", "meta_description": "d", "og_image_url": "i", "twitter_card": None, "meta_robots": "noindex"}
    assert m.language() == "de"


def test_head_links():
    p = page('<link rel="icon" href="a.png"><link rel="apple-touch-icon" href="/b.png"><link rel="shortcut icon" href="c"><link rel="canonical" href="/x"><link rel="alternate" hreflang="DE" href="/de"><link rel="alternate" hreflang="de" href="/de"><link rel="stylesheet" href="s.css">')
    assert p.favicon_url() == "https://shop.example/b.png"
    assert p.canonical_url() == "https://shop.example/x"
    assert p.hreflang_alternates() == [{"lang": "de", "url": "https://shop.example/de"}]
    assert p.stylesheet_urls() == ["https://shop.example/dir/s.css"]


def test_logo():
    assert page('<header><img src="l.png"></header>').logo_url() == "https://shop.example/dir/l.png"
    assert page('<div class="site-logo"><svg></svg></div>').logo_url() == "inline-svg://logo"
    assert page('<script type="application/ld+json">{"@type":"Organization","logo":{"url":"u"}}</script>').logo_url() == "u"
    assert page('<script type="application/ld+json">{bad</script>').structured() == []


def test_navigation():
    p = page('<nav><a href="/a">Cart</a><a href="/b"><h3>Shoes</h3><p>All of them</p></a><a href="https://github.com/x">Code</a><a href="#x">no</a><a href="/a">Cart</a></nav>')
    assert [(x["text"], x["description"], x["role"]) for x in p.nav_links()] == [("Cart", None, "utility"), ("Shoes", "All of them", "mega_menu"), ("Code", None, "social")]


@pytest.mark.parametrize("html", ["<footer><p>Some text</p><ul><li>a</ul></footer>", '<div role="contentinfo"><p>Some text</p><ul><li>a</ul></div>', '<div class="Footer-wrap"><p>Some text</p><ul><li>a</ul></div>'])
def test_footer(html):
    assert page(html).footer_blocks() == [{"type": "paragraph", "text": "Some text"}, {"type": "list", "items": ["a"]}]


def test_links():
    p = page('<a href="/x#f">1</a><a href="/x">2</a><a href="https://other.example/">3</a><a href="mailto:a@b.c">4</a>')
    assert p.internal_links() == ["https://shop.example/x"]
    assert p.crawl_links() == ["https://shop.example/x", "https://shop.example/x", "https://other.example/"]
    assert p.contact_links() == ["mailto:a@b.c"]


def test_thresholds_are_bytes():
    assert size("žluť") == 6
    assert blocks(f"<p>{'a' * 20}</p><p>{'a' * 21}</p><p>{'ž' * 11}</p>") == [{"type": "paragraph", "text": "a" * 21}, {"type": "paragraph", "text": "ž" * 11}]
    assert [b["text"] for b in blocks("<blockquote>1234567</blockquote><blockquote>12345678</blockquote>")] == ["12345678"]


def test_skip_zones_and_main():
    found = blocks('<nav><h1>no</h1></nav><main><h2>yes</h2><header><h3>no</h3></header><div aria-hidden="true"><h3>no</h3></div><div class="slick-cloned"><h3>no</h3></div></main><h1>outside</h1>')
    assert [b["text"] for b in found] == ["yes"]


def test_container_guard():
    html = "<blockquote><p>A paragraph directly in a quote</p></blockquote>"
    assert [b["type"] for b in blocks(html)] == ["quote"]
    assert [b["type"] for b in blocks(html, legacy_container_guard=True)] == ["quote", "paragraph"]


def test_images():
    html = '<figure><picture><source srcset="s.jpg 100w, l.jpg 900w"><img src="m.jpg" alt=""></picture><figcaption>Cap</figcaption></figure><img src="/l.jpg"><img src="1x1.gif"><img data-src="d.png"><img src="l.jpg">'
    assert [(b["original_url"], b["alt_text"]) for b in blocks(html)] == [("https://shop.example/dir/l.jpg", "Cap"), ("https://shop.example/l.jpg", ""), ("https://shop.example/dir/d.png", "")]
    assert len(blocks(html, max_images=1)) == 1
    assert len(blocks("<svg>" + "<path d='M0 0'></path>" * 5 + "</svg>")) == 1


def test_lists_tables_definitions_code_media():
    found = blocks(
        "<ul><li>a<ul><li>b</li></ul></li></ul><table><caption>c</caption><tr><th>x<th>y</tr><tr><td>1<td><table><tr><td>in</td></tr></table></td></tr></table>"
        "<dl><dt>t<dd>d<dd>e</dl><pre><code class='hljs python'>x = 1</code></pre><video><source src='v.mp4'></video><iframe src='https://www.youtube.com/e'></iframe>"
    )
    assert found[0] == {"type": "list", "items": ["a b", "b"]}
    assert found[1] == {"type": "table", "caption": "c", "headers": ["x", "y"], "rows": [["1", "in", "in"]]}
    assert found[2]["definitions"] == [{"term": "t", "description": "d"}, {"term": "t", "description": "e"}]
    assert (found[3]["language"], found[3]["text"]) == ("python", "x = 1")
    assert found[4]["src"] == "https://shop.example/dir/v.mp4"
    assert found[5]["provider"] == "youtube"


def test_forms():
    form = blocks("<form action='/send'><label for=n>Name</label><input id=n name=n required><label>Mail <input type=email name=e></label><textarea name=m></textarea><select name=s><option>1<option>2</select><input type=hidden><button>Go</button></form>")[0]
    assert (form["action"], form["method"], form["submit_text"], form["purpose"]) == ("https://shop.example/send", "GET", "Go", "contact")
    assert [(f["field_type"], f["label"], f["required"], f["options"]) for f in form["fields"]] == [("input", "Name", True, []), ("email", "Mail", False, []), ("textarea", "", False, []), ("select", "", False, ["1", "2"])]


@pytest.mark.parametrize(
    ("fields", "submit", "action", "purpose"),
    [([("q", "search")], "Go", "", "search"), ([("cc-number", "text")], "Pay", "", "payment"), ([("m", "textarea")], "Post comment", "", "comment"), ([("e", "email"), ("p", "password")], "Log in", "", "login"), ([("e", "email"), ("p", "password")], "Sign up", "/register", "signup"), ([("e", "email")], "Send", "", "newsletter"), ([("a", "text")], "Go", "", "generic")],
)
def test_purposes(fields, submit, action, purpose):
    assert form_purpose([{"name": n, "field_type": t} for n, t in fields], submit, action) == purpose


def test_repeats():
    long = {"type": "paragraph", "text": "x" * 31}
    assert without_repeats([long, dict(long), {"type": "paragraph", "text": "s"}, {"type": "paragraph", "text": "s"}]) == [long, {"type": "paragraph", "text": "s"}, {"type": "paragraph", "text": "s"}]


def test_capture_table(spark):
    df = spark.createDataFrame([(1, URL, "<h1>Hi</h1>"), (2, None, None), (2, None, None)], "page_id bigint, url string, html string")
    rows = capture(df, ("title", "content_blocks", "addresses")).orderBy("page_id").collect()
    assert [r.title for r in rows] == ["No title"] * 3
    assert rows[0].content_blocks[0].text == "Hi" and rows[1].content_blocks == []
