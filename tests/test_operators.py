import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagemill.operators import brand, discover, nested, site
from pagemill.operators.components import components
from pagemill.plans import sinks
from tests.conftest import block, heading, paragraph, rows_of


# nested records

JSONS = st.recursive(st.none() | st.booleans() | st.integers(-5, 5) | st.text("ab.[", max_size=3), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text("kx", max_size=2), x, max_size=3), max_leaves=12)


def walk(value, path, parent, out):
    if isinstance(value, dict):
        out.append((path, parent))
        for k, v in value.items():
            walk(v, f"{path}.{k}", path, out)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            walk(v, f"{path}[{i}]", parent, out)
    return out


@given(JSONS)
def test_labels_link_like_the_nesting(value):
    nodes, _ = nested.label([("r", value, None)])
    up = nested.link(nodes)
    assert [(n[4], nodes[p][4] if p >= 0 else "") for n, p in zip(nodes, up, strict=True)] == walk(value, "r", "", [])
    assert [n[0] for n in nodes] == sorted(n[0] for n in nodes)


@given(JSONS)
def test_deep_decoder_agrees(value):
    text = json.dumps(value)
    assert nested._decode_deep(text) == value
    for bad in (text + ",", "[" + text, text + "]", '{"a"' + text + "}"):
        with pytest.raises(ValueError):
            json.loads(bad)
        with pytest.raises(ValueError):
            nested._decode_deep(bad)


def test_nested_table(spark, make_pages):
    deep = "[" * 50_000 + '{"a": {"b": 1}}' + "]" * 50_000
    row = {"page_id": 1, "structured_data": ['{"@type": "A", "x": [{"y": "{}"}, [{"z": "\\ud800"}]]}', None, "bad", "", "3"], "content_blocks": [heading("h"), block(type="form", fields=[("t", "n", "", "", True, [])]), block(type="definitionlist", definitions=[("a", "b"), None])]}
    df = make_pages(row, row, {"page_id": 2}, {"page_id": 3, "structured_data": [deep]}, {"page_id": 4, "structured_data": [], "content_blocks": []})
    found = rows_of(nested.found(df).where("page_id < 3"), "page_id", "node_path", "parent_path")
    want = [("structured_data[0]", ""), ("structured_data[0].x[0]", "structured_data[0]"), ("structured_data[0].x[1][0]", "structured_data[0]"), ("content_blocks[0]", ""), ("content_blocks[1]", ""), ("content_blocks[1].fields[0]", "content_blocks[1]"), ("content_blocks[2]", ""), ("content_blocks[2].definitions[0]", "content_blocks[2]")]
    assert found == sorted(((1, *w) for w in want), key=repr)
    assert nested.found(df).where("page_id = 3").count() == 2
    nodes = nested.node_table(df).where("page_id = 1")
    pairs = nested.contained(nodes, nodes).groupBy("page_id", "inner_pre").agg(F.max("outer_pre").alias("parent"))
    assert rows_of(pairs, "inner_pre", "parent") == rows_of(nodes.where("parent_pre >= 0"), "pre", "parent_pre")
    assert rows_of(nested.attribute_table(df).where("page_id = 1"), "name", "kind") == [("@type", "string"), ("y", "string"), ("z", "string")]
    assert nested.found(df.limit(0)).count() == 0


def test_values_of_blocks(spark, make_pages):
    form = block(type="form", action="/a", submit_text="Go", fields=[("select", "n", "Size", "", True, ["S", None, "L"]), None])
    row = {
        "page_id": 1, "structured_data": ['{"@type": "heading", "x": [{"y": 1}]}', "bad"],
        "content_blocks": [heading("h", 2), form, block(type="definitionlist", definitions=[None, ("a", None), ("b", "c")]), block(type="table", headers=["k"], rows=[["1", None], None, []]), block(type="list", items=["i", ""])],
    }
    df = make_pages(row, row, {"page_id": 2}, {"page_id": 3, "content_blocks": []})
    nodes, values = nested.node_table(df), nested.block_attribute_table(df)
    assert sorted(values.columns) == sorted(nested.attribute_table(df).columns)
    linked = values.join(nodes.withColumnRenamed("pre", "owner_pre"), ["page_id", "owner_pre"])
    b, f, d = "content_blocks[{}]".format, "content_blocks[1].fields[0]", "content_blocks[2].definitions[{}]".format
    want = [
        (b(0), "type", "string", "heading"), (b(0), "level", "number", "2"), (b(0), "text", "string", "h"), (b(1), "type", "string", "form"), (b(1), "action", "string", "/a"), (b(1), "submit_text", "string", "Go"), (b(1), "fields[1]", "null", None),
        (f, "field_type", "string", "select"), (f, "name", "string", "n"), (f, "label", "string", "Size"), (f, "placeholder", "string", ""), (f, "required", "bool", "true"), (f, "options[0]", "string", "S"), (f, "options[1]", "null", None), (f, "options[2]", "string", "L"),
        (b(2), "type", "string", "definitionlist"), (b(2), "definitions[0]", "null", None), (d(1), "term", "string", "a"), (d(2), "term", "string", "b"), (d(2), "description", "string", "c"), (b(3), "type", "string", "table"), (b(3), "headers[0]", "string", "k"),
        (b(3), "rows[0][0]", "string", "1"), (b(3), "rows[0][1]", "null", None), (b(3), "rows[1]", "null", None), (b(4), "type", "string", "list"), (b(4), "items[0]", "string", "i"), (b(4), "items[1]", "string", ""),
    ]
    assert rows_of(linked, "node_path", "name", "kind", "value") == sorted(want, key=repr)
    assert values.count() == len(want)
    assert nested.block_attribute_table(df.limit(0)).count() == 0
    # the tables by type have each node once
    kinds = [nested.type_table(nodes, t) for t in nested.NODE_TYPES] + [nested.other_table(nodes)]
    assert sorted(r for k in kinds for r in rows_of(k, "page_id", "pre")) == sorted(rows_of(nodes, "page_id", "pre"))


def test_blocks_without_a_type_are_objects(make_pages):
    df = make_pages({"page_id": 1, "content_blocks": [None, block(text="x", definitions=[("a", "b")]), heading("h")]})
    want = [("content_blocks[1]", "object", ""), ("content_blocks[1].definitions[0]", "object", "content_blocks[1]"), ("content_blocks[2]", "heading", "")]
    assert rows_of(nested.node_table(df), "node_path", "node_type", "parent_path") == want
    linked = nested.block_attribute_table(df).join(nested.node_table(df).withColumnRenamed("pre", "owner_pre"), ["page_id", "owner_pre"])
    assert ("content_blocks[1]", "text", "x") in rows_of(linked, "node_path", "name", "value")


def test_tables_by_type_are_registered():
    from pagemill.plans import catalogue

    assert {"p2_block_attributes", "p2_nodes_other", *(f"p2_nodes_{t.lower()}" for t in nested.NODE_TYPES)} <= set(catalogue.queries())


# graphs


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=30))
def test_components(spark, links):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    df = spark.createDataFrame([*links, (None, 1), (3, None)], "a bigint, b bigint")
    used = {x for a, b in links if a != b for x in (a, b)}
    assert rows_of(components(df), "id", "component") == sorted(((x, root(x)) for x in used), key=repr)


def test_crawl(spark):
    links = [("s", "https://h.example/", "https://h.example/a", 0), ("s", "https://h.example/", "https://h.example/b#x", 1), ("s", "https://h.example/a", "https://h.example/", 0), ("s", "https://h.example/a", "https://h.example/c", 1), ("s", "https://h.example/c", "https://h.example/d", 0), ("s", "https://h.example/b", "https://o.example/", 0), ("s", "https://h.example/b", "https://h.example/cart/", 0), (None, None, None, None)]
    edges = spark.createDataFrame(links, "site string, src_url string, dst_url string, link_pos int")
    start = spark.createDataFrame([("s", "https://h.example/")], "site string, url string")
    found = {r.url: r.depth for r in discover.crawl(edges, start, 2, None, ("/cart/",)).collect()}
    assert found == {"https://h.example/": 0, "https://h.example/a": 1, "https://h.example/b": 1, "https://h.example/c": 2}
    assert {r.url for r in discover.crawl(edges, start, 3, 2).collect()} == {"https://h.example/", "https://h.example/a"}
    assert discover.crawl(edges.limit(0), start, 2, None).count() == 1


def test_sitemaps_with_a_cycle(spark):
    bodies = [("i.xml", "<sitemapindex><loc>a.xml</loc><loc>i.xml</loc></sitemapindex>"), ("a.xml", "<urlset><loc>https://x.example/?a=1&amp;b=2</loc><loc>b.txt</loc><loc>i.xml?x</loc></urlset>"), ("plain", "no map")]
    df = spark.createDataFrame(bodies, "url string, body string")
    start = spark.createDataFrame([("s", "i.xml"), ("s", "plain"), ("s", "missing.xml")], "site string, url string")
    assert rows_of(discover.sitemap_urls(df, start), "site", "url") == [("s", "https://x.example/?a=1&b=2"), ("s", "plain")]


def test_robots():
    body = "User-agent: *\nDisallow: /admin/\nDisallow: /private/ # x\nCrawl-delay: 2\n\nUser-agent: other\nDisallow: /\n"
    assert discover.read_robots(body) == {"disallow": ["/admin/", "/private/"], "crawl_delay_ms": 2000}
    assert discover.read_robots("User-agent: *\nUser-agent: bad\nDisallow: /x") == {"disallow": [], "crawl_delay_ms": None}
    assert discover.read_robots("user-agent: PageMill-bot\ncrawl-delay: x\ndisallow: /x")["disallow"] == ["/x"]
    assert discover.read_robots(None) == {"disallow": [], "crawl_delay_ms": None}


# sites


def test_templates_and_shells(make_pages):
    shell = [block(type="image"), block(type="image"), heading("Loading"), paragraph("wait")]
    df = make_pages(*({"page_id": i, "site": "s", "url": f"https://s.example/{i}", "content_blocks": shell} for i in range(10)), {"page_id": 20, "site": "t", "url": "u", "content_blocks": shell}, {"page_id": 21, "site": "t"})
    assert rows_of(site.template_counts(df), "site", "block_pattern", "page_count", "sample_page") == [("s", "img,img,h1,p", 10, "https://s.example/0")]
    assert rows_of(site.shell_warnings(df), "site", "warning") == [("s", "spa_loading_shell:10_of_10_pages_share_4_block_template")]
    pair = make_pages(*({"page_id": i, "site": "s", "url": "u", "content_blocks": [block(type="image"), heading("n")]} for i in range(2)))
    assert site.template_counts(pair).first().template_id == "tpl_7e75cc0b"


def test_unique_contacts(spark):
    mails = spark.createDataFrame([("s", "PRESS@a.example"), ("s", "press@a.example"), ("s", "X@a.example"), ("t", "press@a.example"), ("s", None)], "site string, email string")
    assert rows_of(site.unique_emails(mails), "site", "email") == [("s", "X@a.example"), ("s", "press@a.example"), ("t", "press@a.example")]
    phones = spark.createDataFrame([("s", p) for p in ("+420604550936", "+420 604 550 936", "604550936", "(415) 555-0123", "+1 (415) 555 0123", "", None)], "site string, phone string")
    assert rows_of(site.unique_phones(phones), "phone") == [("+1 (415) 555 0123",), ("+420 604 550 936",)]


def test_contacts_of_html(spark):
    from pagemill.sources.pages import capture

    html = '<body><a href="mailto:info%40shop.example?x">m</a><a href="mailto:a@other.example">n</a><a href="tel:+420 604 550 936">t</a><footer><a href="https://github.com/shop">g</a></footer><script type="application/ld+json">{"@type":"Organization","address":{"@type":"PostalAddress","streetAddress":"1 Row","postalCode":"9"}}</script><form action="/c"><input type=email><textarea></textarea></form>Call 604-550-111 or press@shop.example</body>'
    df = spark.createDataFrame([(1, "https://shop.example/contact", html), (2, "https://shop.example/", None)], "page_id bigint, url string, html string")
    row = site.contacts(capture(df, ("contact_links", "body_text", "chrome_text", "social_links", "addresses", "organization", "content_blocks")).withColumn("site", F.lit("s"))).first()
    assert (row.emails, row.addresses, row.contact_form_endpoints) == (["info@shop.example", "press@shop.example"], ["1 Row, 9"], ["https://shop.example/c"])
    assert row.phones == ["+420 604 550 936", "604-550-111"] and row.social_links[0].platform == "github"
    assert json.loads(row.organization)["@type"] == "Organization"


def test_warnings(spark, make_pages):
    pages = make_pages({"page_id": 1, "site": "s", "url": "a"}, {"page_id": 2, "site": "t", "url": "b"}, {"page_id": 3, "site": "t", "url": "c"})
    skipped = spark.createDataFrame([("s", "x", None), ("s", "x", None), ("t", "y", "http_error"), ("u", "z", "http_error")], "site string, url string, reason string")
    assert rows_of(site.partial_warnings(pages, skipped), "site", "warning") == [("s", "partial_scrape:50%_skipped"), ("u", "partial_scrape:100%_skipped")]
    assert rows_of(site.skip_reasons(skipped), "site", "reason", "pages") == [("s", "render_failed", 1), ("t", "http_error", 1), ("u", "http_error", 1)]
    links = spark.createDataFrame([("www.a.example", u) for u in ("https://b.example/1", "https://b.example/2", "https://c.example/", "https://a.example/", "https://sub.a.example/", "bad")], "site string, url string")
    assert rows_of(site.foreign_hosts(links), "percent", "top") == [(50, "b.example")]


def test_summaries(make_pages):
    df = make_pages({"page_id": 1, "site": "s", "url": "https://s.example/a", "internal_links_out": ["https://s.example/b/", "https://s.example/b/"], "content_blocks": [block(type="form")]}, {"page_id": 2, "site": None, "url": None}, {"page_id": 3, "site": "s", "url": "https://s.example/b", "internal_links_out": []})
    assert rows_of(site.page_summaries(df), "page_id", "internal_links_in", "has_form", "block_count") == [(1, 0, True, 1), (2, 0, False, 0), (3, 0, False, 0)]
    assert rows_of(site.page_summaries(df, canonical_links=True), "page_id", "internal_links_in") == [(1, 0), (2, 0), (3, 1)]


def test_palette(spark):
    from pagemill.functions.tables import THEMES

    css = ".brand-a{color:#aa0000} .brand-b{color:#aa0000;color:#00bb00} " + " ".join(f".theme-{c[1:]}{{color:{c}}}" for c in THEMES[0][:3]) + " h1{font-family:Foo} h2{font-family:Foo} h3{font-family:'Foo Bold'}"
    df = spark.createDataFrame([("s", css), ("t", f".x-long{{color:{THEMES[0][0]}}}"), ("u", None)], "site string, css string")
    colours = brand.colours(df)
    assert rows_of(colours, "site", "value", "count") == [("s", "#00bb00", 1), ("s", "#aa0000", 2), ("t", THEMES[0][0], 1)]
    assert rows_of(brand.fonts(df), "site", "family", "count") == [("s", "Foo", 3)]
    assert rows_of(brand.colours(df, 1), "site", "value") == [("s", "#aa0000"), ("t", THEMES[0][0])]
    sheets = spark.createDataFrame([("s", ["https://fonts.googleapis.com/css?family=Foo&family=Baz"]), ("s", None)], "site string, stylesheet_urls array<string>")
    assert rows_of(brand.with_webfonts(brand.fonts(df), brand.webfonts(sheets)), "family", "count") == [("Baz", 5), ("Foo", 8)]
    assert rows_of(brand.confidence(colours, brand.fonts(df)), "site", "confidence") == [("s", "low"), ("t", "low")]


def test_plan_of_urls(spark):
    urls = ["https://s.example/products/w", "https://s.example/cart", "https://s.example/contact", "https://s.example/", "https://s.example/contact/"]
    df = spark.createDataFrame([("s", u, i) for i, u in enumerate(urls)], "site string, url string, ord int")
    assert rows_of(site.planned(df, 3), "url") == [("https://s.example/",), ("https://s.example/contact",)]


# outputs


def test_sinks(spark, make_pages, tmp_path):
    df = make_pages({"page_id": 1, "site": "s", "url": "https://s.example/a", "title": "T", "content_blocks": [heading("h"), paragraph("p")] * 12}, {"page_id": 2, "site": "s", "url": "https://s.example/a"})
    sinks.write_jsonl(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    sinks.write_markdown(df, str(tmp_path / "markdown"))
    assert spark.read.text(str(tmp_path / "markdown" / "site=s" / "slug=a")).count() > 2
    sinks.write_split_pages(df, str(tmp_path / "pages"))
    assert spark.read.json(str(tmp_path / "pages")).where("slug = 'a'").count() == 2
    assert len(sinks.compact(df).where("page_id = 1").first().headings) == 12
    assert {r.kind for r in sinks.asset_manifest(spark, str(tmp_path)).collect()} == {"page-json", "page-md"}
    sinks.mark_status(spark, str(tmp_path / "status"), "complete")
    assert spark.read.text(str(tmp_path / "status")).first()[0] == "complete"
    kind = "contact struct<emails:array<string>,phones:array<string>,social_links:array<struct<platform:string,url:string>>,addresses:array<string>,contact_form_endpoints:array<string>>, templates array<struct<template_id:string,block_pattern:string,page_count:bigint,sample_page:string>>, quality_flags array<struct<flag:string,pages:bigint>>, quality_warnings array<string>"
    bundles = spark.createDataFrame([("s", 2, None, (["a@s.example"], [], [], [], []), None, [("no_h1", 2)], None)], f"site string, total_pages bigint, language string, {kind}")
    lines = [r.line for r in sinks.index_lines(bundles, site.page_summaries(df)).orderBy("part", "line_no").collect()]
    assert lines[:4] == ["# Site export: s", "## At a glance", "- **Site**: s", "- **Pages**: 2"] and "- **E-mails**: a@s.example" in lines and "| `no_h1` | 2 |" in lines and len([x for x in lines if x.startswith("| https://s.example/a |")]) == 2
    assert "page_id" in sinks.json_schema(df)


def test_empty_tables(make_pages):
    df = make_pages({"page_id": 1}).limit(0)
    for out in (site.page_summaries(df), site.templates(df), site.hreflang_groups(df), site.template_pages(df), site.first_values(df), site.category_counts(df), sinks.compact(df)):
        assert out.count() == 0


def test_broadcasts_are_bounded_in_rows_and_bytes_and_tables_are_forgotten(spark):
    from pagemill import runtime

    df = spark.createDataFrame([(k, "x" * 1_000, ["y" * 100] * 10) for k in range(50)], "k int, s string, a array<string>")
    assert runtime.small(df, 50) and not runtime.small(df, 49) and not runtime.small(df, 50, 50_000) and not runtime.small(df.select("a"), 50, 50_000) and runtime.small(df.select("k"), 50, 400)
    assert runtime.small(df.limit(0), 0)
    runtime.forget(spark)
    kept = runtime.materialise(df)
    assert kept.count() == 50 and runtime.forget(spark) == 1 and runtime.forget(spark) == 0


def test_nan_and_infinity_are_no_json():
    from pagemill.operators import nested

    assert [nested.decode(t)[1] for t in ('{"a": NaN}', "[Infinity]", "-Infinity", '{"a": "NaN"}', "[1e5]", "9" * 6_000)] == [False, False, False, True, True, True]
    assert nested.decode("[" * 50_000 + "NaN" + "]" * 50_000) == (None, False)
