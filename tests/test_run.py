import glob
import json

from pagemill.__main__ import config_of, parser
from pagemill.config import EngineConfig
from pagemill.plans.run import run, selected


def test_run_writes_everything(spark, tmp_path):
    html = '<html lang="en"><head><title>T {}</title></head><body><nav><a href="/about">A</a></nav><main><h1>Head</h1><p>A paragraph of some length, really.</p></main></body></html>'
    rows = [(k, f"https://s.example/p{k}", html.format(k)) for k in range(4)]
    rows += [(10, "https://s.example/p1?utm_source=x", html), (11, "https://s.example/cart/x", html), (12, "https://s.example/secret/x", html), (13, "https://t.example/", "<title>Just a moment...</title>"), (14, None, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    robots = spark.createDataFrame([("s.example", "User-agent: *\nDisallow: /secret/")], "site string, body string")
    config = EngineConfig(output_dir=str(tmp_path / "out"), markdown=True, split_pages=True, partitions=2)
    found = run(spark, pages, config, robots=robots)
    assert sorted(r.url for r in found.collect() if r.url) == [f"https://s.example/p{k}" for k in range(4)]
    assert {p.rsplit("/", 1)[1] for p in glob.glob(str(tmp_path / "out" / "*"))} == {"scraped", "pages", "markdown", "compact", "sitemap", "contact", "brand", "site", "skipped", "index", "schema", "assets", "status"}
    assert spark.read.text(str(tmp_path / "out" / "status")).first()[0] == "complete"
    assert spark.read.json(str(tmp_path / "out" / "skipped")).first().reason == "bot_protected"
    bundle = spark.read.json(str(tmp_path / "out" / "site")).where("site = 's.example'").first()
    assert bundle.total_pages == 4 and bundle.templates[0].page_count == 4
    assert json.loads(spark.read.text(str(tmp_path / "out" / "schema")).first()[0])["type"] == "struct"
    assert "style_text" not in spark.read.json(str(tmp_path / "out" / "scraped")).columns
    assert selected(pages, EngineConfig(site="s.example", max_pages=2), None).count() == 2


def test_options():
    config = config_of(parser().parse_args(["in", "-o", "x", "--exclude", "C:/Program Files/Git/a", "--no-default-excludes", "--no-extract-brand", "-m", "5"]))
    assert (config.output_dir, config.exclude_patterns, config.extract_brand, config.max_pages) == ("x", ("/a",), False, 5)


def test_discovery_error_pages_and_index(spark, tmp_path):
    page = lambda k: f'<html lang="en"><head><title>T|{k}</title><style>p{{color:#336699}}</style></head><body><main><h1>Head</h1><p>A paragraph of some length, really.</p></main></body></html>'
    pages = spark.createDataFrame([(k, f"https://s.example/p{k}", page(k)) for k in range(4)] + [(9, "https://new.example/x", page(9))], "page_id bigint, url string, html string")
    links = spark.createDataFrame([("s.example", "https://s.example/p0", "https://s.example/p1", 0), ("s.example", "https://s.example/p1", "https://s.example/p2", 0), ("s.example", "https://s.example/p2", "https://s.example/p3", 0)], "site string, src_url string, dst_url string, link_pos int")
    assert sorted(r.page_id for r in selected(pages, EngineConfig(site="s.example", max_depth=2), links=links).collect()) == [0, 1, 2]
    sitemaps = spark.createDataFrame([("https://s.example/sitemap.xml", "<sitemapindex><loc>https://s.example/s0.xml</loc></sitemapindex>")] + [(f"https://s.example/s{k}.xml", f"<sitemapindex><loc>https://s.example/s{k + 1}.xml</loc></sitemapindex>") for k in range(5)] + [("https://s.example/s5.xml", "<urlset><loc>https://s.example/p3</loc></urlset>")], "url string, body string")
    assert [r.page_id for r in selected(pages, EngineConfig(), sitemaps=sitemaps).collect()] == [3]
    probes = spark.createDataFrame([(77, "https://s.example/none", "<title>Gone</title><main><p>There is nothing at this address.</p></main>")], "page_id bigint, url string, html string")
    skipped = spark.createDataFrame([("s.example", "https://s.example/q", None), ("gone.example", "https://gone.example/", "http_error")], "site string, url string, reason string")
    root = str(tmp_path / "out")
    run(spark, pages, EngineConfig(output_dir=root, capture_404=True, extract_brand=False, partitions=2), skipped=skipped, probes=probes)
    error = spark.read.json(f"{root}/error_pages").first()
    assert error.is_error_page and error.title == "Gone" and "thin_content" in error.quality_flags and error.sections[0].section_type == "content"
    assert spark.read.json(f"{root}/site").where("site = 's.example'").first().total_pages == 4 and not glob.glob(f"{root}/brand")
    lines = lambda site: [line for f in sorted(glob.glob(f"{root}/index/site={site}/*.txt")) for line in open(f).read().splitlines()]
    own = lines("s.example")
    assert own[:3] == ["# Site export: s.example", "> **Warning** 4 of 4 pages share 2 block template (spa_loading_shell)", "> Skipped pages, render_failed: 1"] and "- **Pages**: 4" in own and "- **Language**: en" in own and "| `no_canonical` | 4 |" in own
    assert own.index("## At a glance") < own.index("## Page templates") < own.index("## Quality flags") < own.index("## Pages") and own[-4:] == [f"| https://s.example/p{k} | `page` | T\\|{k} | 7 | — | 0 | 0 | 0 |" for k in range(4)]
    assert lines("gone.example")[0] == "# Site export: gone.example (no page was captured)"
    run(spark, pages, EngineConfig(output_dir=root, site="s.example", partitions=2))
    assert "- **Top colours**: `#336699` (4×)" in lines("s.example")
    master = json.loads("".join(open(f).read() for f in glob.glob(f"{root}/master/*.txt")))
    assert master["total_pages"] == 4 and [p["page_id"] for p in master["pages"]] == [0, 1, 2, 3] and "style_text" not in master["pages"][0]
