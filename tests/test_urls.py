from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagemill.config import EngineConfig, restore_pattern
from pagemill.functions import urls
from pagemill.sources.html_tree import absolute


def apply(spark, function, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, url string")
    return [r[0] for r in df.select("i", function(F.col("url")).alias("x")).orderBy("i").select("x").collect()]


def test_canonical(spark):
    cases = {
        "HTTPS://WWW.Shop.Example:443/a/b//?utm_source=x&q=1&REF=y#top": "https://www.shop.example/a/b?q=1", "http://shop.example": "http://shop.example/", "http://shop.example/?fbclid=1": "http://shop.example/", "not a url": "not a url",
        "https://shop.example/?a=1+2&b": "https://shop.example/?a=1%202&b=", "": "", None: None,
    }
    assert apply(spark, urls.canonical, cases) == list(cases.values())


def test_slugs(spark):
    assert apply(spark, urls.slug, ["https://x.example/", "https://x.example/a/b c", "https://x.example/a--b/", "https://x.example/" + "a" * 90, None]) == ["home", "a-b-c", "a-b", "a" * 80, None]
    assert apply(spark, urls.host_slug, ["https://www.foo-bar.example/x", "https://x.example", "nothing"]) == ["foo-bar_example", "x_example", "site"]


def test_priority(spark):
    cases = {"https://x.example/": 0, "https://x.example": 0, "https://x.example/contact-us": 1, "https://x.example/kontakt": 1, "https://x.example/about": 2, "https://x.example/privacy-policy": 3, "https://x.example/products/cookies": 100, "https://x.example/account/login": 200, "https://x.example/search": 200, "bad": 100}
    assert apply(spark, urls.priority, cases) == list(cases.values())


def test_extensions(spark):
    assert apply(spark, urls.image_extension, ["https://x.example/i?url=%2Flogo.png&w=9", "https://x.example/c.SVG", "https://x.example/a.jpeg", "https://x.example/photo"]) == ["png", "svg", "jpg", "jpg"]
    assert apply(spark, urls.content_type_extension, ["image/svg+xml", "image/webp; charset=utf-8", "text/html", None]) == ["svg", "webp", None, None]
    assert apply(spark, urls.asset_path, ["https://x.example/pixel.gif"]) == [None]


def test_robots_cover(spark):
    rules = F.array(F.lit("/admin/"), F.lit("/api$"))
    assert apply(spark, lambda u: urls.disallowed(u, rules), ["https://x.example/admin/users", "https://x.example/", "https://x.example/api", "https://x.example/api/", "bad", None]) == [True, False, True, False, False, False]
    assert apply(spark, lambda u: urls.disallowed(u, F.array(F.lit("/"))), ["https://x.example/a"]) == [True]


def test_patterns():
    assert restore_pattern("C:/Program Files/Git/home") == "/home"
    assert restore_pattern("D:/shell-root/wp-admin") == "/wp-admin"
    assert [restore_pattern(p) for p in ("/home", "?x", "")] == ["/home", "?x", ""]
    assert EngineConfig(default_excludes=False, excludes=("/x",)).exclude_patterns == ("/x",)
    assert len(EngineConfig().exclude_patterns) == 16


@settings(max_examples=25, deadline=None)
@given(st.lists(st.from_regex(r"https?://[a-zA-Z]{1,5}\.example(/[a-z/]{0,6})?(\?[a-z]{1,3}=[a-z+]{0,3}(&utm_x=1)?)?(#[a-z]{0,3})?", fullmatch=True), min_size=8, max_size=8))
def test_canonical_is_idempotent_and_slugs_are_safe(spark, values):
    once = apply(spark, urls.canonical, values)
    assert apply(spark, urls.canonical, once) == once
    assert all(s and len(s) <= 80 and set(s) <= set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-") for s in apply(spark, urls.slug, values))


def test_absolute():
    base = "https://Shop.Example/a/b?x=1"
    assert absolute(base, "../c") == "https://shop.example/c"
    assert absolute(base, "//CDN.example:443/x y") == "https://cdn.example/x%20y"
    assert absolute(base, "?q=é") == "https://shop.example/a/b?q=%C3%A9"
    assert absolute(base, "\\d") == "https://shop.example/d"
    assert absolute("", "x") is None
    assert absolute(base, "http://[bad") is None
