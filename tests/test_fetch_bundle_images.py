import http.server
import json
import struct
import threading
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.functions import images
from pagemill.operators import brand, bundle, site
from pagemill.sources.fetch import fetch, fetch_one, images as fetched_images, named_assets, probe_urls, raw_pages, robots_files, robots_urls, skipped_pages, write_assets
from pagemill.sources.pages import capture
from tests.conftest import rows_of


class Server(http.server.BaseHTTPRequestHandler):
    tries: dict = {}

    def do_GET(self):
        n = self.tries[self.path] = self.tries.get(self.path, 0) + 1
        status = {"/missing": 404, "/down": 503, "/flaky": 200 if n > 2 else 500}.get(self.path, 200)
        body = {"/robot": "<title>Just a moment...</title>", "/robots.txt": "User-agent: *\nDisallow: /x"}.get(self.path, "<h1>Zażółć</h1>").encode()
        picture = self.path.endswith((".png", "/logo"))
        self.send_response(status)
        self.send_header("Content-Type", "image/svg+xml" if self.path == "/logo" else "image/png" if picture else "text/html; charset=utf-8")
        self.end_headers()
        self.wfile.write(bytes(range(256)) * (1 if self.path == "/dot.png" else 5) if picture else body)

    def log_message(self, *_):
        pass


@pytest.fixture
def base():
    Server.tries = {}
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_retries(base):
    pauses = []
    assert fetch_one(base + "/flaky", sleep=pauses.append)[::3] == (200, 3) and pauses == [0.2, pytest.approx(0.6)]
    assert fetch_one(base + "/missing", sleep=pauses.append)[::3] == (404, 1)
    assert fetch_one(base + "/down", retries=2, sleep=pauses.append)[::3] == (503, 3)
    assert fetch_one("nothing", sleep=pauses.append)[::3] == (None, 1)


def test_fetch_table(spark, base):
    df = spark.createDataFrame([("s", base + p) for p in ("/a", "/a", "/missing", "/robot")] + [("s", "bad"), ("s", None)], "site string, url string")
    found = fetch(df, delay_ms=20, retries=0).cache()
    assert found.count() == 4
    assert [r.html for r in raw_pages(found).collect()] == ["<h1>Zażółć</h1>"]
    assert sorted(r.reason for r in skipped_pages(found).collect()) == ["bot_protected", "http_error", "render_failed"]
    found.unpersist()


def test_bytes_of_assets(spark, base, tmp_path):
    df = spark.createDataFrame([("s", base + p) for p in ("/a.png", "/dot.png", "/pixel.png", "/missing", "/logo")], "site string, url string")
    got = fetch(df.where("NOT endswith(url, 'logo')"), retries=0, binary=True)
    kept = fetched_images(got).collect()
    assert [(r.url, bytes(r.content)) for r in kept] == [(base + "/a.png", bytes(range(256)) * 5)] and kept[0].path.startswith("images/") and kept[0].path.endswith(".png")
    logo = named_assets(fetch(df.where("endswith(url, 'logo')"), retries=0, binary=True), "logo")
    written = write_assets(logo, str(tmp_path)).collect()
    assert [(r.site, r.path, r.size_bytes) for r in written] == [("s", "images/logo.svg", 1_280)]
    assert (tmp_path / "s" / "images" / "logo.svg").read_bytes() == bytes(range(256)) * 5


def test_robots_and_probe_urls(spark, base):
    df = spark.createDataFrame([("s", base + "/b"), ("s", base + "/a"), ("t", None), ("t", "bad")], "site string, url string")
    assert rows_of(robots_urls(df), "site", "url") == [("s", base + "/robots.txt")]
    assert rows_of(robots_files(fetch(robots_urls(df), retries=0)), "site", "body") == [("s", "User-agent: *\nDisallow: /x")]
    (site_, url), = rows_of(probe_urls(df, "run 1"), "site", "url")
    assert site_ == "s" and url.startswith(base + "/pagemill-probe-") and (site_, url) not in rows_of(probe_urls(df, "run 2"), "site", "url")


def png(pixels, kind, filters=None):
    height, width, channels = pixels.shape
    rows, before = b"", np.zeros(width * channels, int)
    for y in range(height):
        line, f = pixels[y].ravel().astype(int), (filters or [0])[y % len(filters or [0])]
        left = np.r_[np.zeros(channels, int), line[:-channels]]
        corner = np.r_[np.zeros(channels, int), before[:-channels]]
        if f == 4:
            guess = [min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2] for a, b, c in zip(left, before, corner, strict=True)]
        else:
            guess = {0: 0 * line, 1: left, 2: before, 3: (left + before) // 2}[f]
        rows += bytes([f]) + bytes(((line - guess) % 256).astype(np.uint8))
        before = line
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_png_round_trip():
    rng = np.random.default_rng(3)
    for kind, channels in ((0, 1), (2, 3), (4, 2), (6, 4)):
        pixels = rng.integers(0, 256, (7, 5, channels), dtype=np.uint8)
        found = images.pixels_of(png(pixels, kind, [0, 1, 2, 3, 4]))
        assert found.shape == (7, 5, 4)
        assert (found[..., :channels] == pixels).all() if kind in (2, 6) else (found[..., 0] == pixels[..., 0]).all()


def test_dominant_colours(spark):
    pixels = np.zeros((300, 10, 4), np.uint8)
    pixels[:] = (255, 255, 255, 255)
    pixels[:150, :4] = (0xAB, 0x10, 0x22, 255)
    pixels[:150, 4:6] = (0x11, 0xCC, 0x22, 255)
    pixels[150:, :2] = (9, 9, 9, 255)
    pixels[150:, 2:9] = (0x11, 0xCC, 0x22, 100)
    raw = png(pixels, 6)
    assert [v for v, _ in images.dominant(raw)] == ["#a01020", "#10c020"]
    assert images.dominant(b"broken") == images.dominant(None) == []
    colours = spark.createDataFrame([("s", "#123456", 3)], "site string, value string, count bigint")
    logos = spark.createDataFrame([("s", raw), ("t", b"x")], "site string, content binary")
    assert rows_of(images.with_image_colours(colours, logos), "site", "value") == [("s", "#10c020"), ("s", "#123456"), ("s", "#a01020")]


def test_bundle(spark):
    html = '<html lang="en"><head><title>T</title><link rel="stylesheet" href="https://fonts.googleapis.com/css?family=Foo"><link rel="stylesheet" href="/a.css"><style>.main-x{color:#aa0000}</style></head><body><nav><a href="/a">A</a></nav><main><h1>H</h1></main></body>'
    raw = spark.createDataFrame([(k, f"https://s.example/{k}", html) for k in range(3)], "page_id bigint, url string, html string")
    captured = capture(raw, bundle.FIELDS).withColumn("site", F.lit("s")).withColumn("quality_flags", F.array(F.lit("no_h1")))
    sheets = spark.createDataFrame([("https://s.example/a.css", ".main-y{color:#00bb00} h1{font-family:Bar}")], "url string, css string")
    row = bundle.site_bundles(captured, stylesheets=sheets).first()
    assert (row.language, row.total_pages, [c.value for c in row.colors], [(f.family, f["count"]) for f in row.fonts]) == ("en", 3, ["#aa0000", "#00bb00"], [("Foo", 5), ("Bar", 1)])
    assert row.templates[0].page_count == 3 and row.primary_nav[0].text == "A" and row.quality_warnings == ["spa_loading_shell:3_of_3_pages_share_1_block_template"]
    assert json.loads(bundle.site_bundles(captured).toJSON().first())["contact"]["emails"] == []
    assert brand.styles(captured, sheets, most=1).count() == 3
    assert bundle.site_bundles(captured.limit(0)).count() == 0


def test_outcomes_and_assets(spark, make_pages):
    pages = make_pages({"page_id": 1, "site": "s", "url": "a"}, {"page_id": 1, "site": "s", "url": "a"}, {"page_id": 2, "site": "s", "url": None})
    skipped = spark.createDataFrame([("s", "a"), ("s", "b"), ("s", "b")], "site string, url string")
    assert rows_of(site.outcome_counts(pages, skipped), "site", "captured", "skipped", "attempted") == [("s", 2, 1, 3)]
    assets = spark.createDataFrame([("a", "p"), ("a", "p"), (None, "q")], "url string, path string")
    assert rows_of(site.with_assets(pages.select("page_id", "url").distinct(), assets, "url", "local"), "page_id", "local") == [(1, "p"), (2, None)]


def gif(rows, palette, clear=None):
    """A GIF whose codes are never longer than at first: a clear code before every second number."""
    bits, codes = 2, []
    for v in rows.ravel().tolist():
        codes += [4, v]
    held, n = 0, 0
    for c in [*codes, 5]:
        held, n = held | c << n, n + 3
    data = held.to_bytes((n + 7) // 8, "little")
    packed = b"".join(bytes([len(data[k : k + 255])]) + data[k : k + 255] for k in range(0, len(data), 255)) + b"\0"
    h, w = rows.shape
    control = b"\x21\xf9\x04\x01\0\0" + bytes([clear]) + b"\0" if clear is not None else b""
    return b"GIF89a" + struct.pack("<HHBBB", w, h, 0x81, 0, 0) + bytes(palette) + control + b"\x2c" + struct.pack("<HHHHB", 0, 0, w, h, 0) + bytes([bits]) + packed + b";"


def test_gif_and_ico():
    rows = np.array([[0, 1, 1], [2, 1, 3]])
    palette = [10, 20, 200, 200, 30, 40, 90, 160, 30, 60, 60, 60]
    found = images.pixels_of(gif(rows, palette, 3))
    assert found[..., :3].tolist() == np.array(palette).reshape(-1, 3)[rows].tolist() and found[..., 3].tolist() == [[255, 255, 255], [255, 255, 0]]
    assert images.dominant(gif(rows, palette)) [0] == ("#c01020", 3)
    # a run of one number needs codes that stand for what they have just begun
    assert images._unpacked((4 | 1 << 3 | 6 << 6 | 7 << 9 | 5 << 13).to_bytes(3, "little"), 2, 100)[:6] == bytes([1] * 6)
    picture = struct.pack("<IiiHHIIiiII", 40, 2, 4, 1, 32, 0, 0, 0, 0, 0, 0) + bytes([200, 30, 10, 255] * 3 + [0, 0, 0, 0]) + bytes(8)
    small = struct.pack("<IiiHHIIiiII", 40, 1, 2, 1, 32, 0, 0, 0, 0, 0, 0) + bytes([1, 2, 3, 255]) + bytes(4)
    head = struct.pack("<HHH", 0, 1, 2) + struct.pack("<BBBBHHII", 1, 1, 0, 0, 1, 32, len(small), 38) + struct.pack("<BBBBHHII", 2, 2, 0, 0, 1, 32, len(picture), 38 + len(small))
    assert images.dominant(head + small + picture) == [("#0010c0", 3)]
    assert images.dominant(b"GIF89a") == images.dominant(b"\0\0\1\0\1\0") == []
