import random

import pyarrow as pa
from pyspark.sql import functions as F

from pagemill.llm import site_lines as sl
from tests.conftest import block, heading, items, paragraph, rows_of

LINE = "All rights reserved, every one"


def test_found_and_cleaned(make_pages):
    pages = [{"page_id": i, "site": "s", "content_blocks": [heading("Title number " + "abcdefgh"[i]), paragraph(f"Own text of page {'abcdefgh'[i] * 9}\n {LINE.upper()}!! \nrest"), items(LINE, None, f"{i}", "ok")]} for i in range(6)]
    pages += [pages[0], {"page_id": 20, "site": "t", "content_blocks": [paragraph(LINE)]}, {"page_id": 21, "site": None, "content_blocks": [paragraph(LINE)] * 9}, {"page_id": 22, "site": "s"}, {"page_id": 23, "site": "s", "content_blocks": [block(), paragraph(None), block(type="list", items=None), block(type="quote", text=LINE)]}]
    df = make_pages(*pages)
    want = [(i, b, j) for i in range(6) for b, j in ((1, 1), (2, 0))]
    assert rows_of(sl.found(df), "page_id", "block_idx", "line_idx") == sorted(want, key=repr)
    kept = {(r.page_id, r.block_idx): r.text for r in sl.cleaned(df).collect()}
    assert kept[0, 1] == "Own text of page aaaaaaaaa\nrest" and kept[0, 2] == "0\nok" and kept[20, 0] == LINE
    assert sl.found(df.limit(0)).count() == 0


def test_five_pages_are_too_few_however_often_a_page_repeats(make_pages):
    df = make_pages(*({"page_id": i, "site": "s", "content_blocks": [items(LINE, LINE, LINE)]} for i in range(5)))
    assert sl.found(df).count() == 0


def test_summaries_lose_no_heavy_line():
    rng = random.Random(3)
    for counters in (30, 60, 200):
        true = {(site, k): 6 if k % 20 == 0 else rng.randint(1, 3) for site in "st" for k in range(300)}
        stream = [(site, 0, k, 0, 1) for (site, k), n in true.items() for _ in range(n)]
        rng.shuffle(stream)
        parts = [pa.Table.from_pylist([dict(zip(sl._SUMMARY.names, r, strict=True)) for r in stream[i::7]], schema=sl._SUMMARY) for i in range(7)]
        summaries = [sl.merge([p], counters) for p in parts]
        total = sl.merge(summaries, counters).to_pylist()
        error = {r["site"]: r["n"] for r in total if r["k1"] is None}
        assert set(error) == ({"s", "t"} if counters < 200 else set(error)) and all(e <= len(stream) / 2 / counters for e in error.values())
        for site in "st":
            kept = {r["k1"]: r["n"] for r in total if r["site"] == site and r["k1"] is not None}
            assert len(kept) <= counters and all(kept.get(k, 0) <= n <= kept.get(k, 0) + error.get(site, 0) for (s, k), n in true.items() if s == site)
        ordered = pa.concat_tables([t.cast(sl._SUMMARY) for t in summaries]).sort_by([("site", "ascending"), ("shard", "ascending")])
        found = [r for b in sl._summarise(iter(ordered.to_batches(max_chunksize=50)), 6, counters) for r in b.to_pylist()]
        lost = {r["site"] for r in found if r["k1"] is None}
        heavy = {(r["site"], r["k1"]) for r in found if r["k1"] is not None}
        assert all(key in heavy or key[0] in lost for key, n in true.items() if n >= 6)


def test_decrements_and_splits_lose_nothing(spark):
    rows = [(p, "s", 0, j, p % 20 * 10 + j if j < 10 else 1_000 + p * 30 + j) for p in range(200) for j in range(30)] + [(p, f"t{p % 3}", 0, j, j) for p in range(9) for j in range(5)]
    lines = spark.createDataFrame(rows, "page_id bigint, site string, block_idx int, line_idx int, k1 bigint").withColumn("k2", F.lit(0).cast("bigint")).repartition(5)
    want = rows_of(sl.confirmed(lines), "site", "k1", "pages")
    assert 0 < len(want) < 2_000
    for counters in (8, 64, 300):
        assert rows_of(sl.confirmed(lines, counters=counters), "site", "k1", "pages") == want
    # summaries of this size do leave lines out
    assert sl.candidates(lines, 6, 300).count() < lines.select("site", "k1").distinct().count()


def test_tiny_summaries_give_the_same(make_pages):
    df = make_pages(*({"page_id": i, "site": "s", "content_blocks": [items(LINE, f"another line {'abcdefghijkl'[i] * 9}")]} for i in range(12)))
    lines = sl.keyed_lines(df)
    assert sl.confirmed(lines, counters=4).count() == sl.confirmed(lines).count() == 1
