import numpy as np

from pagemill.llm import residue as rs
from tests.conftest import block, heading, items, paragraph, rows_of

PROSE = "The harbour master keeps a list of every boat that came in before the storm, and most of the skippers sign it without a word. When the wind turns, the old crane by the pier starts to groan, and nobody in the street sleeps well until the morning."


def test_cases(make_pages):
    pages = {
        1: {"title": "404", "content_blocks": [heading("404"), paragraph("Sorry, the page you are looking for has moved or no longer exists.")]},
        2: {"title": "Shop", "content_blocks": [heading("Shop"), paragraph("PLEASE turn on  JavaScript in your browser to view this site")]},
        3: {"title": "Hello {{ page.name }}", "content_blocks": [paragraph(PROSE)]},
        4: {"title": "A", "content_blocks": [paragraph(PROSE), block(type="table", headers=["%%PRICE%%"], rows=[["1"]])]},
        5: {"title": "A", "content_blocks": [paragraph("Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua."), items("Item one", "Text")]},
        6: {"title": "Why a 404 page needs care", "content_blocks": [paragraph(PROSE * 2), paragraph("Sorry, the page you are looking for has moved or no longer exists.")]},
        7: {"title": "Templates", "content_blocks": [paragraph(PROSE), paragraph("Write {{ user.name }} in the template and the builder of the site puts the name there when the page is made."), block(type="code", text="{{ user.name }} ${x}")]},
        8: {"title": "No title", "content_blocks": [paragraph("Short but real.")]}, 9: {"title": None}, 10: {"title": "", "content_blocks": []}, 11: {"title": "How templates use {{ }} signs", "content_blocks": [paragraph(PROSE)]},
        12: {"title": "A", "content_blocks": [block(), paragraph(None), block(type="list", items=[None, ""]), paragraph("1.2.2027"), paragraph(PROSE)]},
        13: {"title": "A", "content_blocks": [block(type="code", text="Traceback: a.b failed\n at a/x9:12")]},
    }
    df = make_pages(*({"page_id": k} | v for k, v in pages.items()), {"page_id": 1} | pages[1])
    assert [r[0] for r in rows_of(rs.found(df), "page_id")] == sorted([1, 2, 3, 4, 5, 13], key=lambda x: repr((x,)))
    assert rs.found(df.limit(0)).count() == 0


def test_placeholders():
    good = ["{{ a.b }}", "{{name}}", "{% block x %}", "<%= x %>", "${a.b}", "#{a}", "%%X%%", "@@x@@", "[[a-b]]", "__A_B__", "see {name} here", "<insert name here>", "&lt;?= $x ?&gt;", "[Your Name Here]", "[Company Name]"]
    bad = ["{{ }}", "[OK] [No, thanks]", "[Updated] paid $ 9 (100 %)", "a_b __init__", "x@y.example", "{ }", "50 % off", "[1]"]
    assert [bool(rs.SLOT.search(t)) for t in good] == [True] * len(good)
    assert [bool(rs.SLOT.search(t)) for t in bad] == [False] * len(bad)


def test_buckets_find_what_brute_force_finds():
    rng = np.random.default_rng(4)
    known = rng.integers(0, 2**63, 40).astype(np.uint64)
    index = rs.Reached([(i, "error", p, "t", 1.0) for i, p in enumerate(known.view(np.int64).tolist())])
    near = known.copy()
    for k in range(len(near)):
        for bit in rng.choice(64, 4, replace=False):
            near[k] ^= np.uint64(1) << np.uint64(bit)
    found = index.candidates(near)
    assert sum(k in found.get(k, {}) for k in range(40)) >= 38
    assert all(d == int(np.bitwise_count(near[i] ^ known[j])) <= rs.HAMMING for i, js in found.items() for j, d in js.items())


def test_spreading_reaches_variants_but_not_prose(spark, make_pages):
    texts = [f"Exception in page{k}x{k}/row{k}a: {a} of {b} is not defined (line {k})" for k, (a, b) in enumerate([("slug", "name"), ("title", "row")] * 4)] + [PROSE]
    own = rs.units(make_pages(*({"page_id": i, "content_blocks": [paragraph(t)]} for i, t in enumerate(texts))))
    kinds = dict(rows_of(own.join(rs.labels(own), "h"), "page_id", "label"))
    assert kinds == dict.fromkeys(range(8), "error")
    corpus = own.select("h", "print", "text").dropDuplicates(["h"])
    found = rs.links(corpus, rs.seeds(corpus))
    reached = {h for h, *_ in rows_of(found, "h", "by", "label")}
    # every link leads to a trusted unit or to a reached one
    assert {by for _, by, _ in rows_of(found, "h", "by", "label")} <= reached | {r[0] for r in rows_of(rs.seeds(corpus), "h")}


def variants(number, changed, opening, rng):
    """A filler text with some words replaced."""
    words = "dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua".split()
    for _ in range(number):
        text = words.copy()
        for at in rng.choice(len(words), changed, replace=False):
            text[at] = "".join(rng.choice(list("bcdfghklmnprstaeiou"), 7))
        yield opening + " ".join(text)


def test_every_labelled_unit_of_a_bucket_is_compared(spark, make_pages, monkeypatch):
    rng = np.random.default_rng(8)
    known, others = list(variants(8_000, 5, "lorem ipsum ", rng)), list(variants(600, 7, "", rng))
    own = rs.units(make_pages(*({"page_id": i, "content_blocks": [paragraph(t)]} for i, t in enumerate(known + others))))
    rows = [(rs._hash(t), "filler", p, t, 1.0) for t, p in zip(known + others, rs.simhashes([t.split() for t in known + others]).view(np.int64).tolist(), strict=True)]
    # all pairs that verify, closed by chains from the trusted units while trust lasts
    start = len(rs.trusted()) + len(known)
    rows = rs.trusted() + rows
    grams = {r[0]: rs.gram_counts(r[3]) for r in rows}
    prints = np.array([r[2] for r in rows], np.int64).view(np.uint64)
    have, new, trust = rows[:start], np.arange(start), dict.fromkeys(range(start), 1.0)
    open_ = np.arange(start, len(rows))
    while len(new):
        hit = {}
        apart = np.bitwise_count(prints[open_][:, None] ^ prints[new][None, :])
        for i, row in zip(open_.tolist(), apart, strict=True):
            for j in sorted(new[row <= rs.HAMMING].tolist(), key=lambda j: (np.bitwise_count(prints[i] ^ prints[j]), -trust[j], rows[j][1], rows[j][0])):
                a, b = grams[rows[i][0]], grams[rows[j][0]]
                alike = rs.cosine(a, b, rs.norm(a), rs.norm(b))
                if alike >= rs.needed(min(a.total(), b.total())) and alike * trust[j] >= rs.TRUST:
                    hit[i] = alike * trust[j]
                    break
        have, trust = have + [rows[i] for i in hit], trust | hit
        new, open_ = np.array(list(hit), np.int64), np.array([i for i in open_.tolist() if i not in hit], np.int64)
    want = sorted((r[0],) for r in have[len(rs.trusted()) :])
    assert len(known) < len(want) < len(known) + len(others)
    assert sorted(rows_of(rs.labels(own).join(own, "h", "left_semi"), "h")) == want
    monkeypatch.setattr(rs, "BLOCK_UNITS", 2_000)  # more blocks, the same labels
    assert sorted(rows_of(rs.labels(own).join(own, "h", "left_semi"), "h")) == want


def test_long_texts_spread_and_options_are_searched(spark, make_pages):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("bcdfghklmnprstaeiou"), 6)) for _ in range(300)]
    long = "Lorem ipsum " + " ".join(words)
    like = " ".join(words[:140] + ["harbour"] + words[141:])
    assert len(long) > 1_024
    form = {"content_blocks": [paragraph(PROSE), block(type="form", fields=[("select", "n", "Size", "", True, ["S", None, "{{ size.large }}"]), None, ("text", "m", "M", "", False, None)])]}
    plain = {"content_blocks": [paragraph(PROSE), block(type="form", fields=[("select", "n", "Size", "", True, ["S", "L"])])]}
    df = make_pages({"page_id": 1, "content_blocks": [paragraph(long)]}, {"page_id": 2, "content_blocks": [paragraph(like)]}, {"page_id": 3} | form, {"page_id": 4} | plain)
    assert rows_of(rs.found(df), "page_id") == [(1,), (2,), (3,)]


def test_buckets_find_every_pair_within_the_distance():
    rng = np.random.default_rng(6)
    known = rng.integers(0, 2**63, 300).astype(np.uint64)
    near = known.copy()
    for k in range(len(near)):
        for bit in rng.choice(64, rs.HAMMING, replace=False):
            near[k] ^= np.uint64(1) << np.uint64(bit)
    found = rs.Reached([(i, "error", p, "t", 1.0) for i, p in enumerate(known.view(np.int64).tolist())]).candidates(near)
    apart = np.bitwise_count(near[:, None] ^ known[None, :])
    assert {(i, j) for i, js in found.items() for j in js} == set(zip(*(x.tolist() for x in np.nonzero(apart <= rs.HAMMING)), strict=True))
