import random

from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.llm import near_duplicates as nd
from tests.conftest import block, heading, items, paragraph, rows_of

WORDS = [f"w{i}" for i in range(4_000)]


def runs(page):
    out = set()
    for b in page.get("content_blocks") or ():
        texts = [b["text"]] if b["type"] in ("heading", "paragraph", "quote") else b["items"] or () if b["type"] == "list" else ()
        for t in texts:
            w = nd._WORD.findall((t or "").lower())
            out |= set(zip(w, w[1:], w[2:], strict=False))
    return out


def brute(pages, least=100):
    sets = {p["page_id"]: r for p in pages if len(r := runs(p)) >= least}
    group = {k: k for k in sets}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in sets:
        for b in sets:
            if a < b:
                both = len(sets[a] & sets[b])
                if 10 * both >= 7 * (len(sets[a]) + len(sets[b]) - both):
                    group[max(root(a), root(b))] = min(root(a), root(b))
    return sorted((a, b) for a in sets for b in sets if a < b and root(a) == root(b))


def edited(rng, words, rate):
    return [rng.choice(WORDS) if rng.random() < rate else w for w in words]


def test_groups_match_brute_force(make_pages, monkeypatch):
    rng = random.Random(5)
    pages, page_id = [], 0
    for group in range(14):
        base = [rng.choice(WORDS) for _ in range(rng.choice([101, 102, 150, 400]))]
        for _ in range(rng.choice([1, 2, 5])):
            pages.append({"page_id": page_id, "site": f"s{group % 3}", "content_blocks": [heading("x y z"), paragraph(" ".join(edited(rng, base, rng.choice([0, 0.02, 0.05, 0.06]))))]})
            page_id += 1
    # a third of all rows copies one page, some with small edits
    hot = [rng.choice(WORDS) for _ in range(200)]
    for k in range(20):
        pages.append({"page_id": page_id + k, "content_blocks": [items("a b c", " ".join(hot if k % 2 else edited(rng, hot, 0.01)))]})
    pages += [pages[0], pages[-1], {"page_id": 900}, {"page_id": 901, "content_blocks": []}, {"page_id": 902, "content_blocks": [block(), paragraph(None), block(type="list", items=[None, ""])]}, {"page_id": 903, "content_blocks": [paragraph("short text only")]}]
    found = nd.found(make_pages(*pages))
    assert rows_of(found, "page_id_a", "page_id_b") == sorted(brute(pages), key=repr)
    placed = rows_of(nd.classes(make_pages(*pages)), "page_id", "class_id", "class_size")
    assert all(c <= p for p, c, _ in placed) and sum(k - 1 for *_, k in placed) == 2 * len(brute(pages))
    # more turns with hubs give the same
    monkeypatch.setattr(nd, "FEW", 0)
    assert sorted(placed) == sorted(rows_of(nd.classes(make_pages(*pages)), "page_id", "class_id", "class_size"))


def test_common_runs_are_counted_over_all_pages(spark):
    import numpy as np

    rows = [(i, nd.pack(np.unique(np.array([1, 2, 3 if i % 60 else 4, 1_000 + i, 5_000 + i % 40], np.uint64)))) for i in range(1_200)]
    pages = spark.createDataFrame(rows, "page_id bigint, runs binary").repartition(4)
    assert nd.common_runs(pages).tolist() == [1, 2, 3, *range(5_000, 5_040)]
    assert nd.common_runs(pages.limit(0)).tolist() == []


def test_empty_table_and_no_groups(make_pages):
    rng = random.Random(1)
    page = {"page_id": 1, "content_blocks": [paragraph(" ".join(rng.choice(WORDS) for _ in range(200)))]}
    assert nd.found(make_pages(page).limit(0)).count() == 0
    assert nd.found(make_pages(page, page)).count() == 0
    assert rows_of(nd.classes(make_pages(page, page)), "page_id", "class_id") == [(1, 1)]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**40 - 1), max_size=50, unique=True))
def test_sets_survive_packing(values):
    import numpy as np

    runs_ = np.array(sorted(values), np.uint64)
    assert nd.unpack(nd.pack(runs_)).tolist() == runs_.tolist()


def test_one_differing_position_keeps_one_variant():
    import numpy as np

    prints = np.arange(nd.SEGMENTS * nd.POSITIONS, dtype=np.uint64)[None] + np.uint64(7)
    for k in range(prints.size):
        other = prints.copy()
        other[0, k] += np.uint64(1)
        shared = (nd.variants(prints) == nd.variants(other)).reshape(nd.SEGMENTS, nd.POSITIONS)
        segment, place = divmod(k, nd.POSITIONS)
        assert shared[segment].tolist() == [p == place for p in range(nd.POSITIONS)]
        assert shared.sum() == (nd.SEGMENTS - 1) * nd.POSITIONS + 1
