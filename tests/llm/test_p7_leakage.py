import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.llm import leakage as lk
from pagemill.llm.fm_index import FMIndex, suffix_order
from tests.conftest import rows_of


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60), st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=4), min_size=1, max_size=8), st.integers(1, 9))
def test_index_finds_all_occurrences(text, patterns, sample):
    whole = np.array([*text, 0])
    assert suffix_order(whole).tolist() == sorted(range(len(whole)), key=lambda i: whole[i:].tolist())
    index = FMIndex(np.array(text, dtype=np.int64), 5, sample)
    width = max(map(len, patterns))
    low, high = index.search(np.array([[0] * (width - len(p)) + p for p in patterns]), np.array([len(p) for p in patterns]))
    for p, a, b in zip(patterns, low, high, strict=True):
        assert sorted(index.locate(np.arange(a, b)).tolist()) == [i for i in range(len(text)) if text[i : i + len(p)] == p]


ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen"


def brute(docs, items):
    out = set()
    for i, t in items:
        w = lk.words(t)
        for k in range(max(1, len(w) - 11)) if w else ():
            phrase = " " + " ".join(w[k : k + 12]) + " "
            out |= {(d, i) for d, x in docs if phrase in " " + " ".join(lk.words(x)) + " "}
    return sorted(out, key=repr)


def test_cases(spark):
    docs = [(1, f"x {ITEM} y"), (2, ITEM.upper().replace(" ", ", ")), (3, " ".join(ITEM.split()[1:])), (4, " ".join(ITEM.split()[2:])), (5, None), (6, ""), (7, "very short item here"), (8, "short very item"), (9, (ITEM + " ") * 300), (10, "word " * 3000 + ITEM), (10, "word " * 3000 + ITEM)]
    items = [(1, ITEM), (2, "unrelated. " + ITEM + " end"), (3, None), (4, ""), (5, "Very SHORT item"), (6, "!!!"), (7, ITEM)]
    d = spark.createDataFrame([(*x, 1) for x in [*docs, (None, ITEM)]], "doc_id bigint, text string, item_id int")
    b = spark.createDataFrame([*items, (None, ITEM)], "item_id bigint, text string")
    want = brute(docs, items)
    assert rows_of(lk.found(d, b), "doc_id", "item_id") == want
    # small shards, and items in several blocks
    assert rows_of(lk.spans(d, b, shard=50, block=3).select("doc_id", "item_id").distinct(), "doc_id", "item_id") == want
    spans = {(r.doc_id, r.item_id): (r.word_begin, r.word_end) for r in lk.spans(d, b).collect()}
    assert spans[1, 1] == (1, 14) and spans[10, 1] == (3000, 3013) and spans[9, 1] == (0, 13) or spans[9, 1][1] > 0
    assert rows_of(lk.removal_spans(d, b).where("doc_id = 1"), "word_begin", "word_end") == [(1, 14)]
    assert lk.found(d.limit(0), b).count() == lk.found(d, b.limit(0)).count() == 0
