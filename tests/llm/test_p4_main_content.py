import itertools
import random

import numpy as np

from pagemill.llm import main_content as mc
from tests.conftest import block, heading, items, paragraph, rows_of


def brute(field, scores):
    best = max(itertools.product((0, 1), repeat=len(scores)), key=lambda y: field.first[y[0]] + sum(s for s, k in zip(scores, y, strict=True) if k) + sum(field.transitions[a, b] for a, b in zip(y, y[1:], strict=False)))
    return list(best)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    for _ in range(30):
        field = mc.Field(rng.normal(size=mc.DIMENSIONS), rng.normal(size=(2, 2)), rng.normal(size=2))
        pages = [[[int(x)] for x in rng.integers(0, mc.DIMENSIONS, rng.integers(1, 7))] for _ in range(4)]
        for page, found in zip(pages, field.decode(pages), strict=True):
            assert found.tolist() == brute(field, [field.weights[f[0]] for f in page])


def site_page(rng, page_id, site="www.brook-hill.example"):
    word = lambda: rng.choice("oven river garden stone winter paper cloud harbour".split())
    body = [paragraph(" ".join(f"The {word()} near the {word()} holds some {word()} and nobody knows why." for _ in range(3))) for _ in range(rng.randint(1, 4))]
    chrome_before = rng.sample([items("Home", "About us", "Contact", "Blog"), paragraph("Home › Blog › oven"), heading("Skip to main content", 6), paragraph("We use cookies to make Brook Hill work well for you. Choose what you allow.")], 2)
    chrome_after = [heading("Related articles", 4), items(f"A {word()} day", f"The {word()} book"), paragraph("© 2030 Brook Hill. All rights reserved"), block(type="form", purpose="newsletter")][: rng.randint(0, 4)]
    blocks = chrome_before + [heading(f"The {word()} of {word()}")] + body + [items("flour", "salt", "a warm oven")] + chrome_after
    truth = [1, 1, 0] + [0] * (len(body) + 1) + [1] * len(chrome_after)
    return {"page_id": page_id, "site": site, "content_blocks": blocks, "nav_links": [(t, "u", None, "header") for t in ("Home", "About us", "Contact", "Blog")] if page_id % 2 else None}, truth


def test_held_out_pages(make_pages):
    rng = random.Random(2)
    made = [site_page(rng, i, f"www.brook-hill-{i % 5}.example" if i % 3 else "www.brook-hill.example") for i in range(120)]
    df = make_pages(*(p for p, _ in made))
    found = set(rows_of(mc.labelled(df, mc.fit(df, 60)).where("label = 1"), "page_id", "block_idx"))
    want = {(p["page_id"], i) for p, y in made for i, v in enumerate(y) if v}
    hit = len(found & want)
    assert hit >= 0.97 * len(want) and hit >= 0.97 * len(found)


def test_odd_tables(make_pages):
    odd = [{"page_id": 1}, {"page_id": 2, "content_blocks": []}, {"page_id": 3, "site": None, "content_blocks": [block(), paragraph(None), paragraph(""), block(type="list", items=[None]), paragraph("x " * 50_000)]}]
    df = make_pages(*odd, odd[2])
    assert mc.labelled(df).where("page_id = 3").distinct().count() == 5
    assert mc.found(df.limit(0)).count() == 0
    assert mc.body(df).select("page_id", "block_idx").distinct().count() == mc.body(df).count()
