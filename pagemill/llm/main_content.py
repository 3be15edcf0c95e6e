"""Main content of pages, by a linear-chain conditional random field over the leaf blocks of their documents.

A page is the chain of its leaves in document order: its navigation, its content blocks, its footer. Each leaf is described
by features of its ancestor tags, text, type, place, neighbours and likeness to the page's navigation and footer; the
field scores labels (body or surroundings) with their transitions, and Viterbi decodes a page as a whole.

The field is trained by gradients of forward-backward expectations on labelled pages: at first the hand-labelled ones of
``labelled_pages``, then also a bounded sample of the table (``TRAIN_PAGES``), whose labels come from the ancestors of its leaves
(what stands in a ``nav`` or ``footer`` is surroundings, and so is a content block with the text of some page's footer) and else from
the field of the round before: a text that several pages hold gets the label of most of them, another one counts as surroundings
only if the field is sure (``SURE``). No rule of wording labels or decodes a page. Decoding covers every page and whole texts.

The fitted field is kept for the session, so that several queries on one table fit it once; ``save`` and ``load`` keep it longer.

Defined results: pages without blocks have no rows; null texts and items are empty; null sites have no name to compare;
redelivered rows count once; a table too small to train on still has the hand-labelled pages; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm import labelled_pages

#: Most pages of the table's sample that the field is fitted on (those of the smallest hashes of page_id), and hand-labelled ones.
TRAIN_PAGES, HAND_PAGES = 2_000, 2_000
DIMENSIONS = 1 << 16
EPOCHS, RATE, PENALTY = 20, 0.12, 2e-6
#: How sure the field must be of a text that few pages hold, and rounds of labelling the sample.
SURE, ROUNDS = 0.7, 1
#: A label of navigation that this share of all sites use, but three at least, is known for all sites; so there are at most a site's labels over the share.
KNOWN_SHARE = 0.001
_WORD = re.compile(r"[^\W_]+|[©›]")
_PARTS = re.compile(r"\s*[|·•/›»>]\s*")
_DATE = re.compile(r"\W*\d{1,4}[./-]\d{1,2}[./-]\d{2,4}\W*$")
_HOST_PARTS = {"www", "shop", "docs", "blog", "example", "com", "org", "net"}
COLUMNS = ["page_id", "site", "types", "levels", "texts", "items", "purposes", "nav", "footer_texts", "footer_items"]
#: The tags that end the path to a leaf of each type.
TAGS = {"paragraph": "p", "list": "ul>li", "form": "form", "quote": "blockquote", "code": "pre", "image": "figure>img", "table": "table", "definitionlist": "dl", "embed": "iframe", "media": "video"}


def host_words(site: str | None) -> frozenset[str]:
    """The words of a site's name, from its host."""
    return frozenset(w for w in re.split(r"[.\-]", (site or "").lower()) if len(w) > 2 and w not in _HOST_PARTS)


def letters(text: str) -> str:
    """A text's letters alone, in lower case."""
    return "".join(c for c in text.lower() if c.isalpha())


class Block:
    """What features need of one leaf."""

    __slots__ = ("kind", "level", "text", "items", "purpose", "words", "n", "key", "nav", "lexicon", "footer", "parts", "tags")

    def __init__(self, kind, level, text, items, purpose, hosts, own, lexicon, footer, root="main"):
        """``root`` is the region that the leaf stands in: nav, main or footer."""
        self.kind, self.level, self.purpose = kind or "", level or 0, purpose or ""
        self.tags = f"{root}>{f'h{self.level}' if self.kind == 'heading' else TAGS.get(self.kind, self.kind)}"
        self.text = text or ""
        self.items = [i for i in items or () if i]
        whole = self.text or " | ".join(self.items)
        found = _WORD.findall(whole.lower())
        self.n = len(found)
        words: list[str] = []
        for w in found:
            w = "H" if w in hosts else "#" if w.isdigit() else w
            if w != "H" or not words or words[-1] != "H":
                words.append(w)
        self.words = words
        self.key = " ".join(words)
        self.parts = self.items or (_PARTS.split(self.text.strip()) if self.kind == "paragraph" else [])
        self.nav = self.lexicon = 0.0
        if len(self.parts) > 1 or self.items:
            flat = [letters(p) for p in self.parts]
            self.nav = sum(p in own for p in flat) / len(flat)
            self.lexicon = sum(p in lexicon or letters(q.rpartition(" ")[0]) in lexicon for p, q in zip(flat, self.parts, strict=True)) / len(flat)
        self.footer = bool(self.text) and letters(self.text) in footer


def chain(row: tuple, lexicon: frozenset[str]) -> tuple[list[Block], int, int]:
    """The leaves of one page, and where its content blocks begin and end among them; ``row`` has the values of ``COLUMNS`` but page_id."""
    site, types, levels, texts, items, purposes, nav, footer_texts, footer_items = row
    hosts = host_words(site)
    own = {letters(x) for x in nav or () if x} | {letters(x) for xs in footer_items or () for x in xs or () if x}
    footer = {letters(x) for x in footer_texts or () if x}
    own.discard("")
    leaves = [Block("list", 0, None, nav, None, hosts, own, lexicon, frozenset(), "nav")] if nav else []
    begin = len(leaves)
    leaves += [Block(*b, hosts, own, lexicon, footer) for b in zip(types or (), levels or (), texts or (), items or (), purposes or (), strict=True)]
    end = len(leaves)
    leaves += [Block("list" if i else "paragraph", 0, t, i, None, hosts, own, lexicon, footer, "footer") for t, i in zip(footer_texts or (), footer_items or (), strict=True)]
    return leaves, begin, end


_codes: dict[str, int] = {}


def _code(feature: str) -> int:
    at = _codes.get(feature)
    if at is None:
        if len(_codes) > 400_000:
            _codes.clear()
        at = _codes[feature] = zlib.crc32(feature.encode()) & (DIMENSIONS - 1)
    return at


def _size(n: int) -> int:
    return n if n < 4 else 4 if n < 6 else 5 if n < 10 else 6 if n < 17 else 7 if n < 26 else 8 if n <= 40 else 9


def features(blocks: list[Block]) -> list[list[int]]:
    """Hashed features of each block."""
    out = []
    last = len(blocks) - 1
    opened = False
    heads = ["^" if k < 0 else "$" if k > last else blocks[k].kind + ":" + " ".join(blocks[k].words[:4]) if blocks[k].n <= 8 and blocks[k].kind == "heading" else blocks[k].kind for k in range(-1, last + 2)]
    for i, b in enumerate(blocks):
        kind = b.kind[:2]
        f = ["1", f"t{kind}", f"n{kind}{_size(b.n)}", f"<{heads[i]}", f"<{kind}{heads[i]}", f">{heads[i + 2]}", f"p{min(i, 3)}", f"q{min(last - i, 4)}", f"o{kind}{opened}", f"@{b.tags}"]
        if b.kind == "form":
            f.append(f"u{b.purpose}")
        if b.n:
            w = b.words
            f += [f"w{x}" for x in set(w)]
            f += [f"b{kind}{x} {y}" for x, y in zip(w, w[1:], strict=False)] if b.n <= 28 else []
            f += [f"s{kind}{w[0]}", f"k{kind}{' '.join(w[:2])}"]
            if "H" in w:
                f.append(f"H{kind}")
            if w[0] == "H":
                f.append("H0" + kind + (":" if ":" in b.text[:45] else ""))
        if b.text:
            end = b.text.rstrip()[-1:]
            f.append(f"e{kind}" + (end if not end.isalnum() else "9" if end.isdigit() else "a") + str(_size(b.n)))
            f += [f"c{kind}{c}" for c in "©›|·/[" if c in b.text]
            if b.footer:
                f.append("foot")
            if b.n <= 6:
                capital = re.findall(r"[^\W\d_]+", b.text)
                if capital and all(x[0].isupper() and x[1:].islower() for x in capital):
                    f.append(f"C{kind}{len(capital)}{end in '.!?:'}")
                if _DATE.match(b.text):
                    f.append("date")
            if "\n" in b.text.strip():
                f.append("lines")
        if b.level:
            f.append(f"l{b.level}")
        if len(b.parts) > 1 or b.items:
            f += [f"v{kind}{int(b.nav * 4)}", f"x{kind}{int(b.lexicon * 4)}", f"m{kind}{_size(len(b.parts))}", f"a{kind}{_size(b.n // max(1, len(b.parts)))}"]
        opened = opened or b.kind == "heading" and b.level == 1
        out.append([_code(x) for x in f])
    return out


def _lattice(both: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward scores of each place and label, and each page's total, in logarithms."""
    n, width, _ = both.shape
    forward, backward = np.empty((n, width, 2)), np.zeros((n, width, 2))
    forward[:, 0] = first + both[:, 0]
    for t in range(1, width):
        forward[:, t] = np.logaddexp(forward[:, t - 1, :1] + transitions[0], forward[:, t - 1, 1:] + transitions[1]) + both[:, t]
    for t in range(width - 2, -1, -1):
        ahead = both[:, t + 1] + backward[:, t + 1]
        b = np.logaddexp(transitions[:, 0] + ahead[:, :1], transitions[:, 1] + ahead[:, 1:])
        backward[:, t] = np.where((t + 1 < lengths)[:, None], b, 0)
    return forward, backward, np.logaddexp(*np.moveaxis(forward[np.arange(n), lengths - 1], 1, 0))


class Field:
    """Weights of features for surroundings, of transitions and of the first label."""

    def __init__(self, weights: np.ndarray, transitions: np.ndarray, first: np.ndarray):
        self.weights, self.transitions, self.first = weights, transitions, first

    def emissions(self, pages: list[list[list[int]]]) -> np.ndarray:
        """Scores of surroundings over body: pages by blocks, 0 where a page has ended."""
        flat = [f for page in pages for f in page]
        out = np.zeros((len(pages), max(map(len, pages), default=0)))
        if flat:
            sizes = np.array([len(f) for f in flat])
            values = np.add.reduceat(self.weights[np.fromiter((x for f in flat for x in f), np.int64)], np.r_[0, np.cumsum(sizes)[:-1]])
            rows = np.repeat(np.arange(len(pages)), [len(p) for p in pages])
            out[rows, _within(pages)] = values
        return out

    def decode(self, pages: list[list[list[int]]]) -> list[np.ndarray]:
        """The best labels of each page, by Viterbi."""
        scores = self.emissions(pages)
        lengths = np.array([len(p) for p in pages])
        n, width = scores.shape
        if not width:
            return [np.empty(0, np.int64) for _ in pages]
        best = np.stack([np.full(n, self.first[0]), self.first[1] + scores[:, 0]], axis=1)
        back = np.zeros((width, n, 2), np.int8)
        for t in range(1, width):
            step = best[:, :, None] + self.transitions[None]
            back[t] = step.argmax(axis=1)
            moved = step.max(axis=1)
            moved[:, 1] += scores[:, t]
            best = np.where((lengths > t)[:, None], moved, best)
        labels = np.zeros((n, width), np.int64)
        at = best.argmax(axis=1)
        for t in range(width - 1, -1, -1):
            labels[:, t] = at
            if t:
                at = np.where(lengths > t, back[t][np.arange(n), at], at)
        return [labels[i, :k] for i, k in enumerate(lengths)]

    def marginals(self, pages: list[list[list[int]]]) -> list[np.ndarray]:
        """How likely each leaf of some pages (none without leaves) is surroundings."""
        if not pages:
            return []
        scores, lengths = self.emissions(pages), np.array([len(p) for p in pages])
        forward, backward, total = _lattice(np.stack([np.zeros_like(scores), scores], axis=2), lengths, self.transitions, self.first)
        p = np.exp(np.minimum(forward + backward - total[:, None, None], 0))[:, :, 1]
        return [p[i, :k] for i, k in enumerate(lengths)]


def _within(pages: list[list]) -> np.ndarray:
    return np.concatenate([np.arange(len(p)) for p in pages]) if pages else np.empty(0, np.int64)


def train(pages: list[list[list[int]]], labels: list[list[int]], epochs: int = EPOCHS, rate: float = RATE) -> Field:
    """The field that maximises the likelihood of the labels, by adaptive gradient steps on forward-backward expectations."""
    field = Field(np.zeros(DIMENSIONS), np.zeros((2, 2)), np.zeros(2))
    pairs = [(p, y) for p, y in zip(pages, labels, strict=True) if p]
    if not pairs:
        return field
    # pages of like length share a batch, so that little is padding
    pairs.sort(key=lambda x: len(x[0]))
    batches = []
    for begin in range(0, len(pairs), 250):
        some = [p for p, _ in pairs[begin : begin + 250]]
        flat = [f for p in some for f in p]
        y = np.zeros((len(some), max(map(len, some))), np.int64)
        rows, columns = np.repeat(np.arange(len(some)), [len(p) for p in some]), _within(some)
        y[rows, columns] = [v for _, ys in pairs[begin : begin + 250] for v in ys]
        ids = np.fromiter((x for f in flat for x in f), np.int64)
        owner = np.repeat(np.arange(len(flat)), [len(f) for f in flat])
        batches.append((ids, owner, rows, columns, y, np.array([len(p) for p in some])))
    moments = [np.zeros(DIMENSIONS), np.zeros((2, 2)), np.zeros(2)]
    order = np.random.default_rng(3)
    for epoch in range(epochs):
        for k in order.permutation(len(batches)):
            ids, owner, rows, columns, y, lengths = batches[k]
            n, width = y.shape
            e = np.zeros((n, width))
            e[rows, columns] = np.bincount(owner, field.weights[ids], len(rows))
            both = np.stack([np.zeros_like(e), e], axis=2)
            forward, backward, total = _lattice(both, lengths, field.transitions, field.first)
            p = np.exp(forward + backward - total[:, None, None])
            live = np.arange(width)[None] < lengths[:, None]
            step = np.zeros((2, 2))
            for t in range(1, width):
                on = live[:, t]
                if not on.any():
                    break
                joint = np.exp(forward[on, t - 1, :, None] + field.transitions[None] + (both[on, t] + backward[on, t])[:, None] - total[on, None, None])
                step -= joint.sum(axis=0)
                np.add.at(step, (y[on, t - 1], y[on, t]), 1)
            gap = (y - p[:, :, 1])[rows, columns]
            start = np.bincount(y[:, 0], minlength=2) - p[:, 0].sum(axis=0)
            gradients = [np.bincount(ids, gap[owner], DIMENSIONS) / len(rows) - PENALTY * field.weights, step / len(rows), start / len(rows)]
            for value, g, m in zip((field.weights, field.transitions, field.first), gradients, moments, strict=True):
                m *= 0.995
                m += g * g
                value += rate * g / (np.sqrt(m) + 1e-6) * (1 - 0.8 * epoch / epochs)
    return field


def _columns(page_data: DataFrame) -> DataFrame:
    c = F.col
    return page_data.select(
        "page_id", "site", c("content_blocks.type").alias("types"), c("content_blocks.level").alias("levels"), c("content_blocks.text").alias("texts"), c("content_blocks.items").alias("items"),
        c("content_blocks.purpose").alias("purposes"), c("nav_links.text").alias("nav"), c("footer_blocks.text").alias("footer_texts"), c("footer_blocks.items").alias("footer_items"),
    )


def sample(page_data: DataFrame, most: int = TRAIN_PAGES) -> list[tuple]:
    """At most ``most`` pages with blocks, those of the smallest hashes of page_id; only their ids are sorted, their rows are read after."""
    pages = page_data.where(F.size("content_blocks") > 0)
    ids = [r[0] for r in page_data.select("page_id").where("page_id IS NOT NULL").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(most).collect()]
    chosen = page_data.sparkSession.createDataFrame([(i,) for i in ids], "page_id bigint")
    rows = {r[0]: tuple(r) for r in _columns(pages).join(F.broadcast(chosen), "page_id", "left_semi").collect()}
    return [rows[i] for i in sorted(rows)]


def lexicon_of(page_data: DataFrame, share: float = KNOWN_SHARE) -> frozenset[str]:
    """Labels of navigation and of footer lists, as letters, that at least ``share`` of all sites (and three) use; all pages count."""
    texts = F.flatten(F.filter(F.array(F.col("nav_links.text"), F.flatten(F.filter("footer_blocks.items", lambda x: x.isNotNull()))), lambda x: x.isNotNull()))
    used = page_data.where("site IS NOT NULL").select("site", F.explode(texts).alias("label")).select("site", F.regexp_replace(F.lower("label"), r"[^\p{L}]", "").alias("label")).where("label <> ''").distinct()
    sites = page_data.select("site").distinct().count()
    counts = used.groupBy("label").agg(F.count("*").alias("k")).where(F.col("k") >= max(3, share * sites))
    return frozenset(r[0] for r in counts.select("label").collect())


def hand_labelled(number: int, lexicon: frozenset[str]) -> tuple[list[list[list[int]]], list[list[int]]]:
    """Features and labels of the hand-labelled pages."""
    known = lexicon | {letters(x) for v in labelled_pages.NAVIGATION.values() for x in v}
    pages, labels = [], []
    for blocks, y, nav, footer in labelled_pages.pages(number):
        leaves, begin, end = chain((labelled_pages.SITE, *(list(c) for c in zip(*blocks, strict=True)), nav, footer, [None] * len(footer)), known)
        pages.append(features(leaves))
        labels.append([1] * begin + y + [1] * (len(leaves) - end))
    return pages, labels


def relabelled(field: Field, chains: list[tuple[list[Block], int, int]], pages: list[list[list[int]]], sure: float = SURE) -> list[list[int]]:
    """Labels of the leaves of sampled pages: by their ancestors, by footers' texts, by what most pages with a text say, else by what the field is sure of."""
    footers = {b.key for leaves, _, end in chains for b in leaves[end:] if b.n > 1}
    order = [k for k in sorted(range(len(pages)), key=lambda k: len(pages[k])) if pages[k]]
    likely: dict[int, np.ndarray] = {}
    for at in range(0, len(order), 100):
        likely.update(zip(order[at : at + 100], field.marginals([pages[k] for k in order[at : at + 100]]), strict=True))
    votes: dict[tuple[str, str], list[float]] = {}
    for k in order:
        leaves, begin, end = chains[k]
        for b, p in zip(leaves[begin:end], likely[k][begin:end].tolist(), strict=True):
            if b.n:
                votes.setdefault((b.kind, b.key), []).append(p)
    out = []
    for k, (leaves, begin, end) in enumerate(chains):
        labels = [1] * len(leaves)
        for i in range(begin, end):
            b = leaves[i]
            vote = votes.get((b.kind, b.key), ())
            labels[i] = int(b.key in footers or (sum(vote) * 2 > len(vote) if len(vote) > 2 else likely[k][i] > sure))
        out.append(labels)
    return out


Model = tuple[Field, frozenset[str]]
_fitted: dict[tuple, Model] = {}


def fit(page_data: DataFrame, most: int = TRAIN_PAGES, hand: int = HAND_PAGES, rounds: int = ROUNDS) -> Model:
    """A field trained on the labelled pages, and the labels of navigation that many sites use."""
    key = (id(page_data.sparkSession), page_data.semanticHash(), tuple(sorted(page_data.inputFiles())), most, hand, rounds)
    if key not in _fitted:
        lexicon = lexicon_of(page_data)
        pages, labels = hand_labelled(hand, lexicon)
        field = train(pages, labels)
        chains = [chain(r[1:], lexicon) for r in sample(page_data, most)]
        own = [features(leaves) for leaves, _, _ in chains]
        for _ in range(rounds if own else 0):
            field = train(pages + own, labels + relabelled(field, chains, own))
        _fitted.clear()
        _fitted[key] = field, lexicon
    return _fitted[key]


def save(model: Model, path: str) -> None:
    """Writes a fitted field as JSON; of the weights, those that aren't 0."""
    field, lexicon = model
    at = np.flatnonzero(field.weights)
    with open(path, "w") as f:
        json.dump({"at": at.tolist(), "weights": field.weights[at].tolist(), "transitions": field.transitions.tolist(), "first": field.first.tolist(), "lexicon": sorted(lexicon)}, f)


def load(path: str) -> Model:
    """The model of ``save``."""
    with open(path) as f:
        found = json.load(f)
    weights = np.zeros(DIMENSIONS)
    weights[found["at"]] = found["weights"]
    return Field(weights, np.array(found["transitions"]), np.array(found["first"])), frozenset(found["lexicon"])


def _decode(batches: Iterator[pa.RecordBatch], field: Field, lexicon: frozenset[str]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 400):
            batch = whole.slice(at, 400)
            columns = [c.to_pylist() for c in batch.columns]
            order = sorted((i for i in range(batch.num_rows) if columns[2][i]), key=lambda i: len(columns[2][i]))
            pages: list[int] = []
            index: list[int] = []
            labels: list[int] = []
            for begin in range(0, len(order), 100):
                some = order[begin : begin + 100]
                chains = [chain(tuple(c[i] for c in columns[1:]), lexicon) for i in some]
                for i, (_, first, last), y in zip(some, chains, field.decode([features(c[0]) for c in chains]), strict=True):
                    pages += [columns[0][i]] * (last - first)
                    index += range(last - first)
                    labels += y[first:last].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(pages, pa.int64()), pa.array(index, pa.int32()), pa.array(labels, pa.int32())], names=["page_id", "block_idx", "label"])


def labelled(page_data: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, block_idx and label (1 for surroundings) of every block, by a model or else by the one fitted on the table."""
    known = page_data.sparkSession.sparkContext.broadcast(model or fit(page_data))
    return _columns(page_data).mapInArrow(lambda b: _decode(b, *known.value), "page_id bigint, block_idx int, label int")


def found(page_data: DataFrame, model: Model | None = None) -> DataFrame:
    """Blocks that belong to the surroundings: page_id, block_idx."""
    return labelled(page_data, model).where("label = 1").select("page_id", "block_idx").distinct()


def body(page_data: DataFrame, model: Model | None = None) -> DataFrame:
    """Blocks of the main content: page_id, block_idx, type, text (of lists, the items by lines)."""
    kept = labelled(page_data, model).where("label = 0").select("page_id", "block_idx").distinct()
    texts = page_data.select("page_id", F.posexplode(F.arrays_zip(*(F.col(f"content_blocks.{c}").alias(c) for c in ("type", "text", "items")))).alias("block_idx", "b")).dropDuplicates(["page_id", "block_idx"])
    return kept.join(texts, ["page_id", "block_idx"]).select("page_id", "block_idx", F.col("b.type").alias("type"), F.coalesce("b.text", F.array_join("b.items", "\n")).alias("text"))
