"""Evaluation texts inside a training corpus, by an FM-index per shard of the corpus.

A shard's index holds its documents' words as symbols: a word of no item is a break, as no phrase can go over it. Every
phrase of an item (twelve consecutive words, or all its words if it has fewer) is searched backwards in all shards, its
occurrences are located, and the spans are merged per document.

Words are maximal runs of letters or digits in lower case. Defined results: null ids, null and empty texts and items
without words have no cases; repeated items are all reported; repeated documents each have their own; extra columns are ignored. Items
are taken in blocks, so that what is sent to the executors stays bounded at any number of items.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.fm_index import FMIndex
from pagemill.runtime import materialise

WORDS = 12
#: Words of a shard's index; a longer document is indexed in overlapping pieces.
SHARD = 400_000
#: Items, and characters of items, searched at once (about).
ITEM_BLOCK, ITEM_CHARS = 20_000, 20_000_000
WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """The words of a text."""
    return WORD.findall(text.lower()) if text else []


class Phrases:
    """The distinct phrases of a block of items, as symbols."""

    def __init__(self, items: list[tuple[int, str | None]], width: int = WORDS):
        self.width = width
        self.symbol: dict[str, int] = {}
        owners: dict[tuple[int, ...], set[int]] = {}
        for item, text in items:
            ids = [self.symbol.setdefault(w, len(self.symbol) + 2) for w in words(text)]
            if ids:
                for k in range(max(1, len(ids) - width + 1)):
                    owners.setdefault(tuple(ids[k : k + width]), set()).add(item)
        self.symbols = len(self.symbol) + 2
        phrases = list(owners)
        self.items = [sorted(owners[p]) for p in phrases]
        self.lengths = np.array([len(p) for p in phrases], dtype=np.int64)
        self.patterns = np.array([(0,) * (width - len(p)) + p for p in phrases], dtype=np.int64).reshape(len(phrases), width)
        self.shortest = int(self.lengths.min()) if len(phrases) else width


def _spans(texts: list[np.ndarray], docs: list[int], starts: list[int], phrases: Phrases) -> Iterator[tuple[int, int, int, int]]:
    """(document, item, first word, end) of all occurrences in one shard; ``starts`` has the word at which each text begins."""
    joined = np.concatenate([x for t in texts for x in (t, [1])])
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    # runs of item words that are too short for any phrase hold no case, and breaks need only one symbol
    breaks = np.flatnonzero(joined == 1)
    runs = np.diff(np.r_[-1, breaks]) - 1
    keep = np.repeat(runs >= phrases.shortest, runs + 1)
    kept = np.flatnonzero(keep)
    if not len(kept):
        return
    index = FMIndex(joined[kept], phrases.symbols)
    low, high = index.search(phrases.patterns, phrases.lengths)
    hit = np.flatnonzero(high > low)
    if not len(hit):
        return
    counts = (high - low)[hit]
    which = np.repeat(hit, counts)
    offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    at = kept[index.locate(low[which] + offset)]
    text = np.searchsorted(begins, at, side="right") - 1
    for phrase, t, p in zip(which.tolist(), text.tolist(), (at - begins[text]).tolist(), strict=True):
        for item in phrases.items[phrase]:
            yield docs[t], item, p + starts[t], p + starts[t] + int(phrases.lengths[phrase])


def _merged(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Overlapping or touching spans of the same document and item as one."""
    out: list[tuple[int, int, int, int]] = []
    for doc, item, begin, end in sorted(found):
        if out and out[-1][:2] == (doc, item) and begin <= out[-1][3]:
            out[-1] = (doc, item, out[-1][2], max(end, out[-1][3]))
        else:
            out.append((doc, item, begin, end))
    return out


def _search(batches: Iterator[pa.RecordBatch], phrases: Phrases, shard: int) -> Iterator[pa.RecordBatch]:
    texts: list[np.ndarray] = []
    docs: list[int] = []
    starts: list[int] = []
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        spans = _merged(list(_spans(texts, docs, starts, phrases))) if texts else []
        if spans:
            columns = [pa.array(c, t) for c, t in zip(zip(*spans, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "word_begin", "word_end"])
        texts.clear(), docs.clear(), starts.clear()

    get = phrases.symbol.get
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids = np.array([get(w, 1) for w in words(text)], dtype=np.int64)
            for begin in range(0, max(1, len(ids) - phrases.width + 1), shard):
                piece = ids[begin : begin + shard + phrases.width - 1]
                if len(piece) >= phrases.shortest:
                    texts.append(piece), docs.append(doc), starts.append(begin)
                    held += len(piece)
                if held >= shard:
                    yield from flush()
                    held = 0
    yield from flush()


def spans(documents: DataFrame, benchmark: DataFrame, width: int = WORDS, shard: int = SHARD, block: int = ITEM_BLOCK) -> DataFrame:
    """Merged spans of words that a document shares with an item: doc_id, item_id, word_begin, word_end."""
    spark = documents.sparkSession
    docs = documents.select("doc_id", "text").where("doc_id IS NOT NULL AND length(text) > 0")
    items = benchmark.select("item_id", "text").where("item_id IS NOT NULL AND length(text) > 0").distinct()
    # one block is collected at a time, drawn by a hash of whole rows, so that its rows and characters are bounded
    total, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    number = max(-(-total // block), -(-chars // ITEM_CHARS))
    if number > 1:
        items = materialise(items, "items")
    parts = [items if number == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(number)) == b) for b in range(number)]
    out = None
    for part in parts:
        phrases = Phrases([tuple(r) for r in part.collect()], width)
        if len(phrases.items):
            shared = spark.sparkContext.broadcast(phrases)
            one = docs.mapInArrow(lambda b, shared=shared: _search(b, shared.value, shard), "doc_id bigint, item_id bigint, word_begin bigint, word_end bigint")
            out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], "doc_id bigint, item_id bigint, word_begin bigint, word_end bigint")


def found(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Each document and item it holds a phrase of: doc_id, item_id."""
    return spans(documents, benchmark).select("doc_id", "item_id").distinct()


def removal_spans(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """What to cut out of each document: doc_id, word_begin, word_end, the spans of all items merged."""
    from pyspark.sql import Window

    order = Window.partitionBy("doc_id").orderBy("word_begin", "word_end")
    reach = F.max("word_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans(documents, benchmark).withColumn("new", (reach.isNull() | (F.col("word_begin") > reach)).cast("int"))
    numbered = marked.withColumn("span", F.sum("new").over(order))
    return numbered.groupBy("doc_id", "span").agg(F.min("word_begin").alias("word_begin"), F.max("word_end").alias("word_end")).drop("span")


_HITS_SQL = r"""
WITH i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark WHERE text IS NOT NULL),
s AS (SELECT item_id, w, least(12, len(w)) AS n FROM i WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, n, w[k : k + n - 1] AS gram FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS k FROM s)),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, n, k, w[k : k + n - 1] AS gram FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM g))),
m AS (SELECT DISTINCT doc_id, item_id, k - 1 AS b, k - 1 + n AS e FROM h JOIN g USING (n, gram))
"""
FOUND_SQL = _HITS_SQL + "SELECT DISTINCT doc_id, item_id FROM m"
_MERGED_SQL = """
, x AS (SELECT *, max(e) OVER (PARTITION BY {key} ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM m),
y AS (SELECT *, sum(CASE WHEN reach IS NULL OR b > reach THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS span FROM x)
SELECT {key}, min(b)::BIGINT AS word_begin, max(e)::BIGINT AS word_end FROM y GROUP BY {key}, span
"""
SPANS_SQL = _HITS_SQL + _MERGED_SQL.format(key="doc_id, item_id")
REMOVAL_SQL = _HITS_SQL + _MERGED_SQL.format(key="doc_id")
