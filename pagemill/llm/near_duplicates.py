"""Near-duplicate pages, by signatures with one wildcard.

A page is the set of its runs of three words. Its fingerprint has one position per min-hash function; it is cut into
segments so short that, of two pages at the threshold, one segment almost surely differs in at most one position. Each
segment is indexed once per position with that position as a wildcard, so that two segments differ in at most one
position exactly if they share a variant; pages meet by an equality join on variants and are verified on their whole sets.

In a bucket, pages are first compared with one hub only; links become components, and only pages of a bucket that are
still in different components are compared further, in turns with twice as many hubs each. So a group of any size costs pairs
in proportion to its size, and no pair of one bucket is left undecided; a bucket of pages that are all unlike is compared as a whole in the end.

Runs that many pages share (counted over all pages) don't enter the fingerprint unless they make up much of a page; verification
is always on all runs. Exact copies are one row until the end.

Two pages at the threshold share a variant with probability 1 - 6e-6 by their whole sets. If one page is indexed by its uncommon
runs only, a pair is met by these alone: in the worst case (similarity 0.7, one page inside the other, 40 % of the larger one
common, so that the rest is alike by 0.5) with probability 0.964.

Defined results: null blocks, texts and items have no runs; pages below the least number of runs take no part; redelivered
rows count once; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.operators.components import components
from pagemill.runtime import broadcast_if_small, materialise

LEAST_RUNS = 100
SIMILARITY = (7, 10)
SEGMENTS, POSITIONS = 16, 5
#: The share of all pages that makes a run common.
COMMON = 0.02
#: Distinct runs that a task counts before it leaves out those that can't be common in what it has read.
COUNTED = 2_000_000
#: A page of which less than this share of runs is uncommon is indexed by all its runs as well.
RARE_SHARE = 0.6
#: All pages of the buckets that are still open are compared once their pairs are at most so many times their pages.
FEW = 8
_WORD = re.compile(r"[^\W_]+")
_SLICE = 500


class _Hashes(dict):
    """64-bit hashes of words, kept while there are not too many."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def run_sets(pages: list[list[str | None]]) -> list[np.ndarray]:
    """For each page's texts, the sorted 40-bit hashes of its distinct runs of three words."""
    flat: list[int] = []
    lengths: list[int] = []
    ends: list[int] = []
    for texts in pages:
        for text in texts or ():
            if text:
                w = _WORD.findall(text.lower())
                flat += map(_hashes.__getitem__, w)
                lengths.append(len(w))
        ends.append(len(flat))
    h = np.array(flat, dtype=np.uint64)
    if len(h) < 3:
        return [np.empty(0, np.uint64) for _ in pages]
    text_of = np.repeat(np.arange(len(lengths)), lengths)
    runs = mix(h[:-2] * np.uint64(0x9E3779B97F4A7C15) + mix(h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + mix(h[2:]))) >> np.uint64(24)
    inside = text_of[:-2] == text_of[2:]
    out, begin = [], 0
    for end in ends:
        out.append(np.unique(runs[begin:end][inside[begin:end]]))
        begin = end
    return out


def pack(runs: np.ndarray) -> bytes:
    """Sorted 40-bit numbers as bytes."""
    return runs.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def unpack(raw: bytes) -> np.ndarray:
    """The numbers of ``pack``."""
    wide = np.zeros((len(raw) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return wide.view("<u8").ravel()


def page_texts() -> Column:
    """The texts of a page that count: those of heading, paragraph and quote blocks and each list item."""
    blocks = F.arrays_zip(*(F.col(f"content_blocks.{c}").alias(c) for c in ("type", "text", "items")))
    texts = F.transform(blocks, lambda b: F.when(b["type"].isin("heading", "paragraph", "quote"), F.array(b["text"])).when(b["type"] == "list", b["items"]))
    return F.flatten(F.filter(texts, lambda x: x.isNotNull()))


def _to_sets(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, _SLICE):
            batch = whole.slice(at, _SLICE)
            rows = [(i, len(r), xxhash.xxh3_128_digest(p), p) for i, r in zip(batch.column(0).to_pylist(), run_sets(batch.column(1).to_pylist()), strict=True) if len(r) >= least for p in (pack(r),)]
            if rows:
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["page_id", "n", "digest", "runs"])


def sets(page_data: DataFrame, least: int = LEAST_RUNS) -> DataFrame:
    """page_id, n, digest and runs of each row with at least ``least`` runs."""
    texts = page_data.where(F.col("page_id").isNotNull()).select("page_id", page_texts().alias("texts"))
    return texts.mapInArrow(lambda b: _to_sets(b, least), "page_id bigint, n int, digest binary, runs binary")


def _frequent(batches: Iterator[pa.RecordBatch], share: float) -> Iterator[pa.RecordBatch]:
    """Of a task's pages, the runs on at least half of ``share`` of them, with their counts."""
    runs, counts, pages = np.empty(0, np.uint64), np.empty(0, np.int64), 0
    held: list[np.ndarray] = []

    def settle(runs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fresh, k = np.unique(np.concatenate([*held, np.empty(0, np.uint64)]), return_counts=True)
        held.clear()
        both, at = np.unique(np.concatenate([runs, fresh]), return_inverse=True)
        return both, np.bincount(at, np.concatenate([counts, k]), len(both)).astype(np.int64)

    for batch in batches:
        held += [unpack(x) for x in batch.column(0).to_pylist()]
        pages += batch.num_rows
        if sum(map(len, held)) > COUNTED:
            runs, counts = settle(runs, counts)
            if len(runs) > COUNTED:
                keep = counts * 4 >= share * pages
                runs, counts = runs[keep], counts[keep]
    runs, counts = settle(runs, counts)
    keep = counts * 2 >= share * max(pages, 1)
    yield pa.RecordBatch.from_arrays([pa.array(runs[keep].astype(np.int64)), pa.array(counts[keep])], names=["run", "k"])


def common_runs(pages: DataFrame, share: float = COMMON) -> np.ndarray:
    """Runs on more than ``share`` of all pages, by the sums of the tasks' counts: at most 1 / ``share`` times a page's runs are collected.

    A run that is common in none of the tasks' pages isn't in the whole; one that is rare in some can be missed, which costs time only.
    """
    limit = max(2, share * pages.count())
    counts = pages.select("runs").mapInArrow(lambda b: _frequent(b, share), "run bigint, k bigint").groupBy("run").agg(F.sum("k").alias("k"))
    return np.array(sorted(r[0] for r in counts.where(F.col("k") > limit).select("run").collect()), dtype=np.uint64)


def _constants(seed: int, n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


_A, _B = _constants(11, SEGMENTS * POSITIONS), _constants(23, SEGMENTS * POSITIONS)
_C, _S = _constants(37, POSITIONS), _constants(51, SEGMENTS * POSITIONS).reshape(SEGMENTS, POSITIONS)


def fingerprint(runs: np.ndarray) -> np.ndarray:
    """Min-hash values of a set, one per position."""
    return np.array([np.min(runs * a + b) for a, b in zip(_A, _B, strict=True)]) if len(runs) > 2_000 else (runs[None, :] * _A[:, None] + _B[:, None]).min(axis=1)


def variants(prints: np.ndarray, salt: int = 0) -> np.ndarray:
    """One key per segment and wildcard position of each fingerprint (rows)."""
    v = mix(prints.reshape(-1, SEGMENTS, POSITIONS) * _C)
    keys = mix(v.sum(axis=2)[:, :, None] - v + _S + np.uint64(salt))
    return keys.reshape(len(prints), -1).view(np.int64)


def _to_keys(batches: Iterator[pa.RecordBatch], common: np.ndarray, share: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, rare, whole_ids, whole = [], [], [], []
        for page, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            runs = unpack(raw)
            at = np.minimum(np.searchsorted(common, runs), max(0, len(common) - 1))
            kept = runs[common[at] != runs] if len(common) else runs
            if len(kept):
                ids.append(page)
                rare.append(fingerprint(kept))
            if len(kept) < share * len(runs):
                whole_ids.append(page)
                whole.append(fingerprint(runs))
        for pages, prints, salt in ((ids, rare, 0), (whole_ids, whole, 99)):
            if pages:
                keys = variants(np.array(prints), salt)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32)), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(pages, pa.int64()), lists], names=["page_id", "keys"])


def _verified(batches: Iterator[pa.RecordBatch], part: int, whole: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, left, right = batch.column(0), batch.column(1), batch.column(2), batch.column(3)
        good, last, seen = [], None, None
        for x, y in zip(left, right, strict=True):
            x = x.as_py()
            if x is not last and x != last:
                last, seen = x, unpack(x)
            other = unpack(y.as_py())
            shared = len(np.intersect1d(seen, other, assume_unique=True))
            good.append(shared * whole >= part * (len(seen) + len(other) - shared))
        mask = pa.array(good)
        yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], names=["a", "b"])


def verified(pairs: DataFrame, pages: DataFrame, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, on all their runs."""
    ids = materialise(pairs.select(F.explode(F.array("a", "b")).alias("page_id")).distinct(), "ids")
    wanted = materialise(pages.select("page_id", "runs").join(broadcast_if_small(ids, 500_000), "page_id", "left_semi").dropDuplicates(["page_id"]), "wanted")
    left, right = wanted.select(F.col("page_id").alias("a"), F.col("runs").alias("x")), wanted.select(F.col("page_id").alias("b"), F.col("runs").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(lambda b: _verified(b, *similarity), "a bigint, b bigint")


def links(pages: DataFrame, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """Verified links (a, b) between pages with different sets, enough of them to join every chain of links."""
    common = common_runs(pages)
    keys = pages.select("page_id", "runs").mapInArrow(lambda b: _to_keys(b, common, RARE_SHARE), "page_id bigint, keys array<bigint>")
    index = materialise(keys, "keys").select("page_id", F.explode("keys").alias("key"))
    hubs = materialise(index.groupBy("key").agg(F.min("page_id").alias("hub"), F.max("page_id").alias("most")).where("most > hub").select("key", "hub"), "hubs")
    buckets = materialise(index.join(broadcast_if_small(hubs, 300_000), "key").select("key", "page_id", "hub").distinct(), "buckets")
    tried = materialise(buckets.where("page_id <> hub").select(F.col("hub").alias("a"), F.col("page_id").alias("b")).distinct(), "pairs")
    found = materialise(verified(tried, pages, similarity), "links")
    turn = 0
    while True:
        label = components(found)
        placed = buckets.select("key", "page_id").join(broadcast_if_small(label, 300_000), F.col("page_id") == F.col("id"), "left").select("key", "page_id", F.coalesce("component", "page_id").alias("component"))
        # buckets of one component need no more pairs
        sizes = placed.groupBy("key", "component").agg(F.count("*").alias("k"))
        split = sizes.groupBy("key").agg(F.count("*").alias("parts"), F.sum("k").alias("pages"), F.sum(F.col("k") * F.col("k")).alias("inside")).where("parts > 1")
        split = materialise(split.withColumn("cross", (F.col("pages") * F.col("pages") - F.col("inside")) / 2), "split")
        todo, rows, largest = split.agg(F.sum("cross"), F.sum("pages"), F.max("pages")).first()
        if not todo:
            return found
        open_ = materialise(placed.join(broadcast_if_small(split.select("key", "pages"), 300_000), "key"), "open")
        turn += 1
        if last := todo <= FEW * rows or 2**turn >= largest:
            # every pair of pages that are still apart
            one, two = open_.select("key", F.col("page_id").alias("a"), F.col("component").alias("ca")), open_.select("key", F.col("page_id").alias("b"), F.col("component").alias("cb"))
            pairs = one.join(two, "key").where("a < b AND ca <> cb").select("a", "b").distinct()
        else:
            # in each turn twice as many hubs of a bucket, others each time
            hub = open_.where(F.pmod(F.xxhash64("page_id", "key", F.lit(turn)), F.col("pages")) < 2**turn).select("key", F.col("page_id").alias("hub"), F.col("component").alias("its"))
            apart = open_.join(hub, "key").where("component <> its")
            pairs = apart.select(F.least("page_id", "hub").alias("a"), F.greatest("page_id", "hub").alias("b")).distinct()
        fresh = materialise(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        found = materialise(found.unionByName(verified(fresh, pages, similarity)), "links")
        if last:
            return found
        tried = tried.unionByName(fresh)


def _placed(page_data: DataFrame, least: int, similarity: tuple[int, int]) -> DataFrame:
    pages = materialise(sets(page_data, least), "runs")
    members = pages.select("page_id", "digest").distinct()
    first = materialise(members.groupBy("digest").agg(F.min("page_id").alias("first")), "first")
    placed = materialise(members.join(first, "digest").select("page_id", "first"), "members")
    copies = placed.where("page_id <> first").select("page_id")
    alone = pages.select("page_id", "runs").join(broadcast_if_small(copies, 300_000), "page_id", "left_anti")
    label = components(links(alone, similarity))
    return materialise(placed.join(broadcast_if_small(label, 300_000), F.col("first") == F.col("id"), "left").select("page_id", F.coalesce("component", "first").alias("class_id")), "classes")


def classes(page_data: DataFrame, least: int = LEAST_RUNS, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """page_id, class_id (the smallest page_id of its group) and class_size of every page that takes part: the form for groups of any size."""
    placed = _placed(page_data, least, similarity)
    sizes = placed.groupBy("class_id").agg(F.count("*").alias("class_size"))
    return placed.join(broadcast_if_small(sizes, 300_000), "class_id").select("page_id", "class_id", "class_size")


def found(page_data: DataFrame) -> DataFrame:
    """Every pair of pages of one group: page_id_a < page_id_b. Its size is that of the case's definition; ``classes`` has a row per page."""
    placed = _placed(page_data, LEAST_RUNS, SIMILARITY)
    many = placed.groupBy("class_id").agg(F.count("*").alias("k")).where("k > 1").select("class_id")
    grouped = materialise(placed.join(broadcast_if_small(many, 300_000), "class_id", "left_semi"), "grouped")
    a, b = grouped.select("class_id", F.col("page_id").alias("page_id_a")), grouped.select("class_id", F.col("page_id").alias("page_id_b"))
    return a.join(b, "class_id").where("page_id_a < page_id_b").select("page_id_a", "page_id_b")


_CLASSES_SQL = r"""
WITH RECURSIVE p AS (SELECT page_id, content_blocks FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY loaded_at) AS rn FROM page_data) WHERE rn = 1),
b AS (SELECT page_id, unnest(content_blocks) AS b FROM p),
t AS (SELECT page_id, b."text" AS t FROM b WHERE b.type IN ('heading', 'paragraph', 'quote') UNION ALL SELECT page_id, unnest(b.items) FROM b WHERE b.type = 'list'),
w AS (SELECT page_id, regexp_extract_all(lower(t), '[\p{L}\p{N}]+') AS w FROM t WHERE t IS NOT NULL),
r AS (SELECT DISTINCT page_id, w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] AS run FROM (SELECT page_id, w, unnest(range(1, len(w) - 1)) AS k FROM w WHERE len(w) >= 3)),
n AS (SELECT page_id, count(*) AS n FROM r GROUP BY 1 HAVING count(*) >= 100),
s AS (SELECT x.page_id AS a, y.page_id AS b, count(*) AS c FROM r x JOIN r y ON x.run = y.run AND x.page_id < y.page_id GROUP BY 1, 2),
l AS (SELECT a, b FROM s JOIN n na ON na.page_id = a JOIN n nb ON nb.page_id = b WHERE 10 * c >= 7 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
q AS (SELECT page_id AS a, page_id AS b FROM n UNION SELECT q.a, e.b FROM q JOIN e ON q.b = e.a)
"""
FOUND_SQL = _CLASSES_SQL + "SELECT a AS page_id_a, b AS page_id_b FROM q WHERE a < b"
CLASSES_SQL = _CLASSES_SQL + "SELECT a AS page_id, min(b) AS class_id, count(*) AS class_size FROM q GROUP BY a"
