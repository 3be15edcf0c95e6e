"""Lines repeated across one site's pages.

Pass one builds mergeable heavy-hitter summaries (Misra-Gries counters) of line keys for each site. A summary has at most
``COUNTERS`` of them; beyond, all are decremented, and the sum of the decrements is its error, by which a count may be too
low. With n lines the error is at most n / (COUNTERS + 1), however the summaries of tasks are merged, so a site of more lines
than keep the error below the wanted number of pages is split into shards by key, each with a summary of its own. A line
that reaches the number thus keeps a counter. Should a shard's error nevertheless reach it, all lines of the shard are
candidates. A task holds at most ``HELD`` counters, and the merging one a summary and a batch.

Pass two counts the distinct pages of the surviving lines exactly, and the confirmed lines are taken out of their pages.

Defined results: blocks, texts, items and sites that are null have no lines; a line twice on one page counts one page;
redelivered rows count once; repeated rows give no repeated cases; a page's other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.runtime import broadcast_if_small, materialise

MIN_LETTERS = 12
MIN_PAGES = 6
#: Counters of a summary.
COUNTERS = 8_192
#: Counters and new rows that a task holds before it passes its summaries on.
HELD = 400_000
KEY = ["site", "k1", "k2"]
SUMMARY = "site string, shard int, k1 bigint, k2 bigint, n bigint"
_SUMMARY = pa.schema([("site", pa.string()), ("shard", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64()), ("n", pa.int64())])


def letters(line: Column) -> Column:
    """A line's letters alone, in lower case."""
    return F.regexp_replace(F.lower(line), r"[^\p{L}]", "")


def block_lines(page_data: DataFrame) -> DataFrame:
    """One row per line: page_id, site, block_idx, line_idx, line."""
    blocks = page_data.select("page_id", "site", F.posexplode(F.arrays_zip(*(F.col(f"content_blocks.{c}").alias(c) for c in ("type", "text", "items")))).alias("block_idx", "b"))
    lines = F.when(F.col("b.type").isin("heading", "paragraph"), F.split("b.text", "\n", -1)).when(F.col("b.type") == "list", F.col("b.items"))
    return blocks.select("page_id", "site", "block_idx", F.posexplode(lines).alias("line_idx", "line"))


def keyed_lines(page_data: DataFrame) -> DataFrame:
    """Lines that count, with two independent 64-bit hashes of their letters in place of the text."""
    key = block_lines(page_data).where(F.col("site").isNotNull()).withColumn("key", letters(F.col("line"))).where(F.length("key") >= MIN_LETTERS)
    return key.select("page_id", "site", "block_idx", "line_idx", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit(7), F.col("key")).alias("k2"))


def merge(parts: list[pa.Table], counters: int = COUNTERS) -> pa.Table:
    """Summaries (or lines counted one by one) as one for each site and shard; the row of an error has null keys.

    Of a summary with more than ``counters`` entries, the largest count beyond them is taken off all and added to the error.
    """
    total = pa.concat_tables(parts).group_by(_SUMMARY.names[:4]).aggregate([("n", "sum")]).rename_columns(_SUMMARY.names)
    if total.num_rows <= counters:
        return total
    sites = total["site"].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    shards, n, is_error = total["shard"].to_numpy().astype(np.int64), total["n"].to_numpy().copy(), total["k1"].is_null().to_numpy(zero_copy_only=False)
    _, group = np.unique(np.stack([sites, shards]), axis=1, return_inverse=True)
    group = group.ravel()
    order = np.lexsort((-n, is_error, group))
    begins = np.searchsorted(group[order], np.arange(group.max() + 1))
    sizes = np.bincount(group[~is_error], minlength=len(begins))
    over = np.flatnonzero(sizes > counters)
    if not len(over):
        return total
    cut = np.zeros(len(begins), np.int64)
    cut[over] = n[order[begins[over] + counters]]
    n[~is_error] -= cut[group[~is_error]]
    kept = total.set_column(4, "n", pa.array(n)).filter(pa.array(n > 0))
    first = order[begins[over]]
    errors = pa.Table.from_arrays([total["site"].take(first), total["shard"].take(first), pa.nulls(len(over), pa.int64()), pa.nulls(len(over), pa.int64()), pa.array(cut[over])], schema=_SUMMARY)
    return pa.concat_tables([kept.cast(_SUMMARY), errors]).group_by(_SUMMARY.names[:4]).aggregate([("n", "sum")]).rename_columns(_SUMMARY.names)


def _count(batches: Iterator[pa.RecordBatch], counters: int) -> Iterator[pa.RecordBatch]:
    """The summaries of what a task reads."""
    held: list[pa.Table] = []
    for batch in batches:
        held.append(pa.Table.from_arrays([*batch.columns, pa.array(np.ones(batch.num_rows, np.int64))], schema=_SUMMARY))
        if sum(t.num_rows for t in held) > HELD:
            held = [merge(held, counters)]
            if held[0].num_rows > HELD // 2:
                yield from held.pop().cast(_SUMMARY).to_batches(max_chunksize=10_000)
    if held:
        yield from merge(held, counters).cast(_SUMMARY).to_batches(max_chunksize=10_000)


def _candidates(summary: pa.Table, least: int) -> pa.Table:
    """Of merged summaries, the lines that may reach ``least``, and with null keys the shards of which any line may."""
    errors = summary.filter(pc.is_null(summary["k1"])).select(["site", "shard", "n"]).rename_columns(["site", "shard", "error"])
    lines = summary.filter(pc.is_valid(summary["k1"])).join(errors, ["site", "shard"], join_type="left outer")
    error = pc.fill_null(lines["error"], 0)
    good = lines.filter(pc.greater_equal(pc.add(lines["n"], error), least)).select(_SUMMARY.names)
    lost = summary.filter(pc.and_(pc.is_null(summary["k1"]), pc.greater_equal(summary["n"], least)))
    return pa.concat_tables([good, lost])


def _summarise(batches: Iterator[pa.RecordBatch], least: int, counters: int) -> Iterator[pa.RecordBatch]:
    """Merges the summaries of a partition, which come ordered by site and shard, and passes on what may reach ``least``."""
    held = _SUMMARY.empty_table()
    for batch in batches:
        held = merge([held.cast(_SUMMARY), pa.Table.from_batches([batch]).cast(_SUMMARY)], counters)
        # all but the last site and shard of the batch are complete
        site, shard = batch.column(0)[-1], batch.column(1)[-1]
        last = pc.and_(pc.equal(held["site"], site), pc.equal(held["shard"], shard))
        yield from _candidates(held.filter(pc.invert(last)), least).to_batches(max_chunksize=10_000)
        held = held.filter(last)
    yield from _candidates(held, least).to_batches(max_chunksize=10_000)


def sharded(lines: DataFrame, least: int = MIN_PAGES, counters: int = COUNTERS) -> DataFrame:
    """Lines with the shard of their site's summaries; a shard has about half the lines that keep its error below ``least`` - 1."""
    most = max(1, counters * (least - 1) // 2)
    large = lines.groupBy("site").agg(F.count("*").alias("n")).where(F.col("n") > most).select("site", F.ceil(F.col("n") / most).cast("int").alias("shards"))
    joined = lines.join(broadcast_if_small(materialise(large, "large"), 200_000), "site", "left")
    return joined.withColumn("shard", F.coalesce(F.pmod(F.col("k1"), F.col("shards")), F.lit(0)).cast("int")).drop("shards")


def candidates(lines: DataFrame, least: int = MIN_PAGES, counters: int = COUNTERS) -> DataFrame:
    """Lines of a site that may stand on ``least`` pages, from the merged summaries; none that does is missing."""
    rows = sharded(lines, least, counters)
    counted = rows.select("site", "shard", "k1", "k2").mapInArrow(lambda b: _count(b, counters), SUMMARY)
    merged = counted.repartition("site", "shard").sortWithinPartitions("site", "shard").mapInArrow(lambda b: _summarise(b, least, counters), SUMMARY)
    merged = materialise(merged, "summaries")
    lost = merged.where("k1 IS NULL").select("site", "shard")
    found = merged.where("k1 IS NOT NULL").select(*KEY)
    if lost.isEmpty():
        return found
    return found.unionByName(rows.join(lost, ["site", "shard"], "left_semi").select(*KEY)).distinct()


def confirmed(lines: DataFrame, least: int = MIN_PAGES, counters: int = COUNTERS) -> DataFrame:
    """Lines on at least ``least`` distinct pages of their site, counted exactly: site, k1, k2, pages."""
    maybe = candidates(lines, least, counters)
    pages = lines.join(broadcast_if_small(maybe, 200_000), KEY).groupBy(*KEY).agg(F.countDistinct("page_id").alias("pages"))
    return pages.where(F.col("pages") >= least)


def found(page_data: DataFrame, least: int = MIN_PAGES) -> DataFrame:
    """Every occurrence of a confirmed line: page_id, block_idx, line_idx."""
    lines = materialise(keyed_lines(page_data), "lines")
    sure = materialise(confirmed(lines, least), "confirmed")
    return lines.join(broadcast_if_small(sure.select(*KEY), 200_000), KEY, "left_semi").select("page_id", "block_idx", "line_idx").distinct()


def cleaned(page_data: DataFrame, least: int = MIN_PAGES) -> DataFrame:
    """Blocks of lines without the confirmed ones: page_id, block_idx, text (remaining lines joined by line breaks).

    A block of which no line is left gives no row.
    """
    lines = materialise(keyed_lines(page_data), "lines")
    sure = materialise(confirmed(lines, least), "confirmed").select(*KEY)
    all_lines = block_lines(page_data).where(F.col("line").isNotNull()).dropDuplicates(["page_id", "block_idx", "line_idx"])
    key = letters(F.col("line"))
    hashed = all_lines.withColumn("k1", F.xxhash64(key)).withColumn("k2", F.xxhash64(F.lit(7), key))
    kept = hashed.join(broadcast_if_small(sure, 200_000), KEY, "left_anti")
    ordered = F.array_sort(F.collect_list(F.struct("line_idx", "line")))
    return kept.groupBy("page_id", "block_idx").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))


_LINES_SQL = r"""
WITH p AS (SELECT page_id, site, content_blocks FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY loaded_at) AS rn FROM page_data) WHERE rn = 1),
b AS (SELECT page_id, site, i - 1 AS block_idx, content_blocks[i] AS b FROM (SELECT *, unnest(range(1, len(content_blocks) + 1)) AS i FROM p)),
a AS (SELECT page_id, site, block_idx, CASE WHEN b.type IN ('heading', 'paragraph') THEN string_split(b."text", chr(10)) WHEN b.type = 'list' THEN b.items END AS lines FROM b),
l AS (SELECT page_id, site, block_idx, j - 1 AS line_idx, lines[j] AS line FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS j FROM a)),
k AS (SELECT *, regexp_replace(lower(line), '[^\p{L}]', '', 'g') AS key FROM l WHERE line IS NOT NULL),
c AS (SELECT site, key FROM k WHERE length(key) >= 12 AND site IS NOT NULL GROUP BY site, key HAVING count(DISTINCT page_id) >= 6)
"""
FOUND_SQL = _LINES_SQL + "SELECT page_id, CAST(block_idx AS INT) AS block_idx, CAST(line_idx AS INT) AS line_idx FROM k SEMI JOIN c USING (site, key)"
CLEANED_SQL = _LINES_SQL + "SELECT page_id, CAST(block_idx AS INT) AS block_idx, string_agg(line, chr(10) ORDER BY line_idx) AS text FROM k ANTI JOIN c USING (site, key) GROUP BY 1, 2"
