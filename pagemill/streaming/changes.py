"""Streams of captured pages: the extractor on a stream, and detection of changed pages by content hash."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagemill.sources.pages import capture, derived

CHANGES = "url string, content_hash string, previous_hash string, change string"


def captured_stream(stream: DataFrame) -> DataFrame:
    """Captured and derived pages of a stream of raw ones; nothing is kept between batches."""
    return derived(capture(stream))


def _changes(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last = state.get[0] if state.exists else None
    rows = []
    for row in sorted((r for f in frames for r in f.itertuples()), key=lambda r: (r.loaded_at, r.content_hash)):
        if row.content_hash != last:
            rows.append((key[0], row.content_hash, last, "new" if last is None else "changed"))
            last = row.content_hash
    if last is not None:
        state.update((last,))
    yield pd.DataFrame(rows, columns=["url", "content_hash", "previous_hash", "change"])


def changes(stream: DataFrame) -> DataFrame:
    """New and changed pages of a stream (url, content_hash, loaded_at); the state is one hash per URL. Null hashes are left out."""
    kept = stream.where("content_hash IS NOT NULL AND url IS NOT NULL").select("url", "content_hash", "loaded_at")
    return kept.groupBy("url").applyInPandasWithState(_changes, CHANGES, "last string", "append", GroupStateTimeout.NoTimeout)
