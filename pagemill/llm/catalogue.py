"""Queries of the llm subpackage and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagemill.llm import encode, leakage, main_content, near_duplicates, quality, residue, site_lines
from pagemill.runtime import table

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    """Every query of this subpackage by name."""
    return {
        "p1_found": lambda s, d: near_duplicates.found(table(s, d, "page_data")),
        "p1_classes": lambda s, d: near_duplicates.classes(table(s, d, "page_data")),
        "p3_found": lambda s, d: site_lines.found(table(s, d, "page_data")),
        "p3_cleaned": lambda s, d: site_lines.cleaned(table(s, d, "page_data")),
        "p4_found": lambda s, d: main_content.found(table(s, d, "page_data")),
        "p4_body": lambda s, d: main_content.body(table(s, d, "page_data")),
        "p5_found": lambda s, d: residue.found(table(s, d, "page_data")),
        "p5_pages": lambda s, d: residue.judged(table(s, d, "page_data")),
        "p6_ids": lambda s, d: encode.encoded(table(s, d, "documents")),
        "p7_found": lambda s, d: leakage.found(table(s, d, "documents"), table(s, d, "benchmark")),
        "p7_spans": lambda s, d: leakage.spans(table(s, d, "documents"), table(s, d, "benchmark")),
        "p7_removal_spans": lambda s, d: leakage.removal_spans(table(s, d, "documents"), table(s, d, "benchmark")),
        "p8_found": lambda s, d: quality.found(table(s, d, "documents")),
        "p8_statistics": lambda s, d: quality.statistics(table(s, d, "documents")),
        "p8_figures": lambda s, d: quality.statistics(table(s, d, "documents")).select("doc_id", "n_words", "mean_word_length", "n_lines", "common_share", "language"),
        "p8_counts": lambda s, d: quality.counts(table(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query name."""
    return {"p1_found": near_duplicates.FOUND_SQL, "p1_classes": near_duplicates.CLASSES_SQL, "p3_found": site_lines.FOUND_SQL, "p3_cleaned": site_lines.CLEANED_SQL, "p7_found": leakage.FOUND_SQL, "p7_spans": leakage.SPANS_SQL, "p7_removal_spans": leakage.REMOVAL_SQL, "p8_figures": quality.FIGURES_SQL, "p8_counts": quality.COUNTS_SQL}
