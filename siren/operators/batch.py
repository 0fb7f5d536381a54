"""Whole runs: a batch of reports with its counts, and collect, enrich, store, summarise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from siren.operators.collect import collect_reports
from siren.operators.enrich import EntityFn, ScoreFn, enrich
from siren.operators.gazetteer import Places
from siren.operators.lookup import written
from siren.operators.stats import batch_counts, observed, run_summary
from siren.sources.tables import write_enriched


def enrich_batch(
    df: DataFrame,
    gazetteer: DataFrame | Places | None = None,
    score_fn: ScoreFn | None = None,
    entity_fn: EntityFn | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The enriched rows of a batch, and one row with how many there are, are urgent and have no place.

    The rows are written once; both results read them, so that nothing is enriched, and no scorer called, twice.
    """
    rows = written(enrich(df, gazetteer, score_fn=score_fn, entity_fn=entity_fn), "batch")
    return rows, batch_counts(rows)


def run_batch(
    feeds: Sequence[DataFrame], gazetteer: DataFrame, path: str, substitute: DataFrame | None = None
) -> tuple[dict[str, int], DataFrame]:
    """Collect the feeds, enrich the reports, write the stored table to ``path`` and summarise it.

    Returns the counters seen while writing (processed, high_urgency, unknown_location), for which nothing is read
    again, and the summary of the stored table.
    """
    reports = collect_reports(feeds, substitute)
    rows, counters = observed(enrich(reports, gazetteer))
    write_enriched(rows, path)
    return counters.get, run_summary(gazetteer.sparkSession.read.parquet(path))
