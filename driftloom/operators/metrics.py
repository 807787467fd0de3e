"""Statistics of a run, gathered in the pass that makes its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation

from .rounds import settled


def measured(rows: DataFrame, metrics: dict[str, Column], name: str = "measured") -> tuple[DataFrame, dict[str, int]]:
    """``rows`` as a table that is written once, and ``metrics`` (aggregates that need no distinct) over them, from that one pass.

    Aggregates ride along as observations, so that nothing is scanned for them and every number belongs to the very rows that
    were written. A failed and repeated task counts once.
    """
    seen = Observation(name)
    table = settled(rows.observe(seen, *[c.alias(k) for k, c in metrics.items()]), name)
    return table, seen.get


class Gauge:
    """Aggregates at a place of a plan that is still to run: of what is read, beside those of what comes out."""

    def __init__(self, name: str, **metrics: Column):
        self._seen, self._metrics = Observation(name), metrics

    def on(self, rows: DataFrame) -> DataFrame:
        return rows.observe(self._seen, *[c.alias(k) for k, c in self._metrics.items()])

    def read(self) -> dict[str, int]:
        """The numbers; waits until the plan has run."""
        return self._seen.get
