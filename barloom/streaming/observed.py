"""Counts and errors of a validated write, taken in the pass that writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from barloom.operators import validate as va

NAME = "validation"


def validation_metrics() -> list:
    """The counts of ``validation_summary`` as aggregates over checked rows."""
    return [F.count(F.lit(1)).alias("total"), F.count_if("is_valid").alias("valid"), F.count_if(~F.col("is_valid")).alias("invalid")]


def ingest_metrics(ts: str = "ts") -> list:
    return [F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts")]


def _with_rate(found: dict) -> dict:
    return found | {"success_rate": found["valid"] * 100.0 / found["total"] if found["total"] else 0.0}


def write_validated(df: DataFrame, kind: str, path: str, ts: str | None = None) -> dict:
    """Write checked rows by ``is_valid`` and return total, valid, invalid, success_rate (and the time range) of the same pass.

    Valid rows are in ``is_valid=true``; the others, with their errors, in ``is_valid=false``.  The source is read once.
    """
    seen = Observation(NAME)
    metrics = validation_metrics() + (ingest_metrics(ts) if ts else [])
    va.VALIDATORS[kind](df).observe(seen, *metrics).write.partitionBy("is_valid").parquet(path)
    return _with_rate(dict(seen.get))


class ValidationListener(StreamingQueryListener):
    """Keeps the figures of every micro-batch of the streams that ``observed_stream`` made."""

    def __init__(self):
        self.batches: dict[tuple[str, int], dict] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(NAME)
        if row is not None and event.progress.numInputRows:
            self.batches[str(event.progress.id), event.progress.batchId] = _with_rate(row.asDict())

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def summary(self) -> dict:
        """All batches together."""
        return _with_rate({k: sum(b[k] for b in self.batches.values()) for k in ("total", "valid", "invalid")})


def observed_stream(df: DataFrame, kind: str, ts: str | None = None) -> DataFrame:
    """Checked rows of a stream whose progress carries their figures; a ``ValidationListener`` collects them."""
    metrics = validation_metrics() + (ingest_metrics(ts) if ts else [])
    return va.VALIDATORS[kind](df).observe(NAME, *metrics)
