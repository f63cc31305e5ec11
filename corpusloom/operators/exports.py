"""Export and training rows, and the hook for a caller's own scorer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def export_rows(positions: DataFrame, evaluations: DataFrame, key: str, rejects: DataFrame) -> DataFrame:
    """Positions with their evaluation or its absence, and the rejected rows, in one table with a status."""
    joined = positions.join(evaluations, key, "left")
    known = [c for c in evaluations.columns if c != key]
    status = F.when(F.col(known[0]).isNull(), "missing").otherwise("ok")
    return joined.withColumn("status", status).unionByName(rejects.withColumn("status", F.lit("reject")), allowMissingColumns=True)


def opening_label(tagged: Column, custom_start: Column, found: Column, force: bool = False) -> Column:
    """A record's opening: its own tag unless forced, none for a custom start, else the book's."""
    own = F.lit(False) if force else tagged.isNotNull() & (tagged != "")
    return F.when(own, tagged).when(custom_start, None).otherwise(found)


def score_pending(keys: DataFrame, scorer: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Score keys with a function from a frame to a frame; batches come and go by Arrow."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield scorer(batch)

    return keys.mapInPandas(run, schema)


def manifest_state(current: DataFrame, manifest: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """Add state: keep where the manifest has the same fingerprint, rebuild where it has another, build where it has none."""
    known = manifest.select(key, F.col(fingerprint).alias("__old"))
    state = F.when(F.col("__old").isNull(), "build").when(F.col("__old") == F.col(fingerprint), "keep").otherwise("rebuild")
    return current.join(known, key, "left").withColumn("state", state).drop("__old")
