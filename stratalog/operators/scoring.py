"""Batch scoring with providers: planned batches, cached answers, a cost ledger, ceilings and resumption."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.operators.ranking import global_rank


class Provider(Protocol):
    """Scores a batch of (unit_id, payload) rows: one mapping tag -> score per row, and the batch's cost."""

    def score(self, payloads: list[str]) -> tuple[list[dict[str, float]], float]: ...


def greedy_batches(rows: DataFrame, by: str, pos: str, size: str, most_rows: int, most_size: int) -> DataFrame:
    """``batch``: rows in order, a batch ends before it would pass either limit. A row over the limit alone is an error."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(pos)
        out, batch, n, total = [], 0, 0, 0
        for s in pdf[size]:
            if s > most_size:
                raise ValueError("a unit is over the size limit")
            if n and (n == most_rows or total + s > most_size):
                batch, n, total = batch + 1, 0, 0
            n, total = n + 1, total + s
            out.append(batch)
        return pdf.assign(batch=out)

    schema = ", ".join(f"`{k}` {v}" for k, v in kinds.items()) + ", batch int"
    return rows.groupBy(by).applyInPandas(plan, schema)


def fixed_batches(rows: DataFrame, primary, order: list, size: int) -> DataFrame:
    """``batch``: ``size`` rows each, in order."""
    return global_rank(rows, primary, order, "i_").withColumn("batch", F.floor(F.col("i_") / size).cast("int")).drop("i_")


def pending(units: DataFrame, cache: DataFrame) -> DataFrame:
    """Units (unit_id, payload_hash) without a cached answer to the same payload."""
    return units.join(cache.select("unit_id", "payload_hash"), ["unit_id", "payload_hash"], "left_anti")


def _batched(rows: Iterable, most_rows: int, most_size: int) -> Iterator[list]:
    """Rows in lists that end before one would pass either limit; a payload over the limit alone is an error."""
    now, size = [], 0
    for row in rows:
        if len(row.payload) > most_size:
            raise ValueError("a unit is over the size limit")
        if now and (len(now) == most_rows or size + len(row.payload) > most_size):
            yield now
            now, size = [], 0
        now.append(row)
        size += len(row.payload)
    if now:
        yield now


def score_units(units: DataFrame, cache: DataFrame, provider: Callable[[], Provider], batch_rows: int, most_size: int, ceiling: float, spent: float = 0.0) -> tuple[DataFrame, DataFrame, float]:
    """New cache rows (unit_id, payload_hash, tag_id, score), ledger rows (batch_hash, cost), and what was spent in all.

    units: unit_id, pos, payload. Only pending units are sent, in order of ``pos`` and in batches as of
    :func:`greedy_batches`, one request after another as every request costs; it stops before a batch
    once ``ceiling`` is reached. Units come to the driver a sorted partition at a time, as far as
    the ceiling lets it go.
    """
    spark = units.sparkSession
    hashed = units.withColumn("payload_hash", F.sha2("payload", 256))
    ordered = pending(hashed, cache).select("unit_id", "payload_hash", "payload").orderBy("pos").toLocalIterator()
    scores, ledger = [], []
    tool = provider()
    for rows in _batched(ordered, batch_rows, most_size):
        if spent >= ceiling:
            break
        answers, cost = tool.score([r.payload for r in rows])
        if len(answers) != len(rows) or not cost >= 0:
            raise ValueError("an answer does not fit its request")
        spent += cost
        scores += [(r.unit_id, r.payload_hash, tag, float(s)) for r, a in zip(rows, answers, strict=True) for tag, s in a.items()]
        digest = spark.range(1).select(F.sha2(F.lit("|".join(r.payload_hash for r in rows)), 256)).first()[0]
        ledger.append((digest, float(cost)))
    return spark.createDataFrame(scores, "unit_id string, payload_hash string, tag_id string, score double"), spark.createDataFrame(ledger, "batch_hash string, cost double"), spent


def ledger_total(ledger: DataFrame) -> DataFrame:
    """A batch that stands twice in the ledger was paid once."""
    return ledger.groupBy("batch_hash").agg(F.max("cost").alias("cost")).agg(F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 9).alias("total"))


def carry_over(sample: DataFrame, old: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """A new sample with the human labels that its rows already had."""
    kept = old.select(key, *[F.col(c).alias(f"{c}_old") for c in columns])
    out = sample.join(kept, key, "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(f"{c}_old", c) if c in sample.columns else F.col(f"{c}_old"))
    return out.drop(*[f"{c}_old" for c in columns])


def first_available(backends: dict[str, Callable[[], Provider]], wanted: str = "auto") -> tuple[str, Provider]:
    """Name and provider of the wanted backend, or with `auto` of the first, in their order, that can be made.

    A backend says that it can't by ImportError or OSError; one that is asked for by name fails with that.
    """
    if wanted != "auto":
        return wanted, backends[wanted]()
    reasons = []
    for name, make in backends.items():
        try:
            return name, make()
        except (ImportError, OSError) as error:
            reasons.append(f"{name}: {error}")
    raise RuntimeError("no backend: " + "; ".join(reasons))
