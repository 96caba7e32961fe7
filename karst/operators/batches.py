"""Batches of companies in which one that fails is a row and not the end of the job, and counts that reach the caller with the rows."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, BooleanType, IntegralType, StructType


#: Keys whose results go back together.
TOGETHER = 100


def isolated(rows: DataFrame, key: str, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str, most: int = 100_000) -> DataFrame:
    """Rows of ``work`` for each key, with ``error``: null, or in one row what went wrong with that key (its other columns are null).

    ``work`` gets all rows of a key and gives rows of ``schema``, which has no key and no
    error.  Whatever it raises, or gives in another shape, concerns its key alone.  A key
    of more than ``most`` rows isn't gathered: it is an error row as well.  A null key is a key.
    """
    out = StructType.fromDDL(schema)
    names = [f.name for f in out.fields]
    counted = rows.groupBy(F.col(key).alias("__k")).agg(F.count(F.lit(1)).alias("__n"))
    large = counted.where(F.col("__n") > most)
    too_large = large.select(F.col("__k").alias(key), *[F.lit(None).cast(f.dataType).alias(f.name) for f in out.fields], F.concat(F.lit("TooLarge: "), F.col("__n").cast("string"), F.lit(" rows")).alias("error"))
    kept = rows.join(F.broadcast(large.select("__k")) if most >= 10_000 else large.select("__k"), F.col(key).eqNullSafe(F.col("__k")), "left_anti")
    kind = rows.schema[key].dataType

    def told(frame: pd.DataFrame) -> pd.DataFrame | str:
        """What was made of a key's rows, or its error."""
        try:
            made = work(frame)
            return made if isinstance(made, pd.DataFrame) and list(made.columns) == names else made[names].reset_index(drop=True)
        except Exception as e:  # whatever a company's rows may do, the others go on
            return f"{type(e).__name__}: {e}"

    def alone(k: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        made = told(frame)
        if isinstance(made, str):
            return pd.DataFrame([[k[0], *[None] * len(names), made]], columns=[key, *names, "error"])
        made = made.assign(error=None)
        made.insert(0, key, k[0])
        return made

    whole = StructType().add(key, kind)
    for f in out.fields:
        whole.add(f.name, f.dataType, True)
    whole.add("error", "string")
    # What Python does for a key is much for its few bytes, so keys are dealt to all cores.
    parts = max(4 * max(rows.sparkSession.sparkContext.defaultParallelism, 8), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kept = kept.repartition(parts, key)
    if all(isinstance(f.dataType, AtomicType) for f in rows.schema.fields):
        return _runs(kept, key, told, names, whole).unionByName(too_large)
    return kept.groupBy(key).applyInPandas(alone, whole).unionByName(too_large)  # pandas gets nested values by their whole batch


def _runs(rows: DataFrame, key: str, told: Callable[[pd.DataFrame], pd.DataFrame | str], names: list[str], whole: StructType) -> DataFrame:
    """``told`` of each key's rows, which come one after another, many keys to a batch: a batch for each key takes longer than its work.

    A key's columns are as if it came alone: a null makes whole numbers decimal, and booleans objects, in its own key only.
    """
    columns = rows.columns
    gaps = {f.name: (f"__gap{i}", "object" if isinstance(f.dataType, BooleanType) else "float64") for i, f in enumerate(rows.schema.fields) if f.nullable and isinstance(f.dataType, (IntegralType, BooleanType))}
    first = F.row_number().over(Window.partitionBy(key).orderBy(key)) == 1
    filled = [F.coalesce(F.col(c), F.lit(0).cast(rows.schema[c].dataType)).alias(c) if c in gaps else F.col(c) for c in columns]
    sent = rows.withColumn("__first", first).select(*filled, *[F.col(c).isNull().alias(g) for c, (g, _) in gaps.items()], "__first")

    def said(values: pd.DataFrame, blank: np.ndarray | None, done: list[tuple[int, pd.DataFrame | str]]) -> Iterator[pd.DataFrame]:
        """Results by the kinds of their columns, so that none are changed to fit another key's."""
        alike = defaultdict(list)
        for at, made in done:
            alike[bool(blank is not None and blank[at]), None if isinstance(made, str) else tuple(made.dtypes)].append((at, made))
        for (is_blank, kinds), some in alike.items():
            if kinds is None:
                out = pd.DataFrame({n: None for n in names} | {"error": [m for _, m in some]}, columns=[*names, "error"])
                at = [a for a, _ in some]
            else:
                out = pd.concat([m for _, m in some], ignore_index=True).assign(error=None)
                at = np.repeat([a for a, _ in some], [len(m) for _, m in some])
            out.insert(0, key, None if is_blank else values[key].take(at).reset_index(drop=True))
            yield out

    def worked(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        starts, values, done = np.flatnonzero(frame["__first"]), frame[columns], []
        here = {c: (frame[g].to_numpy(dtype=bool), like) for c, (g, like) in gaps.items() if frame[g].any()}
        blank = here[key][0] if key in here else None
        for a, b in zip(starts, [*starts[1:], len(frame)]):
            own = values.iloc[a:b].reset_index(drop=True)
            for c, (gap, like) in here.items():
                if gap[a:b].any():
                    own[c] = own[c].astype(like).where(~gap[a:b], None if like == "object" else np.nan)
            done.append((a, told(own)))
            if len(done) == TOGETHER:
                yield from said(values, blank, done)
                done = []
        yield from said(values, blank, done)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_ = []  # the rows of the last key so far, which may have more in the next batch
        for frame in frames:
            starts = np.flatnonzero(frame["__first"])
            if len(starts):
                if open_ or starts[0]:
                    yield from worked(pd.concat([*open_, frame.iloc[: starts[0]]], ignore_index=True))
                yield from worked(frame.iloc[starts[0] : starts[-1]].reset_index(drop=True))
                open_, frame = [], frame.iloc[starts[-1] :]
            open_.append(frame)
        if open_:
            yield from worked(pd.concat(open_, ignore_index=True))

    return sent.mapInPandas(run, whole)


class Counts:
    """Counts of rows that pass a place in a plan, got while the job that moves them runs: no job of their own.

    ``on`` gives back the rows with the counts attached; ``result`` waits for the first
    action on them.  A count is the number of rows for which its test is true.
    """

    def __init__(self, tests: dict[str, Column] | None = None):
        self.tests, self.observation = tests or {}, Observation()

    def on(self, rows: DataFrame) -> DataFrame:
        return rows.observe(self.observation, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(n) for n, c in self.tests.items()])

    def result(self) -> dict[str, int]:
        return dict(self.observation.get)


def watched(rows: DataFrame, step: Callable[[DataFrame], DataFrame], hook: Callable[[dict[str, int], dict[str, int]], None], tests: dict[str, Column] | None = None) -> Callable[[Callable[[DataFrame], None]], None]:
    """Runs ``step`` within an action and calls ``hook`` with the counts of what went in and what came out.

    The result takes the action, as ``watched(df, step, hook)(lambda out: out.write.parquet(path))``.
    """
    before, after = Counts(), Counts(tests)

    def act(action: Callable[[DataFrame], None]) -> None:
        action(after.on(step(before.on(rows))))
        hook(before.result(), after.result())

    return act
