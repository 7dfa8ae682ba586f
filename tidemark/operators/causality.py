"""Lookahead detector: a feature of a panel must not change where it stands when later rows go."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RTOL, ATOL, MIN_HISTORY = 1e-9, 1e-12, 30
# Where histories are cut, as shares of their length.
FRACTIONS = (0.35, 0.45, 0.55, 0.65, 0.75, 0.85, 0.92)

Inputs = DataFrame | Mapping | Sequence
Feature = Callable[..., DataFrame]


class LeakageError(AssertionError):
    """A feature that looks ahead, or that the detector cannot compare."""


def checkpoints(n: int, min_history: int = MIN_HISTORY) -> list[int]:
    """Row counts at which to cut ``n`` rows."""
    if n <= min_history:
        raise ValueError(f"{n} rows are not more than the {min_history} of history needed")
    cuts = sorted({c for f in FRACTIONS if min_history <= (c := round(f * n)) < n})
    return cuts or [(min_history + n) // 2]


def _map(data: Inputs, change: Callable[[DataFrame], DataFrame]) -> Inputs:
    if isinstance(data, DataFrame):
        return change(data)
    if isinstance(data, Mapping):
        return {k: _map(v, change) for k, v in data.items()}
    if isinstance(data, list | tuple):
        return type(data)(_map(v, change) for v in data)
    raise TypeError(f"cannot cut a {type(data).__name__}")


def _frames(data: Inputs) -> list[DataFrame]:
    if isinstance(data, DataFrame):
        return [data]
    return [f for v in (data.values() if isinstance(data, Mapping) else data) for f in _frames(v)]


def truncate(data: Inputs, last: object, order: str = "date") -> Inputs:
    """The rows up to and including the label ``last`` in every DataFrame of a structure."""
    return _map(data, lambda df: df.filter(F.col(order) <= F.lit(last)))


def labels_of(data: Inputs, order: str = "date") -> DataFrame:
    """The labels that all inputs share; they must have as many each."""
    frames = [f.select(order).distinct() for f in _frames(data)]
    sizes = {f.count() for f in frames}
    if len(sizes) != 1:
        raise ValueError(f"inputs have different numbers of labels: {sorted(sizes)}")
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, order, "left_semi")
    return out


def same(a: Column, b: Column, numeric: bool, rtol: float = RTOL, atol: float = ATOL) -> Column:
    """Equal, both missing, or for numbers within tolerance of ``b``."""
    equal = a.eqNullSafe(b)
    return equal | F.coalesce(F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b), F.lit(False)) if numeric else equal


def disagreements(feature: Feature, data: Inputs, last: object, *, keys: Sequence[str] = ("symbol", "date"), order: str = "date", rtol: float = RTOL, atol: float = ATOL) -> DataFrame:
    """(column, keys, full, cut, kind) for one cut; compared cells that agree have kind ``same``.

    kinds: differs; lost, a label up to the cut that the cut run lacks; invented, a label that the
    input does not have.
    """
    full, cut = feature(data), feature(truncate(data, last, order))
    for out in (full, cut):
        if not isinstance(out, DataFrame):
            raise LeakageError(f"the feature returned a {type(out).__name__}, not a DataFrame")
    if full.columns != cut.columns:
        raise LeakageError(f"columns change with the rows: {full.columns} and {cut.columns}")
    values = [c for c in full.columns if c not in keys]
    types = dict(full.dtypes)
    pack = lambda df, name: df.select(*keys, F.struct(*values).alias(name))
    both = pack(full.filter(F.col(order) <= F.lit(last)), "f").join(pack(cut, "c"), list(keys), "full")
    cells = []
    for v in values:
        a, b = F.col(f"f.{v}"), F.col(f"c.{v}")
        numeric = types[v] in ("double", "float", "int", "bigint", "smallint", "tinyint")
        kind = F.when(F.col("f").isNull(), "invented").when(F.col("c").isNull(), "lost").when(same(a, b, numeric, rtol, atol), "same").otherwise("differs")
        cells.append(F.struct(F.lit(v).alias("column"), a.cast("string").alias("full"), b.cast("string").alias("cut"), kind.alias("kind")))
    return both.select(*keys, F.explode(F.array(*cells)).alias("cell")).select("cell.column", *keys, "cell.full", "cell.cut", "cell.kind")


def summary(feature: Feature, data: Inputs, cuts: Sequence[object], **more) -> DataFrame:
    """(checkpoint, n_compared, n_bad, passed) for each cut label; comparing nothing does not pass."""
    out = None
    for last in cuts:
        cells = disagreements(feature, data, last, **more)
        row = cells.agg(F.count_if(F.col("kind").isin("same", "differs")).alias("n_compared"), F.count_if(F.col("kind") != "same").alias("n_bad"))
        row = row.select(F.lit(last).alias("checkpoint"), "n_compared", "n_bad", ((F.col("n_bad") == 0) & (F.col("n_compared") > 0)).alias("passed"))
        out = row if out is None else out.unionByName(row)
    return out


@dataclass(frozen=True)
class Report:
    name: str
    checkpoints: list
    n_compared: int
    failures: DataFrame
    n_failures: int

    @property
    def passed(self) -> bool:
        return self.n_failures == 0 and self.n_compared > 0


def check(feature: Feature, data: Inputs, name: str = "feature", *, cuts: Sequence[object] | None = None, min_history: int = MIN_HISTORY, order: str = "date", **more) -> Report:
    """Recompute ``feature`` on histories cut at several labels and gather every disagreement."""
    if cuts is None:
        labels = labels_of(data, order)
        numbers = checkpoints(labels.count(), min_history)
        ordered = [r[0] for r in labels.orderBy(order).limit(max(numbers)).collect()]  # the calendar's dates
        cuts = [ordered[n - 1] for n in numbers]
    parts = [disagreements(feature, data, last, order=order, **more).withColumn("checkpoint", F.lit(last)) for last in cuts]
    cells = parts[0]
    for p in parts[1:]:
        cells = cells.unionByName(p)
    totals = cells.agg(F.count_if(F.col("kind").isin("same", "differs")).alias("n"), F.count_if(F.col("kind") != "same").alias("bad")).first()
    return Report(name, list(cuts), totals["n"], cells.filter("kind <> 'same'"), totals["bad"])


def require_causal(feature: Feature, data: Inputs, name: str = "feature", **more) -> Report:
    """``check``, raising with the earliest disagreements."""
    report = check(feature, data, name, **more)
    if not report.passed:
        first = [r.asDict() for r in report.failures.orderBy("checkpoint", more.get("order", "date")).limit(5).collect()]
        raise LeakageError(f"{name} looks ahead: {report.n_failures} disagreements, {report.n_compared} cells compared; first: {first}")
    return report
