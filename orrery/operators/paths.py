"""Light curves to paths: normalisation, path kinds and causal channels.

Observations are rows (oid, band, t, mag, tie); tie orders equal times. Channels are columns; nothing is collected by key.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import stage
from .runs import affine_scan, in_order, pieces

ORDER = ("t", "tie")
NORMALISATIONS = ("unit_time", "raw_time", "raw")


def normalise(obs: DataFrame, keys: Sequence[str], how: str = "unit_time") -> DataFrame:
    """Adds ct (time from the first point; in unit_time over the span, 0 for no span) and cm (mag less its median; in raw as it is)."""
    if how not in NORMALISATIONS:
        raise ValueError(f"normalisation must be one of {NORMALISATIONS}")
    w = Window.partitionBy(*keys)
    since = F.col("t") - F.min("t").over(w)
    span = F.max("t").over(w) - F.min("t").over(w)
    time = F.when(span > 0, since / span).otherwise(0.0) if how == "unit_time" else since
    mag = F.col("mag") if how == "raw" else F.col("mag") - F.percentile("mag", F.lit(0.5)).over(w)
    return obs.withColumns({"ct": time, "cm": mag})


def interleaved(obs: DataFrame, bands: Sequence[str], how: str = "unit_time") -> DataFrame:
    """One path per object over all bands, with the band's number as a third channel cb."""
    kept = obs.where(F.col("band").isin(*bands))
    number = F.array_position(F.array(*[F.lit(b) for b in bands]), F.col("band")) - 1
    return normalise(kept, ["oid"], how).withColumn("cb", number.cast("double"))


def joint_ffill(obs: DataFrame, bands: Sequence[str], how: str = "unit_time") -> DataFrame:
    """(oid, t, ct, c_<band>...): every band's value carried forward onto the union of times.

    Before a band's first observation its first value stands; a band without observations is 0. Of equal times in a
    band the last observation stands.
    """
    kept = obs.where(F.col("band").isin(*bands))
    centre = Window.partitionBy("oid", "band")
    value = F.col("mag") if how == "raw" else F.col("mag") - F.percentile("mag", F.lit(0.5)).over(centre)
    kept = kept.withColumn("v", value)
    at = kept.groupBy("oid", "t").agg(*[F.max_by("v", F.when(F.col("band") == b, F.col("tie"))).alias(f"v_{b}") for b in bands])
    w = Window.partitionBy("oid").orderBy("t")
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    ahead = w.rowsBetween(0, Window.unboundedFollowing)
    filled = {f"c_{b}": F.coalesce(F.last(f"v_{b}", ignorenulls=True).over(back), F.first(f"v_{b}", ignorenulls=True).over(ahead), F.lit(0.0)) for b in bands}
    whole = Window.partitionBy("oid")
    since, span = F.col("t") - F.min("t").over(whole), F.max("t").over(whole) - F.min("t").over(whole)
    time = F.when(span > 0, since / span).otherwise(0.0) if how == "unit_time" else since
    return at.withColumns({**filled, "ct": time}).select("oid", "t", "ct", *[f"c_{b}" for b in bands])


# --- causal channels --------------------------------------------------------------------------------


def _window(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def unit_index(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ORDER) -> DataFrame:
    """Adds u: the point's place from 0 to 1."""
    n = F.count("*").over(Window.partitionBy(*keys))
    return df.withColumn("u", F.when(n > 1, (F.row_number().over(_window(keys, order)) - 1) / (n - 1)).otherwise(0.0))


def cumulative_sum(df: DataFrame, column: str, keys: Sequence[str], order: Sequence[str] = ORDER, out: str = "cum") -> DataFrame:
    return df.withColumn(out, F.sum(column).over(_window(keys, order).rowsBetween(Window.unboundedPreceding, 0)))


def cumulative_integral(df: DataFrame, keys: Sequence[str], t: str = "t", m: str = "mag", order: Sequence[str] = ORDER) -> DataFrame:
    """Adds integral: the trapezoid integral of m over t from the first point."""
    w = _window(keys, order)
    area = 0.5 * (F.col(m) + F.lag(m).over(w)) * (F.col(t) - F.lag(t).over(w))
    part = df.withColumn("_area", F.coalesce(area, F.lit(0.0)))
    return part.withColumn("integral", F.sum("_area").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_area")


def running_max(df: DataFrame, keys: Sequence[str], m: str = "mag", order: Sequence[str] = ORDER) -> DataFrame:
    return df.withColumn("running", F.max(m).over(_window(keys, order).rowsBetween(Window.unboundedPreceding, 0)))


def ewma(df: DataFrame, tau: float, keys: Sequence[str], t: str = "t", m: str = "mag", parts: int | None = None) -> DataFrame:
    """(keys, tie, ewma): y = a y' + (1 - a) m with a = exp(-dt / tau), over each key's points in order; the first y is m.

    A scan in two levels over the affine maps y' -> a y' + (1 - a) m. Rows are sorted over all tasks by key and order; a task scans its
    batches, and knows all but the value at its first row if that row's key began in a task before. Those values, one for each task,
    follow from the tasks' ends in turn. No key is collected, and no term grows with a path's length.
    """
    keys = list(keys)
    rows = in_order(df.select(*keys, F.col(t).cast("double").alias("_t"), "tie", F.col(m).cast("double").alias("_m")), keys, ["_t", "tie"], parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, runs, at = TaskContext.get().partitionId(), 0, 0
        before = (0.0, 0.0, 0.0)  # time and map (from the value at the run's first row) of the row before
        for piece, fresh in pieces(batches, keys):
            times, value = (piece.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("_t", "_m"))
            runs += fresh
            last = times[0] if fresh else before[0]
            keep = np.exp((np.concatenate([[last], times[:-1]]) - times) / tau)
            gain = (1.0 - keep) * value
            if fresh:  # the first row's value stands for itself: unknown in a task's first run, m in the others
                keep[0], gain[0] = (1.0, 0.0) if runs == 1 else (0.0, value[0])
            scale, shift = affine_scan(keep, gain)
            if not fresh:
                scale, shift = scale * before[1], scale * before[2] + shift
            before = (times[-1], scale[-1], shift[-1])
            n = len(piece)
            more = [pa.array(scale), pa.array(shift), pa.array(np.full(n, task)), pa.array(np.arange(at, at + n))]
            at += n
            yield pa.RecordBatch.from_arrays([*piece.columns, *more], names=[*piece.schema.names, "_a", "_b", "_task", "_at"])

    kinds = ", ".join(f"`{c}` {k}" for c, k in rows.dtypes)
    scanned = stage(rows.mapInArrow(run, f"{kinds}, _a double, _b double, _task bigint, _at bigint"), "ewma")
    row = F.struct(F.struct(*keys).alias("key"), "_t", "_m", "_a", "_b")
    ends = scanned.groupBy("_task").agg(F.min_by(row, "_at").alias("first"), F.max_by(row, "_at").alias("last")).orderBy("_task")
    start, carry = [], None
    for r in ends.collect():  # a row for each task of the sort
        first, last = r["first"], r["last"]
        y = first._m
        if carry is not None and carry[0] == first.key:
            a = math.exp((carry[1] - first._t) / tau)
            y = a * carry[2] + (1.0 - a) * first._m
        start.append((r._task, y))
        carry = (last.key, last._t, last._a * y + last._b)
    known = df.sparkSession.createDataFrame(start, "_task bigint, _y double")
    return scanned.join(F.broadcast(known), "_task").select(*keys, "tie", (F.col("_a") * F.col("_y") + F.col("_b")).alias("ewma"))


def _bracket(df: DataFrame, keys: Sequence[str], at: str, value: str) -> DataFrame:
    """For rows of queries (value null) among samples: the sample at or before and the one after, on the axis at."""
    sample = F.when(F.col("_sample"), F.struct(F.col(at).alias("t"), F.col(value).alias("v")))
    w = Window.partitionBy(*keys).orderBy(at, F.when(F.col("_sample"), 0).otherwise(1), "tie")
    before = F.last(sample, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(sample, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumns({"_lo": before, "_hi": after})


def _between(at: str):
    lo, hi = F.col("_lo"), F.col("_hi")
    span = hi["t"] - lo["t"]
    inside = F.when(span > 0, lo["v"] + (hi["v"] - lo["v"]) * (F.col(at) - lo["t"]) / F.when(span > 0, span)).otherwise(lo["v"])
    return F.when(lo.isNull(), hi["v"]).when(hi.isNull(), lo["v"]).otherwise(inside)


def delayed(df: DataFrame, tau: float, keys: Sequence[str], t: str = "t", m: str = "mag") -> DataFrame:
    """(keys, t, tie, delayed): m at t - tau by linear interpolation, held at the ends."""
    flat = df.select(*keys, F.col(t).alias("t0"), "tie", F.col(m).alias("m"))
    kind = F.explode(F.array(F.lit(True), F.lit(False))).alias("_sample")
    both = flat.select("*", kind).withColumn("x", F.when(F.col("_sample"), F.col("t0")).otherwise(F.col("t0") - tau))
    done = _bracket(both, keys, "x", "m").where("not _sample")
    return done.select(*keys, F.col("t0").alias("t"), "tie", _between("x").alias("delayed"))


def interpolated_panel(obs: DataFrame, bands: Sequence[str], points: int = 64) -> DataFrame:
    """(oid, band, grid_i, value): median-centred magnitudes on an even grid over each band's time range.

    A band of fewer than two observations is 0 at every grid point, as is one that an object lacks.
    """
    kept = obs.where(F.col("band").isin(*bands))
    kept = kept.withColumn("v", F.col("mag") - F.percentile("mag", F.lit(0.5)).over(Window.partitionBy("oid", "band")))
    each = kept.groupBy("oid", "band").agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.count("*").alias("n"))
    objects = each.select("oid").distinct().withColumn("band", F.explode(F.array(*[F.lit(b) for b in bands])))
    step = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("grid_i")
    grid = objects.join(each.where("n >= 2"), ["oid", "band"], "left").select("oid", "band", "lo", "hi", step)
    grid = grid.withColumn("x", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("grid_i") / (points - 1))
    samples = kept.join(each.where("n >= 2").select("oid", "band"), ["oid", "band"], "left_semi")
    samples = samples.select("oid", "band", F.col("t").alias("x"), "v", "tie", F.lit(None).cast("int").alias("grid_i"), F.lit(True).alias("_sample"))
    asked = grid.select("oid", "band", "x", F.lit(None).cast("double").alias("v"), F.lit(None).cast("bigint").alias("tie"), "grid_i", F.lit(False).alias("_sample"))
    done = _bracket(samples.unionByName(asked), ["oid", "band"], "x", "v").where("not _sample")
    return done.select("oid", "band", F.col("grid_i").cast("bigint").alias("grid_i"), F.coalesce(_between("x"), F.lit(0.0)).alias("value"))
