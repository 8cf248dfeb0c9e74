"""Convolution features of time series after the published MiniRocket transform (Dempster, Schmidt and Webb, 2021).

The 84 kernels of nine weights, three of which are 2 and the others -1, are dilated, convolved with the series, and each
response is summed up by the share of points above a bias. Biases are quantiles of responses on a bounded sample of series, so
the transform has two passes: fit (one small table on the driver) and apply (a map over objects).
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .relational import sample_rows

WEIGHTS = 9
HIGH = 3
#: Positions of the weights of 2 in each kernel.
KERNELS = np.array(list(itertools.combinations(range(WEIGHTS), HIGH)))
#: Series that biases are taken from, at most.
FIT_SERIES = 256


def dilations(length: int, features: int) -> tuple[np.ndarray, np.ndarray]:
    """Dilations, growing by powers of 2 up to the longest that fits, and how many features each kernel has at each."""
    each = max(1, features // len(KERNELS))
    most = min(each, 32)
    top = np.log2((length - 1) / (WEIGHTS - 1)) if length > WEIGHTS else 0.0
    values, counts = np.unique(np.floor(2.0 ** np.linspace(0, max(0.0, top), most)).astype(int), return_counts=True)
    counts = np.floor(counts * each / most).astype(int)
    for i in itertools.islice(itertools.cycle(range(len(counts))), int(each - counts.sum())):
        counts[i] += 1
    return values, counts


def responses(series: np.ndarray, kernel: np.ndarray, dilation: int) -> np.ndarray:
    """Responses of (..., length) series, padded with zeros: -1 times the sum of nine lagged copies, plus 3 times three of them."""
    length = series.shape[-1]
    reach = (WEIGHTS // 2) * dilation
    padded = np.concatenate([np.zeros((*series.shape[:-1], reach)), series, np.zeros((*series.shape[:-1], reach))], axis=-1)
    lag = lambda i: padded[..., i * dilation : i * dilation + length]
    return 3.0 * sum(lag(i) for i in kernel) - sum(lag(i) for i in range(WEIGHTS))


def plan(length: int, channels: int, features: int) -> list[tuple[int, int, int, np.ndarray]]:
    """(kernel, dilation, features, channels that it sums) of every kernel and dilation; channels by a fixed generator."""
    rng = np.random.default_rng(0)
    out = []
    for d, n in zip(*dilations(length, features), strict=True):
        for k in range(len(KERNELS)):
            most = min(channels, WEIGHTS)
            size = min(channels, int(2 ** rng.uniform(0, np.log2(most + 1))))
            out.append((k, int(d), int(n), rng.choice(channels, max(1, size), replace=False)))
    return out


def fit(series: np.ndarray, features: int) -> list[np.ndarray]:
    """Biases of each entry of the plan: quantiles, at multiples of the golden ratio modulo 1, of the responses of one series after another."""
    golden = (np.sqrt(5) + 1) / 2
    out, used = [], 0
    for i, (k, d, n, channels) in enumerate(plan(series.shape[2], series.shape[1], features)):
        one = responses(series[i % len(series)][channels], KERNELS[k], d).sum(0)
        out.append(np.quantile(one, np.arange(used + 1, used + n + 1) * golden % 1.0))
        used += n
    return out


def transform(series: np.ndarray, features: int, biases: list[np.ndarray]) -> np.ndarray:
    """(objects, features): shares of responses above the biases; every second kernel looks at points without padding only."""
    length, out = series.shape[2], []
    for i, ((k, d, _, channels), bias) in enumerate(zip(plan(length, series.shape[1], features), biases, strict=True)):
        found = responses(series[:, channels], KERNELS[k], d).sum(1)
        edge = (WEIGHTS // 2) * d
        if i % 2 and length > 2 * edge:
            found = found[:, edge : length - edge]
        out.append((found[:, :, None] > bias).mean(1))
    return np.concatenate(out, axis=1)


def kernel_features(panel: DataFrame, bands: Sequence[str], points: int, features: int = 9_996, seed: int = 0) -> DataFrame:
    """(oid, features array<double>) of each object's panel (oid, band, grid_i, value) of so many grid points.

    Objects are rows of one array for each band; biases are fitted on FIT_SERIES objects at most, the first by hash.
    """
    cells = F.array_sort(F.collect_list(F.struct("grid_i", "value")))
    lines = panel.groupBy("oid", "band").agg(F.transform(cells, lambda x: x["value"]).alias("line"))
    zeros = F.array_repeat(F.lit(0.0), points)
    rows = lines.groupBy("oid").agg(*[F.coalesce(F.max(F.when(F.col("band") == b, F.col("line"))), zeros).alias(f"b{i}") for i, b in enumerate(bands)])
    names = [f"b{i}" for i in range(len(bands))]
    sample = sample_rows(rows, "oid", FIT_SERIES, seed).orderBy("oid").collect()
    if not sample:
        return rows.select("oid", F.lit(None).cast("array<double>").alias("features")).limit(0)
    biases = fit(np.array([[r[n] for n in names] for r in sample], float).reshape(len(sample), len(bands), points), features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 64):
                part = batch.slice(i, 64)
                series = np.stack([part.column(n).flatten().to_numpy(zero_copy_only=False).reshape(len(part), points) for n in names], axis=1)
                found = transform(series, features, biases)
                yield pa.RecordBatch.from_arrays([part.column("oid"), pa.array(found.tolist(), pa.list_(pa.float64()))], names=["oid", "features"])

    return rows.mapInArrow(run, f"oid {dict(rows.dtypes)['oid']}, features array<double>")
