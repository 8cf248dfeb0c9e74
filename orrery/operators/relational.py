"""Cuts, reshaping, sampling, manifests and joins around the analytic tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import is_finite
from ..staging import stage

MAG_ERROR = 1.0857362  # magnitudes per unit of relative flux error
EPOCH_OFFSET = 55197.0  # days
TRUE_WORDS = ("true", "1", "t")


def running_condition(cuts: Sequence[tuple[str, Column]]) -> list[tuple[str, Column, Column]]:
    """(name, passed all cuts before, passed this one too) of each cut; a null condition fails."""
    out, before = [], F.lit(True)
    for name, condition in cuts:
        after = before & F.coalesce(condition, F.lit(False))
        out.append((name, before, after))
        before = after
    return out


def apply_cuts(df: DataFrame, cuts: Sequence[tuple[str, Column]]) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, [F.coalesce(c, F.lit(False)) for _, c in cuts], F.lit(True)))


def cut_waterfall(df: DataFrame, cuts: Sequence[tuple[str, Column]]) -> DataFrame:
    """(step, cut, removed, remaining): what each cut takes of what those before it left, in one pass over the data."""
    parts = running_condition(cuts)
    counts = [F.count_if(before & ~after).alias(f"r{i}") for i, (_, before, after) in enumerate(parts)]
    left = [F.count_if(after).alias(f"l{i}") for i, (_, _, after) in enumerate(parts)]
    row = df.agg(*counts, *left)
    steps = F.array(*[F.struct(F.lit(i + 1).cast("bigint").alias("step"), F.lit(n).alias("cut"), F.col(f"r{i}").alias("removed"), F.col(f"l{i}").alias("remaining")) for i, (n, _, _) in enumerate(parts)])
    return row.select(F.inline(steps))


def unpivot_bands(wide: DataFrame, key: str, bands: dict[str, dict[str, str]]) -> DataFrame:
    """(key, band, t, mag, flux, snr, reject): a row for each band of a row; bands maps a band to its columns by role.

    A missing role is null. One pass: an array of structs is inlined.
    """
    kinds = {"t": "double", "mag": "double", "flux": "double", "snr": "double", "reject": "string"}
    part = lambda band, of: F.struct(F.lit(band).alias("band"), *[(F.expr(f"try_cast({of[r]} as {k})") if of.get(r) else F.lit(None).cast(k)).alias(r) for r, k in kinds.items()])
    return wide.select(key, F.inline(F.array(*[part(b, of) for b, of in bands.items()])))


def transit_cuts() -> list[tuple[str, Column]]:
    rejected = F.coalesce(F.lower(F.trim("reject")).isin(*TRUE_WORDS), F.lit(False))
    return [("not_finite", is_finite(F.col("t")) & is_finite(F.col("mag")) & is_finite(F.col("flux"))), ("rejected", ~rejected), ("snr", F.col("snr") > 0)]


def to_photometry(long: DataFrame, key: str) -> DataFrame:
    """Rows that pass the transit cuts, with mjd and magerr derived."""
    kept = apply_cuts(long, transit_cuts())
    return kept.select(key, "band", (F.col("t") + EPOCH_OFFSET).alias("mjd"), "mag", (MAG_ERROR / F.col("snr")).alias("magerr"), "flux")


def within_range(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """One row: lowest and highest value, and whether all lie strictly between the bounds."""
    a = df.agg(F.min(column).alias("lowest"), F.max(column).alias("highest"))
    return a.withColumn("inside", (F.col("lowest") > low) & (F.col("highest") < high))


def band_counts(obs: DataFrame, bands: Sequence[str]) -> DataFrame:
    """(oid, n, n_<band>...): 0 for a missing band."""
    return obs.groupBy("oid").agg(F.count("*").alias("n"), *[F.count_if(F.col("band") == b).alias(f"n_{b}") for b in bands])


def quality_cut(obs: DataFrame, bands: Sequence[str], total: int, each: int) -> DataFrame:
    """Observations of objects with enough of them, in all and in each band."""
    enough = reduce(lambda a, b: a & b, [F.col(f"n_{b}") >= each for b in bands], F.col("n") >= total)
    return obs.join(band_counts(obs, bands).where(enough).select("oid"), "oid", "left_semi")


def manifest(obs: DataFrame) -> DataFrame:
    """(oid, label, n_obs, t_span)."""
    return obs.groupBy("oid").agg(F.min("label").alias("label"), F.count("*").alias("n_obs"), F.round(F.max("t") - F.min("t"), 3).alias("t_span"))


def hash_order(seed: int | str, *keys: str) -> Column:
    """A pseudorandom order by key that other engines can repeat: MD5 of seed and keys."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def stratified_cap(df: DataFrame, by: str, key: str, cap: int, seed: int) -> DataFrame:
    """At most cap rows of each class, by hash order; with order, the place in a shuffle of all kept rows."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(hash_order(seed, key), key)))
    return ranked.where(F.col("rank") <= cap)


def sample_rows(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement, the first by hash order (a top-n, not a sort)."""
    return df.withColumn("_h", hash_order(seed, key)).orderBy("_h", key).limit(n).drop("_h")


def sample_with_replacement(df: DataFrame, key: str, n: int, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """n draws of each group, a row number by hash for each; draw is its number. Rows are numbered in hash order, in two levels."""
    total = df.groupBy(*by).agg(F.count("*").alias("_n"))
    numbered = hash_ranks(df, hash_order(seed, key), by, "_i", [key])
    row = F.pmod(F.xxhash64(F.lit(seed), *by, "draw"), F.greatest("_n", F.lit(1)))
    draws = total.withColumn("draw", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))).select(*by, "draw", row.alias("_i"))
    return draws.join(numbered, [*by, "_i"]).drop("_i")


def thin_random(obs: DataFrame, fraction: float, seed: int, floor: int = 6) -> DataFrame:
    """Each (oid, band) keeps max(floor, round half even of n fraction) observations by hash order."""
    w = Window.partitionBy("oid", "band")
    rank = F.row_number().over(w.orderBy(hash_order(seed, "tie"), "tie"))
    n = F.count("*").over(w)
    marked = obs.withColumns({"_r": rank, "_k": F.greatest(F.lit(floor).cast("double"), F.bround(n * F.lit(fraction), 0))})
    return marked.where("_r <= _k").drop("_r", "_k")


def permute_columns(df: DataFrame, key: str, columns: Sequence[str], seed: int, within: Sequence[str] = ()) -> DataFrame:
    """Each column permuted by itself, within groups: values meet by rank of differing hash orders, ranked in two levels."""
    ranked = lambda part, salt: hash_ranks(part, hash_order(f"{seed}-{salt}", key), within, "_i", [key])
    df = stage(df.select(*dict.fromkeys([*within, key, *columns])), "rows")  # it is read twice for each column
    out = ranked(df.select(*within, key), "rows")
    for c in columns:
        out = out.join(ranked(df.select(*dict.fromkeys([*within, key, c])), c).select(*within, "_i", c), [*within, "_i"])
    return out.drop("_i")


def places(df: DataFrame, *order: Column | str, name: str = "place") -> DataFrame:
    """Adds each row's place, from 1, in the order of the whole table: a range sort, then the lengths of its tasks as offsets."""
    sort = [F.col(o) if isinstance(o, str) else o for o in order]
    ranged = df.repartitionByRange(*sort).sortWithinPartitions(*sort)
    ranged = stage(ranged.withColumns({"_task": F.spark_partition_id(), "_in": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "places")
    lengths = ranged.groupBy("_task").agg(F.count("*").alias("_n"))  # a row for each task of the sort
    before = lengths.select("_task", (F.sum("_n").over(Window.orderBy("_task")) - F.col("_n")).alias("_before"))
    return ranged.join(F.broadcast(before), "_task").withColumn(name, F.col("_before") + F.col("_in") + 1).drop("_task", "_in", "_before", "_n")


def hash_ranks(df: DataFrame, order: Column, by: Sequence[str], name: str, ties: Sequence[str], buckets: int = 256) -> DataFrame:
    """Adds each row's rank, from 0, by a hexadecimal hash within groups, in two levels.

    Rows are ranked within the first two digits of the hash; the counts of these buckets, of which a group has 256, give offsets. So
    a group of any size is many tasks. buckets may be 1, 16 or 256.
    """
    digits = {1: 0, 16: 1, 256: 2}[buckets]
    # windows normalise floating-point keys, so rows shuffled by such a column would be shuffled again; its text is the same key
    floats = [c for c, kind in df.dtypes if c in by and kind in ("float", "double")]
    own = {c: f"_k{i}" if c in floats else c for i, c in enumerate(by)}
    groups = list(own.values())
    bucketed = df.withColumns({"_b": F.substring(order, 1, digits)} | {own[c]: (F.col(c) + 0.0).cast("string") for c in floats})
    # the hash is made again after the shuffle, so that it needn't travel
    keyed = bucketed.repartition(*groups, "_b").withColumn("_h", order)
    inner = F.row_number().over(Window.partitionBy(*groups, "_b").orderBy("_h", *ties)) - 1
    counts = bucketed.groupBy(*groups, "_b").agg(F.count("*").alias("_n"))
    offsets = counts.select(*groups, "_b", (F.sum("_n").over(Window.partitionBy(*groups).orderBy("_b")) - F.col("_n")).alias("_before"))
    ranked = keyed.withColumn("_in", inner).alias("x")
    same = [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in [*groups, "_b"]]
    joined = ranked.join(offsets.alias("y"), same)
    return joined.select(*[F.col(f"x.{c}") for c in df.columns], (F.col("_before") + F.col("_in")).cast("bigint").alias(name))


def align(*frames: DataFrame, key: str = "oid") -> DataFrame:
    """Inner join of all frames on the key."""
    return reduce(lambda a, b: a.join(b, key), frames)


def top_share(df: DataFrame, by: Sequence[str], value: str, missing: str) -> DataFrame:
    """(by, value, n_value, share): the commonest value other than missing (ties: the least), and its share of all rows."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by)
    counts = counts.withColumn("total", F.sum("n").over(w))
    real = counts.where(F.col(value) != missing).withColumn("r", F.row_number().over(w.orderBy(F.desc("n"), value)))
    return real.where("r = 1").select(*by, value, F.col("n").alias("n_value"), (F.col("n") / F.col("total")).alias("share"))


def gap_histogram(obs: DataFrame, bins: int = 60, low: float = -5.0, high: float = 2.0) -> DataFrame:
    """(bin, n): log10 of positive gaps within (oid, band), in even bins; bin 0 and bins + 1 hold what lies outside."""
    w = Window.partitionBy("oid", "band").orderBy("t", "tie")
    gaps = obs.select((F.col("t") - F.lag("t").over(w)).alias("gap")).where("gap > 0")
    return gaps.groupBy(F.width_bucket(F.log10("gap"), F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))


def count_histogram(obs: DataFrame, by: Sequence[str], bins: int = 50) -> DataFrame:
    """(bin, n): groups by their number of rows, in even bins between the least and the most, the last bin closed."""
    counts = obs.groupBy(*by).agg(F.count("*").alias("_n"))
    whole = Window.partitionBy()
    ends = counts.groupBy("_n").agg(F.count("*").alias("_k")).withColumns({"_lo": F.min("_n").over(whole), "_hi": F.max("_n").over(whole)})
    place = F.floor((F.col("_n") - F.col("_lo")) * bins / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1)))
    return ends.groupBy(F.least(place, F.lit(bins - 1)).cast("bigint").alias("bin")).agg(F.sum("_k").alias("n"))


def thin_blocked(obs: DataFrame, fraction: float, seed: int, floor: int = 6) -> DataFrame:
    """Each (oid, band) loses its surplus in up to three contiguous runs of the observations then left; at least floor stay.

    Runs start at hash-derived places. What is removed depends on what was removed before, so a group is one Arrow call.
    """
    import numpy as np
    import pyarrow as pa

    def run(group: pa.Table) -> pa.Table:
        t = group.sort_by([("t", "ascending"), ("tie", "ascending")])
        n = len(t)
        keep = max(floor, round(n * fraction))
        left = np.arange(n)
        if keep < n:
            drop = n - keep
            blocks = max(1, min(3, drop // 3))
            rng = np.random.default_rng([seed, int(t.column("oid")[0].as_py()) % 2**32, *t.column("band")[0].as_py().encode()])
            for k in range(blocks):
                size = min(drop // blocks + (k < drop % blocks), len(left) - floor)
                if size <= 0:
                    break
                at = int(rng.integers(0, len(left) - size + 1))
                left = np.delete(left, slice(at, at + size))
        return t.take(pa.array(left))

    return obs.groupBy("oid", "band").applyInArrow(run, obs.schema)


def pivot_counts(df: DataFrame, key: str, column: str, values: Sequence[str]) -> DataFrame:
    """(key, value...): counts, 0 for none. The values are given, so the plan needs no pass to find them."""
    return df.groupBy(key).agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])


def retention(kept: DataFrame, full: DataFrame, label: str) -> DataFrame:
    """(label, share): rows kept over all rows of each class in both."""
    return kept.groupBy(label).agg(F.count("*").alias("k")).join(full.groupBy(label).agg(F.count("*").alias("n")), label).select(label, (F.col("k") / F.col("n")).alias("share"))


def first_of_each(df: DataFrame, family: str, score: str, key: str) -> DataFrame:
    """The row of the highest score of each family; ties by key."""
    w = Window.partitionBy(family).orderBy(F.desc(score), key)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def exemplar(counts: DataFrame, label: str, key: str, n: str) -> DataFrame:
    """(label, key): of each class the key whose n is nearest to the class's median; ties by key."""
    mid = counts.groupBy(label).agg(F.percentile(n, F.lit(0.5)).alias("m"))
    return counts.join(mid, label).groupBy(label).agg(F.min(F.struct(F.abs(F.col(n) - F.col("m")).alias("gap"), F.col(key).alias("k"))).alias("b")).select(label, F.col("b.k").alias(key))
