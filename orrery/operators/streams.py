"""Orbit streams: windows, thresholds, density-based consensus clusters, null models, excess and catalogue matching.

Neighbour searches are equi-joins. Every criterion bounds the differences of three elements: eccentricity, perihelion distance (as they are
or as ratios) and inclination. So orbits within eps of each other lie in the same or in neighbouring cells of a grid, and each
orbit is sent to its own cell and to half of the neighbours, so that cells meet once.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.orbits import CRITERIA, ELEMENTS, is_valid, orbit, parts, unwhiten, valsecchi, whiten
from ..functions.scalars import circular_difference, in_arc, separation, wrap
from ..staging import stage
from .relational import hash_order, permute_columns

def hop_windows(orbits: DataFrame, width: float, step: float) -> DataFrame:
    """A row for each window [start, start + width) on the circle, start a multiple of step, that holds the orbit."""
    reach = int(-(-width // step))
    # candidates are the starts at or before sol_lon; the range test settles the ends
    last = F.floor(F.col("sol_lon") / step)
    starts = F.transform(F.sequence(last - reach, last), lambda k: F.pmod(k * F.lit(float(step)), F.lit(360.0)))
    rows = orbits.withColumn("window_start", F.explode(F.array_distinct(starts)))
    return rows.where(in_arc(F.col("sol_lon"), F.col("window_start"), F.pmod(F.col("window_start") + width, F.lit(360.0))))


def _cells(eps: Column, criterion: str) -> dict[str, Column]:
    """Coordinates scaled so that orbits within eps differ by 1 at most; null where no other orbit can be within eps."""
    # |x1 - x2| <= eps (x1 + x2) as a difference of logarithms; from an eps of 1 on all are within it
    log_side = F.when(eps < 1, F.ln((1.0 + eps) / (1.0 - eps))).otherwise(F.lit(math.inf))
    ratio = lambda c: F.when(F.col(c) > 0, F.ln(c) / log_side).when(F.col(c) == 0, F.lit(-1e15))
    plane = 180.0 * eps if criterion == "d_d" else F.degrees(2 * F.asin(F.least(F.lit(1.0), eps / 2)))
    return {
        "cq": F.col("q") / eps if criterion == "d_sh" else ratio("q"),
        "ce": ratio("e") if criterion == "d_d" else F.col("e") / eps,
        "ci": F.col("i") / plane,
    }


#: Of the 26 neighbours of a cell the half that follows it, and the cell itself. A rule, not a choice: any half would do.
_HALF = [(x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1) if (x, y, z) >= (0, 0, 0)]


def _sound() -> Column:
    return reduce(and_, [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf)) for c in ELEMENTS])


def _poles() -> dict[str, Column]:
    """The pole of an orbit's plane."""
    i, n = F.radians("i"), F.radians("node")
    return {"px": F.sin(i) * F.sin(n), "py": -F.sin(i) * F.cos(n), "pz": F.cos(i)}


def _at_least(a: dict, b: dict, criterion: str) -> Column:
    """What the square of the distance is at least, by the terms that need no trigonometry. a, b: q, e and the pole of two orbits."""
    near = (2.0 - 2.0 * reduce(add, [a[c] * b[c] for c in ("px", "py", "pz")])) / (math.pi**2 if criterion == "d_d" else 1.0)
    for term in ("e", "q"):
        u, v = a[term], b[term]
        gap = u - v if criterion == "d_sh" or (criterion, term) == ("d_h", "e") else (u - v) / (u + v + 1e-9)
        near = near + gap * gap
    return near


def _reached(near: Column, radius: Column) -> Column:
    """False only where near, a bound of a squared distance, is beyond the radius; a little wider against rounding."""
    return near <= radius * radius * (1 + 1e-9) + 1e-12


#: Grids of windows whose radii differ by less than this power of 2 may be one.
STEP = 0.25
#: Rows of a cell that are one task's at most; a larger cell is split among several.
CELL = 256


def _told(pairs: DataFrame, criterion: str, a: dict, b: dict, most: Column, keep: Sequence[Column]) -> DataFrame:
    """keep and d, the distance of each pair, where it is most at most.

    Used twice in one projection, the distance is a method of its own in the code that Spark makes; within the join it would make one
    too long for the JVM to compile. A value that counts as not deterministic keeps the filter from going into the join.
    """
    d = CRITERIA[criterion](a, b)
    out = pairs.select(*keep, d.alias("d"), (d <= most).alias("_within"), F.spark_partition_id().alias("_at")).where("_within and _at >= 0")
    return out.drop("_within", "_at")


def _tasks(frame: DataFrame) -> int:
    spark = frame.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def _layers(rows: DataFrame, keys: Sequence[str]) -> tuple[Column, Column]:
    """(layer, width) of a row's grid: its key's own, or one that keys of similar _eps share.

    Where the same orbits are in many keys, one grid of the orbits meets each pair once instead of once for each key. Where most orbits
    are in few keys, it would meet pairs that no key has. The squares of the numbers of orbits tell which is less.
    """
    alone = F.xxhash64(*keys) if keys else F.lit(0).cast("bigint")
    level = F.floor(F.log2("_eps") / STEP)
    sizes = rows.groupBy(*keys, level.alias("_level")).agg(F.count("*").cast("double").alias("_n"), F.max("_eps").alias("_wide"))
    apart = sizes.groupBy("_level").agg(F.sum(F.col("_n") * F.col("_n")).alias("_apart"), F.max("_wide").alias("_wide"))
    whole = rows.select(level.alias("_level"), *ELEMENTS).distinct().groupBy("_level").agg(F.count("*").cast("double").alias("_all"))
    shared = {r._level: r._wide for r in apart.join(whole, "_level").collect() if r._all**2 < r._apart} if keys else {}
    if not shared:
        return alone, F.col("_eps")
    wide = F.try_element_at(F.create_map(*[F.lit(v) for pair in shared.items() for v in pair]), level)
    return F.when(wide.isNotNull(), F.xxhash64(F.lit("level"), level)).otherwise(alone), F.coalesce(wide, F.col("_eps"))


def _meet(rows: DataFrame, criterion: str, keys: Sequence[str], also: Sequence[str] = (), layers: tuple[Column, Column] | None = None) -> DataFrame:
    """Pairs of rows of a key within its _eps, each once, with the other columns as x and y, same and d; every row meets itself as well (same).

    A key has a row for each orbit, or for each orbit and also. Cells are of q and of the pole of the orbit's plane: the distance of two
    poles is the chord of the angle between the planes, which every criterion counts in full. So cells tell planes apart by node as
    well as by inclination. An orbit is one row of its layer's grid, with a map of its keys; pairs are told by distance first and by keys then.
    """
    rows = rows.where(_sound()).dropna(subset=list(keys))
    layer, wide = layers or _layers(rows, keys)
    rest = [c for c in rows.columns if c not in (*keys, *ELEMENTS)]
    key = F.col(keys[0]) if len(keys) == 1 else F.struct(*keys) if keys else F.lit(0)
    entry = F.struct(key.alias("key"), F.struct(*rest).alias("value"))
    laid = rows.select(layer.alias("_layer"), wide.alias("_wide"), *ELEMENTS, *[F.col(c).alias(f"_also_{c}") for c in also], entry.alias("_entry"))
    laid = laid.groupBy("_layer", "_wide", *ELEMENTS, *[f"_also_{c}" for c in also]).agg(F.map_from_entries(F.collect_list("_entry")).alias("_keys"))
    # both sides of the grid read the same tags
    laid = stage(laid.withColumn("_tag", F.monotonically_increasing_id()), "grid")
    eps = F.col("_wide")
    pole = _poles()
    chord = 2 * F.sin(F.least(F.lit(math.pi / 2), eps * (math.pi / 2))) if criterion == "d_d" else eps
    cells = _cells(eps, criterion)
    # a little wider than eps, so that rounding can't part two orbits by more than a cell
    scaled = {"cq": cells["cq"], "cx": pole["px"] / chord, "cy": pole["py"] / chord}
    scaled = {k: F.floor(v * (1 - 1e-9)).cast("bigint") for k, v in scaled.items()}
    told = parts(orbit(), criterion) | pole
    # never null: expressions of pairs are then short enough to be compiled
    sure = {k: F.coalesce(v, F.lit(0.0)) for k, v in (told | {"wide": eps}).items()}
    home = laid.where(cells["ce"].isNotNull() & cells["cq"].isNotNull())
    home = home.select("_layer", F.coalesce("_tag", F.lit(0)).alias("_tag"), "_keys", *[v.alias(f"_{k}") for k, v in sure.items()], *[v.alias(k) for k, v in scaled.items()])
    axes = ["_layer", *scaled]
    filled = home.groupBy(*axes).agg(F.ceil(F.count("*") / CELL).cast("int").alias("_parts"))
    steps = F.array(*[F.struct(*[F.lit(k).cast("bigint").alias(c) for c, k in zip(scaled, s, strict=True)]) for s in _HALF])
    around = home.withColumn("_step", F.explode(steps)).withColumns({c: F.col(c) + F.col(f"_step.{c}") for c in scaled})
    around = around.withColumn("_own", F.coalesce(reduce(and_, [F.col(f"_step.{c}") == 0 for c in scaled]), F.lit(False))).drop("_step")
    around = around.join(filled, axes).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    home = home.join(filled, axes).withColumn("_part", F.pmod(F.xxhash64("_tag"), F.col("_parts")).cast("int"))
    # a grid is small in bytes and long in work: it would else be merged into a few tasks
    around, home = (t.drop("_parts").repartition(_tasks(rows), *axes, "_part") for t in (around, home))
    x, y = home.alias("x"), around.alias("y")
    met = [F.col(f"x.{k}") == F.col(f"y.{k}") for k in [*axes, "_part"]]
    # the terms that need no trigonometry, before the whole distance
    side = lambda t, names: {c: F.col(f"{t}._{c}") for c in names}
    reached = _reached(_at_least(*[side(t, ("e", "q", *pole)) for t in "xy"], criterion), F.col("x._wide"))
    out = x.hint("merge").join(y, met).where((~F.col("y._own") | (F.col("x._tag") <= F.col("y._tag"))) & reached)
    keep = [(F.col("x._tag") == F.col("y._tag")).alias("same"), F.col("x._keys").alias("_of_x"), F.col("y._keys").alias("_of_y")]
    out = _told(out, criterion, side("x", told), side("y", told), F.col("x._wide"), keep)
    out = out.select("same", "d", "_of_y", F.explode("_of_x").alias("_key", "_x"))
    out = out.withColumn("_y", F.try_element_at("_of_y", F.col("_key"))).where(F.col("_y").isNotNull() & (F.col("d") <= F.col("_x._eps")))
    of = [F.col("_key").alias(k) for k in keys] if len(keys) == 1 else [F.col(f"_key.{k}").alias(k) for k in keys]
    return out.select(*of, F.col("_x._eps").alias("_eps"), *[F.col(f"_{t}.{c}").alias(f"{c}_{t}") for t in "xy" for c in rest if c != "_eps"], "same", "d")


#: Orbits of equal elements whose pairs are put out by one task at most, on either side.
COPIES = 1000


def close_pairs(orbits: DataFrame, eps: float | str, criterion: str = "d_sh", by: Sequence[str] = ()) -> DataFrame:
    """(by, a, b, d) of pairs a < b within eps (inclusive), each once, by grid cells.

    eps is a number, or the name of a column that is the same for all orbits of a key of by: each key then has a grid of its own
    width. Where it is null or not positive there are no pairs.
    Orbits with a null or non-finite element have no neighbours. Of d_d and d_h so have those with a negative q or e.
    Orbits of equal elements are one row in the grid, with an array of their ids. Cells are
    spread over a fixed number of tasks; a large cell is one task's.
    """
    rows = _within(orbits, eps).where(_sound()).select(*by, "_eps", "traj_id", *ELEMENTS)
    shares = F.ceil(F.count("*").over(Window.partitionBy(*by, *ELEMENTS)) / COPIES)
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("traj_id"), shares)).groupBy(*by, "_eps", *ELEMENTS, "_part").agg(F.collect_list("traj_id").alias("ids"))
    met = _meet(stage(rows, "orbits"), criterion, by, ["_part"]).where(~F.col("same") | (F.size("ids_x") > 1))
    met = met.select(*by, "same", "d", "ids_y", F.explode("ids_x").alias("_a")).select(*by, "same", "d", "_a", F.explode("ids_y").alias("_b"))
    met = met.where((F.col("_a") != F.col("_b")) & (~F.col("same") | (F.col("_a") < F.col("_b"))))
    return met.select(*by, F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"), "d")


def _within(orbits: DataFrame, eps: float | str) -> DataFrame:
    """orbits with _eps, where it is positive."""
    if not isinstance(eps, str) and eps <= 0:
        raise ValueError("eps must be positive")
    width = F.col(eps) if isinstance(eps, str) else F.lit(float(eps))
    return orbits.withColumn("_eps", width.cast("double")).where("_eps > 0")


def neighbour_pairs(orbits: DataFrame, eps: float | str, criterion: str = "d_sh", by: Sequence[str] = ()) -> DataFrame:
    """(by, a, b, d) of ordered pairs a <> b within eps (inclusive): both orders of close_pairs."""
    both = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    return close_pairs(orbits, eps, criterion, by).select(*by, both.alias("_p"), "d").select(*by, "_p.a", "_p.b", "d")


def close_invariants(radiants: DataFrame, eps: float) -> DataFrame:
    """(a, b, d) of pairs a < b within eps by the geocentric criterion with unit weights, by grid cells of (u, phi, lam).

    radiants: traj_id, u, cos_theta, phi, lam. Neither |u1 - u2| nor the difference of the cosines exceeds the distance. Nor does the chord
    of either angle's difference, or of both turned by 180 degrees: so cells of the angles are of a half circle, which closes.
    """
    columns = ["traj_id", "u", "cos_theta", "phi", "lam"]
    # angles whose chords are within eps differ by this at most; cells of the half circle are that wide or a little more
    arc = math.degrees(2 * math.asin(min(1.0, eps / 2))) * (1 + 1e-9)
    count = max(1, int(180 / arc))
    ring = lambda c: F.least(F.floor(F.pmod(F.col(c), F.lit(180.0)) * (count / 180.0)), F.lit(count - 1)).cast("bigint")
    places = {"cu": F.floor(F.col("u") / eps * (1 - 1e-9)).cast("bigint"), "cp": ring("phi"), "cl": ring("lam")}
    home = radiants.dropna(subset=columns).select(*columns, *[v.alias(k) for k, v in places.items()])
    if count >= 3:
        steps = _HALF
    else:
        # of fewer cells than three a cell's two neighbours are one: angles are then not told apart
        home, steps = home.withColumns({"cp": F.lit(0).cast("bigint"), "cl": F.lit(0).cast("bigint")}), [(0, 0, 0), (1, 0, 0)]
    steps = F.array(*[F.struct(*[F.lit(k).cast("bigint").alias(c) for c, k in zip(places, step, strict=True)]) for step in steps])
    next_to = {c: F.col(c) + F.col(f"_step.{c}") for c in places}
    moved = {c: v if c == "cu" else F.pmod(v, F.lit(count)) for c, v in next_to.items()}
    around = home.withColumn("_step", F.explode(steps)).withColumns(moved)
    around = around.withColumn("_own", reduce(and_, [F.col(f"_step.{c}") == 0 for c in places])).drop("_step")
    x, y = home.alias("x"), around.alias("y")
    side = lambda n: {c: F.col(f"{n}.{c}") for c in columns[1:]}
    ids = (F.col("x.traj_id"), F.col("y.traj_id"))
    near = (F.abs(F.col("x.u") - F.col("y.u")) <= eps) & (F.abs(F.col("x.cos_theta") - F.col("y.cos_theta")) <= eps)
    out = x.join(y, [F.col(f"x.{k}") == F.col(f"y.{k}") for k in places]).where((~F.col("y._own") | (ids[0] < ids[1])) & (ids[0] != ids[1]) & near)
    return out.select(F.least(*ids).alias("a"), F.greatest(*ids).alias("b"), valsecchi(side("x"), side("y")).alias("d")).where(F.col("d") <= eps)


#: Orbits of a null whose pairs give a first guess of its quantile, and by how much the bracket's ranks differ from the rank sought.
GUESS_ORBITS = 1000
GUESS_RATIO = 1.3
#: Parts of a bracket whose pairs are counted before any are sorted.
BINS = 4096
#: Up to about so many pairs under the quantile, those of the bracket are sorted at once.
SORTED = 10_000_000


def threshold(null: DataFrame, rate: float, criterion: str, by: Sequence[str], least: int = 50, most: int | None = None, seed: int = 0) -> DataFrame:
    """(by, eps): the distance that a share rate of a null's pairs fall under; null for groups of fewer than least sound orbits.

    The exact quantile over all pairs of a group, between neighbouring ranks by linear interpolation, without the triangle of pairs. A sample
    of bounded size brackets it; of the pairs within the bracket's upper end, by grid cells, those below the lower end are counted and
    the others sorted. Where the bracket misses it grows, for those groups alone. Orbits of equal elements are one, with their number as
    its weight. With most, a group is its first most orbits in hash order.
    """
    keys = list(by)
    rows = null.where(_sound()).select(*keys, "traj_id", *ELEMENTS)
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(hash_order(seed, "traj_id"), "traj_id")))
    rows = stage(ranked if most is None else ranked.where(F.col("_r") <= most), "null")
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    # places of the quantile among the sorted distances, from 0
    last = F.col("_n") * (F.col("_n") - 1) / 2 - 1
    sought = stage(sizes.select(*keys, "_n", (last * rate).alias("_at"), F.floor(last * rate).cast("bigint").alias("_lo"), F.ceil(last * rate).cast("bigint").alias("_hi")), "ranks")

    told = parts(orbit(), criterion)
    few = rows.where(F.col("_r") <= GUESS_ORBITS).join(sizes.select(*keys), keys, "left_semi").select(*keys, "traj_id", *[F.coalesce(v, F.lit(0.0)).alias(f"_{k}") for k, v in told.items()])
    # small in bytes and long in work, as in a grid: a group's triangle is several tasks'
    spread = lambda t: t.repartition(_tasks(t), *keys, "_part").alias
    x = spread(few.withColumn("_part", F.pmod(F.xxhash64("traj_id"), F.lit(8)).cast("int")))("x")
    y = spread(few.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(7)))))("y")
    same = [F.col(f"x.{k}") == F.col(f"y.{k}") for k in [*keys, "_part"]]
    a, b = ({c: F.col(f"{t}._{c}") for c in told} for t in "xy")
    some = _told(x.hint("merge").join(y, [*same, F.col("x.traj_id") < F.col("y.traj_id")]), criterion, a, b, F.lit(math.inf), [F.col(f"x.{k}") for k in keys])
    # of few distances the quantile is next to the smallest: at least the tenth is taken, and none left out below
    few_below = rate * GUESS_ORBITS**2 / 2 < 50
    # a sketch's ranks are off by a few in 100,000, which the bracket allows for
    ends = F.percentile_approx("d", F.array(F.lit(min(1.0, GUESS_RATIO * rate)), F.lit(min(1.0, 20 / GUESS_ORBITS**2)), F.lit(rate / GUESS_RATIO)), 100_000)
    guess = some.groupBy(*keys).agg(ends.alias("_g"))
    reach, floor = F.greatest(F.get("_g", F.lit(0)), F.get("_g", F.lit(1)), F.lit(1e-6)) * (1 + 1e-6), F.lit(0.0) if few_below else F.get("_g", F.lit(2)) * (1 - 1e-6)
    todo = stage(sought.join(guess, keys).select(*sought.columns, reach.alias("_eps"), floor.alias("_floor")), "guess")
    once = stage(rows.groupBy(*keys, *ELEMENTS).agg(F.count("*").alias("_w")), "once")
    many = (sought.agg(F.sum(F.col("_n") * F.col("_n"))).first()[0] or 0) * rate > SORTED
    out = None
    while True:
        if many:
            # counts by bin narrow the bracket to the bins that hold the ranks; only distances within those are sorted
            near = _weighed(once, todo, criterion, keys)
            share = (F.col("d") - F.col("_floor_x")) / F.greatest(F.col("_eps") - F.col("_floor_x"), F.lit(1e-300))
            slot = F.when(F.col("d") >= F.col("_floor_x"), F.least(F.floor(share * BINS), F.lit(BINS - 1))).otherwise(-1)
            slots = _ranked(near.groupBy(*keys, slot.alias("_bin")).agg(F.sum("_c").alias("_c")), "_bin", keys).join(todo, keys)
            held = lambda r: F.max(F.when((F.col("_from") <= F.col(r)) & (F.col(r) < F.col("_to")), F.col("_bin")))
            slots = slots.groupBy(*keys).agg(held("_lo").alias("_a"), held("_hi").alias("_b"))
            edge = lambda k: F.col("_floor") + (F.col("_eps") - F.col("_floor")) * (k / BINS)
            low = F.when(F.col("_a") >= 0, edge(F.col("_a")) * (1 - 1e-9)).when(F.col("_a") < 0, F.lit(0.0)).otherwise(F.col("_floor"))
            high = F.when(F.col("_b") >= 0, F.least(edge(F.col("_b") + 1) * (1 + 1e-9), F.col("_eps"))).otherwise(F.col("_eps"))
            todo = stage(todo.join(slots, keys, "left").select(*sought.columns, high.alias("_eps"), low.alias("_floor")), "bracket")

        near = _weighed(once, todo, criterion, keys)
        # distances below the bracket are told as null, so that a task sends one count for all of them
        tally = near.groupBy(*keys, F.when(F.col("d") >= F.col("_floor_x"), F.col("d")).alias("_d")).agg(F.sum("_c").alias("_c"))
        told = _ranked(tally, "_d", keys).join(todo.drop("_eps", "_floor"), keys)
        at = lambda r: F.max(F.when((F.col("_from") <= F.col(r)) & (F.col(r) < F.col("_to")), F.col("_d")))
        found = stage(told.groupBy(*keys).agg(at("_lo").alias("_a"), at("_hi").alias("_b"), F.max(F.col("_at") - F.col("_lo")).alias("_f"), F.max("_to").alias("_to")), "found")
        done = found.where("_a is not null and _b is not null").select(*keys, (F.col("_a") + F.col("_f") * (F.col("_b") - F.col("_a"))).alias("eps"))
        out = done if out is None else out.unionByName(done)
        # what isn't found lies above the bracket, or below it
        rest = todo.join(done.select(*keys), keys, "left_anti").join(found.select(*keys, "_to"), keys, "left")
        grown = F.when(F.coalesce("_to", F.lit(0)) <= F.col("_hi"), F.col("_eps") * 1.6).otherwise(F.col("_eps"))
        short = stage(rest.select(*sought.columns, grown.alias("_eps"), F.when(F.coalesce("_to", F.lit(0)) <= F.col("_lo"), F.col("_floor")).otherwise(0.0).alias("_floor")), "guess")
        if short.isEmpty():
            return null.select(*keys).distinct().join(out, keys, "left")
        todo = short


def _weighed(once: DataFrame, todo: DataFrame, criterion: str, keys: Sequence[str]) -> DataFrame:
    """Pairs of the orbits of once within each key's _eps, with _c, the number of pairs of copies that they stand for."""
    near = _meet(once.join(todo.select(*keys, "_eps", "_floor"), list(keys)), criterion, keys)
    weight = F.when(F.col("same"), F.expr("_w_x * (_w_x - 1) div 2")).otherwise(F.col("_w_x") * F.col("_w_y"))
    return near.withColumn("_c", weight).where("_c > 0")


def _ranked(tally: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """tally with _from and _to, the ranks from 0 of a value's first and past its last, nulls first."""
    upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy(F.asc_nulls_first(value)))
    return tally.withColumn("_to", upto).withColumn("_from", F.col("_to") - F.col("_c"))


def connected(edges: DataFrame, nodes: DataFrame, by: Sequence[str] = (), rounds: int = 50) -> DataFrame:
    """(by, node, component): the smallest node that each reaches, for undirected edges (by, a, b).

    In each round every node points to its smallest neighbour, if that is smaller than itself; pointers are followed to their ends, and
    edges are put between the ends. So a component halves at least, and a dense one is gone after a round or two: what is left of
    its edges are few. Each round is written to the shared folder.
    """
    keys = list(by)
    labels = stage(nodes.select(*keys, "node", F.col("node").alias("component")))
    edges = edges.select(*keys, "a", "b").where("a <> b")
    for _ in range(rounds):
        both = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
        least = edges.select(*keys, both.alias("_e")).groupBy(*keys, F.col("_e.a").alias("node")).agg(F.min("_e.b").alias("_m"))
        up = _followed(stage(least.select(*keys, "node", F.least("node", "_m").alias("top"))), keys, rounds)
        labels = stage(labels.join(up.select(*keys, F.col("node").alias("component"), "top"), [*keys, "component"], "left").select(*keys, "node", F.coalesce("top", "component").alias("component")))
        of = lambda e: up.select(*keys, F.col("node").alias(e), F.col("top").alias(f"_{e}"))  # noqa: B023, E731
        edges = edges.join(of("a"), [*keys, "a"]).join(of("b"), [*keys, "b"]).where("_a <> _b")
        edges = stage(edges.select(*keys, F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct())
        if edges.isEmpty():
            return labels
    raise RuntimeError("components did not settle")


def _followed(up: DataFrame, keys: Sequence[str], rounds: int = 50) -> DataFrame:
    """up (keys, node, top), staged, with each top replaced by the end of its own pointers."""
    for _ in range(rounds):
        next_up = up.select(*keys, F.col("node").alias("top"), F.col("top").alias("further"))
        jumped = stage(up.join(next_up, [*keys, "top"], "left").select(*keys, "node", F.col("top").alias("old"), F.coalesce("further", "top").alias("top")))
        if jumped.where("top <> old").isEmpty():
            return jumped.drop("old")
        up = jumped.drop("old")
    raise RuntimeError("components did not settle")


def dbscan(orbits: DataFrame, eps: float | str, least: int, criterion: str = "d_sh", by: Sequence[str] = ()) -> DataFrame:
    """(by, traj_id, core, cluster): cluster is the smallest core member's id, null for noise.

    eps is a number or a column, as in close_pairs. least counts the point itself. A border point joins the cluster with the smallest id among its core neighbours'.
    Orbits of equal elements are one node, named by the smallest id and weighing their number, so copies make no pairs.
    """
    keys = list(by)
    width = F.col(eps) if isinstance(eps, str) else F.lit(float(eps))
    own = CRITERIA[criterion](orbit(), orbit())
    # copies are neighbours where an orbit is within eps of itself
    alike = F.coalesce(_sound() & _cells(width.cast("double"), criterion)["ce"].isNotNull() & _cells(width.cast("double"), criterion)["cq"].isNotNull() & (width > 0) & (own <= width), F.lit(False))
    first = F.min("traj_id").over(Window.partitionBy(*keys, *ELEMENTS))
    rows = stage(orbits.withColumn("_head", F.when(alike, first).otherwise(F.col("traj_id"))), "nodes")
    once = stage(_within(rows, eps).groupBy(*keys, "_eps", "_head", *ELEMENTS).agg(F.count("*").alias("_w")), "once")
    # the grid is met three times, and its pairs, which may be many more than orbits, are counted where they arise and never written
    layers = _layers(once, keys)
    pairs = lambda t: _meet(t, criterion, keys, layers=layers).where("_head_x <> _head_y")
    ends = lambda p, x, y: p.select(*keys, F.explode(F.array(F.struct(*[F.col(c).alias(k) for k, c in x.items()]), F.struct(*[F.col(c).alias(k) for k, c in y.items()]))).alias("_e")).select(*keys, "_e.*")
    heard = ends(pairs(once), {"node": "_head_x", "_w": "_w_y"}, {"node": "_head_y", "_w": "_w_x"}).groupBy(*keys, "node").agg(F.sum("_w").alias("_w"))
    weights = heard.unionByName(rows.groupBy(*keys, F.col("_head").alias("node")).agg(F.count("*").alias("_w")))
    core = stage(weights.groupBy(*keys, "node").agg(F.sum("_w").alias("_w")).where(F.col("_w") >= least).select(*keys, "node"), "core")
    once = once.drop("_w").join(core.select(*keys, F.col("node").alias("_head"), F.lit(True).alias("_core")), [*keys, "_head"], "left").withColumn("_core", F.coalesce("_core", F.lit(False)))
    once = stage(once, "once")
    # a core orbit's smallest neighbour is in its cluster: pointers to it are followed to their ends, and pairs join those ends
    near = ends(pairs(once).where("_core_x and _core_y"), {"node": "_head_x", "_m": "_head_y"}, {"node": "_head_y", "_m": "_head_x"}).groupBy(*keys, "node").agg(F.min("_m").alias("_m"))
    up = _followed(stage(core.join(near, [*keys, "node"], "left").select(*keys, "node", F.least("node", "_m").alias("top"))), keys)
    topped = stage(once.join(up.withColumnRenamed("node", "_head"), [*keys, "_head"], "left"), "topped")
    # (a, b) of the ends of two core orbits, and of another orbit and the end of a core one
    links = pairs(topped).where("(_core_x or _core_y) and not (_core_x and _core_y and top_x = top_y)")
    other = lambda t: F.when(F.col(f"_core_{t}"), F.col(f"top_{t}")).otherwise(F.col(f"_head_{t}"))
    x_first = F.col("_core_x") & ~(F.col("_core_y") & (F.col("top_y") < F.col("top_x")))
    links = links.select(*keys, (F.col("_core_x") & F.col("_core_y")).alias("both"), F.when(x_first, other("x")).otherwise(other("y")).alias("a"), F.when(x_first, other("y")).otherwise(other("x")).alias("b"))
    links = stage(links.distinct(), "links")
    tops = connected(links.where("both"), up.select(*keys, F.col("top").alias("node")).distinct(), by).withColumnsRenamed({"node": "top", "component": "cluster"})
    labels = up.join(tops, [*keys, "top"]).select(*keys, "node", "cluster")
    border = links.where("not both").select(*keys, F.col("a").alias("top"), F.col("b").alias("node")).join(tops, [*keys, "top"]).groupBy(*keys, "node").agg(F.min("cluster").alias("near"))
    out = rows.select(*keys, "traj_id", F.col("_head").alias("node")).join(labels.withColumn("core", F.lit(True)), [*keys, "node"], "left").join(border, [*keys, "node"], "left")
    return out.select(*keys, "traj_id", F.coalesce("core", F.lit(False)).alias("core"), F.coalesce("cluster", "near").alias("cluster"))


def consensus(orbits: DataFrame, eps: dict[str, float | str], least: int, by: Sequence[str] = ()) -> DataFrame:
    """(by, traj_id, group): orbits that every criterion clusters, by tuple of clusters, in tuples of least members or more.

    eps maps each criterion to a number or a column, as in close_pairs. group numbers the tuples from 0 in their order.
    """
    keys = list(by)
    labels = None
    for criterion, e in eps.items():
        one = dbscan(orbits, e, least, criterion, by).where("cluster is not null").select(*keys, "traj_id", F.col("cluster").alias(criterion))
        labels = one if labels is None else labels.join(one, [*keys, "traj_id"])
    names = list(eps)
    sizes = labels.groupBy(*keys, *names).count().where(F.col("count") >= least)
    numbered = sizes.withColumn("group", (F.row_number().over(Window.partitionBy(*keys).orderBy(*names)) - 1).cast("bigint"))
    return labels.join(numbered, [*keys, *names]).select(*keys, "traj_id", "group")


def calibrated(window: DataFrame, null: DataFrame, rate: float, by: Sequence[str], criteria: Sequence[str] = tuple(CRITERIA), least: int = 50) -> DataFrame:
    """window with a column eps_<criterion> for each criterion: the threshold of the key's own null, null where that is too small."""
    out = window
    for c in criteria:
        out = out.join(threshold(null, rate, c, by, least).withColumnRenamed("eps", f"eps_{c}"), list(by), "left")
    return out


def stream_groups(window: DataFrame, null: DataFrame, rate: float, least: int, by: str, least_z: float, most_radius: float) -> tuple[DataFrame, DataFrame]:
    """(groups, members) of every window: calibrated thresholds, three clusterings, their consensus, and its excess over the null.

    groups: by, group (a string of window and number), eps_<criterion>, n_members, radius, n_obs, n_exp, z of the groups with a clear excess
    in a ball that isn't large. members: by, group, traj_id and the window's other columns.
    """
    set_up = stage(calibrated(window, null, rate, [by]), "calibrated")
    found = consensus(set_up, {c: f"eps_{c}" for c in CRITERIA}, least, [by])
    name = F.concat_ws("-", F.col(by).cast("int"), F.col("group"))
    members = stage(set_up.join(found.select(by, "traj_id", name.alias("group")), [by, "traj_id"]), "members")
    excess = density_excess(members.select("group", by, *ELEMENTS), window.select(by, *ELEMENTS), null.select(by, *ELEMENTS), "group", by)
    told = members.groupBy(by, "group").agg(F.count("*").alias("n_members"), *[F.max(f"eps_{c}").alias(f"eps_{c}") for c in CRITERIA])
    groups = stage(significant(told.join(excess, [by, "group"]), least_z, most_radius), "groups")
    return groups, members.join(groups.select("group"), "group", "left_semi")


def centroids(orbits: DataFrame, by: Sequence[str], circular: bool = False) -> DataFrame:
    """Medians of the elements by group; with circular, node and peri are medians of offsets from the circular mean."""
    if not circular:
        return orbits.groupBy(*by).agg(*[F.percentile(c, F.lit(0.5)).alias(c) for c in ELEMENTS])
    w = Window.partitionBy(*by)
    around = orbits
    for c in ("node", "peri"):
        mean = F.degrees(F.atan2(F.avg(F.sin(F.radians(c))).over(w), F.avg(F.cos(F.radians(c))).over(w)))
        around = around.withColumn(f"_{c}", mean).withColumn(c, circular_difference(F.col(c), F.col(f"_{c}")))
    mid = around.groupBy(*by).agg(*[F.percentile(c, F.lit(0.5)).alias(c) for c in ELEMENTS], F.max("_node").alias("_n"), F.max("_peri").alias("_p"))
    return mid.withColumns({"node": wrap(F.col("node") + F.col("_n")), "peri": wrap(F.col("peri") + F.col("_p"))}).drop("_n", "_p")


def distance_to(frame: DataFrame, centre: DataFrame, on: Sequence[str], criterion: str = "d_sh") -> DataFrame:
    """frame's rows with d, the distance to the centre of the same key."""
    c = centre.select(*on, *[F.col(x).alias(f"{x}_c") for x in ELEMENTS])
    return frame.join(c, list(on)).withColumn("d", CRITERIA[criterion](orbit(), orbit(suffix="_c"))).drop(*[f"{x}_c" for x in ELEMENTS])


#: Balls of a smaller radius are sought in cells of this size, lest rounding in the distance outweigh a cell.
_LEAST_CELL = 2.0**-9


def in_balls(frame: DataFrame, balls: DataFrame, radius: float | str, by: Sequence[str] = (), criterion: str = "d_sh") -> DataFrame:
    """frame's rows, once for each ball of their key that holds them (radius inclusive), with the ball's other columns and d.

    balls: by, elements of the centre, other columns. radius is a number or the name of a column of balls, which needs keys in by.
    An equi-join: a ball is sent to the 27 cells around its centre, of a width that is its radius rounded up to a power of 2, and a row
    to its own cell of each width in its key. So rows meet only the balls near them, and many balls or rows are many tasks.
    Rows and balls with a null or non-finite element meet nothing, and neither does a ball of null or negative radius.
    """
    keys = list(by)
    sized = isinstance(radius, str)
    if sized and not keys:
        raise ValueError("a radius for each ball needs keys")
    level = lambda r: F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(r, F.lit(_LEAST_CELL)))))
    finite = reduce(and_, [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf)) for c in ELEMENTS])
    places = {k: F.floor(v * (1 - 1e-9)).cast("bigint") for k, v in _cells(F.col("_w"), criterion).items()}
    r = F.col(radius) if sized else F.lit(float(radius))
    wide = balls.where(finite & (r >= 0) & ~F.isnan(r)).withColumn("_r", r.cast("double")).withColumn("_w", level(F.col("_r")))
    rows = frame.where(finite)
    rows = rows.join(wide.select(*keys, "_w").distinct(), keys) if sized else rows.withColumn("_w", level(r))
    rows = rows.withColumns(places | {f"_{k}": v for k, v in _poles().items()})
    wide = wide.withColumns({f"_{k}_c": v for k, v in _poles().items()})
    steps = {k: F.sequence(v - 1, v + 1) for k, v in places.items()}
    poles = [f"_{k}" for k in _poles()]
    cells = wide.select(*[F.col(c) for c in balls.columns if c not in ELEMENTS], "_r", "_w", *[f"{p}_c" for p in poles], *[F.col(x).alias(f"{x}_c") for x in ELEMENTS], *[v.alias(k) for k, v in steps.items()])
    for k in steps:
        cells = cells.withColumn(k, F.explode(k))
    # the terms that need no trigonometry, before the whole distance
    near = _at_least(*[{c.strip("_"): F.col(c + end) for c in ("e", "q", *poles)} for end in ("", "_c")], criterion)
    met = rows.join(cells, [*keys, "_w", *steps]).where(_reached(near, F.col("_r")))
    met = met.withColumn("d", CRITERIA[criterion](orbit(), orbit(suffix="_c"))).where(F.col("d") <= F.col("_r"))
    return met.drop("_w", "_r", *steps, *poles, *[f"{p}_c" for p in poles], *[f"{x}_c" for x in ELEMENTS])


def ball_counts(frame: DataFrame, balls: DataFrame, radius: float | str, names: Sequence[str], by: Sequence[str], n: str, total: str, criterion: str = "d_sh") -> DataFrame:
    """(names, by, n, total): rows of the ball's key within it, and all rows of the key. Balls of keys without rows are left out.

    names are the columns that tell balls of a key apart.
    """
    keys = list(by)
    told = [*names, *keys]
    hits = in_balls(frame.select(*keys, *ELEMENTS), balls, radius, keys, criterion).groupBy(*told).agg(F.count("*").alias(n))
    if keys:
        out = balls.select(*told).join(frame.groupBy(*keys).agg(F.count("*").alias(total)), keys)
    else:
        out = balls.select(*told).withColumn(total, frame.agg(F.count("*")).scalar()).where(F.col(total) > 0)
    return out.join(hits, told, "left").na.fill(0, [n]).select(*told, n, total)


def density_excess(members: DataFrame, window: DataFrame, null: DataFrame, group: str, by: str, criterion: str = "d_sh") -> DataFrame:
    """(group, by, radius, n_obs, n_exp, z): members' ball against the window and against a null scaled to the window's size.

    members: group, by, elements. window and null: by, elements. radius is the 0.8 quantile of members' distances from their median.
    """
    centre = centroids(members, [group, by])
    own = distance_to(members, centre, [group, by], criterion).groupBy(group, by).agg(F.percentile("d", F.lit(0.8)).alias("r"))
    balls = stage(centre.join(own, [group, by]), "balls")
    seen = ball_counts(window, balls, "r", [group], [by], "n_obs", "n_window", criterion)
    expected = ball_counts(null, balls, "r", [group], [by], "n_null", "all_n_null", criterion)
    out = balls.select(group, by, "r").join(seen, [group, by]).join(expected, [group, by], "left")
    n_exp = F.coalesce(F.col("n_null") / F.col("all_n_null"), F.lit(0.0)) * F.col("n_window")
    z = (F.col("n_obs") - n_exp) / F.sqrt(F.greatest(n_exp, F.lit(1.0)))
    return out.select(group, by, F.round("r", 5).alias("radius"), "n_obs", F.round(n_exp, 2).alias("n_exp"), F.round(z, 2).alias("z"))


def significant(groups: DataFrame, least_z: float, most_radius: float) -> DataFrame:
    return groups.where((F.col("z") >= least_z) & (F.col("radius") <= most_radius) & (F.col("radius") > 0))


def merge_overlapping(groups: DataFrame, members: DataFrame) -> DataFrame:
    """Groups that share members, directly or through others, become one structure.

    groups: group, z, window_start, window_end. members: group, traj_id. Returns (structure, best, z, n_windows, n_members, first_start,
    last_end): best is the group of the largest z (ties: the least), members are counted once.
    """
    hub = members.groupBy("traj_id").agg(F.min("group").alias("b"))
    edges = members.join(hub, "traj_id").where("group <> b").select(F.col("group").alias("a"), "b").distinct()
    part = connected(edges, groups.select(F.col("group").alias("node"))).select(F.col("node").alias("group"), F.col("component").alias("structure"))
    told = groups.join(part, "group")
    best = told.groupBy("structure").agg(
        F.min(F.struct((-F.col("z")).alias("nz"), "group")).alias("b"), F.count("*").alias("n_windows"), F.min("window_start").alias("first_start"), F.max("window_end").alias("last_end")
    )
    size = members.join(part, "group").groupBy("structure").agg(F.count_distinct("traj_id").alias("n_members"))
    return best.join(size, "structure").select("structure", F.col("b.group").alias("best"), (-F.col("b.nz")).alias("z"), "n_windows", "n_members", "first_start", "last_end")


# --- null models --------------------------------------------------------------------------------------


def permutation_null(orbits: DataFrame, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """Elements shuffled by themselves within groups; only physical orbits that meet Earth's stay."""
    mixed = permute_columns(orbits, "traj_id", ELEMENTS, seed, by)
    return mixed.where(is_valid(orbit()))


def kde_null(orbits: DataFrame, size: int, seed: int, bandwidth: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """A sample of a Gaussian kernel density in whitened elements: orbits picked by hash, plus noise. Valid ones, size at most in a group.

    Sampling a kernel density needs no density: pick a point, add the kernel's noise. Each pick's tries differ in noise.
    """
    from .relational import sample_with_replacement

    picks = sample_with_replacement(orbits.dropna(subset=list(ELEMENTS)).select(*by, "traj_id", *ELEMENTS), "traj_id", size, seed, by)
    tries = picks.select(*by, "draw", *[c.alias(n) for n, c in whiten(orbit()).items()], F.explode(F.sequence(F.lit(0), F.lit(7))).alias("try"))
    noise = lambda n, k: F.sqrt(-2.0 * F.log(_uniform(seed, [*by, n], k, 0))) * F.cos(6.283185307179586 * _uniform(seed, [*by, n], k, 1))
    moved = tries.select(*by, "draw", "try", *[(F.col(n) + bandwidth * noise("draw", i)).alias(n) for i, n in enumerate(("wq", "we", "wi", "wnx", "wny", "wpx", "wpy"))])
    back = moved.select(*by, "draw", "try", *[c.alias(n) for n, c in unwhiten({n: F.col(n) for n in ("wq", "we", "wi", "wnx", "wny", "wpx", "wpy")}).items()]).where(is_valid(orbit()))
    first = Window.partitionBy(*by, "draw").orderBy("try")
    return back.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r", "try").withColumnRenamed("draw", "traj_id")


def _uniform(seed: int, columns: Sequence[str], k: int, part: int) -> Column:
    """(0, 1) by hash of a draw, its try and a coordinate."""
    h = F.xxhash64(F.lit(seed), *[F.col(c) for c in columns], F.col("try"), F.lit(k), F.lit(part))
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / 9007199254740992.0


def sideband_pool(orbits: DataFrame, centres: DataFrame, gap: float = 8.0, width: float = 10.0) -> DataFrame:
    """(centre, traj_id, elements): orbits gap to gap + width degrees either side of each centre, node turned by their offset to it.

    centres: a small frame with column centre. Bands meet orbits by whole degrees of solar longitude.
    """
    spread = int(gap + width) + 1
    slots = centres.select("centre", F.explode(F.sequence(F.lit(-spread), F.lit(spread))).alias("k"))
    slots = slots.select("centre", F.pmod(F.floor("centre") + F.col("k"), F.lit(360)).alias("slot")).distinct()
    rows = orbits.withColumn("slot", F.pmod(F.floor("sol_lon"), F.lit(360))).join(F.broadcast(slots), "slot")
    c, x = F.col("centre"), F.col("sol_lon")
    band = lambda lo: in_arc(x, wrap(c + lo), wrap(c + lo + width))
    out = rows.where(band(-gap - width) | band(gap))
    return out.select("centre", "traj_id", "q", "e", "i", wrap(F.col("node") + wrap(c - x)).alias("node"), "peri")


def sideband_null(orbits: DataFrame, centres: DataFrame, size: int, seed: int, gap: float = 8.0, width: float = 10.0) -> DataFrame:
    """At most size orbits of each centre's pool, by hash order.

    Counts by the hash's first digits tell up to which of them the size is reached, so only a little more than that is sorted.
    """
    order = hash_order(seed, "traj_id")
    pool = sideband_pool(orbits, centres, gap, width)
    counts = pool.groupBy("centre", F.substring(order, 1, 3).alias("_b")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("centre").orderBy("_b")) - F.col("_n")
    last = counts.withColumn("_before", before).where(F.col("_before") < size).groupBy("centre").agg(F.max("_b").alias("_last"))  # a row for each centre
    first = pool.join(F.broadcast(last), "centre").where(F.substring(order, 1, 3) <= F.col("_last")).drop("_last")
    w = Window.partitionBy("centre").orderBy(order, "traj_id")
    return first.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= size).drop("_r")


def null_ratio(window: DataFrame, null: DataFrame, centres: DataFrame, radius: float) -> DataFrame:
    """(centre_id, n_obs, n_exp, ratio): what a null expects in a ball around each centre over what is there. An empty window or null gives no rows."""
    c = stage(centres.select("centre_id", *ELEMENTS), "centres")
    both = ball_counts(window, c, radius, ["centre_id"], [], "n", "total").join(ball_counts(null, c, radius, ["centre_id"], [], "m", "t"), "centre_id")
    n_exp = F.col("m") / F.col("t") * F.col("total")
    return both.select("centre_id", F.col("n").alias("n_obs"), n_exp.alias("n_exp"), (n_exp / F.greatest("n", F.lit(1))).alias("ratio"))


def window_centres(window: DataFrame, by: Sequence[str], regions: int = 25, least: int = 30, seed: int = 0, sporadic: str = "...") -> DataFrame:
    """(by, centre_id, elements): in each window the median orbit of its commonest code, as 'stream', and regions sporadic orbits.

    A code of fewer than least orbits is no stream; of equally common ones the least is taken. window: by, traj_id, iau_code, elements.
    """
    keys = list(by)
    codes = window.where(F.col("iau_code") != sporadic).groupBy(*keys, "iau_code").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    top = codes.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("m"), "iau_code")).alias("b")).select(*keys, F.col("b.iau_code").alias("iau_code"))
    streams = centroids(window.join(top, [*keys, "iau_code"]), keys).withColumn("centre_id", F.lit("stream"))
    ranked = window.where(F.col("iau_code") == sporadic).withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(hash_order(seed, "traj_id"), "traj_id")))
    alone = ranked.where(F.col("_r") <= regions).withColumn("centre_id", F.col("traj_id").cast("string"))
    columns = [*keys, "centre_id", *ELEMENTS]
    return streams.select(*columns).unionByName(alone.select(*columns))


def ball_ratios(window: DataFrame, null: DataFrame, centres: DataFrame, radius: float, by: Sequence[str]) -> DataFrame:
    """(by, centre_id, n_obs, n_exp, ratio) of each centre within its window: what the null expects in the ball over what is there."""
    return _expected(ball_counts(window, centres, radius, ["centre_id"], by, "n_obs", "_all"), null, centres, radius, by)


def _expected(seen: DataFrame, null: DataFrame, centres: DataFrame, radius: float, by: Sequence[str]) -> DataFrame:
    """ball_ratios of a window whose balls are counted: by, centre_id, n_obs, _all."""
    keys = list(by)
    both = seen.join(ball_counts(null, centres, radius, ["centre_id"], keys, "_m", "_t"), [*keys, "centre_id"], "left")
    n_exp = F.coalesce(F.col("_m") / F.col("_t"), F.lit(0.0)) * F.col("_all")
    return both.select(*keys, "centre_id", "n_obs", n_exp.alias("n_exp"), (n_exp / F.greatest("n_obs", F.lit(1))).alias("ratio"))


def compare_nulls(window: DataFrame, nulls: dict[str, DataFrame], centres: DataFrame, radius: float, by: Sequence[str], least: int = 5) -> DataFrame:
    """(by, null, sporadic_ratio, n_regions, stream_ratio): per window the median ratio over sporadic regions of least orbits or more, and the stream's."""
    keys = list(by)
    centres = stage(centres, "centres")
    # a null is counted twice, by ball and as a whole, and the window once for all nulls
    seen = stage(ball_counts(window, centres, radius, ["centre_id"], keys, "n_obs", "_all"), "seen")
    held = {name: stage(null.select(*keys, *ELEMENTS), "null") for name, null in nulls.items()}
    parts = [_expected(seen, null, centres, radius, by).withColumn("null", F.lit(name)) for name, null in held.items()]
    stream = F.col("centre_id") == "stream"
    region = ~stream & (F.col("n_obs") >= least)
    return reduce(DataFrame.unionByName, parts).groupBy(*keys, "null").agg(
        F.percentile(F.when(region, F.col("ratio")), F.lit(0.5)).alias("sporadic_ratio"), F.count_if(region).alias("n_regions"), F.max(F.when(stream, F.col("ratio"))).alias("stream_ratio")
    )


def null_separation(compared: DataFrame) -> DataFrame:
    """(null, sporadic_ratio, stream_ratio, separation): medians over windows, and the first over the second."""
    mid = compared.groupBy("null").agg(F.percentile("sporadic_ratio", F.lit(0.5)).alias("sporadic_ratio"), F.percentile("stream_ratio", F.lit(0.5)).alias("stream_ratio"))
    return mid.withColumn("separation", F.when(F.col("stream_ratio") > 0, F.col("sporadic_ratio") / F.when(F.col("stream_ratio") > 0, F.col("stream_ratio"))))


# --- recurrence and catalogue -------------------------------------------------------------------------


def year_excess(window: DataFrame, null: DataFrame, centre: DataFrame, radius: float) -> DataFrame:
    """(centre_id, year, n_year, n_obs, n_exp, z): each year's excess in the ball; the null's share is taken once for all years."""
    c = stage(centre.select("centre_id", *ELEMENTS), "centres")
    share = ball_counts(null, c, radius, ["centre_id"], [], "m", "t").select("centre_id", (F.col("m") / F.col("t")).alias("share"))
    # every centre has a row for every year; the years are few
    years = window.groupBy("year").agg(F.count("*").alias("n_year")).agg(F.collect_list(F.struct("year", "n_year"))).scalar()
    per = c.select("centre_id", F.explode(years).alias("y")).select("centre_id", "y.year", "y.n_year")
    hits = in_balls(window, c, radius).groupBy("centre_id", "year").agg(F.count("*").alias("n_obs"))
    per = per.join(hits, ["centre_id", "year"], "left").na.fill(0, ["n_obs"]).join(share, "centre_id")
    n_exp = F.col("share") * F.col("n_year")
    return per.select("centre_id", "year", "n_year", "n_obs", n_exp.alias("n_exp"), ((F.col("n_obs") - n_exp) / F.sqrt(F.greatest(n_exp, F.lit(1.0)))).alias("z"))


def recurrence(per_year: DataFrame, least_z: float = 2.0) -> DataFrame:
    """(centre_id, years_z, years_present, top_share, median_z, years): over the rows of year_excess."""
    strong, there = F.col("z") >= least_z, F.col("n_obs") >= 2
    a = per_year.groupBy("centre_id").agg(
        F.count_if(strong).alias("years_z"), F.count_if(there).alias("years_present"), F.max("n_obs").alias("top"), F.sum("n_obs").alias("all"),
        F.percentile("z", F.lit(0.5)).alias("median_z"), F.concat_ws(",", F.array_sort(F.collect_list(F.when(strong, F.col("year").cast("string"))))).alias("years"),
    )
    return a.select("centre_id", "years_z", "years_present", (F.col("top") / F.greatest("all", F.lit(1))).alias("top_share"), "median_z", "years")


def sky_cells(ra: Column, dec: Column, far: float) -> tuple[Column, Column]:
    """(cell, cells): the zone cell that a place lies in, and an array of all cells with places within far degrees of it.

    Zones are bands of declination, far degrees high, cut along right ascension into equal cells of far degrees or a little more. Places
    within far of one at declination d differ from it by asin(sin far / cos d) in right ascension at most; next to a pole by anything.
    """
    n = max(1, int(360 / far))
    wide, reach = 360.0 / n, far * (1 + 1e-9) + 1e-9
    cell = lambda band, k: band * n + F.pmod(k, F.lit(n))
    place = lambda x, side: F.floor(x / side).cast("bigint")
    pole = F.abs(dec) + reach >= 90
    spread = F.degrees(F.asin(F.least(F.lit(1.0), math.sin(math.radians(reach)) / F.cos(F.radians(dec))))) + 1e-9
    along = F.when(pole | (spread >= 180), F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).otherwise(F.sequence(place(ra - spread, wide), place(ra + spread, wide)))
    bands = F.sequence(place(dec - reach, far), place(dec + reach, far))
    return cell(place(dec, far), place(ra, wide)), F.array_distinct(F.flatten(F.transform(bands, lambda b: F.transform(along, lambda k: cell(b, k)))))


def match_catalogue(radiants: DataFrame, catalogue: DataFrame, far: float = 8.0, speed: float = 0.15, arc: float = 12.0) -> DataFrame:
    """(traj_id, list, code, sep): the nearest entry of each list within far degrees, speed relative and arc degrees of solar longitude.

    An entry without solar longitude passes that test; one without speed is left out, as is one or a radiant without a place. Entries and
    radiants meet by cells of the sky, an equi-join, so the catalogue may be large; of equal separations the least code is taken.
    """
    c = catalogue.where("vg is not null and ra is not null and dec is not null").select("code", "list", F.col("ra").alias("cra"), F.col("dec").alias("cdec"), F.col("vg").alias("cvg"), F.col("lo_s_max").alias("clo"))
    c = c.withColumn("_cell", F.explode(sky_cells(F.col("cra"), F.col("cdec"), far)[1]))
    placed = radiants.where("ra is not null and dec is not null").withColumn("_cell", sky_cells(F.col("ra"), F.col("dec"), far)[0])
    sep = separation(F.col("ra"), F.col("dec"), F.col("cra"), F.col("cdec"))
    fits = (F.abs(F.col("vg") - F.col("cvg")) <= speed * F.greatest("vg", F.lit(1e-6))) & (F.col("clo").isNull() | (F.abs(circular_difference(F.col("sol_lon"), F.col("clo"))) <= arc))
    near = placed.join(c, "_cell").where(fits).withColumn("sep", sep).where(F.col("sep") <= far)
    best = near.groupBy("traj_id", "list").agg(F.min(F.struct("sep", "code")).alias("b"))
    return best.select("traj_id", "list", F.col("b.code").alias("code"), F.col("b.sep").alias("sep"))


def unmatched(radiants: DataFrame, matches: DataFrame) -> DataFrame:
    """Radiants with no match in any list."""
    return radiants.join(matches, "traj_id", "left_anti")
