"""Exact order statistics of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphquarry.sources.scratch import stash

ACCURACY = 10_000


def percentiles(rows: DataFrame, key: list[str], value: str, shares: list[float], few: int = 10_000, max_passes: int = 60) -> DataFrame:
    """(key..., share, value double, n): sorted[floor(n * share)] of each key's values, the last one at most.

    Null and NaN values don't count; a null key is a key. All keys and shares are narrowed at once: a sketch of
    bounded size says near which value the wanted place lies, the values below, at and above it are counted, those
    close to it apart, and the part that holds the place goes on, with its true ends. Both are aggregates with
    map-side combine, so a key with a third of all rows stays in many tasks. A part loses a factor of about a
    hundred in each pass; what has ``few`` values or one distinct value is looked up.
    """
    v = F.col(value).cast("double")
    data = stash(rows.select(*key, v.alias("_v")).filter("_v is not null and not isnan(_v)"), "values")
    sizes = data.groupBy(*key).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    state = sizes.select(*key, "n", "lo", "hi", F.explode(F.array(*map(F.lit, shares))).alias("share"))
    at = F.least(F.floor(F.col("n") * F.col("share")), F.col("n") - 1).cast("long")
    state = stash(state.select(*key, "share", F.col("n").alias("of"), at.alias("at"), "n", "lo", "hi"), "places")

    def inside(ranges: DataFrame) -> DataFrame:
        named = ranges.select(*[F.col(c).alias(f"_{c}") for c in key], "share", "of", "at", "n", "lo", "hi")
        same = F.col("_v").between(F.col("lo"), F.col("hi"))
        for c in key:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        return data.join(named, same).select(*key, "share", "of", "at", "n", "lo", "hi", "_v")

    out = []
    for _ in range(max_passes):
        ended = (F.col("n") <= few) | (F.col("lo") == F.col("hi"))
        done = state.filter(ended)
        equal = done.filter("lo = hi").select(*key, "share", F.col("lo").alias("value"), F.col("of").alias("n"))
        small = inside(done.filter("lo < hi")).groupBy(*key, "share").agg(F.first("of").alias("n"), F.first("at").alias("at"), F.array_sort(F.collect_list("_v")).alias("s"))  # ``few`` values
        out += [equal, small.select(*key, "share", F.get("s", F.col("at").cast("int")).alias("value"), "n")]
        state = state.filter(~ended)
        if state.isEmpty():
            break
        state = stash(state, "open-places")
        # the place as a share of its part, which the sketch is asked for from a little below to a little above
        asked = inside(state).groupBy(*key, "share").agg(F.percentile_approx("_v", [i / 200 for i in range(201)], ACCURACY).alias("q"))
        step = F.floor(200 * F.col("at") / F.col("n")).cast("int")
        marks = state.join(asked.select(*[F.col(c).alias(f"_{c}") for c in key], F.col("share").alias("_share"), "q"), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key] + [F.col("share") == F.col("_share")])
        marks = stash(marks.select(*state.columns, F.get("q", F.greatest(step - 1, F.lit(0))).alias("a"), F.get("q", step).alias("p"), F.get("q", F.least(step + 2, F.lit(200))).alias("b")), "marks")
        named = marks.select(*[F.col(c).alias(f"_{c}") for c in key], "share", "of", "at", "lo", "hi", "a", "p", "b")
        same = F.col("_v").between(F.col("lo"), F.col("hi"))
        for c in key:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        zone = F.when(F.col("_v") < F.col("a"), 0).when(F.col("_v") < F.col("p"), 1).when(F.col("_v") == F.col("p"), 2).when(F.col("_v") <= F.col("b"), 3).otherwise(4)
        counted = data.join(named, same).groupBy(*key, "share", "of", "at", zone.alias("zone")).agg(F.count("*").alias("m"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        zones = counted.groupBy(*key, "share", "of", "at").agg(F.array_sort(F.collect_list(F.struct("zone", "m", "lo", "hi"))).alias("z"))  # five at most
        below = F.aggregate("z", F.struct(F.lit(0).cast("long").alias("sum"), F.lit(None).cast("struct<zone:int,m:bigint,lo:double,hi:double>").alias("hit"), F.lit(0).cast("long").alias("since")), lambda s, x: F.struct(
            (s["sum"] + x["m"]).alias("sum"), F.coalesce(s["hit"], F.when(F.col("at") < s["sum"] + x["m"], x)).alias("hit"), F.when(s["hit"].isNull(), s["sum"]).otherwise(s["since"]).alias("since")
        ))
        state = zones.withColumn("p", below).select(*key, "share", "of", (F.col("at") - F.col("p.since")).alias("at"), F.col("p.hit.m").alias("n"), F.col("p.hit.lo").alias("lo"), F.col("p.hit.hi").alias("hi"))
        state = stash(state, "places")
    else:
        raise RuntimeError(f"not narrowed down in {max_passes} passes")
    result = out[0]
    for o in out[1:]:
        result = result.unionByName(o)
    return result
