"""Exact quantiles of any number of rows, without sorting or buffering them.

A quantile lies between two values of known places.  Their range is cut into ``BUCKETS`` of equal width
and the rows in each are counted; the one that holds the place, trimmed to the least and greatest value
in it, is the range of the next pass, until all values in it are equal.  Every pass is one aggregation
with partial counts, and narrows the range about a thousand times; values are never rounded.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, floor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1_024
MOST_GROUPS = 10_000


@dataclass
class _Place:
    """Where the value of one place is: how many rows lie below the range, and the range."""

    group: object
    place: int
    below: int
    low: float
    high: float


def _narrow(rows: DataFrame, open_: list[tuple[int, _Place]]) -> None:
    """One pass: the range of every place becomes that of the bucket that holds it."""
    spark = rows.sparkSession
    ranges = spark.createDataFrame([(i, p.group, p.low, p.high) for i, p in open_], f"_i int, _group {dict(rows.dtypes)['_group']}, _low double, _high double")
    inside = rows.join(F.broadcast(ranges), rows["_group"].eqNullSafe(ranges["_group"]) & F.col("_value").between(F.col("_low"), F.col("_high")))
    # halves, so that the width of the widest range is still a number
    share = F.try_divide(F.col("_value") / 2 - F.col("_low") / 2, F.col("_high") / 2 - F.col("_low") / 2)
    bucket = F.least(F.lit(BUCKETS - 2), F.coalesce(F.floor(share * BUCKETS), F.lit(0)))
    bucket = F.when(F.col("_value") == F.col("_high"), BUCKETS - 1).otherwise(F.when(F.col("_value") == F.col("_low"), 0).otherwise(bucket))
    counted = inside.groupBy("_i", bucket.alias("bucket")).agg(F.count("*").alias("n"), F.min("_value").alias("low"), F.max("_value").alias("high"))
    buckets: dict[int, list] = {}
    for row in counted.collect():  # at most BUCKETS for each open place
        buckets.setdefault(row["_i"], []).append(row)
    for i, p in open_:
        for row in sorted(buckets[i], key=lambda r: r.bucket):
            if p.place < p.below + row.n:
                p.low, p.high = row.low, row.high
                break
            p.below += row.n


def exact_quantiles(rows: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """One row per group with the quantiles of ``value`` named in ``shares``, interpolated between neighbours.

    Null and NaN values are left out, and infinite ones, which are no measurements.  There may be up to
    ``MOST_GROUPS`` groups, whose bounds pass through the driver.
    """
    spark = rows.sparkSession
    kept = rows.select(F.col(group).alias("_group"), F.col(value).cast("double").alias("_value")).where(
        F.col("_value").isNotNull() & (F.abs("_value") < float("inf")))
    bounds = kept.groupBy("_group").agg(F.count("*").alias("n"), F.min("_value").alias("low"), F.max("_value").alias("high")).limit(MOST_GROUPS + 1).collect()
    if len(bounds) > MOST_GROUPS:
        raise ValueError(f"quantiles of more than {MOST_GROUPS} groups")
    places: list[_Place] = []
    wanted = []
    for b in bounds:
        for name, share in shares.items():
            at = share * (b.n - 1)
            pair = [_Place(b["_group"], p, 0, b.low, b.high) for p in (floor(at), ceil(at))]
            wanted.append((b["_group"], name, at - floor(at), len(places)))
            places += pair
    while open_ := [(i, p) for i, p in enumerate(places) if p.low < p.high]:
        for low in range(0, len(open_), 1000):
            _narrow(kept, open_[low:low + 1000])
    found: dict[object, dict[str, float]] = {}
    for key, name, part, i in wanted:
        lower, upper = places[i].low, places[i + 1].low
        found.setdefault(key, {})[name] = lower + (upper - lower) * part
    kind = dict(kept.dtypes)["_group"]
    return spark.createDataFrame([(key, *[v[n] for n in shares]) for key, v in found.items()],
                                 f"`{group}` {kind}, " + ", ".join(f"`{n}` double" for n in shares))
