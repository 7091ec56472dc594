"""Physical layout: spreading the rows of a skewed key."""

from __future__ import annotations

from heapq import heappop, heappush
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col
from ..functions.draws import row_hash
from ..sources.storage import materialise

_SALT = "__spread"
_HOME, _KEY, _PLACES = "__home", "__key", "__places"
#: A key is heavy from one in so many parts of an even share on; groups of other keys a partition.
_HEAVY, _GROUPS = 8, 16


def spread_by_key(df: DataFrame, key: str, partitions: int) -> DataFrame:
    """Hash-partition by a key, splitting keys too big for one partition.

    Hashing on the key alone sends a hot value to one partition whatever their
    number. Values holding more than an even share of the rows (there are fewer
    of them than partitions, so the list is small) are spread over as many
    partitions as they fill; all other keys stay together. Values of the rows do
    not change.
    """
    return spread_values(df, key, partitions, hot_values(df, key, partitions))


def hot_values(
    df: DataFrame, key: str, partitions: int, total: int | None = None
) -> dict[object, int]:
    """Key values with more than an even share of rows, and how many shares they fill."""
    total = df.count() if total is None else total
    share = max(1.0, total / partitions)
    groups = df.groupBy(col(key).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return {r["k"]: ceil(r["n"] / share) for r in groups.filter(F.col("n") > share).collect()}


def spread_values(df: DataFrame, key: str, partitions: int, hot: dict[object, int]) -> DataFrame:
    if not hot:
        return df.repartition(partitions, col(key))
    data_type = df.schema[key].dataType
    shares = None
    for value, fills in hot.items():
        same = col(key).isNull() if value is None else col(key) == F.lit(value).cast(data_type)
        shares = F.when(same, F.lit(fills)) if shares is None else shares.when(same, F.lit(fills))
    # The task number keeps copies of one row from all getting the same salt.
    salt = F.pmod(F.xxhash64(row_hash(df), F.spark_partition_id()), shares.otherwise(F.lit(1)))
    salted = df.withColumn(_SALT, salt)
    return salted.repartition(partitions, col(key), F.col(_SALT)).drop(_SALT)


def place_by_weight(df: DataFrame, key: str, partitions: int) -> DataFrame:
    """Rows in partitions of like size: keys with many rows and groups of other keys are placed one by one, the largest first.

    A key with an eighth of an even share or more counts alone; of these there are
    at most eight a partition. Other keys are grouped by their hash, sixteen groups
    a partition. Each key or group goes to the partition with the fewest rows so
    far. Only a key with more rows than an even share is divided, into as many like
    parts as fit a share; all other keys stay together. These keys and one number a
    group reach the driver.
    """
    groups = _GROUPS * partitions
    keyed = df.withColumn(_HOME, F.pmod(F.xxhash64(col(key)), F.lit(groups)).cast("int"))
    counts = keyed.groupBy(col(key).alias("k"), F.col(_HOME).alias("home")).agg(F.count(F.lit(1)).alias("n"))
    counts = materialise(counts, "key-weights")
    try:
        total = counts.df.agg(F.sum("n")).first()[0] or 0
        is_heavy = F.col("n") * (_HEAVY * partitions) >= total
        heavy = counts.df.filter(is_heavy).orderBy(F.desc("n"), "home", "k").collect()
        loads = dict(counts.df.filter(~is_heavy).groupBy("home").agg(F.sum("n")).collect())
    finally:
        counts.drop()
    of_keys, of_groups = _places([r["n"] for r in heavy], [loads.get(g, 0) for g in range(groups)], partitions)
    own = F.get(F.lit(of_groups), F.col(_HOME))
    if heavy:
        schema = T.StructType([T.StructField(_KEY, df.schema[key].dataType), T.StructField(_PLACES, T.ArrayType(T.IntegerType()))])
        known = df.sparkSession.createDataFrame([(r["k"], p) for r, p in zip(heavy, of_keys)], schema)
        keyed = keyed.join(F.broadcast(known), col(key).eqNullSafe(F.col(_KEY)), "left")
        # The task number keeps copies of one row from all going to one part.
        turn = F.pmod(F.xxhash64(row_hash(df), F.spark_partition_id()), F.size(_PLACES)).cast("int")
        own = F.when(F.col(_PLACES).isNotNull(), F.get(_PLACES, turn)).otherwise(own)
    placed = keyed.withColumn(_HOME, own).repartitionById(partitions, F.col(_HOME))
    return placed.select(*map(col, df.columns))


def _places(keys: list[int], groups: list[int], partitions: int) -> tuple[list[list[int]], list[int]]:
    """The partitions of each key's like parts, and of each group, given their numbers of rows."""
    share = max(1, -(-(sum(keys) + sum(groups)) // partitions))
    parts = [(n // -(-n // share), i, None) for i, n in enumerate(keys) for _ in range(-(-n // share))]
    queue = [(0, p) for p in range(partitions)]
    of_keys, of_groups = [[] for _ in keys], [0] * len(groups)
    for n, key, group in sorted([*parts, *((n, None, g) for g, n in enumerate(groups))], key=lambda x: -x[0]):
        load, p = heappop(queue)
        heappush(queue, (load + n, p))
        if key is None:
            of_groups[group] = p
        else:
            of_keys[key].append(p)
    return of_keys, of_groups
