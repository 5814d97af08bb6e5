"""Attach per-key facts to rows when one key may hold a large share of them.

Counting is safe under skew (Spark combines before the shuffle); joining the counts back is not, because all
rows of a key would land in one task. The keys that hold more than 1/1024 of the rows, of which there can be
no more than 1024, therefore travel as a broadcast, and their rows take a spread-out key through the ordinary
join so that no task receives them together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairpref.session import broadcast_if_small, cut

HEAVY_SHARE = 1024
SPREAD = 4096


def with_group_size(
    df: DataFrame, fingerprint: Column, size_column: str, spread_by: Column, *, at_least: int, measured: bool = False,
    cheap: Column | None = None,
) -> DataFrame:
    """Add the number of rows that share ``fingerprint`` (a SHA-256 text), null below ``at_least`` rows.

    Leaving out small groups keeps the joined side as small as the answer allows. ``spread_by`` is a column
    that differs between rows of a hot key.

    By default the plan is lazy; both joined sides are unique on the key, so Spark drops the whole computation
    when the size is not used downstream. With ``measured`` the groups are counted and materialised first, and
    when they are few they are broadcast: then wide rows are never shuffled.

    ``cheap`` is a 64-bit hash that is equal where fingerprints are. It is counted first; what is seen once is in no group of
    two, and only the rest is fingerprinted at all. Where that shows no two fingerprints of one hash, rows find their group by
    the hash.
    """
    columns = df.columns
    if measured and cheap is not None and at_least >= 2:
        counted = df.select(cheap.alias("__h")).groupBy("__h").agg(F.count(F.lit(1)).alias("__c"))
        suspects = cut(counted.where("__h is not null and __c > 1").select("__h", F.lit(True).alias("__suspect")))
        small = broadcast_if_small(suspects)
        if small is not suspects:
            df = df.withColumn("__h", cheap)
            told = df.join(small, "__h").select("__h", fingerprint.alias("__fp"))
            found = cut(told.groupBy("__h", "__fp").agg(F.count("__fp").alias("__n")))
            if found.groupBy("__h").count().where("count > 1").isEmpty():
                # One fingerprint for each hash: the hash tells the groups, and no row is fingerprinted again.
                sizes = found.where(F.col("__n") >= at_least).select("__h", F.col("__n").alias(size_column))
                return df.join(F.broadcast(sizes), "__h", "left").drop("__h")
            df = df.join(small, "__h", "left")
            fingerprint = F.when(F.col("__suspect"), fingerprint)
    rows = df.withColumn("__fp", fingerprint).select(*[F.col(f"`{c}`") for c in columns], "__fp")
    keyed = rows.where(F.col("__fp").isNotNull())
    sizes = keyed.groupBy("__fp").agg(F.count(F.lit(1)).alias("__n"))
    wanted = F.col("__n") >= at_least
    if measured:
        groups = cut(sizes.where(wanted))
        small = broadcast_if_small(groups)
        if small is not groups:
            return rows.join(small, "__fp", "left").withColumnRenamed("__n", size_column).drop("__fp")
        total, sizes = keyed.agg(F.count(F.lit(1)).alias("__total")).scalar(), groups
    else:
        total = sizes.agg(F.sum("__n").alias("__total")).scalar()
    heavy = F.col("__n") * HEAVY_SHARE > total
    hot = sizes.where(heavy & wanted).select("__fp", F.col("__n").alias("__hot"))
    cold = sizes.where(~heavy & wanted).select(F.col("__fp").alias("__key"), F.col("__n").alias("__cold"))
    joined = rows.join(F.broadcast(hot), "__fp", "left")
    spread = F.concat(F.lit("hot-"), F.pmod(F.xxhash64(spread_by), F.lit(SPREAD)).cast("string"))
    key = F.when(F.col("__hot").isNull() & F.col("__fp").isNotNull(), F.col("__fp")).otherwise(spread)
    joined = joined.withColumn("__key", key).join(cold, "__key", "left")
    size = F.coalesce(F.col("__hot"), F.col("__cold"))
    return joined.withColumn(size_column, size).drop("__fp", "__key", "__hot", "__cold")
