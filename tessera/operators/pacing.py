"""When requests start under a limit of calls a minute, with cooldowns, as a prefix scan.

A key's requests run one after another: a request starts when it is ready, and not before
the start of the one before it plus that one's gap, start[i] = max(ready[i], start[i-1] +
gap[i-1]). With G the sum of all gaps before, that is start[i] = G[i] + max over j <= i of
(ready[j] - G[j]): a prefix sum and a prefix maximum, no loop. A gap is the pace's interval,
or longer where the request itself took longer; after a rate-limited one the cooldown
follows its end.

A key may hold any share of all rows: rows are dealt to ranges of (key, ready, seq), each
range gives its sum of gaps and its largest ready minus gaps, and the few ranges are
scanned, so no task reads all of a key's rows.

Times are whole microseconds. Ties in ready go by seq; null ready times and keys are left
out; null durations are 0, a null flag is false.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import shared_dir

# Fixed value: seconds to wait after a rate-limited reply.
COOLDOWN_S = 65


def gap(calls: int, per_s: float, took: Column, limited: Column, cooldown_s: float = COOLDOWN_S) -> Column:
    """Microseconds from a request's start to the earliest start of the next: ``calls`` in ``per_s`` seconds, one after another."""
    us = lambda s: F.lit(round(s * 1_000_000)).cast("long")
    took = F.coalesce(took, F.lit(0)).cast("long")
    return F.greatest(us(per_s / calls), took + F.when(F.coalesce(limited, F.lit(False)), us(cooldown_s)).otherwise(us(0)))


def paced(requests: DataFrame, calls: int, per_s: float = 60, cooldown_s: float = COOLDOWN_S) -> DataFrame:
    """key, seq, ready, start, waited (microseconds) of (key, seq, ready, took, limited); ``took`` in microseconds."""
    spark = requests.sparkSession
    own = requests.filter("key is not null and ready is not null").select("key", "seq", F.col("ready").cast("long").alias("ready"), gap(calls, per_s, F.col("took"), F.col("limited"), cooldown_s).alias("gap"))
    ranges = own.repartitionByRange("key", "ready", "seq").select("*", F.spark_partition_id().alias("part"))
    path = f"{shared_dir(spark)}/ranges"
    ranges.write.parquet(path)
    ranges = spark.read.schema(ranges.schema).parquet(path)
    # partition numbers rise with (key, ready, seq), and so does what a range holds of a key
    inside = Window.partitionBy("key", "part").orderBy("ready", "seq")
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranges.withColumn("_g", F.sum("gap").over(so_far) - F.col("gap")).withColumn("_m", F.max(F.col("ready") - F.col("_g")).over(so_far))
    whole = ranges.withColumn("_g", F.sum("gap").over(so_far) - F.col("gap")).groupBy("key", "part").agg(F.sum("gap").alias("gaps"), F.max(F.col("ready") - F.col("_g")).alias("best"))
    earlier = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    scanned = whole.withColumn("_before", F.coalesce(F.sum("gaps").over(earlier), F.lit(0).cast("long"))).withColumn("_reached", F.max(F.col("best") - F.col("_before")).over(earlier))
    out = placed.join(scanned.select("key", "part", "_before", "_reached"), ["key", "part"])
    start = F.col("_before") + F.col("_g") + F.greatest("_reached", F.col("_m") - F.col("_before"))
    return out.select("key", "seq", "ready", start.alias("start"), (start - F.col("ready")).alias("waited"))
