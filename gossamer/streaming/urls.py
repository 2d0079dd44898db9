"""Optional streams over new URLs (the batch run's resume and cache, kept up to date)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gossamer.functions import columns as C


def first_seen(urls: DataFrame, delay: str = "1 day") -> DataFrame:
    """(ts, url) stream: of each registered domain the first URL within the watermark."""
    named = urls.withColumn("full_domain", C.url_parts(F.col("url"))["full_domain"]).where("full_domain <> ''")
    return named.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["full_domain"])


def signal_counts(urls: DataFrame, window: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """Suspicious URLs per window of time and suffix."""
    p = C.url_parts(F.col("url"))
    marked = urls.select("ts", p["suffix"].alias("suffix"), (F.size(C.signals(p["domain"], p["suffix"])) > 0).alias("suspicious"))
    return marked.withWatermark("ts", delay).groupBy(F.window("ts", window), "suffix").agg(F.count("*").alias("n"), F.count_if("suspicious").alias("n_suspicious"))
