"""Histograms, rates, roll-ups and benchmark statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlog.functions import scalars as S


def hdr_buckets(samples: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Counts per slot of the histogram, by its largest value."""
    return samples.groupBy(*keys, S.hdr_slot_top(F.col(value)).alias("hi")).agg(F.count("*").alias("n"))


def hdr_merge(*parts: DataFrame, keys: list[str]) -> DataFrame:
    """Histograms of the same layout, summed by slot."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*keys, "hi").agg(F.sum("n").alias("n"))


def hdr_percentiles(buckets: DataFrame, keys: list[str], ps: list[float]) -> DataFrame:
    """The slot top at each percentile's rank (half away from zero, at least 1): a row per key and percentile."""
    w = Window.partitionBy(*keys).orderBy("hi")
    run = buckets.withColumn("upto", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))
    asked = run.select("*", F.explode(F.array(*map(F.lit, ps))).alias("p"))
    rank = F.least(F.col("total"), F.greatest(F.lit(1), F.floor(F.col("p") / 100 * F.col("total") + 0.5)))
    return asked.filter(F.col("upto") >= rank).groupBy(*keys, "p").agg(F.min("hi").alias("value"))


def rates(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Counter increments per second: 0 at the first sample and where the counter starts anew."""
    w = Window.partitionBy(*keys).orderBy("sample_ts_ms")
    before, at = F.lag("value").over(w), F.lag("sample_ts_ms").over(w)
    step = (F.col("sample_ts_ms") - at) / 1000
    return samples.withColumn("rate", F.coalesce(F.when(step > 0, F.greatest(F.lit(0.0), (F.col("value") - before) / step)), F.lit(0.0)))


def spread(trials: DataFrame, keys: list[str], value: str) -> DataFrame:
    """True median, min, max, mean, sample deviation (0 for one trial) and (max - min) / median."""
    out = trials.groupBy(*keys).agg(F.median(value).alias("median"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("stdev"), F.count("*").alias("n"))
    return out.withColumn("spread", F.when(F.col("median") == 0, 0.0).otherwise((F.col("max") - F.col("min")) / F.col("median")))


def median_trial(trials: DataFrame, keys: list[str], value: str, tie: str) -> DataFrame:
    """The upper median row of each key."""
    w = Window.partitionBy(*keys)
    out = trials.withColumn("_at", F.row_number().over(w.orderBy(value, tie))).withColumn("_n", F.count("*").over(w))
    return out.filter(F.col("_at") == F.floor(F.col("_n") / 2) + 1).drop("_at", "_n")


def prometheus_line(name: Column, labels: Column, value: Column) -> Column:
    return F.concat(name, F.lit("{"), labels, F.lit("} "), value.cast("string"))


def parse_prometheus(lines: DataFrame, column: str = "line") -> DataFrame:
    """name, broker, quantile, value of sample lines; comments and malformed lines go."""
    pattern = r'^([A-Za-z_:][A-Za-z0-9_:]*)\{([^}]*)\} ([-+0-9.eE]+)$'
    part = lambda k: F.regexp_extract(column, pattern, k)
    label = lambda n: F.regexp_extract(part(2), f'{n}="([^"]*)"', 1)
    return lines.filter(F.col(column).rlike(pattern)).select(part(1).alias("name"), label("broker").alias("broker"), F.nullif(label("quantile"), F.lit("")).alias("quantile"), part(3).cast("double").alias("value"))


QUANTILES = {"p50": 50.0, "p90": 90.0, "p95": 95.0, "p99": 99.0, "p999": 99.9}


def hdr_snapshot(values: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """count, min, max, sum, mean and quantiles of each key; values below 0 count as 0."""
    p = hdr_percentiles(hdr_buckets(values, keys, value), keys, list(QUANTILES.values()))
    named = p.groupBy(*keys).agg(*(F.max(F.when(F.col("p") == x, F.col("value"))).alias(n) for n, x in QUANTILES.items()))
    v = F.greatest(F.lit(0), F.col(value))
    total = values.groupBy(*keys).agg(F.count("*").alias("count"), F.min(v).alias("min"), F.max(v).alias("max"), F.sum(v).alias("sum"))
    return named.join(total, keys).withColumn("mean", F.col("sum") / F.col("count"))


def histogram_json(name: Column, labels: Column) -> Column:
    """The JSON document of a histogram's snapshot; labels is a struct."""
    return F.to_json(F.struct(name.alias("name"), labels.alias("labels"), F.lit("histogram").alias("type"), "count", "min", *QUANTILES, "max", F.floor("mean").cast("long").alias("mean")))


def prometheus_summary(snapshot: DataFrame, name: str, help_text: str, labels: Column) -> DataFrame:
    """line: quantiles, sum and count of snapshots in the text format, and the family's HELP and TYPE once."""
    with_label = lambda q: F.concat(labels, F.lit(f',quantile="{q}"'))
    quantiles = {"0.5": "p50", "0.9": "p90", "0.95": "p95", "0.99": "p99", "0.999": "p999", "1.0": "max"}
    lines = [prometheus_line(F.lit(name), with_label(q), F.col(c)) for q, c in quantiles.items()]
    lines += [prometheus_line(F.lit(f"{name}_{c}"), labels, F.col(c)) for c in ("sum", "count")]
    head = snapshot.sparkSession.createDataFrame([(f"# HELP {name} {help_text}",), (f"# TYPE {name} summary",)], "line string")
    return snapshot.select(F.explode(F.array(*lines)).alias("line")).union(head)


def resource_peaks(samples: DataFrame, keys: list[str]) -> DataFrame:
    """cpu_peak, cpu_mean, rss_peak, written, samples of each key's samples (cpu_percent, rss_bytes, written)."""
    return samples.groupBy(*keys).agg(F.round(F.max("cpu_percent"), 1).alias("cpu_peak"), F.round(F.avg("cpu_percent"), 1).alias("cpu_mean"), F.max("rss_bytes").alias("rss_peak"), F.sum("written").alias("written"), F.count("*").alias("samples"))


RESULT = "struct<scenario: bigint, trials: array<struct<trial: bigint, records_per_second: bigint>>>"


def load_results(docs: DataFrame, column: str = "doc", schema: str = RESULT) -> DataFrame:
    """scenario and the fields of every trial, from result documents (JSON); unreadable ones are passed by."""
    read = docs.select(F.from_json(column, schema, {"mode": "PERMISSIVE"}).alias("r")).filter("r.scenario IS NOT NULL")
    return read.select("r.scenario", F.explode("r.trials").alias("t")).select("scenario", "t.*")


def write_csv(rows: DataFrame, path: str) -> None:
    """One CSV file with a header: trials as they are, or a row per scenario as ``spread`` and ``median_trial`` give it."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
