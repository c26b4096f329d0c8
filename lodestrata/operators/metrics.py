"""Counters, gauges, histograms and percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import duration

#: Upper bounds, in seconds, of the usual latency histogram.
LATENCY_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
#: Upper bounds, in bytes, of snapshot sizes: 1024 * 4 ** k.
SIZE_BOUNDS = tuple(float(1024 * 4**k) for k in range(10))
BUCKETS = 32


def counters(rows: DataFrame, by: str, value: Column) -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def cumulative(rows: DataFrame, by: str, value: Column, bounds=LATENCY_BOUNDS) -> DataFrame:
    """(by, le, n): how many values are at most each bound, and in all (le null).

    One aggregation makes all counts; they are unfolded after it.
    """
    counts = rows.groupBy(by).agg(*(F.count_if(value <= b).alias(f"b{k}") for k, b in enumerate(bounds)), F.count("*").alias("whole"))
    pairs = F.array(*(F.struct(F.lit(float(b)).alias("le"), F.col(f"b{k}").alias("n")) for k, b in enumerate(bounds)), F.struct(F.lit(None).cast("double").alias("le"), F.col("whole").alias("n")))
    return counts.select(by, F.explode(pairs).alias("p")).select(by, "p.le", "p.n")


def latest_value(rows: DataFrame, value: str, order: str) -> DataFrame:
    return rows.agg(F.max_by(value, order).alias(value))


def bit_bucket(us: Column) -> Column:
    """The bit length of a number of microseconds, 0 for none, 31 at most."""
    return F.when(us <= 0, 0).otherwise(F.least(F.lit(BUCKETS - 1), F.length(F.bin(us))))


def log2_histogram(rows: DataFrame, us: str) -> DataFrame:
    return rows.groupBy(bit_bucket(F.col(us)).alias("bucket")).agg(F.count("*").alias("cnt"))


def log2_histogram_by(rows: DataFrame, by: str, us: str) -> DataFrame:
    return rows.groupBy(by, bit_bucket(F.col(us)).alias("bucket")).agg(F.count("*").alias("cnt"))


def _percentile(counts: Column, total: Column, pct: float) -> Column:
    """Of (bucket, cnt) pairs in order: the upper bound of the bucket that holds the rank, 0 without values."""
    rank = F.greatest(F.floor(total * F.lit(float(pct)) / 100), F.lit(1))
    start = F.struct(F.lit(0).cast("long").alias("cum"), F.lit(-1).alias("at"))
    step = lambda a, x: F.struct((a["cum"] + x["cnt"]).alias("cum"), F.when((a["at"] < 0) & (a["cum"] + x["cnt"] >= rank), x["bucket"]).otherwise(a["at"]).alias("at"))
    at = F.aggregate(counts, start, step)["at"]
    return F.when(total > 0, F.when(at == 0, F.lit(1)).otherwise(F.pow(F.lit(2.0), at))).otherwise(F.lit(0)).cast("long")


def log2_percentiles(histogram: DataFrame, percents: tuple[float, ...]) -> DataFrame:
    """(pct, us): the upper bound of the bucket that holds the rank; 0 without values. The histogram has BUCKETS rows at most."""
    pairs = F.array_sort(F.collect_list(F.struct("bucket", "cnt")))
    one = histogram.agg(pairs.alias("counts"), F.coalesce(F.sum("cnt"), F.lit(0)).alias("total"))
    return one.select(F.explode(F.array(*(F.struct(F.lit(float(p)).alias("pct"), _percentile(F.col("counts"), F.col("total"), p).alias("us")) for p in percents))).alias("x")).select("x.pct", "x.us")


def log2_percentiles_by(histogram: DataFrame, by: str, percents: dict[str, float]) -> DataFrame:
    """(by, a column for each named percent)."""
    pairs = F.array_sort(F.collect_list(F.struct("bucket", "cnt")))
    per = histogram.groupBy(by).agg(pairs.alias("counts"), F.sum("cnt").alias("total"))
    return per.select(by, *(_percentile(F.col("counts"), F.col("total"), p).alias(name) for name, p in percents.items()))


def mean_and_count(rows: DataFrame, us: str) -> DataFrame:
    return rows.agg(F.coalesce(F.expr(f"sum({us}) div count(*)"), F.lit(0)).alias("mean_us"), F.count("*").alias("n"))


def load_summary(rows: DataFrame, elapsed: Column, by: str | None = None) -> DataFrame:
    """Requests by class: 2xx succeed, all others fail; 503, 429 and no answer (status 0) also count apart."""
    s = F.col("status")
    good = (s >= 200) & (s < 300)
    grouped = rows.groupBy(by) if by else rows.groupBy()
    out = grouped.agg(F.count("*").alias("total"), F.count_if(good).alias("successes"), F.count_if(~good).alias("failures"), F.count_if(s == 503).alias("errors_503"), F.count_if(s == 429).alias("errors_429"), F.count_if(s == 0).alias("network_errors"), elapsed.alias("elapsed_s"))
    rate = F.when(F.col("elapsed_s") > 0, F.col("total") / F.col("elapsed_s")).otherwise(0.0)
    return out.withColumn("rps", rate).withColumn("error_rate", F.when(F.col("total") > 0, F.col("failures") / F.col("total")).otherwise(0.0))


#: The percentiles of a report.
PERCENTS = {"p50": 50.0, "p95": 95.0, "p99": 99.0}


def phase_summaries(rows: DataFrame, elapsed: Column, phase: str, us: str = "us") -> DataFrame:
    """Each phase's counts, rates, mean and percentiles."""
    means = rows.groupBy(phase).agg(F.expr(f"sum({us}) div count(*)").alias("mean_us"))
    return load_summary(rows, elapsed, phase).join(means, phase).join(log2_percentiles_by(log2_histogram_by(rows, phase, us), phase, PERCENTS), phase)


def phase_report(summaries: DataFrame, phase: str) -> DataFrame:
    """(phase, line, text): each phase's summary as numbered lines of text."""
    number = lambda c: F.format_string("%d", F.col(c))
    fields = [
        ("requests", number("total")), ("rps", F.format_string("%.1f", F.col("rps"))), ("successes", number("successes")),
        ("failures", F.format_string("%d (%.2f%%)", F.col("failures"), F.col("error_rate") * 100)),
        ("503", number("errors_503")), ("429", number("errors_429")), ("network", number("network_errors")),
        ("mean", duration(F.col("mean_us"))), *((p, duration(F.col(p))) for p in PERCENTS),
    ]
    lines = F.array(F.col(phase), *(F.concat(F.lit(f"  {name}: "), shown) for name, shown in fields))
    return summaries.select(phase, F.posexplode(lines).alias("line", "text"))


def comparison(summaries: DataFrame, phase: str) -> DataFrame:
    """(phase, text): a line of a table for each phase, beside the others'."""
    cells = [F.format_string("%-28s", F.col(phase)), F.format_string("%12.1f", F.col("rps")), *(F.format_string("%-8s", duration(F.col(c))) for c in ("mean_us", *PERCENTS)), F.format_string("%.2f%%", F.col("error_rate") * 100)]
    return summaries.select(phase, F.concat_ws(" | ", *cells).alias("text"))


def replication_lag(progress: DataFrame, by: str | None = None) -> DataFrame:
    """Bytes that the replica is behind, never below 0, and how often it reconnected."""
    grouped = progress.groupBy(by) if by else progress.groupBy()
    behind = F.greatest(F.max("primary_offset") - F.max("replica_offset"), F.lit(0))
    return grouped.agg(behind.alias("lag_bytes"), F.count_if(F.col("reconnected")).alias("reconnects"))


def snapshot_gauge(snapshots: DataFrame) -> DataFrame:
    return snapshots.agg(F.coalesce(F.max("index"), F.lit(0)).alias("snapshot_index"))


def node_gauges(states: DataFrame, order: str) -> DataFrame:
    """The last term, and whether the node last led."""
    return states.groupBy("node_id").agg(F.max_by("term", order).alias("term"), F.max_by(F.when(F.col("role") == "leader", 1).otherwise(0), order).alias("is_leader"))


def stats_json(stats: DataFrame) -> DataFrame:
    return stats.select(F.to_json(F.struct(*stats.columns)).alias("stats"))


def engine_stats(events: DataFrame, processed: Column, progress: DataFrame | None = None) -> DataFrame:
    """One line of JSON: events processed, events still queued, and the replica's lag and reconnects where they aren't 0."""
    one = events.agg(F.count_if(processed).alias("processed_total"), F.count_if(~processed).alias("queue_depth"))
    if progress is not None:
        lag = replication_lag(progress)
        one = one.join(F.broadcast(lag.select(F.nullif("lag_bytes", F.lit(0)).alias("replication_lag_bytes"), F.nullif("reconnects", F.lit(0)).alias("replication_reconnects"))))  # a row beside a row
    return stats_json(one)


def snapshot_metrics(snapshots: DataFrame, installed: Column, compacted: Column) -> DataFrame:
    """(metric, label, le, value): snapshots created by status, size and duration histograms of those that are ok, installs and entries compacted; one pass."""
    ok = F.col("status") == "ok"
    shapes = {"size_bytes": (F.col("size"), SIZE_BOUNDS), "duration_seconds": (F.col("seconds"), LATENCY_BOUNDS)}
    counts = [F.count_if((F.col("status") == s)).alias(f"created_{s}") for s in ("ok", "error")]
    counts += [F.count_if(ok & (value <= b)).alias(f"{name}_{k}") for name, (value, bounds) in shapes.items() for k, b in enumerate(bounds)]
    counts += [F.coalesce(F.sum(F.when(ok, value)), F.lit(0)).cast("double").alias(f"{name}_sum") for name, (value, _) in shapes.items()]
    one = snapshots.agg(*counts, F.count_if(installed).alias("installs"), F.coalesce(F.sum(compacted), F.lit(0)).alias("compacted"))
    row = lambda metric, label, le, value: F.struct(F.lit(metric).alias("metric"), F.lit(label).cast("string").alias("label"), F.lit(le).cast("double").alias("le"), value.cast("double").alias("value"))
    rows = [row("created_total", s, None, F.col(f"created_{s}")) for s in ("ok", "error")]
    for name, (_, bounds) in shapes.items():
        rows += [row(f"{name}_bucket", None, b, F.col(f"{name}_{k}")) for k, b in enumerate(bounds)]
        rows += [row(f"{name}_bucket", None, float("inf"), F.col("created_ok")), row(f"{name}_sum", None, None, F.col(f"{name}_sum")), row(f"{name}_count", None, None, F.col("created_ok"))]
    rows += [row("install_total", None, None, F.col("installs")), row("compacted_entries_total", None, None, F.col("compacted"))]
    return one.select(F.explode(F.array(*rows)).alias("m")).select("m.*")


def _escaped(label: Column) -> Column:
    return F.replace(F.replace(F.replace(label, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def exposition(rows: DataFrame, name: str, label: str, value: str) -> DataFrame:
    """Rows in the Prometheus text format: name{label="..."} value."""
    return rows.select(F.format_string(f'{name}{{{label}="%s"}} %s', _escaped(F.col(label)), F.col(value).cast("string")).alias("line"))


def exposition_histogram(counts: DataFrame, sums: DataFrame, name: str, label: str) -> DataFrame:
    """(label, place, line): a histogram in the Prometheus text format, from `cumulative` counts and (label, sum) rows; place orders a label's lines."""
    bound = F.coalesce(F.col("le").cast("string"), F.lit("+Inf"))
    shown = _escaped(F.col(label).cast("string"))
    buckets = counts.select(label, F.coalesce("le", F.lit(float("inf"))).alias("place"), F.format_string(f'{name}_bucket{{{label}="%s",le="%s"}} %d', shown, bound, F.col("n")).alias("line"))
    whole = counts.filter("le IS NULL").select(label, F.lit(float("nan")).alias("place"), F.format_string(f'{name}_count{{{label}="%s"}} %d', shown, F.col("n")).alias("line"))
    total = sums.select(label, F.lit(float("nan")).alias("place"), F.format_string(f'{name}_sum{{{label}="%s"}} %s', shown, F.col("sum").cast("string")).alias("line"))
    return buckets.unionByName(total).unionByName(whole)
