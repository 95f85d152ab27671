
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import percent

PERCENTILES = (90, 95, 99)
_ok = "status = 'success'"


def _is(status: str):
    return F.count(F.when(F.col("status") == status, 1))


def _r(x, name: str):
    return F.round(x, 6).alias(name)


def status_counts(sessions: DataFrame) -> DataFrame:
    """[A1]"""
    out = sessions.agg(F.count(F.lit(1)).alias("total"), _is("success").alias("success"), _is("failed").alias("failed"), _is("incomplete").alias("incomplete"))
    return out.withColumn("success_rate", F.round(percent("success", "total"), 6))


def tool_call_stats(sessions: DataFrame) -> DataFrame:
    """[A2, A6] Over successes; no row without any."""
    x = F.col("tool_calls")
    out = sessions.where(_ok).agg(F.sum(x).alias("sum_calls"), _r(F.avg(x), "avg_calls"), _r(F.median(x), "median_calls"), F.min(x).alias("min_calls"), F.max(x).alias("max_calls"))
    return out.where("sum_calls is not null")


def tool_call_distribution(sessions: DataFrame) -> DataFrame:
    """[A3] Successes by number of calls, and their share of all in percent."""
    counts = sessions.where(_ok).groupBy("tool_calls").agg(F.count(F.lit(1)).alias("sessions"))
    total = counts.agg(F.sum("sessions")).scalar()
    return counts.withColumn("share", F.round(percent("sessions", total), 6))


#: Ranges that values are dealt to; their edges are one row.
RANGES = 128


def value_counts(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, v (the value as double, null too), n: how often each value occurs. Ties combine before the shuffle, groups don't meet."""
    return rows.groupBy(*by, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))


def quantiles(counts: DataFrame, by: list[str], shares: tuple[float, ...]) -> DataFrame:
    """[A5, A6, A7, T9] by, q0, q1, ... of value_counts: exact quantiles of each group, linear between neighbours.

    Distinct values are dealt to ranges between approximate quantiles of all of them. Sums by group and range tell which
    range holds a wanted rank; only those are sorted, each by itself, so a group with most of the values is spread over
    tasks. Nothing runs while this is built, and the rows behind the counts are read once, as their shuffle is used again.

    A group without a value has no row; without groups (by is empty) there is no row if there are no values.
    """
    x = counts.where("v is not null")
    edges = x.agg(F.percentile_approx("v", F.array(*[F.lit(k / RANGES) for k in range(1, RANGES)]), F.lit(10_000)).alias("_e"))  # one row
    x = x.join(F.broadcast(edges), F.lit(True)).withColumn("_b", F.size(F.filter("_e", lambda e: e <= F.col("v")))).drop("_e")
    same = lambda cols: reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_at_{c}")) for c in cols])
    sums = x.groupBy(*by, "_b").agg(F.sum("n").alias("_m"))
    whole, line = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("_b")  # a row a range: RANGES of a group at most
    sums = sums.select(*[F.col(c).alias(f"_at_{c}") for c in [*by, "_b"]], "_m", F.sum("_m").over(whole).alias("_all"), (F.sum("_m").over(line) - F.col("_m")).alias("_before"))
    place = [(F.col("_all") - 1) * F.lit(s) for s in shares]
    ends = [(F.floor(p), F.ceil(p)) for p in place]
    holds = lambda first, m: reduce(lambda a, b: a | b, [(first <= r) & (r < first + m) for pair in ends for r in pair])
    hit = x.join(sums.where(holds(F.col("_before"), F.col("_m"))), same([*by, "_b"]))
    own = Window.partitionBy(*by, "_b").orderBy("v")
    hit = hit.withColumn("_first", F.col("_before") + F.sum("n").over(own) - F.col("n")).where(holds(F.col("_first"), F.col("n")))
    at = lambda r: F.max(F.when((F.col("_first") <= r) & (r < F.col("_first") + F.col("n")), F.col("v")))
    found = hit.groupBy(*by, "_all").agg(*[at(r).alias(f"_r{k}_{e}") for k, pair in enumerate(ends) for e, r in enumerate(pair)])
    return found.select(*by, *[(F.col(f"_r{k}_0") + (F.col(f"_r{k}_1") - F.col(f"_r{k}_0")) * (p - F.floor(p))).alias(f"q{k}") for k, p in enumerate(place)])


def exact_quantiles(rows: DataFrame, value: str, shares: tuple[float, ...]) -> DataFrame:
    """[A5, A6, T9] One row q0, q1, ... of exact quantiles; null without values."""
    found = quantiles(value_counts(rows, [], value), [], shares)
    return found.agg(*[F.max(f"q{k}").alias(f"q{k}") for k in range(len(shares))])


def elapsed_stats(sessions: DataFrame) -> DataFrame:
    """[A4] Over successes; the sample deviation of one is 0; no row without any."""
    counts = value_counts(sessions.where(_ok), [], "elapsed").where("v is not null")
    n, v = F.col("n"), F.col("v")
    sums = counts.agg(F.sum(v * n).alias("_sum"), F.sum(n).alias("_n"), F.min(v).alias("_min"), F.max(v).alias("_max"))
    # one row each: sums, the median, and the deviation from the mean in the sums
    off = v - F.col("_sum") / F.col("_n")
    apart = counts.join(F.broadcast(sums.select("_sum", "_n")), F.lit(True)).agg(F.sum(n * off * off).alias("_apart"))
    out = sums.join(apart, F.lit(True)).join(exact_quantiles(sessions.where(_ok), "elapsed", (0.5,)), F.lit(True))
    deviation = F.when(F.col("_n") > 1, F.sqrt(F.col("_apart") / (F.col("_n") - 1))).otherwise(0.0)
    named = {"sum": F.col("_sum"), "avg": F.col("_sum") / F.col("_n"), "median": F.col("q0"), "min": F.col("_min"), "max": F.col("_max"), "stdev": deviation}
    return out.where("_sum is not null").select(*[_r(c, f"{name}_elapsed") for name, c in named.items()])


def elapsed_percentiles(sessions: DataFrame, wanted: tuple[int, ...] = PERCENTILES) -> DataFrame:
    """[A5, T9] Over successes, p90 and so on; 0 without any."""
    found = exact_quantiles(sessions.where(_ok), "elapsed", tuple(p / 100 for p in wanted))
    return found.select(*[F.round(F.coalesce(f"q{k}", F.lit(0.0)), 6).alias(f"p{p}") for k, p in enumerate(wanted)])


def elapsed_by_calls(sessions: DataFrame) -> DataFrame:
    """[A7]"""
    counts = value_counts(sessions.where(_ok), ["tool_calls"], "elapsed")
    known = F.when(F.col("v").isNotNull(), F.col("n"))
    means = counts.groupBy("tool_calls").agg(F.sum("n").alias("sessions"), _r(F.sum(F.col("v") * F.col("n")) / F.sum(known), "avg_elapsed"))
    medians = quantiles(counts, ["tool_calls"], (0.5,)).select(F.col("tool_calls").alias("_calls"), _r(F.col("q0"), "median_elapsed"))
    return means.join(medians, F.col("tool_calls").eqNullSafe(F.col("_calls")), "left").drop("_calls")


def error_distribution(sessions: DataFrame) -> DataFrame:
    """[A8, T5] Failures by class, most frequent first."""
    kind = F.coalesce(F.nullif(F.col("error_type"), F.lit("")), F.lit("unknown")).alias("error_type")
    return sessions.where("status = 'failed'").groupBy(kind).agg(F.count(F.lit(1)).alias("sessions")).orderBy(F.desc("sessions"), "error_type")


def thread_stats(sessions: DataFrame, thread: str = "tid") -> DataFrame:
    """[A9]"""
    good = F.when(F.expr(_ok), F.col("elapsed"))
    out = sessions.groupBy(thread).agg(
        F.count(F.lit(1)).alias("sessions"), _is("success").alias("success"), _is("failed").alias("failed"),
        F.coalesce(F.sum(good), F.lit(0.0)).alias("_sum"), _r(F.coalesce(F.max(good), F.lit(0.0)), "max_elapsed"),
    )
    return out.select(thread, "sessions", "success", "failed", _r(F.col("_sum"), "sum_elapsed"), "max_elapsed", _r(percent("success", "sessions"), "success_rate"), _r(percent("_sum", "success", 1.0), "avg_elapsed"))


def thread_count(sessions: DataFrame, thread: str = "tid") -> DataFrame:
    """[A10]"""
    return sessions.agg(F.count_distinct(thread).alias("threads"))


def wall_clock(sessions: DataFrame, start: str = "start_seconds") -> DataFrame:
    """[A11] From the first start to the last end known, and successes a second; 0 for no time."""
    out = sessions.agg((F.max(F.col(start) + F.col("elapsed")) - F.min(start)).alias("_wall"), _is("success").alias("success"))
    wall = F.greatest(F.coalesce("_wall", F.lit(0.0)), F.lit(0.0))
    return out.select(_r(wall, "wall_seconds"), "success", _r(percent("success", wall, 1.0), "throughput"))


def top_sessions(sessions: DataFrame, n: int = 20, key: str = "key") -> DataFrame:
    """[T1, A23] Keys with the most calls among successes, one row a key (its last session), ties by key."""
    last = sessions.where(_ok).groupBy(key).agg(F.max_by("tool_calls", F.struct("start_ts", "session")).alias("tool_calls"))
    return last.orderBy(F.desc("tool_calls"), key).limit(n)


def sessions_per_file(sessions: DataFrame) -> DataFrame:
    """[A22]"""
    return sessions.groupBy("file").agg(F.count(F.lit(1)).alias("sessions"))
