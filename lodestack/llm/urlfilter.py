"""URL filters with dated lists: an as-of join of captures with validity intervals.

A list entry is (list, kind, pattern, since, action): kind ``domain`` covers a domain
and all below it, ``host`` one host, ``url`` a host and path down to a ``/``; action
``add`` or ``remove`` holds from since on. The entries of a pattern, by time, become
intervals, from an ``add`` up to the next entry of the pattern; at one time a
``remove`` wins. A capture meets the intervals that hold its fetch time.

Defined cases: a null or unreadable url, or a null fetch time, matches nothing;
entries with a null field, another kind or another action count nothing; repeated
entries count once and repeated captures are all returned; hosts are compared in lower
case, without user, port and final dot; a fetch at the first second of an interval is
in it and one at its end isn't; no entries or no captures give no matches; extra
columns are returned as they are, those named like an output column are replaced.

Scale: intervals are dealt by (pattern, period), captures by the keys of their url and
their period, so a pattern with many entries over time meets only those near the fetch
time. Periods are bounded by at most ``PERIODS`` quantiles of the captures' own fetch
times, so an interval has at most as many rows, however long it is, however far off
single times are, and whatever their unit is. The list is broadcast if its measured size
is below ``BROADCAST_BYTES``; beyond it is joined by key, where adaptive execution splits
hot hosts. Matches are few; every capture keeps its place and is joined with them by url
and time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, unused

KINDS = ("domain", "host", "url")
PERIODS = 64
BROADCAST_BYTES = 8 << 20


def host_of(url: Column) -> Column:
    """The host in lower case; empty if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)", 1))
    return F.regexp_replace(host, r"\.$", "")


def keys_of(url: Column) -> Column:
    """What entries of each kind can name a url by: its host's domains, its host, and its path's prefixes."""
    host = host_of(url)
    labels = F.split(host, r"\.", -1)
    path = F.regexp_extract(url, r"^[^:]+://[^/?#]*([^?#]*)", 1)
    steps = F.filter(F.split(path, "/", -1), lambda s: s != "")
    below = lambda xs, n: F.slice(xs, 1, n)
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.concat(F.lit("domain:"), F.array_join(F.slice(labels, k, F.size(labels)), ".")))
    urls = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda k: F.concat(F.lit("url:"), F.concat_ws("/", host, F.when(k > 0, F.array_join(below(steps, F.greatest(k, F.lit(1))), "/")))))
    return F.when(host != "", F.array_distinct(F.concat(domains, F.array(F.concat(F.lit("host:"), host)), urls)))


def intervals(entries: DataFrame) -> DataFrame:
    """list, key, since, until (null: still active), from dated entries with long or timestamp since."""
    pattern = F.regexp_replace(F.when(F.col("kind") == "url", F.col("pattern")).otherwise(F.lower("pattern")), r"[./]+$", "")
    known = F.col("kind").isin(*KINDS) & F.col("action").isin("add", "remove") & F.col("list").isNotNull() & F.col("pattern").isNotNull() & F.col("since").isNotNull()
    rows = entries.where(known).select("list", F.concat_ws(":", "kind", pattern).alias("key"), "since", "action")
    # of one time the last counts: "remove" sorts after "add"
    rows = rows.groupBy("list", "key", "since").agg(F.max("action").alias("action"))
    after = Window.partitionBy("list", "key").orderBy("since")
    return rows.withColumn("until", F.lead("since").over(after)).where("action = 'add'").select("list", "key", "since", "until")


def _seconds(df: DataFrame, col: str) -> Column:
    return F.unix_seconds(col) if dict(df.dtypes)[col] == "timestamp" else F.col(col).cast("long")


def bounds(seen: DataFrame, periods: int = PERIODS) -> list[int]:
    """Fetch times, in order, at which periods of about equally many captures begin."""
    shares = F.array(*[F.lit(k / periods) for k in range(1, periods)])
    found = seen.agg(F.percentile_approx(_seconds(seen, "fetched"), shares, F.lit(1000))).first()[0]
    return sorted(set(found or []))


def matches(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched_at") -> DataFrame:
    """Active entries of each capture: url, fetched, list, key."""
    seen = captures.select(F.col(f"`{url}`").alias("url"), F.col(f"`{fetched}`").alias("fetched")).where("url is not null and fetched is not null")
    edges = bounds(seen)
    period = lambda c: reduce(lambda n, e: n + (c >= F.lit(e)).cast("int"), edges, F.lit(0))
    spans = intervals(entries)
    # An interval without an end goes on to the last period.
    last = F.coalesce(period(_seconds(spans, "until")), F.lit(len(edges)))
    spans = spans.withColumn("_period", F.explode(F.sequence(period(_seconds(spans, "since")), last)))
    spans = stored(spans, "intervals")
    size = spans.agg(F.sum(F.length("key") + F.length("list") + 48)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        spans = F.broadcast(spans)
    keyed = seen.select("url", "fetched", period(_seconds(seen, "fetched")).alias("_period"), F.explode(keys_of(F.col("url"))).alias("key"))
    inside = (F.col("since") <= F.col("fetched")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until")))
    return keyed.join(spans, ["key", "_period"]).where(inside).select("url", "fetched", "list", "key")


def evaluate(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched_at") -> DataFrame:
    """All captures with host, lists (active lists, sorted, comma-joined), entries (active patterns, likewise), n_entries and blocked."""
    # At most lists x keys of one url; only captures with a match are shuffled, and repeated ones combine before.
    found = matches(captures, entries, url, fetched).groupBy("url", "fetched").agg(F.array_sort(F.collect_set(F.struct("list", "key"))).alias("_s"))
    given = [c for c in captures.columns if c.lower() not in ("host", "lists", "entries", "n_entries", "blocked") or c in (url, fetched)]
    u, t, n, lists, names = unused(captures, "url", "fetched", "n", "lists", "entries")
    found = found.select(
        F.col("url").alias(u), F.col("fetched").alias(t), F.size("_s").alias(n),
        F.array_join(F.array_distinct(F.transform("_s", lambda s: s["list"])), ",").alias(lists),
        F.array_join(F.array_sort(F.transform("_s", lambda s: F.concat_ws("/", s["list"], s["key"]))), ",").alias(names),
    )
    out = captures.select(*[f"`{c}`" for c in given]).join(found, (F.col(f"`{url}`") == F.col(u)) & (F.col(f"`{fetched}`") == F.col(t)), "left")
    host = host_of(F.col(f"`{url}`"))
    return out.withColumns({
        "host": F.when(host != "", host), "lists": F.coalesce(lists, F.lit("")), "entries": F.coalesce(names, F.lit("")),
        "n_entries": F.coalesce(n, F.lit(0)).cast("long"), "blocked": F.col(n).isNotNull(),
    }).drop(u, t, lists, names, n)
