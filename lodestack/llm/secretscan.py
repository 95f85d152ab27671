"""Secret scans, with DataFrame functions only.

Base spans come from three fixed patterns; a character Markov model adds spans.
Two first-order models over ASCII, one of random strings and one of ordinary
identifiers, are counted from labelled samples by Spark; the log-likelihood ratio
of a candidate's transitions, in nats, decides. The table of ratios has 128 x 128
entries whatever the data, so it travels as a literal.

Defined cases: a null text counts as empty and has no spans; matches are leftmost
and do not overlap within a kind; positions are code points, ends exclusive;
candidates that touch a base span add nothing; repeated rows are all returned; an
empty table gives an empty table; extra columns are returned as they are, those named
base or spans are replaced.

Scale: no shuffle; each text is scanned where it is read. Positions are running sums of
the lengths of matches and the pieces between them, in log2(matches) rounds, so a text
costs time in proportion to its length and to m log m for m matches; a candidate costs
time in proportion to its length.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, text_of, unused

# Fixed patterns of the base kinds, in the order in which kinds are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")
SPANS = "array<struct<start:int,kind:int,end:int,hit:string>>"

#: A candidate of the model: a run of at least MIN_LENGTH of these characters.
MIN_LENGTH = 12
CANDIDATE = r"[A-Za-z0-9+/_=-]{%d,}" % MIN_LENGTH
PATTERNS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "random": CANDIDATE}
#: Nats for each transition by which the random model has to be the likelier one, and more for a run shorter than LENGTH.
MARGIN, LENGTH, SHORT = 0.5, 24, 0.5
#: Labelled samples: so many random strings, and at most so many ordinary words from so many documents.
RANDOM_SAMPLES = 6000
ORDINARY_DOCUMENTS = 400

# Fixed words of which ordinary identifiers are made.
WORDS = (
    "account address async batch buffer cache change check close column common connect context count current data default "
    "device domain driver empty entry event factory file find format function handle header hidden import init insert invalid "
    "key last length limit link load lock match method module network number offset option output page parent password "
    "pattern previous process program property queue read reference remote render reset response return schedule search "
    "select service size stack state stop stream style table task test thread title total type upload valid version width "
    "worker"
).split()


# Fixed short names of which ordinary paths are made, beside WORDS.
FOLDERS = (
    "api app assets bin build cfg conf core css dev dist doc docs en etc ext home html icons img java js lib lib64 local log main man "
    "media mnt node opt pkg pub py python3 site src srv static std sys test tests tmp tools usr util var vendor web www"
).split()


def labelled_samples(spark: SparkSession, docs: DataFrame | None = None, text: str = "text") -> DataFrame:
    """Samples (sample string, is_random boolean): digests in three alphabets, and identifiers and paths of WORDS, FOLDERS and the documents.

    The sizes are bounded by RANDOM_SAMPLES and ORDINARY_DOCUMENTS; documents are taken in the order of a hash.
    """
    digest = F.sha2(F.concat(F.lit("sample-"), F.col("id").cast("string")), 256)
    random = spark.range(RANDOM_SAMPLES).select(
        F.when(F.col("id") % 3 == 0, F.substring(digest, 1, 40))
        .when(F.col("id") % 3 == 1, F.regexp_replace(F.base64(F.unhex(digest)), "=", ""))
        .otherwise(F.upper(F.regexp_replace(F.base64(F.unhex(digest)), "[^A-Za-z0-9]", "")))
        .alias("sample"),
        F.lit(True).alias("is_random"),
    )
    words = F.array(*map(F.lit, WORDS))
    pick = lambda k: F.element_at(words, (F.pmod(F.xxhash64(F.col("id"), F.lit(k)), F.lit(len(WORDS))) + 1).cast("int"))
    named = spark.range(RANDOM_SAMPLES).select(
        F.when(F.col("id") % 3 == 0, F.concat_ws("_", pick(1), pick(2), pick(3)))
        .when(F.col("id") % 3 == 1, F.concat(pick(1), F.initcap(pick(2)), F.initcap(pick(3))))
        .otherwise(F.upper(F.concat_ws("_", pick(1), pick(2))))
        .alias("sample"),
        F.lit(False).alias("is_random"),
    )
    folders = F.array(*map(F.lit, FOLDERS))
    short = lambda k: F.element_at(folders, (F.pmod(F.xxhash64(F.col("id"), F.lit(k)), F.lit(len(FOLDERS))) + 1).cast("int"))
    number = F.pmod(F.xxhash64(F.col("id"), F.lit(9)), F.lit(1000)).cast("string")
    paths = spark.range(RANDOM_SAMPLES).select(
        F.when(F.col("id") % 4 == 0, F.concat(F.lit("/"), F.concat_ws("/", short(1), short(2), pick(3), pick(4))))
        .when(F.col("id") % 4 == 1, F.concat_ws("/", short(1), F.concat_ws("-", pick(2), short(3)), F.concat(pick(4), number)))
        .when(F.col("id") % 4 == 2, F.concat_ws("/", short(1), F.concat_ws("_", pick(2), pick(3)), F.initcap(pick(4)), F.concat(F.initcap(pick(5)), F.initcap(pick(6)))))
        .otherwise(F.concat_ws("/", pick(1), F.concat_ws("-", short(2), number), F.concat_ws("_", short(3), pick(4))))
        .alias("sample"),
        F.lit(False).alias("is_random"),
    )
    parts = [random, named, paths]
    if docs is not None:
        some = bounded_sample(docs.select(text_of(text).alias("_t")), "_t", ORDINARY_DOCUMENTS)
        word = F.explode(F.regexp_extract_all("_t", F.lit(r"([A-Za-z]{3,})"), F.lit(1)))
        parts.append(some.select(word.alias("sample"), F.lit(False).alias("is_random")))
    return reduce(DataFrame.union, parts)


def needed(length: Column, margin: float = MARGIN) -> Column:
    """The ratio that a run of this length has to exceed."""
    return F.lit(margin) * (length - 1) + F.lit(SHORT) * F.greatest(F.lit(LENGTH) - length, F.lit(0))


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios (random over ordinary) by 128 * first + second character, add-one smoothed.

    Samples that are null or shorter than two characters, and characters beyond ASCII, count nothing. Without any
    sample all ratios are 0.
    """
    pairs = (
        samples.where(F.length("sample") >= 2)
        .select("is_random", F.transform(F.filter(F.split("sample", "", -1), lambda c: c != ""), F.ascii).alias("c"))
        .select("is_random", F.explode(F.zip_with(F.slice("c", F.lit(1), F.size("c") - 1), F.slice("c", F.lit(2), F.size("c") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("p"))
        .select("is_random", "p.a", "p.b")
        .where("a between 0 and 127 and b between 0 and 127")
        .groupBy("is_random", "a", "b").count()
    )
    seen = [[0.0] * 16384, [0.0] * 16384]
    for r in pairs.collect():  # at most 2 x 128 x 128 rows
        seen[bool(r["is_random"])][r["a"] * 128 + r["b"]] = float(r["count"])
    alphabet = 66  # the characters of a candidate
    sums = [[sum(m[a * 128 : a * 128 + 128]) + alphabet for a in range(128)] for m in seen]
    return [math.log((seen[1][k] + 1) / sums[1][k // 128]) - math.log((seen[0][k] + 1) / sums[0][k // 128]) for k in range(16384)]


def _running(xs: Column, both: Callable[[Column, Column], Column], zero: Column) -> Column:
    """xs[0], xs[0] with xs[1], and so on: each round joins every entry with the one 1, 2, 4, ... places before."""
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(xs), F.lit(1)))).cast("int"))
    before = lambda acc, k: F.slice(F.concat(F.array_repeat(zero, F.pow(F.lit(2), k).cast("int")), acc), F.lit(1), F.size(acc))
    return F.aggregate(rounds, xs, lambda acc, k: F.zip_with(before(acc, k), acc, both))


def _found(df: DataFrame, names: dict[str, str], text: str) -> DataFrame:
    """df with a column of spans, structs (start, kind, end, hit) of a pattern's matches, for each of names(column, kind)."""
    # Steps of their own: matches are looked for once, though they are used more than once.
    hits = lambda kind: F.when(F.col(text).rlike(PATTERNS[kind]), F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)))
    df = df.withColumns({f"{c}_hits": hits(kind) for c, kind in names.items()})
    total = lambda c, kind: F.zip_with(F.slice(F.split(text, PATTERNS[kind], -1), F.lit(1), F.size(f"{c}_hits")), f"{c}_hits", lambda p, h: F.length(p) + F.length(h))
    df = df.withColumns({f"{c}_ends": F.when(F.col(f"{c}_hits").isNotNull(), total(c, kind)) for c, kind in names.items()})
    df = df.withColumns({f"{c}_ends": F.when(F.col(f"{c}_ends").isNotNull(), _running(F.col(f"{c}_ends"), lambda x, y: x + y, F.lit(0))) for c in names})
    k = lambda kind: F.lit(KINDS.index(kind))
    span = lambda kind: lambda e, h: F.struct((e - F.length(h)).alias("start"), k(kind).alias("kind"), e.alias("end"), h.alias("hit"))
    none = F.expr(f"cast(array() as {SPANS})")
    return df.withColumns({c: F.coalesce(F.zip_with(f"{c}_ends", f"{c}_hits", span(kind)), none) for c, kind in names.items()}).drop(*[f"{c}_{x}" for c in names for x in ("hits", "ends")])


def ratio_of(hit: Column, ratios: Column) -> Column:
    """The log-likelihood ratio of a string's transitions, in nats."""
    codes = F.transform(F.filter(F.split(hit, "", -1), lambda c: c != ""), lambda c: F.least(F.ascii(c), F.lit(127)))
    last = F.greatest(F.length(hit) - 1, F.lit(0))
    each = F.zip_with(F.slice(codes, F.lit(1), last), F.slice(codes, F.lit(2), last), lambda a, b: F.element_at(ratios, a * 128 + b + 1))
    return F.aggregate(each, F.lit(0.0), lambda acc, x: acc + x)


def _apart(base: Column, found: Column) -> Column:
    """Those of found that touch no span of base: none of those before reaches into it and none after begins in it."""
    every = F.array_sort(F.concat(base, found))
    is_base = lambda x: x["kind"] != KINDS.index("random")
    most = F.lit((1 << 31) - 1)
    reach = _running(F.transform(every, lambda x: F.when(is_base(x), x["end"]).otherwise(F.lit(0))), lambda x, y: F.greatest(x, y), F.lit(0))
    after = F.reverse(_running(F.reverse(F.transform(every, lambda x: F.when(is_base(x), x["start"]).otherwise(most))), lambda x, y: F.least(x, y), most))
    ends = F.zip_with(reach, after, lambda r, a: F.struct(r.alias("reach"), a.alias("after")))
    both = F.zip_with(every, ends, lambda x, e: F.struct(x.alias("span"), e.alias("ends")))
    free = lambda z: ~is_base(z["span"]) & (z["ends"]["reach"] <= z["span"]["start"]) & (z["ends"]["after"] >= z["span"]["end"])
    return F.when(F.size(found) == 0, found).when(F.size(base) == 0, found).otherwise(F.transform(F.filter(both, free), lambda z: z["span"]))


def _said(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    one = lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def scan(docs: DataFrame, ratios: list[float], text: str = "text", margin: float = MARGIN) -> DataFrame:
    """docs with base and spans, arrays of structs (start, kind index, end, hit), each by start and then kind."""
    kept = [c for c in docs.columns if c.lower() not in ("base", "spans")]
    names = unused(docs, "t", "assign", "access", "hex", "random", "ratios")
    t, assign, access, hex_, random, table = names
    out = docs.select(*[F.col(f"`{c}`") for c in kept], text_of(f"`{text}`").alias(t))
    out = _found(out, dict(zip(names[1:5], KINDS)), t)
    long_ = F.filter(assign, lambda x: F.length(F.regexp_extract(x["hit"], f"^{ASSIGN}$", 2)) >= 8)
    out = out.withColumn("base", F.array_sort(F.concat(long_, access, hex_)))
    out = out.withColumn(table, F.split(F.lit(",".join(f"{x:.6g}" for x in ratios)), ",").cast("array<double>"))
    likely = lambda x: ~x["hit"].rlike("^[0-9+/_=-]*$") & (ratio_of(x["hit"], F.col(table)) > needed(F.length(x["hit"]), margin))
    out = out.withColumn(random, F.filter(random, likely))
    return out.withColumn("spans", F.array_sort(F.concat("base", _apart(F.col("base"), F.col(random))))).drop(*names)


def digest(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """The counts, the hash of the base spans and all spans, written as kind:start:end."""
    n = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == KINDS.index(kind))).cast("long")
    return scanned.select(
        key, n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
        F.sha2(_said(F.col("base")), 256).alias("base_sha256"), _said(F.col("spans")).alias("spans"),
    )
