"""The queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bytewords, decontam, importance, langid, linededup, neardup, packing, secretscan, spelling, substring, tokenout, toxicity, urlfilter
from .common import new_path, read


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its site's boilerplate lines cut."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return linededup.drop_lines(docs)


OP1_SQL = f"""
WITH lines AS (
  SELECT coalesce(source, '') AS host, text AS page, unnest(list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> ''))) AS line
  FROM documents WHERE text IS NOT NULL),
totals AS (SELECT coalesce(source, '') AS host, count(DISTINCT text) AS total FROM documents WHERE text IS NOT NULL GROUP BY 1),
bad AS (
  SELECT c.host, list(c.line) AS bad FROM (SELECT host, line, count(DISTINCT page) AS n FROM lines GROUP BY host, line) c JOIN totals t ON c.host = t.host
  WHERE c.n >= {linededup.MIN_PAGES} AND c.n > {linededup.RATIO} * t.total GROUP BY c.host),
cut AS (
  SELECT d.doc_id, d.source, d.text, string_split(d.text, chr(10)) AS lines,
    list_filter(string_split(d.text, chr(10)), lambda x: b.bad IS NULL OR NOT list_contains(b.bad, trim(x, ' ' || chr(9) || chr(13)))) AS kept
  FROM documents d LEFT JOIN bad b ON coalesce(d.source, '') = b.host)
SELECT doc_id, source, CASE WHEN text IS NULL THEN NULL ELSE array_to_string(kept, chr(10)) END AS text,
  CASE WHEN text IS NULL THEN 0 ELSE len(lines) END AS n_lines, CASE WHEN text IS NULL THEN 0 ELSE len(lines) - len(kept) END AS n_dropped
FROM cut
"""


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every embedding whose id is divisible by 20."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(rows, rows.where("vec_id % 20 = 0"), top=20)


# Fixed dated list: list, kind, pattern, since (Unix seconds of a day in 2024), action.
JAN_1 = 1704067200
URL_LIST = [
    (name, kind, pattern, JAN_1 + 86400 * day, action)
    for name, kind, pattern, day, action in (
        ("gambling", "domain", "casino-win.example.net", 20, "add"),
        ("gambling", "domain", "casino-win.example.net", 140, "remove"),
        ("gambling", "domain", "casino-win.example.net", 200, "add"),
        ("adult", "domain", "adult-x.example.com", 0, "add"),
        ("adult", "host", "adult-x.example.com", 90, "add"),
        ("adult", "host", "adult-x.example.com", 90, "remove"),
        ("spam", "url", "tionsh.example.net/fr", 45, "add"),
        ("spam", "url", "tionsh.example.net/fr", 75, "remove"),
        ("spam", "url", "tionsh.example.net/de", 100, "add"),
        ("spam", "host", "tionsh.example.net", 300, "add"),
        ("spam", "host", "m.thther.example.org", 10, "add"),
        ("spam", "host", "m.thther.example.org", 10, "add"),
        ("malware", "domain", "example.org", 250, "add"),
        ("malware", "domain", "example.org", 260, "remove"),
        ("malware", "domain", "tiontion.example.com", 5, "add"),
        ("malware", "domain", "tiontion.example.com", 65, "remove"),
        ("malware", "domain", "tiontion.example.com", 66, "add"),
        ("malware", "url", "ththon.example.com/en", 30, "remove"),
        ("malware", "url", "ththon.example.com/en", 120, "add"),
    )
]
FETCHED = "1704067200 + (page_id * 2221) % 31622400"


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's active list entries at its fetch time, which goes by page_id over the year 2024."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url", F.expr(FETCHED).alias("fetched_at"))
    entries = spark.createDataFrame(URL_LIST, "list string, kind string, pattern string, since long, action string")
    return urlfilter.evaluate(pages, entries)


OP3_SQL = f"""
WITH entries(list, kind, pattern, since, action) AS (VALUES {", ".join(f"('{a}', '{b}', '{c}', {d}, '{e}')" for a, b, c, d, e in URL_LIST)}),
once AS (SELECT list, kind || ':' || pattern AS key, since, max(action) AS action FROM entries GROUP BY ALL),
spans AS (SELECT * FROM (SELECT list, key, since, action, lead(since) OVER (PARTITION BY list, key ORDER BY since) AS until FROM once) WHERE action = 'add'),
caps AS (SELECT page_id, url, {FETCHED} AS fetched_at, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1)), '') AS host,
  list_filter(string_split(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '') AS steps FROM pages),
keys AS (
  SELECT page_id, fetched_at, unnest(list_distinct(list_concat(
    list_transform(generate_series(1, len(string_split(host, '.'))), lambda k: 'domain:' || array_to_string(list_slice(string_split(host, '.'), k, len(string_split(host, '.'))), '.')),
    ['host:' || host],
    list_transform(generate_series(0, len(steps)), lambda k: 'url:' || host || CASE WHEN k = 0 THEN '' ELSE '/' || array_to_string(list_slice(steps, 1, k), '/') END)))) AS key
  FROM caps WHERE host IS NOT NULL),
found AS (
  SELECT k.page_id, string_agg(DISTINCT s.list, ',' ORDER BY s.list) AS lists, string_agg(s.list || '/' || s.key, ',' ORDER BY s.list || '/' || s.key) AS entries, count(*) AS n
  FROM keys k JOIN spans s ON k.key = s.key AND s.since <= k.fetched_at AND (s.until IS NULL OR k.fetched_at < s.until) GROUP BY k.page_id)
SELECT c.page_id, c.url, c.fetched_at, c.host, coalesce(f.lists, '') AS lists, coalesce(f.entries, '') AS entries, coalesce(f.n, 0) AS n_entries, f.n IS NOT NULL AS blocked
FROM caps c LEFT JOIN found f ON c.page_id = f.page_id
"""


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces with their places in sequences of 4096 tokens."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), end_id=2, length=4096)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words inside windows of the benchmark."""
    found = decontam.scan(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


OP5_SQL = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, n, array_to_string(list_slice(w, k, k + n - 1), ' ') AS win
  FROM (SELECT item, w, least(len(w), 10) AS n, unnest(generate_series(1, greatest(1, len(w) - 9))) AS k FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
found AS (
  SELECT d.doc_id, d.k, d.n, x.item
  FROM (SELECT doc_id, n, k, array_to_string(list_slice(w, k, k + n - 1), ' ') AS win
        FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM docs, sizes WHERE len(w) >= n)) d
  JOIN windows x ON d.win = x.win AND d.n = x.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(k, k + n - 1)) AS p FROM found) GROUP BY 1),
who AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY 1)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(o.n_items, 0) AS n_items, sha256(coalesce(o.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit h ON d.doc_id = h.doc_id LEFT JOIN who o ON d.doc_id = o.doc_id
"""


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from the folds that aren't held out."""
    docs = read(spark, sf_dir, "documents")
    net = langid.learn(docs)
    return langid.predict(docs.select("doc_id", "text"), net).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's group of near copies by 2-word shingles."""
    return neardup.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"), words=2, similarity=0.8)


OP7_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, k, k + 1), ' ') AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 1))) AS k FROM docs WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
both_ AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM shingles x JOIN shingles y ON x.s = y.s WHERE x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM both_ JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * i >= 80 * (p.n + q.n - i)),
reach AS (SELECT doc_id AS node, doc_id AS low FROM docs UNION SELECT l.b AS node, r.low FROM reach r JOIN links l ON l.a = r.node),
low AS (SELECT node, min(low) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, l.component_id, d.doc_id = l.component_id AS kept
FROM docs d JOIN low l ON l.node = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""


def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every paragraph of 50 words or more that repeats, and where it stays."""
    return substring.repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written in the binary format and read back."""
    docs, path = read(spark, sf_dir, "documents").select("doc_id", "text"), new_path(spark, "ids")
    tokenout.write(docs, path, vocabulary("byte_bpe_50k.json"), end_id=0)
    return tokenout.read(spark, path, ids=False)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model spans of secrets in every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    ratios = secretscan.train(secretscan.labelled_samples(spark, docs))
    return secretscan.digest(secretscan.scan(docs, ratios))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight towards the benchmark's text, and the rank of the 5 % that are drawn."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return importance.resample(docs, read(spark, sf_dir, "benchmark").select("text"), percent=5).drop("n_words")


def crc_sql(text: str) -> str:
    """SQL for the crc32 of a string's UTF-8 bytes: a fold over them with the polynomial's table."""
    code = f"list_transform(range(strlen({text})), lambda k: ('0x' || substr(hex({text}), 2 * k + 1, 2))::BIGINT)"
    return f"xor(list_reduce({code}, lambda c, b: xor({bytewords.TABLE.tolist()}[(xor(c, b) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295)"


def words_sql(text: str = "text") -> str:
    return rf"regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


OP11_SQL = f"""
WITH docs AS (SELECT doc_id, {words_sql()} AS w FROM documents),
runs AS (SELECT doc_id, array_to_string(list_slice(w, k, k + n - 1), ' ') AS f FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM docs, (VALUES (1), (2), (3)) v(n) WHERE len(w) >= n)),
goal AS (SELECT array_to_string(list_slice(w, k, k + n - 1), ' ') AS f FROM (SELECT w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM (SELECT {words_sql()} AS w FROM benchmark), (VALUES (1), (2), (3)) v(n) WHERE len(w) >= n)),
per_text AS MATERIALIZED (SELECT doc_id, f, count(*) AS n FROM runs GROUP BY doc_id, f),
hashed AS MATERIALIZED (SELECT f, CAST({crc_sql("f")} AS BIGINT) % 10000 AS bucket FROM (SELECT f FROM per_text UNION SELECT f FROM goal)),
source AS (SELECT bucket, sum(n) AS s FROM per_text JOIN hashed USING (f) GROUP BY bucket),
target AS (SELECT bucket, count(*) AS t FROM goal JOIN hashed USING (f) GROUP BY bucket),
gain AS (
  SELECT b.bucket, CAST(floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * ((SELECT coalesce(sum(s), 0) FROM source)::DOUBLE + 10000) / ((coalesce(s, 0)::DOUBLE + 1) * ((SELECT coalesce(sum(t), 0) FROM target)::DOUBLE + 10000)))) AS BIGINT) AS g
  FROM range(10000) b(bucket) LEFT JOIN source ON source.bucket = b.bucket LEFT JOIN target ON target.bucket = b.bucket),
weights AS (SELECT doc_id, sum(n * g) AS weight FROM per_text JOIN hashed USING (f) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, len(w) AS n_words, 3 * len(w) - CASE WHEN len(w) = 0 THEN 0 WHEN len(w) = 1 THEN 2 ELSE 3 END AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) AS BIGINT) + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM docs d LEFT JOIN weights ON weights.doc_id = d.doc_id),
ranks AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN r <= 5 * n // 100 THEN r END AS rank FROM scored s LEFT JOIN ranks ON ranks.doc_id = s.doc_id
"""


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word, its near words, its form and its root."""
    return spelling.variants(read(spark, sf_dir, "documents").select("doc_id", "text"))


OP12_SQL = rf"""
WITH RECURSIVE runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents)
  WHERE length(run) >= 5 GROUP BY doc_id, run),
hashed AS MATERIALIZED (SELECT run, n, {crc_sql("(doc_id || ':' || run)")} AS h FROM runs),
words AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
gaps AS MATERIALIZED (SELECT word, n, k, substr(word, 1, k - 1) AS l, substr(word, k + 1) AS r FROM (SELECT word, n, unnest(generate_series(1, length(word))) AS k FROM words)),
shorter AS MATERIALIZED (SELECT DISTINCT g.word AS long, g.n AS long_n, w.word AS short, w.n AS short_n FROM gaps g JOIN words w ON g.l || g.r = w.word),
near AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM gaps a JOIN gaps b ON a.k = b.k AND a.l = b.l AND a.r = b.r AND a.word <> b.word
  UNION ALL SELECT long, long_n, short, short_n FROM shorter UNION ALL SELECT short, short_n, long, long_n FROM shorter),
best AS (SELECT word, n, near, near_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS r FROM near),
forms AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.near_n >= 2 * w.n THEN b.near END AS form, CASE WHEN b.near_n >= 2 * w.n THEN b.near_n END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word AND b.r = 1),
way AS (SELECT word, word AS at, form FROM forms UNION ALL SELECT way.word, f.word, f.form FROM way JOIN forms f ON way.form = f.word)
SELECT f.word, f.form, way.at AS root, f.n, f.n_near, f.form_n FROM forms f JOIN way ON way.word = f.word AND way.form IS NULL
"""


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learned from the labels of the folds that aren't held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.classified(docs, toxicity.learn(docs, read(spark, sf_dir, "labels").select("doc_id", "toxic")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_line_dedup": op1_line_dedup, "op2_nearest_neighbours": op2_nearest_neighbours, "op3_url_filters": op3_url_filters, "op4_packing": op4_packing, "op5_decontamination": op5_decontamination, "op6_language_id": op6_language_id, "op7_near_duplicates": op7_near_duplicates, "op8_repeated_passages": op8_repeated_passages, "op9_token_ids": op9_token_ids, "op10_secret_scan": op10_secret_scan, "op11_importance_resampling": op11_importance_resampling, "op12_spelling_variants": op12_spelling_variants, "op13_toxicity": op13_toxicity}


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1_SQL, "op3_url_filters": OP3_SQL, "op5_decontamination": OP5_SQL, "op7_near_duplicates": OP7_SQL, "op11_importance_resampling": OP11_SQL, "op12_spelling_variants": OP12_SQL}
