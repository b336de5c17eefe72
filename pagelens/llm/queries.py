"""Registered queries: each applies one operator to its whole table and derives the digest columns.

ORACLE_SQL holds DuckDB SQL for those that SQL can express; the others are held against brute force in tests/llm.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (bpe, chat_threads, decontaminate, embedding_dedup, license_scan, ngram_join, periodic_runs, pitman_yor, quality, rans, substring_dedup,
               url_filter, whitening)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (ngram_join.ngram_jaccard_join(table(spark, sf_dir, "documents"), size=4, percent=85)
            .select("doc_id", "n_shingles", "component_id", "n_links"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=10)
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op3_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.bpe_roundtrip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


#: (host, path, verdict)
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)


def op5_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations as mails that quote the turns before; the result has the quotes removed and the replies linked."""
    return chat_threads.quote_links(chat_threads.as_mail(table(spark, sf_dir, "conversations")))


def op6_pitman_yor_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score_documents(table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("row.doc_id", F.round("p_bad", 6).alias("p_bad"), "rejected")


def op8_rans_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rans.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, special=True)
    return out.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"), length=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_near_dedup(table(spark, sf_dir, "embeddings"))


def repeated_tails(docs: DataFrame) -> DataFrame:
    """The documents (doc_id, text) of op11: in a tenth of them the words from the a-th on repeat p words (fixed by the query's contract).
    A null doc_id has no checksum and keeps its text."""
    h, n, i = F.col("h"), F.size("w"), F.col("i")
    a = F.pmod(F.floor(h / 10), n)
    p = 1 + F.floor((n - a) / (3 + F.pmod(F.floor(h / 10), F.lit(8))))
    d = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    split = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    d = d.withColumn("w", F.when(F.pmod("h", F.lit(10)) == 0, split)).withColumn("a", a).withColumn("p", p)
    word = "transform(sequence(0, size(w) - 1), i -> get(w, cast(if(i < a, i, a + (i - a) % p) as int)))"
    return d.select("doc_id", F.when(F.size("w") > 0, F.array_join(F.expr(word), " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs.periodic_runs(repeated_tails(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    out = out.withColumn("best", best)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.p")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.p")).alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    templates = spark.createDataFrame(license_scan.TEMPLATES, "label string, text string")
    return license_scan.license_scan(table(spark, sf_dir, "documents"), templates).drop("found")


QUERIES = {f.__name__: f for f in (
    op1_ngram_jaccard_join, op2_benchmark_decontamination, op3_byte_level_bpe, op4_url_filters, op5_quotation_linking,
    op6_pitman_yor_scoring, op7_quality_classifier, op8_rans_token_files, op9_substring_dedup, op10_embedding_near_dedup, op11_periodic_runs,
    op12_embedding_whitening, op13_license_scan)}

_LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANK_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_ALNUM_WORDS = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": f"""
WITH RECURSIVE d AS (SELECT doc_id, {_BLANK_WORDS.format(_LOW.format("coalesce(text, '')"))} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, list_slice(w, i, i + least(len(w), 4) - 1) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 4) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 85 * (a.n + b.n - k)),
r(doc, reach) AS (SELECT x, y FROM l UNION SELECT r.doc, l.y FROM r JOIN l ON l.x = r.reach)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(least(d.doc_id, (SELECT min(reach) FROM r WHERE r.doc = d.doc_id)), d.doc_id)::BIGINT AS component_id,
(SELECT count(*) FROM l WHERE l.x = d.doc_id)::BIGINT AS n_links FROM d LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op2_benchmark_decontamination": f"""
WITH d AS (SELECT doc_id, {_ALNUM_WORDS.format(_LOW.format("coalesce(text, '')"))} AS w FROM documents),
b AS (SELECT item_id, {_ALNUM_WORDS.format(_LOW.format("coalesce(text, '')"))} AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, list_slice(w, i, i + least(len(w), 10) - 1) AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
p AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM v) WHERE len(w) >= k),
h AS (SELECT p.doc_id, p.i, p.k, v.item_id FROM p JOIN v ON v.k = p.k AND v.g = list_slice(p.w, p.i, p.i + p.k - 1)),
c AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id""",
    "op4_url_filters": """
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
r(rh, rp, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block'))
SELECT page_id, host, path, (SELECT rh || rp FROM r WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) ORDER BY length(rh || rp) DESC LIMIT 1) AS rule,
coalesce((SELECT verdict FROM r WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) ORDER BY length(rh || rp) DESC LIMIT 1), 'allow') AS verdict FROM u""",
    "op5_quotation_linking": r"""
WITH RECURSIVE c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
o AS (SELECT conv_id, turn, i, lower(trim(regexp_replace(string_split(text, chr(10))[i], '\s+', ' ', 'g'))) AS s FROM (SELECT conv_id, turn, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM c)),
f AS (SELECT conv_id, s, min(turn) AS first FROM o WHERE s <> '' GROUP BY conv_id, s),
q AS (SELECT conv_id, turn + 1 AS turn, i, 1 AS level, s FROM o WHERE s <> '' UNION ALL SELECT conv_id, turn + 2, 0, 2, s FROM o WHERE i = 1 AND s <> ''),
l AS (SELECT q.conv_id, q.turn, level, i, first FROM q JOIN c USING (conv_id, turn) JOIN f ON f.conv_id = q.conv_id AND f.s = q.s),
p AS (SELECT conv_id, turn, count(*) AS n, arg_max(first, i) FILTER (level = 1) AS reply_to FROM l GROUP BY conv_id, turn),
t(conv_id, turn, up, depth) AS (SELECT conv_id, turn, turn, 0 FROM c UNION ALL SELECT t.conv_id, t.turn, p.reply_to, depth + 1 FROM t JOIN p ON p.conv_id = t.conv_id AND p.turn = t.up WHERE p.reply_to IS NOT NULL),
z AS (SELECT conv_id, turn, min(up) AS root_turn, max(depth) AS depth FROM t GROUP BY conv_id, turn)
SELECT c.conv_id, c.turn, role, p.reply_to, z.root_turn, z.depth::BIGINT AS depth, coalesce(p.n, 0)::BIGINT AS n_quoted, coalesce(p.n, 0)::BIGINT AS n_linked,
trim(regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g')) AS text
FROM c LEFT JOIN p ON p.conv_id = c.conv_id AND p.turn = c.turn JOIN z ON z.conv_id = c.conv_id AND z.turn = c.turn""",
    "op9_substring_dedup": f"""
WITH d AS (SELECT doc_id, {_BLANK_WORDS.format("coalesce(text, '')")} AS w FROM documents),
v AS (SELECT doc_id, i, row_number() OVER (PARTITION BY list_slice(w, i, i + 19) ORDER BY doc_id, i) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM v WHERE k > 1),
x AS (SELECT doc_id, w[j] AS word, j FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS j FROM d)),
y AS (SELECT x.doc_id, count(g.j) AS n_removed, string_agg(word, ' ' ORDER BY x.j) FILTER (g.j IS NULL) AS kept FROM x LEFT JOIN g ON g.doc_id = x.doc_id AND g.j = x.j GROUP BY x.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN y ON y.doc_id = d.doc_id""",
    "op10_embedding_near_dedup": """
WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS n FROM e WHERE list_dot_product(v, v) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id WHERE list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.98),
r(vec, reach) AS (SELECT x, y FROM l UNION SELECT r.vec, l.y FROM r JOIN l ON l.x = r.reach),
c AS (SELECT vec_id, coalesce(least(vec_id, (SELECT min(reach) FROM r WHERE r.vec = vec_id)), vec_id)::BIGINT AS component_id FROM embeddings)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.x = vec_id)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM c""",
}

#: Levels of the prefix doubling in the SQL of op11: windows of up to 2**13 words, texts of up to 32,768 words.
_LEVELS = 13


def _runs_sql() -> str:
    """Periods from neighbouring equal windows of 1, 2, 4, ... words (ranked by doubling), runs from stretches of equal words that far apart."""
    levels = ["k0 AS (SELECT doc_id, i, dense_rank() OVER (ORDER BY w) AS r FROM x)"]
    for k in range(1, _LEVELS + 1):
        levels.append(f"k{k} AS (SELECT a.doc_id, a.i, dense_rank() OVER (ORDER BY a.r, b.r) AS r FROM k{k - 1} a JOIN k{k - 1} b ON b.doc_id = a.doc_id AND b.i = a.i + {2 ** (k - 1)})")
    pairs = " UNION ".join(f"SELECT doc_id, d AS q FROM (SELECT doc_id, lead(i) OVER (PARTITION BY doc_id, r ORDER BY i) - i AS d FROM k{k}) WHERE d <= {2 ** k} AND d > {2 ** k // 2}"
                           for k in range(_LEVELS + 1))
    words = _BLANK_WORDS.format("coalesce(text, '')")
    crc = "(SELECT c FROM crc WHERE crc.doc_id = documents.doc_id)"
    return f"""
WITH RECURSIVE bytes AS (SELECT doc_id, ascii(substr(doc_id::VARCHAR, j::INT, 1)) AS b, j FROM (SELECT DISTINCT doc_id, unnest(range(1, length(doc_id::VARCHAR) + 1)) AS j FROM documents)),
crc_step(doc_id, j, bit, c) AS (SELECT DISTINCT doc_id, 0::BIGINT, 8, 4294967295::BIGINT FROM documents
UNION ALL SELECT s.doc_id, CASE WHEN bit = 8 THEN s.j + 1 ELSE s.j END, CASE WHEN bit = 8 THEN 1 ELSE bit + 1 END,
CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END
FROM (SELECT s.doc_id, s.j, s.bit, CASE WHEN s.bit = 8 THEN xor(s.c, b.b::BIGINT) ELSE s.c END AS v FROM crc_step s LEFT JOIN bytes b ON b.doc_id = s.doc_id AND b.j = s.j + 1 WHERE s.bit < 8 OR b.b IS NOT NULL) s),
crc AS (SELECT doc_id, xor(arg_max(c, j * 10 + bit), 4294967295) AS c FROM crc_step WHERE bit = 8 GROUP BY doc_id),
o AS (SELECT doc_id, {crc} AS h, {words} AS w FROM documents),
pa AS (SELECT doc_id, h, w, len(w) AS n, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM o),
pl AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM pa),
x AS (SELECT doc_id, i, CASE WHEN h % 10 = 0 AND i >= a THEN w[a + (i - a) % p + 1] ELSE w[i + 1] END AS w FROM (SELECT *, unnest(range(0, n)) AS i FROM pl)),
{", ".join(levels)},
c AS ({pairs}),
e AS (SELECT c.doc_id, q, a.i, a.i - row_number() OVER (PARTITION BY c.doc_id, q ORDER BY a.i) AS g FROM c JOIN k0 a ON a.doc_id = c.doc_id JOIN k0 b ON b.doc_id = c.doc_id AND b.i = a.i + q AND b.r = a.r),
f AS (SELECT doc_id, q, min(i) AS start, max(i) + 1 + q - min(i) AS length FROM e GROUP BY doc_id, q, g HAVING max(i) + 1 + q - min(i) >= greatest(6, 4 * q)),
t AS (SELECT doc_id, start, length, min(q) AS period FROM f GROUP BY doc_id, start, length),
m AS (SELECT doc_id, count(*) AS n_runs, max(struct_pack(l := length, s := -start, p := -period)) AS best, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM t GROUP BY doc_id),
dead AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM t),
k AS (SELECT x.doc_id, string_agg(w, ' ' ORDER BY x.i) AS kept FROM x WHERE NOT EXISTS (SELECT 1 FROM dead WHERE dead.doc_id = x.doc_id AND dead.i = x.i) GROUP BY x.doc_id)
SELECT o.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, (-best.s)::BIGINT AS start, best.l::BIGINT AS length, (-best.p)::BIGINT AS period, (1000 * best.l // -best.p)::BIGINT AS exponent_milli,
sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM o LEFT JOIN m ON m.doc_id = o.doc_id LEFT JOIN k ON k.doc_id = o.doc_id"""


def _license_sql() -> str:
    """Every block against every template by counting common words."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    words = _ALNUM_WORDS.format(_LOW.format("coalesce(text, '')"))
    values = ", ".join(f"({i}, {quoted(label)}, {quoted(text)})" for i, (label, text) in enumerate(license_scan.TEMPLATES))
    phrases = ", ".join(f"({quoted(label)}, {quoted(text)})" for text, label in license_scan.PHRASES)
    return f"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents),
t AS (SELECT id, label, w, greatest(8, (2 ** ceil(log2(len(w))))::BIGINT) AS s, len(list_distinct(w)) AS size FROM (SELECT id, label, {words} AS w FROM (VALUES {values}) v(id, label, text))),
p AS (SELECT label, string_split(text, ' ') AS w FROM (VALUES {phrases}) v(label, text)),
x AS (SELECT doc_id, i, w[i + 1] AS word FROM (SELECT doc_id, w, unnest(range(0, len(w))) AS i FROM d)),
b AS (SELECT d.doc_id, x.i, label FROM p JOIN x ON x.word = p.w[1] JOIN d ON d.doc_id = x.doc_id AND list_slice(d.w, x.i + 1, x.i + len(p.w)) = p.w),
bs AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY doc_id),
v AS (SELECT id, s, label, size, unnest(list_distinct(w)) AS word FROM t),
h AS (SELECT doc_id, id, label, size, x.word, x.i // s AS block FROM v JOIN x ON x.word = v.word UNION SELECT doc_id, id, label, size, x.word, x.i // s - 1 FROM v JOIN x ON x.word = v.word WHERE x.i >= s),
g AS (SELECT doc_id, label, count(*) / size AS share FROM h GROUP BY doc_id, block, id, label, size HAVING count(*) >= ceil(round({license_scan.THRESHOLD} * size, 9))),
l AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM g UNION SELECT doc_id, label FROM b) GROUP BY doc_id),
s AS (SELECT doc_id, max(share) AS share FROM g GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels,
coalesce(labels, '') AS labels, greatest(coalesce(share, 0.0), CASE WHEN n_base > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS score
FROM d LEFT JOIN bs ON bs.doc_id = d.doc_id LEFT JOIN l ON l.doc_id = d.doc_id LEFT JOIN s ON s.doc_id = d.doc_id"""


ORACLE_SQL |= {"op11_periodic_runs": _runs_sql(), "op13_license_scan": _license_sql()}
