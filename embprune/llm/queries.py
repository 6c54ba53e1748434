"""The queries of this subpackage, with production parameters, over whole tables; and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import crc_mod5, read
from .url_filter import Rule

#: The rules of op9.
RULES = [Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/")]


def sha256_text(column) -> F.Column:
    return F.sha2(F.coalesce(column, F.lit("")).cast("binary"), 256)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import bpe

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    done = bpe.encode(docs, path, decoded="decoded")
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), sha256_text(F.col("decoded")).alias("decoded_sha256"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import KINDS, scan

    found = scan(read(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"))

    def n(kind: str) -> F.Column:
        return F.size(F.filter("secrets", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans) -> F.Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")

    base = F.filter("secrets", lambda s: s.kind != KINDS[3])
    return found.select("doc_id", n("assign"), n("access"), n("hex"), sha256_text(joined(base)).alias("base_sha256"), joined(F.col("secrets")).alias("spans"), n("random"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_contamination

    found = find_contamination(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", sha256_text(F.array_join("item_ids", ",")).alias("items_sha256"), "contaminated")


def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dup import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"), shingle_words=2)


def op5_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hmm import score_texts

    return score_texts(read(spark, sf_dir, "documents"), crc_mod5("doc_id") == 1)


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import search

    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(rows, rows.where("vec_id % 20 = 0"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("word_bpe_49k.json")).drop("text")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify, learn

    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = learn(docs.where(crc_mod5("doc_id") != 0))
    done = identify(docs.drop("lang"), profiles)
    return done.select("doc_id", (crc_mod5("doc_id") == 0).alias("held_out"), "lang_pred", "score")


def toxic_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of op9: canonical URLs of the pages whose id is labelled toxic."""
    from .url_filter import canonical, url_parts

    pages, labels = read(spark, sf_dir, "pages").select("page_id", "url"), read(spark, sf_dir, "labels")
    marked = labels.where("toxic = 1").select(F.col("doc_id").alias("page_id"))
    return pages.join(marked, "page_id", "left_semi").select(canonical(*url_parts(F.col("url"))).alias("canonical"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import filter_urls

    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, toxic_urls(spark, sf_dir), RULES).drop("url")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    done = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", sha256_text(F.col("text")).alias("kept_sha256"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import audit

    return audit(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"), read(spark, sf_dir, "labels"))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece_bpe import encode

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    done = encode(docs, public_tokenizers.path("piece_bpe_32k.model"), decoded="decoded")
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return done.select("doc_id", "n_tokens", sha256_text(ids).alias("ids_sha256"), sha256_text(F.col("decoded")).alias("decoded_sha256"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .source_divergence import divergence

    return divergence(read(spark, sf_dir, "documents").select("text", "lang", "source"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_bpe, op2_secrets, op3_decontamination, op4_near_dup, op5_hmm, op6_ann, op7_token_counts, op8_language_id, op9_url_filter, op10_line_dedup, op11_filter_audit, op12_sentencepiece, op13_source_divergence]
    return {f.__name__: f for f in found}


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP3_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, m, array_to_string(w[i : i + m - 1], ' ') AS s FROM (SELECT item, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM (SELECT item, w, least(13, len(w)) AS m FROM b WHERE len(w) > 0))),
dw AS (SELECT rid, m, i, array_to_string(w[i : i + m - 1], ' ') AS s FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)),
occ AS (SELECT rid, i, m, item FROM dw JOIN bw USING (m, s)),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT rid, i, m FROM occ)) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM occ) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN its USING (rid)
"""

OP4_SQL = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT rid, CASE WHEN len(w) < 2 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS g FROM (SELECT rid, w, unnest(range(1, greatest(len(w), 2))) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT rid, count(*) AS n FROM s GROUP BY rid),
h AS MATERIALIZED (SELECT rid, n, hash(g) AS g FROM s JOIN n USING (rid)),
l AS MATERIALIZED (SELECT a.rid AS x, b.rid AS y FROM h a JOIN h b ON a.g = b.g AND a.rid <> b.rid AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)
  GROUP BY a.rid, b.rid, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r(rid, node) AS (SELECT rid, rid FROM d UNION SELECT r.rid, l.y FROM r JOIN l ON l.x = r.node),
c AS (SELECT r.rid, min(t.doc_id) AS component_id FROM r JOIN d t ON t.rid = r.node GROUP BY r.rid)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM d JOIN c USING (rid) LEFT JOIN n USING (rid)
"""

_PARTS = rf"""SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''), {_AZ}) AS host,
  coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages"""

OP9_SQL = rf"""
WITH p AS ({_PARTS}),
c AS (SELECT *, regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') AS canonical FROM p),
listed AS (SELECT DISTINCT canonical FROM c WHERE canonical <> '' AND page_id IN (SELECT doc_id FROM labels WHERE toxic = 1)),
rules(action, rhost, rpath) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
r AS (SELECT c.*, (SELECT arg_max(rhost || rpath || ' ' || action, length(rhost || rpath)) FROM rules
  WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS found FROM c)
SELECT page_id, host, path, split_part(found, ' ', 1) AS rule,
  CASE WHEN found IS NOT NULL THEN split_part(found, ' ', 2) WHEN canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""

OP10_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT rid, coalesce(doc_id, -9223372036854775808) AS doc, pos, l[pos] AS line, trim(translate(l[pos], {_AZ}), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k FROM (SELECT rid, doc_id, l, unnest(range(1, len(l) + 1)) AS pos FROM d)),
r AS (SELECT k, max(doc) AS top FROM x WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT rid) >= 3),
y AS (SELECT x.*, r.top IS NOT NULL AND x.doc < r.top AS gone FROM x LEFT JOIN r USING (k))
SELECT doc_id, n_lines, n_dropped, sha256(coalesce(kept, '')) AS kept_sha256
FROM d JOIN (SELECT rid, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone) AS kept FROM y GROUP BY rid) USING (rid)
"""

OP11_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT t, min(doc_id) AS first_id FROM d GROUP BY t),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
  || CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) THEN 'C' ELSE '' END
  || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > first_id THEN 'E' ELSE '' END AS fails
  FROM d JOIN f USING (t) LEFT JOIN l USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY part, fails),
x(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT o, CAST(k AS INTEGER) AS step, substr(o, CAST(k AS INTEGER), 1) AS f, substr(o, 1, CAST(k AS INTEGER) - 1) AS before FROM o, range(1, 6) r(k)),
y AS (SELECT c.*, s.*, contains(fails, f) AS hit, before <> '' AND regexp_matches(fails, '[' || before || '-]') AS gone FROM c, s),
z AS (SELECT part, o AS filter_order, step, f, coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (hit AND NOT gone), 0) AS removed,
  coalesce(sum(n) FILTER (hit AND gone), 0) AS redundant, coalesce(sum(n) FILTER (fails = f), 0) AS unique_fails,
  coalesce(sum(good) FILTER (hit AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (hit AND NOT gone), 0) AS toxic_lost FROM y GROUP BY ALL),
h AS (SELECT part, f, sum(removed) AS shapley FROM z GROUP BY part, f)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(shapley AS BIGINT) AS shapley FROM z JOIN h USING (part, f)
"""

OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS MATERIALIZED (SELECT rid, lang, source, unnest(w) AS term FROM d),
k AS MATERIALIZED (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
a AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(n, 0)::HUGEINT AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
p AS MATERIALIZED (SELECT lang, source, term, n, 1 + 1000000000 * (n + 5) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p FROM a JOIN v USING (lang)),
b AS (SELECT lang, term, sum(n) AS n FROM a GROUP BY lang, term),
q AS MATERIALIZED (SELECT lang, term, 1 + 1000000000 * (n + 5) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q FROM b JOIN v USING (lang)),
s AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y USING (lang, term) WHERE x.source <> y.source GROUP BY ALL),
r AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
    LEFT JOIN s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM r QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= 50
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_decontamination": OP3_SQL, "op4_near_dup": OP4_SQL, "op9_url_filter": OP9_SQL, "op10_line_dedup": OP10_SQL, "op11_filter_audit": OP11_SQL, "op13_source_divergence": OP13_SQL}
