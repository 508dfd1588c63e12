"""One registered query per operator, over its whole tables, and the SQL it is checked against where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    collocations,
    decontamination,
    language_id,
    lexical_search,
    lm_score,
    mixing,
    quality,
    secrets,
    sharding,
    simhash,
    spotsigs,
    url_filter,
    warc,
)
from .common import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql.strip()
        return function

    return register


_WORD = r"[^\x20\x09-\x0D]+"

_MIX_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORD}')), 0)::BIGINT AS size FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, source_size * 3 AS cap FROM totals),
levelled AS (SELECT *, cap / weight AS ratio,
    (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighted),
stop AS (SELECT arg_min(level, ratio) FILTER (WHERE ratio > level) AS level FROM levelled),
targets AS (SELECT l.source, source_size,
    CASE WHEN s.level IS NULL OR ratio <= s.level THEN cap::DOUBLE ELSE weight * s.level END AS target,
    ('0x' || substr(md5('42:' || coalesce('=' || l.source, 'null')), 1, 5))::BIGINT / 1048576 AS shift
  FROM levelled l, stop s),
numbered AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id) AS n FROM sized)
SELECT doc_id, size, source_size, target,
  (CASE WHEN source_size = 0 THEN 0 ELSE
     floor(shift + n * (target / source_size)) - floor(shift + (n - 1) * (target / source_size)) END * size)::BIGINT AS taken
FROM numbered n JOIN targets t ON n.source IS NOT DISTINCT FROM t.source
"""


@query("op1_mixing", _MIX_SQL)
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query("op2_spotsigs")
def op2_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spotsigs.fingerprint_edited(table(spark, sf_dir, "documents"))
    likeness = spotsigs.pruned_jaccard
    return found.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        spotsigs.as_string("sigs").alias("fingerprint"),
        spotsigs.as_string("edited_sigs").alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )


@query("op3_lm_score")
def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_scores(table(spark, sf_dir, "documents"))


@query("op4_secrets")
def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "spans")
    of_kind = lambda kind: F.filter("spans", lambda span: span["kind"] == kind)
    written = lambda spans: F.array_join(
        F.transform(spans, lambda span: F.concat_ws(":", span["kind"], span["start"], span["end"])), ","
    )
    base = F.filter("spans", lambda span: span["kind"] != "lexed")
    return found.select(
        "doc_id",
        *[F.size(of_kind(kind)).cast("bigint").alias(f"n_{kind}") for kind in secrets.KINDS],
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )


@query("op5_language_id")
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.language_id(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select(
        "doc_id",
        language_id.held_out().alias("held_out"),
        F.col("language.lang").alias("lang_pred"),
        F.col("language.score").alias("score"),
    )


@query("op6_sharding")
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents")).withColumn("law", F.lit("key"))


@query("op7_simhash")
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", simhash.hex_digits().alias("fingerprint"), "component_id"
    )


_WARC_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first < page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""


@query("op8_warc", _WARC_SQL)
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(table(spark, sf_dir, "pages")).drop("url")


@query("op9_quality")
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    good, toxic = F.col("quality_score") >= 0.5, F.col("toxic_score") >= 0.5
    return scored.select(
        "doc_id",
        quality.held_out().alias("held_out"),
        *[f"{target}_{view}" for target in ("quality", "toxic") for view in ("text", "meta", "score")],
        good.cast("int").alias("quality_pred"),
        toxic.cast("int").alias("toxic_pred"),
        (good & ~toxic).alias("keep"),
    )


_PLAIN = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_DECONTAMINATION_SQL = f"""
WITH d AS (SELECT doc_id, {_PLAIN} AS w FROM documents),
i AS (SELECT item_id, {_PLAIN} AS w FROM benchmark),
starts AS (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(0, len(w) - least(len(w), 13) + 1)) AS s FROM i WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[s + 1:s + n], ' ') AS t FROM starts),
places AS (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS s FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n),
hits AS (SELECT doc_id, s, p.n, item_id FROM places p JOIN windows v ON p.n = v.n AND array_to_string(p.w[s + 1:s + p.n], ' ') = v.t),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query("op10_decontamination", _DECONTAMINATION_SQL)
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", ids, "contaminated")


_URL_SQL = r"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS raw, coalesce(rest, '') AS rest FROM cut),
split AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  substr(rest, length(raw) + 1) AS after FROM parts),
named AS (SELECT page_id, host, after, regexp_extract(after, '^[^?#]*') AS path FROM split),
judged AS (SELECT *, CASE
    WHEN (host = 'www.example.com' OR suffix(host, '.www.example.com')) AND prefix(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND prefix(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR suffix(host, '.com')) AND prefix(path, '/') THEN 'com/' END AS rule,
  translate(host || after, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS target FROM named),
matched AS (SELECT *, CASE
    WHEN rule IS NOT NULL THEN NULL
    WHEN regexp_matches(target, '(^|[\x00-\x24\x26-\x2C\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x7F])robots\.txt$') THEN '^robots.txt|'
    WHEN regexp_matches(target, '^([^/?#]*\.)?doubleclick([\x00-\x24\x26-\x2C\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x7F]|$)') THEN '||doubleclick^'
    WHEN regexp_matches(target, '^([^/?#]*\.)?casino-') THEN '||casino-*'
    WHEN regexp_matches(target, '^([^/?#]*\.)?adserver([\x00-\x24\x26-\x2C\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x7F]|$)') THEN '||adserver^'
    WHEN regexp_matches(target, '^([^/?#]*\.)?ads-') THEN '||ads-*'
    WHEN regexp_matches(target, '(^|[\x00-\x24\x26-\x2C\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x7F])wp-login\.php') THEN '^wp-login.php'
    WHEN regexp_matches(target, '(^|[\x00-\x24\x26-\x2C\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x7F])phishing([\x00-\x24\x26-\x2C\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x7F]|$)') THEN '^phishing^'
    WHEN regexp_matches(target, '\?.*&sessionid=', 's') THEN '?*&sessionid='
    WHEN strpos(target, '-track.') > 0 THEN '-track.*'
    WHEN strpos(target, '-pills.') > 0 THEN '-pills.*'
    WHEN strpos(target, '-farm.') > 0 THEN '-farm.*'
    WHEN strpos(target, '-casino.') > 0 THEN '-casino.*'
    WHEN strpos(target, '-bets.') > 0 THEN '-bets.*' END AS pattern FROM judged)
SELECT page_id, host, path, rule, pattern, CASE
  WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN pattern IS NULL OR pattern = '^robots.txt|' THEN 'allow' ELSE 'block' END AS verdict
FROM matched
"""


@query("op11_url_filter", _URL_SQL)
def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(table(spark, sf_dir, "pages"), url_filter.rule_table(spark))
    return judged.select("page_id", "host", "path", "rule", "pattern", "verdict")


_COLLOCATION_SQL = r"""
WITH cut AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
said AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM cut),
totals AS (SELECT lang, sum(len(w)) AS n FROM said GROUP BY lang),
lengths AS (SELECT unnest(range(1, 6)) AS k),
phrases AS (SELECT lang, k, p, count(*) AS f FROM (
    SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i : w[i:i + k - 1])) AS p FROM said, lengths WHERE len(w) >= k)
  GROUP BY lang, k, p HAVING count(*) >= 100),
covered AS (SELECT DISTINCT s.lang, s.p FROM phrases s JOIN phrases b ON s.lang = b.lang AND b.k = s.k + 1 AND b.f >= s.f
  AND (b.p[1:s.k] = s.p OR b.p[2:b.k] = s.p) WHERE s.k > 1),
cuts AS (SELECT c.lang, c.p, c.f, x.k AS first, a.f AS l, b.f AS r, 1000::HUGEINT * c.f * n // (a.f::HUGEINT * b.f) AS score
  FROM phrases c JOIN totals USING (lang) JOIN (SELECT unnest(range(1, 5)) AS k) x ON x.k < c.k
  JOIN phrases a ON a.lang = c.lang AND a.p = c.p[1:x.k] JOIN phrases b ON b.lang = c.lang AND b.p = c.p[x.k + 1:c.k]
  WHERE (c.lang, c.p) NOT IN (SELECT (lang, p) FROM covered)),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, first) = 1),
ranked AS (SELECT *, array_to_string(p, ' ') AS phrase,
  row_number() OVER (PARTITION BY lang ORDER BY score DESC, f DESC, array_to_string(p, ' ')) AS rank FROM lowest)
SELECT lang, rank::BIGINT AS rank, phrase, f::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


@query("op12_collocations", _COLLOCATION_SQL)
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


_LEXICAL_SQL = f"""
WITH d AS (SELECT doc_id, {_PLAIN} AS w FROM documents),
total AS (SELECT count(*)::BIGINT AS docs, sum(len(w))::BIGINT AS words FROM d WHERE len(w) > 0),
tf AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d) GROUP BY doc_id, n, t),
weights AS (SELECT t, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY t, docs),
terms AS (SELECT DISTINCT item_id, t FROM (SELECT item_id, unnest({_PLAIN}) AS t FROM benchmark)),
scored AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // words))))::BIGINT AS score
  FROM terms JOIN tf USING (t) JOIN weights USING (t), total GROUP BY item_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""


@query("op13_lexical_search", _LEXICAL_SQL)
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
