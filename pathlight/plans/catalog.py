"""Every operator run over the given tables, each next to the SQL that must give the same rows.

The tables hold no source files, so file tables are derived from them: every document becomes a file whose path is made
from its source, language and number. A later state of the corpus drops or blanks the documents labelled toxic, edits
those of low quality and adds the web pages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import operators as op
from ..functions import WHITESPACE, cosine_distance, suffix, vector_literal
from ..operators.ann import CellIndex
from ..operators.search import INDEX_VIEW
from ..session import scratch_dir
from ..sources import IndexStore, change_list, corpus_scan, ignore_rules, path_list, spread, table_corpus, write_files
from ..streaming import stream_changes
from .pipelines import add_delete_index, full_changes, full_index, incremental_index, refit_model, stored_embedder

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

DIM = 1024
RULES = ["src1/*", "*.md", "*/doc_[0-4]?.py", "src2/??/doc_1*", "*/[!e]?/doc_9*", "README", "*secret*"]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql.strip()
        return function

    return register


# --- shared inputs --------------------------------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def document_path() -> Column:
    extension = F.create_map(*[F.lit(v) for v in ("en", ".py", "de", ".cpp", "fr", ".hpp", "es", ".md")])
    return F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), "doc_id", F.try_element_at(extension, F.col("lang")))


def with_path(rows: DataFrame) -> DataFrame:
    return rows.withColumn("file_path", document_path())


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_corpus(documents(spark, sf_dir), document_path(), "text")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its path and labels, which are NULL for most."""
    labels = table(spark, sf_dir, "labels")
    return with_path(table(spark, sf_dir, "documents")).join(labels, "doc_id", "left")


def later_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = (
        F.when((F.col("toxic") == 1) & (F.col("quality") == 0), F.lit(" \n\t 　\n"))
        .when(F.col("quality") == 0, F.concat("text", F.lit("\nrevised")))
        .otherwise(F.col("text"))
    )
    dropped = F.coalesce((F.col("toxic") == 1) & (F.col("quality") == 1), F.lit(False))
    kept = labelled(spark, sf_dir).filter(~dropped)
    pages = table(spark, sf_dir, "pages")
    web = table_corpus(pages, F.concat(F.lit("web/"), "page_id", F.lit(".html")), "html")
    return table_corpus(kept, "file_path", text).unionByName(web)


def first_vector(embeddings: DataFrame) -> list[float]:
    return embeddings.orderBy("vec_id").first()["embedding"]


def letter_counts() -> Callable[[list[str]], list[list[float]]]:
    """Stand-in for a model: how often four letters occur in a text."""
    return lambda texts: [[float(text.count(letter)) for letter in "aeio"] for text in texts]


def digest(index: DataFrame) -> DataFrame:
    return index.select("file_path", F.md5("code_text").alias("digest"), F.size("embedding").alias("dim"))


_PATH = """source || '/' || lang || '/doc_' || doc_id
      || CASE lang WHEN 'en' THEN '.py' WHEN 'de' THEN '.cpp' WHEN 'fr' THEN '.hpp' WHEN 'es' THEN '.md' END"""
_NEWLINES = r"regexp_replace({}, '\r\n?', chr(10), 'g')"
_FILES = f"files AS (SELECT doc_id, lang, source, {_PATH} AS file_path, {_NEWLINES.format('text')} AS content FROM documents)"
_LABELLED = f"labelled AS (SELECT d.*, l.quality, l.toxic, {_PATH} AS file_path FROM documents d LEFT JOIN labels l USING (doc_id))"
_LATER = f"""{_LABELLED}, later AS (
  SELECT file_path, {_NEWLINES.format('''CASE
      WHEN toxic = 1 AND quality = 0 THEN ' ' || chr(10) || chr(9) || chr(160) || chr(12288) || chr(10)
      WHEN quality = 0 THEN text || chr(10) || 'revised' ELSE text END''')} AS content
  FROM labelled WHERE NOT coalesce(toxic = 1 AND quality = 1, false)
  UNION ALL SELECT 'web/' || page_id || '.html', {_NEWLINES.format('html')} FROM pages)"""
_TRIM = f"trim({{}}, '{WHITESPACE}')"
_KEPT = """NOT (starts_with(file_path, 'src1/') OR ends_with(file_path, '.md')
  OR regexp_full_match(file_path, '.*/doc_[0-4].\\.py') OR regexp_full_match(file_path, 'src2/../doc_1.*')
  OR regexp_full_match(file_path, '.*/[^e]./doc_9.*') OR file_path = 'README' OR contains(file_path, 'secret'))"""
_CODE = f"CASE WHEN regexp_matches(file_path, '[.](py|cpp|hpp)$') THEN {_TRIM.format('content')} ELSE content END"


def _group(path: str) -> str:
    return f"('0x' || substr(md5({path}), 1, 8))::BIGINT % 65536"


_DISTANCE = "least(greatest(list_cosine_distance({}::DOUBLE[], {}::DOUBLE[]), 0), 2)"


# --- sources --------------------------------------------------------------------------------------------------------


@query(
    "corpus_scan",
    f"""WITH {_FILES} SELECT CASE doc_id % 6 WHEN 0 THEN '_' WHEN 1 THEN '.' ELSE '' END || source || '/' || lang || '/'
    || CASE doc_id % 5 WHEN 0 THEN '_' WHEN 1 THEN '.' WHEN 2 THEN '__' ELSE '' END || doc_id AS file_path,
  CASE WHEN doc_id % 11 = 0 THEN 0 ELSE length(content) END AS characters,
  sha256(CASE WHEN doc_id % 11 = 0 THEN '' ELSE content END) AS sha FROM files""",
)
def corpus_scan_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents written as files - many with names that begin with ``.`` or ``_``, some of them empty - and scanned."""
    start = lambda column, cases: F.element_at(
        F.array(*[F.lit(c) for c in cases]), (F.col(column) % len(cases) + 1).cast("int")
    )
    path = F.concat(
        start("doc_id", ["_", ".", "", "", "", ""]), "source", F.lit("/"), "lang", F.lit("/"),
        start("doc_id", ["_", ".", "__", "", ""]), F.col("doc_id").cast("string"),
    )
    text = F.when(F.col("doc_id") % 11 == 0, F.lit("")).otherwise(F.col("text"))
    root = f"{scratch_dir(spark)}/corpus"
    write_files(documents(spark, sf_dir).select(path.alias("file_path"), text.cast("binary").alias("bytes")), root)
    return corpus_scan(spark, root).select(
        "file_path", F.length("content").cast("bigint").alias("characters"), F.sha2("content", 256).alias("sha")
    )


_PIECES = f"list_filter(regexp_split_to_array(text, '[{WHITESPACE}]+'), lambda x: x <> '')"


@query(
    "path_list",
    f"""
SELECT conv_id, turn, unnest(generate_series(0, len(pieces) - 1)) AS position, unnest(list_transform(pieces, lambda x:
  CASE WHEN parts(x) = '' AND NOT starts_with(x, '/') THEN '.' ELSE
    CASE WHEN regexp_matches(x, '^//([^/]|$)') THEN '//' WHEN starts_with(x, '/') THEN '/' ELSE '' END || parts(x) END
)) AS file_path
FROM (SELECT conv_id, turn, {_PIECES} AS pieces FROM conversations)
""".replace("parts(x)", "array_to_string(list_filter(string_split(x, '/'), lambda y: y NOT IN ('', '.')), '/')"),
)
def path_list_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return path_list(lists, "text").withColumn("position", F.col("position").cast("bigint"))


def change_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as lines of a change list; some are blank or lack a field."""
    user = F.concat(F.lit("\tuser/"), F.col("user_id"))
    line = (
        F.when(F.col("event_type") == "signup", F.concat(F.lit("A"), user))
        .when(F.col("event_type") == "view", F.concat(F.lit("M"), user))
        .when(F.col("event_type") == "error", F.concat(F.lit("D"), user))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("R100"), user, F.lit("\tbuyer/"), F.col("user_id")))
        .when(F.col("value") > 20, F.concat(F.lit("click "), F.col("user_id")))
        .otherwise(F.lit(""))
    )
    return table(spark, sf_dir, "events").select("event_id", line.alias("value"))


@query(
    "change_list",
    """
SELECT event_id, CASE event_type WHEN 'signup' THEN 'A' WHEN 'view' THEN 'M' WHEN 'error' THEN 'D' ELSE 'R100' END AS status,
  'user/' || user_id AS file_path, CASE event_type WHEN 'purchase' THEN 'buyer/' || user_id END AS new_path
FROM events WHERE event_type IN ('signup', 'view', 'error', 'purchase')
""",
)
def change_list_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return change_list(change_lines(spark, sf_dir))


@query(
    "route_changes",
    """
SELECT event_id, CASE event_type WHEN 'signup' THEN 'A' WHEN 'view' THEN 'M' ELSE 'D' END AS change,
  'user/' || user_id AS file_path
FROM events WHERE event_type IN ('signup', 'view', 'error', 'purchase')
UNION ALL SELECT event_id, 'A', 'buyer/' || user_id FROM events WHERE event_type = 'purchase'
""",
)
def route_changes_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.route_changes(change_list(change_lines(spark, sf_dir)))


_DIFF = f"""WITH {_FILES}, {_LATER}, diff AS (
  SELECT CASE WHEN f.file_path IS NULL THEN 'A' WHEN l.file_path IS NULL THEN 'D' ELSE 'M' END AS change,
    coalesce(f.file_path, l.file_path) AS file_path
  FROM files f FULL JOIN later l USING (file_path)
  WHERE f.file_path IS NULL OR l.file_path IS NULL OR f.content <> l.content)
"""


@query("snapshot_diff", f"{_DIFF} SELECT change, file_path FROM diff")
def snapshot_diff_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.snapshot_diff(files(spark, sf_dir), later_files(spark, sf_dir))


def moved_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The later files, some of them moved to another folder and some copied."""
    later = later_files(spark, sf_dir)
    moved = F.when(F.col("file_path").rlike("[37][.]"), F.concat(F.lit("moved/"), "file_path")).otherwise(F.col("file_path"))
    copied = later.filter(F.col("file_path").rlike("9[.]")).withColumn("file_path", F.concat(F.lit("copy/"), "file_path"))
    return later.withColumn("file_path", moved).unionByName(copied)


@query(
    "snapshot_moves",
    f"""WITH {_FILES}, {_LATER}, moved AS (
  SELECT CASE WHEN regexp_matches(file_path, '[37][.]') THEN 'moved/' || file_path ELSE file_path END AS file_path, content FROM later
  UNION ALL SELECT 'copy/' || file_path, content FROM later WHERE regexp_matches(file_path, '9[.]')),
gone AS (SELECT md5(content) AS digest, count(*) AS n FROM files ANTI JOIN moved USING (file_path) GROUP BY ALL),
fresh AS (SELECT md5(content) AS digest, count(*) AS n FROM moved ANTI JOIN files USING (file_path) GROUP BY ALL)
SELECT digest, least(coalesce(g.n, 0), coalesce(f.n, 0)) AS moved, greatest(coalesce(g.n, 0) - coalesce(f.n, 0), 0) AS removed,
  greatest(coalesce(f.n, 0) - coalesce(g.n, 0), 0) AS added
FROM gone g FULL JOIN fresh f USING (digest)""",
)
def snapshot_moves_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many files with the same contents have moved, are gone, or are new."""
    before, after = files(spark, sf_dir), moved_files(spark, sf_dir)
    found = op.snapshot_moves(before, after).filter("change <> 'M'")
    side = lambda rows, name: rows.select(F.lit(name).alias("side"), "file_path", F.md5("content").alias("digest"))
    digests = side(before, "before").unionByName(side(after, "after"))
    asked = found.withColumn("side", F.when(F.col("change") == "A", "after").otherwise("before"))
    counted = {"moved": "R", "removed": "D", "added": "A"}
    counts = [F.count_if(F.col("change") == change).alias(name) for name, change in counted.items()]
    return asked.join(digests, ["side", "file_path"]).groupBy("digest").agg(*counts)


@query("change_summary", f"{_DIFF} SELECT change, count(*) AS files FROM diff WHERE {_KEPT} GROUP BY change")
def change_summary_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.change_summary(op.ignore_filter(snapshot_diff_query(spark, sf_dir), RULES))


@query("union_changes", f"{_DIFF} SELECT change, file_path FROM diff WHERE change <> 'D'")
def union_changes_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = snapshot_diff_query(spark, sf_dir)
    return op.union_changes(changes.filter("change = 'A'"), changes.filter("change = 'M'"))


@query(
    "ignore_rules",
    f"""
SELECT conv_id, turn, rule FROM (
  SELECT conv_id, turn, role, {_TRIM.format('line')} AS rule
  FROM (SELECT conv_id, turn, role, unnest(string_split(text, chr(10))) AS line FROM conversations))
WHERE rule <> '' AND role <> 'system' AND NOT starts_with(rule, '#')
""",
)
def ignore_rules_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every message as a line of a rule file: those of one role commented, those of another padded."""
    before = F.when(F.col("role") == "system", F.lit("\t# ")).when(F.col("role") == "user", F.lit("  ")).otherwise("")
    lines = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", before.alias("before"), F.explode(F.split("text", "\n")).alias("line")
    )
    value = F.concat("before", "line", F.lit(" \r"))
    return ignore_rules(lines.select("conv_id", "turn", value.alias("value")))


# --- filters and checks ---------------------------------------------------------------------------------------------


@query("ignore_filter", f"WITH {_FILES} SELECT doc_id, file_path FROM files WHERE {_KEPT}")
def ignore_filter_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.ignore_filter(with_path(table(spark, sf_dir, "documents")).select("doc_id", "file_path"), RULES)


@query(
    "language_tag",
    f"""WITH {_FILES}, paths AS (SELECT file_path FROM files UNION ALL SELECT url FROM pages)
SELECT file_path, regexp_extract(file_path, '[^/]([.][^/.]+)$', 1) AS suffix,
  CASE regexp_extract(file_path, '[^/]([.][^/.]+)$', 1)
    WHEN '.py' THEN 'python' WHEN '.cpp' THEN 'cpp' WHEN '.hpp' THEN 'cpp' END AS language
FROM paths""",
)
def language_tag_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = files(spark, sf_dir).select("file_path")
    urls = table(spark, sf_dir, "pages").select(F.col("url").alias("file_path"))
    return op.language_tag(paths.unionByName(urls).withColumn("suffix", suffix("file_path")))


PYTHON_HEADER = '# générated file\n\nimport os, sys as system\nfrom a.b import (\n    c,  # 文字\n    d as e,\n)\n'
CPP_HEADER = '/* notice\n * in the public domain */\n#include <vector>\n#include "a.h" // own\n\n// end\n'


def with_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    header = (
        F.when(F.col("lang") == "en", F.lit(PYTHON_HEADER))
        .when(F.col("lang") == "es", F.lit(PYTHON_HEADER))
        .otherwise(F.lit(CPP_HEADER))
    )
    return table_corpus(table(spark, sf_dir, "documents"), document_path(), F.concat(header, "text"))


_HEADERS = f"""headed AS (SELECT *, CASE WHEN lang IN ('en', 'es') THEN '{PYTHON_HEADER}' ELSE '{CPP_HEADER}' END AS header
  FROM files), stripped AS (SELECT *, header || content AS whole,
  CASE WHEN lang = 'es' THEN header || content ELSE {_TRIM.format('content')} END AS code_text FROM headed)"""


@query("strip_header", f"WITH {_FILES}, {_HEADERS} SELECT file_path, md5(code_text) AS digest FROM stripped")
def strip_header_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.strip_headers(with_headers(spark, sf_dir)).select("file_path", F.md5("code_text").alias("digest"))


@query(
    "header_summary",
    f"""WITH {_FILES}, {_HEADERS}
SELECT CASE lang WHEN 'en' THEN 'python' WHEN 'es' THEN NULL ELSE 'cpp' END AS language, count(*) AS files,
  sum(length(whole))::BIGINT AS characters, sum(length(whole) - length(code_text))::BIGINT AS stripped
FROM stripped GROUP BY 1""",
)
def header_summary_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.header_summary(with_headers(spark, sf_dir))


@query("blank_filter", f"WITH {_LATER} SELECT file_path FROM later WHERE {_TRIM.format('content')} <> ''")
def blank_filter_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.blank_filter(later_files(spark, sf_dir), "content").select("file_path")


@query(
    "path_normalize",
    f"""WITH {_FILES}
SELECT doc_id, v AS variant, CASE v WHEN 3 THEN '/' || file_path WHEN 4 THEN '//' || file_path WHEN 5 THEN '/' || file_path
  WHEN 6 THEN '../' || file_path ELSE file_path END AS file_path
FROM files, range(0, 7) AS t(v)""",
)
def path_normalize_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("file_path")
    variants = F.array(
        F.concat(F.lit("./"), path),
        F.replace(path, F.lit("/"), F.lit("//./")),
        F.concat(path, F.lit("/.//")),
        F.concat(F.lit("/"), path),
        F.concat(F.lit("//"), path),
        F.concat(F.lit("///./"), path),
        F.concat(F.lit(".././"), path),
    )
    untidy = with_path(table(spark, sf_dir, "documents")).select(
        "doc_id", F.posexplode(variants).alias("variant", "file_path")
    )
    return op.path_normalize(untidy).withColumn("variant", F.col("variant").cast("bigint"))


@query(
    "exists_filter",
    f"WITH {_FILES}, {_LATER} SELECT file_path FROM files WHERE file_path IN (SELECT file_path FROM later)",
)
def exists_filter_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.exists_filter(files(spark, sf_dir).select("file_path"), later_files(spark, sf_dir))


@query("path_like", f"WITH {_FILES} SELECT file_path FROM files WHERE file_path LIKE '%.py'")
def path_like_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("file_path").filter(F.col("file_path").like("%.py"))


def odd_vector(nan: int, infinite: int, zero: int = -1, missing: int = -1) -> Column:
    """The vector, but with a NaN or an infinite first element, all zeros, or NULL for four labels."""
    label, rest = F.col("label"), F.slice("embedding", 2, 1000)
    first = lambda value: F.concat(F.array(F.lit(value).cast("float")), rest)
    return (
        F.when(label == nan, first(float("nan")))
        .when(label == infinite, first(float("inf")))
        .when(label == zero, F.transform("embedding", lambda value: value * 0))
        .when(label != missing, F.col("embedding"))
    )


def faulty_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors as an index in which some labels stand for broken rows."""
    label = F.col("label")
    path = F.concat(F.lit("vec/"), F.col("vec_id"))
    return table(spark, sf_dir, "embeddings").select(
        F.when(label == 0, F.lit("same"))
        .when(label == 1, F.concat(F.repeat(F.lit("x"), 255), path))
        .when(label == 2, F.lit(None))
        .otherwise(path)
        .alias("file_path"),
        F.when(label != 3, F.lit("text")).alias("code_text"),
        F.when(label == 4, F.slice("embedding", 1, 63)).when(label != 5, odd_vector(6, 7)).alias("embedding"),
    )


@query(
    "validate_index",
    """
WITH i AS (SELECT label, 'vec/' || vec_id AS path FROM embeddings)
SELECT 'path_not_unique' AS rule, 'same' AS file_path, count(*) AS rows FROM i WHERE label = 0 HAVING count(*) > 1
UNION ALL SELECT 'path_missing', NULL, count(*) FROM i WHERE label = 2 HAVING count(*) > 0
UNION ALL SELECT 'path_too_long', repeat('x', 255) || path, 1 FROM i WHERE label = 1
UNION ALL SELECT 'text_missing', path, 1 FROM i WHERE label = 3
UNION ALL SELECT 'dimension', path, 1 FROM i WHERE label = 4
UNION ALL SELECT 'not_finite', path, 1 FROM i WHERE label IN (6, 7)
""",
)
def validate_index_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.validate_index(faulty_index(spark, sf_dir), 64)


@query(
    "quarantine",
    """SELECT CASE label WHEN 0 THEN 'same' WHEN 1 THEN repeat('x', 255) || 'vec/' || vec_id
  WHEN 2 THEN NULL ELSE 'vec/' || vec_id END AS file_path, label NOT IN (1, 2, 3, 4, 6, 7) AS accepted FROM embeddings""",
)
def quarantine_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = op.quarantine(faulty_index(spark, sf_dir), 64)
    return good.select("file_path", F.lit(True).alias("accepted")).unionByName(
        bad.select("file_path", F.lit(False).alias("accepted"))
    )


# --- change application ---------------------------------------------------------------------------------------------


@query(
    "dedupe_last_wins",
    """SELECT conv_id, turn, role, text FROM conversations
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1""",
)
def dedupe_last_wins_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.dedupe_last_wins(table(spark, sf_dir, "conversations"), ["turn"], "conv_id")


@query(
    "delete_by_key",
    f"WITH {_FILES}, {_LABELLED} SELECT file_path FROM files ANTI JOIN (FROM labelled WHERE toxic = 1) USING (file_path)",
)
def delete_by_key_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    toxic = labelled(spark, sf_dir).filter("toxic = 1")
    return op.delete_by_key(files(spark, sf_dir).select("file_path"), toxic)


@query(
    "assign_ids",
    f"""WITH {_FILES}
SELECT row_number() OVER (ORDER BY {_group('file_path')}, file_path) AS id, file_path FROM files""",
)
def assign_ids_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.assign_ids(files(spark, sf_dir).select("file_path"))


def document_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_path(table(spark, sf_dir, "documents"))
    return rows.select((F.col("doc_id") + 1).alias("id"), "file_path", F.col("text").alias("code_text"))


_INDEX = f"idx AS (SELECT doc_id + 1 AS id, {_PATH} AS file_path, text AS code_text FROM documents)"
_NEW_IDS = f"""(SELECT max(id) FROM idx) + row_number() OVER (PARTITION BY {{old}} IS NULL ORDER BY {_group('u.file_path')}, u.file_path)"""


@query(
    "upsert",
    f"""WITH {_INDEX}, u AS (SELECT url AS file_path, html AS code_text FROM pages
  UNION ALL SELECT {_PATH}, 'toxic ' || doc_id FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)
SELECT coalesce(i.id, {_NEW_IDS.format(old='i.id')}) AS id, u.file_path, md5(u.code_text) AS digest
FROM u LEFT JOIN idx i USING (file_path)
UNION ALL SELECT id, file_path, md5(code_text) FROM idx ANTI JOIN u USING (file_path)""",
)
def upsert_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("url").alias("file_path"), F.col("html").alias("code_text"))
    toxic = labelled(spark, sf_dir).filter("toxic = 1")
    toxic = toxic.select("file_path", F.concat(F.lit("toxic "), F.col("doc_id")).alias("code_text"))
    rows = op.upsert(document_index(spark, sf_dir), pages.unionByName(toxic))
    return rows.select("id", "file_path", F.md5("code_text").alias("digest"))


def conversation_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of a conversation as a write to the document of the same number."""
    paths = with_path(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("conv_id"), "file_path")
    turns = table(spark, sf_dir, "conversations").join(paths, "conv_id", "left")
    path = F.coalesce("file_path", F.concat(F.lit("conv/"), F.col("conv_id")))
    return turns.select(path.alias("file_path"), F.col("text").alias("code_text"), "turn")


_WRITES = f"""writes AS (SELECT coalesce(d.file_path, 'conv/' || conv_id) AS file_path, c.text AS code_text, turn
  FROM conversations c LEFT JOIN (SELECT doc_id, {_PATH} AS file_path FROM documents) d ON d.doc_id = c.conv_id)"""


@query(
    "apply_changes",
    f"""WITH {_INDEX}, {_LABELLED}, {_WRITES},
u AS (SELECT file_path, code_text FROM writes QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY turn DESC) = 1),
left_over AS (SELECT * FROM idx ANTI JOIN (FROM labelled WHERE toxic = 1) USING (file_path))
SELECT coalesce(i.id, {_NEW_IDS.format(old='i.id')}) AS id, u.file_path,
  md5(u.code_text) AS digest
FROM u LEFT JOIN left_over i USING (file_path)
UNION ALL SELECT id, file_path, md5(code_text) FROM left_over ANTI JOIN u USING (file_path)""",
)
def apply_changes_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    toxic = labelled(spark, sf_dir).filter("toxic = 1")
    writes = conversation_writes(spark, sf_dir)
    rows = op.apply_changes(document_index(spark, sf_dir), writes, toxic, order=["turn"])
    return rows.select("id", "file_path", F.md5("code_text").alias("digest"))


@query(
    "apply_summary",
    """SELECT (SELECT count(DISTINCT conv_id) FROM conversations) AS upserted,
  (SELECT count(*) FROM labels WHERE toxic = 1) AS deleted""",
)
def apply_summary_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    writes = op.dedupe_last_wins(conversation_writes(spark, sf_dir), ["turn"])
    return op.apply_summary(writes, table(spark, sf_dir, "labels").filter("toxic = 1"))


# --- embedding ------------------------------------------------------------------------------------------------------


def _bucket(word: str) -> str:
    return f"('0x' || substr(md5({word}), 1, 8))::BIGINT % {DIM}"


_MODEL = f"""tf AS (SELECT doc_id, {_bucket('word')} AS bucket, count(*) AS tf FROM
  (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS word FROM documents) GROUP BY ALL),
df AS (SELECT bucket, count(*) AS documents FROM tf GROUP BY bucket),
model AS (SELECT b.bucket, coalesce(df.documents, 0) AS documents, total,
  ln((1 + total) / (1 + coalesce(df.documents, 0))) + 1 AS idf
  FROM (SELECT unnest(range(0, {DIM})) AS bucket) b LEFT JOIN df USING (bucket), (SELECT count(*) AS total FROM documents))"""
_DOC_VECTORS = """vectors AS (SELECT doc_id, bucket, (w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)))::FLOAT::DOUBLE AS weight
  FROM (SELECT doc_id, bucket, tf * idf AS w FROM tf JOIN model USING (bucket)))"""
_QUERY_VECTORS = f"""qtf AS (SELECT item_id, {_bucket('word')} AS bucket, count(*) AS tf FROM
  (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS word FROM benchmark) GROUP BY ALL),
qvectors AS (SELECT item_id, bucket, (w / sqrt(sum(w * w) OVER (PARTITION BY item_id)))::FLOAT::DOUBLE AS weight
  FROM (SELECT item_id, bucket, tf * idf AS w FROM qtf JOIN model USING (bucket)))"""


def corpus_embedder(spark: SparkSession, sf_dir: str) -> op.TfIdfEmbedder:
    return op.TfIdfEmbedder.fit(documents(spark, sf_dir), DIM, "text")


def long_form(vectors: DataFrame, key: str) -> DataFrame:
    weights = vectors.select(key, F.posexplode("embedding").alias("bucket", "weight")).filter("weight <> 0")
    return weights.select(
        key, F.col("bucket").cast("bigint").alias("bucket"), F.round(F.col("weight").cast("double"), 6).alias("weight")
    )


@query(
    "fit_idf",
    f"WITH {_MODEL} SELECT bucket::INTEGER AS bucket, documents, total, round(idf, 9) AS idf FROM model",
)
def fit_idf_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = op.fit_idf(documents(spark, sf_dir), DIM, "text")
    return model.select("bucket", "documents", "total", F.round("idf", 9).alias("idf"))


@query(
    "embed_corpus",
    f"WITH {_MODEL}, {_DOC_VECTORS} SELECT doc_id, bucket, round(weight, 6) AS weight FROM vectors",
)
def embed_corpus_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_form(corpus_embedder(spark, sf_dir)(documents(spark, sf_dir), "text"), "doc_id")


@query(
    "embed_query",
    f"WITH {_MODEL}, {_QUERY_VECTORS} SELECT item_id, bucket, round(weight, 6) AS weight FROM qvectors",
)
def embed_query_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_form(corpus_embedder(spark, sf_dir)(table(spark, sf_dir, "benchmark"), "text"), "item_id")


@query(
    "embed_table",
    "SELECT doc_id, "
    + ", ".join(f"(length(text) - length(replace(text, '{c}', '')))::DOUBLE AS {c}_count" for c in "aeio")
    + " FROM documents",
)
def embed_table_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = op.embed_table(table(spark, sf_dir, "documents"), letter_counts, 4, "text")
    counts = [F.get("embedding", F.lit(i)).cast("double").alias(f"{c}_count") for i, c in enumerate("aeio")]
    return good.select("doc_id", *counts)


# --- search ---------------------------------------------------------------------------------------------------------

_FIRST = "(SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)"
_TO_FIRST = f"SELECT vec_id, label, {_DISTANCE.format('embedding', _FIRST)} AS d FROM embeddings"


# Labels that stand for vectors without a direction (NaN, infinite, zero) and for missing ones; written as -1 and NULL.
_ODD = {"nan": 1, "infinite": 2, "zero": 3, "missing": 4}
_ODD_TO_FIRST = f"""SELECT vec_id, CASE WHEN label = 4 THEN NULL WHEN label IN (1, 2, 3) THEN 'nan'::DOUBLE ELSE d END AS d
  FROM ({_TO_FIRST})"""


def odd_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", odd_vector(**_ODD).alias("embedding"))


def _shown(distance: Column | str) -> Column:
    return F.round(F.nanvl(distance, F.lit(-1.0)), 6).alias("distance")


@query("cosine_distance", f"SELECT vec_id, CASE WHEN isnan(d) THEN -1 ELSE round(d, 6) END AS distance FROM ({_ODD_TO_FIRST})")
def cosine_distance_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = vector_literal(first_vector(table(spark, sf_dir, "embeddings")))
    rows = odd_index(spark, sf_dir)
    return rows.select("vec_id", _shown(cosine_distance("embedding", first)))


@query(
    "top_k_search",
    f"SELECT vec_id, round(d, 6) AS distance FROM ({_TO_FIRST}) ORDER BY round(d, 9), vec_id LIMIT 10",
)
def top_k_search_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings")
    hits = op.top_k_search(embeddings, first_vector(embeddings), key="vec_id")
    return hits.select("vec_id", F.round("distance", 6).alias("distance"))


@query(
    "ranked_hits",
    f"""SELECT row_number() OVER (ORDER BY round(d, 9), vec_id) AS rank, vec_id, round(d, 4) AS distance,
  printf('%d. %d (distance: %.4f)', row_number() OVER (ORDER BY round(d, 9), vec_id), vec_id, d) AS line
FROM ({_TO_FIRST}) ORDER BY 1 LIMIT 10""",
)
def ranked_hits_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings")
    hits = op.ranked_hits(op.top_k_search(embeddings, first_vector(embeddings), key="vec_id"), "vec_id")
    return hits.select(F.col("rank").cast("bigint").alias("rank"), "vec_id", F.round("distance", 4).alias("distance"), "line")


_PAIRS = f"""SELECT q.vec_id AS query_id, e.vec_id, CASE WHEN e.label = 4 THEN NULL
    WHEN q.label IN (1, 2, 3) OR e.label IN (1, 2, 3) THEN 'nan'::DOUBLE
    ELSE {_DISTANCE.format('e.embedding', 'q.embedding')} END AS d
  FROM embeddings q, embeddings e WHERE q.label <> 4"""
_RANKED = f"""SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9) NULLS LAST, vec_id) AS rank
  FROM ({_PAIRS}) QUALIFY rank <= 10"""
_BATCH = f"""SELECT query_id, rank, vec_id, CASE WHEN isnan(d) THEN -1 ELSE round(d, 6) END AS distance FROM ({_RANKED})"""


def _rounded(hits: DataFrame, key: str = "vec_id") -> DataFrame:
    return hits.select("query_id", F.col("rank").cast("bigint").alias("rank"), key, _shown("distance"))


def odd_queries(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("vec_id").alias("query_id"), "embedding")


@query("batch_search", _BATCH)
def batch_search_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of every vector among all vectors, some of which have no direction or are missing."""
    rows = odd_index(spark, sf_dir)
    return _rounded(op.batch_search(odd_queries(rows), rows, key="vec_id"))


@query("batch_search_blocks", _BATCH)
def batch_search_blocks_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the way taken for query sets too large to send to every task, with several blocks of the index."""
    rows = odd_index(spark, sf_dir)
    return _rounded(op.batch_search(odd_queries(rows), rows, key="vec_id", max_broadcast_bytes=0, block_rows=200))


@query(
    "semantic_search",
    f"""WITH {_FILES}, {_MODEL}, {_DOC_VECTORS}, {_QUERY_VECTORS},
pairs AS (SELECT item_id, doc_id, greatest(1 - sum(q.weight * v.weight) / (any_value(qn) * any_value(vn)), 0) AS d
  FROM (SELECT *, sqrt(sum(weight * weight) OVER (PARTITION BY item_id)) AS qn FROM qvectors) q
  JOIN (SELECT *, sqrt(sum(weight * weight) OVER (PARTITION BY doc_id)) AS vn FROM vectors) v USING (bucket)
  GROUP BY item_id, doc_id)
SELECT item_id AS query_id, rank, file_path, round(d, 6) AS distance FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(d, 9), file_path) AS rank
  FROM pairs JOIN files USING (doc_id)) WHERE rank <= 10""",
)
def semantic_search_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts to hits: embed the corpus and the query texts with one model and find the nearest files."""
    texts = with_path(documents(spark, sf_dir)).select("file_path", "text")
    embedder = op.TfIdfEmbedder.fit(texts, DIM, "text")
    asked, _ = op.split_queries(table(spark, sf_dir, "benchmark"))
    hits = op.batch_search(embedder(asked, "text"), embedder(texts, "text"), query_id="item_id")
    return _rounded(hits, "file_path")


def vector_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("vec/"), "vec_id").alias("file_path"), F.concat(F.lit("label "), "label").alias("code_text"), "embedding"
    )


@query(
    "sql_search",
    f"""SELECT 'vec/' || vec_id AS file_path, round(d, 6) AS distance FROM ({_TO_FIRST})
WHERE label <> 3 ORDER BY round(d, 9), file_path LIMIT 10""",
)
def sql_search_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = vector_index(spark, sf_dir)
    statement = f"""
        SELECT file_path, round(distance, 6) AS distance FROM (
          SELECT file_path, cosine_distance(embedding, :embedding) AS distance
          FROM {INDEX_VIEW} WHERE code_text <> 'label 3')
        ORDER BY round(distance, 6), file_path LIMIT 10"""
    return op.sql_search(index, statement, first_vector(table(spark, sf_dir, "embeddings")))


@query(
    "default_search",
    f"""SELECT 'vec/' || vec_id AS file_path, round(d, 6) AS distance FROM ({_TO_FIRST}) ORDER BY round(d, 9), file_path LIMIT 10""",
)
def default_search_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL that a search runs when none is given: projection, order by distance, limit."""
    hits = op.sql_search(vector_index(spark, sf_dir), op.DEFAULT_SQL, first_vector(table(spark, sf_dir, "embeddings")))
    return hits.select("file_path", F.round("distance", 6).alias("distance"))


@query("index_count", "SELECT count(*) AS files FROM embeddings")
def index_count_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.sql_search(vector_index(spark, sf_dir), f"SELECT count(*) AS files FROM {INDEX_VIEW}")


def cells(spark: SparkSession, sf_dir: str) -> CellIndex:
    """The vectors in 16 cells, written and read back."""
    path = scratch_dir(spark)
    op.build_cells(odd_index(spark, sf_dir), cells=16, iterations=5).write(path, rows_per_file=200)
    return CellIndex.read(spark, path, key="vec_id")


def fiftieth(rows: DataFrame) -> DataFrame:
    return odd_queries(rows).filter("query_id % 50 = 0")


@query(
    "ann_search",
    """SELECT vec_id AS query_id, 10::BIGINT AS hits, 10::BIGINT AS right_distances, true AS in_order, true AS found_nine_of_ten,
  true AS probes_told
FROM embeddings WHERE label <> 4""",
)
def ann_search_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search with default arguments of every row against all rows.

    Every query has its ten hits, with their exact distances, in order; of all true neighbours nine in ten are found; and it is told
    in how many cells, one at least.
    """
    rows = odd_index(spark, sf_dir)
    queries, index = odd_queries(rows), op.build_cells(rows)
    hits = op.ann_search(queries, index, key="vec_id", report=True)
    vectors = [rows.select(F.col("vec_id").alias(name), F.col("embedding").alias(f"{name}_vector")) for name in ("query_id", "vec_id")]
    exact = op.batch_search(queries, rows, key="vec_id").select("query_id", "vec_id", F.lit(1).alias("true_hit"))
    before = F.lag(F.nanvl("distance", F.lit(3.0))).over(Window.partitionBy("query_id").orderBy("rank"))
    measured = (
        hits.join(vectors[0], "query_id").join(vectors[1], "vec_id").join(exact, ["query_id", "vec_id"], "left")
        .withColumn("right", _shown("distance").eqNullSafe(_shown(cosine_distance("vec_id_vector", "query_id_vector"))))
        .withColumn("later", F.coalesce(F.nanvl("distance", F.lit(3.0)) >= before - 1e-9, F.lit(True)))
        .groupBy("query_id")
        .agg(
            F.count("*").alias("hits"),
            F.count_if("right").alias("right_distances"),
            F.bool_and("later").alias("in_order"),
            F.count("true_hit").alias("true_hits"),
            F.bool_and(F.col("probed").between(1, len(index.centres))).alias("probes_told"),
        )
    )
    true_hits, all_hits = measured.agg(F.sum("true_hits"), F.sum("hits")).first()
    found = F.lit((true_hits or 0) >= 0.9 * (all_hits or 0))
    return measured.withColumn("found_nine_of_ten", found).drop("true_hits")


@query("ann_search_all_cells", _BATCH)
def ann_search_all_cells_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probing every cell must give the exact answer."""
    return _rounded(op.ann_search(odd_queries(odd_index(spark, sf_dir)), cells(spark, sf_dir), probes=16, key="vec_id"))


@query("ann_search_by_bounds", f"SELECT * FROM ({_BATCH}) WHERE query_id % 50 = 0")
def ann_search_by_bounds_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaving out only cells whose bound cannot beat the k-th hit must give the exact answer, too."""
    rows = odd_index(spark, sf_dir)
    return _rounded(op.ann_search(fiftieth(rows), cells(spark, sf_dir), recall=1.0, key="vec_id"))


_AFTER_CHANGES = f"""WITH later AS (
  SELECT vec_id, vec_id AS given, 1 AS sign FROM embeddings WHERE vec_id % 3 <> 0 AND vec_id % 7 <> 2
  UNION ALL SELECT vec_id, vec_id, -1 FROM embeddings WHERE vec_id % 7 = 2
  UNION ALL SELECT vec_id + 1000000, vec_id, 1 FROM embeddings WHERE vec_id % 11 = 5),
pairs AS (SELECT query_id, later.vec_id, CASE WHEN sign = 1 OR isnan(d) THEN d ELSE 2 - d END AS d
  FROM ({_PAIRS}) p JOIN later ON p.vec_id = later.given WHERE query_id % 50 = 0)
SELECT query_id, rank, vec_id, CASE WHEN isnan(d) THEN -1 ELSE round(d, 6) END AS distance FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9) NULLS LAST, vec_id) AS rank FROM pairs)
WHERE rank <= 10"""


@query("ann_search_after_changes", _AFTER_CHANGES)
def ann_search_after_changes_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that followed two changes - rows deleted, turned round and added - searched at full probing, without a rebuild."""
    rows, path = odd_index(spark, sf_dir), scratch_dir(spark)
    op.build_cells(rows, cells=16, iterations=5).write(path, rows_per_file=200)
    read = lambda: CellIndex.read(spark, path, key="vec_id")
    turned = rows.filter("vec_id % 7 = 2").withColumn("embedding", F.transform("embedding", lambda x: -x))
    op.append_changes(read(), path, turned, rows.filter("vec_id % 3 = 0").select("vec_id"), key="vec_id")
    added = rows.filter("vec_id % 11 = 5").withColumn("vec_id", F.col("vec_id") + 1_000_000)
    op.append_changes(read(), path, added, key="vec_id")
    return _rounded(op.ann_search(fiftieth(rows), read(), recall=1.0, key="vec_id"))


# --- the index at rest ----------------------------------------------------------------------------------------------


def vector_store(spark: SparkSession, sf_dir: str) -> IndexStore:
    """All vectors published, then a second batch: two labels deleted, one of them written again, one rewritten."""
    store = IndexStore(spark, scratch_dir(spark), 64)
    rows = vector_index(spark, sf_dir)
    store.publish_index(rows, source_version="first")
    labels = F.col("code_text").isin("label 1", "label 3")
    rewritten = rows.filter(labels).withColumn("code_text", F.concat(F.lit("new "), "code_text"))
    store.publish_index(rewritten, rows.filter(F.col("code_text").isin("label 1", "label 2")), "second")
    return store


@query(
    "publish_index",
    """SELECT 'vec/' || vec_id AS file_path, CASE WHEN label IN (1, 3) THEN 'new ' ELSE '' END || 'label ' || label AS code_text,
  label <> 1 AS same_id, true AS same_vector
FROM embeddings WHERE label <> 2""",
)
def publish_index_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published rows, and whether they still have the id and vector of the first version."""
    store = vector_store(spark, sf_dir)
    first = store.read(1).select("file_path", F.col("id").alias("first_id"), F.col("embedding").alias("first_vector"))
    return (
        store.read()
        .join(first, "file_path", "left")
        .select(
            "file_path",
            "code_text",
            (F.col("id") == F.col("first_id")).alias("same_id"),
            (F.col("embedding") == F.col("first_vector")).alias("same_vector"),
        )
    )


@query(
    "publish_repeated",
    """WITH given AS (
  SELECT vec_id, 'label ' || label AS code_text FROM embeddings UNION ALL SELECT vec_id, 'other ' || label FROM embeddings WHERE label IN (1, 2)
  UNION ALL SELECT vec_id, 'label ' || label FROM embeddings WHERE label = 3)
SELECT 'vec/' || vec_id AS file_path, arg_max(code_text, md5(code_text)) AS code_text, count(*) - 1 AS set_aside FROM given GROUP BY vec_id""",
)
def publish_repeated_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that share a path, with equal and with other texts: one is in the index, the others are set aside."""
    rows = vector_index(spark, sf_dir)
    other = rows.filter(F.col("code_text").isin("label 1", "label 2")).withColumn("code_text", F.replace("code_text", F.lit("label"), F.lit("other")))
    store = IndexStore(spark, scratch_dir(spark), 64)
    store.publish_index(rows.unionByName(other).unionByName(rows.filter("code_text = 'label 3'")))
    aside = store.rejected().filter(F.array_contains("broken", "path_not_unique")).groupBy("file_path").agg(F.count("*").alias("n"))
    return store.read().join(aside, "file_path", "left").select("file_path", "code_text", F.coalesce("n", F.lit(0)).alias("set_aside"))


@query(
    "index_state",
    """SELECT 1::BIGINT AS version, true AS "full", 'first' AS source_version, count(*) AS upserted, 0::BIGINT AS deleted,
  0::BIGINT AS requests, 0::BIGINT AS rejected, true AS timed FROM embeddings
UNION ALL SELECT 2, false, 'second', count(*) FILTER (label IN (1, 3)), count(*) FILTER (label IN (1, 2)),
  count(*) FILTER (label IN (1, 2)), 0, true FROM embeddings
UNION ALL SELECT 3, false, 'second', 0, count(*) FILTER (label = 5), 0, 0, true FROM embeddings""",
)
def index_state_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three versions; in the last the texts of one label have become blank, which removes them without a request."""
    store = vector_store(spark, sf_dir)
    blanked = vector_index(spark, sf_dir).filter("code_text = 'label 5'")
    store.publish_index(blanked, finish=lambda rows: rows.withColumn("deleted", F.lit(True)))
    counts = ["version", "full", "source_version", "upserted", "deleted", "requests", "rejected"]
    return store.index_state().select(*counts, F.col("indexed_at").isNotNull().alias("timed"))


@query(
    "full_changes",
    f"WITH {_FILES} SELECT 'A' AS change, file_path FROM files WHERE {_KEPT}",
)
def full_changes_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return full_changes(files(spark, sf_dir), RULES)


def new_store(spark: SparkSession) -> IndexStore:
    return IndexStore(spark, scratch_dir(spark), DIM)


@query(
    "full_index",
    f"WITH {_FILES} SELECT file_path, md5({_CODE}) AS digest, {DIM} AS dim FROM files WHERE {_KEPT}",
)
def full_index_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = new_store(spark)
    full_index(store, files(spark, sf_dir), RULES, source_version="v1")
    return digest(store.read())


@query("full_index_of_nothing", f"WITH {_FILES} SELECT file_path, md5({_CODE}) AS digest, {DIM} AS dim FROM files WHERE {_KEPT}")
def full_index_of_nothing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first run whose rules leave nothing, and a later one with other rules, which fits the model."""
    store, given = new_store(spark), files(spark, sf_dir)
    full_index(store, given, ["*"], source_version="v1")
    incremental_index(store, op.ignore_filter(given, RULES), source_version="v2")
    return digest(store.read())


_LATER_INDEX = f"""WITH {_LATER} SELECT file_path, md5({_CODE}) AS digest, {DIM} AS dim
FROM later WHERE {_KEPT} AND {_TRIM.format('content')} <> ''"""


@query("full_index_again", _LATER_INDEX)
def full_index_again_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two full runs on two states of the corpus: files that have vanished are gone, all vectors are of the second model."""
    store = new_store(spark)
    full_index(store, files(spark, sf_dir), RULES, source_version="v1")
    full_index(store, later_files(spark, sf_dir), RULES, source_version="v2")
    return digest(store.read())


@query("incremental_by_digest", _LATER_INDEX)
def incremental_by_digest_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later run that finds what has changed by the digests in the index alone."""
    store = new_store(spark)
    full_index(store, files(spark, sf_dir), RULES, source_version="v1")
    incremental_index(store, op.ignore_filter(later_files(spark, sf_dir), RULES), base="v1", source_version="v2")
    return digest(store.read(source_version="v2"))


@query(
    "incremental_index",
    f"""WITH {_LATER} SELECT file_path, md5({_CODE}) AS digest, {DIM} AS dim
FROM later WHERE {_KEPT} AND {_TRIM.format('content')} <> ''""",
)
def incremental_index_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First run on the files, later run on what has changed since."""
    store = new_store(spark)
    before, after = files(spark, sf_dir), later_files(spark, sf_dir)
    full_index(store, before, RULES, source_version="v1")
    incremental_index(store, after, previous=before, rules=RULES, source_version="v2")
    return digest(store.read())


@query(
    "refit_model",
    f"""WITH {_LATER}, texts AS (SELECT file_path, {_CODE} AS code FROM later WHERE {_KEPT} AND {_TRIM.format('content')} <> ''),
df AS (SELECT bucket, count(*) AS documents FROM (
    SELECT DISTINCT file_path, {_bucket('word')} AS bucket FROM (
      SELECT file_path, unnest(regexp_extract_all(lower(code), '[\\p{{L}}\\p{{N}}]+')) AS word FROM texts)) GROUP BY bucket)
SELECT b.bucket::INTEGER AS bucket, coalesce(documents, 0) AS documents, total,
  round(ln((1 + total) / (1 + coalesce(documents, 0))) + 1, 9) AS idf, total AS equal_vectors
FROM (SELECT unnest(range(0, {DIM})) AS bucket) b LEFT JOIN df USING (bucket), (SELECT count(*) AS total FROM texts)"""
)
def refit_model_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model after a later run, brought up to date; and how many vectors are those that it gives for the texts."""
    store = new_store(spark)
    full_index(store, files(spark, sf_dir), RULES, source_version="v1")
    incremental_index(store, op.ignore_filter(later_files(spark, sf_dir), RULES), source_version="v2")
    refit_model(store)
    plain = stored_embedder(store)(store.read().select("code_text", F.col("embedding").alias("stored")))
    apart = F.aggregate(F.zip_with("stored", "embedding", lambda a, b: F.abs(a - b).cast("double")), F.lit(0.0), lambda x, y: F.greatest(x, y))
    equal = plain.agg(F.count_if(apart < 1e-6)).first()[0]
    return store.read_model().select("bucket", "documents", "total", F.round("idf", 9).alias("idf"), F.lit(equal).cast("bigint").alias("equal_vectors"))


@query(
    "incremental_index_moves",
    f"""WITH {_LATER}, moved AS (
  SELECT CASE WHEN regexp_matches(file_path, '[37][.]') THEN 'moved/' || file_path ELSE file_path END AS file_path, content FROM later
  UNION ALL SELECT 'copy/' || file_path, content FROM later WHERE regexp_matches(file_path, '9[.]'))
SELECT file_path, md5({_CODE}) AS digest, {DIM} AS dim FROM moved WHERE {_KEPT} AND {_TRIM.format('content')} <> ''""",
)
def incremental_index_moves_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later run in which files that only moved keep their texts and vectors."""
    store = new_store(spark)
    before, after = files(spark, sf_dir), moved_files(spark, sf_dir)
    full_index(store, before, RULES, source_version="v1")
    incremental_index(store, after, previous=before, rules=RULES, source_version="v2", moves=True)
    return digest(store.read())


@query(
    "add_delete_index",
    f"""WITH {_FILES}, {_LATER}, gone AS (SELECT file_path FROM labelled WHERE toxic = 1 AND quality = 1)
SELECT file_path, md5({_CODE}) AS digest, {DIM} AS dim FROM (
  SELECT file_path, content FROM later WHERE starts_with(file_path, 'web/')
  UNION ALL SELECT file_path, content FROM files ANTI JOIN gone USING (file_path) WHERE {_KEPT})""",
)
def add_delete_index_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages added and some documents deleted by explicit path lists."""
    store = new_store(spark)
    full_index(store, files(spark, sf_dir), RULES, source_version="v1")
    later = later_files(spark, sf_dir)
    add = later.filter(F.col("file_path").startswith("web/")).select("file_path")
    delete = labelled(spark, sf_dir).filter("toxic = 1 AND quality = 1").select("file_path")
    add_delete_index(store, later, add, delete)
    return digest(store.read())


@query(
    "stream_changes",
    """SELECT 'user/' || user_id || '.txt' AS file_path, 'event ' || event_id || ' ' || props AS code_text FROM (
  SELECT * FROM events WHERE event_type IN ('signup', 'view', 'error')
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
WHERE event_type <> 'error'""",
)
def stream_changes_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of changes to one file per user, in four micro-batches each of which has late events."""
    given, root = table(spark, sf_dir, "events"), scratch_dir(spark)
    for part in range(4):
        given.filter(F.pmod(F.xxhash64("event_id"), F.lit(4)) == part).coalesce(1).write.parquet(f"{root}/part={part}")
    reader = spark.readStream.schema(given.schema).option("maxFilesPerTrigger", 1)
    events = reader.option("recursiveFileLookup", "true").parquet(root)
    change = F.create_map(*[F.lit(v) for v in ("signup", "A", "view", "M", "error", "D")])
    changes = events.select(
        F.try_element_at(change, F.col("event_type")).alias("change"),
        F.concat(F.lit("user/"), F.col("user_id"), F.lit(".txt")).alias("file_path"),
        F.concat(F.lit("event "), F.col("event_id"), F.lit(" "), F.col("props")).alias("content"),
        "ts",
        "event_id",
    )
    store = IndexStore(spark, scratch_dir(spark), 4)
    embedder = op.BatchEmbedder(letter_counts, 4)
    stream_changes(store, changes, scratch_dir(spark), ["ts", "event_id"], embedder=embedder).awaitTermination()
    return store.read().select("file_path", "code_text")
