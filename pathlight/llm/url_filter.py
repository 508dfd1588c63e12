"""URL filters: rules are indexed by their rarest literal token, and only rules that a URL's tokens fetch are tried.

Only DataFrame functions are used. A rule is of one of two kinds:

* ``site`` - a host and a path, e.g. ``example.com/en/``: fits the host and all its subdomains, if the path of the URL
  begins with that of the rule. Of several that fit the longest decides.
* ``pattern`` - the wildcard syntax that public filter lists use: ``*`` is any run of characters, ``^`` a separator or either
  end, ``|`` at either end the begin or end of the URL, ``||`` at the begin a whole host label; case of letters is ignored.
  Patterns are asked where no site rule fits; one that allows beats those that block.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, staged
from .decontamination import BROADCAST_BYTES, _slices, words_of

RULE_SCHEMA = "kind string, action string, rule string"

# The site rules that the registered query applies, and a short list of patterns for what none of them covers.
SITE_RULES = [
    ("site", "allow", "com/"),
    ("site", "block", "example.com/en/"),
    ("site", "allow", "www.example.com/en/"),
    ("site", "block", "net/es/"),
    ("site", "block", "net/fr/"),
]
PATTERN_RULES = [
    ("pattern", "block", "||ads-*"),
    ("pattern", "block", "||adserver^"),
    ("pattern", "block", "||casino-*"),
    ("pattern", "block", "||doubleclick^"),
    ("pattern", "block", "-bets.*"),
    ("pattern", "block", "-casino.*"),
    ("pattern", "block", "-farm.*"),
    ("pattern", "block", "-pills.*"),
    ("pattern", "block", "-track.*"),
    ("pattern", "block", "^phishing^"),
    ("pattern", "block", "^wp-login.php"),
    ("pattern", "block", "?*&sessionid="),
    ("pattern", "allow", "^robots.txt|"),
]

# Fixed value: a token is a run of letters, digits and non-ASCII characters, as words of a benchmark are.
_TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
# Fixed value: what a separator in a pattern stands for, ASCII other than letters, digits and ``_-.%``.
_SEPARATOR = r"[\x00-\x24\x26-\x2C\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x7F]"
_ROW_BYTES = 64


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] = SITE_RULES + PATTERN_RULES) -> DataFrame:
    return spark.createDataFrame(rules, RULE_SCHEMA)


def with_parts(rows: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host``, ``path`` and ``target``: the URL after ``://`` with its host in lower case, which rules are tried on."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise(F.lit(""))
    host = lower_ascii(F.regexp_extract(F.col("_rest"), r"^[^/?#]*", 0))
    after = F.substring(F.col("_rest"), F.length("host") + 1, F.length("_rest"))
    return (
        rows.withColumn("_rest", F.coalesce(rest, F.lit("")))
        .withColumn("host", host)
        .withColumn("_after", after)
        .withColumns({"path": F.regexp_extract("_after", r"^[^?#]*", 0), "target": F.concat("host", "_after")})
        .drop("_rest", "_after")
    )


def _escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"[\\.+?$\[\](){}|*^\-]", r"\\$0")


def compiled(rules: DataFrame) -> DataFrame:
    """``(kind, action, rule, regex, tokens)`` of every distinct rule.

    ``tokens`` are the literal tokens that any URL which the rule fits has as whole tokens: those that touch neither a wildcard
    nor an open end of the rule. A rule of another kind or action is an error; one that is NULL is none.
    """
    known = F.col("kind").isin("site", "pattern") & F.col("action").isin("allow", "block")
    wrong = F.raise_error(F.concat(F.lit("unknown kind or action of rule "), F.col("rule")))
    rules = rules.select("kind", "action", "rule").filter(F.col("rule").isNotNull()).distinct()
    rules = rules.withColumn("kind", F.when(known, F.col("kind")).otherwise(wrong.cast("string")))

    host = lower_ascii(F.substring_index("rule", "/", 1))
    path = F.substring(F.col("rule"), F.length(F.substring_index("rule", "/", 1)) + 1, F.length("rule"))
    site = F.concat(F.lit(r"^(?:[^/?#]*\.)?"), _escaped(host), F.when(path == "", r"(?:[/?#]|\z)").otherwise(_escaped(path)))
    site_text = F.concat(host, path, F.when(path == "", "/").otherwise("*"))

    at_label, at_start = F.col("rule").startswith("||"), F.col("rule").startswith("|")
    at_end = F.col("rule").endswith("|") & (F.length("rule") > F.when(at_label, 2).otherwise(1))
    skipped = F.when(at_label, 2).when(at_start, 1).otherwise(0)
    body = F.substring(F.col("rule"), skipped + 1, F.length("rule") - skipped - at_end.cast("int"))
    literal = F.regexp_replace(body, r"[\\.+?$\[\](){}|\-]", r"\\$0")
    inner = F.regexp_replace(F.regexp_replace(literal, r"\^", rf"(?:{_SEPARATOR}|\\A|\\z)".replace(r"\x", r"\\x")), r"\*", ".*")
    begin = F.when(at_label, r"^(?:[^/?#]*\.)?").when(at_start, "^").otherwise("")
    pattern = F.concat(F.lit("(?is)"), begin, inner, F.when(at_end, r"\z").otherwise(""))
    pattern_text = F.concat(F.when(at_start, "").otherwise("*"), body, F.when(at_end, "").otherwise("*"))

    is_site = F.col("kind") == "site"
    return rules.withColumns(
        {
            "regex": F.when(is_site, site).otherwise(pattern),
            "_text": lower_ascii(F.when(is_site, site_text).otherwise(pattern_text)),
        }
    ).select(
        "kind",
        "action",
        "rule",
        "regex",
        F.array_distinct(
            F.regexp_extract_all("_text", F.lit(rf"(?<!{_TOKEN}|\*){_TOKEN}+(?!{_TOKEN}|\*)"), F.lit(0))
        ).alias("tokens"),
    )


def url_tokens(target: str = "target") -> Column:
    return F.array_distinct(words_of(lower_ascii(F.col(target))))


def rule_index(rules: DataFrame, urls: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``(kind, action, rule, regex, token)``: every rule under its rarest token; ``token`` is empty if a rule has none.

    How many URLs have a token is counted over all ``urls``, for tokens of rules only, and combined before the shuffle.
    """
    rules = staged(compiled(rules), "rules")
    placed = rules.select("rule", "kind", "action", F.explode("tokens").alias("token"))
    vocabulary = staged(placed.select("token").distinct(), "vocabulary")
    spoken = urls.select(F.explode(url_tokens()).alias("_spoken"))
    counts = [
        spoken.join(some, F.col("_spoken") == F.col("token"), "left_semi").groupBy("_spoken").agg(F.count("*").alias("_times"))
        for some in _slices(vocabulary, F.octet_length("token") + _ROW_BYTES, "token", limit)
    ]
    key = ["kind", "action", "rule"]
    if not counts:
        return rules.drop("tokens").withColumn("token", F.lit(""))
    times = reduce(DataFrame.union, counts)
    rarity = F.struct(F.coalesce("_times", F.lit(0)).alias("times"), "token")
    rarest = placed.join(times, F.col("token") == F.col("_spoken"), "left").groupBy(*key).agg(F.min(rarity).alias("_rarest"))
    joined = rules.drop("tokens").join(rarest, key, "left")
    return joined.select(*key, "regex", F.coalesce("_rarest.token", F.lit("")).alias("token"))


def fitting(urls: DataFrame, index: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``(row, kind, action, rule)``: the rules that fit each URL of ``urls(row, target)``.

    The tokens of a URL - and the empty one, under which rules without a token stand - fetch the candidates in a broadcast join;
    the join's condition runs their regular expressions and nothing else does. A rule list of more than ``limit`` bytes goes in
    several rounds.
    """
    asked = F.explode(F.concat(F.array(F.lit("")), url_tokens())).alias("_asked")
    asking = urls.select("row", "target", asked)
    size = F.octet_length("regex") + F.octet_length("rule") + F.octet_length("token") + _ROW_BYTES
    condition = (F.col("_asked") == F.col("token")) & F.rlike(F.col("target"), F.col("regex"))
    found = [
        asking.join(some, condition).select("row", "kind", "action", "rule")
        for some in _slices(staged(index, "index"), size, "rule", limit)
    ]
    if not found:
        nothing = F.lit(None).cast("string")
        return urls.select("row", nothing.alias("kind"), nothing.alias("action"), nothing.alias("rule")).limit(0)
    return reduce(DataFrame.union, found)


def judge(
    pages: DataFrame,
    rules: DataFrame,
    otherwise: str = "allow",
    page_id: str = "page_id",
    url: str = "url",
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """``(page_id, url, host, path, rule, pattern, verdict)`` of every row of ``pages``.

    ``rule`` is the longest site rule that fits and gives the verdict; without one it is NULL, and a fitting ``pattern`` decides,
    else ``otherwise``. Of equally long rules, and of patterns, one that allows comes first, then the last by name.

    A URL that is NULL or has no ``://`` has an empty host and path. Repeated rows, also with one id, are rows of their own; a NULL
    id is kept; an empty table gives an empty result, an empty rule list lets ``otherwise`` decide. Only id and URL are read, so
    other columns may have any names. URLs are written once with a number for each row, under which verdicts are combined: one
    row per URL is shuffled, and neither a hot host nor a hot URL gathers in a task.
    """
    named = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    rows = staged(with_parts(named).withColumn("row", F.monotonically_increasing_id()), "urls")
    found = fitting(rows, rule_index(rules, rows, limit), limit)
    is_site, allows = F.col("kind") == "site", F.col("action") == "allow"
    order = F.struct(is_site, F.when(is_site, F.length("rule")).otherwise(0), allows, "rule")
    best = found.groupBy("row").agg(F.max_by(F.struct("kind", "rule", "action"), order).alias("_best"))
    return rows.join(best, "row", "left").select(
        "page_id",
        "url",
        "host",
        "path",
        F.when(F.col("_best.kind") == "site", F.col("_best.rule")).alias("rule"),
        F.when(F.col("_best.kind") == "pattern", F.col("_best.rule")).alias("pattern"),
        F.coalesce("_best.action", F.lit(otherwise)).alias("verdict"),
    )
