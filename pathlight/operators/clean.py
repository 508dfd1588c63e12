"""Filters and checks that decide what goes into the index."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import LANGUAGES, is_blank, language_of, matches_any_glob, normalize_path, strip_header

# Rules that become parts of one predicate; a rule file has dozens.
MOST_RULES = 10_000

# Fixed value: longest path the index accepts.
MAX_PATH_LENGTH = 255


def ignore_filter(files: DataFrame, rules: Iterable[str] | DataFrame, path: str = "file_path") -> DataFrame:
    """Drop rows whose whole path matches any glob rule. A filter only: no join, no shuffle.

    ``rules`` is a list, or the DataFrame of :func:`pathlight.sources.ignore_rules` - the contents of one rule file,
    which is read on the driver in any case to build the predicate.
    """
    if isinstance(rules, DataFrame):
        rules = [row["rule"] for row in rules.limit(MOST_RULES + 1).collect()]
        if len(rules) > MOST_RULES:
            raise ValueError(f"more than {MOST_RULES} rules: join such a table instead of turning it into a predicate")
    return files.filter(~matches_any_glob(path, rules))


def language_tag(files: DataFrame, languages: Mapping[str, str] = LANGUAGES, path: str = "file_path") -> DataFrame:
    """Add ``language``, NULL for an unknown suffix."""
    return files.withColumn("language", language_of(path, languages))


def path_normalize(files: DataFrame, path: str = "file_path") -> DataFrame:
    return files.withColumn(path, normalize_path(path))


def blank_filter(files: DataFrame, text: str = "code_text") -> DataFrame:
    """Drop rows whose text is empty or whitespace."""
    return files.filter(~is_blank(text))


def exists_filter(paths: DataFrame, files: DataFrame, path: str = "file_path") -> DataFrame:
    """Only the paths which exist in the file table. Reads nothing but the path column of ``files``."""
    return paths.join(files.select(path), path, "left_semi").select(*paths.columns)


def strip_headers(
    files: DataFrame, languages: Mapping[str, str] = LANGUAGES, path: str = "file_path", content: str = "content"
) -> DataFrame:
    """Add ``code_text``: the content without the leading comments and imports of its language."""
    return files.withColumn("code_text", strip_header(content, language_of(path, languages)))


def header_summary(files: DataFrame, languages: Mapping[str, str] = LANGUAGES) -> DataFrame:
    """Files, characters before and characters cut off, per language."""
    tagged = strip_headers(language_tag(files, languages), languages)
    return tagged.groupBy("language").agg(
        F.count("*").alias("files"),
        F.sum(F.length("content")).alias("characters"),
        F.sum(F.length("content") - F.length("code_text")).alias("stripped"),
    )


def _row_rules(dim: int, embedding: str) -> list[tuple[str, Column]]:
    path, text, vector = F.col("file_path"), F.col("code_text"), F.col(embedding)
    bad_vector = vector.isNotNull() & ((F.size(vector) != dim) | F.exists(vector, lambda value: value.isNull()))
    return [
        ("path_missing", path.isNull()),
        ("path_too_long", F.length(path) > MAX_PATH_LENGTH),
        ("text_missing", text.isNull()),
        ("dimension", bad_vector),
        ("not_finite", F.exists(vector, lambda value: F.isnan(value) | (F.abs(value) == float("inf")))),
    ]


def broken_rules(dim: int, embedding: str = "embedding") -> Column:
    """Array with the names of the row rules that a row breaks."""
    found = [F.when(test, F.lit(name)) for name, test in _row_rules(dim, embedding)]
    return F.array_compact(F.array(*found))


def validate_index(index: DataFrame, dim: int, embedding: str = "embedding") -> DataFrame:
    """Table ``(rule, file_path, rows)`` of every broken constraint, duplicate paths included."""
    # Every path is counted along with the broken rules: one scan, one shuffle of names and paths.
    counted = F.when(F.col("file_path").isNotNull(), F.lit("path_not_unique"))
    rules = F.concat(broken_rules(dim, embedding), F.array_compact(F.array(counted)))
    return (
        index.select("file_path", F.explode(rules).alias("rule"))
        .groupBy("rule", "file_path")
        .agg(F.count("*").alias("rows"))
        .filter((F.col("rule") != "path_not_unique") | (F.col("rows") > 1))
    )


def quarantine(rows: DataFrame, dim: int, embedding: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """Split rows into those that keep the row rules and those that do not, the latter with ``broken``."""
    marked = rows.withColumn("broken", broken_rules(dim, embedding))
    return marked.filter(F.size("broken") == 0).drop("broken"), marked.filter(F.size("broken") > 0)
