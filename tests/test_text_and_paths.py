import fnmatch
from pathlib import PurePosixPath

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pathlight.functions import (
    WHITESPACE,
    glob_to_regex,
    is_blank,
    language_of,
    matches_any_glob,
    normalize_path,
    split_whitespace,
    strip,
    suffix,
    universal_newlines,
)


def column(spark, values, name="s"):
    return spark.createDataFrame([(i, value) for i, value in enumerate(values)], f"i int, {name} string")


def evaluate(spark, values, expression):
    rows = column(spark, values).select("i", expression.alias("out")).collect()
    return [row["out"] for row in sorted(rows, key=lambda row: row["i"])]


def test_whitespace_is_what_python_strips():
    assert set(WHITESPACE) == {chr(i) for i in range(0x110000) if chr(i).isspace()}


def test_strip_blank_and_split(spark):
    texts = [" a b ", "　x ", "\n\t\x1c ", "", "é ü"]
    assert evaluate(spark, texts, strip("s")) == [text.strip() for text in texts]
    assert evaluate(spark, texts, is_blank("s")) == [text.strip() == "" for text in texts]
    assert evaluate(spark, texts, split_whitespace("s")) == [text.split() for text in texts]


def test_universal_newlines(spark):
    assert evaluate(spark, ["a\r\nb\rc\n", "plain"], universal_newlines("s")) == ["a\nb\nc\n", "plain"]


PATHS = [
    "a", "./a", "a//b", "a/./b", "a/b/", "/a", "//a", "///a", "/", "//", "", ".", "./", "a/../b", "..", "./..//x/.",
    "/./a", "//./a", "a b/c", ".hidden", "https://x.y//z/",
]


def test_normalize_path(spark):
    assert evaluate(spark, PATHS, normalize_path("s")) == [str(PurePosixPath(path)) for path in PATHS]


def test_suffix_and_language(spark):
    paths = ["a.py", "b.cpp", "c.hpp", "d.md", ".bashrc", "x.tar.gz", "dir.x/file", "dir.py/.py", "no", "end."]
    assert evaluate(spark, paths, suffix("s")) == [".py", ".cpp", ".hpp", ".md", "", ".gz", "", "", "", ""]
    expected = ["python", "cpp", "cpp", *[None] * 7]
    assert evaluate(spark, paths, language_of("s")) == expected
    assert evaluate(spark, ["q.rs", "a.py"], language_of("s", {".rs": "rust"})) == ["rust", None]
    assert evaluate(spark, ["q.rs"], language_of("s", {})) == [None]


@pytest.mark.parametrize(
    ("path", "rules", "ignored"),
    [
        ("test.py", ["*.py"], True),
        ("build/", ["build/", "*.py"], True),
        ("src/build/", ["*/build/*", "*.py"], True),
        ("test.cpp", ["*.py"], False),
        ("src/main.py", ["test*"], False),
        ("build/x", ["build/"], False),
        ("a/b/c.txt", ["a*.txt"], True),
        ("a\nb", ["a*b"], True),
        ("any", [], False),
    ],
)
def test_glob_decisions(spark, path, rules, ignored):
    assert evaluate(spark, [path], matches_any_glob("s", rules)) == [ignored]


def test_globs_agree_with_fnmatch(spark):
    paths = ["", "a", "ab", "a/b.py", "x.py", "[a]", "a]", "a-b", "^a", "a&b", "A", "é", "a.b", "src/t/x.cpp", "a\\b"]
    rules = [
        "", "*", "a*", "*a", "*a*", "a?b", "[ab]", "[!a]", "[a-c]b", "[]a]", "[", "[a", "*.py", "src/*/x.*", "a.b",
        "[^a]a", "[c-a]", "[!c-a]", "a[&-&]b", "a\\b", "**", "?", "[[]a]", "a[-]b", "*?",
    ]
    for rule in rules:
        expected = [fnmatch.fnmatchcase(path, rule) for path in paths]
        assert evaluate(spark, paths, matches_any_glob("s", [rule])) == expected, rule
        regex = F.col("s").rlike(rf"\A(?:{glob_to_regex(rule)})\z")
        assert evaluate(spark, paths, regex) == expected, rule


def test_many_rules(spark):
    rules = [f"dir{i}/[ab]*" for i in range(3000)] + [f"*.x{i}" for i in range(3000)]
    paths = ["dir2999/azz", "dir2999/czz", "q.x1500", "q.y"]
    assert evaluate(spark, paths, matches_any_glob("s", rules)) == [True, False, True, False]


@settings(max_examples=200, deadline=None)
@given(st.text("ab*?[]!-/.", max_size=7), st.text("ab!-]/.[", max_size=6))
def test_glob_regex_property(pattern, path):
    import re

    assert bool(re.fullmatch(glob_to_regex(pattern), path)) == fnmatch.fnmatchcase(path, pattern)
