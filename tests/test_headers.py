import pytest
from pyspark.sql import functions as F

from pathlight.functions import strip_header

PYTHON = {
    "sample": (
        "\n# hello\n# world\nimport sys\n\nimport os\nfrom pathlib import Path\n\nprint('xxx')\nprint('xxx')\n",
        "print('xxx')\nprint('xxx')",
    ),
    "docstring is code": ('"""doc"""\nimport a\n', '"""doc"""\nimport a'),
    "future import is code": ("from __future__ import x\nimport a\n", "from __future__ import x\nimport a"),
    "after future import": ("# c\nfrom __future__ import x\n", "from __future__ import x"),
    "brackets": ("from a.b import (\n  x, # c)\n  y as z,\n)\ncode()\n", "code()"),
    "relative": ("from . import a\nfrom .b import c\nfrom .. import *\nfrom .x.y import d\nz", "z"),
    "continued": ("from a import b, \\\n   c\nimport d, \\\n  e\nx=1", "x=1"),
    "aliases": ("import numpy as np, a.b as c # hi\ny = 1", "y = 1"),
    "two on a line": ("import sys; x = 1\n", "; x = 1"),
    "only header": ("import a\n# x\n", ""),
    "non-ascii header": ("# héé 中文 😀\nimport a\nx = 'ü'\n", "x = 'ü'"),
    "name like import": ("important = 1\nimport x", "important = 1\nimport x"),
    "name like from": ("from_x = 3", "from_x = 3"),
    "prose": ("import duties rose\n# x", "import duties rose\n# x"),
    "byte order mark": ("﻿import a\nx", "x"),
    "shebang": ("#!/usr/bin/python\nx", "x"),
    "later imports stay": ("x = 1\nimport a\n", "x = 1\nimport a"),
    "windows line ends": ("import a\r\n# b\r\nx = 1\r\n", "x = 1"),
    "C comment is code": ("// a\nimport b", "// a\nimport b"),
    "blank": (" \n\t", ""),
}

CPP = {
    "includes": ('#include <a>\n# include "b.h" // x\n/* a\n * b */ int x;\n', "int x;"),
    "guard is code": ("// c\n#ifndef A\n#define A\n", "#ifndef A\n#define A"),
    "pragma is code": ("#pragma once\n#include <a>", "#pragma once\n#include <a>"),
    "using is code": ("#include <a>\nusing namespace std;\n", "using namespace std;"),
    "open comment is code": ("// a\n/* x\nint", "/* x\nint"),
    "continued comment": ("// a \\\n still comment\nint x;", "int x;"),
    "no line end": ("#include <a>", ""),
    "stars": ("/***/ /**/ /* **/int z;", "int z;"),
    "import is code": ("import a;\n", "import a;"),
    "hash comment is code": ("# comment\nint x;", "# comment\nint x;"),
}


@pytest.mark.parametrize(("language", "cases"), [("python", PYTHON), ("cpp", CPP)])
def test_headers(spark, language, cases):
    rows = spark.createDataFrame([(name, text) for name, (text, _) in cases.items()], "name string, content string")
    out = rows.select("name", strip_header("content", F.lit(language)).alias("out")).collect()
    assert {row["name"]: row["out"] for row in out} == {name: expected for name, (_, expected) in cases.items()}


def test_unknown_language_is_untouched(spark):
    rows = spark.createDataFrame([("  # a\n", None), (" x ", "rust"), (None, "python")], "content string, l string")
    out = [row[0] for row in rows.select(strip_header("content", "l")).collect()]
    assert out == ["  # a\n", " x ", None]


def test_very_long_headers(spark):
    texts = {
        "python": [
            "# c\nimport a\nfrom a import b\n" * 30_000 + "x",
            "import a, \\\n" + "  b, \\\n" * 30_000 + " c\nx",
            "from a import (\n" + "  b, # c\n" * 30_000 + " c)\nx",
            "\n" * 500_000 + "x",
        ],
        "cpp": ["// a\n#include <b>\n" * 30_000 + "x", "/*" + "y *\n" * 200_000 + "*/x", "//" + " \\\n" * 30_000 + "\nx"],
    }
    for language, contents in texts.items():
        rows = spark.createDataFrame([(text,) for text in contents], "content string")
        assert {row[0] for row in rows.select(strip_header("content", F.lit(language))).collect()} == {"x"}


def test_text_without_header_is_quick_with_long_blanks(spark):
    rows = spark.createDataFrame([("x" + " " * 1_000_000 + "y" + " " * 1_000_000,)], "content string")
    assert rows.select(F.length(strip_header("content", F.lit("python")))).first()[0] == 1_000_002
