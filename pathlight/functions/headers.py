"""Leading comments and imports of a source file, as one regular expression per language.

Each pattern matches the longest run of header items at the start of a text. All repetitions are possessive, which Java
runs as loops: neither a header of many lines nor one import over many lines costs stack depth, and a text without a
header is given up on at its first character.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col, strip, strip_left

_BREAK = r"\\\r?\n"


def _python_header() -> str:
    gap = rf"(?:[ \t\f]|{_BREAK})"
    dotted = rf"\w++(?:{gap}*+\.{gap}*+\w++)*+"
    alias = rf"(?:{gap}++as{gap}++\w++)?+"
    end = rf"(?={gap}*+(?:[\r\n;#]|\z))"
    plain = rf"import{gap}++{dotted}{alias}(?:{gap}*+,{gap}*+{dotted}{alias})*+{end}"

    names = rf"\w++{alias}(?:{gap}*+,{gap}*+\w++{alias})*+"
    inner = rf"(?:\s|{_BREAK}|#[^\n]*+)"
    inner_name = rf"\w++(?:{inner}++as{inner}++\w++)?+"
    bracketed = rf"\({inner}*+{inner_name}(?:{inner}*+,{inner}*+{inner_name})*+{inner}*+(?:,{inner}*+)?+\)"
    relative = rf"{gap}*+\.(?:{gap}|\.)*+(?:(?!import\b){dotted})?+"
    source = rf"(?:{gap}++(?!__future__\b){dotted}|{relative})"
    listed = rf"from{source}{gap}*+\bimport(?:{gap}*+{bracketed}|{gap}++{names}|{gap}*+\*){end}"

    blank = rf"[\s\uFEFF\u2060\u200B]++|{_BREAK}"
    return rf"(?U)\A(?:{blank}|#[^\n]*+|{plain}|{listed})*+"


def _cpp_header() -> str:
    line_comment = rf"//(?:[^\\\n]++|{_BREAK}|\\.)*+"
    block_comment = r"/\*(?s:.*?)\*/"
    target = r'(?:<[^>\n]*+>|"(?:[^"\\\n]++|\\.)*+"|\w++(?:\([^)\n]*+\))?+)'
    include = rf"#[ \t]*+include[ \t]*+{target}(?=[ \t]*+(?:/[/*]|\r?\n|\z))"
    return rf"(?U)\A(?:\s++|{_BREAK}|{line_comment}|{block_comment}|{include})*+"


HEADERS: dict[str, str] = {"python": _python_header(), "cpp": _cpp_header()}

# Every header starts with one of these, so a text that starts otherwise never meets the pattern.
_OPENINGS: dict[str, tuple[str, ...]] = {
    "python": ("#", "import", "from", "\\", "\ufeff", "\u2060", "\u200b"),
    "cpp": ("/", "#", "\\"),
}


def strip_header(content: Column | str, language: Column | str, headers: Mapping[str, str] = HEADERS) -> Column:
    """Text without its leading header and outer whitespace; text of an unknown language is returned as it is."""
    content, language = _col(content), _col(language)
    result = content
    for name, pattern in headers.items():
        cut = F.regexp_replace(content, F.lit(pattern), F.lit(""))
        if openings := _OPENINGS.get(name):
            may_have_header = reduce(or_, [strip_left(content).startswith(opening) for opening in openings])
            cut = F.when(may_have_header, cut).otherwise(content)
        result = F.when(language == F.lit(name), strip(cut)).otherwise(result)
    return result
