"""Column functions over file paths: normal form, suffix, glob rules."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col

# Which suffix belongs to which language; every other suffix has none.
LANGUAGES = {
    ".py": "python",
    ".cpp": "cpp",
    ".hpp": "cpp",
}

# Rules that need a regular expression are joined into alternations of at most this many, so that no pattern grows
# without limit however long the rule list is. Simple rules beyond the other number are
# treated as regular expressions too, which keeps the predicate short.
_RULES_PER_PATTERN = 200
_SIMPLE_RULES = 100


def normalize_path(column: Column | str) -> Column:
    """POSIX normal form: no ``.`` segments, no doubled or trailing slashes; ``..`` stays; empty becomes ``.``."""
    path = _col(column)
    root = F.regexp_extract(path, "^(//(?!/)|/)?", 0)
    kept = F.filter(F.split(path, "/"), lambda part: ~part.isin("", "."))
    joined = F.concat(root, F.array_join(kept, "/"))
    return F.when(joined == "", F.lit(".")).otherwise(joined)


def suffix(column: Column | str) -> Column:
    """Last ``.ext`` of the file name; empty for none, for hidden files like ``.bashrc`` and for a dot in a folder."""
    return F.regexp_extract(_col(column), r"[^/]([.][^/.]+)$", 1)


def language_of(column: Column | str, languages: Mapping[str, str] = LANGUAGES) -> Column:
    """Language of a path by its suffix, NULL when unknown."""
    if not languages:
        return F.lit(None).cast("string")
    lookup = F.create_map(*[F.lit(value) for pair in languages.items() for value in pair])
    return F.try_element_at(lookup, suffix(column))


def glob_to_regex(pattern: str) -> str:
    """Java regular expression that matches the whole path: ``*`` and ``?`` cross ``/``; ``[seq]`` and ``[!seq]``."""
    out = []
    rest = pattern
    while rest:
        head, rest = rest[0], rest[1:]
        if head == "*":
            if out[-1:] != [".*"]:
                out.append(".*")
        elif head == "?":
            out.append(".")
        elif head == "[" and (close := rest.find("]", 2 if rest[:1] == "!" else 1)) > 0:
            out.append(_char_class(rest[:close]))
            rest = rest[close + 1 :]
        else:
            out.append(_quote(head))
    return "(?s)" + "".join(out)


def _quote(char: str) -> str:
    return char if char.isalnum() or char in "_/- " or ord(char) > 127 else "\\" + char


def _char_class(body: str) -> str:
    negated = body.startswith("!")
    members = body[1:] if negated else body
    parts = []
    while members:
        if len(members) >= 3 and members[1] == "-":
            low, high = members[0], members[2]
            if low <= high:
                parts.append(f"{_quote_in_class(low)}-{_quote_in_class(high)}")
            members = members[3:]
        else:
            parts.append(_quote_in_class(members[0]))
            members = members[1:]
    if not parts:  # only empty ranges: matches nothing, or anything when negated
        return "." if negated else "(?!)"
    return f"[{'^' if negated else ''}{''.join(parts)}]"


def _quote_in_class(char: str) -> str:
    return char if char.isalnum() or ord(char) > 127 else "\\" + char


_MAGIC = re.compile(r"[*?\[]")


def matches_any_glob(column: Column | str, patterns: Iterable[str]) -> Column:
    """True when the whole path matches at least one glob.

    Rules of the everyday kinds (`name`, `*.ext`, `folder/*`, `*part*`) become equality, suffix, prefix and substring
    predicates, which Spark pushes into a Parquet scan; only the rest become regular expressions.
    """
    path = _col(column)
    exact: list[str] = []
    regexes: list[str] = []
    simple: dict[str, Column] = {}
    for pattern in dict.fromkeys(patterns):
        core = pattern.strip("*")
        if _MAGIC.search(core) or len(simple) >= _SIMPLE_RULES:
            regexes.append(glob_to_regex(pattern))
        elif pattern == core:
            exact.append(pattern)
        elif not core:
            simple[pattern] = path.isNotNull()
        elif not pattern.startswith("*"):
            simple[pattern] = path.startswith(core)
        elif not pattern.endswith("*"):
            simple[pattern] = path.endswith(core)
        else:
            simple[pattern] = path.contains(core)
    tests = list(simple.values())
    if exact:
        tests.append(path.isin(exact))
    for start in range(0, len(regexes), _RULES_PER_PATTERN):
        joined = "|".join(f"(?:{regex})" for regex in regexes[start : start + _RULES_PER_PATTERN])
        tests.append(path.rlike(rf"\A(?:{joined})\z"))
    return _any(tests)


def _any(tests: list[Column]) -> Column:
    """Balanced OR, so that thousands of rules do not nest thousands deep."""
    if not tests:
        return F.lit(False)
    while len(tests) > 1:
        pairs = [tests[i] | tests[i + 1] for i in range(0, len(tests) - 1, 2)]
        tests = pairs + ([tests[-1]] if len(tests) % 2 else [])
    return tests[0]
