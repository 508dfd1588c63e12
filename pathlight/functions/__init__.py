from .headers import HEADERS, strip_header
from .paths import LANGUAGES, glob_to_regex, language_of, matches_any_glob, normalize_path, suffix
from .text import WHITESPACE, is_blank, split_whitespace, strip, universal_newlines
from .vectors import cosine_distance, dot_product, l2_norm, register_functions, vector_literal

__all__ = [
    "HEADERS",
    "LANGUAGES",
    "WHITESPACE",
    "cosine_distance",
    "dot_product",
    "glob_to_regex",
    "is_blank",
    "l2_norm",
    "language_of",
    "matches_any_glob",
    "normalize_path",
    "register_functions",
    "split_whitespace",
    "strip",
    "strip_header",
    "suffix",
    "universal_newlines",
    "vector_literal",
]
