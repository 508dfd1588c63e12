from .corpus import (
    change_list,
    corpus_scan,
    ignore_rules,
    path_list,
    paths_frame,
    read_change_list,
    read_ignore_rules,
    readable,
    spread,
    table_corpus,
)
from .files import list_files, read_files, write_files
from .store import INDEX_SCHEMA, STATE_SCHEMA, IndexStore, State

__all__ = [
    "INDEX_SCHEMA",
    "STATE_SCHEMA",
    "IndexStore",
    "State",
    "change_list",
    "corpus_scan",
    "ignore_rules",
    "list_files",
    "path_list",
    "paths_frame",
    "read_change_list",
    "read_files",
    "read_ignore_rules",
    "readable",
    "spread",
    "table_corpus",
    "write_files",
]
