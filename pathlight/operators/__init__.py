from .ann import CellIndex, ann_search, append_changes, build_cells, drift
from .changes import (
    apply_changes,
    apply_summary,
    assign_ids,
    change_summary,
    dedupe_last_wins,
    delete_by_key,
    keep_by_key,
    keep_ids,
    route_changes,
    snapshot_diff,
    snapshot_moves,
    union_changes,
    upsert,
)
from .clean import (
    blank_filter,
    exists_filter,
    header_summary,
    ignore_filter,
    language_tag,
    path_normalize,
    quarantine,
    strip_headers,
    validate_index,
)
from .embed import BatchEmbedder, TfIdfEmbedder, embed_table, fit_idf, tfidf_weights
from .search import (
    DEFAULT_SQL,
    batch_search,
    encode_query,
    ranked_hits,
    search_text,
    split_queries,
    sql_search,
    top_k_search,
)

__all__ = [
    "DEFAULT_SQL",
    "BatchEmbedder",
    "CellIndex",
    "TfIdfEmbedder",
    "ann_search",
    "append_changes",
    "apply_changes",
    "apply_summary",
    "assign_ids",
    "batch_search",
    "blank_filter",
    "build_cells",
    "drift",
    "change_summary",
    "dedupe_last_wins",
    "delete_by_key",
    "embed_table",
    "encode_query",
    "exists_filter",
    "fit_idf",
    "header_summary",
    "ignore_filter",
    "keep_by_key",
    "keep_ids",
    "language_tag",
    "path_normalize",
    "quarantine",
    "ranked_hits",
    "route_changes",
    "search_text",
    "snapshot_diff",
    "snapshot_moves",
    "split_queries",
    "sql_search",
    "strip_headers",
    "tfidf_weights",
    "top_k_search",
    "union_changes",
    "upsert",
    "validate_index",
]
