from .pipelines import (
    add_delete_index,
    full_changes,
    full_index,
    incremental_index,
    index_diff,
    prepare,
    refit_model,
    refresh_cells,
    stored_embedder,
    texts_of,
)

__all__ = [
    "add_delete_index",
    "full_changes",
    "full_index",
    "incremental_index",
    "index_diff",
    "prepare",
    "refit_model",
    "refresh_cells",
    "stored_embedder",
    "texts_of",
]
