from .changes import apply_batch, stream_changes

__all__ = ["apply_batch", "stream_changes"]
