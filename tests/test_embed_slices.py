"""What an embedding task holds at once does not grow with its Arrow batches."""

import pyarrow as pa
from pyspark.sql import functions as F

from pathlight.operators import embed


def in_slices(monkeypatch, make, given):
    """The arrays that the Arrow function of ``make`` gives for one batch."""
    found = []
    with monkeypatch.context() as patched:
        patched.setattr(embed.F, "arrow_udf", lambda kind: lambda function: found.append(function) or (lambda column: F.lit(None)))
        make()
    return list(found[0](iter([given])))


def test_vectors_are_given_slice_by_slice(spark, monkeypatch):
    texts = spark.createDataFrame([("a",)], "code_text string")
    parts = in_slices(monkeypatch, lambda: embed.tfidf_weights(texts, [1.0] * 8, as_float=True), pa.array(["a b", None, ""] * 1000))
    assert sum(map(len, parts)) == 3000 and max(map(len, parts)) <= 1024 and sum(part.null_count for part in parts) == 1000
    vectors = pa.array([[1.0, 2.0], None] * 1500, pa.list_(pa.float32()))
    stored = spark.createDataFrame([([1.0, 2.0],)], "embedding array<float>")
    parts = in_slices(monkeypatch, lambda: embed.reweighted(stored, [1.0, 1.0], [2.0, 1.0]), vectors)
    assert sum(map(len, parts)) == 3000 and max(map(len, parts)) <= 1024 and sum(part.null_count for part in parts) == 1500


def test_long_texts_are_split_into_words_one_by_one():
    texts = pa.array(["word " * (1 << 19)] * 6 + [None, "a"] * 3)
    sizes = [sum(len(text or "") for text in part.to_pylist()) for part in embed._slices(texts)]
    assert max(sizes) <= embed._MATRIX_BYTES and sum(sizes) == 6 * 5 * (1 << 19) + 3
