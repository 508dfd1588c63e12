import hashlib
import math
import re

import numpy as np
import pyarrow as pa
import pytest

from pathlight.operators import BatchEmbedder, TfIdfEmbedder, embed_table, fit_idf
from pathlight.operators.embed import term_counts

TEXTS = ["Hello, hello World_1!", "world  wide", "", None, "…!?", "Éa éA 文字 x2", "a " * 3000]


def bucket(word, dim):
    return int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % dim


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute_force(texts, dim):
    counts = np.zeros((len(texts), dim))
    for row, text in enumerate(texts):
        for word in words(text):
            counts[row, bucket(word, dim)] += 1
    total = sum(text is not None for text in texts)
    idf = np.array([math.log((1 + total) / (1 + n)) + 1 for n in (counts > 0).sum(axis=0)])
    vectors = counts * idf
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return counts, idf, np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)


def corpus(spark):
    return spark.createDataFrame([(str(i), text) for i, text in enumerate(TEXTS)], "file_path string, code_text string")


def test_term_counts():
    counts, _, _ = brute_force(TEXTS, 16)
    assert (term_counts(pa.array(TEXTS), 16) == counts).all()
    assert term_counts(pa.array([], pa.string()), 4).shape == (0, 4)
    sliced = pa.array(["skipped", *TEXTS]).slice(1)
    assert (term_counts(sliced, 16) == counts).all()


@pytest.mark.parametrize("dim", [3, 64])
def test_tfidf_matches_brute_force(spark, dim):
    _, idf, vectors = brute_force(TEXTS, dim)
    rows = corpus(spark).repartition(3)
    model = fit_idf(rows, dim).orderBy("bucket").collect()
    assert [row["bucket"] for row in model] == list(range(dim))
    assert {row["total"] for row in model} == {6}
    assert np.allclose([row["idf"] for row in model], idf)
    embedded = {r["file_path"]: r["embedding"] for r in TfIdfEmbedder.fit(rows, dim)(rows).collect()}
    for i, text in enumerate(TEXTS):
        if text is None:
            assert embedded[str(i)] is None
        else:
            assert np.allclose(embedded[str(i)], vectors[i], atol=1e-6)


def test_query_uses_the_model_of_the_corpus(spark):
    rows = corpus(spark)
    embedder = TfIdfEmbedder.fit(rows, 32)
    query = spark.createDataFrame([("hello unseenword",)], "text string")
    vector = np.array(embedder(query, "text").first()["embedding"])
    _, idf, _ = brute_force(TEXTS, 32)
    expected = np.zeros(32)
    for word in ("hello", "unseenword"):
        expected[bucket(word, 32)] += idf[bucket(word, 32)]
    assert np.allclose(vector, expected / np.linalg.norm(expected), atol=1e-6)


def test_no_model(spark):
    with pytest.raises(ValueError, match="no embedding model"):
        TfIdfEmbedder([])


def test_a_fit_on_nothing_weighs_all_words_alike(spark):
    """A run that leaves no file is a run like any other; the next one with files fits the model anew."""
    model = fit_idf(corpus(spark).filter("false"), 4, "code_text").orderBy("bucket").collect()
    assert [tuple(r) for r in model] == [(n, 0, 0, 1.0) for n in range(4)]
    assert TfIdfEmbedder.fit(corpus(spark).filter("false"), 4).idf == [1.0] * 4


def test_batch_embedder(spark, letters):
    rows = corpus(spark).repartition(2)
    out = {r["file_path"]: r["embedding"] for r in BatchEmbedder(letters, 4, batch_size=2)(rows).collect()}
    assert out["0"] == [0.0, 2.0, 0.0, 3.0]
    assert out["2"] == [0.0] * 4
    assert out["3"] is None


def test_embed_table_sets_unusable_vectors_aside(spark):
    def load():
        def encode(texts):
            return [[1.0, 2.0] if text == "ok" else [] if text == "failed" else [1.0] if text == "short" else None for text in texts]

        return encode

    rows = spark.createDataFrame([("ok",), ("failed",), ("short",), ("none",)], "code_text string")
    good, bad = embed_table(rows, load, 2)
    assert [(r["code_text"], r["embedding"]) for r in good.collect()] == [("ok", [1.0, 2.0])]
    assert sorted(r["code_text"] for r in bad.collect()) == ["failed", "none", "short"]


def test_model_that_loses_rows_is_an_error(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "code_text string").coalesce(1)
    with pytest.raises(Exception, match="zip"):
        BatchEmbedder(lambda: lambda texts: [[1.0]], 1)(rows).collect()


def test_a_model_is_loaded_once_per_worker(spark, tmp_path):
    """Many tasks share the workers, and a worker loads a model once."""
    loads = tmp_path / "loads"
    loads.mkdir()

    def load():
        import os
        import uuid

        open(os.path.join(str(loads), f"{os.getpid()}-{uuid.uuid4().hex}"), "w").close()
        return lambda texts: [[1.0, float("nan") if "bad" in text else 2.0] for text in texts]

    rows = spark.createDataFrame([(f"t{n}" if n else "bad",) for n in range(64)], "code_text string").repartition(32)
    embedded = BatchEmbedder(load, 2)(rows)
    assert embedded.filter("embedding IS NULL").count() == 1
    workers = [path.name.split("-")[0] for path in loads.iterdir()]
    assert len(workers) == len(set(workers)) <= 8
