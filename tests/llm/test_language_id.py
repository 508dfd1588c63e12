import zlib

import numpy as np

from pathlight.llm import language_id

from .conftest import records

WORDS = {
    "en": "the and of house water good morning people think through which".split(),
    "de": "und der die haus wasser guten morgen menschen denken durch welche".split(),
    "fr": "et le la maison eau bonjour matin gens pensent à travers lequel".split(),
}


def corpus(spark, size=600):
    draw = np.random.default_rng(6)
    rows = []
    for n in range(size):
        lang = ["en", "de", "fr", "en"][n % 4]
        rows.append((n, " ".join(draw.choice(WORDS[lang], 12)), lang if n % 11 else None, lang))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, truth string")


def test_held_out_accuracy_and_no_peeking(spark):
    docs = corpus(spark)
    rows = records(language_id.language_id(docs).withColumn("held_out", language_id.held_out()))
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["language"]["lang"] == r["truth"] for r in held) / len(held) > 0.98
    assert all(0 <= r["language"]["score"] <= 1 for r in rows)
    # The label of a row that is held out has no influence.
    from pyspark.sql import functions as F

    altered = docs.withColumn("lang", F.when(language_id.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    again = {r["doc_id"]: r["language"] for r in records(language_id.language_id(altered))}
    assert again == {r["doc_id"]: r["language"] for r in rows}


def test_pieces_of_a_long_text_count_every_gram_once(monkeypatch):
    text = "the quick brown fox jumps over " * 50
    whole = np.concatenate([b for _, b in language_id.gram_buckets([text, "und die"])])
    monkeypatch.setattr(language_id, "_CHARACTERS_AT_ONCE", 64)
    cut = np.concatenate([b for _, b in language_id.gram_buckets([text, "und die"])])
    assert (np.sort(whole) == np.sort(cut)).all()


def test_counts_against_a_plain_model(spark):
    """Probabilities equal those of naive Bayes written out with dictionaries."""
    import math
    from collections import Counter

    docs = corpus(spark, 200)
    model = language_id.fit(docs)
    train = [r for r in records(docs) if r["lang"] and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2]
    counts = {lang: Counter() for lang in model.languages}
    for r in train:
        for _, buckets in language_id.gram_buckets([r["text"]]):
            counts[r["lang"]].update(buckets.tolist())
    for number, lang in enumerate(model.languages):
        total = sum(counts[lang].values()) + language_id.SMOOTHING * language_id.BUCKETS
        for bucket, n in counts[lang].most_common(50):
            assert math.isclose(model.buckets[bucket, number], math.log((n + language_id.SMOOTHING) / total), rel_tol=1e-5)


def test_odd_rows(odd_docs, no_docs):
    rows = records(language_id.language_id(odd_docs))
    assert len(rows) == odd_docs.count()
    for r in rows:
        if r["text"] is None or not any(c.isalpha() for c in r["text"]):
            assert r["language"] == {"lang": "und", "score": 0.0}
        else:
            assert r["language"]["lang"] in ("en", "de", "fr") and 0 <= r["language"]["score"] <= 1
    kept = language_id.keep_identified(odd_docs)
    assert kept.columns == odd_docs.columns and {r["language"] for r in records(kept)} == {"l"}
    assert language_id.language_id(no_docs).count() == 0
