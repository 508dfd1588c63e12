import numpy as np
import pytest
from pyspark.sql import functions as F

from pathlight.llm import quality

from .conftest import records


def corpus(spark, size=900, labelled=300):
    """Junk shouts and has symbols; a word tells what is toxic. Only some rows are labelled."""
    draw = np.random.default_rng(7)
    words = [f"word{n}" for n in range(300)]
    docs, labels = [], []
    for n in range(size):
        text = list(draw.choice(words, 40))
        junk, toxic = n % 4 == 0, n % 5 == 0
        if toxic:
            text[int(draw.integers(40))] = "wretch"
        text = " ".join(w.upper() + "!!" if junk else w for w in text)
        docs.append((n, text, "en", f"s{n % 3}"))
        if draw.random() < labelled / size:
            labels.append((n, int(not junk), int(toxic)))
    return (
        spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string"),
        spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"),
    )


def test_unlabelled_rows_are_told_apart(spark):
    docs, labels = corpus(spark)
    rows = records(quality.classify(docs, labels))
    assert np.mean([(r["quality_score"] >= 0.5) == (r["doc_id"] % 4 != 0) for r in rows]) > 0.97
    assert np.mean([(r["toxic_score"] >= 0.5) == (r["doc_id"] % 5 == 0) for r in rows]) > 0.97
    again = {r["doc_id"]: r["quality_score"] for r in records(quality.score(docs, {"quality": quality.fit(docs, labels, "quality")}))}
    assert all(abs(again[r["doc_id"]] - r["quality_score"]) < 1e-9 for r in rows)


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs, labels = corpus(spark)
    wrong = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (quality.fit(docs, given, "quality") for given in (labels, wrong))
    assert (one.text.weights == two.text.weights).all() and (one.mix == two.mix).all()


def test_each_view_learns_from_the_other():
    """A word that no labelled row has is learned because the form of the page gives it away."""
    draw = np.random.default_rng(8)

    def rows(count, word_of):
        label = draw.random(count) < 0.5
        text = [np.unique(np.append(draw.integers(10, 200, 15), word_of(bad))) for bad in label]
        form = [np.unique(np.append(draw.integers(0, 20, 3), 100 if bad else 101)) for bad in label]
        return (quality.Sparse.of(text), quality.Sparse.of(form)), label.astype(float)

    views, labels = rows(200, lambda bad: 1 if bad else 2)
    pool, truth = rows(2000, lambda bad: draw.choice([1, 3]) if bad else 2)
    alone = quality.co_train(views, labels, pool, rounds=0)
    taught = quality.co_train(views, labels, pool, rounds=3)
    assert alone.text.weights[3] == 0 == taught.text.weights[3] or taught.text.weights[3] > alone.text.weights[3]
    _, _, score = taught.score(*pool)
    assert ((score > 0.5) == (truth > 0.5)).mean() > 0.98


def test_a_line_is_fitted():
    draw = np.random.default_rng(9)
    x = draw.normal(size=(4000, 1))
    y = (draw.random(4000) < quality.sigmoid(2 * x[:, 0] - 1)).astype(float)
    assert np.allclose(quality.fit_line(x, y), [2, -1], atol=0.2)


@pytest.mark.parametrize("columns", [{}, {"quality": 1, "toxic": 0}])
def test_odd_rows(spark, odd_docs, no_docs, columns):
    labels = spark.createDataFrame(
        [(1, 1, 0), (1, 1, 0), (2, 0, 1), (3, 0, None), (None, 1, 1), (77, 1, 1), (4, None, 0)], "doc_id bigint, quality int, toxic int"
    )
    for name, value in columns.items():
        labels = labels.withColumn(name, F.lit(value))
    rows = records(quality.classify(odd_docs, labels))
    assert len(rows) == odd_docs.count()
    assert all(0 <= r[f"{t}_{v}"] <= 1 for r in rows for t in ("quality", "toxic") for v in ("text", "meta", "score"))
    assert quality.classify(no_docs, labels).count() == 0
    assert quality.classify(odd_docs, labels.limit(0)).count() == odd_docs.count()


def same(one, two):
    sides = [(one.text, two.text), (one.meta, two.meta)]
    return (one.mix == two.mix).all() and all((a.weights == b.weights).all() and a.bias == b.bias for a, b in sides)


def test_partitions_and_repeated_labelled_rows_change_nothing(spark):
    """A labelled document counts once however often it occurs, and sums over the pool do not depend on how it is dealt."""
    docs, labels = corpus(spark, 400, 200)
    hot = labels.select("doc_id").limit(1).collect()[0].doc_id
    repeated = docs.unionByName(docs.filter(F.col("doc_id") == hot).select(docs.columns).crossJoin(spark.range(300)).drop("id"))
    one = quality.fit(docs.repartition(1), labels, "quality")
    assert same(one, quality.fit(repeated.repartition(7), labels, "quality"))


def test_sums_over_tasks_are_those_over_all_rows(spark):
    """Every pool row of which a view is sure is handed over, in whatever task it lies: against one pass over all rows."""
    draw = np.random.default_rng(10)
    lists = lambda top: [np.unique(draw.integers(0, top, 12)).tolist() for _ in range(500)]
    words, form = lists(300), lists(60)
    sparse = [quality.Sparse.of([np.array(r, dtype=np.int64) for r in side]) for side in (words, form)]
    labels = (draw.random(500) < 0.5).astype(float)
    kept = np.ones(quality.TEXT_BUCKETS, dtype=bool)
    training = quality.CoTraining((sparse[0], sparse[1]), labels, np.arange(500) % 5 == 0, kept)
    for view in training.teachers:
        view.slope, view.shift = 5.0, 0.0
    expected = quality.pool_sums((sparse[0], sparse[1]), training.teachers, training.students())
    assert all(0 < side[:, -1].sum() < 500 for side in expected)
    pool = spark.createDataFrame(list(zip(words, form, strict=True)), "words array<int>, form array<int>").repartition(5)
    found = quality._pool_sums(pool, [training])[0]
    assert all((a == b).all() for a, b in zip(found, expected, strict=True))
