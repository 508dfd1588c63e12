"""A quality classifier by co-training: two views of a document teach each other."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package
from .common import named, staged

TEXT_BUCKETS = 1 << 18
META_BUCKETS = 1 << 12

# The classifier is fitted on about so many labelled rows, chosen by a hash of their ids, and on all unlabelled ones.
LABELLED_ROWS = 12_000
ROUNDS, ROUND_STEPS = 3, 4
# A view hands over every row of which it is sure by this probability.
CONFIDENT = 0.95
# How much the rows that were handed over count against the labelled ones.
POOL_SHARE = 0.5
# Rows of a batch, and the steps in which gradients are counted.
BATCH, GRID = 256, 1 << 24

# Words count only if they go with the label this much (chi-square of one degree of freedom): others would be learned by
# heart, and the few that matter would drown among them.
LEAST_CHI2 = 25.0

_TOKEN = re.compile(r"\w+|[^\w\s]+")


def text_features(text: str) -> np.ndarray:
    """Content view: hashes of the different words and runs of symbols, in lower case."""
    tokens = set(_TOKEN.findall(text.lower()))
    found = np.fromiter((zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in tokens), np.int64, len(tokens))
    return np.unique(found & (TEXT_BUCKETS - 1))


def meta_features(text: str, lang: str | None, source: str | None) -> np.ndarray:
    """Metadata view: source and language, and the form of the page - lengths, lines, case, symbols - never its words."""
    size = max(1, len(text))
    words = text.split()
    letters = sum(map(str.isalpha, text))
    lines = text.count("\n") + 1
    shares = {
        "letters": letters / size,
        "upper": sum(map(str.isupper, text)) / max(1, letters),
        "digits": sum(map(str.isdigit, text)) / size,
        "other": (size - letters - len(words)) / size,
        "different": len(set(words)) / max(1, len(words)),
    }
    names = [f"source={source}", f"lang={lang}", f"size={int(np.log2(size))}", f"line={int(np.log2(size / lines))}"]
    names.append(f"word={min(20, size // max(1, len(words)))}")
    names += [f"{name}={int(20 * share)}" for name, share in shares.items()]
    return np.unique([zlib.crc32(name.encode("utf-8", "surrogatepass")) & (META_BUCKETS - 1) for name in names])


@dataclass
class Sparse:
    """Rows of present features."""

    indices: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, rows: list[np.ndarray]) -> Sparse:
        starts = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int64)
        return cls(np.concatenate(rows).astype(np.int64) if rows else np.empty(0, np.int64), starts)

    def __len__(self) -> int:
        return len(self.starts) - 1

    def take(self, rows: np.ndarray) -> Sparse:
        return Sparse.of([self.indices[self.starts[r] : self.starts[r + 1]] for r in rows.tolist()])

    def only(self, kept: np.ndarray) -> Sparse:
        """The same rows without the features that are not kept."""
        left = kept[self.indices]
        counts = np.bincount(self.scaled()[0][left], minlength=len(self))
        return Sparse(self.indices[left], np.concatenate(([0], np.cumsum(counts))).astype(np.int64))

    def scaled(self) -> tuple[np.ndarray, np.ndarray]:
        """Row number and value of every entry; rows have length one."""
        counts = np.diff(self.starts)
        return np.repeat(np.arange(len(self)), counts), np.repeat(1 / np.sqrt(np.maximum(counts, 1)), counts)


@dataclass
class Logistic:
    """A linear model, and the line that turns its margins into probabilities."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def margins(self, rows: Sparse) -> np.ndarray:
        row, value = rows.scaled()
        return np.bincount(row, self.weights[rows.indices] * value, minlength=len(rows)) + self.bias

    def logits(self, rows: Sparse) -> np.ndarray:
        return self.slope * self.margins(rows) + self.shift

    def calibrate(self, rows: Sparse, labels: np.ndarray) -> Logistic:
        fitted = fit_line(self.margins(rows)[:, None], labels)
        return Logistic(self.weights, self.bias, float(fitted[0]), float(fitted[1]))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def fit_logistic(rows: Sparse, labels: np.ndarray, buckets: int, seed: int, epochs: int = 8, l2: float = 1e-6) -> Fitted:
    """Logistic regression by adaptive gradient steps over small batches; classes weigh the same."""
    model, squares = Logistic(np.zeros(buckets), 0.0), np.full(buckets + 1, 1e-4)
    if len(rows) == 0 or labels.min() == labels.max():
        model.bias = 0.0 if len(rows) == 0 else 3.0 * (2 * float(labels[0]) - 1)
        return Fitted(model, squares)
    weight = np.where(labels > 0.5, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    random = np.random.default_rng(seed)
    for _ in range(epochs):
        order = random.permutation(len(rows))
        for start in range(0, len(order), BATCH):
            chosen = order[start : start + BATCH]
            batch = rows.take(chosen)
            row, value = batch.scaled()
            error = (sigmoid(model.margins(batch)) - labels[chosen]) * weight[chosen]
            touched, place = np.unique(batch.indices, return_inverse=True)
            gradient = np.bincount(place, error[row] * value, minlength=len(touched)) + l2 * model.weights[touched]
            squares[touched] += gradient**2
            model.weights[touched] -= gradient / np.sqrt(squares[touched])
            squares[-1] += error.sum() ** 2
            model.bias -= error.sum() / np.sqrt(squares[-1])
    return Fitted(model, squares)


def fit_line(inputs: np.ndarray, labels: np.ndarray, steps: int = 50, ridge: float = 1e-2) -> np.ndarray:
    """Coefficients of a logistic regression on few dense inputs, the constant last, by Newton's method."""
    if len(labels) == 0:
        return np.append(np.ones(inputs.shape[1]), 0.0)
    design = np.hstack([inputs, np.ones((len(inputs), 1))])
    beta = np.zeros(design.shape[1])
    for _ in range(steps):
        p = sigmoid(design @ beta)
        hessian = (design * (p * (1 - p) + 1e-9)[:, None]).T @ design + ridge * np.eye(len(beta))
        step = np.linalg.solve(hessian, design.T @ (labels - p) - ridge * beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return beta


def telling(rows: Sparse, labels: np.ndarray, buckets: int, least: float = LEAST_CHI2) -> np.ndarray:
    """Which features go with the label."""
    with_both = np.bincount(rows.indices, labels[rows.scaled()[0]], minlength=buckets)
    present = np.bincount(rows.indices, minlength=buckets).astype(np.float64)
    n, positive = len(labels), labels.sum()
    gap = with_both * (n - positive) - (present - with_both) * positive
    return gap**2 * n > least * present * (n - present) * positive * (n - positive)


@dataclass
class CoTrained:
    """Two calibrated views, the words that count, and how the logits are combined."""

    kept: np.ndarray
    text: Logistic
    meta: Logistic
    mix: np.ndarray

    def score(self, text: Sparse, meta: Sparse) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of the class by the content, by the metadata, and by both."""
        views = np.stack([self.text.logits(text.only(self.kept)), self.meta.logits(meta)], axis=1).clip(-30, 30)
        return sigmoid(views[:, 0]), sigmoid(views[:, 1]), sigmoid(views @ self.mix[:2] + self.mix[2])


@dataclass
class Fitted:
    """A view while it is trained: its linear model, and the squares of gradients seen so far, the constant's last."""

    model: Logistic
    squares: np.ndarray

    def step(self, gradient: np.ndarray) -> None:
        """One adaptive step along the gradient, the constant's last."""
        self.squares += gradient**2
        change = gradient / np.sqrt(self.squares)
        self.model = Logistic(self.model.weights - change[:-1], self.model.bias - change[-1])


def gradient_sums(rows: Sparse, model: Logistic, labels: np.ndarray) -> np.ndarray:
    """Sums over rows of the gradient of the loss: one line for each class, whose last two entries are the constant's and the number
    of rows. They are whole numbers of ``1 / GRID``, so they add up to the same in any order."""
    row, value = rows.scaled()
    error = sigmoid(model.margins(rows)) - labels
    parts = np.rint(error[row] * value * GRID)
    sums = np.zeros((2, len(model.weights) + 2), dtype=np.int64)
    for label in (0, 1):
        told = labels == label
        sums[label, :-2] = np.bincount(rows.indices, parts * told[row], minlength=len(model.weights)).astype(np.int64)
        sums[label, -2:] = np.rint(error[told] * GRID).sum(), told.sum()
    return sums


def mean_gradient(sums: np.ndarray) -> np.ndarray:
    """Gradient in which classes weigh the same, as of a batch of ``BATCH`` rows. A class without rows adds nothing."""
    means = sums[:, :-1] / GRID / np.maximum(sums[:, -1:], 1)
    return means.sum(axis=0) * BATCH / 2


def pool_sums(pool: tuple[Sparse, Sparse], teachers: list[Logistic], students: list[Logistic]) -> list[np.ndarray]:
    """For each view the gradient sums over the pool rows that the other view, as it was when the round began, is sure of."""
    sums = []
    for view in range(2):
        logits = teachers[1 - view].logits(pool[1 - view])
        sure = np.flatnonzero(np.abs(logits) >= np.log(CONFIDENT / (1 - CONFIDENT)))
        sums.append(gradient_sums(pool[view].take(sure), students[view], (logits[sure] > 0).astype(np.float64)))
    return sums


class CoTraining:
    """Co-training of two views for one label.

    Both views are fitted on labelled rows first. In every round each view labels all pool rows that it is sure of for the other,
    and the views are trained on by steps along a gradient of which ``POOL_SHARE`` comes from these rows and the rest from the
    labelled ones, however many there are of either. The rows that are ``aside`` calibrate the views and weigh them.
    """

    def __init__(self, views: tuple[Sparse, Sparse], labels: np.ndarray, aside: np.ndarray, words: np.ndarray, seed: int = 42):
        fitted, kept = np.flatnonzero(~aside), np.flatnonzero(aside)
        views = (views[0].only(words), views[1])
        self.words, self.labels, self.told = words, labels[fitted], labels[kept]
        self.known = [view.take(fitted) for view in views]
        self.aside = [view.take(kept) for view in views]
        self.views = [
            fit_logistic(rows, self.labels, buckets, seed)
            for rows, buckets in zip(self.known, (TEXT_BUCKETS, META_BUCKETS), strict=True)
        ]
        # A label without rows of both classes has nothing to teach.
        self.open = len(self.labels) > 0 and self.labels.min() != self.labels.max()
        self.begin_round()

    def calibrated(self) -> list[Logistic]:
        return [side.model.calibrate(rows, self.told) for side, rows in zip(self.views, self.aside, strict=True)]

    def begin_round(self) -> None:
        self.teachers = self.calibrated()

    def students(self) -> list[Logistic]:
        return [side.model for side in self.views]

    def step(self, sums: list[np.ndarray]) -> None:
        """Train both views on by a step, given the sums over the pool."""
        if not self.open:
            return
        for side, rows, pool in zip(self.views, self.known, sums, strict=True):
            own = mean_gradient(gradient_sums(rows, side.model, self.labels))
            share = POOL_SHARE if pool[:, -1].all() else 0.0
            side.step((1 - share) * own + share * mean_gradient(pool))

    def result(self) -> CoTrained:
        text, meta = self.calibrated()
        logits = np.stack([text.logits(self.aside[0]), meta.logits(self.aside[1])], axis=1).clip(-30, 30)
        return CoTrained(self.words, text, meta, fit_line(logits, self.told))


def co_train(
    views: tuple[Sparse, Sparse], labels: np.ndarray, pool: tuple[Sparse, Sparse], seed: int = 42, rounds: int = ROUNDS
) -> CoTrained:
    """Co-train on rows at hand, a fifth of which are kept for calibration: what :func:`fit_all` does over tables."""
    aside = np.random.default_rng(seed).random(len(labels)) < 0.2
    if len(labels) and (aside.all() or not aside.any()):
        aside[:] = np.arange(len(labels)) % 5 == 0
    words = telling(views[0].take(np.flatnonzero(~aside)), labels[~aside], TEXT_BUCKETS)
    training = CoTraining(views, labels, aside, words, seed)
    pool = (pool[0].only(words), pool[1])
    for _ in range(rounds):
        training.begin_round()
        for _ in range(ROUND_STEPS):
            training.step(pool_sums(pool, training.teachers, training.students()))
    return training.result()


def _views_of(texts: pa.Array, langs: pa.Array, sources: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for text, lang, source in zip(texts, langs, sources, strict=True):
        whole = text.as_py() or ""
        yield text_features(whole), meta_features(whole, lang.as_py(), source.as_py())


def _sparse(lists: pa.ListArray) -> Sparse:
    return Sparse(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), _starts(lists))


def _starts(lists: pa.ListArray) -> np.ndarray:
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return offsets - offsets[0]


def _lists(rows: Sparse) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(rows.starts, pa.int32()), pa.array(rows.indices, pa.int32()))


def _featured(docs: DataFrame, kept: np.ndarray | None = None, ids: bool = False) -> DataFrame:
    """``words`` and ``form`` of every row - of the words, those that are ``kept``. With ``ids`` an id comes from a task once."""
    shared = docs.sparkSession.sparkContext.broadcast(kept)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                if ids:
                    given = batch.column("_id").to_pylist()
                    fresh = [not (i in seen or seen.add(i)) for i in given]
                    batch = batch.filter(pa.array(fresh, pa.bool_()))
                if batch.num_rows == 0:
                    continue
                words, form = zip(*_views_of(batch.column("text"), batch.column("lang"), batch.column("source")), strict=True)
                words, form = Sparse.of(list(words)), Sparse.of(list(form))
                if shared.value is not None:
                    words = words.only(shared.value)
                out = {name: batch.column(name) for name in carried}
                yield pa.record_batch(out | {"words": _lists(words), "form": _lists(form)})

    carried = [name for name in docs.columns if name not in ("text", "lang", "source")]
    schema = T.StructType([docs.schema[name] for name in carried])
    for name in ("words", "form"):
        schema = schema.add(name, T.ArrayType(T.IntegerType()))
    return docs.mapInArrow(features, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Labelled rows that are never learned from: a fifth, by id. A NULL id is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def _drawn(name: str) -> Column:
    return F.pmod(F.xxhash64("_id", F.lit(name)), F.lit(1 << 20))


def _labelled(docs: DataFrame, labels: DataFrame, targets: Sequence[str], doc_id: str, rows: int) -> DataFrame:
    """Features and labels of about ``rows`` labelled documents, one row for each id.

    An id is joined to one of its texts, that with the least hash. A task gives the features of an id once, so an id with very
    many rows is many rows in no place.
    """
    told = labels.filter(~held_out(doc_id)).groupBy(F.col(doc_id).alias("_id"))
    known = staged(told.agg(*[F.min(name).cast("double").alias(f"_label{n}") for n, name in enumerate(targets)]), "labels")
    share = min(1.0, rows / max(1, known.count()))
    chosen = known.filter(_drawn("label") < int(share * (1 << 20))).withColumn("_aside", F.pmod(F.xxhash64("_id"), F.lit(5)) == 0)
    given = docs.select(F.col(doc_id).alias("_doc"), F.xxhash64("text", "lang", "source").alias("_hash"), "text", "lang", "source")
    picked = given.join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).groupBy("_id").agg(F.min("_hash").alias("_least"))
    picked = staged(chosen.join(picked, "_id"), "chosen")
    found = given.join(F.broadcast(picked), (F.col("_doc") == F.col("_id")) & (F.col("_hash") == F.col("_least")))
    found = found.drop("_doc", "_hash", "_least")
    return staged(_featured(found, ids=True).dropDuplicates(["_id"]), "labelled")


def _telling(rows: DataFrame, label: str) -> np.ndarray:
    """Which words go with the label, by counts made in tasks."""
    told = rows.filter(F.col(label).isNotNull() & ~F.col("_aside"))
    n, positive = told.agg(F.count("*"), F.coalesce(F.sum(label), F.lit(0.0))).first()
    counts = told.select(F.explode("words").alias("word"), F.col(label).alias("label")).groupBy("word")
    counts = counts.agg(F.count("*").cast("double").alias("present"), F.sum("label").alias("both"))
    gap = F.col("both") * (n - positive) - (F.col("present") - F.col("both")) * positive
    bound = LEAST_CHI2 * F.col("present") * (n - F.col("present")) * positive * (n - positive)
    kept = np.zeros(TEXT_BUCKETS, dtype=bool)
    kept[[row.word for row in counts.filter(gap**2 * n > bound).select("word").collect()]] = True
    return kept


def _start(rows: DataFrame, label: str, words: np.ndarray) -> CoTraining:
    """The labelled rows, of which only words that count come to the driver."""
    shared = rows.sparkSession.sparkContext.broadcast(words)

    def only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            few = _lists(_sparse(batch.column("words")).only(shared.value))
            yield pa.record_batch({name: batch.column(name) for name in ("label", "aside", "form")} | {"words": few})

    told = rows.filter(F.col(label).isNotNull()).select("_id", F.col(label).alias("label"), F.col("_aside").alias("aside"), "words", "form")
    # The rows arrive in any order; sorted by their id, a rerun fits the same model.
    table = told.orderBy("_id").drop("_id").mapInArrow(only, "label double, aside boolean, form array<int>, words array<int>").toArrow()
    sides = [Sparse.of([np.asarray(x, dtype=np.int64) for x in table[name].to_pylist()]) for name in ("words", "form")]
    labels = np.asarray(table["label"].to_numpy(), dtype=np.float64)
    return CoTraining((sides[0], sides[1]), labels, np.asarray(table["aside"].to_numpy()).astype(bool), words)


def _pool_sums(pool: DataFrame, trainings: Sequence[CoTraining]) -> list[list[np.ndarray]]:
    """:func:`pool_sums` over all rows of the pool for every label in one job; what tasks and driver hold is bounded by the buckets."""
    shared = pool.sparkSession.sparkContext.broadcast([(t.words, t.teachers, t.students()) for t in trainings])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = None
        for batch in batches:
            words, form = _sparse(batch.column("words")), _sparse(batch.column("form"))
            found = [s for kept, *models in shared.value for s in pool_sums((words.only(kept), form), *models)]
            totals = found if totals is None else [a + b for a, b in zip(totals, found, strict=True)]
        for part, total in enumerate(totals or []):
            label, place = np.nonzero(total)
            columns = [np.full(len(label), part), label, place, total[label, place]]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["part", "label", "place", "sum"])

    found = pool.mapInArrow(sums, "part long, label long, place long, sum long").groupBy("part", "label", "place")
    table = found.agg(F.sum("sum").alias("sum")).toArrow()
    out = [np.zeros((2, size + 2), dtype=np.int64) for _ in trainings for size in (TEXT_BUCKETS, META_BUCKETS)]
    part, label, place, total = (np.asarray(table[name].to_numpy()) for name in ("part", "label", "place", "sum"))
    for number, into in enumerate(out):
        mine = part == number
        into[label[mine], place[mine]] = total[mine]
    shared.unpersist()
    return [out[n : n + 2] for n in range(0, len(out), 2)]


def fit_all(
    docs: DataFrame,
    labels: DataFrame,
    targets: Sequence[str],
    labelled_rows: int = LABELLED_ROWS,
    rounds: int = ROUNDS,
    doc_id: str = "doc_id",
) -> dict[str, CoTrained]:
    """Co-train a classifier for each label on about ``labelled_rows`` labelled documents and on all unlabelled ones.

    ``docs`` has ``text``, ``lang`` and ``source``; other columns are not read. Labels of held-out rows, NULL ones and those of
    unknown documents are not used; of several labels of a document the smallest counts, of several texts of a labelled id that
    with the least hash. Repeated unlabelled rows count as often as they occur, a NULL id is unlabelled, NULL and empty texts have
    no words. Empty tables give a model whose scores are constant.

    The driver holds the labelled rows, as words that count, and sums over the pool, whose size is that of the buckets. The
    features of the pool are written once; each step reads them and sends back one sum for each feature. Sums are of whole
    numbers, so reruns and other partitions fit the same model.
    """
    ship_package(docs.sparkSession)
    rows = _labelled(docs, labels, targets, doc_id, labelled_rows)
    names = [f"_label{n}" for n in range(len(targets))]
    trainings = [_start(rows, name, _telling(rows, name)) for name in names]
    listed = labels.select(F.col(doc_id).alias("_listed")).distinct()
    given = docs.select(F.col(doc_id).alias("_id"), "text", "lang", "source")
    pool = None
    if rounds and any(t.open for t in trainings):
        # Features before the join: should the labels be too many to be sent to every task, no text is shuffled for them.
        features = _featured(given, np.logical_or.reduce([t.words for t in trainings]))
        pool = staged(features.join(listed, F.col("_id") == F.col("_listed"), "left_anti").select("words", "form"), "pool")
    for _ in range(rounds if pool is not None else 0):
        for training in trainings:
            training.begin_round()
        for _ in range(ROUND_STEPS):
            for training, sums in zip(trainings, _pool_sums(pool, trainings), strict=True):
                training.step(sums)
    return {target: training.result() for target, training in zip(targets, trainings, strict=True)}


def fit(docs: DataFrame, labels: DataFrame, target: str, **options) -> CoTrained:
    """:func:`fit_all` for one label."""
    return fit_all(docs, labels, [target], **options)[target]


def score(docs: DataFrame, models: dict[str, CoTrained], text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Add ``<target>_text``, ``<target>_meta`` and ``<target>_score`` for each model: probabilities by either view and both.
    Existing columns of these names are replaced.

    Every row is scored by its whole text; NULL and empty texts have no words and are scored by what is left.
    """
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(models)
    names = [f"{target}_{view}" for target in models for view in ("text", "meta", "score")]
    schema = T.StructType([T.StructField(name, T.DoubleType()) for name in names])

    @F.arrow_udf(schema)
    def probabilities(texts: pa.Array, langs: pa.Array, sources: pa.Array) -> pa.Array:
        out: list[list[np.ndarray]] = [[] for _ in names]
        for start in range(0, len(texts), 1024):
            part = (column.slice(start, 1024) for column in (texts, langs, sources))
            words, form = zip(*_views_of(*part), strict=True)
            scored = [p for model in shared.value.values() for p in model.score(Sparse.of(list(words)), Sparse.of(list(form)))]
            for column, values in zip(out, scored, strict=True):
                column.append(values)
        return pa.StructArray.from_arrays([pa.array(np.concatenate(c) if c else np.empty(0)) for c in out], names)

    given = docs.withColumn("_llm_scores", probabilities(F.col(text), F.col(lang).cast("string"), F.col(source).cast("string")))
    rest = [name for name in docs.columns if name not in names]
    return given.select(*named(rest), *[F.col(f"_llm_scores.{name}").alias(name) for name in names])


def classify(
    docs: DataFrame, labels: DataFrame, targets: tuple[str, ...] = ("quality", "toxic"), doc_id: str = "doc_id", **options
) -> DataFrame:
    """Fit a classifier per label column and score every row of ``docs``. Without labels of both classes scores are constant."""
    return score(docs, fit_all(docs, labels, targets, doc_id=doc_id, **options))
