"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package
from .common import named

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
SMOOTHING = 0.5

# The classifier is fitted on about so many labelled rows of each language, chosen by a hash of their ids.
TRAINING_ROWS = 4000
# More languages than this are refused: the matrix of log probabilities is sent to every task.
MAX_LANGUAGES = 1000

# N-grams count as independent evidence up to this many; longer texts are not more certain than that.
EVIDENCE = 60
UNDETERMINED = "und"
# A language less likely than this is no identification.
LEAST_SCORE = 0.5

_CHARACTERS_AT_ONCE = 1 << 18


@cache
def _letters() -> np.ndarray:
    """For every character of the basic plane its lower case if it is a letter, else a space."""
    table = np.full(1 << 16, 32, dtype=np.uint32)
    for code in range(1 << 16):
        if chr(code).isalpha():
            table[code] = ord(chr(code).lower()[0])
    return table


def _codes(text: str) -> np.ndarray:
    """Letters in lower case between single spaces, as numbers; it begins and ends with a space."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    basic = codes < 1 << 16
    codes = np.where(basic, _letters()[np.where(basic, codes, 0)], codes)
    codes = np.concatenate(([32], codes, [32])).astype(np.uint32)
    space = codes == 32
    return codes[~(space & np.concatenate(([False], space[:-1])))]


def _grams(codes: np.ndarray, starts: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of one order that lie inside a text, and where they end. ``starts`` is each place's text start."""
    if len(codes) < order:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    value = np.zeros(len(codes) - order + 1, dtype=np.uint64)
    for shift in range(order):
        value = (value + codes[shift : len(codes) - order + 1 + shift]) * np.uint64(0x9E3779B97F4A7C15)
        value ^= value >> np.uint64(29)
    ends = np.arange(order - 1, len(codes))
    inside = ends - starts[order - 1 :] >= order - 1
    return ((value * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(48)).astype(np.int64)[inside] & (BUCKETS - 1), ends[inside]


def _chunks(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Texts as bounded pieces ``(codes, start of the text for each place, text number for each place)``.

    A long text is cut into pieces that overlap by what the longest n-gram needs.
    """
    codes, rows, size = [], [], 0
    step, overlap = _CHARACTERS_AT_ONCE, max(ORDERS) - 1

    def packed():
        lengths = np.array([len(c) for c in codes])
        begin = np.repeat(np.cumsum(lengths) - lengths, lengths)
        return np.concatenate(codes), begin, np.repeat(np.array(rows), lengths)

    for row, text in enumerate(texts):
        if not text:
            continue
        whole = _codes(text)
        for start in range(0, len(whole), step):
            # Only the first piece has n-grams shorter than the longest that end in the overlap; see _scores.
            piece = whole[max(0, start - overlap) : start + step]
            codes.append(piece)
            rows.append(row if start == 0 else -row - 1)
            size += len(piece)
            if size >= step:
                yield packed()
                codes, rows, size = [], [], 0
    if codes:
        yield packed()


def gram_buckets(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(text number, bucket)`` of every n-gram, in bounded arrays."""
    overlap = max(ORDERS) - 1
    for codes, begin, rows in _chunks(texts):
        for order in ORDERS:
            buckets, ends = _grams(codes, begin, order)
            row, begun = rows[ends], begin[ends]
            # A later piece repeats the end of the one before: n-grams that end there were counted already.
            fresh = (row >= 0) | (ends - begun >= overlap)
            row = np.where(row < 0, -row - 1, row)
            yield row[fresh], buckets[fresh]


@dataclass
class LanguageModel:
    """Log probabilities of the buckets, one column per language, and of the languages."""

    languages: list[str]
    buckets: np.ndarray
    priors: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Number of the most likely language of each text, and its probability."""
        totals = np.zeros((len(texts), len(self.languages)))
        seen = np.zeros(len(texts), dtype=np.int64)
        width = max(1, (4 << 20) // max(1, len(self.languages)))
        for rows, buckets in gram_buckets(texts):
            for start in range(0, len(rows), width):
                row, values = rows[start : start + width], self.buckets[buckets[start : start + width]]
                first = np.flatnonzero(np.diff(row, prepend=-1))
                np.add.at(totals, row[first], np.add.reduceat(values, first, axis=0, dtype=np.float64))
                np.add.at(seen, row[first], np.diff(np.append(first, len(row))))
        tempered = totals * np.minimum(1.0, EVIDENCE / np.maximum(seen, 1))[:, None] + self.priors
        tempered -= tempered.max(axis=1, keepdims=True)
        probability = np.exp(tempered)
        probability /= probability.sum(axis=1, keepdims=True)
        best = probability.argmax(axis=1)
        return best, probability[np.arange(len(texts)), best]


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that are never learned from. A NULL id is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        languages = batch.column(0).to_pylist()
        texts = batch.column(1).to_pylist()
        numbers = {language: n for n, language in enumerate(dict.fromkeys(languages))}
        number = np.array([numbers[language] for language in languages])
        for rows, buckets in gram_buckets(texts):
            for language, n in numbers.items():
                own = counts.setdefault(language, np.zeros(BUCKETS, dtype=np.int64))
                own += np.bincount(buckets[number[rows] == n], minlength=BUCKETS)
    for language, own in counts.items():
        used = np.flatnonzero(own)
        yield pa.record_batch(
            {"lang": pa.array([language] * len(used), pa.string()), "bucket": pa.array(used), "n": pa.array(own[used])}
        )


def fit(
    docs: DataFrame,
    training_rows: int = TRAINING_ROWS,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
) -> LanguageModel:
    """Learn from the rows with text and language that are not held out: all of them, or about ``training_rows`` each.

    Tasks count n-grams and send counts per bucket; the driver gets a table of languages x buckets.
    """
    ship_package(docs.sparkSession)
    usable = docs.filter(~held_out(doc_id) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = {r[0]: r[1] for r in usable.groupBy(lang).count().limit(MAX_LANGUAGES + 1).collect()}
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(rows)
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    draw = F.pmod(F.xxhash64(F.col(doc_id), F.lit("language")), F.lit(1 << 20))
    share = F.create_map(*[F.lit(v) for k in languages for v in (k, int(min(1.0, training_rows / rows[k]) * (1 << 20)))])
    chosen = usable.filter(draw < share[F.col(lang)]).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts = chosen.mapInArrow(_count_grams, "lang string, bucket long, n long")
    table = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    matrix = np.zeros((BUCKETS, len(languages)))
    place = {language: n for n, language in enumerate(languages)}
    column = np.array([place[x] for x in table["lang"].to_pylist()], dtype=np.int64)
    matrix[np.asarray(table["bucket"]).astype(np.int64), column] = np.asarray(table["n"])
    matrix = np.log(matrix + SMOOTHING) - np.log(matrix.sum(axis=0) + SMOOTHING * BUCKETS)
    known = np.array([rows[language] for language in languages], dtype=np.float64)
    return LanguageModel(languages, matrix.astype(np.float32), np.log(known / known.sum()))


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", into: str = "language") -> DataFrame:
    """Add a struct ``(lang, score)``. NULL, a text without a letter, or a model of no language: ``und`` with score 0."""
    spark = docs.sparkSession
    ship_package(spark)
    if not model.languages:
        return docs.withColumn(into, F.struct(F.lit(UNDETERMINED).alias("lang"), F.lit(0.0).alias("score")))
    shared = spark.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])

    @F.arrow_udf(schema)
    def predict(texts: pa.Array) -> pa.Array:
        names = pa.array(shared.value.languages)
        best, score = [], []
        for start in range(0, len(texts), 512):
            numbers, scores = shared.value.predict(texts.slice(start, 512).to_pylist())
            best.append(numbers)
            score.append(scores)
        chosen = np.concatenate(best) if best else np.empty(0, np.int64)
        return pa.StructArray.from_arrays(
            [names.take(pa.array(chosen)), pa.array(np.concatenate(score) if score else np.empty(0))], ["lang", "score"]
        )

    wordless = F.coalesce(~F.col(text).rlike(r"\p{L}"), F.lit(True))
    unknown = F.struct(F.lit(UNDETERMINED).alias("lang"), F.lit(0.0).alias("score"))
    return docs.withColumn(into, predict(F.col(text))).withColumn(into, F.when(wordless, unknown).otherwise(F.col(into)))


def language_id(
    docs: DataFrame,
    training_rows: int = TRAINING_ROWS,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    into: str = "language",
) -> DataFrame:
    """Fit on the labelled rows of ``docs`` and add ``language`` (or a column named ``into``, replacing any such) to all of them; see :func:`fit` and :func:`identify`.

    Repeated rows get equal results; very long texts are read whole, in pieces; an empty table gives an empty result.
    """
    model = fit(docs, training_rows, doc_id, text, lang)
    return identify(docs, model, text, into)


def keep_identified(docs: DataFrame, least_score: float = LEAST_SCORE, **options) -> DataFrame:
    """The rows of ``docs`` whose language could be told with at least this score, with their columns."""
    found = language_id(docs, into="_llm_language", **options)
    told = (F.col("_llm_language.lang") != UNDETERMINED) & (F.col("_llm_language.score") >= least_score)
    return found.filter(told).select(*named(docs.columns))
