"""Scoring texts with a language model that is trained on the corpus: causal self-attention over subwords."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from . import attention
from .common import LOWER_BYTES, staged

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: pieces that byte pairs are merged in - letters, digits or symbols, with one space before them.
PIECES = r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"

# What is predicted first is a class: frequent subwords are classes of their own; the others share the rest of the classes.
CLASSES, SHARED = 256, 24
# Words per block: the unit in which texts and counts meet. A longer text is a block of its own.
BLOCK_WORDS = 1 << 21
# The model is trained on all training texts, in runs of so many words; each run belongs to one of the rounds.
RUN_WORDS, ROUNDS = 40, 3
# A task with few runs - under about a megabyte of text - goes over all of them again until it has made so many steps in a round.
LEAST_STEPS = 200
# Tokens of a block that are scored at a time, and words that are split at a time.
SLICE_TOKENS, SPLIT_ROWS = 1 << 18, 512
# Runs that are laid into windows at a time.
RUNS_AT_ONCE = 1 << 11
# How much the attention model counts against the share of the word among all training words.
ATTENTION_SHARE = 0.65

# Fixed value: the byte table that lower-cases A-Z and makes a space of the other white space between words.
_PLAIN = LOWER_BYTES.translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b" " * 5))
_DOCS, _WORDS, _SUBWORDS = 0, 1, 2
_ENCODED = (
    "kind int, block bigint, doc_ids array<bigint>, held array<boolean>, draws array<int>, lengths array<int>, codes binary, "
    "sizes binary, pieces binary, idx int, word string, n bigint"
)
_ARROW = pa.schema(
    [
        ("kind", pa.int32()), ("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())),
        ("draws", pa.list_(pa.int32())), ("lengths", pa.list_(pa.int32())), ("codes", pa.binary()), ("sizes", pa.binary()),
        ("pieces", pa.binary()), ("idx", pa.int32()), ("word", pa.string()), ("n", pa.int64()),
    ]
)


@cache
def _tokenizer(content: bytes) -> tiktoken.Encoding:
    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines())}
    return tiktoken.Encoding("subwords", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


def held_out(doc_id: str = "doc_id") -> Column:
    """Texts that nothing is learned from. A NULL id is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 10 == 0, F.lit(False))


def _rows(count: int, **columns: pa.Array) -> pa.RecordBatch:
    given = [columns[f.name] if f.name in columns else pa.nulls(count, f.type) for f in _ARROW]
    return pa.record_batch(given, schema=_ARROW)


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts end to end, in lower case, and how many each text has."""
    own = texts.take(pa.array(np.arange(len(texts)))).fill_null("").cast(pa.large_string())
    _, offsets, data = own.buffers()
    plain = pa.py_buffer((data.to_pybytes() if data else b"").translate(_PLAIN))
    split = pc.split_pattern(pa.Array.from_buffers(own.type, len(own), [None, offsets, plain], offset=own.offset), " ")
    words = split.flatten()
    there = np.asarray(pc.not_equal(pc.binary_length(words), 0))
    counts = np.bincount(np.asarray(pc.list_parent_indices(split))[there], minlength=len(texts))
    return words.filter(pa.array(there)), counts


def _packed(numbers: np.ndarray) -> bytes:
    """Compressed byte by byte of the numbers: the high bytes are nearly all zero."""
    planes = np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, numbers.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpacked(packed: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind)[:, 0]


def _stretches(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all stretches, end to end."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _block(
    number: int,
    ids: list,
    held: list[bool],
    draws: list[int],
    lengths: np.ndarray,
    words: pa.ChunkedArray,
    encoding: tiktoken.Encoding,
    heard: np.ndarray,
) -> Iterator[pa.RecordBatch]:
    """A block of texts as one row of word numbers and the subwords of its different words, and a row for each of these words.

    The subwords of training texts are counted in ``heard``. The first row's ``n`` is the number of training texts.
    """
    coded = words.combine_chunks().dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    codes, spoken = np.asarray(coded.indices), coded.dictionary
    by_use = np.argsort(-np.bincount(codes, minlength=len(spoken)), kind="stable")
    place = np.empty(len(spoken), dtype=np.uint32)
    place[by_use] = np.arange(len(spoken), dtype=np.uint32)
    codes = place[codes]
    counts = np.bincount(codes[np.repeat(~np.array(held, dtype=bool), lengths)], minlength=len(spoken))
    spoken = spoken.take(pa.array(by_use)).cast(pa.string())
    pieces = [encoding.encode_ordinary(" " + word) for word in spoken.to_pylist()]
    sizes = np.fromiter(map(len, pieces), np.uint32, len(pieces))
    subwords = np.fromiter(chain.from_iterable(pieces), np.uint16, int(sizes.sum()))
    # Sums of whole numbers below 2**53 are exact.
    heard += np.bincount(subwords, np.repeat(counts, sizes), len(heard)).astype(np.int64)
    yield _rows(
        1,
        kind=pa.array([_DOCS], pa.int32()),
        block=pa.array([number]),
        doc_ids=pa.array([ids], pa.list_(pa.int64())),
        held=pa.array([held], pa.list_(pa.bool_())),
        draws=pa.array([draws], pa.list_(pa.int32())),
        lengths=pa.array([lengths.tolist()], pa.list_(pa.int32())),
        codes=pa.array([_packed(codes)], pa.binary()),
        sizes=pa.array([_packed(sizes)], pa.binary()),
        pieces=pa.array([_packed(subwords)], pa.binary()),
        n=pa.array([len(held) - sum(held)]),
    )
    for start in range(0, len(spoken), 50_000):
        part = spoken.slice(start, 50_000)
        yield _rows(
            len(part),
            kind=pa.array(np.full(len(part), _WORDS, np.int32)),
            block=pa.array(np.full(len(part), number)),
            idx=pa.array(np.arange(start, start + len(part), dtype=np.int32)),
            word=part,
            n=pa.array(counts[start : start + len(part)].astype(np.int64)),
        )


def _encode(batches: Iterator[pa.RecordBatch], tokenizer: bytes, block_words: int) -> Iterator[pa.RecordBatch]:
    """Task body: texts into blocks, and how often the training texts of this task have each subword."""
    encoding = _tokenizer(tokenizer)
    heard = np.zeros(1 << 16, dtype=np.int64)
    ids: list = []
    held: list[bool] = []
    draws: list[int] = []
    lengths: list[np.ndarray] = []
    parts: list[pa.Array] = []
    size = number = 0

    def full() -> Iterator[pa.RecordBatch]:
        block = (TaskContext.get().partitionId() << 24) + number
        return _block(block, ids, held, draws, np.concatenate(lengths), pa.chunked_array(parts, pa.large_string()), encoding, heard)

    for batch in batches:
        for at in range(0, len(batch), SPLIT_ROWS):
            part = batch.slice(at, SPLIT_ROWS)
            words, counts = _split(part.column(1))
            ids += part.column(0).to_pylist()
            held += part.column(2).to_pylist()
            draws += part.column(3).to_pylist()
            lengths.append(counts)
            parts.append(words)
            size += len(words)
            if size >= block_words:
                yield from full()
                ids, held, draws, lengths, parts, size, number = [], [], [], [], [], 0, number + 1
    if ids:
        yield from full()
    used = np.flatnonzero(heard)
    yield _rows(len(used), kind=pa.array(np.full(len(used), _SUBWORDS, np.int32)), idx=pa.array(used.astype(np.int32)), n=pa.array(heard[used]))


@dataclass
class SubwordClasses:
    """The class of every subword, and the log probability of a subword within its class.

    The first ``starts`` classes begin a word (or end the text); 0 is the end. ``prior`` holds the log shares of the classes.
    """

    of: np.ndarray
    within: np.ndarray
    prior: np.ndarray
    starts: int


def subword_classes(counts: np.ndarray, begins: np.ndarray, ends: int, classes: int = CLASSES, shared: int = SHARED) -> SubwordClasses:
    """``counts`` of all subwords in the training texts, which of them begin a word, and the number of texts."""
    own = np.argsort(-counts, kind="stable")[: classes - 1 - shared]
    own = own[counts[own] > 0]
    first, later = own[begins[own]], own[~begins[own]]
    half = shared // 2
    starts = 1 + len(first) + half
    of = np.empty(len(counts), dtype=np.int64)
    by_rank = np.empty(len(counts), dtype=np.int64)
    by_rank[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
    of[:] = np.where(begins, 1 + len(first) + by_rank % half, starts + len(later) + by_rank % half)
    of[first], of[later] = 1 + np.arange(len(first)), starts + np.arange(len(later))
    total = starts + len(later) + half
    # Subwords that were never seen are possible, too.
    softened = counts + 0.5
    sums = np.bincount(of, softened, minlength=total)
    sums[0] = ends + 0.5
    return SubwordClasses(of, np.log(softened / sums[of]).astype(np.float32), np.log(sums / sums.sum()), starts)


@dataclass
class _Runs:
    """Runs of training words: whether each begins (1) and ends (2) its text, its number of subwords, and these end to end."""

    flags: np.ndarray
    sizes: np.ndarray
    subwords: np.ndarray

    def __len__(self) -> int:
        return len(self.flags)


def _runs_of(block: dict[str, pa.Scalar], number: int, rounds: int) -> _Runs:
    """The runs of a block that belong to this round."""
    held, draws, lengths = (np.asarray(block[name].values) for name in ("held", "draws", "lengths"))
    codes, sizes = _unpacked(block["codes"].as_buffer(), np.uint32), _unpacked(block["sizes"].as_buffer(), np.uint32).astype(np.int64)
    pieces = _unpacked(block["pieces"].as_buffer(), np.uint16)
    lengths = lengths.astype(np.int64)
    many = np.where(held, 0, -(-lengths // RUN_WORDS))
    doc, turn = np.repeat(np.arange(len(lengths)), many), _stretches(np.zeros_like(many), many)
    mine = (draws[doc] + turn) % rounds == number
    doc, start = doc[mine], turn[mine] * RUN_WORDS
    count = np.minimum(RUN_WORDS, lengths[doc] - start)
    # A run that begins or ends its text says so.
    flags = (start == 0) + 2 * (start + RUN_WORDS >= lengths[doc])
    words = codes[_stretches((np.cumsum(lengths) - lengths)[doc] + start, count)]
    of_words = sizes[words]
    subwords = pieces[_stretches((np.cumsum(sizes) - sizes)[words], of_words)]
    return _Runs(flags, _sum_parts(of_words, count).astype(np.int64), subwords)


def _windows(runs: _Runs, order: np.ndarray, classes: SubwordClasses, begin: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """What windows over the runs, taken in this order, read and predict; -1 where nothing is."""
    window, lead = attention.WINDOW, attention.CONTEXT
    starts = np.cumsum(runs.sizes) - runs.sizes
    for at in range(0, len(order), RUNS_AT_ONCE):
        some = order[at : at + RUNS_AT_ONCE]
        first, size = runs.flags[some] & 1 == 1, runs.sizes[some]
        length = size + (runs.flags[some] >> 1)
        # As in scoring, a text begins after the context slots and goes on from slot to slot.
        skip = np.where(first, lead, 0)
        room = window - skip
        many = -(-length // room)
        run, place = np.repeat(np.arange(len(some)), length), _stretches(np.zeros_like(length), length)
        slots = (np.cumsum(many) - many)[run] * window + place // room[run] * window + skip[run] + place % room[run]
        spoken = runs.subwords[np.minimum(starts[some][run] + place, len(runs.subwords) - 1)].astype(np.int64)
        target = np.where(place < size[run], classes.of[spoken], 0)
        read = np.empty_like(spoken)
        read[1:] = spoken[:-1]
        opening = place == 0
        # The first token of a run inside a text has no context, so nothing is learned from it.
        read[opening] = np.where(first, begin, -1)
        target[opening] = np.where(first, target[opening], -1)
        inputs, targets = np.full((2, many.sum() * window), -1)
        inputs[slots], targets[slots] = read, target
        yield inputs.reshape(-1, window), targets.reshape(-1, window)


def _train(
    batches: Iterator[pa.RecordBatch], parameters: attention.Parameters, classes: SubwordClasses, seed: int, number: int, rounds: int
) -> Iterator[pa.RecordBatch]:
    """Task body: steps over the runs of this task that belong to a round, from the given parameters.

    Gives rows of the new ones: an embedding weighed by how often its token was read, all others by the steps.
    """
    p = {name: value.copy() for name, value in parameters.items()}
    optimiser = attention.Adam(p)
    begin, size = p["embed"].shape[0] - 1, attention.BATCH_WINDOWS
    random = np.random.default_rng(seed)
    uses = np.zeros(begin + 1)
    rest = np.empty((2, 0, attention.WINDOW), dtype=np.int64)

    def learn(read: np.ndarray, aim: np.ndarray) -> None:
        # Slots without a token read the beginning, which nothing sees.
        there = read >= 0
        inputs = np.where(there, read, begin)
        g, tokens, _ = attention.sparse_gradient(p, inputs, there, np.maximum(aim, 0), aim >= 0, classes.starts)
        often = np.bincount(np.searchsorted(tokens, read[there]), minlength=len(tokens))
        if not often[-1]:
            tokens, often, g["embed"] = tokens[:-1], often[:-1], g["embed"][:-1]
        optimiser.update(g, tokens)
        uses[tokens] += often

    def read_runs(runs: _Runs) -> None:
        nonlocal rest
        for inputs, targets in _windows(runs, random.permutation(len(runs)), classes, begin):
            inputs, targets = np.concatenate([rest[0], inputs]), np.concatenate([rest[1], targets])
            full = len(inputs) // size * size
            for at in range(0, full, size):
                learn(inputs[at : at + size], targets[at : at + size])
            rest = np.stack([inputs[full:], targets[full:]])

    def read_rest() -> None:
        nonlocal rest
        if rest.shape[1]:
            learn(*rest)
        rest = rest[:, :0]

    again: list[_Runs] = []
    for batch in batches:
        for row in range(len(batch)):
            runs = _runs_of({name: batch[name][row] for name in batch.schema.names}, number, rounds)
            read_runs(runs)
            if optimiser.step < LEAST_STEPS:
                again.append(runs)
    read_rest()
    if optimiser.step < LEAST_STEPS and sum(map(len, again)):
        once = _Runs(*(np.concatenate([getattr(runs, name) for runs in again]) for name in ("flags", "sizes", "subwords")))
        while optimiser.step < LEAST_STEPS:
            read_runs(once)
            read_rest()
    if optimiser.step:
        others = _others(p)
        used = np.flatnonzero(uses)
        rows = np.vstack([p["embed"][used] * uses[used, None], others.astype(np.float64) * optimiser.step])
        weights = np.concatenate([uses[used], np.full(len(others), optimiser.step)])
        at = np.concatenate([used, len(uses) + np.arange(len(others))])
        columns = {f"v{n}": pa.array(np.ascontiguousarray(rows[:, n])) for n in range(rows.shape[1])}
        yield pa.record_batch({"at": pa.array(at), "weight": pa.array(weights)} | columns)


def _others(p: attention.Parameters) -> np.ndarray:
    """All parameters but the embeddings, as rows as long as an embedding."""
    flat = np.concatenate([p[name].ravel() for name in sorted(p) if name != "embed"])
    width = p["embed"].shape[1]
    return np.pad(flat, (0, -len(flat) % width)).reshape(-1, width)


def _trained(
    blocks: DataFrame, like: attention.Parameters, classes: SubwordClasses, seed: int, number: int, rounds: int
) -> attention.Parameters:
    """Parameters after a round over the runs that belong to it: the means over all tasks. As many numbers reach the driver as there are."""
    held = blocks.sparkSession.sparkContext.broadcast((like, classes))
    numbers = ["weight", *[f"v{n}" for n in range(like["embed"].shape[1])]]
    given = blocks.mapInArrow(lambda b: _train(b, *held.value, seed + number, number, rounds), ", ".join(["at bigint", *[f"{n} double" for n in numbers]]))
    sums = given.groupBy("at").agg(*[F.sum(name).alias(name) for name in numbers]).toArrow()
    held.unpersist()
    rows = np.vstack([like["embed"], _others(like)])
    if sums.num_rows:
        total = np.stack([np.asarray(sums[name]) for name in numbers], axis=1)
        rows[np.asarray(sums["at"])] = total[:, 1:] / total[:, :1]
    out, at = {"embed": rows[: len(like["embed"])]}, 0
    flat = rows[len(like["embed"]) :].ravel()
    for name in sorted(like):
        if name != "embed":
            out[name] = flat[at : at + like[name].size].reshape(like[name].shape).astype(np.float32)
            at += like[name].size
    return out


@dataclass
class LanguageModel:
    """All that scoring needs besides the counts of words: sizes, classes, parameters."""

    tokens: int
    distinct: int
    ends: int
    classes: SubwordClasses
    parameters: attention.Parameters
    share: float = ATTENTION_SHARE


def _sum_parts(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums over consecutive parts, none of them empty."""
    return np.add.reduceat(values, np.cumsum(lengths) - lengths, dtype=np.float64)


def score_block(
    lengths: np.ndarray, codes: np.ndarray, counts: np.ndarray, sizes: np.ndarray, subwords: np.ndarray, model: LanguageModel
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(known tokens, base score, score)`` of every text of a block; ``codes`` number the words that counts, sizes and subwords list.

    Texts are scored some at a time, so that memory holds little more than the block itself.
    """
    # The end of a text is one word more, numbered last.
    counts = np.append(counts, model.ends)
    subwords = subwords.astype(np.int64)
    piece_classes = np.append(model.classes.of[subwords], 0).astype(np.int16)
    # The end of a text is the last of its tokens and never read.
    pieces_read = np.append(subwords, 0)
    within = np.append(model.classes.within[subwords], np.float32(0))
    word_lengths = np.append(sizes, 1).astype(np.int64)
    word_starts = np.cumsum(word_lengths) - word_lengths
    with np.errstate(divide="ignore"):
        plain = np.log1p(-model.share) + np.log(counts / max(1, model.tokens))
    base = np.log10((counts + 0.1) / (model.tokens + 0.1 * (model.distinct + 1)))
    known, plainly, modelled = (np.empty(len(lengths)) for _ in range(3))
    ends = np.cumsum(lengths)
    row = 0
    while row < len(lengths):
        begin = ends[row] - lengths[row]
        stop = max(row + 1, int(np.searchsorted(ends, begin + SLICE_TOKENS, side="right")))
        some, spoken = lengths[row:stop], codes[begin : ends[stop - 1]]
        tokens = some + 1
        ended = np.full(len(spoken) + len(some), len(sizes), dtype=np.int64)
        ended[np.arange(len(spoken)) + np.repeat(np.arange(len(some)), some)] = spoken
        size = word_lengths[ended]
        starts = np.cumsum(size) - size
        where = _stretches(word_starts[ended], size)
        sequence = piece_classes[where].astype(np.int64)
        long = _sum_parts(size, tokens).astype(np.int64)
        chosen, begun = attention.score_texts(model.parameters, sequence, long, model.classes.starts, read=pieces_read[where])
        chosen += within[where]
        # A word is its subwords, given that a word begins, and then that another one begins (or the text ends).
        spelled = np.add.reduceat(chosen, starts, dtype=np.float64) - begun[starts]
        following = np.append(begun[starts[1:]], 0.0)
        following[np.cumsum(tokens) - 1] = 0.0
        word = np.logaddexp(np.log(model.share) + spelled + following, plain[ended])
        known[row:stop] = _sum_parts(counts[ended] > 0, tokens)
        plainly[row:stop] = _sum_parts(base[ended], tokens)
        modelled[row:stop] = _sum_parts(word, tokens) / np.log(10)
        row = stop
    return known, plainly, modelled


def lm_scores(
    docs: DataFrame,
    tokenizer: str = TOKENIZER,
    rounds: int = ROUNDS,
    block_words: int = BLOCK_WORDS,
    seed: int = 42,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of every row, scored over its whole text.

    Tokens are the words of a text and its end. ``base_score`` comes from counts of the training words alone. ``score`` is
    the log10 probability by the model: each word is a mixture of its share among the training words and of its subwords,
    predicted one by one from those before it.

    Texts are encoded once, in blocks, each with its different words and their subwords. Words are counted over all training
    texts by a shuffle of these words, and only the counts are brought back to the blocks. The attention model starts
    from the shares of the subword classes and reads every word of all training texts: runs of words are dealt to ``rounds``
    rounds, in which every task trains on the runs of its blocks; in between the parameters are averaged.

    NULL and empty texts consist of the end alone; repeated rows get equal results; an empty table gives an empty result;
    without training texts all counts are 0.
    """
    spark = docs.sparkSession
    ship_package(spark)
    with open(tokenizer, "rb") as file:
        content = file.read()
    vocabulary = spark.sparkContext.broadcast(content)
    given = docs.select(
        F.col(doc_id).cast("bigint"), F.col(text), held_out(doc_id), F.pmod(F.xxhash64(F.col(doc_id), F.lit(seed)), F.lit(rounds)).cast("int")
    ).toDF("doc_id", "text", "held", "draw")
    encoded = staged(given.mapInArrow(lambda b: _encode(b, vocabulary.value, block_words), _ENCODED), "encoded", "zstd")
    blocks, words = encoded.filter(F.col("kind") == _DOCS), encoded.filter(F.col("kind") == _WORDS)
    # A block has a word once, so of the blocks with a word one is the first.
    same = Window.partitionBy("word")
    counted = staged(
        words.select("block", "idx", F.sum("n").over(same).alias("c"), (F.min("block").over(same) == F.col("block")).alias("first")),
        "counted",
        "zstd",
    )
    total = F.coalesce(F.sum("n"), F.lit(0))
    ends = int(blocks.agg(total).first()[0])
    spoken = int(words.agg(total).first()[0])
    distinct = counted.filter(F.col("first") & (F.col("c") > 0)).count() + (ends > 0)
    tokens = spoken + ends
    sums = encoded.filter(F.col("kind") == _SUBWORDS).groupBy(F.col("idx").alias("subword")).agg(F.sum("n").alias("n")).toArrow()
    encoding = _tokenizer(content)
    size = encoding.n_vocab
    counts = np.zeros(size, dtype=np.int64)
    counts[np.asarray(sums["subword"]).astype(np.int64)] = np.asarray(sums["n"])
    begins = np.zeros(size, dtype=bool)
    for token in encoding.token_byte_values():
        begins[encoding.encode_single_token(token)] = token.startswith(b" ")
    classes = subword_classes(counts, begins, ends)
    parameters = attention.initial(len(classes.prior), classes.prior, classes.starts, seed, vocabulary=size)
    training = blocks.select("held", "draws", "lengths", "codes", "sizes", "pieces")
    for number in range(rounds):
        parameters = _trained(training, parameters, classes, seed, number, rounds)
    model = spark.sparkContext.broadcast(LanguageModel(tokens, distinct, ends, classes, parameters))

    def score(key: tuple, texts: pa.Table, listed: pa.Table) -> pa.Table:
        row = texts.slice(0, 1).to_pylist()[0]
        lengths = np.array(row["lengths"], dtype=np.int64)
        codes, sizes = (_unpacked(row[name], np.uint32) for name in ("codes", "sizes"))
        counts = np.empty(len(sizes), dtype=np.int64)
        counts[np.asarray(listed["idx"])] = np.asarray(listed["c"])
        known, base, total = score_block(lengths, codes, counts, sizes, _unpacked(row["pieces"], np.uint16), model.value)
        return pa.table(
            {
                "doc_id": pa.array(row["doc_ids"], pa.int64()),
                "held_out": pa.array(row["held"], pa.bool_()),
                "n_tokens": pa.array(lengths + 1),
                "n_known": pa.array(known.astype(np.int64)),
                "base_score": pa.array(base),
                "score": pa.array(total),
            }
        )

    texts = blocks.select("block", "doc_ids", "held", "lengths", "codes", "sizes", "pieces")
    listed = counted.select(F.col("block").alias("of_block"), "idx", "c")
    scored = (
        texts.groupBy("block")
        .cogroup(listed.groupBy("of_block"))
        .applyInArrow(score, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    )
    return scored.withColumn("train_tokens", F.lit(tokens).cast("bigint"))
