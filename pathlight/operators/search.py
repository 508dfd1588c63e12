"""Vector search by cosine distance: one query, many queries, free SQL."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import is_blank, register_functions, vector_literal
from ..session import ship_package

# Hits per search, the SQL a search runs when none is given, and the name of the searched table.
DEFAULT_K = 10
INDEX_VIEW = "code_chunks"
DEFAULT_SQL = """
SELECT file_path, cosine_distance(embedding, :embedding) AS distance
FROM code_chunks
ORDER BY distance ASC NULLS LAST, file_path
LIMIT 10
"""

# Distances closer than this are ties and are ordered by key, so that the last bit of a sum never decides.
TIE_DIGITS = 9

# Queries up to this size are sent to every task; beyond it queries and index meet in blocks instead.
MAX_BROADCAST_BYTES = 32 << 20
# Sizes of one block on either side (as doubles): either side is copied once per block of the other, so blocks are as
# large as a task easily holds. A block of queries has its hits and their order beside it, so it is the smaller one.
INDEX_BLOCK_BYTES = 32 << 20
QUERY_BLOCK_BYTES = 16 << 20

_FIRST_QUERIES = 1000

# Upper bound for the elements of one distance matrix inside a task (doubles).
_MATRIX_ELEMENTS = 2 << 20
_MERGE_PARTS = 32


def hit_order(key: str = "file_path", distance: str = "distance") -> list[Column]:
    """Nearest first, then by key. NaN sorts after every number and NULL after NaN."""
    return [F.round(distance, TIE_DIGITS).asc_nulls_last(), F.col(key).asc()]


def top_k_search(
    index: DataFrame, vector: Sequence[float], k: int = DEFAULT_K, key: str = "file_path", embedding: str = "embedding"
) -> DataFrame:
    """The ``k`` rows nearest to one vector: ``(key, distance)``.

    Every task scans its part of the index as matrix products and keeps ``k`` rows; those are merged by a top-k node.
    """
    units, _ = unit_rows(np.asarray([vector], dtype=np.float64))
    schema = T.StructType(
        [
            T.StructField("query_id", T.IntegerType()),
            T.StructField("key", index.schema[key].dataType),
            T.StructField("distance", T.DoubleType()),
        ]
    )
    hits = scan_with(index.select(key, embedding), QueryBlock(pa.array([0], pa.int32()), units), schema, k)
    return hits.select(F.col("key").alias(key), "distance").orderBy(*hit_order(key)).limit(k)


def ranked_hits(hits: DataFrame, key: str = "file_path") -> DataFrame:
    """Number the hits of one search from 1 and add ``line``, e.g. ``1. src/a.py (distance: 0.1234)``.

    ``hits`` is the short list a search returned, so the single window partition holds ``k`` rows.
    """
    ranked = hits.withColumn("rank", F.row_number().over(Window.orderBy(*hit_order(key))))
    return ranked.withColumn("line", hit_line(F.col("rank"), F.col(key), F.col("distance")))


def hit_line(rank: Column, key: Column, distance: Column) -> Column:
    return F.format_string("%d. %s (distance: %.4f)", rank, key, distance)


def split_queries(queries: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Queries with text, and rejected ones (NULL or blank)."""
    blank = F.coalesce(is_blank(text), F.lit(True))
    return queries.filter(~blank), queries.filter(blank)


# --- many queries ---------------------------------------------------------------------------------------------------


@dataclass
class QueryBlock:
    """Queries as a matrix of unit rows (zero rows stay zero), and their ids.

    With ``cells`` a query is compared only with index rows of the cells it probes: ``cells.get(c)`` lists its rows. Hits farther than
    ``limit`` are of no use to a query.
    """

    ids: pa.Array
    units: np.ndarray
    cells: Mapping[int, np.ndarray] | Probing | None = None
    limit: np.ndarray | None = None


class Probing(Protocol):
    """Tells which queries of a block probe a cell, when it is asked for it."""

    def get(self, cell: int) -> np.ndarray | None: ...


def vector_matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """A list column as an ``n x dim`` matrix, and which rows were NULL (their matrix row is zero)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    missing = np.asarray(column.is_null())
    lengths = np.asarray(column.value_lengths().fill_null(dim))
    if (lengths != dim).any():
        raise ValueError(f"different vector dimensions: {sorted(set(lengths.tolist()))} and {dim}")
    matrix = np.zeros((len(column), dim))
    matrix[~missing] = np.asarray(column.flatten(), dtype=np.float64).reshape(int((~missing).sum()), dim)
    return matrix, missing


def unit_rows(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled to length one, and which rows have no direction: zeros, and rows with NaN or infinite elements.

    The latter become zeros as well, so that no comparison ever meets a NaN.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    without = (norms == 0) | ~np.isfinite(norms)
    units = matrix / np.where(without, 1.0, norms)[:, None]
    units[without] = 0.0
    return units, without


def matrix_parts(rows: int, columns: int) -> Iterator[slice]:
    """Slices of the rows of a matrix, so that each part has a bounded number of elements."""
    step = max(1, _MATRIX_ELEMENTS // max(1, columns))
    return (slice(start, start + step) for start in range(0, rows, step))


def _distance(similarity: np.ndarray) -> np.ndarray:
    return np.clip(1.0 - similarity, 0.0, 2.0)


def _order(distance: np.ndarray) -> np.ndarray:
    return distance.round(TIE_DIGITS)


class _Nearest:
    """The ``k`` best hits seen so far for each query of a block."""

    def __init__(self, block: QueryBlock, k: int) -> None:
        self.block = block
        self.k = k
        self.zero_query = ~block.units.any(axis=1)
        self.zero_queries = int(self.zero_query.sum())
        self.limit = np.full(len(block.ids), np.inf) if block.limit is None else block.limit.copy()
        # Undefined distances are the same for all queries, so they are kept once: those of all rows to queries without a
        # direction, and those of rows without a direction to all others.
        self.shared: dict[bool, pa.Table] = {}
        self.best: pa.Table | None = None
        self.pending: list[pa.Table] = []
        self.pending_rows = 0

    def add(self, keys: pa.Array, units: np.ndarray, zero: np.ndarray, missing: np.ndarray, rows: np.ndarray) -> None:
        """Compare index rows with the queries at positions ``rows``, a bounded part of the matrix at a time."""
        if len(keys) == 0:
            return
        special = np.flatnonzero(zero | missing)
        plain = np.flatnonzero(~(zero | missing)) if len(special) else None
        zeros = int(self.zero_query[rows].sum())
        if len(special) and len(rows) - zeros == len(self.limit) - self.zero_queries:
            self._share(False, keys.take(pa.array(special)), missing[special])
            special = special[:0]
        if zeros and zeros == self.zero_queries:
            self._share(True, keys, missing)
            rows = rows[~self.zero_query[rows]]
        for bounds in matrix_parts(len(rows), len(keys)):
            part = rows[bounds]
            without = self.zero_query[part]
            asked = part[~without] if without.any() else part
            if plain is None:
                self._add_numbers(keys, units, asked)
            elif len(plain):
                self._add_numbers(keys.take(pa.array(plain)), units[plain], asked)
            # Distances that are not numbers come last: they count while a query has fewer than k numbers.
            if len(special):
                self._add_rest(keys.take(pa.array(special)), missing[special], asked[self.limit[asked] >= 3.0])
            if without.any():
                self._add_rest(keys, missing, part[without])

    def _add_numbers(self, keys: pa.Array, units: np.ndarray, rows: np.ndarray) -> None:
        if len(rows) == 0:
            return
        similarity = self.block.units[rows] @ units.T
        limit = self.limit[rows]
        if len(keys) >= self.k and (unlimited := limit > 2.0).any():
            kth = np.partition(similarity[unlimited], len(keys) - self.k, axis=1)[:, len(keys) - self.k]
            limit[unlimited] = _order(_distance(kth))
            self.limit[rows] = limit
        # A little slack, since limits are rounded; the exact comparison follows for the few that remain.
        query, row = np.nonzero(similarity >= (1.0 - limit - 10.0**-TIE_DIGITS)[:, None])
        distance = _distance(similarity[query, row])
        order = _order(distance)
        near = order <= limit[query]
        self._keep(rows[query[near]], order[near], keys.take(pa.array(row[near])), pa.array(distance[near]))

    def _add_rest(self, keys: pa.Array, missing: np.ndarray, rows: np.ndarray) -> None:
        """Undefined distances: NaN, or NULL for a missing vector. All rows rank alike, so the first keys win."""
        if len(rows) == 0:
            return
        self._keep_rest(self._first(pa.table({"o": np.where(missing, 4.0, 3.0), "key": keys})), rows)

    def _first(self, rest: pa.Table) -> pa.Table:
        first = pc.sort_indices(rest, sort_keys=[("o", "ascending"), ("key", "ascending")])[: self.k]
        return rest.take(first).combine_chunks()

    def _share(self, all_rows: bool, keys: pa.Array, missing: np.ndarray) -> None:
        rest = pa.table({"o": np.where(missing, 4.0, 3.0), "key": keys})
        self.shared[all_rows] = self._first(pa.concat_tables([self.shared[all_rows], rest]) if all_rows in self.shared else rest)

    def _keep_rest(self, rest: pa.Table, rows: np.ndarray) -> None:
        order, keys = np.asarray(rest["o"]), rest["key"].combine_chunks()
        distance = pa.array(np.full(len(order), np.nan), mask=order == 4.0)
        step = max(1, _MATRIX_ELEMENTS // max(1, len(order)))
        for start in range(0, len(rows), step):
            part = rows[start : start + step]
            many = np.tile(np.arange(len(order)), len(part))
            self._keep(np.repeat(part, len(order)), order[many], keys.take(pa.array(many)), distance.take(pa.array(many)))

    def _keep(self, query: np.ndarray, order: np.ndarray, keys: pa.Array, distance: pa.Array) -> None:
        if len(query) == 0:
            return
        self.pending.append(pa.table({"q": pa.array(query, pa.int32()), "o": order, "key": keys, "d": distance}))
        self.pending_rows += len(query)
        if self.pending_rows > max(200_000, 2 * self.k * len(self.limit)):
            self._prune()

    def _prune(self) -> None:
        tables = ([self.best] if self.best is not None else []) + self.pending
        if not tables:
            return
        merged = pa.concat_tables(tables).sort_by([("q", "ascending"), ("o", "ascending"), ("key", "ascending")])
        query = np.asarray(merged["q"])
        first = np.searchsorted(query, query, side="left")
        self.best = merged.filter(pa.array(np.arange(len(query)) - first < self.k)).combine_chunks()
        self.pending, self.pending_rows = [], 0
        query, order = np.asarray(self.best["q"]), np.asarray(self.best["o"])
        last = np.flatnonzero(np.diff(query, append=-1))
        full = last[last - np.searchsorted(query, query[last], side="left") == self.k - 1]
        self.limit[query[full]] = np.minimum(self.limit[query[full]], order[full])

    def result(self) -> Iterator[pa.RecordBatch]:
        self._prune()
        if True in self.shared:
            self._keep_rest(self.shared[True], np.flatnonzero(self.zero_query))
        if False in self.shared:
            self._keep_rest(self.shared[False], np.flatnonzero(~self.zero_query & (self.limit >= 3.0)))
        self._prune()
        if self.best is None:
            return
        hits = pa.table(
            {
                "query_id": self.block.ids.take(self.best["q"].combine_chunks()),
                "key": self.best["key"],
                "distance": self.best["d"],
            }
        )
        yield from hits.to_batches(max_chunksize=20_000)


def _scan_block(batches, block: QueryBlock, k: int) -> Iterator[pa.RecordBatch]:
    """Task body: run over a part of the index once and give at most ``k`` hits per query.

    Columns of the index are key, vector and, where cells are searched, the cell.
    """
    if len(block.ids) == 0:
        return
    nearest = _Nearest(block, k)
    everything = np.arange(len(block.ids))
    for batch in batches:
        matrix, missing = vector_matrix(batch.column(1), block.units.shape[1])
        units, zero = unit_rows(matrix)
        if block.cells is None:
            nearest.add(batch.column(0), units, zero, missing, everything)
            continue
        cell = np.asarray(batch.column(2))
        for value in np.unique(cell):
            probing = block.cells.get(int(value))
            if probing is not None:
                chosen = np.flatnonzero(cell == value)
                keys = batch.column(0).take(pa.array(chosen))
                nearest.add(keys, units[chosen], zero[chosen], missing[chosen], probing)
    yield from nearest.result()


def collect_queries(queries: DataFrame, query_id: str, embedding: str, max_bytes: int) -> pa.Table | None:
    """Ids and vectors of the queries, or None when there are more than fit into ``max_bytes``.

    A first fetch of a few queries is mostly all there is; it also tells their length, and so how many fit. No more
    than one row beyond that is fetched. ``queries`` holds no NULL vectors.
    """
    rows = queries.select(query_id, embedding)
    table = rows.limit(_FIRST_QUERIES + 1).toArrow()
    if table.num_rows == 0:
        return table
    most = max(1, max_bytes // (8 * max(1, len(table.column(1)[0]))))
    if table.num_rows > _FIRST_QUERIES and most > _FIRST_QUERIES:
        table = rows.limit(most + 1).toArrow()
    return table if table.num_rows <= most else None


def query_block(table: pa.Table) -> QueryBlock:
    ids = table.column(0).combine_chunks()
    vectors = table.column(1).combine_chunks()
    lengths = vectors.value_lengths().drop_null()
    matrix, _ = vector_matrix(vectors, lengths[0].as_py() if len(lengths) else 0)
    return QueryBlock(ids, unit_rows(matrix)[0])


def hit_schema(queries: DataFrame, index: DataFrame, query_id: str, key: str) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_id", queries.schema[query_id].dataType),
            T.StructField("key", index.schema[key].dataType),
            T.StructField("distance", T.DoubleType()),
        ]
    )


def merge_hits(hits: DataFrame, k: int, key: str) -> DataFrame:
    """Best ``k`` of the partial lists of each query, with ``rank`` from 1.

    A query gets up to ``k`` hits from every task, so the lists are first merged in parts and then per query: no task
    sorts the hits of all tasks for one query.
    """
    part = F.pmod(F.spark_partition_id(), F.lit(_MERGE_PARTS))
    order = hit_order("key")
    by_part = Window.partitionBy("query_id", "part").orderBy(*order)
    by_query = Window.partitionBy("query_id").orderBy(*order)
    return (
        hits.withColumn("part", part)
        .withColumn("rank", F.row_number().over(by_part))
        .filter(F.col("rank") <= k)
        .withColumn("rank", F.row_number().over(by_query))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", F.col("key").alias(key), "distance")
    )


def batch_search(
    queries: DataFrame,
    index: DataFrame,
    k: int = DEFAULT_K,
    query_id: str = "query_id",
    key: str = "file_path",
    embedding: str = "embedding",
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
    block_rows: int | None = None,
) -> DataFrame:
    """Exact ``k`` nearest index rows of every query: ``(query_id, rank, key, distance)``.

    A query whose vector is NULL has no hits.

    Queries up to ``max_broadcast_bytes`` go to every task; the index is scanned once, in place, as matrix products per
    Arrow batch. More queries than that meet the index in blocks of bounded size (:func:`block_search`), which are cut by
    direction: a query is not compared with a block - of about ``block_rows`` rows - that cannot hold a nearer row than its k-th
    hit in the nearest block (:func:`~pathlight.operators.ann.search_by_bounds`).
    """
    queries = queries.filter(F.col(embedding).isNotNull())
    table = collect_queries(queries, query_id, embedding, max_broadcast_bytes)
    rows = index.select(key, embedding)
    schema = hit_schema(queries, index, query_id, key)
    if table is None:
        from .ann import search_by_bounds

        first = queries.select(F.size(embedding)).first()
        by_size = max(1, INDEX_BLOCK_BYTES // (8 * max(1, first[0] if first else 1)))
        found = search_by_bounds(queries, index, k, query_id, key, embedding, block_rows or by_size)
        if found is not None:
            return found
        return block_search(
            queries.select(F.col(query_id).alias("query_id"), F.col(embedding).alias("vector"), F.lit(0).alias("cell")),
            rows.select(F.col(key).alias("key"), F.col(embedding).alias("vector"), F.lit(0).alias("cell")),
            schema,
            k,
            key,
        )
    return merge_hits(scan_with(rows, query_block(table), schema, k), k, key)


def scan_with(rows: DataFrame, block: QueryBlock, schema: T.StructType, k: int) -> DataFrame:
    ship_package(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(block)
    return rows.mapInArrow(lambda batches: _scan_block(batches, shared.value, k), schema)


def block_search(
    queries: DataFrame,
    index: DataFrame,
    schema: T.StructType,
    k: int,
    key: str,
    index_block: int | None = None,
    query_block_rows: int | None = None,
    probing: Callable[[QueryBlock, pa.Table], QueryBlock] | None = None,
) -> DataFrame:
    """Exact search for query sets of any size: ``queries(query_id, vector, cell)`` x ``index(key, vector, cell)``.

    Both sides of a cell are cut into blocks of bounded size by hash, however many rows the cell holds. One task
    compares one block of queries with one block of the index and gives ``k`` hits per query, so neither a hot cell nor
    a large query set can fill a task, and pairs are never emitted. The table of block counts has one row per cell.

    With ``probing`` the cells are divided further: the index has a column ``part``, and ``probing`` gives a block of queries, made from
    a table with all columns of ``queries``, the parts that each of them is compared with.
    """
    ship_package(index.sparkSession)
    if index_block is None or query_block_rows is None:
        first = queries.select(F.size("vector")).first()
        row_bytes = 8 * max(1, first[0] if first else 1)
        index_block = index_block or max(1, INDEX_BLOCK_BYTES // row_bytes)
        query_block_rows = query_block_rows or max(1, QUERY_BLOCK_BYTES // row_bytes)

    def blocks(side: DataFrame, name: str, rows: int) -> DataFrame:
        needed = F.ceil(F.count("*") / F.lit(rows)).cast("int")
        return side.groupBy("cell").agg(needed.alias(name))

    sizes = blocks(index, "index_blocks", index_block).join(blocks(queries, "query_blocks", query_block_rows), "cell")

    def placed(side: DataFrame, id_column: str, own: str, other: str) -> DataFrame:
        mine = F.pmod(F.xxhash64(id_column), F.col(own)).cast("int")
        copies = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        return side.join(F.broadcast(sizes), "cell").withColumn("mine", mine).withColumn("theirs", copies)

    own = [name for name in queries.columns if name != "cell"] if probing else ["query_id", "vector"]
    compared = ["key", "vector", "part"] if probing else ["key", "vector"]
    left = placed(queries, "query_id", "query_blocks", "index_blocks").select(
        "cell", F.col("mine").alias("qb"), F.col("theirs").alias("ib"), *own
    )
    right = placed(index, "key", "index_blocks", "query_blocks").select(
        "cell", F.col("theirs").alias("qb"), F.col("mine").alias("ib"), *compared
    )

    target = pa.schema([("query_id", _arrow(schema, 0)), ("key", _arrow(schema, 1)), ("distance", pa.float64())])

    def compare(some_queries: pa.Table, some_rows: pa.Table) -> pa.Table:
        if some_queries.num_rows == 0 or some_rows.num_rows == 0:
            return target.empty_table()
        block = query_block(some_queries.select(["query_id", "vector"]))
        some_rows = some_rows.select(compared)
        if probing:
            block, some_rows = probing(block, some_queries), some_rows.sort_by("part")
        found = list(_scan_block(some_rows.to_batches(max_chunksize=4096), block, k))
        return pa.Table.from_batches(found) if found else target.empty_table()

    keys = ["cell", "qb", "ib"]
    hits = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, schema)
    return merge_hits(hits, k, key)


def _arrow(schema: T.StructType, position: int) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(schema[position].dataType)


# --- text and SQL ---------------------------------------------------------------------------------------------------


def encode_query(spark: SparkSession, text: str, embedder: Callable[..., DataFrame]) -> list[float]:
    """The vector of one query text, by the same embedder as the index."""
    if not text:
        raise ValueError("query text is required")
    row = spark.createDataFrame([(text,)], "text string")
    vector = embedder(row, "text", "embedding").first()["embedding"]
    if vector is None:
        raise ValueError("the query text could not be embedded")
    return [float(value) for value in vector]


def search_text(
    index: DataFrame, text: str, embedder: Callable[..., DataFrame], k: int = DEFAULT_K, key: str = "file_path"
) -> DataFrame:
    """Embed a query text and return its ranked hits."""
    return ranked_hits(top_k_search(index, encode_query(index.sparkSession, text, embedder), k, key), key)


_PARAMETER = re.compile(r":embedding\b")


def sql_search(
    index: DataFrame,
    sql: str = DEFAULT_SQL,
    embedding: Sequence[float] | None = None,
    query_text: str = "",
    embedder: Callable[..., DataFrame] | None = None,
    view: str = INDEX_VIEW,
) -> DataFrame:
    """Run any Spark SQL over the index, which it sees as ``code_chunks``.

    If the text mentions ``:embedding``, the query vector is bound to it: ``embedding``, or ``query_text`` run through
    ``embedder``; having neither is an error. Without it nothing is embedded.
    """
    spark = index.sparkSession
    register_functions(spark)
    index.createOrReplaceTempView(view)
    if not _PARAMETER.search(sql):
        return spark.sql(sql)
    if embedding is None:
        if not query_text or embedder is None:
            raise ValueError("query text must be provided when the SQL uses :embedding")
        embedding = encode_query(spark, query_text, embedder)
    return spark.sql(sql, args={"embedding": vector_literal(embedding)})
