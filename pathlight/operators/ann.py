"""Approximate nearest neighbours: the index is divided into cells, and a query looks only into those that can matter.

A cell has a centre and a radius, the largest angle between the centre and a row. No row of a cell is nearer to a query than
the angle to the centre less the radius. A search probes the nearest cells first and then every cell whose bound
lies below the k-th hit found so far. Taken as it is, the bound gives the exact answer. In many dimensions hardly any
row lies where the bound allows it, so a search that asks for a recall below 1 takes a share of the radius only; which
share gives which recall is measured when the cells are built, by exact searches.
"""
from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import l2_norm
from ..session import scratch_dir, ship_package
from .search import (
    DEFAULT_K,
    INDEX_BLOCK_BYTES,
    MAX_BROADCAST_BYTES,
    TIE_DIGITS,
    QueryBlock,
    block_search,
    collect_queries,
    hit_schema,
    matrix_parts,
    merge_hits,
    query_block,
    scan_with,
    unit_rows,
    vector_matrix,
)

DEFAULT_CELLS = 256
# Cells that every query looks into before bounds are compared with hits.
FIRST_PROBES = 4
# The share of the true neighbours that a search shall find unless it asks for another one.
DEFAULT_RECALL = 0.95
# Rows whose true neighbours are searched when cells are built, to learn which share of the radius gives which recall.
CALIBRATION_ROWS = 200

# Blocks by direction into which an exact search of very many queries cuts the index at most, and rows their centres are fitted on.
MOST_BLOCKS = 4096
BLOCK_TRAINING_ROWS = 100_000

# The cell of rows without a direction. Every search looks into it, as they count while a query has too few neighbours.
NO_DIRECTION = -1

# A share of the radius at which no cell but the first ones is looked into.
FAR = 1000.0
ROWS_PER_FILE = 500_000

# Cells should be fitted anew once so large a part of the rows has come later, or later rows lie so much farther from their centres.
LATER_SHARE = 0.5
LATER_ANGLE = 1.2

_CENTRES = "cell int, centre array<double>, lowest double, rows bigint, angles double"


@dataclass
class CellIndex:
    """Index rows with their ``cell``, and what is known of every cell.

    ``centres`` are unit vectors, ``lowest`` the least similarity of a row to its centre (NaN for an empty cell), ``counts`` the
    rows and ``angles`` the sum of their angles to the centre. ``needs`` are the shares of the radius at which the true neighbours
    of the calibration rows are found (it may be negative), sorted. Rows without a direction - missing, zero or not finite vectors - are in the
    cell :data:`NO_DIRECTION`.
    """

    rows: DataFrame
    centres: np.ndarray
    embedding: str = field(default="embedding")
    lowest: np.ndarray | None = None
    counts: np.ndarray | None = None
    angles: np.ndarray | None = None
    needs: np.ndarray | None = None

    def radius_share(self, recall: float) -> float:
        """Which share of the radius finds this part of the neighbours; 1 for all of them, or if it was not measured."""
        if recall >= 1 or self.needs is None or not len(self.needs):
            return 1.0
        # A quarter of the way from the wanted recall to 1 is a margin for queries that are not like the calibration rows.
        return float(np.quantile(self.needs, recall + (1 - recall) / 4, method="higher"))

    def near(self, units: np.ndarray, probes: int) -> np.ndarray:
        """For each unit row which cells are its ``probes`` nearest ones that hold rows."""
        chosen = np.zeros((len(units), len(self.centres)), bool)
        for part in matrix_parts(*chosen.shape):
            angle = self._angles(units[part])
            angle[:, ~self._held()] = np.inf
            order = np.argsort(angle, axis=1, kind="stable")[:, :probes]
            np.put_along_axis(chosen[part], order, True, axis=1)
            chosen[part] &= np.isfinite(angle)
        return chosen

    def within(self, units: np.ndarray, kth: np.ndarray, share: float) -> np.ndarray:
        """For each unit row which cells may hold a row nearer than its k-th hit; NaN stands for too few hits, and for all cells."""
        reach, radius = _reach(kth), self._radius()
        chosen = np.zeros((len(units), len(self.centres)), bool)
        for part in matrix_parts(*chosen.shape):
            chosen[part] = (self._angles(units[part]) - share * radius < reach[part, None]) & self._held()
        return chosen

    def groups(self, most: int) -> np.ndarray:
        """For each cell the number of its group: cells that follow each other in the direction in which centres differ most, with
        about ``most`` rows together or a single cell."""
        if self.counts is None:
            return np.arange(len(self.centres), dtype=np.int32)
        apart = self.centres - self.centres.mean(axis=0)
        order = np.argsort(apart @ np.linalg.eigh(apart.T @ apart)[1][:, -1], kind="stable")
        rows = self.counts[order]
        number = np.empty(len(order), np.int32)
        number[order] = (np.cumsum(rows) - rows) // most
        return number

    def _radius(self) -> np.ndarray:
        return np.arccos(np.clip(np.nan_to_num(self._lowest(), nan=1.0) - 10.0**-TIE_DIGITS, -1, 1))

    def _angles(self, units: np.ndarray) -> np.ndarray:
        if not len(self.centres) or not len(units):
            return np.zeros((len(units), len(self.centres)))
        return np.arccos(np.clip(units @ self.centres.T, -1, 1))

    def _lowest(self) -> np.ndarray:
        return np.full(len(self.centres), -1.0) if self.lowest is None else self.lowest

    def _held(self) -> np.ndarray:
        return np.ones(len(self.centres), bool) if self.counts is None else self.counts > 0

    def write(self, path: str, rows_per_file: int = ROWS_PER_FILE, version: int = 0) -> None:
        """Save as Parquet with one folder per cell, so that a search opens only the folders it probes.

        A large cell is written by several tasks, in proportion to its rows. ``version`` is that of the index they were built
        from. Changes appended to older cells are gone.
        """
        placed = _dealt(self.rows, self.embedding, rows_per_file)
        placed.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy("cell").parquet(f"{path}/rows")
        self.rows.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{path}/schema")
        spark = self.rows.sparkSession
        # Through Arrow, as lists of rows would be made by Python workers of their own.
        spark.createDataFrame(self._described()).write.mode("overwrite").parquet(f"{path}/centres")
        needs = pa.table({"need": pa.array([] if self.needs is None else self.needs, pa.float64())})
        spark.createDataFrame(needs).coalesce(1).write.mode("overwrite").parquet(f"{path}/needs")
        built = T.StructType.fromDDL(f"{_CENTRES}, delta int, version bigint")
        spark.createDataFrame(pa.Table.from_pylist([{"rows": 0, "angles": 0.0, "version": version}], to_arrow_schema(built))).coalesce(1).write.mode("overwrite").parquet(f"{path}/later")

    def _described(self) -> pa.Table:
        none = np.zeros(len(self.centres))
        counts, angles = (none if known is None else known for known in (self.counts, self.angles))
        return pa.table(
            {
                "cell": pa.array(range(len(self.centres)), pa.int32()),
                "centre": pa.array(self.centres.tolist(), pa.list_(pa.float64())),
                "lowest": pa.array(self._lowest(), pa.float64()),
                "rows": pa.array(counts.astype(np.int64)),
                "angles": pa.array(angles, pa.float64()),
            }
        )

    @classmethod
    def read(cls, spark: SparkSession, path: str, embedding: str = "embedding", key: str = "file_path") -> CellIndex:
        """The cells as written, with all changes appended since.

        A changed row replaces the one with its key: the rows as built meet the changed keys in a left-anti join; changes
        are chosen by key and number alone, so that only vectors of probed cells are read.
        """
        described = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()
        schema = spark.read.parquet(f"{path}/schema").schema
        rows = spark.read.schema(schema).parquet(f"{path}/rows").select(*schema.fieldNames())
        later = spark.read.parquet(f"{path}/later").collect()
        column = lambda name, source: np.array([row[name] for row in source], dtype=np.float64)
        lowest, counts, angles = column("lowest", described), column("rows", described), column("angles", described)
        for row in later:
            cell = row["cell"]
            if cell is not None and cell >= 0:
                lowest[cell] = np.fmin(lowest[cell], row["lowest"])
                counts[cell] += row["rows"]
                angles[cell] += row["angles"]
        needs = np.sort(column("need", spark.read.parquet(f"{path}/needs").collect()))
        deltas = sorted({row["delta"] for row in later if row["delta"] is not None})
        if deltas:
            stored = T.StructType([*schema.fields, T.StructField("_deleted", T.BooleanType()), T.StructField("delta", T.IntegerType())])
            reader = spark.read.schema(stored).option("basePath", f"{path}/deltas")
            changed = reader.parquet(*[f"{path}/deltas/delta={n}" for n in deltas])
            last = changed.groupBy(key).agg(F.max("delta").alias("delta"))
            live = changed.join(last, [key, "delta"], "left_semi").filter(~F.col("_deleted")).select(*rows.columns)
            rows = rows.join(last.select(key), key, "left_anti").select(*rows.columns).unionByName(live)
        centres = np.array([row["centre"] for row in described], dtype=np.float64) if described else np.zeros((0, 0))
        return cls(rows, centres, embedding, lowest, counts, angles, needs)


def _reach(kth: np.ndarray) -> np.ndarray:
    """The angle within which a row is nearer than the k-th hit, or as near: a little wider, as distances that agree in TIE_DIGITS
    digits are equal. NaN stands for too few hits."""
    reach = np.arccos(np.clip(1 - kth - 2 * 10.0**-TIE_DIGITS, -1, 1))
    reach[np.isnan(kth)] = np.inf
    return reach


def _dealt(rows: DataFrame, embedding: str, rows_per_file: int) -> DataFrame:
    """Rows with all of a cell in one task, or in several by their number."""
    sizes = rows.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(rows_per_file)).cast("int").alias("_files"))
    # Never by the vector: many rows may have the same.
    others = [name for name in rows.columns if name not in (embedding, "cell")]
    part = F.pmod(F.xxhash64(*others), F.col("_files"))
    placed = rows.join(F.broadcast(sizes), "cell").withColumn("_part", part)
    return placed.repartition("cell", "_part").drop("_files", "_part")


def build_cells(
    index: DataFrame,
    cells: int = DEFAULT_CELLS,
    embedding: str = "embedding",
    seed: int = 42,
    iterations: int = 10,
    training_rows: int | None = None,
    k: int = DEFAULT_K,
    calibration_rows: int = CALIBRATION_ROWS,
) -> CellIndex:
    """Cluster the directions of the vectors and give every row its nearest cell.

    Centres are fitted on all vectors that have a direction; a caller who asks for it gets them fitted on about
    ``training_rows`` of them. Every row of the index gets a cell, in one pass without a shuffle; radii are taken over all rows.
    The neighbours of ``calibration_rows`` rows are searched exactly, once, to learn how far a search has to go for a recall.
    Only ``cells`` x dimension numbers, these rows and their hits reach the driver. Without a vector that has a direction
    there are no cells, and all rows are in :data:`NO_DIRECTION`.
    """
    ship_package(index.sparkSession)
    norm = l2_norm(embedding)
    fitted_on = index.filter(F.col(embedding).isNotNull() & (norm > 0) & ~F.isnan(norm) & (norm < float("inf")))
    if not fitted_on.limit(1).count():
        return CellIndex(index.withColumn("cell", F.lit(NO_DIRECTION)), np.zeros((0, 0)), embedding)
    if training_rows is not None:
        fitted_on = fitted_on.sample(min(1.0, training_rows / max(1, fitted_on.count())), seed)
    model = KMeans(
        k=cells, seed=seed, maxIter=iterations, distanceMeasure="cosine", initMode="random", featuresCol="vector"
    ).fit(fitted_on.select(array_to_vector(F.col(embedding).cast("array<double>")).alias("vector")))
    centres, _ = unit_rows(np.array(model.clusterCenters()))
    # Through explode, so that a filter by cell is not pushed below and the cell computed by a second worker of the same task.
    placed = index.withColumn("_cell", _nearest_cell(centres)(embedding))
    found = CellIndex(placed.select(*[F.col(f"`{name}`") for name in index.columns], F.explode(F.array("_cell")).alias("cell")), centres, embedding)
    lowest, counts, angles = np.full(len(centres), np.nan), np.zeros(len(centres)), np.zeros(len(centres))
    for row in _spread(index, centres, embedding).collect():
        if row["cell"] != NO_DIRECTION:
            lowest[row["cell"]], counts[row["cell"]], angles[row["cell"]] = row["lowest"], row["rows"], row["angles"]
    found = replace(found, lowest=lowest, counts=counts, angles=angles)
    return replace(found, needs=_needs(found, k, calibration_rows))


def _spread(rows: DataFrame, centres: np.ndarray, embedding: str) -> DataFrame:
    """``(cell, lowest, rows, angles)``: least similarity to the centre, rows, and sum of angles to it, combined in tasks."""

    @F.arrow_udf("cell int, similarity double")
    def placed(vectors: pa.Array) -> pa.Array:
        similarity, cell = _place(vectors, centres)
        return pa.StructArray.from_arrays([pa.array(cell), pa.array(similarity)], ["cell", "similarity"])

    given = rows.select(placed(embedding).alias("p")).select("p.cell", "p.similarity")
    angle = F.acos(F.least(F.greatest("similarity", F.lit(-1.0)), F.lit(1.0)))
    return given.groupBy("cell").agg(
        F.min("similarity").alias("lowest"), F.count("*").alias("rows"), F.sum(angle).alias("angles")
    )


def _needs(cells: CellIndex, k: int, wanted: int) -> np.ndarray:
    """For every true neighbour of some rows the share of its cell's radius at which a search would reach it, sorted.

    A neighbour in one of the first cells is found at any share, however negative.
    """
    with_direction = cells.rows.filter(F.col("cell") != NO_DIRECTION).select(
        F.col("cell").alias("key"), F.col(cells.embedding).alias("vector"), "cell"
    )
    if not wanted:
        return np.empty(0)
    # The same rows each time, from all over the index.
    asked = with_direction.orderBy(F.xxhash64("vector")).limit(wanted).select("vector").toArrow()
    block = query_block(pa.table({"query_id": pa.array(range(asked.num_rows), pa.int32()), "vector": asked.column(0)}))
    schema = T.StructType.fromDDL("query_id int, key int, distance double")
    # Each row finds itself first, which tells nothing.
    hits = merge_hits(scan_with(with_direction.select("key", "vector"), block, schema, k + 1), k + 1, "cell").filter("rank > 1").toArrow()
    query, cell = np.asarray(hits["query_id"]), np.asarray(hits["cell"])
    search = _Search(replace(cells, rows=with_direction), schema, k + 1, FIRST_PROBES, 1.0, True)
    first = search._kth(merge_hits(search.sent(block)[0], k + 1, "key")).collect()
    reach = np.full(len(block.ids), np.inf)
    for row in first:
        if row["kth"] is not None:
            reach[row["query_id"]] = np.arccos(np.clip(1 - row["kth"], -1, 1))
    angle = np.arccos(np.clip((block.units[query] * cells.centres[cell]).sum(axis=1), -1, 1))
    radius = np.maximum(np.arccos(np.clip(cells.lowest[cell], -1, 1)), 1e-6)
    share = (angle - reach[query]) / radius
    share[cells.near(block.units, FIRST_PROBES)[query, cell]] = -np.inf
    return np.sort(np.clip(share, -FAR, 1.0))


def append_changes(
    cells: CellIndex,
    path: str,
    upserts: DataFrame,
    deletes: DataFrame | None = None,
    key: str = "file_path",
    version: int | None = None,
) -> None:
    """Let written cells follow a change of the index: new and changed rows are placed by the stored centres, keys of deleted ones noted.

    ``upserts`` has the columns of the index, one row per key; a key that is deleted and written counts as written. Nothing of the
    index is read. The last file written makes the change visible; a failed attempt leaves nothing that is read. Radii grow
    with the new rows, so a search at recall 1 stays exact.
    """
    spark = upserts.sparkSession
    ship_package(spark)
    names = [name for name in cells.rows.columns if name != "cell"]
    place = _nearest_cell(cells.centres)(cells.embedding) if len(cells.centres) else F.lit(NO_DIRECTION)
    rows = upserts.select(*names).withColumns({"cell": place, "_deleted": F.lit(False)})
    if deletes is not None:
        gone = deletes.select(key).distinct().join(upserts.select(key), key, "left_anti")
        gone = gone.withColumns({"cell": F.lit(NO_DIRECTION), "_deleted": F.lit(True)})
        rows = rows.unionByName(gone, allowMissingColumns=True)
    known = spark.read.parquet(f"{path}/later").agg(F.max("delta")).first()[0]
    number = 0 if known is None else known + 1
    folder = f"{path}/deltas/delta={number}"
    _dealt(rows, cells.embedding, ROWS_PER_FILE).write.mode("overwrite").partitionBy("cell").parquet(folder)
    written = spark.read.schema(rows.schema).parquet(folder).filter(~F.col("_deleted")).select(cells.embedding)
    described = _spread(written, cells.centres, cells.embedding) if len(cells.centres) else written.limit(0).selectExpr(
        "-1 AS cell", "0D AS lowest", "0L AS rows", "0D AS angles"
    )
    mark = spark.range(1).select(F.lit(None).cast("int").alias("cell"), F.lit(None).cast("double").alias("lowest"), F.lit(0).cast("bigint").alias("rows"), F.lit(0.0).alias("angles"))
    (
        described.select("cell", "lowest", F.col("rows").cast("bigint").alias("rows"), "angles")
        .unionByName(mark)
        .select(
            "cell", F.lit(None).cast("array<double>").alias("centre"), "lowest", "rows", "angles",
            F.lit(number).alias("delta"), F.lit(version).cast("bigint").alias("version"),
        )
        .coalesce(1).write.mode("append").parquet(f"{path}/later")
    )


def has_cells(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/later/_SUCCESS")
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def cells_version(spark: SparkSession, path: str) -> int:
    """The version of the index which written cells were built from, or have followed to."""
    return spark.read.parquet(f"{path}/later").agg(F.max("version")).first()[0] or 0


def drift(spark: SparkSession, path: str) -> dict[str, float | bool]:
    """How far later rows have left the cells: ``later_share`` of all rows, and ``angle_ratio``, their mean angle to their centre against
    that of the rows as built. ``refit`` says that cells should be built anew: searches stay right, but probe more than they need."""
    built = spark.read.parquet(f"{path}/centres").agg(F.sum("rows"), F.sum("angles")).first()
    later = spark.read.parquet(f"{path}/later").filter("cell >= 0").agg(F.sum("rows"), F.sum("angles")).first()
    rows, late = built[0] or 0, later[0] or 0
    share = late / (rows + late) if rows + late else 0.0
    mean = lambda total, count: (total or 0.0) / count if count else 0.0
    before, now = mean(built[1], rows), mean(later[1], late)
    ratio = now / before if before and late else 1.0
    return {"later_share": share, "angle_ratio": ratio, "refit": share > LATER_SHARE or ratio > LATER_ANGLE}


def _place(vectors: pa.Array, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Similarity to the nearest centre, and its cell."""
    matrix, missing = vector_matrix(vectors, centres.shape[1])
    units, without = unit_rows(matrix)
    best, cell = np.empty(len(units)), np.empty(len(units), np.int64)
    for part in matrix_parts(len(units), len(centres)):
        similarity = units[part] @ centres.T
        cell[part] = similarity.argmax(axis=1)
        best[part] = similarity.max(axis=1)
    return best, np.where(without | missing, NO_DIRECTION, cell).astype(np.int32)


def _nearest_cell(centres: np.ndarray):
    @F.arrow_udf("int")
    def nearest(vectors: pa.Array) -> pa.Array:
        return pa.array(_place(vectors, centres)[1])

    return nearest


def ann_search(
    queries: DataFrame,
    cells: CellIndex,
    k: int = DEFAULT_K,
    probes: int | None = None,
    query_id: str = "query_id",
    key: str = "file_path",
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
    recall: float = DEFAULT_RECALL,
    report: bool = False,
) -> DataFrame:
    """``(query_id, rank, key, distance)``: ``k`` near rows of every query, with their exact distances.

    A query looks into its :data:`FIRST_PROBES` nearest cells, and then into every other cell that may hold a nearer row than its
    k-th hit so far, where cells count as so much smaller as the wanted ``recall`` allows; a ``recall`` of 1 gives the exact answer.
    With ``probes`` it looks into so many nearest cells instead; all of them give the exact answer, too. Rows without a direction
    are always looked at. ``report`` adds ``probed``, the number of cells that the query looked into.

    Only probed cells are scanned, in place and without a shuffle; a cell that holds a large part of the rows is scanned by as many
    tasks as it has splits. Query sets too large to send to every task are paired with their cells by a join and compared block
    by block.
    """
    ship_package(cells.rows.sparkSession)
    embedding = cells.embedding
    queries = queries.filter(F.col(embedding).isNotNull()).select(F.col(query_id).alias("query_id"), F.col(embedding).alias("vector"))
    schema = hit_schema(queries, cells.rows, "query_id", key)
    table = collect_queries(queries, "query_id", "vector", max_broadcast_bytes)
    rows = cells.rows.select(F.col(key).alias("key"), F.col(embedding).alias("vector"), "cell")
    search = _Search(replace(cells, rows=rows), schema, k, probes or FIRST_PROBES, cells.radius_share(recall), probes is not None)
    found, probed = search.sent(query_block(table)) if table is not None else search.joined(queries)
    hits = merge_hits(found, k, key)
    return hits.join(F.broadcast(probed) if table is not None else probed, "query_id") if report else hits


def search_by_bounds(
    queries: DataFrame, index: DataFrame, k: int, query_id: str, key: str, embedding: str, block_rows: int
) -> DataFrame | None:
    """Exact search of any number of queries where blocks of the index are cells: a query meets only those that its k-th hit in the
    nearest ones cannot rule out. None if the index is a single block.

    Centres come from a sample of the index, which decides how much is ruled out and not what is found. Rows and their cells are
    written once to the scratch folder, as the search reads them several times.
    """
    blocks = min(MOST_BLOCKS, -(-index.count() // block_rows))
    if blocks < 2:
        return None
    rows = index.select(key, embedding)
    cells = build_cells(rows, blocks, embedding, iterations=5, training_rows=BLOCK_TRAINING_ROWS, k=k, calibration_rows=0)
    asked = queries.select(F.col(query_id).alias("query_id"), F.col(embedding).alias("vector"))
    schema = hit_schema(asked, rows, "query_id", key)
    placed, path = cells.rows.select(F.col(key).alias("key"), F.col(embedding).alias("vector"), "cell"), scratch_dir(index.sparkSession)
    placed.write.parquet(path)
    placed = index.sparkSession.read.schema(placed.schema).parquet(path)
    hits, _ = _Search(replace(cells, rows=placed), schema, k, 1, 1.0, False).joined(asked)
    return merge_hits(hits, k, key)


@dataclass
class _Search:
    """One search: hits of the first cells, and those of the cells that may hold better ones."""

    cells: CellIndex
    schema: T.StructType
    k: int
    first: int
    share: float
    fixed: bool

    def sent(self, block: QueryBlock) -> tuple[DataFrame, DataFrame]:
        """Queries that are sent to every task: ``(hits, probed)``."""
        chosen = self.cells.near(block.units, self.first)
        hits = self._scan(block, chosen, [NO_DIRECTION])
        if not self.fixed:
            hits = self._staged(hits)
            kth = {row["query_id"]: row["kth"] for row in self._kth(hits).collect()}
            reached = np.array([kth.get(name, np.nan) for name in block.ids.to_pylist()], dtype=np.float64)
            more = self.cells.within(block.units, reached, self.share) & ~chosen
            chosen = chosen | more
            if more.any():
                hits = hits.unionByName(self._scan(block, more, []))
        counts = pa.table({"query_id": block.ids, "probed": pa.array(chosen.sum(axis=1).astype(np.int32))})
        return hits, self.cells.rows.sparkSession.createDataFrame(counts)

    def joined(self, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Queries that meet their cells in a join: ``(hits, probed)``.

        The first cells of a query are few, and it goes to each of them. Further ones may be most of all cells, so it goes to groups of
        cells, once to each that holds a cell within its reach; the task then compares it with those cells only.
        """
        cells, first, share = self.cells, self.first, self.share
        bare = replace(cells, rows=None)

        def lists(chosen: np.ndarray) -> pa.Array:
            offsets = np.concatenate(([0], np.cumsum(chosen.sum(axis=1)))).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.nonzero(chosen)[1].astype(np.int32)))

        @F.arrow_udf("array<int>")
        def near(vectors: pa.Array) -> pa.Array:
            units = _units(vectors, bare.centres)
            found = [lists(bare.near(units[part], first)) for part in matrix_parts(len(units), len(bare.centres))]
            return pa.concat_arrays(found) if found else pa.array([], pa.list_(pa.int32()))

        placed = queries.withColumn("cells", near("vector"))
        asked = placed.select("query_id", "vector", F.explode(F.concat("cells", F.array(F.lit(NO_DIRECTION)))).alias("cell"))
        hits = block_search(asked, cells.rows, self.schema, self.k, "key").drop("rank")
        probed = placed.select("query_id", F.size("cells").alias("probed"))
        if self.fixed:
            return hits, probed
        hits = self._staged(hits)
        group = bare.groups(max(1, INDEX_BLOCK_BYTES // (8 * max(1, bare.centres.shape[1]))))
        groups = int(group.max()) + 1 if len(group) else 0

        @F.arrow_udf("groups array<int>, cells int")
        def within(vectors: pa.Array, kth: pa.Array, nearest: pa.Array) -> pa.Array:
            units, reached = _units(vectors, bare.centres), np.asarray(kth.fill_null(np.nan), dtype=np.float64)
            counts, found = np.zeros(len(units), np.int32), [pa.array([], pa.list_(pa.int32()))]
            for part in matrix_parts(len(units), len(bare.centres)):
                chosen = bare.within(units[part], reached[part], share)
                chosen[_members(nearest[part])] = False
                counts[part] = chosen.sum(axis=1)
                wanted = np.zeros((len(chosen), groups), bool)
                for number in range(groups):
                    wanted[:, number] = chosen[:, group == number].any(axis=1)
                found.append(lists(wanted))
            return pa.StructArray.from_arrays([pa.concat_arrays(found), pa.array(counts)], ["groups", "cells"])

        def probing(block: QueryBlock, asked: pa.Table) -> QueryBlock:
            kth = np.asarray(asked["kth"].combine_chunks().fill_null(np.nan), dtype=np.float64)
            limit = np.where(np.isnan(kth), np.inf, kth.round(TIE_DIGITS))
            return replace(block, cells=_Reached(block.units, bare, _reach(kth), share, asked["cells"].combine_chunks()), limit=limit)

        again = placed.join(self._kth(hits), "query_id", "left").withColumn("more", within("vector", "kth", "cells"))
        spark = cells.rows.sparkSession
        numbers = pa.table({"part": pa.array(range(len(group)), pa.int32()), "cell": pa.array(group, pa.int32())})
        parts = cells.rows.withColumnRenamed("cell", "part").join(F.broadcast(spark.createDataFrame(numbers)), "part")
        asked = again.select("query_id", "vector", "kth", "cells", F.explode("more.groups").alias("cell"))
        others = block_search(asked, parts, self.schema, self.k, "key", None, None, probing)
        return hits.unionByName(others.drop("rank")), again.select("query_id", (F.size("cells") + F.col("more.cells")).alias("probed"))

    def _scan(self, block: QueryBlock, chosen: np.ndarray, always: list[int]) -> DataFrame:
        always = always if len(block.ids) else []
        rows = self.cells.rows.filter(F.col("cell").isin([*np.flatnonzero(chosen.any(axis=0)).tolist(), *always]))
        return scan_with(rows, QueryBlock(block.ids, block.units, _Chosen(chosen, always)), self.schema, self.k)

    def _staged(self, hits: DataFrame) -> DataFrame:
        """The best hits of the first cells: they tell how far to go on, and are merged with what is found there."""
        path = scratch_dir(hits.sparkSession)
        merge_hits(hits, self.k, "key").drop("rank").write.parquet(path)
        return hits.sparkSession.read.schema(self.schema).parquet(path)

    def _kth(self, hits: DataFrame) -> DataFrame:
        """``(query_id, kth)``: the distance of the k-th hit; NULL if there are fewer or it is no number."""
        number = F.col("distance").isNotNull() & ~F.isnan("distance")
        counted = hits.groupBy("query_id").agg(F.count_if(number).alias("_hits"), F.max(F.when(number, F.col("distance"))).alias("_kth"))
        return counted.select("query_id", F.when(F.col("_hits") >= self.k, F.col("_kth")).alias("kth"))


def _units(vectors: pa.Array, centres: np.ndarray) -> np.ndarray:
    if not len(centres):
        return np.zeros((len(vectors), 0))
    return unit_rows(vector_matrix(vectors, centres.shape[1])[0])[0]


def _members(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Row and value of every member of a list column."""
    lengths = np.asarray(lists.value_lengths().fill_null(0))
    return np.repeat(np.arange(len(lists)), lengths), np.asarray(lists.flatten(), dtype=np.int64)


class _Chosen:
    """Which queries look into which cells, in one bit for each pair: lists of them would outgrow the queries that are sent along."""

    def __init__(self, chosen: np.ndarray, always: list[int]) -> None:
        self.queries = len(chosen)
        self.bits = np.packbits(chosen, axis=0)
        self.always = always

    def get(self, cell: int) -> np.ndarray | None:
        if cell in self.always:
            return np.arange(self.queries)
        if cell < 0:
            return None
        asked = np.flatnonzero(np.unpackbits(self.bits[:, cell], count=self.queries))
        return asked if len(asked) else None


class _Reached:
    """Which queries of a block reach a cell beyond those they have looked into; worked out cell by cell, as it is asked for."""

    def __init__(self, units: np.ndarray, cells: CellIndex, reach: np.ndarray, share: float, seen: pa.ListArray) -> None:
        self.units = units
        self.centres = cells.centres
        self.reach = reach
        self.radius = share * cells._radius()
        query, cell = _members(seen)
        order = np.argsort(cell, kind="stable")
        self.seen_cell, self.seen_query = cell[order], query[order]

    def get(self, cell: int) -> np.ndarray | None:
        reached = np.arccos(np.clip(self.units @ self.centres[cell], -1, 1)) - self.radius[cell] < self.reach
        start, stop = np.searchsorted(self.seen_cell, [cell, cell + 1])
        reached[self.seen_query[start:stop]] = False
        return np.flatnonzero(reached) if reached.any() else None
