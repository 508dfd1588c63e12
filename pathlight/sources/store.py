"""The index at rest: immutable Parquet versions and a state table that says which of them count.

A publish writes only its own changes - new rows and markers for deleted paths - into a fresh version folder, and then
appends one row to the state table. That append is the commit: readers look at committed versions only, so a failed or
half-written publish is never seen, and data, model, version name and time become visible together. A reader takes the
last full version and lays the later changes over it; :meth:`IndexStore.compact` writes a new full version,
:meth:`IndexStore.merge` folds the later changes into one, and :meth:`IndexStore.vacuum` removes what nobody can read.

Beside the rows of a version lie its keys: one short row per path, in buckets by the hash of the path. Whatever is decided by
paths, ids and digests reads these, and only the buckets of the paths concerned. Texts and vectors are never shuffled.

One writer at a time is assumed, as many readers as you like.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.changes import dedupe_last_wins, delete_by_key, keep_by_key, number_keys
from ..operators.clean import broken_rules

INDEX_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("code_text", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)
# ``broken`` names the rules a row breaks; it is NULL for a good row. ``deleted`` marks a removed path. ``digest`` tells
# whether a text has changed, and ``seq`` where in an ordered stream the row was written.
_SEGMENT_SCHEMA = T.StructType(
    [
        *INDEX_SCHEMA.fields,
        T.StructField("deleted", T.BooleanType()),
        T.StructField("broken", T.ArrayType(T.StringType())),
        T.StructField("digest", T.StringType()),
        T.StructField("seq", T.StringType()),
        T.StructField("removed_at", T.TimestampType()),
        T.StructField("row", T.LongType()),
        T.StructField("v", T.LongType()),
    ]
)
# One row for each path and kind - ``live``, ``deleted`` or ``broken`` - of a version: ``row`` and what else is known of the one
# that counts, ``n`` how many there are.
_KEY_SCHEMA = "file_path string, kind string, id bigint, digest string, seq string, row bigint, n bigint, v bigint, bucket int"
STATE_SCHEMA = T.StructType(
    [
        T.StructField("version", T.LongType(), False),
        T.StructField("full", T.BooleanType(), False),
        T.StructField("source_version", T.StringType()),
        T.StructField("stream", T.StringType()),
        T.StructField("batch_id", T.LongType()),
        T.StructField("upserted", T.LongType()),
        T.StructField("deleted", T.LongType()),
        T.StructField("requests", T.LongType()),
        T.StructField("rejected", T.LongType()),
        T.StructField("last_id", T.LongType()),
        T.StructField("model", T.LongType()),
        T.StructField("replaces", T.LongType()),
        T.StructField("buckets", T.IntegerType()),
        T.StructField("indexed_at", T.TimestampType()),
    ]
)
_MODEL_SCHEMA = "bucket int, documents bigint, total bigint, idf double"

# Versions after the last full one are folded into a full version once they hold this share of its rows.
FULL_SHARE = 0.25
# So many versions after the last full one are folded by the next publish.
FOLD_EVERY = 50

# Paths of a full version in one bucket of its keys, and the most buckets.
BUCKET_PATHS = 1_000_000
MOST_BUCKETS = 4096

# For so long the marks of removed paths are kept that tell late writes of a stream from new ones.
MARK_DAYS = 30


def empty_frame(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """No rows, known as such to the optimizer, which then drops the joins around it."""
    columns = [F.lit(None).cast(field.dataType).alias(field.name) for field in schema]
    return spark.range(1).where(F.lit(False)).select(*columns)


def text_digest(text: str = "code_text") -> Column:
    return F.md5(text)


@dataclass(frozen=True)
class State:
    """The newest committed version. Before the first publish all counts are 0 and ``source_version`` is None.

    ``model`` is the version with which the model in force was stored, 0 if there is none. ``buckets`` is the number of buckets
    in which keys lie from the last full version on.
    """

    version: int = 0
    base: int = 0
    source_version: str | None = None
    last_id: int = 0
    model: int = 0
    buckets: int = 1


class IndexStore:
    def __init__(self, spark: SparkSession, root: str, dim: int, bucket_paths: int = BUCKET_PATHS) -> None:
        self.spark = spark
        self.root = root.rstrip("/")
        self.dim = dim
        self.bucket_paths = bucket_paths

    # --- state ---

    def _state_rows(self) -> DataFrame:
        # While the table is being folded a version may be in it twice.
        return self._read("state", STATE_SCHEMA).dropDuplicates(["version"])

    def index_state(self) -> DataFrame:
        """All committed versions, oldest first; empty before the first publish."""
        return self._state_rows().orderBy("version")

    def state(self) -> State:
        return self._state(self._committed())

    def _committed(self, version: int | None = None) -> list[Row]:
        """State rows from the last full version up to ``version`` (default: the newest), without those that a later one
        among them replaces; oldest first. Earlier history is not read into the driver."""
        history = self._state_rows()
        if version is not None:
            history = history.filter(F.col("version") <= version)
        base, newest = history.agg(F.max(F.when(F.col("full"), F.col("version"))), F.max("version")).first()
        if version is not None and newest != version:
            raise ValueError(f"the index has no version {version}")
        if base is None:
            return []
        rows = history.filter(F.col("version") >= base).drop("stream", "batch_id", "indexed_at").collect()
        rows.sort(key=lambda row: row["version"])
        return [
            row
            for n, row in enumerate(rows)
            if not any(later["replaces"] is not None and later["replaces"] <= row["version"] for later in rows[n + 1 :])
        ]

    @staticmethod
    def _state(committed: list[Row]) -> State:
        if not committed:
            return State()
        last = committed[-1]
        base = max(row["version"] for row in committed if row["full"])
        return State(last["version"], base, last["source_version"], last["last_id"], last["model"] or 0, last["buckets"] or 1)

    def version_of(self, source_version: str) -> int:
        """The newest version published as ``source_version``; an unknown one is an error."""
        found = self._state_rows().filter(F.col("source_version") == source_version).agg(F.max("version")).first()[0]
        if found is None:
            raise ValueError(f"unknown source version {source_version!r}")
        return found

    def last_batch(self, stream: str) -> int | None:
        """Last micro-batch of a stream that was published."""
        rows = self._state_rows().filter(F.col("stream") == stream)
        return rows.agg(F.max("batch_id")).first()[0]

    # --- reading ---

    def read(self, version: int | None = None, source_version: str | None = None) -> DataFrame:
        """The index as of a version (default: the newest) as ``(id, file_path, code_text, embedding)``.

        The version may be given by the name it was published as. An unknown version is an error, and so is reading one
        that :meth:`vacuum` has removed. The rows of the last full version meet only the paths changed since, in a
        left-anti join; when there are no later changes this is a plain scan.
        """
        if source_version is not None:
            version = self.version_of(source_version)
        return self._rows(self._committed(version))

    def digests(self, version: int | None = None) -> DataFrame:
        """``(file_path, digest)`` of all rows: enough to tell what has changed, without reading a text."""
        return self._rows(self._committed(version), ["file_path", "digest"], self._keys)

    def changes_since(self, version: int) -> tuple[DataFrame, DataFrame] | None:
        """``(rows, paths)``: what was written and what was removed after a version; None if a full version has come since."""
        committed = self._committed()
        if not committed or self._state(committed).base > version:
            return None
        later = [row for row in committed if row["version"] > version]
        if not later:
            return empty_frame(self.spark, INDEX_SCHEMA), empty_frame(self.spark, T.StructType([INDEX_SCHEMA["file_path"]]))
        last = _latest(self._segments(later))
        return last.filter(~F.col("deleted")).select(*INDEX_SCHEMA.fieldNames()), last.filter("deleted").select("file_path")

    def _segments(self, committed: list[Row]) -> DataFrame:
        """Rows of the given versions that are in force. Only their folders are listed."""
        folders = [f"{self.root}/segments/v={row['version']}" for row in committed]
        reader = self.spark.read.schema(_SEGMENT_SCHEMA).option("basePath", f"{self.root}/segments")
        return reader.parquet(*folders).filter(F.col("broken").isNull())

    def _keys(self, committed: list[Row], buckets: list[int] | None = None) -> DataFrame:
        """Keys of the given versions, in some buckets or all; ``deleted`` as in segments."""
        folders = [f"{self.root}/keys/v={row['version']}" for row in committed]
        reader = self.spark.read.schema(_KEY_SCHEMA).option("basePath", f"{self.root}/keys")
        found = reader.parquet(*folders).filter("kind <> 'broken'").withColumn("deleted", F.col("kind") == "deleted")
        return found if buckets is None else found.filter(F.col("bucket").isin(buckets))

    def _touched(self, paths: DataFrame, state: State) -> list[int] | None:
        """The buckets in which some paths lie; None stands for all of them."""
        if state.buckets == 1:
            return None
        found = paths.select(_bucket(state.buckets).alias("bucket")).distinct().collect()
        return None if len(found) == state.buckets else [row["bucket"] for row in found]

    def _rows(
        self, committed: list[Row], columns: list[str] | None = None, source: Callable[[list[Row]], DataFrame] | None = None
    ) -> DataFrame:
        """Current rows: those of the last full version without the paths changed since, and the last of each of these."""
        columns, source = columns or INDEX_SCHEMA.fieldNames(), source or self._segments
        if not committed:
            return empty_frame(self.spark, T.StructType([_SEGMENT_SCHEMA[name] for name in columns]))
        base = self._state(committed).base
        rows = source([row for row in committed if row["version"] == base]).filter(~F.col("deleted")).select(*columns)
        later = [row for row in committed if row["version"] > base]
        if not later:
            return rows
        changes = source(later)
        live = _latest(changes).filter(~F.col("deleted")).select(*columns)
        return delete_by_key(rows, changes).unionByName(live)

    def rejected(self) -> DataFrame:
        """Rows set aside by publishes ``(v, file_path, broken)``, with the rules they broke."""
        committed = self._state_rows().select(F.col("version").alias("v"))
        rows = self._read("segments", _SEGMENT_SCHEMA).filter(F.col("broken").isNotNull())
        return rows.select("v", "file_path", "broken").join(committed, "v", "left_semi")

    # --- writing ---

    def publish_index(
        self,
        upserts: DataFrame | None = None,
        deletes: DataFrame | None = None,
        source_version: str | None = None,
        order: list[str] | None = None,
        finish: Callable[[DataFrame], DataFrame] | None = None,
        stream: str | None = None,
        batch_id: int | None = None,
        keys: DataFrame | None = None,
        full: bool = False,
        model: int | None = None,
    ) -> State:
        """Apply one batch, deletes before upserts, and commit it. ``source_version`` None keeps the stored one.

        ``upserts`` are ``(file_path, code_text, embedding)``. Of several rows for one path the last by the columns named in
        ``order`` counts; without ``order`` one is taken - by its digest, so a rerun takes the same text - and the others are
        set aside as ``path_not_unique``. With ``finish`` they may have any columns besides ``file_path``,
        and ``finish`` makes the other two of them while the version is written; it may also add ``deleted`` (this path
        is to be removed after all) and ``unembedded`` (no vector could be made). With ``full`` the upserts are the whole
        index: paths that are not among them are gone. ``model`` names a model stored by :meth:`write_model`, which comes
        into force with this version.

        Rows that break a rule of the index are set aside (see :meth:`rejected`) and not applied. Replaced rows keep
        their id; new ones get ids above all earlier ones, unique but with gaps. A first version is written by a single map-only
        job, of which keys are made then; otherwise only paths and ids in the buckets of the batch's paths are read, and
        joined with these: ``keys``, if these - or more - are known without computing the upserts.
        """
        committed = self._committed()
        before = self._state(committed)
        version = before.version + 1
        if upserts is None:
            upserts = empty_frame(self.spark, INDEX_SCHEMA).drop("id")
        if order:
            upserts = dedupe_last_wins(upserts, order)
        requests = 0
        if deletes is not None:
            wanted = [name for name in ("file_path", "seq") if name in deletes.columns]
            deletes = deletes.select(*wanted)
            requests = deletes.count()
        if before.version == 0:
            rows = upserts.withColumn("id", F.lit(before.last_id + 1) + F.monotonically_increasing_id())
        else:
            paths = (upserts if keys is None else keys).select("file_path").filter(F.col("file_path").isNotNull()).distinct()
            touched = self._touched(paths, before)
            known = self._rows(committed, ["file_path", "id"], lambda rows: self._keys(rows, touched))
            if requests:
                known = delete_by_key(known, deletes)
            numbered = number_keys(paths.join(known, "file_path", "left"), before.last_id)
            rows = upserts.drop("id").join(numbered, "file_path", "left")
        if finish:
            rows = finish(rows)
        rows = self._marked(rows)
        if deletes is not None and not full:
            markers = deletes.groupBy("file_path").agg(F.max("seq").alias("seq")) if "seq" in deletes.columns else deletes.distinct()
            rows = rows.unionByName(markers.withColumn("deleted", F.lit(True)), allowMissingColumns=True)
        self._write_segment(rows, version)
        state = self._commit(version, before, source_version, requests, stream, batch_id, full=full, model=model)
        # How many versions readers lay over the last full one from now on.
        later = 0 if state.base == state.version else 1 + sum(row["version"] > state.base for row in committed)
        return self.fold() if later >= FOLD_EVERY else state

    def _marked(self, rows: DataFrame) -> DataFrame:
        """Rows as they are stored: removed ones without contents, and the broken rules of the others."""
        for flag in ("deleted", "unembedded"):
            if flag not in rows.columns:
                rows = rows.withColumn(flag, F.lit(False))
        failed = F.array_compact(F.array(F.when(F.col("unembedded"), F.lit("embedding_missing"))))
        found = F.concat(broken_rules(self.dim), failed)
        broken = F.when(~F.col("deleted") & (F.size(found) > 0), found)
        return rows.withColumn("broken", broken).withColumn("digest", text_digest()).drop("unembedded")

    def write_model(self, idf: DataFrame) -> int:
        """Store a model beside the version to be published next; it counts once that version is committed with it."""
        version = self.state().version + 1
        self._write(idf.select("bucket", "documents", "total", "idf"), f"models/v={version}")
        return version

    def read_model(self, version: int | None = None) -> DataFrame:
        """The model in force, or one that was just written; empty if there is none."""
        return self._read(f"models/v={self.state().model if version is None else version}", T.StructType.fromDDL(_MODEL_SCHEMA))

    # --- upkeep ---

    def compact(self) -> State:
        """Write the current rows as a full version, so that readers no longer merge.

        Marks of removed paths that have a place in a stream stay for MARK_DAYS: late writes are told from new ones by them.
        """
        committed = self._committed()
        before = self._state(committed)
        stored = [name for name in _SEGMENT_SCHEMA.fieldNames() if name != "v"]
        rows = self._rows(committed, stored)
        young = F.col("removed_at") > F.current_timestamp() - F.expr(f"INTERVAL '{MARK_DAYS}' DAY")
        last = _latest(self._segments(committed))
        marks = last.filter(F.col("deleted") & F.col("seq").isNotNull() & young).select(*stored)
        self._write_segment(rows.unionByName(marks), before.version + 1)
        return self._commit(before.version + 1, before, None, 0, None, None, full=True, written=False)

    def merge(self) -> State:
        """Fold the versions after the last full one into a single one, which replaces them for readers."""
        committed = self._committed()
        before = self._state(committed)
        later = [row for row in committed if row["version"] > before.base]
        if len(later) < 2:
            return before
        self._write_segment(_latest(self._segments(later)), before.version + 1)
        return self._commit(
            before.version + 1, before, None, 0, None, None, written=False, replaces=later[0]["version"]
        )

    def fold(self, most: int | None = None) -> State:
        """Once ``most`` versions (:data:`FOLD_EVERY`) have come after the last full one, fold them: into a full version if they
        hold a share of :data:`FULL_SHARE` of its rows, else into one. Every publish does so; earlier versions stay readable."""
        most = most or FOLD_EVERY
        committed = self._committed()
        state = self._state(committed)
        later = [row for row in committed if row["version"] > state.base]
        if len(later) < most:
            return state
        base = next(row for row in committed if row["version"] == state.base)
        changed = sum(row["upserted"] + row["deleted"] for row in later)
        return self.compact() if changed >= FULL_SHARE * max(1, base["upserted"]) else self.merge()

    def tidy(self, most: int = 20) -> State:
        """:meth:`fold`, and then remove what is no longer read."""
        before = self.state()
        state = self.fold(most)
        if state.version != before.version:
            self.vacuum()
        return state

    def vacuum(self) -> None:
        """Remove versions that are no longer read, and fold the small files of the state table into one.

        The newest version and the one before the last full or merged version stay readable; older ones do not.
        """
        state = self._state_rows().cache()
        try:
            folded = state.filter(F.col("full") | F.col("replaces").isNotNull()).agg(F.max("version")).first()[0]
            previous = state.filter(F.col("version") < (folded or 0)).agg(F.max("version")).first()[0]
            kept = {row["version"] for row in self._committed()}
            if previous is not None:
                kept |= {row["version"] for row in self._committed(previous)}
            models = {row["model"] for row in state.filter(F.col("version").isin(list(kept))).select("model").collect()}
            for name, wanted in (("segments", kept), ("keys", kept), ("models", models)):
                for folder in self._folders(name):
                    if folder.startswith("v=") and int(folder[2:]) not in wanted:
                        self._remove(f"{name}/{folder}")
            old = self._folders("state")
            state.coalesce(1).write.mode("append").parquet(f"{self.root}/state")
            for name in old:
                if name.startswith("part-"):
                    self._remove(f"state/{name}")
        finally:
            state.unpersist()

    def _path(self, name: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _folders(self, name: str) -> list[str]:
        system, path = self._path(name)
        return [entry.getPath().getName() for entry in system.listStatus(path)] if system.exists(path) else []

    def _remove(self, name: str) -> None:
        system, path = self._path(name)
        system.delete(path, True)

    def _commit(
        self, version, before, source_version, requests, stream, batch_id, full=False, model=None, written=True, replaces=None
    ) -> State:
        """``written``: whether the rows of the version are changes, and not a copy of those of earlier ones."""
        is_full = full or before.base == 0
        # Counting reads the footers of files only.
        buckets = before.buckets
        if is_full:
            buckets = min(MOST_BUCKETS, -(-max(1, self._segment(version).count()) // self.bucket_paths))
        counts = self._write_keys(version, buckets)
        if counts["repeated"]:
            self._set_aside(version)
            version += 1
            counts = self._write_keys(version, buckets)
        kept = before.source_version if source_version is None else source_version
        last_id = max(before.last_id, counts["last_id"] or 0)
        base = version if is_full else before.base
        model = before.model if model is None else model
        row = self.spark.range(1).select(
            F.lit(version).cast("bigint").alias("version"),
            F.lit(base == version).alias("full"),
            F.lit(kept).cast("string").alias("source_version"),
            F.lit(stream).cast("string").alias("stream"),
            F.lit(batch_id).cast("bigint").alias("batch_id"),
            F.lit(counts["upserted"]).cast("bigint").alias("upserted"),
            F.lit(counts["deleted"]).cast("bigint").alias("deleted"),
            F.lit(requests).cast("bigint").alias("requests"),
            F.lit(counts["rejected"] if written else 0).cast("bigint").alias("rejected"),
            F.lit(last_id).cast("bigint").alias("last_id"),
            F.lit(model).cast("bigint").alias("model"),
            F.lit(replaces).cast("bigint").alias("replaces"),
            F.lit(buckets).cast("int").alias("buckets"),
            F.current_timestamp().alias("indexed_at"),
        )
        row.coalesce(1).write.mode("append").parquet(f"{self.root}/state")
        return State(version, base, kept, last_id, model, buckets)

    def _segment(self, version: int) -> DataFrame:
        return self.spark.read.schema(_SEGMENT_SCHEMA).parquet(f"{self.root}/segments/v={version}")

    def _write_keys(self, version: int, buckets: int) -> Row:
        """Write the keys of a version and count them: ``upserted, deleted, rejected, repeated, last_id``.

        Rows of one path are combined before the shuffle, so neither a path nor a bucket gathers them.
        """
        kind = F.when(F.col("deleted"), "deleted").when(F.col("broken").isNotNull(), "broken").otherwise("live")
        place = F.struct("digest", "row")
        keys = (
            self._segment(version)
            .select("file_path", kind.alias("kind"), "id", "digest", "seq", "row")
            .groupBy("file_path", "kind")
            .agg(F.max_by(F.struct("id", "digest", "row"), place).alias("last"), F.max("seq").alias("seq"), F.count("*").alias("n"))
            .select("file_path", "kind", "last.id", "last.digest", "seq", "last.row", "n", _bucket(buckets).alias("bucket"))
        )
        dealt = keys.repartition(buckets, "bucket").sortWithinPartitions("bucket", "file_path") if buckets > 1 else keys
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/keys/v={version}")
        live = F.col("kind") == "live"
        return (
            self.spark.read.schema(_KEY_SCHEMA)
            .option("basePath", f"{self.root}/keys")
            .parquet(f"{self.root}/keys/v={version}")
            .agg(
                F.count_if(live).alias("upserted"),
                F.count_if(F.col("kind") == "deleted").alias("deleted"),
                F.coalesce(F.sum(F.when(F.col("kind") == "broken", F.col("n"))), F.lit(0)).alias("rejected"),
                F.count_if(live & (F.col("n") > 1)).alias("repeated"),
                F.max("id").alias("last_id"),
            )
            .first()
        )

    def _set_aside(self, version: int) -> None:
        """Write the rows of a version anew, as the next one, with all rows of a path but the one that counts as broken."""
        keys = self.spark.read.schema(_KEY_SCHEMA).option("basePath", f"{self.root}/keys").parquet(f"{self.root}/keys/v={version}")
        kept = keys.filter("kind = 'live' AND n > 1").select("file_path", F.col("row").alias("_kept"))
        rows = self._segment(version).join(kept, "file_path", "left")
        other = ~F.col("deleted") & F.col("broken").isNull() & (F.col("row") != F.col("_kept"))
        broken = F.when(other, F.array(F.lit("path_not_unique"))).otherwise(F.col("broken"))
        self._write_segment(rows.withColumn("broken", broken).drop("_kept"), version + 1)
        for name in ("segments", "keys"):
            self._remove(f"{name}/v={version}")

    def places(self, paths: DataFrame) -> DataFrame:
        """``(file_path, stored_seq)``: the last place in a stream at which each of some paths was written or removed."""
        committed = self._committed()
        if not committed:
            return empty_frame(self.spark, T.StructType.fromDDL("file_path string, stored_seq string"))
        touched = self._touched(paths, self._state(committed))
        rows = self._keys(committed, touched).select("file_path", "seq").filter(F.col("seq").isNotNull())
        return keep_by_key(rows, paths).groupBy("file_path").agg(F.max("seq").alias("stored_seq"))

    def all_places(self) -> DataFrame:
        """``(file_path, stored_seq)`` of all paths that have a place in a stream."""
        committed = self._committed()
        if not committed:
            return empty_frame(self.spark, T.StructType([T.StructField("file_path", T.StringType()), T.StructField("stored_seq", T.StringType())]))
        rows = self._keys(committed).select("file_path", "seq").filter(F.col("seq").isNotNull())
        return rows.groupBy("file_path").agg(F.max("seq").alias("stored_seq"))

    # --- tables beside the index ---

    def stage(self, rows: DataFrame, name: str) -> DataFrame:
        """Write a table that a run needs more than once, and read it back: it is then computed only once."""
        self._write(rows, f"staged/{name}")
        return self._read(f"staged/{name}", rows.schema)

    # --- files ---

    def _write_segment(self, rows: DataFrame, version: int) -> None:
        for name in ("digest", "seq", "removed_at"):
            if name not in rows.columns:
                rows = rows.withColumn(name, F.lit(None))
        removed = F.when(F.col("deleted"), F.coalesce(F.col("removed_at").cast("timestamp"), F.current_timestamp()))
        rows = rows.withColumns({"removed_at": removed, "row": F.monotonically_increasing_id()})
        columns = [F.col(f.name).cast(f.dataType) for f in _SEGMENT_SCHEMA if f.name != "v"]
        self._write(rows.select(*columns), f"segments/v={version}")

    def _write(self, rows: DataFrame, name: str) -> None:
        """A version folder belongs to one publish; leftovers of a failed attempt at the same version are replaced."""
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}")

    def _read(self, name: str, schema: T.StructType) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return empty_frame(self.spark, schema)


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("file_path"), F.lit(buckets)).cast("int")


def _latest(changes: DataFrame) -> DataFrame:
    """The last row of every path. Within one version a written row counts more than a deletion of the same path."""
    return dedupe_last_wins(changes.withColumn("_live", ~F.col("deleted")), ["v", "_live"]).drop("_live")


def order_key(rows: DataFrame, order: list[str]) -> Column:
    """The order columns - whole numbers, dates, times or strings - as one string that sorts as they do."""

    def part(name: str) -> Column:
        kind = rows.schema[name].dataType
        if isinstance(kind, T.StringType):
            # Later parts cannot interfere: a string ends before anything that may stand in one.
            return F.concat(F.coalesce(name, F.lit("")), F.lit("\x01"))
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            number = F.unix_micros(F.col(name).cast("timestamp"))
        elif isinstance(kind, T.DateType):
            number = F.unix_date(name)
        elif isinstance(kind, T.IntegralType):
            number = F.col(name)
        else:
            raise ValueError(f"cannot order by {name}: {kind.simpleString()}")
        smallest = F.lit(str(1 << 63)).cast("decimal(20,0)")
        shifted = number.cast("decimal(20,0)") + smallest
        return F.coalesce(F.lpad(shifted.cast("decimal(20,0)").cast("string"), 20, "0"), F.lit("0" * 20))

    return reduce(F.concat, [part(name) for name in order])
