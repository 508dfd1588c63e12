"""Whole indexing runs: full, incremental, and explicit add/delete lists.

A run reads the texts once, and strips, embeds and writes them in the same pass; everything that decides *which* files
are concerned works on paths alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import LANGUAGES, is_blank, language_of, strip_header
from ..operators.changes import digest_diff, keep_by_key, route_changes, snapshot_diff, snapshot_moves
from ..operators.clean import ignore_filter
from ..operators.ann import DEFAULT_CELLS, CellIndex, append_changes, build_cells, cells_version, drift, has_cells
from ..operators.embed import Embedder, TfIdfEmbedder, fit_idf, idf_of_vectors, reweighted
from ..sources.corpus import paths_frame
from ..sources.store import IndexStore, State, text_digest

Rules = Iterable[str] | DataFrame
Paths = str | list[str] | DataFrame


def prepare(files: DataFrame, languages: Mapping[str, str] = LANGUAGES) -> DataFrame:
    """Replace ``content`` by ``code_text``: the header cut off, NULL for a blank text, which also sets ``deleted``.

    The text goes through a one-element ``explode`` so that it is computed once per row: a filter or a second use of
    it would otherwise be pushed below and compute it again.
    """
    rest = [F.col(name) for name in files.columns if name != "content"]
    text = strip_header("content", language_of("file_path", languages))
    stripped = files.select(*rest, F.explode(F.array(text)).alias("code_text"))
    blank = F.coalesce(is_blank("code_text"), F.lit(False))
    return stripped.withColumn("deleted", blank).withColumn("code_text", F.when(~blank, F.col("code_text")))


def texts_of(files: DataFrame, languages: Mapping[str, str] = LANGUAGES) -> DataFrame:
    """``(file_path, code_text)`` of the files that would be indexed."""
    return prepare(files.select("file_path", "content"), languages).filter("code_text IS NOT NULL").drop("deleted")


def finisher(embedder: Embedder, languages: Mapping[str, str]) -> Callable[[DataFrame], DataFrame]:
    """Last steps from a file to an index row, for :meth:`IndexStore.publish_index`."""

    def finish(files: DataFrame) -> DataFrame:
        rest = [name for name in ("seq",) if name in files.columns]
        rows = embedder(prepare(files.select("id", "file_path", "content", *rest), languages))
        return rows.withColumn("unembedded", F.col("code_text").isNotNull() & F.col("embedding").isNull())

    return finish


def stored_embedder(store: IndexStore) -> TfIdfEmbedder:
    """The default embedder with the model that was fitted when the index was first built."""
    return TfIdfEmbedder(store.read_model())


def embedder_for(store: IndexStore, texts: DataFrame) -> tuple[TfIdfEmbedder, int | None]:
    """The stored embedder; or a new one, and the number of its model, if that in force was fitted when there was no text yet."""
    if store.read_model().filter("total = 0").limit(1).count():
        return fit_model(store, texts)
    return stored_embedder(store), None


def fit_model(store: IndexStore, texts: DataFrame) -> tuple[TfIdfEmbedder, int]:
    """A new embedder and the number of its model, which comes into force with the version published with it."""
    number = store.write_model(fit_idf(texts, store.dim))
    return TfIdfEmbedder(store.read_model(number)), number


def full_index(
    store: IndexStore,
    files: DataFrame,
    rules: Rules = (),
    embedder: Embedder | None = None,
    source_version: str | None = None,
    languages: Mapping[str, str] = LANGUAGES,
) -> State:
    """Index every file that is not ignored and not blank, as a full version: what was in the index before is gone.

    Without an embedder one is fitted, and its model is stored and committed with the version. Files that were indexed
    before keep their id.
    """
    kept, model = ignore_filter(files, rules), None
    if embedder is None:
        embedder, model = fit_model(store, texts_of(kept, languages))
    finish = finisher(embedder, languages)
    return store.publish_index(
        kept, source_version=source_version, finish=finish, keys=kept.select("file_path"), full=True, model=model
    )


def full_changes(files: DataFrame, rules: Rules = ()) -> DataFrame:
    """What a first run does, as changes: every file that is not ignored is added."""
    return ignore_filter(files.select(F.lit("A").alias("change"), "file_path"), rules)


def index_diff(digests: DataFrame, files: DataFrame, languages: Mapping[str, str] = LANGUAGES) -> DataFrame:
    """Changes between the index and a file table, by digest of the text that would be indexed.

    ``digests`` are those of :meth:`IndexStore.digests`, so that no text of the index is read. A file that could not be
    read counts as modified: it is set aside when published, and the row it has stays.
    """
    there = prepare(files.select("file_path", "content"), languages).filter(~F.col("deleted"))
    return digest_diff(digests, there.select("file_path", text_digest().alias("digest")))


def incremental_index(
    store: IndexStore,
    files: DataFrame,
    changes: DataFrame | None = None,
    previous: DataFrame | None = None,
    base: str | None = None,
    rules: Rules = (),
    embedder: Embedder | None = None,
    source_version: str | None = None,
    languages: Mapping[str, str] = LANGUAGES,
    moves: bool = False,
) -> State:
    """Later run: embed what was added or modified, remove what was deleted, record the version, in one commit.

    Changes are taken from ``changes`` (raw ``status`` or routed ``change`` rows), else from the difference to the
    ``previous`` file table, else from the difference to the index - as it is, or as it was when ``base`` was recorded as
    its version (an unknown one is an error). A file which has become blank is removed; one that could not be read is set
    aside, and its old row stays.

    With ``moves``, which needs ``previous``, a file that has only moved is not embedded again: its text and vector are taken from the
    index. That reads the index once, so it pays where embedding is dear. A move that gives a file another language, or out of
    the reach of the rules, is a removal and an addition.
    """
    if moves:
        if previous is None:
            raise ValueError("moves are found by comparing two file tables: give previous")
        return _with_moves(store, files, previous, rules, embedder, source_version, languages)
    if changes is None and previous is not None:
        changes = snapshot_diff(previous, files)
    elif changes is None:
        digests = store.digests(None if base is None else store.version_of(base))
        changes = index_diff(digests, files, languages)
    elif "change" not in changes.columns:
        changes = route_changes(changes)
    # A short table of paths, needed several times and possibly the result of comparing two corpora.
    changes = store.stage(ignore_filter(changes.select("change", "file_path"), rules), "changes")
    paths = changes.filter(F.col("change").isin("A", "M"))
    removed = changes.filter(F.col("change") == "D")
    written, model = keep_by_key(files, paths), None
    if embedder is None:
        embedder, model = embedder_for(store, texts_of(written, languages))
    finish = finisher(embedder, languages)
    return store.publish_index(written, removed, source_version, finish=finish, keys=paths, model=model)


def _with_moves(store, files, previous, rules, embedder, source_version, languages) -> State:
    found = snapshot_moves(previous, files)
    same = language_of("file_path", languages).eqNullSafe(language_of("new_path", languages))
    split = F.when((F.col("change") == "R") & ~same, F.array(
        F.struct(F.lit("D").alias("change"), F.col("file_path"), F.lit(None).cast("string").alias("new_path")),
        F.struct(F.lit("A").alias("change"), F.col("new_path").alias("file_path"), F.lit(None).cast("string").alias("new_path")),
    )).otherwise(F.array(F.struct("change", "file_path", "new_path")))
    found = store.stage(found.select(F.inline(split)), "moves")
    moved = ignore_filter(found.filter("change = 'R'"), rules, "new_path")
    # The row to take may be missing: an ignored file that has moved to where it counts.
    held = store.read().select("file_path", "code_text", "embedding").join(moved.select("file_path", "new_path"), "file_path")
    held = store.stage(held.select(F.col("new_path").alias("file_path"), "code_text", "embedding"), "moved")
    others = moved.select(F.col("new_path").alias("file_path")).join(held.select("file_path"), "file_path", "left_anti")
    paths = ignore_filter(found.filter("change IN ('A', 'M')"), rules).select("file_path").unionByName(others)
    removed = ignore_filter(found.filter("change IN ('D', 'R')"), rules).select("file_path")
    written, model = keep_by_key(files, paths), None
    if embedder is None:
        embedder, model = embedder_for(store, texts_of(written, languages))
    finish = finisher(embedder, languages)
    given = written.withColumns({"code_text": F.lit(None).cast("string"), "embedding": F.lit(None).cast("array<float>")})

    def finish_new(rows: DataFrame) -> DataFrame:
        """Moved rows are finished already."""
        embedded = finish(rows.filter("code_text IS NULL"))
        kept = rows.filter("code_text IS NOT NULL").select("id", "file_path", "code_text", "embedding")
        return embedded.unionByName(kept.withColumns({"deleted": F.lit(False), "unembedded": F.lit(False)}), allowMissingColumns=True)

    rows = given.unionByName(held, allowMissingColumns=True)
    keys = paths.unionByName(held.select("file_path"))
    return store.publish_index(rows, removed, source_version, finish=finish_new, keys=keys, model=model)


def refit_model(store: IndexStore) -> State:
    """Bring the default model up to date with everything that was written, replaced and removed since it was fitted.

    The counts of the model are taken from the vectors of the index, and every vector is weighted anew; no text is split into
    words again. The result is a full version that holds what a fit on all its texts would have given; rows keep their ids.
    Places of a stream are then known to its checkpoint only.
    """
    before = stored_embedder(store)
    number = store.write_model(idf_of_vectors(store.read(), store.dim))
    after = TfIdfEmbedder(store.read_model(number))
    rows = reweighted(store.read().drop("id"), before.idf, after.idf)
    return store.publish_index(rows, full=True, keys=store.digests().select("file_path"), model=number)


def add_delete_index(
    store: IndexStore,
    files: DataFrame,
    add: Paths = "",
    delete: Paths = "",
    embedder: Embedder | None = None,
    languages: Mapping[str, str] = LANGUAGES,
) -> State:
    """Explicit lists. Ignore rules do not apply and the recorded source version stays; one list must be given.

    Without an embedder the stored model is used. Only an empty store gets a new one, fitted on the added files: another
    model beside the vectors of an index would make distances meaningless.
    """
    if all(isinstance(paths, (str, list)) and not paths for paths in (add, delete)):
        raise ValueError("give paths to add or to delete")
    spark = files.sparkSession
    paths, model = paths_frame(spark, add), None
    written = keep_by_key(files, paths)
    if embedder is None and store.state().version:
        embedder, model = embedder_for(store, texts_of(written, languages))
    elif embedder is None:
        embedder, model = fit_model(store, texts_of(written, languages))
    finish = finisher(embedder, languages)
    return store.publish_index(written, paths_frame(spark, delete), finish=finish, keys=paths, model=model)


def refresh_cells(store: IndexStore, path: str, cells: int = DEFAULT_CELLS, **how) -> CellIndex:
    """Cells for approximate search that hold the newest version of an index, at ``path``.

    Cells that are there follow what was written and removed since: the change alone is read, placed and added. They are built
    anew if there are none, if a full version was published since, or if the rows added have drifted away (:func:`drift`).
    ``how`` goes to :func:`build_cells`.
    """
    spark, state = store.spark, store.state()
    if has_cells(spark, path) and not drift(spark, path)["refit"]:
        reached = cells_version(spark, path)
        changes = store.changes_since(reached)
        if changes is not None:
            if reached < state.version:
                append_changes(CellIndex.read(spark, path), path, *changes, version=state.version)
            return CellIndex.read(spark, path)
    build_cells(store.read().select("file_path", "embedding"), cells, **how).write(path, version=state.version)
    return CellIndex.read(spark, path)


__all__ = [
    "add_delete_index",
    "full_changes",
    "full_index",
    "incremental_index",
    "index_diff",
    "prepare",
    "refit_model",
    "refresh_cells",
    "stored_embedder",
    "texts_of",
]
