"""A stream of file changes applied to an index, micro-batch by micro-batch.

The last place in the stream at which each path was written or removed is keyed state: it lies in the checkpoint, split by
path like the changes, so a micro-batch tells late writes from new ones without looking into the index.
"""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions import LANGUAGES
from ..operators.changes import dedupe_last_wins
from ..operators.clean import ignore_filter
from ..operators.embed import Embedder
from ..plans.pipelines import Rules, finisher, stored_embedder
from ..sources.store import MARK_DAYS, IndexStore, order_key

# The state store that keyed state with an age needs; and no micro-batches without data, which state with an age
# would ask for again and again, so that a run over what is available would never end.
_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
_PLACED = "file_path string, change string, content string, seq string"


def last_place(mark_days: int = MARK_DAYS) -> StatefulProcessor:
    """Lets the last change of each path pass if it comes after all that were seen before.

    The place of a path that is there is kept for ever, that of a removed one for ``mark_days``. The class is made here so that it
    is sent as it is: the process that sets up its state does not have the files a session was given.
    """

    class LastPlace(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.there = handle.getValueState("there", "seq string")
            self.removed = handle.getValueState("removed", "seq string", ttlDurationMs=mark_days * 86_400_000)

        def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
            last = None
            for batch in rows:
                found = batch.loc[batch["seq"].idxmax()]
                if last is None or found["seq"] > last["seq"]:
                    last = found
            if last is None or last["seq"] <= self._seen():
                return
            self._keep(last["seq"], last["change"] == "D")
            yield pd.DataFrame([last[["file_path", "change", "content", "seq"]].to_dict()])

        def handleInitialState(self, key, initialState, timerValues):  # noqa: N802, N803
            self._keep(initialState["stored_seq"].max(), False)

        def _seen(self) -> str:
            found = [state.get() for state in (self.there, self.removed) if state.exists()]
            return max((row[0] for row in found), default="")

        def _keep(self, seq: str, removed: bool) -> None:
            kept, gone = (self.removed, self.there) if removed else (self.there, self.removed)
            gone.clear()
            kept.update((seq,))

        def close(self) -> None:
            pass

    return LastPlace()


def apply_batch(
    store: IndexStore,
    changes: DataFrame,
    order: list[str],
    rules: Rules = (),
    embedder: Embedder | None = None,
    stream: str = "changes",
    batch_id: int | None = None,
    languages: Mapping[str, str] = LANGUAGES,
    placed: bool = False,
) -> bool:
    """Publish ordered change rows ``(change, file_path, content)``; of several for one path the last one counts.

    That holds across batches as well: a write that comes after a later one - or after a later deletion - is dropped. A
    batch whose id was published before is skipped, so a replay after a failure changes nothing. Returns whether the batch
    was applied. ``placed`` changes are the last of each path already, with their place as ``seq``; for others the places
    stored with the index are read.
    """
    if batch_id is not None:
        done = store.last_batch(stream)
        if done is not None and batch_id <= done:
            return False
    latest = changes
    if not placed:
        latest = dedupe_last_wins(_wanted(changes, rules), order)
        latest = latest.withColumn("seq", order_key(latest, order))
        latest = latest.join(store.places(latest), "file_path", "left").filter(
            F.col("stored_seq").isNull() | (F.col("seq") > F.col("stored_seq"))
        )
    latest.persist()  # one shuffle of the batch serves paths, counts and texts
    finish = finisher(embedder or stored_embedder(store), languages)
    written, removed = latest.filter("change <> 'D'"), latest.filter("change = 'D'")
    try:
        store.publish_index(written, removed, finish=finish, stream=stream, batch_id=batch_id)
    finally:
        latest.unpersist()
    return True


def _wanted(changes: DataFrame, rules: Rules) -> DataFrame:
    return ignore_filter(changes.filter(F.col("change").isin("A", "M", "D")), rules)


def last_changes(store: IndexStore, changes: DataFrame, order: list[str], rules: Rules = (), mark_days: int = MARK_DAYS) -> DataFrame:
    """``(file_path, change, content, seq)`` of a streaming DataFrame: in every micro-batch the last change of each path, unless a later
    one was seen before. What the index knows of earlier places is read once, when the first micro-batch of a checkpoint runs.
    """
    wanted = _wanted(changes, rules).filter(F.col("file_path").isNotNull())
    keyed = wanted.select("file_path", "change", "content", order_key(wanted, order).alias("seq"))
    return keyed.groupBy("file_path").transformWithStateInPandas(
        last_place(mark_days), _PLACED, "Update", "ProcessingTime", initialState=store.all_places().groupBy("file_path")
    )


def stream_changes(
    store: IndexStore,
    changes: DataFrame,
    checkpoint: str,
    order: list[str],
    rules: Rules = (),
    embedder: Embedder | None = None,
    stream: str = "changes",
    compact_every: int = 20,
    trigger: dict | None = None,
    mark_days: int = MARK_DAYS,
) -> StreamingQuery:
    """Start applying a streaming DataFrame of changes. ``trigger`` defaults to everything available, then stop.

    The checkpoint remembers how far the source was read, and the last place of every path (:func:`last_place`); the batch id
    stored with each version makes the sink exactly once. Places of removed paths are forgotten after ``mark_days``. Every ``compact_every`` versions the changes are folded together (:meth:`IndexStore.tidy`), so that neither the
    files on disk nor the versions a reader meets grow with the age of the stream.
    """

    def publish(batch: DataFrame, batch_id: int) -> None:
        apply_batch(store, batch, order, embedder=embedder, stream=stream, batch_id=batch_id, placed=True)
        store.tidy(compact_every)

    spark = store.spark
    before = {name: spark.conf.get(name) for name in _SETTINGS}
    # A query keeps the settings it was started with.
    for name, value in _SETTINGS.items():
        spark.conf.set(name, value)
    try:
        return (
            last_changes(store, changes, order, rules, mark_days)
            .writeStream.outputMode("update")
            .foreachBatch(publish)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
