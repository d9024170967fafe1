"""Incremental forms of the batch jobs on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from citeloom.config import DEFAULTS, Settings
from citeloom.operators.chunking import chunk_sections
from citeloom.operators.graph import GraphState, fold_batch, operations_of
from citeloom.operators.lexical import chunk_postings, forward_index, posting_rows
from citeloom.operators.models import Embedder, embed
from citeloom.operators.ordered import measured_broadcast
from citeloom.schemas import CANDIDATES, DOCUMENT_SOURCES, DOCUMENTS, REFERENCES, STREAMED_CHUNKS, STREAMED_POSTINGS, STREAMED_VECTORS
from citeloom.session import materialize, shared_folder
from citeloom.sources.files import numbered
from citeloom.sources.snapshots import Snapshots

ENRICHED = {"chunks": STREAMED_CHUNKS, "vectors": STREAMED_VECTORS, "postings": STREAMED_POSTINGS}
PARTS = {"documents": DOCUMENTS, "sources": DOCUMENT_SOURCES, "candidates": CANDIDATES}


def snapshots(spark: SparkSession, root: str, settings: Settings = DEFAULTS) -> Snapshots:
    """The canonical state as tables in parts of document ids."""
    return Snapshots(spark, root, PARTS, "doc_id", settings.snapshot_parts)


def read_snapshot(spark: SparkSession, root: str, version: int | None = None, settings: Settings = DEFAULTS) -> GraphState:
    """State after batch ``version`` (default: the last committed one); the state before the first batch is empty."""
    store = snapshots(spark, root, settings)
    version = store.last_commit() if version is None else version if version >= 0 else None
    return GraphState(*[store.read(name, version) for name in PARTS])


def batch_time(spark: SparkSession, root: str, batch_id: int, now_unix: Callable[[], int]) -> int:
    """The time of a batch, written when the batch is first tried and read when it is tried again."""
    path = f"{root}/times/batch={batch_id}"
    try:
        return spark.read.schema("now_unix long").json(path).first()["now_unix"]
    except AnalysisException:  # the batch has not been tried yet
        spark.createDataFrame([(now_unix(),)], "now_unix long").coalesce(1).write.mode("overwrite").json(path)
    return spark.read.schema("now_unix long").json(path).first()["now_unix"]


def fold_references_stream(
    spark: SparkSession, source: DataFrame, root: str, now_unix: Callable[[], int], settings: Settings = DEFAULTS
) -> StreamingQuery:
    """Fold new reference artifacts into the canonical state, each batch once.

    A batch reads and rewrites the parts of the state that its documents fall into, and commits them together. A batch that was
    committed is passed over; one that failed before is done again at the time of its first try, with the same result.
    ``source`` is REFERENCES with ``seq``, or comes from ``reference_stream``.
    """
    root = root.rstrip("/")
    store = snapshots(spark, root, settings)

    def fold(batch: DataFrame, batch_id: int) -> None:
        before = store.last_commit()
        if before is not None and before >= batch_id:
            return
        if "seq" not in batch.columns:
            at = F.struct("file", "block", F.monotonically_increasing_id().alias("line"))
            batch = numbered(batch.withColumn("seq", at))
        batch = materialize(batch, "references")
        now = batch_time(spark, root, batch_id, now_unix)
        touched = store.touched(operations_of(batch, None, now))
        state = fold_batch(GraphState(*[store.read(name, before, touched) for name in PARTS]), batch, None, now, settings)
        store.commit(batch_id, before, {name: getattr(state, name) for name in PARTS}, touched)

    return (
        source.writeStream.foreachBatch(fold)
        .option("checkpointLocation", f"{root}/_progress")
        .trigger(availableNow=True)
        .start()
    )


def reference_stream(spark: SparkSession, runs: str) -> DataFrame:
    """Run artifacts as a stream with the place of every row; rows of a batch are numbered in file order."""
    rows = spark.readStream.schema(REFERENCES).json(runs)
    return rows.select(
        *REFERENCES.fieldNames(), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    )


ATTEMPT_STATE = "retry_count int, status string, at_unix long, last_seq long"
ATTEMPT_ROWS = "doc_id {id_type}, status string, retry_count int, next_retry_unix long, last_seq long"


def candidate_lifecycle(results: DataFrame, settings: Settings = DEFAULTS, timeout_ms: int | None = None) -> DataFrame:
    """Running candidate state per document from a stream of attempts (doc_id, status, seq, at_unix).

    The attempt with the largest ``seq`` decides the status, also if older ones arrive in later batches; late ones
    still count as retries. The state is an aggregate, so the attempts of a batch are folded in the tasks that read them and a
    document that many attempts name costs one row per task.

    With ``timeout_ms`` a blocked candidate whose document stays silent is reported as 'retry_due'; this takes a Python step per document.
    """
    retries, wait = max(settings.candidate_max_retries, 1), max(settings.candidate_retry_days, 1) * 86400
    if timeout_ms is None:
        return _running_candidates(results, retries, wait)
    id_type = results.schema["doc_id"].dataType.simpleString()

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, status, at, last_seq = state.get if state.exists else (0, "discovered", None, None)
        if state.hasTimedOut:
            state.remove()
            due = None if at is None else at + wait
            yield pd.DataFrame([(key[0], "retry_due", count, due, last_seq)], columns=list(columns)).astype(columns)
            return
        # One frame at a time: a document with many attempts never sits in memory as a whole.
        for rows in frames:
            count += int(rows["status"].isin(["blocked", "failed"]).sum())
            last = rows.loc[rows["seq"].idxmax()]
            if last_seq is None or last["seq"] > last_seq:
                last_seq, status, at = int(last["seq"]), last["status"], int(last["at_unix"])
        due = None
        if status in ("blocked", "failed"):
            status, due = ("failed", None) if count >= retries else ("blocked", at + wait)
        state.update((count, status, at, last_seq))
        if status == "blocked":
            state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame([(key[0], status, count, due, last_seq)], columns=list(columns)).astype(columns)

    columns = {"doc_id": "object", "status": "object", "retry_count": "int32", "next_retry_unix": "Int64", "last_seq": "Int64"}
    return results.groupBy("doc_id").applyInPandasWithState(
        advance, ATTEMPT_ROWS.format(id_type=id_type), ATTEMPT_STATE, "update", GroupStateTimeout.ProcessingTimeTimeout
    )


def _running_candidates(results: DataFrame, retries: int, wait: int) -> DataFrame:
    """(ATTEMPT_ROWS) from the number of bad attempts and the last attempt of every document."""
    folded = results.groupBy("doc_id").agg(
        F.count_if(F.col("status").isin("blocked", "failed")).cast("int").alias("retry_count"),
        F.max(F.struct(F.col("seq").cast("long").alias("seq"), F.col("at_unix").cast("long").alias("at_unix"), "status")).alias("last"),
    )
    bad, spent = F.col("last.status").isin("blocked", "failed"), F.col("retry_count") >= retries
    return folded.select(
        "doc_id", F.when(bad & spent, "failed").when(bad, "blocked").otherwise(F.col("last.status")).alias("status"), "retry_count",
        F.when(bad & ~spent, F.col("last.at_unix") + wait).alias("next_retry_unix"), F.col("last.seq").alias("last_seq"),
    )


TIMED_STATE = "retry_count int, status string, at_unix long, last_seq long"
TIMED_ROWS = "doc_id {id_type}, status string, retry_count int, next_retry_unix long, last_seq long"


class RetryTimers(StatefulProcessor):
    """Candidate state per document with a timer for its next retry.

    Attempts are taken in the order of ``seq``, whatever order they come in. A blocked candidate registers a timer in event time; a
    newer attempt replaces it, and when the watermark passes it the candidate is reported as 'retry_due'.
    """

    def __init__(self, columns: dict[str, str], retries: int, wait: int):
        self.columns, self.retries, self.wait = columns, retries, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("candidate", TIMED_STATE)

    def _due(self, status: str, at: int | None) -> int | None:
        return None if status != "blocked" or at is None else at + self.wait

    def _rows(self, key, status: str, count: int, due: int | None, last_seq: int | None) -> pd.DataFrame:
        return pd.DataFrame([(key[0], status, count, due, last_seq)], columns=list(self.columns)).astype(self.columns)

    def _set_timer(self, due: int | None) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if due is not None:
            self.handle.registerTimer(due * 1000)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        """The batch fold's candidate: (doc_id, retry_count, status, at_unix, last_seq)."""
        row = initialState.iloc[0]
        values = (int(row["retry_count"]), row["status"], int(row["at_unix"]), int(row["last_seq"]))
        self.state.update(values)
        self._set_timer(self._due(values[1], values[2]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        count, status, at, last_seq = self.state.get() if self.state.exists() else (0, "discovered", None, None)
        for frame in rows:
            count += int(frame["status"].isin(["blocked", "failed"]).sum())
            last = frame.loc[frame["seq"].idxmax()]
            if last_seq is None or last["seq"] > last_seq:
                last_seq, status, at = int(last["seq"]), last["status"], int(last["at_unix"])
        if status in ("blocked", "failed"):
            status = "failed" if count >= self.retries else "blocked"
        self.state.update((count, status, at, last_seq))
        due = self._due(status, at)
        self._set_timer(due)
        yield self._rows(key, status, count, due, last_seq)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        count, status, at, last_seq = self.state.get()
        self.state.update((count, "retry_due", at, last_seq))
        yield self._rows(key, "retry_due", count, self._due(status, at), last_seq)

    def close(self) -> None:
        pass


def retry_timers(
    results: DataFrame, event_time: str, watermark: str, initial: DataFrame | None = None, settings: Settings = DEFAULTS
) -> DataFrame:
    """Candidate state per document, and 'retry_due' when its wait is over in event time.

    ``results``: doc_id, status, seq, at_unix and the event time; ``initial``: candidates of a batch fold (doc_id, retry_count,
    status, at_unix, last_seq), one row per document. Needs the RocksDB state store.
    """
    columns = {"doc_id": "object", "status": "object", "retry_count": "int32", "next_retry_unix": "Int64", "last_seq": "Int64"}
    id_type = results.schema["doc_id"].dataType.simpleString()
    processor = RetryTimers(columns, max(settings.candidate_max_retries, 1), max(settings.candidate_retry_days, 1) * 86400)
    return results.withWatermark(event_time, watermark).groupBy("doc_id").transformWithStateInPandas(
        processor, TIMED_ROWS.format(id_type=id_type), "Update", "EventTime",
        initialState=None if initial is None else initial.groupBy("doc_id"),
    )


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """The state store that processors with timers need, for streams that are started inside."""
    name, store = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name)
    spark.conf.set(name, store)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def first_mentions(references: DataFrame, event_time: str, watermark: str, keys: tuple[str, ...]) -> DataFrame:
    """First mention of each key. Unlike the batch form, mentions later than the watermark are dropped."""
    return references.withWatermark(event_time, watermark).dropDuplicatesWithinWatermark(list(keys))


def enrich_documents_stream(
    documents: DataFrame, root: str, embedder: Embedder | None = None, settings: Settings = DEFAULTS
) -> StreamingQuery:
    """New documents (doc_id, arxiv_id, title, sections; one row per document and batch) to chunks, vectors and postings.

    The three tables are committed together, in parts of document ids: of a touched part, the rows of documents that come
    again are left out and the new ones added. So a shorter new text leaves no stale chunk, vector or posting, and a batch that
    is tried again after its commit changes nothing.
    """
    spark = documents.sparkSession
    store = enriched_store(spark, root, settings)

    def write(batch: DataFrame, batch_id: int) -> None:
        before = store.last_commit()
        if before is not None and before >= batch_id:
            return
        chunks = chunk_sections(batch, settings.chunk_max_chars, settings.chunk_overlap_chars)
        embedded = materialize(embed(chunks, "text", "embedding", embedder, settings.embed_batch_size), "chunks")
        fresh = {
            "chunks": embedded.drop("embedding"), "vectors": embedded.select("chunk_id", "doc_id", F.col("embedding").cast("array<float>")),
            # One row per chunk: a rewrite moves chunks, not terms.
            "postings": chunk_postings(forward_index(embedded, ["doc_id"]), ["doc_id"]),
        }
        came = materialize(batch.select("doc_id").distinct(), "documents")
        touched = store.touched(came)
        came = measured_broadcast(came, settings.max_broadcast_bytes)
        tables = {}
        for name, rows in fresh.items():
            columns = store.schemas[name].fieldNames()
            kept = store.read(name, before, touched).join(came, "doc_id", "left_anti").select(*columns)
            tables[name] = kept.unionByName(rows.select(*columns))
        store.commit(batch_id, before, tables, touched)

    return (
        documents.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{root.rstrip('/')}/_progress")
        .trigger(availableNow=True)
        .start()
    )


def enriched_store(spark: SparkSession, root: str, settings: Settings = DEFAULTS) -> Snapshots:
    return Snapshots(spark, root, ENRICHED, "doc_id", settings.snapshot_parts)


def enriched_chunks(spark: SparkSession, root: str, settings: Settings = DEFAULTS) -> DataFrame:
    """Chunks of every streamed document as of the last commit."""
    store = enriched_store(spark, root, settings)
    return store.read("chunks", store.last_commit())


def enriched_postings(spark: SparkSession, root: str, settings: Settings = DEFAULTS) -> DataFrame:
    store = enriched_store(spark, root, settings)
    return posting_rows(store.read("postings", store.last_commit()), ["doc_id"])


def enriched_vectors(spark: SparkSession, root: str, settings: Settings = DEFAULTS) -> DataFrame:
    store = enriched_store(spark, root, settings)
    return store.read("vectors", store.last_commit())


def run_to_table(stream: DataFrame, spark: SparkSession, name: str, mode: str = "append") -> DataFrame:
    """Drain a bounded stream and read what it wrote."""
    import uuid

    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    schema = stream.schema

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch_id}")

    query = (
        stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/_progress")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(schema.add("batch", "long")).parquet(f"{folder}/rows")
