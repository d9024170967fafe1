"""Composite jobs: discover, resolve, select, ingest, curate, rebuild."""

from __future__ import annotations

import time
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.config import DEFAULTS, Settings
from citeloom.functions.scoring import TierThresholds
from citeloom.operators import catalog, curate, extract, lexical, queue, resolve, select, upsert
from citeloom.operators.chunking import chunk_sections, extract_sections
from citeloom.operators.graph import GraphState, fold_batch, reference_events, resolution_events
from citeloom.operators.models import Embedder, embed
from citeloom.schemas import PAPERS
from citeloom.operators.ordered import first_in_order, is_small, keyed_join
from citeloom.session import materialize, materialize_observed, small_batches
from citeloom.sources.files import is_written, numbered, paper_id_lines, read_references, read_resolutions, require_rows, write_run


# --- discover and resolve ------------------------------------------------------------------------------------


def discover_in_texts(texts: DataFrame, source_kind: str, discovered_at: int) -> tuple[DataFrame, DataFrame]:
    """(seed records, references) of landed README texts (source_repo, source_url, found_in, text)."""
    records = extract.mine_texts(texts)
    return records, extract.references_from_texts(records, source_kind, discovered_at)


def discover_in_pages(pages: DataFrame, source_kind: str, discovered_at: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(link records, references, self-resolving references) of landed pages (page_url, html)."""
    links = extract.mine_pages(pages)
    return (
        links, extract.references_from_pages(links, source_kind, discovered_at),
        extract.resolutions_from_pages(links, source_kind),
    )


@dataclass(frozen=True)
class Resolution:
    records: DataFrame
    resolutions: DataFrame
    pdf_urls: DataFrame
    paper_ids: DataFrame
    totals: DataFrame


def resolve_from_cache(dois: DataFrame, cache: DataFrame, resolved_at: int) -> Resolution:
    resolved = materialize(resolve.resolve_dois(dois, cache), "resolved")
    known = resolved.filter(F.col("cache_state") == "resolved")
    return Resolution(
        known, resolve.resolution_rows(resolved, resolved_at), resolve.pdf_url_list(resolved),
        resolve.sorted_unique(known, "arxiv_id"), resolve.resolution_totals(resolved),
    )


def record_run(
    spark, rows: DataFrame, kind: str, state: GraphState, root: str, run_id: str, now_unix: int, settings: Settings = DEFAULTS,
    resume: bool = False,
) -> GraphState:
    """State after one run of discovered ``references`` or of ``resolutions`` (``kind``).

    The rows are written in the order of ``seq`` as the run's artifact, which is immutable; the fold and the event log
    read the artifact, so a state can be rebuilt from artifacts alone. A run id that exists is refused before anything
    else is written. ``resume`` goes on with a run that was interrupted: what it has written whole is kept, the rest is written.
    """
    if not (resume and is_written(spark, f"{root}/{kind}", run_id)):
        # A global sort reads its input twice; the second time it is read as it was stored.
        write_run(materialize(rows, kind).orderBy("seq").drop("seq"), f"{root}/{kind}", run_id, again=resume)
    path = f"{root}/{kind}/run_id={run_id}"
    if kind == "references":
        landed = materialize(numbered(read_references(spark, path).drop("run_id")), "run")
        events, inputs = reference_events(landed, run_id), (landed, None)
    elif kind == "resolutions":
        landed = materialize(numbered(read_resolutions(spark, path)), "run")
        events, inputs = resolution_events(landed, run_id, now_unix), (None, landed)
    else:
        raise ValueError(f"unknown kind of run: {kind}")
    if not (resume and is_written(spark, f"{root}/events/{kind}", run_id)):
        write_run(events, f"{root}/events/{kind}", run_id, again=resume)
    return fold_batch(state, *inputs, now_unix, settings)


# --- selection -----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Selection:
    papers: DataFrame
    totals: DataFrame
    migrated: DataFrame | None


def select_latest(feed: DataFrame, papers: DataFrame, limit: int, skip_ingested: bool = True, scan_cap: int | None = None) -> Selection:
    """Newest papers of a landed feed (PAPER_METADATA with seq = 0, 1, ...)."""
    known = catalog.ingested_versions(papers)
    chosen, stats = select.select_from_feed(feed, known if skip_ingested else known.limit(0), limit, scan_cap)
    return Selection(select.without_known_versions(chosen, known) if skip_ingested else chosen, stats, None)


def select_by_ids(raw_ids: DataFrame, fetched: DataFrame, papers: DataFrame, skip_ingested: bool = True) -> Selection:
    """Explicit ids (raw_id, seq) against landed metadata; legacy rows get their version first."""
    known, migrated = catalog.ingested_versions(papers), None
    if skip_ingested:
        by_base = select.match_requested(
            catalog.legacy_unversioned(papers).select(F.col("arxiv_id").alias("requested_id"), F.lit(0).alias("seq")), fetched, True
        )
        migrated = select.migrate_legacy(catalog.legacy_unversioned(papers), by_base)
        moved = migrated.filter(F.col("outcome") == "migrated").select("arxiv_id_with_version")
        known = known.unionByName(moved).distinct()
    matched = materialize(select.match_requested(select.requested_ids(raw_ids), fetched, upgrade=skip_ingested), "matched")
    remaining = select.without_known_versions(matched, known) if skip_ingested else matched
    return Selection(remaining, select.selection_totals(matched, remaining), migrated)


def select_from_lines(lines: DataFrame, fetched: DataFrame, papers: DataFrame, limit: int | None = None, skip_ingested: bool = True) -> tuple[Selection, DataFrame]:
    """(selection, one row with the number of skipped lines) of JSON lines (line, seq): the first ``limit`` different ids in the
    order of the lines."""
    ids, skipped = paper_id_lines(lines)
    ids = ids if limit is None else first_in_order(ids, "seq", limit)
    return select_by_ids(ids.select(F.col("paper_id").alias("raw_id"), "seq"), fetched, papers, skip_ingested), skipped


# --- ingest --------------------------------------------------------------------------------------------------

HASHED = 8  # times its measured bytes that a column of short keys takes as a broadcast hash table, at most


@dataclass(frozen=True)
class Library:
    """Everything ingestion reads and writes, as one snapshot. ``index`` is the forward index of the chunks."""

    graph: GraphState
    papers: DataFrame
    chunks: DataFrame
    vectors: DataFrame
    metrics: DataFrame
    index: DataFrame


def chunk_papers(papers: DataFrame, fulltexts: DataFrame, settings: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """(chunks, errors) of papers (doc_id, arxiv_id, title, file_stem) from (file_stem, xml).

    A paper whose text is absent or unreadable gives an error row and touches nothing else.
    """
    small_batches(papers.sparkSession)
    texts = keyed_join(papers, fulltexts.select("file_stem", "xml"), "file_stem", "left")
    parsed = texts.withColumn("__s", extract_sections("xml")).select("*", "__s.sections", "__s.error").drop("__s", "xml")
    missing = F.when(F.col("sections").isNull(), "full text not found")
    errors = parsed.select("doc_id", F.coalesce("error", missing).alias("error")).filter(F.col("error").isNotNull())
    good = parsed.filter(F.col("error").isNull())
    return chunk_sections(good, settings.chunk_max_chars, settings.chunk_overlap_chars), errors


def ingest_batch(
    library: Library, selected: DataFrame, fulltexts: DataFrame, now_unix: int, embedder: Embedder | None = None,
    cache_only: bool = False, settings: Settings = DEFAULTS,
) -> tuple[Library, DataFrame]:
    """(next library, outcomes) of one queue batch. ``outcomes`` holds doc_id, outcome and reason per candidate."""
    listed = queue.to_papers(selected, library.graph.documents)
    if cache_only:
        listed = queue.require_cached(listed, fulltexts)
    listed = materialize(listed, "queue-batch")
    papers = listed.filter(F.col("blocked_reason").isNull())
    # Of a small batch only its own texts are shuffled; the full-text table is filtered by its stems.
    stems = papers.select("file_stem")
    if is_small(stems, settings.max_broadcast_bytes // HASHED):
        fulltexts = fulltexts.join(F.broadcast(stems), "file_stem", "left_semi")
    chunks, errors = chunk_papers(papers, fulltexts, settings)
    chunks = materialize(
        embed(chunks, "text", "embedding", embedder, settings.embed_batch_size).withColumn("seq", F.col("chunk_index").cast("long")),
        "chunks",
    )
    failed = errors.select("doc_id", F.lit("pipeline_failed").alias("failure"))
    outcomes = materialize(
        keyed_join(listed, failed, "doc_id", "left").select(
            "doc_id",
            F.when(F.col("blocked_reason").isNotNull(), "blocked").when(F.col("failure").isNotNull(), "failed")
            .otherwise("ingested").alias("outcome"),
            F.coalesce("blocked_reason", "failure").alias("reason"),
        ),
        "outcomes",
    )
    with_text = keyed_join(papers, chunks.select("doc_id").distinct(), "doc_id", "left_semi")
    empty = F.lit(None).cast("string")
    rows = with_text.select(
        "arxiv_id", "doc_id", "arxiv_id_with_version", empty.alias("version"), "title", F.lit("").alias("summary"),
        empty.alias("published"), empty.alias("updated"), F.array().cast("array<string>").alias("authors"), "pdf_url", "abs_url",
        F.concat("file_stem", F.lit(".pdf")).alias("pdf_path"), F.concat("file_stem", F.lit(".tei.xml")).alias("tei_path"),
        "provenance_kind", empty.alias("content_sha256"), F.lit(0).cast("long").alias("seq"),
    )
    results = outcomes.select("doc_id", F.col("outcome").alias("status"), "reason", F.lit(0).alias("seq"))
    candidates = queue.apply_results(library.graph.candidates, results, now_unix, settings)
    documents = queue.apply_results_to_documents(library.graph.documents, candidates, results, now_unix)
    chunk_rows = chunks.select(*library.chunks.columns, "seq")
    return (
        Library(
            GraphState(documents, library.graph.sources, candidates),
            upsert.upsert_papers(library.papers, rows).select(*PAPERS.fieldNames()),
            upsert.upsert_chunks(library.chunks, chunk_rows),
            upsert.upsert_vectors(library.vectors, chunks.select("chunk_id", "embedding", "seq"), dimension=settings.embedding_dimension),
            library.metrics,
            lexical.refresh_index(library.index, chunk_rows),
        ),
        outcomes,
    )


def checkpointed(library: Library, name: str) -> Library:
    """Write a library as tables, so that a long loop starts each round from files."""

    def cut(df: DataFrame, part: str) -> DataFrame:
        return materialize(df, f"{name}-{part}")

    graph = library.graph
    return Library(
        GraphState(cut(graph.documents, "documents"), cut(graph.sources, "sources"), cut(graph.candidates, "candidates")),
        cut(library.papers, "papers"), cut(library.chunks, "paper-chunks"), cut(library.vectors, "vectors"),
        cut(library.metrics, "metrics"), cut(library.index, "index"),
    )


def drain_queue(
    library: Library, fulltexts: DataFrame, now_unix: int, embedder: Embedder | None = None, cache_only: bool = False,
    settings: Settings = DEFAULTS,
) -> tuple[Library, list[dict]]:
    """Ingest until no candidate is ready: (library, totals per pass).

    Every attempt takes its candidate off the ready list, so the loop ends; by default one pass takes the whole list.
    ``settings.queue_batch_size`` cuts it into passes, each of which writes the library anew.
    """
    rounds: list[dict] = []
    while True:
        batch = materialize(
            queue.ready_candidates(library.graph.candidates, settings.queue_batch_size, now_unix), "selected"
        )
        if batch.isEmpty():
            return library, rounds
        library, outcomes = ingest_batch(library, batch, fulltexts, now_unix, embedder, cache_only, settings)
        library = checkpointed(library, "library")
        rounds.append(queue.ingest_totals(outcomes).first().asDict())


# --- curate --------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Curation:
    metrics: DataFrame
    totals: DataFrame
    tiers: DataFrame


def curate_corpus(
    papers: DataFrame, metrics: DataFrame, catalogue: DataFrame, venues: DataFrame, now_unix: int, current_year: int,
    refresh_days: int = 30, limit: int | None = None, skip_non_curatable: bool = True,
    thresholds: TierThresholds = TierThresholds(),
) -> Curation:
    """Refresh stale metrics from a landed metadata catalogue (paper_key, payload)."""
    ids = catalog.paper_ids(papers, limit)
    chosen = curate.curatable(ids) if skip_non_curatable else ids
    due = curate.stale_or_missing(chosen, metrics, refresh_days, now_unix)
    rows = materialize(
        curate.metric_rows(curate.look_up(due, catalogue), venues, now_unix, current_year, thresholds), "metrics"
    )
    merged = upsert.upsert_metrics(metrics, rows.withColumn("seq", F.lit(0).cast("long")))
    n = F.count(F.lit(1))
    totals = (
        ids.agg(n.alias("total_ids"))
        .select(
            "total_ids", due.agg(n).scalar().alias("to_refresh"), rows.agg(n).scalar().alias("updated"),
            chosen.agg(n).scalar().alias("curatable"),
        )
        .select(
            "total_ids", "to_refresh", "updated", (F.col("total_ids") - F.col("updated")).alias("skipped"),
            (F.col("total_ids") - F.col("curatable")).alias("skipped_non_curatable"),
        )
    )
    return Curation(merged, totals, curate.tier_distribution(merged))


# --- rebuild -------------------------------------------------------------------------------------------------


def restore_graph(spark, references: list[DataFrame], resolutions: list[DataFrame], now_unix: int, settings: Settings = DEFAULTS) -> GraphState:
    """State recomputed from run artifacts alone. Each artifact carries ``seq``; artifacts apply in list order."""
    if not references and not resolutions:
        raise FileNotFoundError("no run artifacts to rebuild from")

    def in_order(parts: list[DataFrame]) -> DataFrame | None:
        spaced = [df.withColumn("seq", F.col("seq") + F.lit(i * (1 << 40))) for i, df in enumerate(parts)]
        out = spaced[0] if spaced else None
        for df in spaced[1:]:
            out = out.unionByName(df, allowMissingColumns=True)
        return out

    return fold_batch(GraphState.empty(spark), in_order(references), in_order(resolutions), now_unix, settings)


def rebuild(
    spark, references: list[DataFrame], resolutions: list[DataFrame], empty: Library, fulltexts: DataFrame, catalogue: DataFrame,
    venues: DataFrame, now_unix: int, current_year: int, embedder: Embedder | None = None, settings: Settings = DEFAULTS,
) -> tuple[Library, DataFrame]:
    """Restore, drain the queue, curate: (library, step report). Results are new tables; nothing is deleted."""
    report: list[tuple[str, str, float, str]] = []

    def step(name: str, work):
        started = time.monotonic()
        result, details = work()
        report.append((name, "ok", time.monotonic() - started, details))
        return result

    # Checks and folds read an artifact several times, so it is derived once.
    references = [materialize(part, "references") for part in references]
    resolutions = [materialize(part, "resolutions") for part in resolutions]
    for part in references + resolutions:
        require_rows(part, "run artifact")

    def restore():
        graph = restore_graph(spark, references, resolutions, now_unix, settings)
        documents, seen = materialize_observed(graph.documents, "restored-documents", n=F.count(F.lit(1)))
        library = checkpointed(replace(empty, graph=replace(graph, documents=documents)), "restored")
        return library, f"documents={seen['n']}"

    library = step("restore", restore)

    def drain():
        drained, rounds = drain_queue(library, fulltexts, now_unix, embedder, settings=settings)
        return drained, f"loops={len(rounds)} ingested={sum(r['ingested'] for r in rounds)}"

    library = step("ingest", drain)

    def metrics():
        done = curate_corpus(library.papers, library.metrics, catalogue, venues, now_unix, current_year)
        table, seen = materialize_observed(done.metrics, "curated", n=F.count(F.lit(1)))
        return replace(library, metrics=table), f"metrics={seen['n']}"

    library = step("curate", metrics)
    steps = spark.createDataFrame(report, "step string, status string, seconds double, details string")
    return library, materialize(steps, "rebuild-report")
