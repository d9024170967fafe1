"""Table schemas. Sources are always read with one of these, never inferred."""

from pyspark.sql import types as T

S, L, I, D, B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


REFERENCES = _table(ref_type=S, normalized_value=S, source_kind=S, source_ref=S, discovered_at_unix=L)
RESOLUTIONS = _table(
    doc_id=S, arxiv_id=S, arxiv_id_with_version=S, doi=S, pdf_url=S, resolution_confidence=D, source_kind=S,
    resolved_at_unix=L,
)
DOCUMENTS = _table(
    doc_id=S, arxiv_id=S, arxiv_id_with_version=S, doi=S, pdf_url=S, status=S, resolution_confidence=D,
    provenance_kind=S, best_source_kind=S, created_at=L, updated_at=L,
)
DOCUMENT_SOURCES = _table(doc_id=S, source_kind=S, source_ref=S, first_seen=L, last_seen=L)
CANDIDATES = _table(
    doc_id=S, status=S, best_pdf_url=S, priority_score=D, retry_count=I, next_retry_unix=L, last_error=S, updated_at=L
)
PAPERS = _table(
    arxiv_id=S, doc_id=S, arxiv_id_with_version=S, version=S, title=S, summary=S, published=S, updated=S, authors_json=S,
    pdf_url=S, abs_url=S, pdf_path=S, tei_path=S, provenance_kind=S, content_sha256=S,
)
CHUNKS = _table(chunk_id=S, doc_id=S, arxiv_id=S, title=S, section_title=S, chunk_index=I, text=S)
METRICS = _table(
    arxiv_id=S, citation_count=I, year=I, venue=S, publication_types=S, is_peer_reviewed=I, score=D, tier=I, updated_at=L
)
VECTORS = _table(chunk_id=S, embedding=T.ArrayType(T.FloatType()))
STREAMED_CHUNKS = T.StructType([*CHUNKS.fields, T.StructField("char_start", I), T.StructField("char_end", I)])
STREAMED_VECTORS = _table(chunk_id=S, doc_id=S, embedding=T.ArrayType(T.FloatType()))
STREAMED_POSTINGS = _table(chunk_id=S, doc_id=S, n_tokens=I, terms=T.ArrayType(_table(term=S, tf=L)))
PAPER_METADATA = _table(
    arxiv_id=S, arxiv_id_with_version=S, version=S, doc_id=S, title=S, summary=S, published=S, updated=S,
    authors=T.ArrayType(S), pdf_url=S, abs_url=S,
)
METADATA_PAYLOAD = _table(citationCount=I, year=I, venue=S, publicationTypes=T.ArrayType(S))
_LOCATION = _table(pdf_url=S, landing_page_url=S, license=S, is_oa=B)
WORK = T.StructType(
    [
        T.StructField("id", S), T.StructField("ids", _table(arxiv=S)), T.StructField("best_oa_location", _LOCATION),
        T.StructField("primary_location", _LOCATION), T.StructField("locations", T.ArrayType(_LOCATION)),
        T.StructField("_status", I),
    ]
)
EVAL_CASES = _table(
    case_no=I, question=S, must_include_arxiv_ids=T.ArrayType(S), must_include_tokens=T.ArrayType(S), min_sources=I
)
ROUTER_REPLY = _table(mode=S, targets=T.ArrayType(S), k=I, max_per_doc=I, require_cross_doc=B, notes=S)
