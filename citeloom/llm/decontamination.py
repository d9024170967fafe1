"""Benchmark decontamination: MinHash containment search partitioned by size, confirmed on full shingle sets.

A set of a few dozen shingles inside a document of thousands has almost no Jaccard similarity to it, so both sides are
cut by size. Items fall into classes by powers of two of their set size; for class ``u`` a document is seen as windows
of ``2 u`` shingles, one every ``u``, so that any run as long as an item of the class lies within one window. An item
of which the share ``least`` stands in a window has a Jaccard similarity of at least 0.19 to it, and one of
``coordinates`` MinHash values agrees unless that fails 64 times (a chance near 10^-6).

A MinHash value is the hash of one member, its witness. A window that shares a value holds the witness, so only
windows that hold a witness of an item of their class get signatures: one pass over the shingles with a hash lookup
finds them. Candidates then are pairs with an equal coordinate, and a pair counts if the item's distinct shingles,
compared as strings over the whole document, are contained to ``least`` or more.

Words are runs of letters and digits in lower case. Edge cases: texts that are null, empty or shorter than one
shingle match nothing. Rows with one document id are one document, and so are, for ``contained_items``, those without an
id. Rows with one item id are one item, and items with equal texts each get their rows. ``contained_items`` names no
items without an id; ``clean_documents`` takes each text without an id as an item, or a document, of its own. Empty
tables give no rows. Columns other than ids and texts are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.session import materialize

COORDINATES = 64
BROADCAST_ROWS = 1_000_000


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _positions(words: str, width: int) -> Column:
    n = F.size(words)
    return F.when(n >= width, F.sequence(F.lit(0), n - width))


def _shingle_hash(words: str, at: str, width: int) -> Column:
    return F.xxhash64(*[F.get(F.col(words), F.col(at) + i) for i in range(width)])


def _hash_rows(rows: DataFrame, width: int) -> DataFrame:
    """One row per shingle: position and hash. explode_outer, because explode would read the words twice."""
    return rows.withColumn("at", F.explode_outer(_positions("words", width))).where("at is not null").withColumn(
        "h", _shingle_hash("words", "at", width)
    )


def _signature(rows: DataFrame, keys: list[str], coordinates: int) -> DataFrame:
    """MinHash coordinates of the hashes ``h`` of each key as rows: k, value."""
    minima = rows.groupBy(*keys).agg(*[F.min(F.xxhash64("h", F.lit(k))).alias(f"m{k}") for k in range(coordinates)])
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"m{k}").alias("value")) for k in range(coordinates)])
    return minima.select(*keys, F.inline(pairs))


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast only what was counted; a larger side is shuffled."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _key(column: str, text: str, alone: bool = False) -> Column:
    """An id as a join key that is never null. ``alone``: texts without an id have a key each."""
    none = F.col(column).isNull()
    own = F.when(none, F.sha2(F.coalesce(text, F.lit("")), 256)) if alone else F.lit(None).cast("string")
    return F.struct(none.alias("none"), F.col(column).alias("id"), own.alias("own"))


def _shingles(rows: DataFrame, keys: list[str], width: int) -> DataFrame:
    words = rows.select(*keys, words_of(F.col("text")).alias("words"))
    placed = words.withColumn("at", F.explode_outer(_positions("words", width))).where("at is not null")
    return placed.select(*keys, F.array_join(F.slice("words", F.col("at") + 1, width), " ").alias("shingle")).distinct()


def _contained(documents: DataFrame, items: DataFrame, least: float, width: int, coordinates: int, broadcast_rows: int) -> DataFrame:
    """(doc, item, n_shingles, n_shared, containment) for documents (doc, text) and items (item, text); no key is null."""
    item_rows = items.select("item", words_of(F.col("text")).alias("words"))
    item_set = _hash_rows(item_rows, width).select("item", "h", F.array_join(
        F.slice("words", F.col("at") + 1, width), " ").alias("shingle")).distinct()
    sizes = item_set.groupBy("item").agg(F.count(F.lit(1)).alias("n_shingles"))
    sizes = sizes.withColumn("u", F.pow(F.lit(2), F.ceil(F.log2("n_shingles"))).cast("int"))
    item_set = materialize(item_set.join(sizes, "item"), "decon-items")
    item_signature = materialize(_signature(item_set, ["item", "u"], coordinates), "decon-signatures")

    own = item_set.select("item", "u", "h", F.explode(F.sequence(F.lit(0), F.lit(coordinates - 1))).alias("k"))
    witnesses = materialize(
        own.withColumn("value", F.xxhash64("h", "k")).join(item_signature, ["item", "u", "k", "value"], "left_semi")
        .select("h", "u").distinct(), "decon-witnesses",
    )
    texts = documents.select("doc", "text")
    shingles = _hash_rows(texts.select("doc", words_of(F.col("text")).alias("words")), width).select("doc", "at", "h")
    met = shingles.join(_bounded(witnesses, broadcast_rows), "h")
    block = F.floor(F.col("at") / F.col("u")).cast("int")
    windows = met.select("doc", "u", F.explode(F.array(block, block - 1)).alias("w")).where("w >= 0").distinct()
    windows = materialize(windows, "decon-windows")
    touched = materialize(
        texts.join(windows.select("doc").distinct(), "doc", "left_semi")
        .select("doc", words_of(F.col("text")).alias("words")), "decon-documents",
    )

    cut = touched.join(windows, "doc").select(
        "doc", "u", "w", F.slice("words", F.col("w") * F.col("u") + 1, 2 * F.col("u") + width - 1).alias("words")
    )
    window_signature = _signature(_hash_rows(cut, width), ["doc", "u", "w"], coordinates)
    candidates = materialize(
        window_signature.join(_bounded(item_signature, broadcast_rows), ["u", "k", "value"]).select("doc", "item").distinct(),
        "decon-candidates",
    )

    wanted = candidates.join(item_set.select("item", "shingle", "n_shingles"), "item")
    present = touched.join(candidates.select("doc").distinct(), "doc", "left_semi")
    present = present.withColumn("at", F.explode_outer(_positions("words", width))).where("at is not null").select(
        "doc", F.array_join(F.slice("words", F.col("at") + 1, width), " ").alias("shingle")
    ).distinct()
    shared = wanted.join(present, ["doc", "shingle"]).groupBy("doc", "item", "n_shingles").agg(
        F.count(F.lit(1)).alias("n_shared")
    )
    return shared.withColumn("containment", F.col("n_shared") / F.col("n_shingles")).where(F.col("containment") >= least)


def contained_items(
    documents: DataFrame, items: DataFrame, least: float = 0.8, width: int = 5, coordinates: int = COORDINATES,
    id_col: str = "doc_id", item_col: str = "item_id", text: str = "text", broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """(doc id, item id, n_shingles, n_shared, containment) of every item contained to ``least`` or more."""
    named = F.col(id_col).isNotNull()
    wanted = items.where(F.col(item_col).isNotNull()).select(_key(item_col, text).alias("item"), F.col(text).alias("text"))
    found = _contained(
        documents.where(named).select(_key(id_col, text).alias("doc"), F.col(text).alias("text")), wanted,
        least, width, coordinates, broadcast_rows,
    )
    # The rows without an id are one document of any length, which windows would not fit: its shingles are all compared.
    shingles = _shingles(wanted, ["item"], width)
    sizes = shingles.groupBy("item").agg(F.count(F.lit(1)).alias("n_shingles"))
    held = _shingles(documents.where(~named).select(_key(id_col, text).alias("doc"), F.col(text).alias("text")), ["doc"], width)
    shared = held.join(shingles, "shingle").groupBy("doc", "item").agg(F.count(F.lit(1)).alias("n_shared")).join(sizes, "item")
    nameless = shared.withColumn("containment", F.col("n_shared") / F.col("n_shingles")).where(F.col("containment") >= least)
    found = found.unionByName(nameless)
    return found.select(F.col("doc.id").alias(id_col), F.col("item.id").alias(item_col), "n_shingles", "n_shared", "containment")


def clean_documents(
    documents: DataFrame, items: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text: str = "text",
    least: float = 0.8, width: int = 5, coordinates: int = COORDINATES, broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """The documents that contain no item; all rows of an id go or stay together, rows without an id by their texts."""
    keyed = documents.withColumn("__doc", _key(id_col, text, alone=True))
    leaks = _contained(
        keyed.select(F.col("__doc").alias("doc"), F.col(text).alias("text")),
        items.select(_key(item_col, text, alone=True).alias("item"), F.col(text).alias("text")),
        least, width, coordinates, broadcast_rows,
    ).select(F.col("doc").alias("__doc")).distinct()
    return keyed.join(leaks, "__doc", "left_anti").select(*documents.columns)
