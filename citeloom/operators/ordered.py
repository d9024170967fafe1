"""Order-sensitive steps without a single-task sort: first-wins dedupe, numbering, salted joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citeloom.config import DEFAULTS


def first_per_key(df: DataFrame, keys: Sequence[str], order: Column | str) -> DataFrame:
    """The first row of every key. An aggregate, so each task sends one row per key to the shuffle."""
    order = F.col(order) if isinstance(order, str) else order
    return _edge_per_key(df, keys, F.min_by, order)


def last_per_key(df: DataFrame, keys: Sequence[str], order: Column | str) -> DataFrame:
    """The last row of every key."""
    order = F.col(order) if isinstance(order, str) else order
    return _edge_per_key(df, keys, F.max_by, order)


def _edge_per_key(df: DataFrame, keys: Sequence[str], pick, order: Column) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.select(*keys).distinct()
    kept = df.groupBy(*keys).agg(pick(F.struct(*rest), order).alias("__row"))
    return kept.select(*[F.col(c) if c in keys else F.col("__row")[c].alias(c) for c in df.columns])


def first_in_order(df: DataFrame, seq: str, n: int) -> DataFrame:
    """The first ``n`` rows by a position column; every task sends its first n rows only."""
    return df.orderBy(seq).limit(max(n, 0))


def running_totals(
    df: DataFrame, seq: str, totals: dict[str, Column], bucket_rows: int = DEFAULTS.rows_per_numbering_bucket
) -> DataFrame:
    """Running sums over a whole table in the order of an integer position column.

    Positions are cut into ranges of at most ``bucket_rows``; sums run inside each range and the small
    per-range totals (one row per range) supply the offsets. No task ever sorts the table.
    """
    ranged = df.withColumn("__range", F.floor(F.col(seq) / F.lit(bucket_rows)).cast("long"))
    # Value columns become plain columns first, so that both branches share one plan.
    for name, value in totals.items():
        ranged = ranged.withColumn(f"__{name}", value.cast("long"))
    per_range = ranged.groupBy("__range").agg(*[F.sum(f"__{name}").alias(f"__sum_{name}") for name in totals])
    before = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    offsets = per_range.select(
        "__range", *[F.coalesce(F.sum(f"__sum_{name}").over(before), F.lit(0)).alias(f"__off_{name}") for name in totals]
    )
    inside = W.partitionBy("__range").orderBy(seq).rowsBetween(W.unboundedPreceding, W.currentRow)
    numbered = ranged.select(
        *df.columns, "__range", *[F.sum(f"__{name}").over(inside).alias(f"__in_{name}") for name in totals]
    )
    return numbered.join(offsets, "__range").select(
        *df.columns, *[(F.col(f"__in_{name}") + F.col(f"__off_{name}")).alias(name) for name in totals]
    )


def salted_join(big: DataFrame, small: DataFrame, on: str, spread: Sequence[str], salts: int = DEFAULTS.salts) -> DataFrame:
    """Inner join in which rows of one hot key of ``big`` go to ``salts`` tasks.

    The salt is a hash of row columns, so a re-run task routes rows the same way. ``small`` holds few rows
    per key and is repeated once per salt.
    """
    left = big.withColumn("__salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    right = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [on, "__salt"]).drop("__salt")


def is_small(df: DataFrame, limit: int) -> bool:
    """Whether the rows were measured to fit ``limit`` bytes. For stored tables: it reads them."""
    cells = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 8 for c in df.columns), F.lit(16))
    return (df.agg(F.sum(cells)).first()[0] or 0) <= limit


def measured_broadcast(df: DataFrame, limit: int) -> DataFrame:
    """A broadcast hint only for rows that were measured to fit; else Spark plans the join."""
    return F.broadcast(df) if is_small(df, limit) else df


def keyed_join(left: DataFrame, right: DataFrame, on: str, how: str) -> DataFrame:
    """A join on a key that is as frequent as the rows of a whole table: both sides are shuffled. Spark takes a stored table for as
    small as its compressed columns, and would send the keys of a corpus through the driver as a hash table of many times that size."""
    return left.join(right.hint("merge"), on, how)


def id_batches(ids: DataFrame, id_col: str, seq: str, batch_size: int) -> DataFrame:
    """Ids in order, cut into batches of a fixed size: (batch_no, ids)."""
    numbered = running_totals(ids.select(id_col, seq), seq, {"__n": F.lit(1)})
    batch = F.floor((F.col("__n") - 1) / F.lit(max(1, batch_size))).cast("long")
    in_order = F.array_sort(F.collect_list(F.struct(F.col("__n"), F.col(id_col))))
    return (
        numbered.groupBy(batch.alias("batch_no"))
        .agg(in_order.alias("__ids"))
        .select("batch_no", F.col(f"__ids.{id_col}").alias("ids"))
    )


def ranked_counts(df: DataFrame, key: str, limit: int, n_col: str = "n") -> DataFrame:
    """Largest groups first, names break ties; a limit of zero or less gives no rows."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias(n_col))
    return counts.orderBy(F.desc(n_col), F.asc(key)).limit(max(limit, 0))
