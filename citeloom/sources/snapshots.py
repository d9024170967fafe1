"""Keyed tables in parts: a batch rewrites the parts that its keys fall into, and a commit names the files that count.

A part is a hash of the key. Batch n writes ``<table>/version=n/part=p`` for the parts it touches, then its commit: one small file
that names, for every part of every table, the version to read. Readers follow the last commit, so a batch that was interrupted
before its commit leaves nothing behind that is read; tried again it overwrites its own version. A batch that was committed is
not applied again.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

COMMIT = "table string, part int, version long"


class Snapshots:
    """Tables under ``root``, each with the schema of its rows; ``key`` is the column of all of them that decides the part."""

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, StructType], key: str = "doc_id", parts: int = 64):
        self.spark, self.root, self.schemas, self.key, self.parts = spark, root.rstrip("/"), schemas, key, parts

    def part_of(self, key: Column | str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.parts)).cast("int")

    def last_commit(self) -> int | None:
        try:
            return self.spark.read.schema(COMMIT + ", batch long").json(f"{self.root}/commits").agg(F.max("batch")).first()[0]
        except AnalysisException:  # nothing was committed yet
            return None

    def manifest(self, batch: int | None) -> dict[tuple[str, int], int]:
        """(table, part) to version as of a commit: tables times parts entries."""
        if batch is None:
            return {}
        rows = self.spark.read.schema(COMMIT).json(f"{self.root}/commits/batch={batch}").collect()
        return {(r["table"], r["part"]): r["version"] for r in rows}

    def read(self, table: str, batch: int | None, only: list[int] | None = None) -> DataFrame:
        """A table as of a commit, or ``only`` some of its parts."""
        chosen = sorted((v, p) for (t, p), v in self.manifest(batch).items() if t == table and (only is None or p in only))
        if not chosen:
            return self.spark.createDataFrame([], self.schemas[table])
        paths = [f"{self.root}/{table}/version={version}/part={part}" for version, part in chosen]
        return self.spark.read.schema(self.schemas[table]).parquet(*paths)

    def touched(self, keys: DataFrame) -> list[int]:
        """The parts of some keys; as many numbers as there are parts at most."""
        return sorted(r["part"] for r in keys.select(self.part_of(self.key).alias("part")).distinct().collect())

    def commit(self, batch: int, before: int | None, tables: dict[str, DataFrame], touched: list[int]) -> None:
        """Replace the touched parts of the given tables by their rows; everything else stays as it was at ``before``."""
        entries = {k: v for k, v in self.manifest(before).items() if k[0] not in tables or k[1] not in touched}
        for name, rows in tables.items():
            path = f"{self.root}/{name}/version={batch}"
            placed = rows.select(*self.schemas[name].fieldNames()).withColumn("part", self.part_of(self.key)).where(F.col("part").isin(touched))
            # Several tasks may share a part, so a hot key does not hold up one of them.
            placed.write.mode("overwrite").partitionBy("part").parquet(path)
            written = self.spark.read.schema(StructType([*self.schemas[name].fields]).add("part", "integer")).parquet(path)
            entries |= {(name, r["part"]): batch for r in written.select("part").distinct().collect()}
        rows = [(t, p, v) for (t, p), v in sorted(entries.items())]
        self.spark.createDataFrame(rows, COMMIT).coalesce(1).write.mode("overwrite").json(f"{self.root}/commits/batch={batch}")
