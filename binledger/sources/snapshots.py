"""Versions of the stock tables that share their files.

A store is a folder with ``data/<table>/write=<name>/`` and ``manifest/version=<n>/``. A manifest names, for every table
of its version, the folders that hold it. Tables that a version doesn't change are referred to where they are; tables
that only grow get one more folder; tables that change in place lie in buckets of a key, and only buckets
with a changed row are written anew. The manifest is written last and in one file, so a version is either
there with everything it names or not at all; the newest manifest is the current version. What a failed
write left behind is named by no manifest and read by nobody.

A version can carry the name of the batch that made it. Asked for a second time, the batch is found and not
applied again, so a job that commits by batch may be repeated after any failure. One job writes to a store at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binledger import schemas
from binledger.session import shuffles_removed
from binledger.sources.tables import Tables, laid_out_log

LOG = "stock_transaction"
#: Tables that change in place and the key whose hash names a row's bucket.
BUCKET_KEY = {
    "inventory": "product_id", "po_line": "po_line_id", "so_line": "so_line_id", "purchase_order": "po_id", "sales_order": "so_id",
}
#: Buckets of a table. A store keeps the number it was created with; more than 32 folders a table are listed by a job.
BUCKETS = 16
#: Tables written at the same time; their jobs share the cluster.
WRITERS = 6
#: What a store holds besides the stock tables: the decision on every command.
DECISIONS = "movement_decision"
DECISION_DDL = "seq BIGINT, cmd STRING, code BIGINT, reason STRING, src_before BIGINT, dst_before BIGINT, batch STRING"

_MANIFEST = "version BIGINT, batch STRING, table STRING, bucket INT, path STRING"


def schema_of(table: str) -> T.StructType:
    return T.StructType.fromDDL(DECISION_DDL) if table == DECISIONS else schemas.table_schema(table)


def bucket_of(table: str) -> Column:
    return F.pmod(F.xxhash64(BUCKET_KEY[table]), F.lit(BUCKETS)).cast("int")


class Snapshots:
    """The versions in one folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    # -- reading --

    def manifests(self) -> DataFrame:
        """Every committed version with what it is made of."""
        try:
            return self.spark.read.schema(_MANIFEST).parquet(f"{self.folder}/manifest")
        except AnalysisException as gone:
            if gone.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], _MANIFEST)

    def current(self) -> int:
        """The newest version, 0 in an empty store."""
        return self.manifests().agg(F.max("version")).first()[0] or 0

    def version_of(self, batch: str) -> int | None:
        """The version that a batch made, if it has been applied."""
        return self.manifests().where(F.col("batch") == batch).agg(F.max("version")).first()[0]

    def parts(self, version: int | None = None) -> dict[str, list[tuple[int, str]]]:
        """Buckets (-1 for tables without) and folders of every table of a version; some hundreds of names."""
        version = self.current() if version is None else version
        rows = self.manifests().where(F.col("version") == version).collect()
        if not rows:
            raise ValueError(f"no version {version} in {self.folder}")
        found: dict[str, list[tuple[int, str]]] = {}
        for r in sorted(rows, key=lambda r: (r["table"], r["bucket"], r["path"])):
            found.setdefault(r["table"], []).append((r["bucket"], r["path"]))
        return found

    def load(self, version: int | None = None) -> dict[str, DataFrame]:
        """One DataFrame per table, each with its fixed schema; the current version by default."""
        return {name: self._read(name, [p for _, p in own]) for name, own in self.parts(version).items()}

    def _read(self, table: str, paths: list[str]) -> DataFrame:
        schema = schema_of(table)
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self._parquet(table, schema, paths).select(*schema.fieldNames())

    def _parquet(self, table: str, schema: T.StructType, paths: list[str]) -> DataFrame:
        reader = self.spark.read.schema(schema).option("basePath", f"{self.folder}/data/{table}")
        return reader.parquet(*(f"{self.folder}/{p}" for p in paths))

    def log_months(self, version: int | None = None) -> DataFrame:
        """The log with ``transaction_month``, the folder name that date ranges are pruned by."""
        schema = T.StructType([*schema_of(LOG).fields, T.StructField("transaction_month", T.StringType())])
        return self._parquet(LOG, schema, [p for _, p in self.parts(version)[LOG]]).select(*schema.fieldNames())

    # -- writing --

    def _write(self, table: str, rows: DataFrame) -> str:
        path = f"data/{table}/write=w{uuid.uuid4().hex}"
        if table == LOG:
            laid_out_log(rows).write.partitionBy("transaction_type", "transaction_month").parquet(f"{self.folder}/{path}")
        elif table in BUCKET_KEY:
            dealt = rows.withColumn("bucket", bucket_of(table)).repartition("bucket")
            dealt.write.partitionBy("bucket").parquet(f"{self.folder}/{path}")
        else:
            rows.write.parquet(f"{self.folder}/{path}")
        return path

    def _commit(self, version: int, parts: Mapping[str, list[tuple[int, str]]], batch: str | None) -> int:
        rows = [(version, batch, table, bucket, path) for table, own in parts.items() for bucket, path in own]
        manifest = self.spark.createDataFrame(rows, _MANIFEST).drop("version").coalesce(1)
        manifest.write.mode("errorifexists").parquet(f"{self.folder}/manifest/version={version}")
        return version

    def create(self, tables: Tables, batch: str | None = None) -> int:
        """Write whole tables as the next version, without decisions yet."""
        def place(name: str) -> list[tuple[int, str]]:
            rows = self.spark.createDataFrame([], DECISION_DDL) if name == DECISIONS else tables[name]
            return self._placed(name, rows.select(*schema_of(name).fieldNames()), range(BUCKETS))

        return self._commit(self.current() + 1, at_once(place, [*schemas.TABLE_DDL, DECISIONS]), batch)

    def _placed(self, table: str, rows: DataFrame, buckets) -> list[tuple[int, str]]:
        with shuffles_removed(rows.sparkSession):
            path = self._write(table, rows)
        if table not in BUCKET_KEY:
            return [(-1, path)]
        schema = T.StructType([*schema_of(table).fields, T.StructField("bucket", T.IntegerType())])  # there may be no file
        held = self.spark.read.schema(schema).parquet(f"{self.folder}/{path}")
        used = {r["bucket"] for r in held.select("bucket").distinct().collect()}  # folder names
        return [(b, f"{path}/bucket={b}") for b in buckets if b in used]

    def commit(
        self, changed: Mapping[str, tuple[DataFrame, list[int]]], added: Tables, batch: str | None = None
    ) -> int:
        """The next version: ``changed`` tables in the buckets named with each, ``added`` rows behind the others.

        A batch that has been applied before changes nothing and returns its version.
        """
        done = self.version_of(batch) if batch is not None else None
        if done is not None:
            return done
        version = self.current()
        parts = self.parts(version)

        def place(name: str) -> list[tuple[int, str]]:
            columns, held = schema_of(name).fieldNames(), parts.get(name, [])
            if name in added:
                return [*held, *self._placed(name, added[name].select(*columns), [])]
            rows, buckets = changed[name]
            fresh = rows.select(*columns).where(bucket_of(name).isin(buckets))
            return [(b, p) for b, p in held if b not in set(buckets)] + self._placed(name, fresh, buckets)

        written = [*(name for name, (_, buckets) in changed.items() if buckets), *added]
        return self._commit(version + 1, parts | at_once(place, written), batch)

    def compact(self, table: str) -> int:
        """The next version with the folders of a growing table rewritten as one."""
        parts = self.parts()
        rows = self._read(table, [p for _, p in parts[table]])
        parts[table] = self._placed(table, rows, range(BUCKETS))
        return self._commit(self.current() + 1, parts, None)


def at_once[Made](place: Callable[[str], Made], names: list[str]) -> dict[str, Made]:
    """Something made for each name, some names at the same time: small jobs that would wait for each other."""
    with ThreadPoolExecutor(WRITERS) as pool:
        return dict(zip(names, pool.map(place, names), strict=True))


def touched_buckets(keys: Mapping[str, DataFrame]) -> dict[str, list[int]]:
    """For each table the buckets of some keys, in one job."""
    each = [
        rows.select(F.lit(name).alias("table"), F.pmod(F.xxhash64(rows.columns[0]), F.lit(BUCKETS)).cast("int").alias("bucket"))
        for name, rows in keys.items()
    ]
    found = reduce(DataFrame.unionAll, each).distinct().collect()  # at most BUCKETS a table
    return {name: sorted(r["bucket"] for r in found if r["table"] == name) for name in keys}
