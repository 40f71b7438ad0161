"""Tables that are changed by key: a change rewrites the buckets that it touches, and counts once it is whole.

    data/<version>/bucket=<b>/   Parquet that Spark's committer wrote, never changed
    manifest/<n>.json            the table after its n-th change: key, schema, and each bucket's version

Rows are dealt into buckets by hash of their key. A change reads its buckets, writes them as a new
version, and then adds a manifest. Readers take the latest one, so a change whose task or driver was
lost has never happened; what it left behind is in no manifest, and vacuum() deletes it. Two changes
at once can't both claim a number: the later one is refused and may be tried again. Buckets are few
enough (BUCKETS) for the driver; rows never come to it."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerloom.operators import tables
from ledgerloom.operators.inverted import path_of

BUCKETS, FILES = 64, 8
#: Length of a stored error (fixed value).
ERROR_CHARS = 4000


class Conflict(RuntimeError):
    """Another change came first."""


class KeyedTable:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        fs, manifests = path_of(spark, f"{self.folder}/manifest")
        numbers = [int(f.getPath().getName().removesuffix(".json")) for f in fs.listStatus(manifests) if f.getPath().getName().endswith(".json")]
        self.number = max(numbers)
        stored = json.loads(spark.read.text(f"{self.folder}/manifest/{self.number:012d}.json", wholetext=True).first()[0])
        self.key, self.buckets, self.versions = stored["key"], stored["buckets"], {int(b): v for b, v in stored["versions"].items()}
        self.schema = StructType.fromJson(stored["schema"])

    @classmethod
    def create(cls, rows: DataFrame, folder: str, key: list[str], buckets: int = BUCKETS) -> KeyedTable:
        made = cls.__new__(cls)
        made.spark, made.folder, made.number, made.key, made.buckets, made.versions, made.schema = rows.sparkSession, folder.rstrip("/"), 0, key, buckets, {}, rows.schema
        made.commit(range(buckets), rows)
        return made

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The table as of the latest change that this object has seen, or some of its buckets."""
        paths = [f"{self.folder}/data/{v}/bucket={b}" for b, v in sorted(self.versions.items()) if buckets is None or b in buckets]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(*paths)

    def touched(self, rows: DataFrame) -> list[int]:
        return [r[0] for r in rows.select(self.bucket()).distinct().collect()]

    def commit(self, touched, rows: DataFrame) -> None:
        """Make rows all that the touched buckets hold."""
        version, touched = uuid.uuid4().hex, list(touched)
        data = f"{self.folder}/data/{version}"
        dealt = rows.select(*(F.col(f.name).cast(f.dataType) for f in self.schema)).withColumn("bucket", self.bucket())
        # the rows of a key that many share are spread over FILES tasks
        dealt.repartition("bucket", F.pmod(F.xxhash64(*(f"`{f.name}`" for f in self.schema if "map" not in f.dataType.simpleString())), F.lit(FILES))).write.partitionBy("bucket").parquet(data)
        fs, _ = path_of(self.spark, data)
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        versions = {b: v for b, v in self.versions.items() if b not in set(touched)} | {b: version for b in touched if fs.exists(path(f"{data}/bucket={b}"))}
        stored = {"key": self.key, "buckets": self.buckets, "schema": self.schema.jsonValue(), "versions": versions}
        number = self.number + 1
        name = f"{self.folder}/manifest/{number:012d}"
        draft = path(f"{name}.{version}.draft")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(stored).encode()))
        out.close()
        try:
            fs.create(path(f"{name}.claim"), False).close()  # fails if it is there
        except Exception as lost:
            fs.delete(draft, False)
            fs.delete(path(data), True)
            raise Conflict(f"change {number} of {self.folder} came first") from lost
        fs.rename(draft, path(f"{name}.json"))
        self.number, self.versions = number, versions

    def change(self, rows: DataFrame, new: Callable[[DataFrame], DataFrame]) -> None:
        """Replace what the buckets of rows hold by new(what they hold)."""
        touched = self.touched(rows)
        if touched:
            self.commit(touched, new(self.read(touched)))

    def upsert(self, rows: DataFrame, created: str | None = None, updated: str | None = None, now: Column | None = None) -> None:
        self.change(rows, lambda old: tables.upsert(old, rows, self.key, created, updated, now))

    def insert_missing(self, rows: DataFrame) -> None:
        self.change(rows, lambda old: tables.insert_missing(old, rows, self.key))

    def replace_children(self, rows: DataFrame, touched: DataFrame | None = None) -> None:
        """For tables keyed by their parent: the children of touched parents (or of those in rows) go, rows come."""
        parents = rows.select(*self.key) if touched is None else touched.select(*self.key)
        self.change(parents, lambda old: old.join(parents.distinct(), self.key, "left_anti").unionByName(rows))

    def delete(self, keys: DataFrame) -> None:
        self.change(keys, lambda old: old.join(keys.select(*self.key), self.key, "left_anti"))

    def wipe(self, keep: Column) -> None:
        """All rows but those that `keep` names go."""
        self.commit(list(self.versions), self.read().where(F.coalesce(keep, F.lit(False))))

    def vacuum(self) -> int:
        """Delete versions that the latest change doesn't name; how many. Not while others read or change the table."""
        fs, data = path_of(self.spark, f"{self.folder}/data")
        spent = [f.getPath() for f in fs.listStatus(data) if f.getPath().getName() not in set(self.versions.values())]
        for found in spent:
            fs.delete(found, True)
        return len(spent)


class Checkpoints:
    """Extraction states by collection: extracting, then extracted or failed, stored as they change."""

    SCHEMA = "collection string, title string, run_id string, status string, graph string, stats string, error string, updated timestamp"

    def __init__(self, table: KeyedTable):
        self.table = table

    @classmethod
    def create(cls, spark: SparkSession, folder: str, buckets: int = 8) -> Checkpoints:
        return cls(KeyedTable.create(spark.createDataFrame([], cls.SCHEMA), folder, ["collection"], buckets))

    def begin(self, rows: DataFrame, run_id: str, now: Column) -> None:
        """collection and title: known or not, they start anew, without graph, statistics or error."""
        blank = [F.lit(None).cast("string").alias(c) for c in ("graph", "stats", "error")]
        new = rows.select("collection", "title", F.lit(run_id).alias("run_id"), F.lit("extracting").alias("status"), *blank, now.alias("updated"))
        self.table.change(new, lambda old: old.join(new.select("collection"), "collection", "left_anti").unionByName(new))

    def _update(self, rows: DataFrame, now: Column, **values: Column) -> None:
        given = rows.select("collection", *(v.alias(f"__{c}") for c, v in values.items()), F.lit(True).alias("__hit"))
        self.table.change(rows, lambda old: old.join(given, "collection", "left").select(*(F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in values else F.when(F.col("__hit"), now).otherwise(F.col(c)).alias(c) if c == "updated" else F.col(c) for c in old.columns)))

    def save(self, rows: DataFrame, now: Column) -> None:
        """collection, graph and stats of those that are extracted; unknown collections are left out."""
        self._update(rows, now, status=F.lit("extracted"), graph=F.col("graph"), stats=F.col("stats"), error=F.lit(None).cast("string"))

    def fail(self, rows: DataFrame, now: Column) -> None:
        """collection and error of those that failed."""
        self._update(rows, now, status=F.lit("failed"), error=F.left("error", F.lit(ERROR_CHARS)))

    def pending(self, wanted: DataFrame) -> DataFrame:
        """Collections that aren't extracted: unknown, failed, or left in the middle."""
        done = self.table.read().where("status = 'extracted'").select("collection")
        return wanted.join(done, "collection", "left_anti")
