"""Tables as Parquet folders in buckets, behind numbered manifests.

A table's rows lie in buckets by a hash of their key. A write makes one new folder
with the buckets that it touches; the manifest says which buckets of which folders
are live. So rows that are added touch no old file, and rows that are changed or
removed cost the buckets that hold them. A manifest gets its number in one step: a
crash before it leaves the version before, and a writer that was overtaken starts
again from the newer version.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import KEYS, PARENTS, TABLES, conform, orphans, violations
from ..session import durable
from .versions import Conflict, Versions

MOST_FOLDERS = 64
ROWS_A_BUCKET = 1 << 18
MOST_BUCKETS = 4096
TRIES = 20


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` rows replace ``old`` rows of their key; keys of ``new`` must be unique."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def delete(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(gone.select(*keys).distinct(), keys, "left_anti")


def with_ids(new: DataFrame, top: int, order: list[str], id_col: str = "id") -> DataFrame:
    """Rows numbered from ``top`` + 1 on in an order, by partition counts and not in one task."""
    mid = durable(new.orderBy(*order))
    mid = durable(mid.withColumn("__part", F.spark_partition_id()).withColumn("__mid", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = mid.groupBy("__part").agg(F.count("*").alias("__n"))  # a row per partition
    starts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return mid.join(F.broadcast(starts), "__part").withColumn(id_col, F.col("__start") + F.col("__mid") + 1 + top).drop("__part", "__mid", "__start")


class Store:
    """A folder of tables. A write never touches the files that a reader has open."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _versions(self, table: str) -> Versions:
        return Versions(self.spark, f"{self.folder}/{table}/manifests")

    def state(self, table: str) -> tuple[int, int, list[dict]]:
        """(version, number of buckets, parts): a part is a folder with its live buckets."""
        number, lines = self._versions(table).latest()
        found = [json.loads(line) for line in lines] or [{"buckets": 1}, *self._earlier(table)]
        return number, found[0]["buckets"], found[1:]

    def _earlier(self, table: str) -> list[dict]:
        """Folders without buckets that a store of an earlier version names in a file ``current``."""
        fs, place = self._fs(f"{self.folder}/{table}/current")
        if not fs.exists(place):
            return []
        stream = fs.open(place)
        try:
            return [{"folder": name, "live": [0], "plain": True} for name in bytes(stream.readAllBytes()).decode().split("\n")]
        finally:
            stream.close()

    def version(self, table: str) -> int:
        return self.state(table)[0]

    def exists(self, table: str) -> bool:
        return bool(self.state(table)[2])

    def _rows(self, table: str, parts: list[dict], only: list[int] | None = None) -> DataFrame:
        """The live rows of ``parts``, or those of some buckets; older files may lack newer columns."""
        paths = [f"{self.folder}/{table}/{p['folder']}" + ("" if p.get("plain") else f"/bucket={b}") for p in parts for b in p["live"] if only is None or b in only]
        empty = self.spark.createDataFrame([], TABLES[table])
        return conform(self.spark.read.schema(empty.schema).parquet(*paths), table) if paths else empty

    def read(self, table: str) -> DataFrame:
        """The current version; an empty table where nothing was written yet."""
        return self._rows(table, self.state(table)[2])

    def pick(self, table: str, keys: DataFrame) -> DataFrame:
        """The rows of some keys, from their buckets alone; ``keys`` has the columns of the table's key."""
        _, buckets, parts = self.state(table)
        kinds = dict(x.split() for x in TABLES[table].split(", "))
        names = keys.select(*[F.col(k).cast(kinds[k]).alias(k) for k in KEYS[table]]).distinct()
        only = [r.bucket for r in names.select(self._bucket(table, buckets).alias("bucket")).distinct().collect()] if buckets > 1 else None  # MOST_BUCKETS at most
        return self._rows(table, parts, only).join(names, KEYS[table], "left_semi")

    def _bucket(self, table: str, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*KEYS[table]), F.lit(buckets)).cast("int")

    def _put(self, table: str, df: DataFrame, buckets: int, check: bool = True) -> dict:
        """Write rows as a new folder; nothing names it yet."""
        folder = f"v-{uuid.uuid4().hex}"
        path = f"{self.folder}/{table}/{folder}"
        rows = conform(df, table).withColumn("bucket", self._bucket(table, buckets))
        (rows.repartition("bucket") if buckets > 1 else rows).write.partitionBy("bucket").parquet(path)
        fs, place = self._fs(path)
        live = sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(place) if s.getPath().getName().startswith("bucket="))
        part = {"folder": folder, "live": live}
        if check and live and violations(self._rows(table, [part]), table).limit(1).count():
            fs.delete(place, True)
            raise ValueError(f"{table}: a value is outside its domain")
        return part

    def _commit(self, table: str, after: int, buckets: int, parts: list[dict]) -> None:
        live = [p for p in parts if p["live"]] or parts[:1]
        self._versions(table).commit(after, [json.dumps(x) for x in ({"buckets": buckets}, *live)])

    def _again(self, step: Callable[[], None]) -> None:
        """Run a step from the newest version on until no other writer comes between."""
        for _ in range(TRIES):
            try:
                return step()
            except Conflict:
                continue
        raise Conflict(f"{self.folder}: too many writers")

    def write(self, table: str, df: DataFrame, check: bool = True, after: int | None = None) -> None:
        """Replace the whole table, which gets as many buckets as its rows ask for; the version before stays for open readers until ``vacuum``.

        ``after``: the version that ``df`` was made from; if another one is there
        meanwhile this is a ``Conflict``, and without it the newest is replaced.
        """
        rows = durable(conform(df, table))
        buckets = max(1, min(MOST_BUCKETS, -(-rows.count() // ROWS_A_BUCKET)))
        part = self._put(table, rows, buckets, check)
        if after is not None:
            return self._commit(table, after, buckets, [part])
        return self._again(lambda: self._commit(table, self.version(table), buckets, [part]))

    def append(self, table: str, new: DataFrame) -> None:
        """Write the new rows alone; a table of ``MOST_FOLDERS`` is then written whole, so that it stays a few."""
        made: dict[int, dict] = {}

        def step() -> None:
            number, buckets, parts = self.state(table)
            if buckets not in made:
                made[buckets] = self._put(table, new, buckets)
            self._commit(table, number, buckets, [*parts, made[buckets]])

        self._again(step)
        if len(self.state(table)[2]) >= MOST_FOLDERS:
            self.compact(table)

    def compact(self, table: str) -> None:
        """Write the table as one folder, with the number of buckets that its rows ask for."""

        def step() -> None:
            number, _, parts = self.state(table)
            self.write(table, self._rows(table, parts), False, number)

        self._again(step)

    def change(self, table: str, hit: Callable[[DataFrame], DataFrame], fresh: Callable[[DataFrame], DataFrame]) -> None:
        """Write the buckets anew that hold rows of ``hit`` (rows with the key's columns), as ``fresh`` of their old rows.

        Other buckets keep their files. ``hit`` and ``fresh`` are asked again if another
        writer was faster.
        """

        def step() -> None:
            number, buckets, parts = self.state(table)
            if buckets > 1:
                touched = [r.bucket for r in hit(self._rows(table, parts)).select(self._bucket(table, buckets).alias("bucket")).distinct().collect()]  # MOST_BUCKETS at most
            else:
                touched = [0]
            new = self._put(table, fresh(self._rows(table, parts, touched)), buckets)
            kept = [p | {"live": [b for b in p["live"] if b not in touched]} for p in parts]
            self._commit(table, number, buckets, [*[p for p in kept if p["live"]], new])

        self._again(step)

    def upsert(self, table: str, new: DataFrame) -> None:
        """Insert or replace by the table's key."""
        rows = durable(conform(new, table))
        self.change(table, lambda _: rows, lambda old: upsert(old, rows, KEYS[table]))

    def delete(self, table: str, gone: DataFrame, keys: list[str] | None = None) -> None:
        keys = keys or KEYS[table]
        names = durable(gone.select(*keys).distinct())
        self.change(table, lambda old: old.join(names, keys, "left_semi"), lambda old: delete(old, names, keys))

    def update(self, table: str, changes: DataFrame, key: str = "id") -> None:
        """Set the columns of ``changes`` for rows of its keys; a null leaves a value as it is."""
        fresh = [c for c in changes.columns if c != key]
        renamed = durable(changes.select(key, *[F.col(c).alias(f"__{c}") for c in fresh]))
        columns = [part.split()[0] for part in TABLES[table].split(", ")]

        def joined(old: DataFrame) -> DataFrame:
            return old.join(renamed, key, "left").select(*[F.coalesce(f"__{c}", c).alias(c) if c in fresh else F.col(c) for c in columns])

        self.change(table, lambda old: old.join(renamed, key, "left_semi"), joined)

    def top_id(self, table: str) -> int:
        return self.read(table).agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]

    def add_tags(self, pairs: DataFrame) -> None:
        from ..functions.text import trim

        self.upsert("document_tags", pairs.select("document_id", F.lower(trim(F.col("tag"))).alias("tag")).distinct())

    def remove_tags(self, pairs: DataFrame) -> None:
        self.delete("document_tags", pairs)

    def replace_children(self, documents: DataFrame) -> None:
        """Drop entries, chunks, vectors, claims and derived content of documents; the documents stay."""
        ids = documents.select(F.col("id").alias("document_id"))
        for table in ("entries", "derived_content", "claims"):
            self.delete(table, ids, ["document_id"])
        self.clean()

    def clean(self) -> None:
        """Remove rows whose parents are gone, top down."""
        for table in ("entries", "chunks", "document_tags", "derived_content", "claims", "vec_chunks", "vec_claims"):
            rows, parents = self.read(table), self.read(PARENTS[table][1])
            if orphans(rows, table, parents).limit(1).count():
                self.delete(table, orphans(rows, table, parents), [PARENTS[table][0]])

    def migrate(self) -> None:
        """Bring all tables to the present schema and give documents of another signature width new signatures."""
        from ..functions.shingles import LANES, signatures

        from ..operators.families import components, superseded_edges

        if not self.exists("document_families"):
            self.write("document_families", components(superseded_edges(self.read("document_relations"))))
        for table in TABLES:
            if not self.exists(table):
                self.write(table, self.read(table))
        documents = self.read("documents")
        stale = documents.filter((F.col("document_minhash").isNotNull() & (F.size("document_minhash") != LANES)) | (F.col("document_minhash").isNotNull() & F.col("document_shingle_count").isNull()))
        if stale.limit(1).count():
            bodies = self.read("entries").join(stale.select(F.col("id").alias("document_id")), "document_id", "left_semi")
            texts = bodies.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "body"))), lambda x: x["body"]), "\n").alias("text"))
            signed = signatures(stale.select("id").join(texts, F.col("id") == F.col("document_id"), "left").select("id", F.coalesce("text", F.lit("")).alias("text")))
            self.update("documents", signed.select("id", F.col("signature").alias("document_minhash"), F.col("n_shingles").cast("long").alias("document_shingle_count")))
        self.clean()

    def vacuum(self, table: str) -> None:
        """Delete versions that are no longer current."""
        named = {p["folder"] for p in self.state(table)[2]}
        self._versions(table).forget(1)
        fs, place = self._fs(f"{self.folder}/{table}")
        for status in fs.listStatus(place):
            name = status.getPath().getName()
            if name.startswith("v-") and name not in named:
                fs.delete(status.getPath(), True)
