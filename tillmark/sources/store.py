"""Parquet tables that change together: rows dealt to buckets of files by key, and one manifest for each version.

A transaction writes new files beside the old ones, for those buckets only that hold changed keys. Nothing of it can
be seen until ``commit`` renames a manifest that lists the files of all tables to the next version's name; a rename
that finds the name taken means that another writer came first. A reader takes one manifest and so sees all tables of
one version, whatever is written meanwhile; what a writer left behind when it died is never listed. The file system
must rename atomically, as HDFS does (a local one is for tests: it does not keep two processes apart in the same
instant).

The driver holds the manifest (a path for each bucket of each table) and numbers of buckets, never rows; joins by key
sort and merge, as a broadcast would bring the keys of all rows to it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillmark.operators import storage
from tillmark.sources.schemas import SCHEMA_VERSION, TABLES, add_missing_columns

#: The columns whose hash deals the rows of each table to buckets.
LAYOUT: dict[str, tuple[str, ...]] = {
    "receipts": ("source_file",), "line_items": ("receipt_id",), "validation_results": ("receipt_id",), "products": ("product_id",),
    "product_aliases": ("store", "raw_description"), "shoppers": ("shopper_id",),
}
#: Columns that must be null or name a row of another table, by table.
REFERENCES: dict[str, dict[str, str]] = {"receipts": {"shopper_id": "shoppers"}, "line_items": {"product_id": "products"}, "product_aliases": {"product_id": "products"}}
CHILDREN = ("line_items", "validation_results")
#: Files that the rows of a large bucket are spread over, so that one key's rows are not one task's.
SPREAD = 4


class Conflict(RuntimeError):
    """Another writer committed first: take a new snapshot and do the work again."""


class BrokenReference(ValueError):
    """New rows name rows that are not there."""


@dataclass(frozen=True)
class Snapshot:
    """All tables as of one version."""

    store: Store
    version: int
    files: dict[str, dict[int, str]]
    batches: dict[str, int]

    def table(self, name: str, buckets: Iterable[int] | None = None) -> DataFrame:
        """A table, or those of its buckets; other buckets' files are not opened."""
        has = self.files.get(name, {})
        paths = sorted({has[b] for b in (has if buckets is None else buckets) if b in has})
        spark, schema = self.store.spark, self.store.schemas[name]
        return spark.read.schema(schema).parquet(*(f"{self.store.root}/data/{p}" for p in paths)) if paths else spark.createDataFrame([], schema)

    def lookup(self, name: str, *key: object) -> DataFrame:
        """The rows of one key, from the one bucket that can hold them."""
        by = self.store.layout[name]
        kinds = {f.name: f.dataType for f in self.store.schemas[name]}
        same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.lit(v).cast(kinds[c])) for c, v in zip(by, key, strict=True)))
        at = self.store.spark.range(1).select(self.store.bucket([F.lit(v).cast(kinds[c]) for c, v in zip(by, key, strict=True)])).head()[0]
        return self.table(name, [at]).filter(same)


class Store:
    """Tables below ``root`` in ``buckets`` buckets each; the number is fixed when the store is made (rows over files' size tells it)."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, schemas: dict[str, T.StructType] | None = None, layout: dict[str, tuple[str, ...]] | None = None) -> None:
        self.spark, self.root, self.schemas, self.layout = spark, root.rstrip("/"), schemas or TABLES, layout or LAYOUT
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        last = self._read(self._versions()[-1]) if self._versions() else None
        self.buckets = last["buckets"] if last else buckets

    def _path(self, below: str):  # noqa: ANN202
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{below}" if below else self.root)

    def _names(self, below: str) -> list[str]:
        at = self._path(below)
        return sorted(x.getPath().getName() for x in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _versions(self) -> list[int]:
        return [int(n[1:-5]) for n in self._names("manifest") if n.startswith("v") and n.endswith(".json")]

    def _manifest(self, version: int) -> str:
        return f"manifest/v{version:012d}.json"

    def _read(self, version: int) -> dict:
        f = self._fs.open(self._path(self._manifest(version)))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(f, "UTF-8"))
        finally:
            f.close()

    def _publish(self, version: int, manifest: dict) -> None:
        """Writes a manifest and gives it its name in one step."""
        tmp = f"manifest/.{uuid.uuid4().hex}"
        f = self._fs.create(self._path(tmp), True)
        f.write(bytearray(json.dumps(manifest).encode()))
        f.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(self._fs.makeQualified(self._path(tmp)), self._fs.makeQualified(self._path(self._manifest(version))), none)
        except Exception as e:
            self._fs.delete(self._path(tmp), False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {version} is taken") from e
            raise

    def bucket(self, key: list[Column]) -> Column:
        return F.pmod(F.xxhash64(*key), F.lit(self.buckets)).cast("int")

    def buckets_of(self, rows: DataFrame, table: str) -> set[int]:
        """The buckets of ``table`` that ``rows``, which have its key, fall into."""
        return {r[0] for r in rows.select(self.bucket([F.col(c) for c in self.layout[table]]).alias("bucket")).distinct().collect()}

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The last version, or an earlier one that is kept."""
        have = self._versions()
        if version is None and not have:
            return Snapshot(self, 0, {}, {})
        m = self._read(have[-1] if version is None else version)
        if m["schema"] > SCHEMA_VERSION:
            raise ValueError(f"stored schema {m['schema']} is newer than {SCHEMA_VERSION}")
        return Snapshot(self, m["version"], {t: {int(b): p for b, p in x.items()} for t, x in m["tables"].items()}, m["batches"])

    def begin(self) -> Transaction:
        return Transaction(self, self.snapshot())

    def vacuum(self, keep: int = 2) -> list[str]:
        """Deletes all but the last ``keep`` manifests and the folders that none of these lists; no writer may be at work. Returns the folders."""
        have = self._versions()
        for v in have[:-keep]:
            self._fs.delete(self._path(self._manifest(v)), False)
        listed = {p.rsplit("/", 1)[0] for v in have[-keep:] for x in self._read(v)["tables"].values() for p in x.values()}
        gone = [f"{t}/{d}" for t in self._names("data") for d in self._names(f"data/{t}") if f"{t}/{d}" not in listed]
        for d in gone:
            self._fs.delete(self._path(f"data/{d}"), True)
        return gone


class Transaction:
    """Changes to several tables on top of one snapshot; each sees what those before it did, others see nothing until ``commit``."""

    def __init__(self, store: Store, base: Snapshot) -> None:
        self.store, self.base = store, base
        self.now = Snapshot(store, base.version, {t: dict(x) for t, x in base.files.items()}, dict(base.batches))
        self._new: list[tuple[str, DataFrame]] = []  # staged rows whose references are looked up at the end
        self._staged: list[str] = []

    def _stage(self, rows: DataFrame) -> DataFrame:
        """New rows as files of their own, so that all that follows reads the same ones, once."""
        at = f"staging/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.store.root}/{at}")
        self._staged.append(at)
        return self.store.spark.read.schema(rows.schema).parquet(f"{self.store.root}/{at}")

    def _rewrite(self, name: str, touched: set[int], rows: DataFrame) -> None:
        """``rows`` are from now on all that the touched buckets hold."""
        if not touched:
            return
        s, at = self.store, f"{name}/{uuid.uuid4().hex}"
        out = add_missing_columns(rows, s.schemas[name])
        out = out.withColumn("bucket", s.bucket([F.col(c) for c in s.layout[name]]))
        spread = F.pmod(F.xxhash64(*out.columns), F.lit(SPREAD))
        out.repartition("bucket", spread).write.partitionBy("bucket").parquet(f"{s.root}/data/{at}")
        made = {int(n.removeprefix("bucket=")) for n in s._names(f"data/{at}") if n.startswith("bucket=")}
        if not made <= touched:
            raise RuntimeError(f"{name}: rows of buckets {sorted(made - touched)} are not to be rewritten")
        files = self.now.files.setdefault(name, {})
        for b in touched:
            files.pop(b, None)
        files.update({b: f"{at}/bucket={b}" for b in made})

    def _merge(self, name: str, rows: DataFrame, how) -> DataFrame:  # noqa: ANN001
        """Stages ``rows`` and rewrites the buckets of their keys as ``how(stored, rows)``."""
        new = self._stage(add_missing_columns(rows, self.store.schemas[name]))
        touched = self.store.buckets_of(new, name)
        self._rewrite(name, touched, how(self.now.table(name, touched), new))
        self._new.append((name, new))
        return new

    def put(self, name: str, rows: DataFrame) -> None:
        """Rows in place of those with their keys; of several new ones of a key the greatest counts."""
        self._merge(name, rows, lambda old, new: storage.replace_by_key(old, new, list(self.store.layout[name])))

    def save_products(self, rows: DataFrame, keep_embedding: bool = True) -> None:
        self._merge("products", rows, lambda old, new: storage.save_products(old, new, keep_embedding))

    def save_aliases(self, rows: DataFrame) -> None:
        keyed = storage.keyed_aliases(add_missing_columns(rows, self.store.schemas["product_aliases"]))
        self._merge("product_aliases", keyed, storage.save_aliases)

    def save_receipts(self, receipts: DataFrame, line_items: DataFrame | None = None, validation_results: DataFrame | None = None) -> None:
        """Receipts in place of those of the same ``source_file``, whose lines and checks go; theirs come. An owner stays.

        Of several new receipts of one file the one with the greatest id counts, and the others' lines are left out.
        Lines and checks must belong to receipts of this call.
        """
        s = self.store
        new = self._stage(add_missing_columns(receipts, s.schemas["receipts"]))
        touched = s.buckets_of(new, "receipts")
        stored = self.now.table("receipts", touched)
        gone = stored.join(new.select("source_file").hint("merge"), "source_file", "left_semi").select("receipt_id")
        (rows,) = storage.save_receipts(stored, new)
        stays = storage.latest(new, ["source_file"], [F.desc("receipt_id")]).select("receipt_id")
        for name, given in zip(CHILDREN, (line_items, validation_results), strict=True):
            own = self._stage(add_missing_columns(given if given is not None else s.spark.createDataFrame([], s.schemas[name]), s.schemas[name]))
            self._require(name, own, "receipt_id", new.select("receipt_id"))
            where = s.buckets_of(gone.unionByName(own.select("receipt_id")), name)
            kept = self.now.table(name, where).join(gone.hint("merge"), "receipt_id", "left_anti")
            self._rewrite(name, where, kept.unionByName(own.join(stays.hint("merge"), "receipt_id", "left_semi").select(*kept.columns)))
            self._new.append((name, own))
        self._rewrite("receipts", touched, rows)
        self._new.append(("receipts", new))

    def append(self, name: str, rows: DataFrame) -> None:
        """Lines or checks of receipts that are stored already."""
        new = self._stage(add_missing_columns(rows, self.store.schemas[name]))
        self._require(name, new, "receipt_id", self.now.table("receipts").select("receipt_id"))
        touched = self.store.buckets_of(new, name)
        self._rewrite(name, touched, self.now.table(name, touched).unionByName(new))
        self._new.append((name, new))

    def delete_receipts(self, ids: DataFrame) -> DataFrame:
        """Receipts with their lines and checks; products stay. Returns ``receipt_id, existed`` for each id."""
        s, ids = self.store, self._stage(ids.select(F.col("receipt_id").cast("long")).distinct())
        before = self.now.table("receipts")
        for name in ("receipts", *CHILDREN):
            found = self.now.table(name).join(ids.hint("merge"), "receipt_id", "left_semi") if name == "receipts" else ids
            touched = s.buckets_of(found, name)
            self._rewrite(name, touched, self.now.table(name, touched).join(ids.hint("merge"), "receipt_id", "left_anti"))
        return self._stage(ids.join(before.select("receipt_id", F.lit(True).alias("existed")).distinct().hint("merge"), "receipt_id", "left").select("receipt_id", F.coalesce("existed", F.lit(False)).alias("existed")))

    def update_lines(self, changes: DataFrame) -> None:
        """Columns of lines by ``line_item_id``."""
        changes = self._stage(changes)
        touched = self.store.buckets_of(self.now.table("line_items").join(changes.select("line_item_id").hint("merge"), "line_item_id", "left_semi"), "line_items")
        rows = storage.update_lines(self.now.table("line_items", touched), changes)
        self._rewrite("line_items", touched, rows)
        if "product_id" in changes.columns:
            self._new.append(("line_items", changes))

    def set_owners(self, owners: DataFrame) -> None:
        """Receipts' owners by ``receipt_id, shopper_id``."""
        owners = self._stage(owners.select("receipt_id", "shopper_id"))
        touched = self.store.buckets_of(self.now.table("receipts").join(owners.hint("merge"), "receipt_id", "left_semi"), "receipts")
        of = owners.select("receipt_id", F.struct("shopper_id").alias("_new"))
        rows = self.now.table("receipts", touched).join(of.hint("merge"), "receipt_id", "left")
        self._rewrite("receipts", touched, rows.withColumn("shopper_id", F.when(F.col("_new").isNotNull(), F.col("_new.shopper_id")).otherwise(F.col("shopper_id"))).drop("_new"))
        self._new.append(("receipts", owners))

    def _require(self, name: str, rows: DataFrame, column: str, known: DataFrame) -> None:
        missing = [r[0] for r in rows.select(column).filter(F.col(column).isNotNull()).distinct().join(known.hint("merge"), column, "left_anti").orderBy(column).limit(5).collect()]
        if missing:
            raise BrokenReference(f"{name}.{column}: no such row for {', '.join(map(repr, missing))}")

    def _check_references(self) -> None:
        """One anti-join for each column of new rows that names other rows; only the buckets that can hold these are read."""
        for name, rows in self._new:
            for column, parent in REFERENCES.get(name, {}).items():
                if column in rows.columns and parent in self.store.layout:
                    keys = rows.select(F.col(column).cast(self.store.schemas[parent][column].dataType)).filter(F.col(column).isNotNull()).distinct()
                    self._require(name, keys, column, self.now.table(parent, self.store.buckets_of(keys, parent)).select(column))

    def commit(self, batch: tuple[str, int] | None = None) -> int:
        """Makes all changes visible at once and returns the version. ``batch`` names the stream and number that it holds."""
        self._check_references()
        if batch:
            self.now.batches[batch[0]] = batch[1]
        version = self.base.version + 1
        self.store._publish(version, {"version": version, "schema": SCHEMA_VERSION, "buckets": self.store.buckets, "tables": self.now.files, "batches": self.now.batches})
        return version

    def close(self) -> None:
        """Drops staged files; what the transaction returned is read before."""
        for at in self._staged:
            self.store._fs.delete(self.store._path(at), True)
        self._staged = []
