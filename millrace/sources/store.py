"""Tables of chunks, vectors and keyed rows as Parquet folders with versions.

Rows lie in buckets by a hash of their key. A change is a small folder of its own: new rows, and the keys of rows
that are gone; readers put the newest change of a key before the bucket's row. Once changes are a larger share of the table,
the buckets that they touch are rewritten, and split where they have grown. A version is a small manifest that
names the folders; it counts once it is there. So readers never see half a write, a change of k rows writes k rows,
a snapshot is a manifest that is kept, and of two writers that start from one version the second is refused.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Points that one page of a scan holds.
PAGE = 256
#: Rows of a bucket from which it is split when it is rewritten.
BUCKET_ROWS = 4_000_000
#: Changes are folded into the buckets once they have more rows than this and than one row in so many, or more folders.
FOLD_ROWS, FOLD_SHARE, FOLD_FOLDERS = 100_000, 16, 24


class Conflict(RuntimeError):
    """Another writer made the version that this one was to make."""


class Versions:
    """Manifests below a path: v00000001, v00000002, ... and named ones."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._at("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self) -> list[str]:
        fs = self._fs()
        return sorted(s.getPath().getName() for s in fs.listStatus(self._at(""))) if fs.exists(self._at("")) else []

    def versions(self) -> list[str]:
        """Names of versions, oldest first."""
        return [n.removesuffix(".json") for n in self._names() if n.startswith("v") and n.endswith(".json")]

    def current(self) -> str | None:
        names = self.versions()
        return names[-1] if names else None

    def _manifest(self, name: str) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/{name}.json", wholetext=True).first().value)

    def _state(self) -> tuple[int, dict]:
        name = self.current()
        if name is None:
            raise FileNotFoundError(f"nothing in {self.path}")
        return int(name[1:]), self._manifest(name)

    def _put(self, name: str, manifest: dict) -> None:
        """Make a manifest appear whole, unless there is one of this name: by a hard link on local file systems, which
        fails if the name is taken, elsewhere by the store's rename, which HDFS refuses onto an existing file."""
        fs, part, whole = self._fs(), self._at(f"_{uuid.uuid4().hex}"), self._at(f"{name}.json")
        out = fs.create(part, False)
        out.writeBytes(json.dumps(manifest))
        out.close()
        try:
            if fs.getUri().getScheme() == "file":
                old, new = (self.spark._jvm.java.io.File(p.toUri().getPath()).toPath() for p in (part, whole))
                self.spark._jvm.java.nio.file.Files.createLink(new, old)
                done = True
            else:
                done = not fs.exists(whole) and fs.rename(part, whole)
        except Py4JJavaError:
            done = False
        fs.delete(part, False)
        if not done:
            raise Conflict(f"{name} is there already")

    def _next(self, base: int, manifest: dict) -> str:
        """The version after `base`."""
        name = f"v{base + 1:08d}"
        self._put(name, manifest)
        return name


def _free(taken: list[str], name: str) -> str:
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


class Table(Versions):
    """A keyed table below a path of any file system that Spark writes; a null key is a key like others."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 16):
        super().__init__(spark, path)
        self.key, self.buckets = key, buckets

    # reading
    def _base(self, manifest: dict, buckets: list[str] | None = None) -> DataFrame:
        wanted = [f for k, f in manifest["buckets"].items() if buckets is None or k in buckets]
        if not wanted:
            return self.spark.createDataFrame([], manifest["schema"])
        return self.spark.read.schema(manifest["schema"]).parquet(*[f"{self.path}/{f}" for f in wanted])

    def _changes(self, manifest: dict) -> DataFrame:
        """The newest change of each key, with a last column that says whether the row is gone."""
        schema, gone = manifest["schema"], manifest["gone"]
        turn = _free([gone, *_columns(schema)], "turn")
        each = [self.spark.read.schema(f"{schema}, `{gone}` boolean").parquet(f"{self.path}/{c['folder']}").withColumn(turn, F.lit(i)) for i, c in enumerate(manifest["changes"])]
        newest = _free([turn, gone, *_columns(schema)], "newest")
        last = F.row_number().over(Window.partitionBy(f"`{self.key}`").orderBy(F.col(turn).desc()))
        return reduce(DataFrame.unionByName, each).withColumn(newest, last).where(F.col(newest) == 1).drop(turn, newest)

    def _merged(self, manifest: dict, buckets: list[str] | None = None) -> DataFrame:
        base = self._base(manifest, buckets)
        if not manifest["changes"]:
            return base
        late = self._changes(manifest)
        if buckets is not None:
            late = late.where(self._bucket(manifest["n"]).isin([int(b) for b in buckets]))
        name = _free(base.columns, "changed")
        kept = base.join(late.select(F.col(f"`{self.key}`").alias(name)), F.col(f"`{self.key}`").eqNullSafe(F.col(name)), "left_anti")
        return kept.unionByName(late.where(~F.col(f"`{manifest['gone']}`")).drop(manifest["gone"]))

    def read(self) -> DataFrame:
        return self._merged(self._state()[1])

    def _bucket(self, n: int) -> Column:
        return F.pmod(F.xxhash64(f"`{self.key}`"), F.lit(n)).cast("int")

    # writing
    def _buckets(self, df: DataFrame, n: int) -> dict[str, str]:
        """Write df by bucket; number -> folder."""
        folder, name = f"data-{uuid.uuid4().hex}", _free(df.columns, "_bucket")
        df.withColumn(name, self._bucket(n)).repartition(F.col(name)).write.partitionBy(name).parquet(f"{self.path}/{folder}")
        made = [s.getPath().getName() for s in self._fs().listStatus(self._at(folder))]
        return {m.removeprefix(f"{name}="): f"{folder}/{m}" for m in made if m.startswith(f"{name}=")}

    def write(self, df: DataFrame) -> str:
        """A new version with these rows alone."""
        base = self._state()[0] if self.current() else 0
        manifest = {"schema": ", ".join(f"`{c}` {t}" for c, t in df.dtypes), "n": self.buckets, "buckets": self._buckets(df, self.buckets), "changes": [], "gone": _free(df.columns, "_gone")}
        manifest["rows"] = self._base(manifest).count()
        return self._next(base, manifest)

    def merge(self, rows: DataFrame | None = None, gone: DataFrame | None = None, order: Column | None = None) -> str:
        """One version in which the keys of `gone` have no row and `rows` replace those of their keys. Of several rows
        with a key the last by `order` counts, without an order any one. What is written is these rows alone."""
        base, manifest = self._state()
        names, flag, parts = _columns(manifest["schema"]), manifest["gone"], []
        empty = self.spark.createDataFrame([], manifest["schema"])
        if rows is not None:
            n = _free(rows.columns, "n")
            rows = rows.withColumn(n, F.row_number().over(Window.partitionBy(f"`{self.key}`").orderBy(order.desc() if order is not None else F.xxhash64(*[f"`{c}`" for c in rows.columns])))).where(F.col(n) == 1).drop(n)
            parts.append(empty.unionByName(rows, allowMissingColumns=True).select(*[f"`{c}`" for c in names]).withColumn(flag, F.lit(False)))
        if gone is not None:
            keys = gone.select(f"`{self.key}`").distinct()
            if rows is not None:
                mine = rows.select(F.col(f"`{self.key}`").alias("kept_key"))
                keys = keys.join(mine, keys[self.key].eqNullSafe(mine["kept_key"]), "left_anti")
            parts.append(empty.unionByName(keys, allowMissingColumns=True).select(*[f"`{c}`" for c in names]).withColumn(flag, F.lit(True)))
        folder = f"data-{uuid.uuid4().hex}"
        change = reduce(DataFrame.unionByName, parts)
        change.write.parquet(f"{self.path}/{folder}")
        n = self.spark.read.schema(f"{manifest['schema']}, `{flag}` boolean").parquet(f"{self.path}/{folder}").count()
        if not n:
            return f"v{base:08d}"
        name = self._next(base, manifest | {"changes": [*manifest["changes"], {"folder": folder, "rows": n}]})
        changed = sum(c["rows"] for c in manifest["changes"]) + n
        if changed > max(FOLD_ROWS, manifest["rows"] // FOLD_SHARE) or len(manifest["changes"]) + 1 > FOLD_FOLDERS:
            try:
                return self.compact()
            except Conflict:  # another writer was faster; its version holds this change, and folds later
                return self.current()
        return name

    def compact(self) -> str:
        """Fold changes into the buckets that they touch. Where buckets have grown beyond BUCKET_ROWS rows, all are
        split in two, as often as it takes: row counts are kept in the manifest."""
        base, manifest = self._state()
        n = manifest["n"]
        while manifest["rows"] + sum(c["rows"] for c in manifest["changes"]) > n * BUCKET_ROWS:
            n *= 2
        if n > manifest["n"]:
            buckets = self._buckets(self._merged(manifest), n)
        elif manifest["changes"]:
            some = [str(r[0]) for r in self._changes(manifest).select(self._bucket(n)).distinct().collect()]  # `n` numbers at most
            buckets = {k: f for k, f in manifest["buckets"].items() if k not in some} | self._buckets(self._merged(manifest, some), n)
        else:
            return f"v{base:08d}"
        done = manifest | {"n": n, "buckets": buckets, "changes": []}
        done["rows"] = self._base(done).count()
        return self._next(base, done)

    def upsert(self, rows: DataFrame, order: Column | None = None) -> str:
        """Rows replace those of their keys; buckets stay as they are until changes are folded."""
        if self.current() is None:
            self.write(self.spark.createDataFrame([], ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)))
        return self.merge(rows, order=order)

    def delete(self, condition: Column) -> str:
        """Rows for which the condition holds go; unknown ones stay."""
        return self.merge(gone=self.read().where(condition))

    def scroll(self, wanted: Column | None = None) -> DataFrame:
        return self.read() if wanted is None else self.read().where(wanted)

    def page(self, after: object = None, wanted: Column | None = None, size: int = PAGE) -> DataFrame:
        """The next rows by key after the last key of the page before."""
        rows = self.scroll(wanted)
        return (rows if after is None else rows.where(F.col(self.key) > after)).orderBy(self.key).limit(size)

    def of_document(self, doc_id: str, order: str = "chunk_index", limit: int = 1000) -> DataFrame:
        return self.read().where(F.col("doc_id") == doc_id).orderBy(order).limit(limit)

    def stats(self) -> DataFrame:
        """Rows and keys."""
        return self.read().agg(F.count("*").alias("rows"), F.countDistinct(self.key).alias("keys"))

    def snapshot(self, name: str) -> None:
        """Keep the current version under a name: its manifest alone is copied."""
        self._put(f"snapshot-{name}", self._state()[1])

    def snapshots(self) -> list[str]:
        return [n.removeprefix("snapshot-").removesuffix(".json") for n in self._names() if n.startswith("snapshot-")]

    def restore(self, name: str) -> str:
        base, _ = self._state()
        self._put(f"v{base + 1:08d}", self._manifest(f"snapshot-{name}"))
        return f"v{base + 1:08d}"

    def drop_snapshot(self, name: str) -> None:
        self._fs().delete(self._at(f"snapshot-{name}.json"), False)

    def vacuum(self, keep: int = 2) -> None:
        """Old versions go, all but the last `keep`, and folders that no version or snapshot names."""
        for v in self.versions()[:-keep]:
            self._fs().delete(self._at(f"{v}.json"), False)
        kept = [self._manifest(n) for n in [*self.versions(), *(f"snapshot-{s}" for s in self.snapshots())]]
        held = {f.split("/")[0] for m in kept for f in [*m["buckets"].values(), *(c["folder"] for c in m["changes"])]}
        for n in self._names():
            if n.startswith("data-") and n not in held:
                self._fs().delete(self._at(n), True)


def _columns(schema: str) -> list[str]:
    return [f.name for f in StructType.fromDDL(schema).fields]


def append_csv(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)


def write_summary(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)  # a summary is a row


class Results:
    """JSON results by name below a folder: put, list, get, delete."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self) -> list[str]:
        """Newest first."""
        fs = self._at().getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = list(fs.listStatus(self._at())) if fs.exists(self._at()) else []
        return [n for _, n in sorted(((-s.getModificationTime(), s.getPath().getName()) for s in found))]

    def put(self, name: str, df: DataFrame) -> None:
        write_summary(df, f"{self.path}/{name}")

    def get(self, name: str) -> DataFrame:
        return self.spark.read.json(f"{self.path}/{name}")

    def delete(self, name: str) -> bool:
        return self._at(name).getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(self._at(name), True)
