"""Tables in the shared folder under one manifest: changes are seen whole or not at all.

A version is a small JSON file that names, for each table, its parts: folders of Parquet,
dealt into buckets by the hash of the table's keys.  A change writes its parts first, where
no reader looks, and then puts down the next version's file, which at most one writer can.
A writer that dies leaves the old version; one that comes second gets ``Conflict`` and
tries again on the new version.  Readers of an old version finish, as no file is changed.

A batch reads, of each part, the buckets that its keys fall in.  Parts are merged when
they are not larger than twice the newer one, as digits carry, so a table of n rows has
about log n parts and a row is rewritten about log n times; a merged part has more buckets
the more rows it has, so a bucket stays of bounded size.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grafita.sources.shared import PLAIN

#: Rows that a bucket holds on average at most, and the most buckets a part may have.
BUCKET_ROWS, MOST_BUCKETS = 250_000, 4096
_BUCKET = "__bucket"


class Conflict(Exception):
    """Another writer made the next version first."""


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    """A bucket by the keys; nulls count.  ``buckets`` is a power of two, so fewer buckets merge whole ones."""
    return F.pmod(F.xxhash64(*[F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("\0")) for k in keys]), F.lit(buckets)).cast("int")


class Files:
    """What a manifest needs of the file system behind a path."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.root = self.jvm.org.apache.hadoop.fs.Path(root)
        self.fs = self.root.getFileSystem(self.conf)
        self.local = self.fs.getUri().getScheme() == "file"

    def path(self, name: str) -> object:
        return self.jvm.org.apache.hadoop.fs.Path(self.root, name)

    def names(self, name: str) -> list[str]:
        p = self.path(name)
        return [s.getPath().getName() for s in self.fs.listStatus(p)] if self.fs.exists(p) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Puts down a whole file if none of its name is there; False if one is."""
        near = self.path(f"{name}.{uuid.uuid4().hex}.tmp")
        stream = self.fs.create(near, False)
        stream.write(text.encode())
        stream.close()
        try:
            if self.local:  # a rename would replace the file; a link does not
                of = lambda p: self.jvm.java.nio.file.Paths.get(p.toUri())
                self.jvm.java.nio.file.Files.createLink(of(self.fs.makeQualified(self.path(name))), of(self.fs.makeQualified(near)))
            else:
                none = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
                self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(near, self.path(name), none)
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        finally:
            self.fs.delete(near, False)
        return True

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class Store:
    """Named tables below ``root``, each with key columns that its buckets go by."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root, Files(spark, root)

    # -- reading

    def paths(self, parts: list[dict], wanted: set[int] | None = None) -> list[str]:
        """Folders of the parts' buckets, or of those that hold some of ``wanted`` (of MOST_BUCKETS)."""
        out = []
        for p in parts:
            near = None if wanted is None else {w % p["of"] for w in wanted}
            out += [f"{self.root}/{p['path']}/{_BUCKET}={b}" for b in p["buckets"] if near is None or int(b) in near]
        return out

    def version(self) -> int:
        """The newest version; 0 before the first."""
        return max([0, *(int(n[:-5]) for n in self.files.names("versions") if n.endswith(".json"))])

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        return json.loads(self.files.read(f"versions/{version:012d}.json")) if version else {"tables": {}, "notes": {}}

    def read(self, name: str, version: int | None = None, near: DataFrame | None = None) -> DataFrame:
        """A table as of a version; with ``near``, only the buckets that near's keys fall in."""
        t = self.manifest(version)["tables"][name]
        paths = self.paths(t["parts"], None if near is None else touched(near, t["keys"]))
        if not paths:
            return self.spark.createDataFrame([], t["schema"])
        return self.spark.read.schema(t["schema"]).parquet(*paths)

    def rows(self, name: str, version: int | None = None) -> int:
        """Counted when the parts were written, so no table is read."""
        return sum(map(size, self.manifest(version)["tables"].get(name, {"parts": []})["parts"]))

    # -- writing

    def part(self, df: DataFrame, keys: Sequence[str], most: int | None = None) -> dict:
        """Writes df as a part that no version names yet.

        With ``most``, the rows it has or a little more than that, df is not held and counted
        before it is written.
        """
        path = f"data/{uuid.uuid4().hex}"
        if most is not None:
            of = buckets_for(most)
            if most:
                self.write(df, keys, of, path)
            return {"path": path, "of": of, "buckets": self.counted(path) if most else {}}
        df = df.persist()
        try:
            fine = df.groupBy(bucket_of(keys, MOST_BUCKETS).alias("b")).count().collect()  # at most MOST_BUCKETS rows
            rows = sum(r["count"] for r in fine)
            of = buckets_for(rows)
            buckets: dict[str, int] = {}
            for r in fine:
                buckets[str(r["b"] % of)] = buckets.get(str(r["b"] % of), 0) + r["count"]
            if rows:
                self.write(df, keys, of, path)
        finally:
            df.unpersist()
        return {"path": path, "of": of, "buckets": buckets}

    def write(self, df: DataFrame, keys: Sequence[str], of: int, path: str) -> None:
        """A part's folders; a bucket that one key makes large is split over tasks."""
        df.withColumn(_BUCKET, bucket_of(keys, of)).hint("rebalance", _BUCKET).write.options(**PLAIN).partitionBy(_BUCKET).parquet(f"{self.root}/{path}")

    def counted(self, path: str) -> dict[str, int]:
        """Rows by bucket of a part that is written, from the heads of its files."""
        told = self.spark.read.schema(f"{_BUCKET} int").option("basePath", f"{self.root}/{path}").parquet(f"{self.root}/{path}")
        return {str(r[_BUCKET]): r["count"] for r in told.groupBy(_BUCKET).count().collect()}

    def commit(self, base: int, manifest: dict) -> int:
        """Makes ``manifest`` the version after ``base``, or raises Conflict."""
        self.files.fs.mkdirs(self.files.path("versions"))
        if not self.files.create(f"versions/{base + 1:012d}.json", json.dumps(manifest)):
            raise Conflict(f"version {base + 1} is there")
        return base + 1

    def change(self, edit: Callable[[dict, int], None], tries: int = 20) -> int:
        """Edits the newest manifest and commits it; again on the next one if another writer was first."""
        for _ in range(tries):
            base = self.version()
            m = self.manifest(base)
            edit(m, base)
            try:
                return self.commit(base, m)
            except Conflict:
                continue
        raise Conflict(f"{tries} tries")

    @staticmethod
    def add(m: dict, name: str, keys: Sequence[str], schema: str, part: dict) -> None:
        t = m["tables"].setdefault(name, {"keys": list(keys), "schema": schema, "parts": []})
        if part["buckets"]:
            t["parts"].append(part)

    def append(self, batches: dict[str, tuple[DataFrame, Sequence[str]]], notes: dict | None = None) -> int:
        """Adds rows to several tables at once: name to (rows, keys); a new name makes a table.

        notes are kept with the version, for what must change together with the rows.
        """
        parts = {n: (self.part(df, keys), keys, ddl(df)) for n, (df, keys) in batches.items()}

        def edit(m: dict, _: int) -> None:
            for n, (part, keys, schema) in parts.items():
                self.add(m, n, keys, schema, part)
            m["notes"].update(notes or {})

        return self.change(edit)

    def bootstrap(self, load: Callable[[], dict[str, tuple[DataFrame, Sequence[str]]]]) -> tuple[int, bool]:
        """Loads an empty store once: (version, whether this call did).

        Of several calls at one time each may write its parts, but only one's are named.
        """
        if self.version():
            return self.version(), False
        m = {"tables": {}, "notes": {}}
        for n, (df, keys) in load().items():
            self.add(m, n, keys, ddl(df), self.part(df, keys))
        try:
            return self.commit(0, m), True
        except Conflict:
            for t in m["tables"].values():
                for p in t["parts"]:
                    self.files.delete(p["path"])
            return self.version(), False

    def clear(self, *names: str) -> dict[str, int]:
        """Empties tables in one new version, and tells the rows each had."""
        had: dict[str, int] = {}

        def edit(m: dict, _: int) -> None:
            for n in names:
                had[n] = sum(map(size, m["tables"][n]["parts"]))
                m["tables"][n]["parts"] = []

        self.change(edit)
        return had

    def recreate(self, name: str, schema: str, keys: Sequence[str]) -> int:
        """An empty table of a schema in place of what had the name."""
        return self.change(lambda m, _: m["tables"].update({name: {"keys": list(keys), "schema": schema, "parts": []}}))

    def without(self, m: dict, name: str, keys: DataFrame) -> int:
        """Edits a manifest so that rows of a table whose keys are among ``keys`` are gone; tells how many.

        keys: the table's key columns, distinct.  Only buckets that hold such keys are read and
        written again.
        """
        t = m["tables"][name]
        wanted = touched(keys, t["keys"])
        kept, hit, read = [], [], 0
        for p in t["parts"]:
            near = {str(w % p["of"]) for w in wanted}
            hit += self.paths([p], wanted)
            read += sum(r for b, r in p["buckets"].items() if b in near)
            kept.append(p | {"buckets": {b: r for b, r in p["buckets"].items() if b not in near}})
        if not hit:
            return 0
        old = self.spark.read.schema(t["schema"]).parquet(*hit)
        new = self.part(old.join(keys.hint("shuffle_hash"), [old[k].eqNullSafe(keys[k]) for k in t["keys"]], "left_anti"), t["keys"], read)
        t["parts"] = [p for p in [*kept, new] if p["buckets"]]
        return read - size(new)

    def remove(self, where: dict[str, DataFrame]) -> dict[str, int]:
        """Takes rows out of several tables in one version: name to a table of keys; tells how many went."""
        gone: dict[str, int] = {}
        self.change(lambda m, _: gone.update({n: self.without(m, n, keys) for n, keys in where.items()}))
        return gone

    def compact(self, name: str, merge: Callable[[DataFrame], DataFrame] | None = None, whole: bool = False) -> bool:
        """Merges the newest parts that are not larger than twice what follows them; True if it did.

        ``merge`` makes rows of one key one (it must give the same whether it is run once or
        part by part).  ``whole`` merges all parts.
        """
        base = self.version()
        m = self.manifest(base)
        t = m["tables"][name]
        parts, n = t["parts"], 1 if t["parts"] else 0
        while n < len(parts) and (whole or size(parts[-n - 1]) <= 2 * sum(map(size, parts[-n:]))):
            n += 1
        if n < 2:
            return False
        rows = self.spark.read.schema(t["schema"]).parquet(*self.paths(parts[-n:]))
        t["parts"] = parts[:-n] + [self.part(merge(rows) if merge else rows, t["keys"])]
        try:
            self.commit(base, m)
        except Conflict:
            return False  # the other writer's batch comes first; the next call merges
        return True

    def vacuum(self, keep: int = 1) -> int:
        """Deletes folders that none of the newest ``keep`` versions names; for a time without writers."""
        now = self.version()
        named = {p["path"] for v in range(max(1, now - keep + 1), now + 1) for t in self.manifest(v)["tables"].values() for p in t["parts"]}
        old = [f"data/{n}" for n in self.files.names("data") if f"data/{n}" not in named]
        for p in old:
            self.files.delete(p)
        return len(old)


def buckets_for(rows: int) -> int:
    of = 1
    while of * BUCKET_ROWS < rows and of < MOST_BUCKETS:
        of *= 2
    return of


def size(part: dict) -> int:
    return sum(part["buckets"].values())


def touched(rows: DataFrame, keys: Sequence[str]) -> set[int]:
    """Buckets, of MOST_BUCKETS, that the keys of rows fall in."""
    return {r[0] for r in rows.select(bucket_of(keys, MOST_BUCKETS)).distinct().collect()}


def ddl(df: DataFrame) -> str:
    """The columns of df as a schema string."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
