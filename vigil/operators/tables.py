"""Tables in folders that all executors share: versions with an atomic commit, writers' counters, cached results.

A table is a folder of data folders and a log.  A version is a log entry that lists the
data folders it consists of; it becomes visible when that entry is created, which fails
if another run has created the same number.  So a run that dies leaves the last version
as it was, readers never see half a write, and of two writers one is told to try again.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; only a local master may do without one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="vigil-shared-"))
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Folder:
    """Small files and listings in a folder of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark.sparkContext._jvm
        self.path = path.rstrip("/")
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self) -> list[str]:
        """What lies directly in the folder, sorted; an absent folder has nothing."""
        at = self._at("")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def create(self, name: str, text: str) -> bool:
        """Write a file that is not there yet, in one step; False if it is there already."""
        try:
            out = self._fs.create(self._at(name), False)
        except Exception as e:
            if "already exists" in str(e) or "FileAlreadyExists" in str(e):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def text(self, name: str) -> str:
        size = self._fs.getFileStatus(self._at(name)).getLen()
        source = self._fs.open(self._at(name))
        read = bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(source, size)).decode()
        source.close()
        return read

    def remove(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


class Conflict(RuntimeError):
    """Another run has committed a version since this one began."""


@dataclass(frozen=True)
class Part:
    """A data folder of a version, without the rows that a later overwrite has replaced."""

    path: str
    without: tuple[tuple[str, str], ...] = ()

    def read(self, spark: SparkSession, schema: str) -> DataFrame:
        df = spark.read.schema(schema).parquet(self.path)
        for condition, _ in self.without:
            df = df.where(~F.coalesce(F.expr(condition), F.lit(False)))
        return df


class VersionedTable:
    """``append``, ``replace`` and ``read`` over versions of a table with a fixed schema."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self._log = Folder(spark, f"{self.path}/log")

    def version(self) -> int:
        """The number of the last version; 0 before the first commit."""
        done = [n for n in self._log.names() if n.endswith(".json") and n[:-5].isdigit()]
        return int(done[-1][:-5]) if done else 0

    def parts(self, version: int | None = None) -> list[Part]:
        version = self.version() if version is None else version
        if version == 0:
            return []
        listed = json.loads(self._log.text(f"{version:012}.json"))["parts"]
        return [Part(p["path"], tuple(map(tuple, p["without"]))) for p in listed]

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version (the last one), an empty table before the first commit."""
        df = self.spark.createDataFrame([], self.schema)
        for part in self.parts(version):
            df = df.unionByName(part.read(self.spark, self.schema))
        return df

    def _write(self, rows: DataFrame) -> Part:
        path = f"{self.path}/data-{uuid.uuid4().hex}"
        kinds = self.spark.createDataFrame([], self.schema).schema
        rows.select(*[F.col(f.name).cast(f.dataType) for f in kinds]).write.parquet(path)
        return Part(path)

    def commit(self, began: int, parts: list[Part]) -> int:
        """Make ``parts`` the version after ``began``, or raise Conflict and change nothing."""
        entry = json.dumps({"parts": [{"path": p.path, "without": p.without} for p in parts]})
        if self.version() != began or not self._log.create(f"{began + 1:012}.json", entry):
            raise Conflict(f"version {began + 1} of {self.path} is there already")
        return began + 1

    def append(self, rows: DataFrame) -> int:
        began = self.version()
        return self.commit(began, [*self.parts(began), self._write(rows)])

    def replace(self, condition: str, rows: DataFrame) -> int:
        """Rows for those that fulfil ``condition`` (SQL); what stays is not rewritten."""
        began = self.version()
        mark = (condition, uuid.uuid4().hex)
        kept = [Part(p.path, (*p.without, mark)) for p in self.parts(began)]
        return self.commit(began, [*kept, self._write(rows)])

    def compact(self) -> int:
        """One data folder for all of the version; older versions stay readable."""
        began = self.version()
        return self.commit(began, [self._write(self.read(began))])

    def clean(self) -> list[str]:
        """Remove data folders that no version names (of runs that died); their names."""
        named = {p.path.rsplit("/", 1)[1] for v in range(1, self.version() + 1) for p in self.parts(v)}
        whole = Folder(self.spark, self.path)
        gone = [n for n in whole.names() if n.startswith("data-") and n not in named]
        for n in gone:
            whole.remove(n)
        return gone


class Counters:
    """What a pass has counted; a part of the plan that Spark left out as empty has counted nothing."""

    def __init__(self, names: tuple[str, ...]):
        self.names, self.observation = names, Observation()

    @property
    def ran(self) -> bool:
        try:
            return bool(self.observation.get)
        except Py4JJavaError:  # its row has no fields
            return False

    def values(self) -> dict[str, int]:
        return dict(self.observation.get) if self.ran else dict.fromkeys(self.names, 0)


def counted(df: DataFrame, **counts: Column) -> tuple[DataFrame, Counters]:
    """``df`` with counters that its next full pass fills."""
    seen = Counters(tuple(counts))
    return df.observe(seen.observation, *[F.coalesce(c, F.lit(0)).cast("long").alias(n) for n, c in counts.items()]), seen


def fingerprint(df: DataFrame) -> tuple[int, str]:
    """Rows of ``df`` and a sum of their hashes: equal for equal rows in any order."""
    each = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]) if df.columns else F.lit(0)
    r = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(each.cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    return r.n, str(r.h)


def cached(source: DataFrame, path: str, key: str, compute: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, str]:
    """The rows of ``compute(source)`` from a cache of that name, and how they came: hit, miss or stale.

    An entry is valid for the row count and the fingerprint of the rows that it was made
    from.  It is published in one step, by the marker that names its data: a run that
    dies leaves none, and a stale entry is only replaced once the new one is whole.
    """
    spark, (n, mark) = source.sparkSession, fingerprint(source)
    folder = Folder(spark, f"{path.rstrip('/')}/{key}")
    entries = [e for e in folder.names() if e.endswith(".entry")]
    name = f"{n}-{mark}.entry"
    if name in entries:
        return spark.read.parquet(f"{folder.path}/{folder.text(name)}"), "hit"
    data = f"data-{uuid.uuid4().hex}"
    compute(source).write.parquet(f"{folder.path}/{data}")
    if not folder.create(name, data):  # another run was first; its rows are as good
        folder.remove(data)
    for old in entries:
        folder.remove(folder.text(old))
        folder.remove(old)
    return spark.read.parquet(f"{folder.path}/{folder.text(name)}"), "stale" if entries else "miss"
