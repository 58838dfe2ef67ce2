"""Recorded answers of providers as sources: pages of CVE records with pushed filters, and the latest of a folder of reports.

A provider has a name, a fetch that gives a table, and the key by which its records are
told apart.  ``recorded_pages`` is a Python data source over a folder of page files as a
crawler leaves them: ``severity=<S>/*.json`` (or .txt), one page (a JSON document with
totalResults, startIndex and vulnerabilities) a line.  Each input partition reads a group
of files, a filter on the severity opens only the files of that severity, and a page
beyond totalResults is left out.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from vigil.operators.sinks import dedupe_key
from vigil.sources import feeds

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # readers run where this package may be absent


class Provider(Protocol):
    name: str

    def fetch(self, spark: SparkSession) -> DataFrame: ...

    def dedupe_key(self) -> Column: ...


@dataclass
class Files(InputPartition):
    paths: tuple[tuple[str, str], ...]  # (severity, path)


class _Reader(DataSourceReader):
    def __init__(self, root: str, files_per_partition: int):
        self.root, self.files, self.severities = root, files_per_partition, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equality and IN on the severity; all other filters stay with Spark."""
        for f in filters:
            wanted = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if wanted is not None and f.attribute == ("severity",):
                self.severities = wanted if self.severities is None else self.severities & wanted
            else:
                yield f

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.root) if "://" in self.root else (fs.LocalFileSystem(), self.root.removeprefix("file:"))
        found = []
        for info in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            folder, _, name = info.path.rpartition("/")
            severity = folder.rpartition("/")[2].partition("severity=")[2]
            if info.is_file and name.endswith((".json", ".txt")) and severity and (self.severities is None or severity in self.severities):
                found.append((severity, info.path))
        found.sort()
        return [Files(tuple(found[i : i + self.files])) for i in range(0, len(found), self.files)] or [Files(())]

    def read(self, partition: Files) -> Iterator[tuple]:
        from pyarrow import fs

        system = fs.FileSystem.from_uri(self.root)[0] if "://" in self.root else fs.LocalFileSystem()
        for severity, path in partition.paths:
            with system.open_input_stream(path) as source:
                for line in source.read().decode().split("\n"):
                    if not line.strip():
                        continue
                    page = json.loads(line)
                    start, total = page.get("startIndex", 0), page.get("totalResults", 0)
                    if start >= total:  # pages of a file come in any order
                        continue
                    for i, record in enumerate(page.get("vulnerabilities") or []):
                        yield severity, start + i, total, json.dumps(record)


class RecordedPages(DataSource):
    """Options: path (a folder that all workers reach), files_per_partition (default 8)."""

    @classmethod
    def name(cls) -> str:
        return "recorded_pages"

    def schema(self) -> str:
        return "severity string, place long, total_results long, record string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("files_per_partition", 8)))


#: What a page holds for one record.
RECORD = feeds.NVD.split("vulnerabilities array<", 1)[1].strip().removesuffix(">")


@dataclass
class PageProvider:
    """CVE records of a folder of recorded pages, normalised; told apart by their CVE id alone."""

    path: str
    severities: tuple[str, ...] | None = None
    files_per_partition: int = 8
    name: str = "recorded_pages"

    def pages(self, spark: SparkSession) -> DataFrame:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        spark.dataSource.register(RecordedPages)
        rows = spark.read.format(self.name).option("path", self.path).option("files_per_partition", self.files_per_partition).load()
        return rows if self.severities is None else rows.where(F.col("severity").isin(*self.severities))

    def fetch(self, spark: SparkSession) -> DataFrame:
        one = self.pages(spark).select("severity", F.array(F.from_json("record", RECORD)).alias("vulnerabilities"))
        return feeds.normalise_nvd(one)

    def dedupe_key(self) -> Column:
        return F.coalesce(F.nullif(F.col("cve_id"), F.lit("")), F.lit(""))


@dataclass
class RecordProvider:
    """Vendor records of JSON files; told apart by CVE id, else by the vendor's own id."""

    path: str
    name: str = "records"

    def fetch(self, spark: SparkSession) -> DataFrame:
        return feeds.normalise_records(feeds.read_json(spark, self.path, feeds.RECORD))

    def dedupe_key(self) -> Column:
        return dedupe_key()


def write_pages(records: DataFrame, path: str, page_size: int = 2000) -> None:
    """Record (severity, place, record as JSON) as page files: each page a line, all pages of a severity in its folder.

    A page holds the records of page_size places.  Places give the order and may have gaps: a
    page's startIndex counts the severity's records before it, summed over a row for each page.
    """
    pages = records.groupBy("severity", F.floor(F.col("place") / page_size).alias("page")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "record"))), lambda r: r["record"]), ",").alias("body"),
    )
    counts = records.groupBy("severity", F.floor(F.col("place") / page_size).alias("page")).agg(F.count("*").alias("n"))
    all_of = Window.partitionBy("severity")
    starts = counts.select("severity", "page", (F.sum("n").over(all_of.orderBy("page")) - F.col("n")).alias("start"), F.sum("n").over(all_of).alias("total"))
    text = F.format_string('{"totalResults":%d,"startIndex":%d,"vulnerabilities":[%s]}', "total", "start", "body")
    pages.join(starts, ["severity", "page"]).select("severity", text.alias("value")).write.partitionBy("severity").option("compression", "none").format("text").mode("overwrite").save(path)


def latest_report(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The rows of the newest JSON report in a folder, with report (its file name) and written_at; none if there is no report.

    The file is chosen by its modification time, ties by the later name, as Spark's hidden
    metadata column has them; only the names are compared before the one file is read.
    """
    from vigil.operators.tables import Folder

    empty = spark.createDataFrame([], f"{schema}, report string, written_at timestamp")
    if not any(n.endswith(".json") for n in Folder(spark, folder).names()):
        return empty
    rows = spark.read.schema(schema).json(f"{folder}/*.json").select("*", F.col("_metadata.file_path").alias("__path"), F.col("_metadata.file_name").alias("report"), F.col("_metadata.file_modification_time").alias("written_at"))
    last = rows.agg(F.max(F.struct("written_at", "report")).alias("last")).first().last
    if last is None:
        return empty
    return rows.where((F.col("report") == last.report) & (F.col("written_at") == F.lit(last.written_at))).drop("__path")
