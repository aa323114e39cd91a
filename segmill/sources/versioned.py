"""Tables of many folders with one manifest a version: what a manifest lists is the table, and a new one takes its place at once.

A manifest is one file that appears whole when its job commits. A run that dies before that leaves folders that no manifest names; the
table stays as it was. One writer at a time.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ENTRY = "name string, folder string, rows long"


@dataclass(frozen=True)
class Entry:
    """A folder of the table: its name (a class, a batch), its place below the table's path, and its rows."""

    name: str
    folder: str
    rows: int


def manifest(spark: SparkSession, path: str) -> tuple[int, list[Entry]]:
    """The number and the entries of the last manifest; -1 and none before the first."""
    schema = f"version long, entries array<struct<{ENTRY.replace(' ', ':').replace(',:', ',')}>>"
    try:
        last = spark.read.schema(schema).json(f"{path}/_manifests/*").orderBy(F.desc("version")).first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        last = None
    return (-1, []) if last is None else (last.version, [Entry(*e) for e in last.entries])


def commit(spark: SparkSession, path: str, version: int, entries: list[Entry]) -> None:
    """Make entries the table, as `version`; fails if there is such a version already."""
    row = spark.createDataFrame([(version, [(e.name, e.folder, e.rows) for e in entries])], f"version long, entries array<struct<{ENTRY.replace(' ', ':').replace(',:', ',')}>>")
    row.coalesce(1).write.mode("errorifexists").json(f"{path}/_manifests/{version:020d}")


def read(spark: SparkSession, path: str, schema: StructType | str, entries: list[Entry] | None = None) -> DataFrame:
    """The rows of the entries, those of the last manifest if not given."""
    entries = manifest(spark, path)[1] if entries is None else entries
    folders = [f"{path}/{e.folder}" for e in entries if e.rows]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def add(rows: DataFrame, path: str, name: str, place: str | None = None) -> Entry:
    """rows as a folder of the table that no manifest names yet. A given place is written over: a batch that runs again leaves the same."""
    folder = place or f"data/{uuid.uuid4().hex}"
    rows.write.mode("overwrite").parquet(f"{path}/{folder}")
    return Entry(name, folder, rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/{folder}").count())


def publish(rows: DataFrame, path: str, by: str = "classification", key: str = "job") -> None:
    """The rows of the jobs in `rows` in place of what the table had of these jobs: a row is in one class, also when its job changes class.

    A folder a class. Written are the classes that gain or lose rows; all others keep their folders. Classes are few; null is one of them.
    """
    spark = rows.sparkSession
    version, entries = manifest(spark, path)
    held = read(spark, path, rows.schema, entries)
    own = rows.select(key).distinct()
    on = held[key].eqNullSafe(own[key])
    name = F.coalesce(F.col(by).cast("string"), F.lit(""))
    touched = {r[0] for r in held.join(own, on, "left_semi").select(name).distinct().union(rows.select(name).distinct()).collect()}
    stays = [e for e in entries if e.name not in touched]
    gone = [e for e in entries if e.name in touched]
    kept = read(spark, path, rows.schema, gone)
    whole = kept.join(own, kept[key].eqNullSafe(own[key]), "left_anti").unionByName(rows)
    new = [add(whole.where(name == c), path, c) for c in sorted(touched)]
    commit(spark, path, version + 1, [*stays, *(e for e in new if e.rows)])


def classes(spark: SparkSession, path: str) -> dict[str, str]:
    """The folder of each class of the last version."""
    return {e.name: f"{path}/{e.folder}" for e in manifest(spark, path)[1]}


def merged_tail(path: str, entries: list[Entry], merge, schema: StructType | str, spark: SparkSession) -> list[Entry]:
    """The last entries merged by `merge` (a function of their rows) while the one before has at most twice the rows: of n rows
    there are then at most about log2(n) folders, and a row is rewritten as often at most, however many batches come."""
    at = len(entries)
    total = 0
    while at and (at == len(entries) or entries[at - 1].rows <= 2 * total):
        at -= 1
        total += entries[at].rows
    if len(entries) - at < 2:
        return entries
    return [*entries[:at], add(merge(read(spark, path, schema, entries[at:])), path, entries[-1].name)]
