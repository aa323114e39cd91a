"""The job ledger: steps keep when they were made and take the last status; events are derived from flags and appended."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upserted(steps: DataFrame) -> DataFrame:
    """steps(job, step, seq, status) -> one row a job and step: first seq, last seq, last status."""
    return steps.groupBy("job", "step").agg(F.min("seq").alias("created_at"), F.max("seq").alias("updated_at"), F.max_by("status", "seq").alias("status"))


def events_of(steps: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """One event for each rule (condition, code, severity) that a row meets: one scan, the rules exploded."""
    hits = F.array_compact(F.array(*(F.when(F.expr(c), F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for c, code, severity in rules)))
    return steps.withColumn("_e", F.explode(hits)).select(*steps.columns, "_e.code", "_e.severity")


def append(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def exists(spark, path: str) -> bool:
    """True if a step's artifact is complete, so that a resumed job can skip it."""
    try:
        spark.read.text(f"{path}/_SUCCESS").isEmpty()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def resumed(spark, path: str, build) -> DataFrame:
    """The step's written result: read if it is there, built, written and read otherwise."""
    if not exists(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
