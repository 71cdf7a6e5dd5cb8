"""Job bookkeeping on tables: what is pending, logs, download states, pipeline stages."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial
from itertools import islice

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from pagelake.sources import writers


def pending(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of ``wanted`` whose key is not in ``done``."""
    return wanted.join(done.select(F.col(key).alias("_k")).distinct(), F.col(key) == F.col("_k"), "left_anti")


def members(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in ``other``."""
    return df.join(other.select(F.col(key).alias("_k")).distinct(), F.col(key) == F.col("_k"), "left_semi")


def upsert(log: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` replaces rows of equal keys and adds the rest; missing columns are null."""
    return log.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def download_status(jobs: DataFrame, log: DataFrame, remote: DataFrame, files: DataFrame) -> DataFrame:
    """State of each job: exists, logged, success, failed, pending or error, and whether to fetch it.

    jobs(issue, job_id, target_filename), log(job_id, status), remote(job_id,
    remote_status), files(target_filename).
    """
    ok = log.where("status = 'success'").select(F.col("job_id").alias("_l")).distinct()
    have = files.select(F.col("target_filename").alias("_f")).distinct()
    out = jobs.join(ok, F.col("job_id") == F.col("_l"), "left").join(have, F.col("target_filename") == F.col("_f"), "left")
    out = out.join(remote.select(F.col("job_id").alias("_r"), "remote_status"), F.col("job_id") == F.col("_r"), "left")
    state = (
        F.when(F.col("_f").isNotNull(), "exists").when(F.col("_l").isNotNull(), "logged").when(F.col("remote_status") == "SUCCESS", "success")
        .when(F.col("remote_status").isin("FAILED", "TIMEOUT_EXCEEDED", "CANCELLED"), "failed").when(F.col("remote_status").isNull(), "error").otherwise("pending")
    )
    return out.select("issue", "job_id", "target_filename", state.alias("state"), (state == "success").alias("fetch"))


def submit_pending(wanted: DataFrame, log_path: str, key: str, submit: Callable[[list[Row]], list[tuple]], at_once: int = 100) -> int:
    """Submit what the log does not hold yet, ``at_once`` jobs at a time, and append each batch's successes to the log.

    ``submit`` takes rows and gives those that succeeded, as (key, job_id)
    tuples. A run that breaks off loses one batch at most; the next one goes on
    from the log. Rows reach the driver batch by batch. Gives the successes.
    """
    spark, schema = wanted.sparkSession, f"{key} {wanted.schema[key].dataType.simpleString()}, job_id string"
    todo = pending(wanted, spark.read.parquet(log_path), key) if writers.exists(spark, log_path) else wanted
    rows, n = todo.dropDuplicates([key]).toLocalIterator(), 0
    while batch := list(islice(rows, at_once)):
        done = submit(batch)
        if done:
            spark.createDataFrame(done, schema).coalesce(1).write.mode("append").parquet(log_path)
        n += len(done)
    return n


@dataclass
class Stage:
    """A step of a pipeline. One that makes a table may name where it is kept: if it is there whole, it is read instead."""

    name: str
    run: object
    needs: tuple[str, ...] = ()
    path: str | None = None


@dataclass
class PipelineState:
    """Named stages with prerequisites; what is in ``done`` is not run again."""

    stages: list[Stage]
    done: dict[str, object] = field(default_factory=dict)
    spark: SparkSession | None = None

    def next(self) -> Stage | None:
        return next((s for s in self.stages if s.name not in self.done and all(n in self.done for n in s.needs)), None)

    def resume(self) -> dict[str, object]:
        while (stage := self.next()) is not None:
            run = partial(stage.run, self.done)
            self.done[stage.name] = writers.kept(self.spark, stage.path, run) if stage.path else run()
        return self.done
