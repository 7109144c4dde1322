"""Captures, canonical records and runs kept as append-only tables, each identified by its content.

Layout: ``raw`` (raw_event_id, source, received_at, sha256, payload), ``records``
and ``runs`` under one root. Nothing is overwritten: what is there already is
left alone, and the same id with other content is an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators.matching import Outcome, Tolerance, reconcile
from tallyloom.session import cut
from tallyloom.sources import statements


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    def _there(self, name: str) -> DataFrame | None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return self.spark.read.parquet(f"{self.root}/{name}") if fs.exists(at) else None

    def _add(self, name: str, rows: DataFrame, key: str, content: list[str] = ()) -> DataFrame:
        """Appends rows whose key is new and returns those. Nothing is added where a key comes with other ``content`` than before."""
        known = self._there(name)
        if content:
            told = rows.select(key, *content)
            told = told if known is None else told.unionByName(known.join(rows.select(key).distinct(), key, "left_semi").select(key, *content))
            text = F.to_json(F.struct(*content))
            for r in told.groupBy(key).agg(F.min(text).alias("low"), F.max(text).alias("high")).filter("low <> high").limit(1).collect():
                raise ValueError(f"{key} {r[key]} is kept with other content")
        rows = rows.dropDuplicates([key])
        fresh = cut(rows if known is None else rows.join(known.select(key), key, "left_anti"))
        fresh.write.mode("append").parquet(f"{self.root}/{name}")
        return fresh

    def capture(self, payloads: DataFrame) -> DataFrame:
        """``payloads``: source, received_at, payload (binary). The id is the hash of source and bytes."""
        sha = F.sha2("payload", 256)
        rows = payloads.filter("payload is not null").withColumn("sha256", sha).withColumn("raw_event_id", F.sha2(F.concat_ws("\x1f", F.coalesce("source", F.lit("")), "sha256"), 256))
        self._add("raw", rows.select("raw_event_id", "source", "received_at", "sha256", "payload"), "raw_event_id")
        return rows

    def raw(self, ids: DataFrame | None = None) -> DataFrame:
        """Captures, checked against their hashes as they are read."""
        rows = self._there("raw")
        rows = rows if ids is None else rows.join(ids.select("raw_event_id").distinct(), "raw_event_id", "left_semi")
        whole = F.sha2("payload", 256) == F.col("sha256")
        return rows.withColumn("payload", F.when(whole, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged capture "), "raw_event_id")).cast("binary")))

    def ingest(self, payloads: DataFrame, adapter: str = "camt053/1", normalizer: str = "1") -> tuple[DataFrame, DataFrame]:
        """Captures first, then normalises and saves; returns the saved records and the errors, which keep their raw ids."""
        captured = self.capture(payloads)
        read = cut(statements.statement_records(captured))
        records = statements.with_record_ids(read, adapter, normalizer).withColumn("adapter_version", F.lit(adapter)).withColumn("normalizer_version", F.lit(normalizer))
        return self._add("records", records.drop("error"), "record_id", [c for c in records.columns if c not in ("record_id", "error")]), read.filter("error is not null").select("raw_event_id", "error")

    def run(self, left: DataFrame, right: DataFrame, tol: Tolerance, engine_version: str) -> tuple[str, Outcome]:
        """Reconciles and keeps the run under the hash of its rules, engine and result."""
        if not engine_version:
            raise ValueError("a run needs the engine's version")
        twice = left.select("id").union(right.select("id")).groupBy("id").count().filter("count > 1").limit(1).collect()
        if twice:
            raise ValueError(f"id {twice[0]['id']!r} is given twice")
        outcome = reconcile(left, right, tol)
        result = outcome.result_hash()
        run_id = statements.record_id(outcome.ruleset_id, engine_version, result)
        inputs = left.select(F.lit("left").alias("side"), "id").union(right.select(F.lit("right").alias("side"), "id"))
        self._add("runs", self.spark.createDataFrame([(run_id, outcome.ruleset_id, engine_version, result)], "run_id string, ruleset_id string, engine_version string, result_hash string"), "run_id")
        inputs.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(f"{self.root}/run_inputs")
        return run_id, outcome

    def read_run(self, run_id: str) -> Row:
        """A kept run, whose id must be the hash of its content."""
        runs = self._there("runs")
        kept = runs.filter(F.col("run_id") == run_id).collect() if runs is not None else []
        if not kept:
            raise ValueError("no such run")
        if statements.record_id(kept[0]["ruleset_id"], kept[0]["engine_version"], kept[0]["result_hash"]) != run_id:
            raise ValueError("damaged run")
        return kept[0]

    def replay(self, run_id: str, left: DataFrame, right: DataFrame, tol: Tolerance, engine_version: str) -> Outcome:
        """Runs again and compares: the same engine must give the same result."""
        kept = self.read_run(run_id)
        if kept["engine_version"] != engine_version:
            raise ValueError("no such run by this engine")
        outcome = reconcile(left, right, tol)
        if outcome.result_hash() != kept["result_hash"]:
            raise ValueError("the replayed run differs")
        return outcome

    def records(self, ids: DataFrame | None = None) -> DataFrame:
        """Canonical records, whose identities are derived anew from their content as they are read."""
        rows = self._there("records")
        rows = rows if ids is None else rows.join(ids.select("record_id").distinct(), "record_id", "left_semi")
        derived = statements.identity(F.col("adapter_version"), F.col("normalizer_version"))
        return rows.withColumn("record_id", F.when(F.col("record_id") == derived, F.col("record_id")).otherwise(F.raise_error(F.concat(F.lit("damaged record "), "record_id"))))

    def lineage(self, run_id: str, record_id: str | None = None) -> DataFrame:
        """From a run's inputs, or one of them, back to the captures: side, record_id, locator, raw_event_id, source, received_at."""
        self.read_run(run_id)
        inputs = self.spark.read.parquet(f"{self.root}/run_inputs").filter(F.col("run_id") == run_id).select("side", F.col("id").alias("record_id"))
        if record_id is not None:
            inputs = inputs.filter(F.col("record_id") == record_id)
            if inputs.isEmpty():
                raise ValueError(f"record {record_id} is no input of the run")
        return inputs.join(self.records().select("record_id", "locator", "raw_event_id"), "record_id").join(self._there("raw").drop("payload"), "raw_event_id")
