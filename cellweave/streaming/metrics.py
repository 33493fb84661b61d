"""Run metrics and run states that arrive as files while a run is active."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from cellweave.operators.ledger import latest
from cellweave.streaming.keyed import KeyedTable


def metric_stream(spark: SparkSession, folder: str, schema: StructType | str, files_per_batch: int = 100) -> DataFrame:
    """File source of metric rows; the schema is given, never inferred."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def latest_table(spark: SparkSession, target: str, schema: StructType | str, keys: list[str], order: str, every: int = 8) -> KeyedTable:
    """The row of largest ``order`` per key, kept current."""
    names = StructType.fromDDL(schema).names if isinstance(schema, str) else schema.names
    return KeyedTable(spark, target, schema, lambda rows: latest(rows, keys, order).select(*names), every)


def keep_latest(rows: DataFrame, target: str, checkpoint: str, keys: list[str], order: str, every: int = 8) -> StreamingQuery:
    return latest_table(rows.sparkSession, target, rows.schema, keys, order, every).keep(rows, checkpoint)


def current(spark: SparkSession, target: str, schema: StructType | str, keys: list[str], order: str) -> DataFrame:
    """The table as it stands: the latest row per key, replaced rows are gone."""
    return latest_table(spark, target, schema, keys, order).read()


STATE = "run_id long, state string, seq long, closed string, closed_seq long"


def _merged_states(rows: DataFrame) -> DataFrame:
    return rows.groupBy("run_id").agg(
        F.max_by("state", "seq").alias("state"), F.max("seq").alias("seq"), F.max_by("closed", "closed_seq").alias("closed"), F.max("closed_seq").alias("closed_seq"))


def state_rows(events: DataFrame) -> DataFrame:
    """Ledger events (run_id, state, seq) as rows of the state table."""
    over = F.col("state") != "active"
    return events.select("run_id", "state", "seq", F.when(over, F.col("state")).alias("closed"), F.when(over, F.col("seq")).alias("closed_seq"))


def state_table(spark: SparkSession, target: str, every: int = 8) -> KeyedTable:
    """State of each run, merged from events in any order: largest seq, last state, last closing state and its seq."""
    return KeyedTable(spark, target, STATE, _merged_states, every)


def run_states(states: DataFrame) -> DataFrame:
    """Complete, aborted and skipped are final once said, later active rows are ignored; active before."""
    return states.select("run_id", F.coalesce("closed", "state").alias("state"), "seq")


def run_state(events: DataFrame) -> DataFrame:
    """State of each run from all of its ledger events at once."""
    return run_states(_merged_states(state_rows(events)))
