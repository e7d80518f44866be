"""Writers: immutable generations in partitioned Parquet, and ordered JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_generation(folder: str, project_id: str, generation: int, nodes: DataFrame, edges: DataFrame) -> None:
    """Writes one generation's tables under folder, and its row in the manifest once both are complete.

    A generation without nodes is an error, as is one that is in the manifest already: what was written is never
    changed. Readers go by the manifest, so a write that fails midway is invisible.
    """
    spark = nodes.sparkSession
    if not nodes.head(1):
        raise ValueError("a generation has at least one node")
    if manifest(spark, folder).where((F.col("project_id") == project_id) & (F.col("generation") == generation)).head(1):
        raise ValueError(f"generation {generation} of {project_id} exists")
    place = f"{folder}/{{}}/project_id={project_id}/generation={generation}"
    nodes.drop("project_id", "generation").write.mode("overwrite").parquet(place.format("nodes"))
    edges.drop("project_id", "generation").write.mode("overwrite").parquet(place.format("edges"))
    row = spark.range(1).select(F.lit(project_id).alias("project_id"), F.lit(generation).cast("bigint").alias("generation"), F.unix_millis(F.current_timestamp()).alias("activated_at_ms"))
    row.coalesce(1).write.mode("append").parquet(f"{folder}/manifest")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(project_id, generation, activated_at_ms) of all complete generations; empty where none was written."""
    schema = "project_id STRING, generation BIGINT, activated_at_ms BIGINT"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{folder}/manifest")


def read_active(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table's rows of the latest complete generation of each project; partitions of others are pruned."""
    active = manifest(spark, folder).groupBy("project_id").agg(F.max("generation").alias("generation"))
    return spark.read.parquet(f"{folder}/{name}").join(active, ["project_id", "generation"], "left_semi")


def write_json_lines(rows: DataFrame, order: list[str], path: str) -> None:
    """Rows as JSON lines in order, range-partitioned by it: the files in order of name hold the lines in order."""
    line = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.select(line.alias("value")).write.mode("overwrite").text(path)


STATES = "project_id STRING, generation BIGINT, state STRING, at_ms BIGINT, summary STRING"
# The states of a generation that is being made, and the longest summary of a failure.
OPEN, LONGEST_SUMMARY = ("CREATED", "BUILDING"), 500


def generation_states(spark: SparkSession, folder: str) -> DataFrame:
    """(project_id, generation, state, at_ms, summary): the latest state of each generation; empty where none was begun."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/states")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], STATES)
    rows = spark.read.schema(STATES + ", nth BIGINT").parquet(f"{folder}/states")
    return rows.groupBy("project_id", "generation").agg(F.max_by(F.struct("state", "at_ms", "summary"), "nth").alias("s")).select("project_id", "generation", "s.*")


def _note(spark: SparkSession, folder: str, project_id: str, generation: int, state: str, summary: str | None = None) -> None:
    """Appends a generation's state; states are never changed, the one noted last counts."""
    own = spark.range(1).select(
        F.lit(project_id).alias("project_id"), F.lit(generation).cast("bigint").alias("generation"), F.lit(state).alias("state"), F.unix_millis(F.current_timestamp()).alias("at_ms"),
        F.left(F.lit(summary).cast("string"), F.lit(LONGEST_SUMMARY)).alias("summary"), F.unix_micros(F.current_timestamp()).alias("nth"),
    )
    own.coalesce(1).write.mode("append").parquet(f"{folder}/states")


def begin_generation(spark: SparkSession, folder: str, project_id: str) -> int:
    """Begins the next generation of a project and gives its number. An error while another one is being built."""
    own = generation_states(spark, folder).where(F.col("project_id") == project_id)
    last = own.agg(F.coalesce(F.max("generation"), F.lit(0)).alias("last"), F.count_if(F.col("state") == "BUILDING").alias("building")).first()
    if last.building:
        raise ValueError(f"a generation of {project_id} is being built")
    _note(spark, folder, project_id, last.last + 1, "BUILDING")
    return last.last + 1


def _state(spark: SparkSession, folder: str, project_id: str, generation: int) -> str | None:
    row = generation_states(spark, folder).where((F.col("project_id") == project_id) & (F.col("generation") == generation)).first()
    return row.state if row else None


def fail_generation(spark: SparkSession, folder: str, project_id: str, generation: int, summary: str) -> None:
    """Ends a generation that is being made, with a bounded summary. What was active before stays so."""
    if _state(spark, folder, project_id, generation) not in OPEN:
        raise ValueError(f"generation {generation} of {project_id} isn't being made")
    _note(spark, folder, project_id, generation, "FAILED", summary)


def activate_generation(spark: SparkSession, folder: str, project_id: str, generation: int, nodes: DataFrame, edges: DataFrame) -> None:
    """Writes a generation that is being made, and notes it as ready."""
    if _state(spark, folder, project_id, generation) not in OPEN:
        raise ValueError(f"generation {generation} of {project_id} isn't being made")
    write_generation(folder, project_id, generation, nodes, edges)
    _note(spark, folder, project_id, generation, "READY")


def mark_stale(spark: SparkSession, folder: str, project_id: str) -> None:
    """Notes the active generation of a project as stale; its rows stay readable."""
    active = manifest(spark, folder).where(F.col("project_id") == project_id).agg(F.max("generation").alias("g")).first().g
    if active is None:
        raise ValueError(f"{project_id} has no active generation")
    _note(spark, folder, project_id, active, "STALE")
