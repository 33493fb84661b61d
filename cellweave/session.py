"""Session defaults and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(app: str = "cellweave", cores: str = "*", partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A session for tests and the bench. On a cluster the submitter's session is used as it is.

    Size estimates do not see how many rows an ``explode`` makes, so this session broadcasts on sizes measured after a
    shuffle only; sides that are counted first carry a hint.
    """
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
        .config("spark.sql.adaptive.autoBroadcastJoinThreshold", "10MB")
        .config("spark.sql.autoBroadcastJoinThreshold", "-1")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def small_side(df: DataFrame, most_bytes: int = 16 << 20) -> DataFrame:
    """``df`` with a broadcast hint if its rows were measured to be small, else with one for a merge join.

    Numbers, dates and truth values count 8 bytes, texts and bytes their length, nested values the length of their JSON.
    """
    size = F.lit(16)
    for field in df.schema.fields:
        kind = field.dataType.typeName()
        if kind in ("string", "binary", "varchar", "char"):
            size = size + F.coalesce(F.octet_length(F.col(f"`{field.name}`")), F.lit(0))
        elif kind in ("array", "map", "struct"):
            size = size + F.coalesce(F.octet_length(F.to_json(F.col(f"`{field.name}`"))), F.lit(0))
        else:
            size = size + 8
    return F.broadcast(df) if (df.agg(F.sum(size.cast("long"))).first()[0] or 0) <= most_bytes else df.hint("merge")


def numbered(df: DataFrame, name: str, times: int) -> DataFrame:
    """Each row ``times`` times with the numbers from 0 in ``name``.

    A join with a short range, because its size estimate counts the rows it makes. That of ``explode`` does not: a window
    of 1024 cells would pass for one row and be sent whole through the driver as the small side of a later join.
    """
    return df.crossJoin(F.broadcast(df.sparkSession.range(0, times, 1, 1).withColumnRenamed("id", name)))


_LOCAL: dict[str, str] = {}  # folders of local sessions that name none


def scratch_folder(spark: SparkSession) -> str:
    """A new folder below the one the cluster names in ``spark.checkpoint.dir``.

    Only a local session without the setting gets a folder of its own; a cluster session without it is
    an error, because a machine-local folder would not be visible to the other executors.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="spark-")
        root = _LOCAL[app]
    return f"{root}/{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """Write the rows to the shared folder and go on from the written table.

    Survives the loss of executors. A written table also forgets the inferred constraints of its plan,
    which a checkpoint keeps and which grow with every round of a loop. ``instead_of`` is a table of an earlier
    round that nothing reads any more: its files go once the new table is complete.
    """
    spark = df.sparkSession
    folder = scratch_folder(spark)
    df.write.parquet(folder)
    out = spark.read.schema(df.schema).parquet(folder)
    out.written_to = folder
    old = getattr(instead_of, "written_to", None)
    if old is not None:
        path = spark._jvm.org.apache.hadoop.fs.Path(old)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return out
