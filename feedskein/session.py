"""Session settings and the shared folder for written intermediate tables."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master=None, app_name="feedskein", **conf) -> SparkSession:
    """A session with the settings the engine relies on; a cluster supplies the rest."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.maxMetadataStringLength", "1000")  # so that plans show which folders they read
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir, the folder all executors share.

    A machine-local folder stands in only for a local master with the setting unset.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="feedskein-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(frame: DataFrame, name: str) -> DataFrame:
    """frame written to the shared folder and read back.

    For a result that several steps use: it is computed once, outlives lost executors, and
    its size is known when the joins on it are planned.
    """
    path = scratch_dir(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
MOST_ARROW_ROWS = 1000  # whole documents and pages go to Python: ten thousand of them are hundreds of MB


def limit_arrow_rows(spark: SparkSession) -> None:
    """No more than MOST_ARROW_ROWS rows at a time to and from Python; a smaller number stays."""
    given = int(spark.conf.get(ARROW_ROWS))
    spark.conf.set(ARROW_ROWS, str(min(given, MOST_ARROW_ROWS) if given > 0 else MOST_ARROW_ROWS))


def estimated_bytes(frame: DataFrame):
    """Spark's own estimate of the size of frame; None for clients that cannot see the plan."""
    if not hasattr(frame, "_jdf"):
        return None
    return int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


MOST_PARTITIONS = 50_000  # every map task keeps an index entry for each


def size_shuffles(spark: SparkSession, *inputs: DataFrame, per_task=128 * 1024 * 1024, growth=4) -> int:
    """Set the number of shuffle partitions for jobs that shuffle these inputs: one per
    `per_task` bytes, taking files to grow by `growth` when read, and never fewer than are
    set now. Adaptive execution merges those that turn out small, but cannot split ones
    that a too low number made large."""
    expected = growth * sum(estimated_bytes(frame) or 0 for frame in inputs)
    present = int(spark.conf.get("spark.sql.shuffle.partitions"))
    number = max(present, min(-(-expected // per_task), MOST_PARTITIONS))
    spark.conf.set("spark.sql.shuffle.partitions", str(number))
    return number
