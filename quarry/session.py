"""SparkSession construction and shared-folder helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str | None = None, partitions: int | None = None,
                  app: str = "quarry") -> SparkSession:
    """Session tuned for this library: AQE on, UI off, UTC, Arrow on."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    partitions = partitions or int(os.environ.get("QUARRY_SHUFFLE_PARTITIONS", cpus))
    spark = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("QUARRY_DRIVER_MEMORY", "16g"))
        .config("spark.sql.files.maxPartitionBytes", str(64 * 1024 * 1024))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


_SHIPPED: set[str] = set()


def configure(spark: SparkSession) -> None:
    """Settings every operator relies on; safe to call on a foreign session."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # large Arrow batches for narrow rows, bounded by bytes for wide ones
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 * 1024 * 1024))
    checkpoint_dir(spark)
    ship_package(spark)


def ship_package(spark: SparkSession) -> None:
    """Make ``quarry`` importable in Python workers (Arrow functions pickle by reference)."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    import zipfile

    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="quarry-pkg-"), "quarry.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _dirs, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    spark.sparkContext.addPyFile(out)
    _SHIPPED.add(app)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster the deployment sets it to shared storage; we only pick a
    local scratch folder when it is unset (tests, local runs).
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="quarry-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(current)
    return current


_SCRATCH: dict[str, list[str]] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh directory under the shared checkpoint folder."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    _SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def scratch_mark(spark: SparkSession) -> int:
    """How many scratch directories the application has made so far (see ``clear_scratch``)."""
    return len(_SCRATCH.get(spark.sparkContext.applicationId, ()))


def clear_scratch(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Delete the scratch directories made after a mark, once what was built on them is written elsewhere."""
    made = _SCRATCH.get(spark.sparkContext.applicationId, [])
    for path in made[since:]:
        if path not in keep:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    made[since:] = [p for p in made[since:] if p in keep]


def pin(df):
    """Cut lineage at a reused intermediate: write it as a Parquet table under the
    shared checkpoint folder and read it back (survives executor loss; columnar,
    so cheaper than a row checkpoint; never a machine-local checkpoint)."""
    spark = df.sparkSession
    path = scratch_path(spark, "pin")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


ROWS_BROADCAST = 3_000_000  # rows of keys that are sent to the executors (some 200 MB there); more are exchanged


def sent(keys):
    """A written table of narrow keys, marked to be sent to the executors whole as long as it has few rows,
    so that wide rows meet it where they are."""
    from pyspark.sql import functions as F
    return F.broadcast(keys) if keys.count() <= ROWS_BROADCAST else keys
