"""Session helpers: a local session for tests and benches, and the
checkpoint folder used to cut lineage in iterative jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "framescope") -> SparkSession:
    """A local session configured the way the tests and the bench run."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder of this session.

    On a cluster the folder comes from ``spark.checkpoint.dir`` (a shared
    file system) and its absence is an error. Only a local-mode session
    without the setting (tests) gets a fresh scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        try:
            configured = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset key
            configured = None
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        configured = tempfile.mkdtemp(prefix="framescope-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def written(df, name: str):
    """Write a frame below the session's checkpoint folder and read it back:
    its rows outlive lost executors (no lineage, no executor's own disk) and
    later steps do not compute them again."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def run_concurrently(*steps):
    """Run independent eager steps (each a zero-argument callable that
    triggers Spark jobs) from separate driver threads, so their jobs share
    the cluster instead of queueing behind each other; results in order."""
    from concurrent.futures import ThreadPoolExecutor

    if len(steps) <= 1:
        return [s() for s in steps]
    with ThreadPoolExecutor(max_workers=len(steps)) as pool:
        futures = [pool.submit(s) for s in steps]
        return [f.result() for f in futures]
