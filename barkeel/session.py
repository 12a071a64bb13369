"""Session helpers: builder defaults for local use, durable intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "*", partitions: int = 8, app: str = "barkeel") -> SparkSession:
    """A session for tests and benches on one machine; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only a local master may do without that setting; it then gets a temporary
    folder that is removed at exit.  On a cluster the absence is an error, as a
    machine-local folder would lose data with its machine.
    """
    conf = spark.sparkContext.getConf()
    named = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    own = tempfile.mkdtemp(prefix="barkeel-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", own)
    return own


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that workers can import it anywhere."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    package = Path(__file__).resolve().parent
    here = tempfile.mkdtemp(prefix="barkeel-code-")  # the driver serves the file from here as long as it lives
    atexit.register(shutil.rmtree, here, ignore_errors=True)
    path = Path(here) / f"barkeel-{uuid.uuid4().hex}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(path))


_WRITTEN: list[str] = []


def durable(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends there.

    Lost executors cost nothing but the re-read of files.  On a local master the
    table is removed when Python ends; on a cluster by ``clear_durable``, once the
    results that read it are written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/barkeel-{uuid.uuid4().hex}"
    out = df.write.option("compression", "zstd")
    if partition_by:
        out = out.partitionBy(*partition_by)
    out.parquet(path)
    _WRITTEN.append(path)
    if spark.sparkContext.master.startswith("local["):
        atexit.register(shutil.rmtree, path.removeprefix("file://"), ignore_errors=True)
    return spark.read.schema(df.schema).parquet(path)


def clear_durable(spark: SparkSession) -> int:
    """Remove the tables that ``durable`` wrote in this process; frames that read them end with them."""
    removed = 0
    while _WRITTEN:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        removed += bool(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True))
    return removed


def watched(df: DataFrame, callback: Callable[[int, int], None], pause: float = 0.2) -> DataFrame:
    """``durable(df)`` that tells a callback how many of the tasks known so far are done: first (0, 0), last (n, n)."""
    context, group, done = df.sparkSession.sparkContext, f"watched-{uuid.uuid4().hex}", threading.Event()
    seen = [0, 0]

    def tell() -> None:
        tracker = context.statusTracker()
        stages = {s: i for j in tracker.getJobIdsForGroup(group) if (job := tracker.getJobInfo(j)) for s in job.stageIds if (i := tracker.getStageInfo(s))}
        now = [sum(i.numCompletedTasks for i in stages.values()), sum(i.numTasks for i in stages.values())]
        if now != seen and now[1] >= seen[1] and now[0] >= seen[0]:
            seen[:] = now
            callback(*now)

    def watch() -> None:
        while not done.wait(pause):
            tell()

    callback(0, 0)
    watcher = threading.Thread(target=watch, daemon=True)
    context.setJobGroup(group, "watched")
    watcher.start()
    try:
        return durable(df)
    finally:
        done.set()
        watcher.join()
        context.setLocalProperty("spark.jobGroup.id", None)
        callback(max(seen[1], 1), max(seen[1], 1))
