"""Session settings and lineage cuts shared by every operator."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", partitions: int = 8, app: str = "framewright") -> SparkSession:
    """A session for one machine (tests, benchmark). A cluster brings its own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a scratch folder only on a local master."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="framewright-"))
    return context.getCheckpointDir()


_made: list[str] = []  # paths handed out and not released yet


def scratch_path(spark: SparkSession) -> str:
    """A new path inside the shared folder, for a table written in passing. ``scratch`` removes what was written."""
    _made.append(f"{shared_folder(spark)}/{uuid.uuid4().hex}")
    return _made[-1]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes, at its end, the tables that operators wrote in passing inside it.

    Operators give back lazy tables that read those files, so what is wanted of them must be written (or collected) inside, too.
    """
    before = len(_made)
    try:
        yield
    finally:
        ended, _made[before:] = _made[before:], []
        for name in ended:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the files.

    The files survive a lost executor, and rows keep the partition and the order they had.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
