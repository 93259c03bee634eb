"""Session helpers: scratch locations on shared storage and lineage cuts."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path
from zipfile import ZipFile

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def local_session(cores: int = 8, app: str = "terraflow") -> SparkSession:
    """A small local session for tests and benches."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Temporary folders of local sessions, by application.
_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach.

    A cluster names it in ``spark.checkpoint.dir``. Where that is unset, a
    session in one process (tests, a laptop) gets a temporary folder; on a
    cluster such a folder would be another one on every machine, so it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="terraflow-")
    return _LOCAL[app]


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Gives the package to the Python workers of a session, once.

    Nothing is done where the workers find it by themselves: started in its
    folder, installed, or with that folder in PYTHONPATH.
    """
    root = Path(__file__).resolve().parent.parent
    places = {Path(p).resolve() for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)] if p}
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or root in places or root.name in ("site-packages", "dist-packages"):
        return
    _SHIPPED.add(app)
    archive = Path(tempfile.mkdtemp(prefix="terraflow-")) / "terraflow.zip"
    with ZipFile(archive, "w") as out:
        for file in sorted((root / "terraflow").rglob("*.py")):
            out.write(file, file.relative_to(root))
    spark.sparkContext.addPyFile(str(archive))


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path for one intermediate table or file sink."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


#: Rows up to which the planner may broadcast a written table by the size of its files.
BROADCAST_ROWS = 200_000


def shuffled(df: DataFrame) -> DataFrame:
    """The table, never broadcast by an estimate.

    Files of repetitive rows, and a table before its rows are exploded, are far
    smaller than the rows that a broadcast holds in the driver.
    """
    return df.hint("merge")


def materialize(df: DataFrame, label: str = "step", hinted: bool = True) -> DataFrame:
    """Cut the lineage of an iterative step by a written Parquet table.

    Written tables survive lost executors. Their rows are counted while they are
    written, and those of many rows are joined by a shuffle. Without ``hinted`` they
    may be the large side of a broadcast join.
    """
    return _written(df, label, F.count(F.lit(1)).alias("n"), hinted=hinted)[0]


def _written(df: DataFrame, label: str, *counts: Column, hinted: bool = True) -> tuple[DataFrame, dict]:
    """The written table, and what was observed while it was written, ``n`` being its rows."""
    spark, seen = df.sparkSession, Observation()
    path = scratch_path(spark, label)
    df.observe(seen, *counts).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    return (out if not hinted or seen.get["n"] <= BROADCAST_ROWS else shuffled(out)), seen.get


_ONCE: dict[tuple[str, str, str], tuple[str, StructType, bool]] = {}


def once(spark: SparkSession, label: str, source: str, make: Callable[[], DataFrame], write: Callable[[DataFrame], str] | None = None) -> DataFrame:
    """A table derived from the files of ``source``, written by the first query that needs it and read by later ones.

    Kept for one application and one shared folder; made anew where the written table is gone.
    The files of ``source`` must not change meanwhile. ``write`` lays the table out and returns its path.
    """
    key = (f"{spark.sparkContext.applicationId} {shared_folder(spark)}", label, source)
    if key in _ONCE:
        path, schema, small = _ONCE[key]
        try:
            out = spark.read.schema(schema).parquet(path)
            return out if small else shuffled(out)
        except AnalysisException:  # cleared by the owner of the folder
            del _ONCE[key]
    df = make()
    if write is None:
        path = scratch_path(spark, label)
        df.write.parquet(path)
    else:
        path = write(df)
    out = spark.read.parquet(path)
    small = out.count() <= BROADCAST_ROWS
    _ONCE[key] = path, out.schema, small
    return out if small else shuffled(out)


def materialize_some(df: DataFrame, label: str, wanted: Column | None = None) -> tuple[DataFrame, bool]:
    """Written table, and whether it has a row (for which ``wanted`` holds).

    The answer is observed while the table is written, so it costs no job.
    """
    count = F.count(F.lit(1)) if wanted is None else F.count_if(wanted)
    out, seen = _written(df, label, F.count(F.lit(1)).alias("n"), count.alias("some"))
    return out, seen["some"] > 0
