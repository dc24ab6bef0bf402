"""Where stored indexes and tables live, and how they are known again.

Executors must see what is written, so everything goes below the folder that
``spark.checkpoint.dir`` names; only local mode may lack it (tests).
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_roots: dict[str, str] = {}
_built: dict[tuple[str, str, str], str] = {}


def file_system(spark: SparkSession, path: str):
    """(Hadoop file system, path): works for every store that Spark can read."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jpath


#: Rows of an Arrow batch: a worker holds whole documents and what is made of them.
ARROW_ROWS = 512


def short_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker holds at once, whatever the size of its partition."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    spark.conf.set(key, str(ARROW_ROWS if now <= 0 else min(now, ARROW_ROWS)))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below this application's shared folder."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = tempfile.mkdtemp(prefix="lexloom-")
            spark.sparkContext.setCheckpointDir(base)
        _roots[app] = f"{base.rstrip('/')}/lexloom-core-{uuid.uuid4().hex}"
    return f"{_roots[app]}/{name}-{uuid.uuid4().hex[:12]}"


def fingerprint(df: DataFrame) -> str:
    """Digest of the names, sizes and times of the files that ``df`` reads."""
    digest = hashlib.sha256()
    for f in sorted(df.inputFiles()):
        fs, path = file_system(df.sparkSession, f)
        status = fs.getFileStatus(path)
        digest.update(f"{f} {status.getLen()} {status.getModificationTime()}\n".encode())
    return digest.hexdigest()


def built_once(df: DataFrame, name: str, build: Callable[[str], None]) -> str:
    """Folder of what ``build`` writes from ``df``: made once per application and state of the files."""
    key = (df.sparkSession.sparkContext.applicationId, name, fingerprint(df))
    if key not in _built:
        path = shared_folder(df.sparkSession, name)
        build(path)
        _built[key] = path
    return _built[key]
