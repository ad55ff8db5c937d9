"""The folder that driver and executors share, and the tables saved there: scopes that delete them, and `release`."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: The open scopes of this thread or task, the innermost last: paths that go when the scope ends.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())
#: Paths that no scope owns, by application: tables behind results. `release` deletes them.
_kept: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset a local session gets a folder of its own; a cluster has none that all its
    machines see, so there it is an error."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/millrace-{sc.applicationId}"


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables saved inside are deleted at the end; what is still needed must be saved as `lasting`, or written elsewhere.
    Scopes belong to the thread that opened them, so queries in several threads don't touch each other's tables."""
    own: list[str] = []
    token = _scopes.set((*_scopes.get(), own))
    try:
        yield
    finally:
        _scopes.reset(token)
        for path in own:
            delete(spark, path)


@contextlib.contextmanager
def unscoped() -> Iterator[None]:
    """Tables saved inside belong to no open scope but to `release`: for a result that outlives the scope it is made in."""
    token = _scopes.set(())
    try:
        yield
    finally:
        _scopes.reset(token)


def register(spark: SparkSession, path: str, lasting: bool = False) -> None:
    """Gives a path to the innermost scope (a lasting one to the scope around it), or where there is none to `release`."""
    scopes = _scopes.get()[: -1 if lasting else None]
    (scopes[-1] if scopes else _kept.setdefault(spark.sparkContext.applicationId, [])).append(path)


def release(spark: SparkSession) -> int:
    """Deletes the tables behind all results made so far, which can't be read afterwards, and says how many there were."""
    paths = _kept.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        delete(spark, path)
    return len(paths)


def new_path(spark: SparkSession, name: str, lasting: bool = False) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    register(spark, path, lasting)
    return path


def saved(df: DataFrame, name: str, lasting: bool = False, by: Sequence[str] = (), **options: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends here and lost executors cost nothing. A lasting
    table outlives the innermost scratch, not the one around it. `by` names columns whose values get a folder each."""
    path = new_path(df.sparkSession, name, lasting)
    df.write.options(**options).partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
