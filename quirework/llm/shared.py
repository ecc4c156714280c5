"""What the operators of this subpackage share: the cluster's shared folder, files in it, worker set-up."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_MADE: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only where that setting is unset (local mode, tests) a temporary folder of this machine stands in.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _OWN.setdefault("root", "file://" + tempfile.mkdtemp(prefix="quirework-"))
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path for a new folder in the shared folder; it goes when the driver ends."""
    if not _MADE:
        atexit.register(_remove_all)
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _MADE.append((spark, path))
    return path


def remove_folder(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _remove_all() -> None:
    for spark, path in _MADE:
        try:
            if spark.sparkContext._jsc is None:
                raise RuntimeError("stopped")
            remove_folder(spark, path)
        except Exception:  # the session may be gone
            if path.startswith("file:/") and _OWN.get("root", "\0") in path:
                import shutil

                shutil.rmtree("/" + path[5:].lstrip("/"), ignore_errors=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends here, and any executor can read it."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession):
    """Removes the folders that are made inside, but those of tables given to what it yields."""
    kept, before = set(), len(_MADE)

    def keep(table: DataFrame) -> DataFrame:
        kept.update(p.rsplit("/", 2)[-2] for p in table.inputFiles())
        return table

    yield keep
    for made in _MADE[before:]:
        if made[1].rsplit("/", 1)[-1] not in kept:
            remove_folder(*made)
            _MADE.remove(made)


def prepare_workers(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it, and give freed Arrow memory back."""
    top = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if top not in paths:
        env["PYTHONPATH"] = os.pathsep.join([top, *(p for p in paths if p)])
    # Arrow's own pool keeps what was freed: about 75 MB of a worker that read batches of 10,000 documents
    env.setdefault("ARROW_DEFAULT_MEMORY_POOL", "system")


def write_file(uri: str, parts) -> int:
    """Writes ``parts`` (bytes) as one file: first under a name of this attempt, then renamed.

    A task that runs again, or twice at once, leaves one whole file.
    """
    from pyarrow import fs
    from pyspark import TaskContext

    context = TaskContext.get()
    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    own = f"{os.path.dirname(path)}/.{os.path.basename(path)}.{context.taskAttemptId() if context else 0}"
    size = 0
    with system.open_output_stream(own) as out:
        for part in parts:
            size += len(part)
            out.write(part)
    try:
        system.move(own, path)
    except OSError:  # stores that don't rename onto a file
        system.delete_file(path)
        system.move(own, path)
    return size


def texts_as_bytes(column) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column; null gives no bytes."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary() if column.type == pa.string() else pa.large_binary()).to_pylist()]


def packed_rows(data, lengths):
    """Consecutive parts of an array as an Arrow column of bytes."""
    import numpy as np
    import pyarrow as pa

    stops = np.concatenate(([0], np.cumsum(lengths) * data.itemsize))
    if stops[-1] < 1 << 31:
        return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(stops.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
    return pa.array([data[a:b].tobytes() for a, b in zip(stops[:-1] // data.itemsize, stops[1:] // data.itemsize)], pa.binary())
