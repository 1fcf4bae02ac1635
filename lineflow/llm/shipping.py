"""Makes this package importable on executors, and keeps its workers there small."""

from __future__ import annotations

import ctypes
import os
import shutil
import tempfile

from pyspark import SparkFiles
from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give executors the package, once per application, as ``--py-files`` would.

    The archive lies in Spark's own folder of shipped files on the driver, which
    serves it to executors, later ones too.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="package-", dir=SparkFiles.getRootDirectory())
    staged = os.path.join(folder, "source", os.path.basename(package))
    shutil.copytree(package, staged, ignore=shutil.ignore_patterns("__pycache__"))
    archive = shutil.make_archive(os.path.join(folder, "lineflow-package"), "zip", os.path.dirname(staged))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


def give_memory_back() -> None:
    """Return the memory that a worker has freed to the system.

    Spark keeps Python workers for later tasks, also of other stages, beside the
    executor's heap; what they have freed would be missing there.  Where the C library
    has no such call, nothing happens.
    """
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass
