"""Makes this package importable in the Python workers of a cluster, and keeps what goes to them at once small."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Bytes of an Arrow batch, instead of Spark's 64 MB: executors and workers keep the memory of the largest that they have had.
ARROW_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m")


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once per application. Unless the session names a size of Arrow batches, set it."""
    name, default, ours = ARROW_BYTES
    if spark.conf.get(name) == default:
        spark.conf.set(name, ours)
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="spark-marketloom-")) / f"{package.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(path))
    _shipped.add(context.applicationId)
