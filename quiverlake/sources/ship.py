"""Hand this package to the executors, whose Python need not have it on its path."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once an application: zip the package into the shared folder of ``spark.checkpoint.dir`` and add it to the workers' path. Starts no Python worker."""
    sc = spark.sparkContext
    if sc.applicationId in _done:
        return
    package, packed = Path(__file__).resolve().parent.parent, io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not root:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quiverlake-")
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/quiverlake-{uuid.uuid4().hex}.zip")
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    stream = fs.create(path, True)
    try:
        stream.write(bytearray(packed.getvalue()))
    finally:
        stream.close()
    sc.addPyFile(fs.makeQualified(path).toString())
    _done.add(sc.applicationId)
