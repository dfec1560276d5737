"""What the operators of this package share."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this library to the executors once per application, as a job submitted with its own code would be
    (``--py-files``); Python workers then import it whatever folder they run in."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        path = os.path.join(tempfile.mkdtemp(prefix="ledgerloom-py-"), "ledgerloom_code.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(package):
                for n in sorted(names):
                    if n.endswith(".py"):
                        full = os.path.join(folder, n)
                        z.write(full, os.path.relpath(full, os.path.dirname(package)))
        spark.sparkContext.addPyFile(path)
        _SHIPPED.add(app)
    return spark


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """The wanted column names, each lengthened until no column of ``taken`` has it (Spark doesn't tell cases apart)."""
    lower = {c.lower() for c in taken}
    out = []
    for name in wanted:
        while name.lower() in lower:
            name += "_"
        out.append(name)
    return out
