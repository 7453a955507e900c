"""The package as one zip for the workers of a session that was started elsewhere."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent


def ship_code(spark: SparkSession) -> str:
    """Sends this package to every executor, present and future, unless it is installed there; the path of the zip on the driver.

    Spark copies the file from the driver, so its folder needs not be shared.
    """
    path = Path(tempfile.mkdtemp(prefix="loamlake-ship-")) / "loamlake.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(PACKAGE.rglob("*.py")):
            z.write(file, Path("loamlake") / file.relative_to(PACKAGE))
    spark.sparkContext.addPyFile(str(path))
    return str(path)
