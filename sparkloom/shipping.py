"""Makes the package importable in Python workers and gives access to the shared folder."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once per application, as ``--py-files`` would.

    The archive is served by the driver, so executors need no shared folder for it.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        archive = os.path.join(tempfile.mkdtemp(prefix="sparkloom-"), "sparkloom_pkg.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, str(Path(root.name) / p.relative_to(root)))
        sc.addPyFile(archive)
        _shipped.add(sc.applicationId)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which the driver and all executors share; one of
    our own only where the session names none, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    at = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not named and not at.isDefined():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sparkloom-cp-"))
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
    return named or at.get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint in :func:`shared_folder`."""
    folder = shared_folder(df.sparkSession)
    if not df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        df.sparkSession.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
