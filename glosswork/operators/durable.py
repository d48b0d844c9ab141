"""What outlives tasks: tables in the shared folder, and the package itself on executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where it is unset and Spark runs in one process, as in tests, a temporary one."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or getattr(spark.sparkContext, "_glosswork_shared", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = spark.sparkContext._glosswork_shared = "file://" + tempfile.mkdtemp(prefix="glosswork-")
    return at.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """``df`` written once and read again."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for a context, so that Python functions load where it isn't installed."""
    context = spark.sparkContext
    if getattr(context, "_glosswork_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    if not package.is_dir():  # it runs from an archive that was shipped already
        return
    path = Path(tempfile.mkdtemp(prefix="glosswork-")) / f"{package.name}.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(path))
    context._glosswork_shipped = True


#: Most bytes of one Arrow batch that Python functions are handed; a row longer than this travels alone.
BATCH_BYTES = 16 << 20


def bound_batches(spark: SparkSession) -> None:
    """Before Python functions run on rows of blocks: ship the package, and bound Arrow batches by bytes."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
