"""Helpers shared by the text operators: shared storage, input normalisation, table loading."""

from __future__ import annotations

import io
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbor.plans.storage import discard, shared_dir, store

_SHIPPED: set[str] = set()


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the input tables by name."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def write_shared(df: DataFrame, name: str) -> str:
    """Write ``df`` once as Parquet to a fresh place in the shared folder; the files go when the application ends.

    Unlike an RDD checkpoint this computes the plan once, is compressed and is read back column by column.
    """
    return _stored(df, name)[1]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` read back from :func:`write_shared`; cuts lineage and survives lost executors."""
    return _stored(df, name)[0]


def _stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    read, path = store(df, name)
    place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(place)
    return read, path


def drop_shared(spark: SparkSession, path: str) -> None:
    """Delete a place written by :func:`write_shared` before the application ends."""
    discard(spark, path)


def ship(spark: SparkSession) -> None:
    """Send the modules of this package to the executors, once for an application, so that they need no copy installed."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    package = Path(__file__).resolve().parents[1]
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for module in sorted(package.rglob("*.py")):
            z.write(module, module.relative_to(package.parent))
    path = f"{shared_dir(spark)}/{package.name}-{uuid.uuid4().hex}.zip"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    out = files.create(place)
    out.write(bytearray(packed.getvalue()))
    out.close()
    files.deleteOnExit(place)
    context.addPyFile(path)


def each_copy(rows: DataFrame, copies: str, nth: str) -> DataFrame:
    """Every row as often as the column ``copies`` says, not at all below 1, with its number ``nth`` from 0. Numbers are made in
    blocks, so that no row holds an array of all of them.
    """
    block, n = 4096, F.col(copies).cast("long")
    blocks = rows.where(n > 0).withColumn(nth, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / block))))
    return blocks.withColumn(nth, F.explode(F.sequence(F.col(nth) * block, F.least(F.col(nth) * block + block, n) - 1)))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have, so that inputs with clashing columns work."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_key(text: Column) -> Column:
    """16-byte identity of a text: equal for equal texts."""
    return F.unhex(F.md5(text.cast("binary")))


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of the id written as text; null ids count as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def quoted(name: str) -> Column:
    """A column by its exact top-level name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")
