"""Pieces that several operators share: words, stable hashes, checkpoints, local names."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that part words.
SPACES = " \t\n\x0b\x0c\r"
_SPACE_RUN = r"[\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """body(value) with value computed once. An expression that a lambda names once would else be
    moved into the lambda and run for every element."""
    return F.transform(F.array(value), body)[0]


def text_of(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text, in order; none for null."""
    trimmed = F.btrim(text_of(text), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _SPACE_RUN))


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else (lower() would also change other letters)."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 4. Fold 2 is held out from learning."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


_shipped: set[str] = set()


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """df.mapInArrow() with this package sent along, once for each application, so that workers can
    import it wherever they start."""
    context = df.sparkSession.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).parents[1]
        path = f"{tempfile.mkdtemp(prefix='lodestar-')}/lodestar.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for file in sorted(package.rglob("*")):
                if file.suffix in (".py", ".json"):
                    z.write(file, file.relative_to(package.parent))
        context.addPyFile(path)
        _shipped.add(context.applicationId)
    return df.mapInArrow(function, schema)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it. Only a local
    session, whose executors share the driver's disk, gets one of its own where it names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    if not folder:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        folder = f"file://{tempfile.mkdtemp(prefix='lodestar-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def saved(df: DataFrame, name: str, plain: tuple[str, ...] = ()) -> DataFrame:
    """df as written in the shared folder: cuts the lineage, survives lost executors, and is
    computed once however often it is read. The files live until drop_saved() or with the folder.
    Columns named plain (Parquet's names) hold hashes: no dictionary is tried for them."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lodestar-{name}-{uuid.uuid4().hex}"
    as_is = {f"parquet.enable.dictionary#{column}": "false" for column in plain}
    df.select("*").write.options(**as_is).parquet(path)  # a frame of its own, so that df does not hold on to the shuffles
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def drop_saved(*frames: DataFrame) -> None:
    """Delete what saved() wrote, once everything made from it is written itself."""
    for df in frames:
        if path := getattr(df, "_saved_at", None):
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of stages that nothing refers to any more. It
    acts when the driver collects garbage, which else may be long after the disks are full."""
    for _ in range(2):  # what the first round drops may hold what the second can drop
        gc.collect()
        time.sleep(0.1)  # the driver's Python tells the JVM what it has dropped
        spark._jvm.System.gc()
        time.sleep(0.2)  # the cleaner works in the background
