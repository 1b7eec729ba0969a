"""What the operators of this folder share: packing rows, checkpoints, and reading tables."""

from __future__ import annotations

import atexit
import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bounds of one Arrow batch between the JVM and Python. Texts may be long, so batches end at whichever is met first.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 8_000_000}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Hold Arrow batches to ``BATCH``, so that a worker has few long texts in memory at once, however long they are.

    Plans are lazy and read these options when they run, so they are the session's from then on; all operators use the
    same bounds, and tighter ones that the session already has stay.
    """
    for key, most in BATCH.items():
        now = int(spark.conf.get(key).rstrip("b"))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def whole_numbers(df: DataFrame, column: str) -> None:
    """Refuse ids that are no whole numbers at the call, not in a task."""
    kind = df.select(df[f"`{column}`"]).schema[0].dataType
    if not isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise TypeError(f"{column} must hold whole numbers, not {kind.simpleString()}")


def once(kind: str, key: object, make: Callable[[], object]):
    """What ``make`` builds, kept for the later tasks of this worker process; of each kind only the last is held."""
    held = sys.__dict__.setdefault("_strandweave_held", {})
    if kind not in held or held[kind][0] != key:
        held.pop(kind, None)
        held[kind] = (key, make())
    return held[kind][1]


def forget(module: str) -> None:
    """Drop what other operators than that of ``module`` left in this worker process: workers go from one stage to the next, and
    a tokenizer's tables would otherwise stay in memory beside whatever comes after it."""
    held = sys.__dict__.get("_strandweave_held", {})
    other = [kind for kind in held if kind.partition(".")[0] != module.rpartition(".")[2]]
    for kind in other:
        del held[kind]
    if other:
        gc.collect()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass


def labelled(docs: DataFrame, text_col: str, id_col: str, labels: DataFrame, label_col: str, most_bytes: int) -> DataFrame:
    """_i and _y: each id that has a text of at most ``most_bytes`` bytes and one label (0 or 1), once. Rows that repeat
    an id don't multiply; an id with contradicting labels is left out."""
    known = labels.filter(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_i")).agg(F.min(label_col).cast("int").alias("_y"), F.max(label_col).cast("int").alias("_z"))
    ids = docs.filter(F.octet_length(docs[f"`{text_col}`"]) <= most_bytes).select(docs[f"`{id_col}`"].alias("_i"))
    return ids.join(known.filter("_y = _z").select("_i", "_y"), "_i").dropDuplicates(["_i"])


def texts_with(docs: DataFrame, text_col: str, id_col: str, chosen: DataFrame, most_bytes: int) -> list[tuple[str, int]]:
    """(text, label) of ``chosen`` (_i and _y, a bounded table of distinct ids) in order of id; of several texts with one id
    the least within the bound."""
    slim = docs.filter(F.octet_length(docs[f"`{text_col}`"]) <= most_bytes).select(docs[f"`{id_col}`"].alias("_i"), docs[f"`{text_col}`"].alias("_t"))
    rows = slim.join(F.broadcast(chosen), "_i").groupBy("_i", "_y").agg(F.min("_t").alias("_t")).collect()
    return [(r["_t"], r["_y"]) for r in sorted(rows, key=lambda r: r["_i"])]


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: the session's own setting, or a temporary one in plain local mode only."""
    sc = spark.sparkContext
    told = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if told:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(told)
        return told
    master = sc.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(made := tempfile.mkdtemp(prefix="strandweave-"))
    return made


def cut(df: DataFrame) -> DataFrame:
    """``df``, computed once and read back from the shared checkpoint folder; lost executors can't lose it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder, read back; the folder goes when the driver ends."""
    spark = df.sparkSession
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/strandweave-{spark.sparkContext.applicationId}"
    path = f"{base}/{uuid.uuid4().hex}"
    # The table holds the result, so the shuffle files behind it may go as soon as it is written.
    told = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if told is None else spark.conf.set(CLEANUP, told)
    if base not in _made:
        _made.add(base)
        atexit.register(_drop, spark, base)
    return spark.read.schema(df.schema).parquet(path)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_made: set[str] = set()


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:  # the session may have ended first; the folder is a temporary one
        pass


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files that nothing refers to any more, before the next large exchange."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def map_rows(
    df: DataFrame,
    needs: dict[str, str],
    make: Callable[[], Callable[[dict[str, pa.Array]], list[pa.Array]]],
    out: T.StructType,
) -> DataFrame:
    """Add columns to whole rows with an Arrow function, without a shuffle and without clashing names.

    The result has two struct columns: ``row`` (the input row, untouched) and ``out`` (the new values).
    ``needs`` maps the function's argument names to columns of ``df``. ``make`` runs once per task and
    returns the function from argument arrays to output arrays, in the order of ``out``.
    """
    packed = df.select(
        F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row"),
        *[df[f"`{c}`"].alias(f"arg_{a}") for a, c in needs.items()],
    )
    schema = T.StructType([T.StructField("row", packed.schema["row"].dataType), T.StructField("out", out)])
    names, fields = list(needs), out.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(make.__module__)
        call = make()
        for b in batches:
            if not b.num_rows:
                continue
            made = call({a: b.column(b.schema.get_field_index(f"arg_{a}")) for a in names})
            yield pa.RecordBatch.from_arrays([b.column(0), pa.StructArray.from_arrays(made, names=fields)], names=["row", "out"])

    small_batches(df.sparkSession)
    return packed.mapInArrow(run, schema)


def ascii_lower(col):
    """A-Z in lower case; every other character as it is."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
