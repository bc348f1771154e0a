"""What every operator of this folder needs: code on the executors, Arrow batches, table reading, the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that one inner batch of a Python task holds; bounds its memory.
CHUNK_CHARS = 2_000_000

_shipped: set[str] = set()


#: Rows of an Arrow batch between Spark and Python.  Spark's default of 10,000 suits narrow rows; whole texts of that many
#: rows, on their way there and back, would take hundreds of MB outside the heap.
BATCH_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once for each application (they may not have the driver's path)."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == 10_000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    path = os.path.join(tempfile.mkdtemp(), f"densigrid_{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "densigrid")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once for each row."""
    return F.transform(F.array(value), use)[0]


def text_id(text: Column) -> Column:
    """128 bits that stand for a text: so many that no two texts of any corpus are taken for one by chance."""
    return F.unhex(F.md5(F.encode(text, "UTF-8")))


def quoted(name: str) -> str:
    """A column's name as Spark's expressions take it, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one, that no column of ``df`` has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; one on this machine only where all of Spark runs on it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), "densigrid-shared")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate results, in whatever file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read back from the shared folder: later work does not repeat what made them."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts with about CHUNK_CHARS characters together (one text at least)."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > CHUNK_CHARS:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


_kept: dict = {}


def kept(key: tuple, make: Callable[[], object]):
    """What this Python worker keeps from task to task: the last thing asked for, and nothing beside it, as Spark gives one
    worker the tasks of all operators in turn."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def forget() -> None:
    _kept.clear()


def map_texts(df: DataFrame, make: Callable[[], Callable[[list[str]], dict]], fields: str, keep: list[str], text: str = "text", null: str | None = "", keeps: bool = False) -> DataFrame:
    """Columns ``keep`` and those that the function of ``make()`` gives for the column ``text``, batch by batch.

    ``make`` runs once in each task; null texts reach the function as ``null``.  Unless ``make`` ``keeps`` something from task to
    task (see ``kept``), what others kept is dropped first.
    """
    ship(df.sparkSession)
    n = len(keep)
    at = keep.index(text) if text in keep and dict(df.dtypes)[text] == "string" else n
    # Numbered names on the way, as Arrow plans take no names that need quotes.  A text that is kept need not be sent twice.
    names = [f"kept{i}" for i in range(n)]
    source = df.select(*[F.col(quoted(c)).alias(k) for c, k in zip(keep, names)], *[F.col(text).cast("string").alias("sent")] * (at == n))
    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields[:n])
    schema = f"{head}, {fields}" if keep else fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            forget()
        work = make()
        for batch in batches:
            texts = [null if t is None else t for t in batch.column(at).to_pylist()]
            for a, b in chunks([t or "" for t in texts]):
                made = work(texts[a:b])
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in range(n)] + [v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v) for v in made.values()],
                    names=[*names, *made],
                )

    out = source.mapInArrow(run, schema)
    return out.toDF(*keep, *out.columns[n:])


#: Rows, and bytes in columns of no fixed width, up to which a materialised list of keys is broadcast; beyond it, both sides
#: are shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32_000_000


def small(df: DataFrame) -> DataFrame:
    """A materialised narrow table, marked for broadcast only if its counted size is within the bounds."""
    kept = cut(df)
    wide = [F.col(quoted(n)) for n, t in kept.dtypes if t in ("string", "binary") or "<" in t]
    size = F.sum(F.octet_length(F.to_json(F.struct(*wide)))) if wide else F.lit(0)
    rows, used = kept.agg(F.count("*"), size).first()
    return F.broadcast(kept) if rows <= BROADCAST_ROWS and (used or 0) <= BROADCAST_BYTES else kept
