"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import functools
import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Bytes other than ASCII letters, digits and UTF-8 lead or continuation bytes become spaces.
WORD_TABLE = bytes(
    b if b >= 0x80 or chr(b).isalnum() else 0x20
    for b in bytes(range(256)).lower()
)


#: Bytes of an Arrow batch, and rows that a reader of Parquet decodes at a time (their texts lie in one array).
BATCH_BYTES, READ_ROWS = 1 << 20, 512
#: Bytes that a Python object in a cache takes beside its contents, about.
OBJECT = 100
_SPACE = re.compile(rb"[ \t\n\r\x0b\x0c]")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, size: int = 128 << 20) -> int:
    """Partitions for a shuffle of whole texts: those of the session, and more where the plan's estimate of df's bytes asks for it."""
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(partitions(df.sparkSession), min(estimate // size, 1 << 20) if estimate < 1 << 60 else 0)


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, which every executor sees.

    The setting is read from the session. Only a local session may lack it,
    where the driver and the executors are one process.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "/tmp/checkpoints"
    return f"{base.rstrip('/')}/millrace-{uuid.uuid4().hex}"


def stored(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there, and a lost executor loses nothing."""
    path = shared_dir(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: str | Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    col = F.col(text) if isinstance(text, str) else text
    return F.translate(F.coalesce(col, F.lit("")), UPPER, LOWER)


def crc_bucket(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n (a null id counts as the empty text)."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit(""))) % n


def texts_of(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """The UTF-8 bytes of a string column, null as empty."""
    col = batch.column(batch.schema.get_field_index(name))
    return [x or b"" for x in col.cast(pa.large_binary()).to_pylist()]


def pieces(raw: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """A text in pieces of about size bytes that end before white space; a longer word stays whole."""
    at = 0
    while len(raw) - at > size:
        cut = _SPACE.search(raw, at + size)
        if cut is None:
            break
        yield raw[at : cut.start()]
        at = cut.start()
    yield raw[at:] if at else raw


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that df lacks, whatever extra columns it brings."""
    have, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out


def bounded(spark: SparkSession) -> None:
    """Keep Arrow batches small: texts can be long, and a Python worker holds several copies of a batch. The same for batches of Parquet's reader."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, "64m").lower().rstrip("b")
    size = int(now.rstrip("kmg")) << {"k": 10, "m": 20, "g": 30}.get(now[-1], 0)
    if size <= 0 or size > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    rows = "spark.sql.parquet.columnarReaderBatchSize"
    if int(spark.conf.get(rows, "4096")) > READ_ROWS:
        spark.conf.set(rows, str(READ_ROWS))


@functools.cache
def _libc(name: str) -> Callable[..., int]:
    """A function of the C library; one that does nothing if it lacks it."""
    return getattr(ctypes.CDLL(None), name, lambda *_: 0)


def roomy() -> None:
    """Keep the memory of arrays that come and go at hand until released(): to fetch its pages anew costs as much as the arithmetic. Holds for the process."""
    for what in (-1, -3):  # M_TRIM_THRESHOLD, M_MMAP_THRESHOLD
        _libc("mallopt")(what, 1 << 30)


def released() -> None:
    """Hand free memory back to the system: a worker outlives its task and would keep the most that it ever held."""
    pa.default_memory_pool().release_unused()
    _libc("malloc_trim")(0)


def annotate(
    docs: DataFrame,
    per_batch: Callable[[], Callable[[list[bytes]], list[pa.Array]]],
    fields: Iterable[tuple[str, T.DataType]],
    text: str = "text",
    keep_text: bool = True,
) -> DataFrame:
    """Append columns computed from each row's text, batch by batch, without a shuffle.

    ``per_batch()`` is called once in each task and returns the function that maps
    a batch of texts to one Arrow array per field.
    """
    bounded(docs.sparkSession)
    fields = list(fields)
    kept = [f for f in docs.schema.fields if keep_text or f.name != text]
    schema = T.StructType(kept + [T.StructField(n, t) for n, t in fields])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = per_batch()
        try:
            for batch in batches:
                made = work(texts_of(batch, text))
                cols = [batch.column(batch.schema.get_field_index(n)) for n in names]
                yield pa.RecordBatch.from_arrays([*cols, *made], names=[*names, *(n for n, _ in fields)])
        finally:  # a worker outlives its task
            getattr(work, "close", lambda: None)()
            work = batch = made = cols = None
            released()

    return docs.mapInArrow(run, schema)
