"""What the operators of this subpackage share: intermediate tables, ids, Arrow plumbing."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

_written: list[tuple[SparkSession, str]] = []
_held: list[DataFrame] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it. Where that is unset, a temporary
    folder of this machine will do if executors run here too; on a cluster it is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lodegraph-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back.

    This cuts the lineage: what has been written survives lost executors, and later passes read it instead of
    computing it again. The tables are removed when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def hold(df: DataFrame) -> DataFrame:
    """Keep the rows on the executors' disks from when they are first worked out: for what is used several times but is
    quickly made again, as far as a lost executor takes it along."""
    _held.append(df.persist(StorageLevel.DISK_ONLY))
    return _held[-1]


def tables_now() -> tuple[int, int]:
    """How many tables are written and held, for :func:`forget_tables`."""
    return len(_written), len(_held)


def forget_tables(since: tuple[int, int] = (0, 0), keep: int = 0) -> None:
    """Remove the tables written and give back those held since then, but for the last ``keep`` written."""
    while len(_held) > since[1]:
        try:
            _held.pop().unpersist()
        except Exception:  # the session may have ended
            break
    kept = _written[len(_written) - keep :]
    del _written[len(_written) - keep :]
    _forget_written(since[0])
    _written.extend(kept)


def _forget_written(since: int) -> None:
    while len(_written) > since:
        spark, path = _written.pop()
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
        except Exception:  # the JVM may have ended before Python; nothing is left to do then
            return


atexit.register(forget_tables)


#: Keys that have over 1 / HOT of all rows are joined by broadcast: there are at most HOT of them, whatever the data.
HOT = 1000
#: Rows of a key that one task can take in any case.
FEW = 100_000


def join_counted(rows: DataFrame, small: DataFrame, key: str, count: str, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """``rows`` joined with ``small``, which has one row a key; its column ``count`` says how many of ``rows`` have that key.

    The few keys that hold much of the rows do not meet in one task: they are broadcast, and only the others shuffled.
    ``how`` is inner or left_semi. The count does not come along. ``counts`` is a written table with the same counts, for
    a ``small`` that is dear to work out.
    """
    counts = small if counts is None else counts
    total = counts.agg(F.sum(count)).first()[0] or 0
    many = F.col(count) > max(total // HOT, FEW)
    if counts.where(many).isEmpty():
        return rows.join(small.drop(count), key, how)
    rest = rows.join(small.where(~many).drop(count), key, how)
    return rest.unionByName(rows.join(F.broadcast(small.where(many).drop(count)), key, how))


def id_crc(column: str = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def id_crc_py(value: object) -> int:
    return zlib.crc32(b"" if value is None else str(value).encode())


def utf8_texts(column: pa.Array) -> Iterator[bytes]:
    """The texts of a string column as UTF-8, null as empty, one at a time and without a second copy of the batch."""
    binary = column.cast(pa.binary()) if pa.types.is_string(column.type) else column.cast(pa.large_binary())
    for value in binary:
        yield value.as_py() or b""


#: What drops the caches that operators keep in a worker from task to task.
dropped_when_lean: list[Callable[[], None]] = []


def lean_memory() -> None:
    """In a worker that handles large arrays: drop what other operators remember there, and give back to the system at once what is freed, where its allocator can be
    told to (blocks of a megabyte and more get their own mapping), and what is kept free for later."""
    for drop in dropped_when_lean:
        drop()
    pa.default_memory_pool().release_unused()
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 1 << 20)
        libc.malloc_trim(0)
    except (OSError, AttributeError):
        return
