"""What the operators share: tables in the shared folder, word arrays, bounded chunks of Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bytes that separate words: space, and tab to carriage return.
BLANKS = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z; every other character stays, unlike ``lower``."""
    return F.translate(c, _UPPER, _UPPER.lower())


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a session on one machine gets a temporary one; a cluster raises, as no folder of one
    machine would do there.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or (sc._jsc.sc().getCheckpointDir().get() if sc._jsc.sc().getCheckpointDir().isDefined() else None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    import tempfile

    own = tempfile.mkdtemp(prefix="tessera-")
    sc.setCheckpointDir(own)
    return f"file://{own}"


#: The lists that ``noted`` blocks now open keep of the tables written.
_NOTED: list[list[str]] = []


@contextlib.contextmanager
def noted() -> Iterator[list[str]]:
    """A list that gets the paths of the tables that are stored in this block."""
    paths: list[str] = []
    _NOTED.append(paths)
    try:
        yield paths
    finally:
        _NOTED.remove(paths)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: lineage ends there and a lost
    executor costs no recomputation. Whoever returns a result that no longer needs the table drops it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    for paths in _NOTED:
        paths.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables that ``stored`` wrote, once nothing reads them any more."""
    jvm = spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _release() -> None:
    """Gives freed memory back to the system: workers live for many tasks and share an executor's limit."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


_CACHE: dict = {}
_CACHE_STAGE: list[int | None] = [None]


def stage_cache() -> dict:
    """What this worker process keeps between tasks of one stage; the first task of another stage empties it."""
    from pyspark import TaskContext

    task = TaskContext.get()
    stage = task.stageId() if task else None
    if _CACHE_STAGE[0] != stage:
        _CACHE.clear()
        _release()
        _CACHE_STAGE[0] = stage
    return _CACHE


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 6 << 20) -> Iterator[pa.RecordBatch]:
    """Splits batches so that none holds more than ``most`` bytes of text, but for a single longer row."""
    stage_cache()
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(size) // most
        cuts = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            yield batch.slice(int(a), int(b - a))
        _release()


def filled(column: pa.Array) -> pa.Array:
    """Null texts as empty ones, as one array without offset."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pa.concat_arrays([pc.fill_null(column, "")])


def word_array(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order and, for each text, where its words start (one more entry at the end).

    Words are runs of bytes other than space and tab to carriage return."""
    lists = pc.ascii_split_whitespace(texts)
    words = lists.flatten()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    full = pc.greater(pc.binary_length(words), 0)  # blanks at either end leave empty pieces
    keep = full.to_numpy(zero_copy_only=False)
    if not keep.all():
        words = words.filter(full)
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
    return words, offsets


def word_ids(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A number for each word, equal for equal words, and the distinct words by number."""
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def hash_words(distinct: pa.Array) -> np.ndarray:
    """64-bit hashes of distinct words, alike in every process."""
    import xxhash

    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(w.encode("utf-8", "surrogatepass")) for w in distinct.to_pylist()), np.uint64, len(distinct))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n entries of h; entry i is for h[i:i+n]."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[k : k + len(out)]
    return mixed(out)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[0], starts[0]+1, ... (lengths[0] of them), then those of the next run."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def beside(docs: DataFrame, text_col: str, fields: list[tuple[str, str]], judge, most: int = 4 << 20) -> DataFrame:
    """All columns of docs and new ones computed from the text alone, without a join.

    ``judge`` takes an array of texts (null: empty) and returns an array for each of ``fields`` (name, type).
    Columns of docs with the name of a new one are replaced."""
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    made = [StructField(n, _parse_datatype_string(t)) for n, t in fields]
    new = {n.lower() for n, _ in fields}
    own = [f for f in docs.schema.fields if f.name.lower() not in new or f.name == text_col]
    passed = [f for f in own if f.name.lower() not in new]
    rows = docs.select(*(F.col(f"`{f.name}`") for f in passed), F.col(f"`{text_col}`").alias("__bs_text"))

    def run(batches):
        for part in slices(batches, text="__bs_text", most=most):
            got = judge(filled(part.column("__bs_text")))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *got], names=[*(f.name for f in passed), *(n for n, _ in fields)])

    return rows.mapInArrow(run, StructType([*passed, *made]))
