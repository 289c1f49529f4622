"""What several operators share: stored intermediate tables and byte-level text arrays.

Intermediate tables are written as Parquet under the folder that the session names
in ``spark.checkpoint.dir``, which every executor can read, so a lost executor costs
a re-read and not a recomputation from the start.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: ASCII white space: the bytes that part words, [\x20\x09-\x0D].
SPACES = np.zeros(256, dtype=bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True

#: The same class as a Java / RE2 regular expression for one word.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of text that one numpy step handles at a time; a single longer text is handled alone.
STEP_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own where none is set and all run in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: While set, the shuffle files of a finished query are removed at once.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back; it goes when the driver ends, or with dropped().

    The table is what later steps read, so the shuffles that made it are let go once it is
    complete; until then a lost executor's part is made again from them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_SHUFFLES, "false")
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_SHUFFLES, before)

    def gone() -> None:
        try:
            remove(spark, path)
        except Exception:  # the session has ended before us: the folder's owner cleans it
            return

    atexit.register(gone)
    table = spark.read.schema(df.schema).parquet(path)
    _paths[id(table)] = (table, path)
    return table


#: Stored tables by the identity of what stored() returned, which is kept so that it stays theirs.
_paths: dict[int, tuple[DataFrame, str]] = {}


def dropped(table: DataFrame) -> None:
    """Removes what stored() wrote, once nothing will read it again."""
    _, path = _paths.pop(id(table))
    remove(table.sparkSession, path)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a string column as one byte array and n + 1 offsets into it; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def without(docs: DataFrame, *names: str) -> DataFrame:
    """docs less the columns of these names, in whatever case; other columns may have any names."""
    gone = {n.lower() for n in names}
    keep = [i for i, c in enumerate(docs.columns) if c.lower() not in gone]
    if len(keep) == len(docs.columns):
        return docs
    return numbered(docs).select(*[f"c{i}" for i in keep]).toDF(*[docs.columns[i] for i in keep])


def numbered(docs: DataFrame) -> DataFrame:
    """docs with its columns named c0, c1 and so on, so that no name clashes or needs quoting; toDF() gives names back."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])


def place_of(docs: DataFrame, name: str) -> int | None:
    """The place of the first column of that name, None where there is none."""
    return next((i for i, c in enumerate(docs.columns) if c == name), None)


def steps(batches: Iterator[pa.RecordBatch], text: str | int, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that each holds about `most` bytes of the text column, named or numbered."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = utf8(batch.column(batch.schema.get_field_index(text) if isinstance(text, str) else text))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the number of words of every document."""
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n, np.int64)
    inside = ~SPACES[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True
    before = np.empty(len(data), dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.empty(len(data), dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def scrambled(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit (the public splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_MIX = scrambled(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """_STEP to the powers 0 to n - 1, modulo 2**64."""
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 256), _STEP, dtype=np.uint64)
        grown[0] = 1
        _powers = np.cumprod(grown, dtype=np.uint64)
    return _powers[:n]


#: Bytes of words that are named at a time.
NAME_BYTES = 1 << 18


def word_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit name for each word that depends on its bytes alone."""
    out = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):  # so many bytes at a time: each takes several words of working memory
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + NAME_BYTES)))
        a, lengths = starts[at:to], ends[at:to] - starts[at:to]
        first = np.cumsum(lengths) - lengths
        place = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(first, lengths)
        values = _MIX[data[np.repeat(a, lengths) + place]] * powers(int(lengths.max()))[place]
        out[at:to] = np.add.reduceat(values, first) + lengths.astype(np.uint64)
        at = to
    return scrambled(out)


def window_names(names: np.ndarray, counts: np.ndarray, width: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit name for every run of `width` words within one document, and the index of its first word."""
    if len(names) < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.full(len(names) - width + 1, (salt * 0x9E3779B97F4A7C15 + 1) % 2**64, dtype=np.uint64)
    for j in range(width):
        total = total * _STEP + names[j : len(names) - width + 1 + j]
    ends = np.cumsum(counts)
    room = np.repeat(ends, counts) - np.arange(len(names))
    at = np.flatnonzero(room[: len(total)] >= width)
    return scrambled(total[at]), at
