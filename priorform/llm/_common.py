"""What the operators of this package share: row facts, word hashes, stages, Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: ASCII letters lower-cased; every ASCII byte that is neither letter nor digit becomes a blank.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
UPPER_AZ, LOWER_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; an own one only in a local session without that setting."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="priorform-llm-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def store(df: DataFrame) -> DataFrame:
    """Write an intermediate table as parquet into the shared folder and read it back.

    This cuts the lineage without depending on any executor staying alive.
    """
    path = f"{shared_folder(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


FEW = 100_000  # short rows up to which a table is gathered in one task, or broadcast, instead of being dealt out


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """A table of at most ``FEW`` rows as one partition, which needs no exchange for what follows; a larger one as it is."""
    return df.coalesce(1) if rows <= FEW else df


def sent(df: DataFrame, rows: int) -> DataFrame:
    """A table of at most ``FEW`` rows to be broadcast in joins; a larger one as it is."""
    return F.broadcast(df) if rows <= FEW else df


def drop_stored(*stages: DataFrame) -> None:
    """Delete the files of tables from :func:`store` that nothing reads any more."""
    for df in stages:
        spark = df.sparkSession
        top = shared_folder(spark).split(":")[-1].lstrip("/")
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if path.rsplit("/", 1)[-1].startswith("llm-") and top in path:
                path = spark._jvm.org.apache.hadoop.fs.Path(path)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of stored stages now instead of at some later collection of the driver's garbage."""
    spark.sparkContext._jvm.System.gc()


def crc_of_id(id_col: str = "doc_id") -> Column:
    """CRC-32 of the id as text; a missing id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))


def text_bytes(text_col: str = "text") -> Column:
    return F.col(text_col).cast("binary")


def map_arrow(
    df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list | np.ndarray | pa.Array] | None], schema: str, keep: Sequence[str] = (), rows: int | None = None
) -> DataFrame:
    """``mapInArrow`` with columns as Python lists in, columns out; ``keep`` columns stay Arrow arrays.

    ``rows`` bounds how many rows ``fn`` gets at once, and so the memory of what it makes of them.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, rows or whole.num_rows) for i in range(0, whole.num_rows, rows or whole.num_rows or 1)):
                out = fn({n: batch.column(i) if n in keep else batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)})
                if out is not None:
                    yield pa.RecordBatch.from_arrays(
                        [v.cast(f.type) if isinstance(v, pa.Array) else pa.array(v, f.type) for f, v in ((f, out[f.name]) for f in target)],
                        schema=target,
                    )

    return df.mapInArrow(run, schema)


class WordHashes(dict):
    """64-bit hash of a word, remembered; emptied when it grows beyond ``limit`` words."""

    def __init__(self, limit: int = 1_000_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.limit:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted values, each once; faster than ``np.unique`` on short arrays of hashes."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])[: len(x)]]


SHORT = 64  # bytes of a word up to which its hash is a sum over its bytes
AT_ONCE = 32  # texts hashed together
WORD_BYTE = ~np.isin(np.arange(256), list(b" \t\n\v\f\r"))
_BYTES = np.where(WORD_BYTE, mixed(np.frombuffer(LOWER, np.uint8) + np.uint64(0x9E3779B97F4A7C15)), np.uint64(0))  # A to Z count as a to z
_PLACES = mixed(np.arange(SHORT, dtype=np.uint64) + np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def _hashes_of(texts: list[bytes]) -> list[np.ndarray]:
    whole = b"\n".join([*texts, b""])
    data = np.frombuffer(whole, np.uint8)
    word = WORD_BYTE[data]
    edges = np.flatnonzero(np.diff(word, prepend=False))  # the last byte is a blank
    if not len(edges):
        return [np.zeros(0, np.uint64)] * len(texts)
    first, last = edges[::2], edges[1::2]
    size = last - first
    place = np.arange(len(data)) - np.repeat(np.concatenate([[0], first]), np.diff(first, prepend=0, append=len(data)))
    sums = np.cumsum(_PLACES[place % SHORT] * _BYTES[data])[last - 1]
    sums[1:] -= sums[:-1].copy()
    out = sums + size.astype(np.uint64)
    for i in np.flatnonzero(size > SHORT):
        out[i] = xxhash.xxh3_64_intdigest(whole[first[i] : last[i]].translate(LOWER))
    return np.split(mixed(out), np.searchsorted(first, np.cumsum([len(t) + 1 for t in texts])[:-1]))


def word_hashes(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    """For each text the 64-bit hashes of its words between ASCII white space, A to Z lower-cased, in their order.

    A word's hash is the sum of a random number per byte times one per place, for all words of some texts at once.
    """
    for at in range(0, len(texts), AT_ONCE):
        yield from _hashes_of([t or b"" for t in texts[at : at + AT_ONCE]])


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` consecutive word hashes (empty when there are fewer words)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for j in range(1, k):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += words[j : j + n]
    return mixed(out + np.uint64(k))



def text_key(text_col: str = "text") -> Column:
    """A 64-bit key of the text; with the id it tells rows apart that share an id."""
    return F.xxhash64(F.col(text_col))
