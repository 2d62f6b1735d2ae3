"""What the operators of this subpackage share: reading, Arrow batches, checkpoints, text pieces."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words; everything else belongs to a word.
WORD_SPLIT = r"[\x20\x09-\x0D]+"

#: White space as the tokenizers' patterns see it: the Unicode property, without U+001C to U+001F.
_SPACE = "\t-\r \x85\xa0  -     　"
_CUT = re.compile(f"(?<=[^{_SPACE}])[{_SPACE}]")
_SPACES = re.compile(f"[{_SPACE}]+")
_ODD = re.compile("[\x1c-\x1f]")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, by whatever file system Spark reads it from."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_map(
    df: DataFrame,
    columns: dict[str, str | Column],
    schema: str,
    make: Callable[[], Callable[[pa.RecordBatch], Iterable[dict[str, object]]]],
) -> DataFrame:
    """Run a Python function over Arrow batches of some columns.

    ``columns`` maps the names the function sees to columns of ``df``, so clashing names of other
    columns never reach it. ``make`` is called once in each task and returns a function from a
    record batch to dicts of equally long column lists in the order of ``schema``.
    """
    picked = df.select([(F.col(f"`{c}`") if isinstance(c, str) else c).alias(n) for n, c in columns.items()])
    arrow_schema = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in batches:
            work = work or make()
            for out in work(batch):
                arrays = [x if isinstance(x := out[f.name], pa.Array) else pa.array(x, type=f.type) for f in arrow_schema]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow_schema)
            # nothing of a batch stays while the next is read, and its memory goes back
            del batch
            out = arrays = None
            pa.default_memory_pool().release_unused()

    return picked.mapInArrow(run, schema)


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def whole_texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The column's strings, null read as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def text_groups(batch: pa.RecordBatch, name: str = "text", rows: int = 256) -> Iterator[tuple[int, list[str]]]:
    """First row and whole texts (null: empty) of a few rows of a batch at a time, so that only those become strings."""
    column = batch.column(name)
    for start in range(0, batch.num_rows, rows):
        yield start, [t or "" for t in column.slice(start, rows).to_pylist()]


def measured(text: Column, names: list[str], kind: str, measure: Callable[[str], tuple], rows: int = 256) -> Column:
    """Struct of ``measure``'s values for each text of a column (null: empty), a few texts as strings at a time."""
    item = {"bigint": pa.int64(), "double": pa.float64()}[kind]

    @F.arrow_udf(", ".join(f"{n} {kind}" for n in names))
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            found = [measure(t or "") for start in range(0, len(texts), rows) for t in texts.slice(start, rows).to_pylist()]
            columns = list(zip(*found)) if found else [()] * len(names)
            yield pa.StructArray.from_arrays([pa.array(c, item) for c in columns], names)
            # nothing of a batch stays while the next is read, and its memory goes back
            del texts, found, columns
            pa.default_memory_pool().release_unused()

    return run(text)


class Remembered(dict):
    """Values of a function by its argument, ``size`` at most: when half of that is new, what hasn't been asked for since the last time goes."""

    def __init__(self, make: Callable[[str], bytes], size: int):
        super().__init__()
        self.make, self.half, self.old = make, max(1, size // 2), {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def cut_points(text: str, size: int) -> Iterator[str]:
    """Cut a text into runs of about ``size`` characters between a non-space and a space.

    The tokenizers used here never match across such a place and look no further than it, so the
    runs can be tokenized one by one. A run without a space stays whole.
    """
    start = 0
    while len(text) - start > size:
        found = _CUT.search(text, start + size)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def space_words(text: str) -> list[str]:
    """Words between Unicode white space (U+001C to U+001F are not white space)."""
    return [w for w in _SPACES.split(text) if w] if _ODD.search(text) else text.split()


_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_WORD = re.compile("[^\x20\x09-\x0d]+")


def ascii_words(text: str) -> list[str]:
    """Words between ASCII spaces: matches of ``[^\\x20\\x09-\\x0D]+``."""
    return _WORD.findall(text) if _ODD_SPACE.search(text) else text.split()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that all executors share.

    The folder is the session's ``spark.checkpoint.dir``; one of our own is set only where the
    session names none, as in tests.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Write rows as Parquet under the shared folder and read them back: lineage is cut, and later steps read the columns they need."""
    path = shared_folder(df.sparkSession, "stored")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path under the shared one; the file system removes it when the driver's process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors share: spark.checkpoint.dir, or the warehouse if unset."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"


def id_split(id_col: str, parts: int) -> Column:
    """crc32 of the id's decimal text, modulo ``parts``: the split into learning and held-out rows (null id: null)."""
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % parts


def free_name(name: str, columns: list[str]) -> str:
    """``name``, with underscores before it where a table has a column of that name (in either case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name
