"""Shared pieces of the text operators: Arrow batch plumbing, vectorised tokenising, folds, shared folders.

Texts stay UTF-8 bytes from Parquet to numpy; words are never materialised unless an operator needs their text.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles; a longer single text is a step of its own.
CHUNK_BYTES = 1 << 20
#: Bytes of words that are hashed at once, few enough for a core's cache.
WORD_BYTES = 1 << 15
#: Files of a labelled sample at most. Each file that Spark writes starts some processes on a local file system.
SAMPLE_FILES = 24
#: Rows that make a file of a checkpoint whose rows are counted; a frame of fewer rows is one file, whatever its partitions.
FILE_ROWS = 1 << 15

_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(doc_id: Column, modulus: int, remainder: int) -> Column:
    """True where crc32(doc_id as text) mod modulus is remainder; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus == remainder


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a session of one machine may do without: it gets a folder of its own."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if base is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _OWN.get(sc.applicationId)
        if base is None:
            import tempfile

            base = _OWN[sc.applicationId] = tempfile.mkdtemp(prefix="checkpoints")
    return base.rstrip("/")


_OWN: dict[str, str] = {}


def checkpoint(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder all executors share.

    `rows`: how many rows the last step goes through at most, if known. A file each FILE_ROWS of them is enough then:
    on a local file system Spark starts some processes for every file that it writes, empty ones too.
    """
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared folder, for a table that is written once and read again; it goes when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder: computed once, safe against lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_counted(left: DataFrame, right: DataFrame, key: str, n: str = "n", parts: int = 1000) -> DataFrame:
    """left joined with right, which has one row a key and the number `n` of left's rows with it; n is dropped.

    Keys with over 1 / `parts` of the rows, so `parts` of them at most, are broadcast; their rows stay where they are.
    """
    total = right.agg(F.sum(n)).first()[0] or 0
    hot, rest = (F.broadcast(right.where(F.col(n) * parts > total).drop(n)), right.where(F.col(n) * parts <= total).drop(n))
    return left.join(hot, key).unionByName(left.join(hot.select(key), key, "left_anti").join(rest, key))


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete shuffle files of frames that nothing refers to any more."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


# ---------------------------------------------------------------- Arrow batches


class Texts:
    """Some rows' texts as one byte array; nulls are empty."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def __getitem__(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def text_bytes(column: pa.Array) -> list[bytes]:
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def chunks(batch: pa.RecordBatch, text: int, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `limit` bytes of text each (a longer text stands alone)."""
    if batch.num_rows == 0:
        return
    column = batch.column(text)
    off = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    start = 0
    while start < len(column):
        end = max(start + 1, int(np.searchsorted(off, off[start] + limit, side="right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def texts_of(column: pa.Array) -> Texts:
    """The column's bytes without copies, but where nulls have bytes below them."""
    off = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8)[off[0] : off[-1]] if body is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return Texts(data, off - off[0])


def text_map(df: DataFrame, columns: list[str], make: Callable, schema: str, limit: int = CHUNK_BYTES) -> DataFrame:
    """mapInArrow with `make()` once a task; what it returns maps a slice of the batch to a list of Arrow arrays.

    `columns` are selected by name, the text last, so extra columns of the input never meet the operator's own.
    """
    names = [x.split()[0].strip("`") for x in _split_schema(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for part in chunks(batch, len(columns) - 1, limit):
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in step(part)], names)

    picked = df.select(*columns[:-1], F.col(columns[-1]).cast("string").alias(columns[-1]))
    return picked.mapInArrow(run, schema)


def filter_rows(df: DataFrame, text: str, make: Callable) -> DataFrame:
    """The rows for which `make()`'s function of a slice of the text column says True, all columns unchanged."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = make()
        for batch in batches:
            for part in chunks(batch, at):
                yield part.filter(pa.array(keep(part.column(at)), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def with_columns(df: DataFrame, text: str | None, make: Callable, schema: str, limit: int = CHUNK_BYTES) -> DataFrame:
    """All columns of df, then those of `schema`, which `make()`'s function gives for each slice of a batch.

    df must not have columns of these names: see without().

    Slices hold about `limit` bytes of the text column, or `limit` rows if there is none.
    """
    new = [x.split()[0].strip("`") for x in _split_schema(schema)]
    at = None if text is None else df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            parts = chunks(batch, at, limit) if at is not None else (batch.slice(k, limit) for k in range(0, batch.num_rows, limit))
            for part in parts:
                yield pa.RecordBatch.from_arrays([*part.columns, *step(part)], [*part.schema.names, *new])

    return df.mapInArrow(run, f"{_ddl(df)}, {schema}")


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns of these names, whatever their case: an operator's own columns replace them."""
    own = {n.lower() for n in names}
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in own))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def _split_schema(schema: str) -> list[str]:
    out, depth, last = [], 0, ""
    for ch in schema:
        depth += (ch in "<(") - (ch in ">)")
        if ch == "," and not depth:
            out.append(last.strip())
            last = ""
        else:
            last += ch
    return [*out, last.strip()]


def type_of(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


# ---------------------------------------------------------------- words


def word_table(keep: str = "any") -> np.ndarray:
    """Byte -> lower-cased byte inside words, 0 between them.

    any: words are runs of other than ASCII white space. alnum: runs of a-z, 0-9 and non-ASCII bytes.
    alpha: runs of a-z and non-ASCII bytes.
    """
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    if keep == "any":
        t[[0x20, 9, 10, 11, 12, 13]] = 0
        t[0] = 65  # the byte 0 itself belongs to a word; no other byte is mapped to an upper-case letter
    else:
        b = np.arange(256)
        word = (b >= 128) | ((b >= 65) & (b <= 90)) | ((b >= 97) & (b <= 122)) | ((b >= 48) & (b <= 57) if keep == "alnum" else False)
        t[~word] = 0
    return t


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 on uint64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_R), -1, 1 << 64))
    with np.errstate(over="ignore"):
        up = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, _R)]))
        down = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, inverse)]))
    return up, down


_UP, _DOWN = None, None


def words(t: Texts, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all words in order: their first bytes' places, 64-bit hashes, and per text the index of its first word (n+1 values).

    A word's hash is the polynomial of its bytes (as `table` maps them) mod 2^64, mixed; it doesn't depend on the place.
    """
    global _UP, _DOWN
    v = table[t.data]
    inside = v != 0
    first = inside.copy()
    if len(first):
        first[1:] &= ~inside[:-1]
        heads = t.offsets[:-1][t.offsets[:-1] < t.offsets[1:]]
        first[heads] = inside[heads]
    starts = np.flatnonzero(first)
    per_text = np.searchsorted(starts, t.offsets)
    hashes = np.zeros(len(starts), np.uint64)
    a = 0
    with np.errstate(over="ignore"):
        while a < len(starts):
            lo = starts[a]
            b = max(a + 1, int(np.searchsorted(starts, lo + WORD_BYTES)))
            hi = starts[b] if b < len(starts) else len(v)
            if _UP is None or len(_UP) < hi - lo:
                _UP, _DOWN = _powers(max(2 * WORD_BYTES, int(hi - lo)))
            rel = starts[a:b] - lo
            hashes[a:b] = np.add.reduceat(v[lo:hi].astype(np.uint64) * _UP[: hi - lo], rel) * _DOWN[rel]
            a = b
        return starts, mix(hashes + np.uint64(1)), per_text


def word_sizes(t: Texts, table: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Bytes of each word that words() found, up to its text's end."""
    inside = table[t.data] != 0
    last = inside.copy()
    if len(last):
        last[:-1] &= ~inside[1:]
        tails = t.offsets[1:][t.offsets[:-1] < t.offsets[1:]] - 1
        last[tails] = inside[tails]
    return np.flatnonzero(last) + 1 - starts


def hash_words(texts: list[str], table: np.ndarray) -> np.ndarray:
    """The hashes of single words, as words() has them."""
    raw = [x.encode() for x in texts]
    off = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    _, h, per = words(Texts(np.frombuffer(b"".join(raw), np.uint8), off), table)
    assert (np.diff(per) == 1).all(), "each must be one word"
    return h


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i+1]], empty ranges included."""
    c = np.concatenate([np.zeros((1, *values.shape[1:]), np.float64), np.cumsum(values, axis=0, dtype=np.float64)])
    return c[bounds[1:]] - c[bounds[:-1]]


# ---------------------------------------------------------------- labelled samples


def labelled_sample(df: DataFrame, labels: DataFrame, learn: Column, key: str, text: str, label: str, rows: int, salt: int) -> DataFrame:
    """k, y, t: at most `rows` labelled rows with their whole texts, chosen by a hash of the key, written to the shared folder.

    A key is one row: the largest of its labels and, of several rows of df, the text of the least hash. The choice is
    the same on every run and partitioning. Null keys and labels are left out; null texts are empty.
    """
    named = labels.where(learn & F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max(label).cast("int").alias("y"))
    kept = named.orderBy(F.xxhash64(F.col("k").cast("string"), F.lit(salt)), "k").limit(rows)
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    texts = df.select(F.col(key).alias("k"), t.alias("t")).join(F.broadcast(kept), "k")  # `rows` keys at most
    one = texts.groupBy("k", "y").agg(F.min_by("t", F.xxhash64("t")).alias("t"))  # a key's copies meet map-side
    return written(one.select(F.col("k").cast("string").alias("k"), "y", "t").coalesce(SAMPLE_FILES), "sample")
