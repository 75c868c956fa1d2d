"""Shared pieces: document frames, shared-folder tables, vectorised word hashing.

Conventions of every operator in this subpackage:

* A null ``doc_id`` is treated as one id larger than all others and is given
  back as null.  A null ``text`` is the empty text.
* Rows may repeat: each row is answered, rows of one id count as one document.
"""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULL_ID = 2**63 - 1
#: Bytes of text that one vectorised step takes at once; a longer text is a step of its own.
STEP_BYTES = 2 << 20
U64 = np.uint64


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _plain(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns renamed by place, but doc_id and text: no name is another's but for case."""
    return docs.toDF(*[c if c in ("doc_id", "text") else f"_{i}" for i, c in enumerate(docs.columns)])


def _filled() -> dict[str, Column]:
    return {"doc_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)), "text": F.coalesce(F.col("text"), F.lit(""))}


def id_text(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, without nulls."""
    return _plain(docs).select(*[v.alias(k) for k, v in _filled().items()])


def with_rest(docs: DataFrame) -> DataFrame:
    """doc_id and text without nulls, and the other columns by place (and the doc_id as it was) in the struct ``rest``, for ``like``."""
    plain = _plain(docs)
    rest = F.struct(*[F.col(n).alias(f"_{i}") for i, n in enumerate(plain.columns) if n != "text"])
    return plain.select("doc_id", "text", rest.alias("rest")).withColumns(_filled())


def like(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` from a frame with ``text`` and ``rest``; ``n_chars`` follows the text."""
    out = []
    for i, f in enumerate(docs.schema.fields):
        kept = F.col("text") if f.name == "text" else F.char_length("text").cast(f.dataType) if f.name == "n_chars" else F.col(f"rest._{i}")
        out.append(kept.alias(f.name))
    return df.select(*out)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Batches sorted by ``key``, cut so that no group is split."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = numbers(b, key)
        other = np.flatnonzero(k != k[0])
        first = int(other[0]) if len(other) else len(k)
        if held and numbers(held[0], key)[0] == k[0]:
            held.append(b.slice(0, first))
            b = b.slice(first)
        if not b.num_rows:
            continue
        if held:
            yield _joined(held)
        k = numbers(b, key)
        other = np.flatnonzero(k != k[-1])
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield b.slice(0, cut)
        held = [b.slice(cut)]
    if held:
        yield _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches(max_chunksize=None)[0]


def schema_of(ddl: str, **columns) -> T.StructType:
    """A schema from DDL and, after it, columns with their types."""
    s = T._parse_datatype_string(ddl)
    for name, kind in columns.items():
        s = s.add(name, kind)
    return s


def real_id(name: str = "doc_id") -> Column:
    return F.when(F.col(name) == F.lit(NULL_ID), F.lit(None)).otherwise(F.col(name)).cast("long")


def give_back_ids(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: real_id(n) for n in (names or ("doc_id",))})


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set and all run in one process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lanternflow-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder's path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/lanternflow-{label}-{uuid.uuid4().hex}"
    where, files = _where(spark, path)
    files.mkdirs(where)
    files.deleteOnExit(where)
    return path


def stored(df: DataFrame, label: str, per_file: int = 0) -> DataFrame:
    """Write a table to the shared folder and read it again.

    This cuts the lineage so that a lost executor costs one read, and lets
    several later steps use the rows without computing them anew.  Spark
    deletes the folder when the driver ends; ``free`` does so before.
    ``per_file`` bounds the rows of a file, for very wide rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lanternflow-{label}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").option("maxRecordsPerFile", per_file).parquet(path)
    where, files = _where(spark, path)
    files.deleteOnExit(where)
    out = spark.read.schema(schema).parquet(path)
    _paths[id(out)] = path
    weakref.finalize(out, _paths.pop, id(out), None)
    return out


_paths: dict[int, str] = {}


def _where(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def free(*tables: DataFrame) -> None:
    """Delete stored tables; nothing that is still to run may read them."""
    for t in tables:
        if path := _paths.pop(id(t), None):
            where, files = _where(t.sparkSession, path)
            files.delete(where, True)


def small_batches(spark: SparkSession, rows: int = 2_000) -> None:
    """Hand Python at most so many rows at once, unless the session sets its own number.

    At Spark's default of 10,000 a batch of texts takes some 30 MB, several
    times over in the executor and its workers.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow for a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield from fn(b)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def batch_of(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)


def binary_column(data: bytes | np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A binary column from one buffer and the bytes of each row."""
    off = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=off[1:])
    return pa.BinaryArray.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(off), pa.py_buffer(data)])


def bit_filter(slots: DataFrame, bits: int) -> bytes:
    """A bit for each slot (a column ``at`` below ``bits``), packed little-endian.

    Slots are combined to 64-bit words before they are shuffled, so at most
    bits / 64 rows are collected, whatever the input.
    """
    words = slots.groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(at & 63 AS INT)))").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[words.column("word").to_numpy().astype(np.int64)] = words.column("bits").to_numpy().view(np.uint64)
    return out.tobytes()


#: Bits of a filter over ids that is broadcast (4 MB); false hits are removed by a join.
ID_BITS = 1 << 25


def id_slot(name: str) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(ID_BITS))


def id_filter(spark: SparkSession, ids: DataFrame | None):
    """A broadcast bit filter over the column ``id``, of fixed size; None: no id."""
    return spark.sparkContext.broadcast(bytes(ID_BITS // 8) if ids is None else bit_filter(ids.select(id_slot("id").alias("at")), ID_BITS))


def in_id_filter(bits: bytes, at: np.ndarray) -> np.ndarray:
    has = np.frombuffer(bits, np.uint8)
    return ((has[at >> 3] >> (at & 7)) & 1).astype(bool)


def with_slot(texts: DataFrame) -> DataFrame:
    """(doc_id, text) with each id's place in a filter, for ``in_id_filter``."""
    return texts.select("doc_id", "text", id_slot("doc_id").alias("at"))


def pick(texts: DataFrame, bits) -> DataFrame:
    """The rows (doc_id, text) whose id a filter may hold."""

    def fn(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield b.filter(pa.array(in_id_filter(bits.value, numbers(b, "at")))).select(["doc_id", "text"])

    return arrow_map(with_slot(texts), fn, "doc_id long, text string")


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return column(batch, name).to_numpy(zero_copy_only=False)


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column as one array, and the row offsets into it."""
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if off is not None else np.zeros(len(col) + 1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def steps(off: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Cut rows into runs of at most so many bytes; a longer row is alone."""
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + most, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
_BASE, _BASE_INV = U64(0x9E3779B97F4A7C15), U64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    key = "inv" if inverse else "pow"
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(n, STEP_BYTES + 64)
        a = np.full(size, _BASE_INV if inverse else _BASE, np.uint64)
        a[0] = 1
        made = np.multiply.accumulate(a)
        if size > 4 * STEP_BYTES:
            return made
        have = _powers[key] = made
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise a 64-bit hash (splitmix64)."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of some texts, as arrays.

    hash: 64 bits of each word; start, end: its bytes; doc: its text;
    first: where each text's words begin (one more at the end).
    """

    def __init__(self, data: np.ndarray, off: np.ndarray, lower: bool = True) -> None:
        base = off[0]
        data, off = data[base : off[-1]], off - base
        n = len(data)
        self.data = data = _LOWER[data] if lower else data
        solid = ~_IS_SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        before = np.zeros(n, bool)
        before[1:] = solid[:-1]
        self.start = np.flatnonzero(solid & (~before | edge[:n]))
        after = np.zeros(n, bool)
        after[:-1] = solid[1:]
        self.end = np.flatnonzero(solid & (~after | edge[1:])) + 1
        if n:
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTE[data] * powers(n)[:n], out=sums[1:])
            h = (sums[self.end] - sums[self.start]) * powers(n, True)[self.start]
            self.hash = mix(h + (self.end - self.start).astype(np.uint64))
        else:
            self.hash = np.zeros(0, np.uint64)
        self.first = np.searchsorted(self.start, off).astype(np.int64)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(off) - 1), self.count)


def shingles(words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, first word) of each run of ``size`` words; a shorter text has its whole sequence as one."""
    w, cnt, first = words.hash, words.count, words.first
    n = len(w)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    pad = np.concatenate([w, np.zeros(size - 1, np.uint64)])
    h = np.zeros(n, np.uint64)
    left = (first[1:] - 1)[words.doc] - np.arange(n)
    for k in range(size):
        part = pad[k : k + n] if k == 0 else np.where(left >= k, pad[k : k + n], U64(0))
        h = h * U64(0xD6E8FEB86659FD93) + part
    h = mix(h)
    keep = (left >= size - 1) | ((cnt[words.doc] < size) & (np.arange(n) == first[:-1][words.doc]))
    at = np.flatnonzero(keep)
    return h[at], words.doc[at], at - first[:-1][words.doc[at]]


def unique_per_doc(h: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each text, ascending within it, and where each text's run begins (texts must be in order)."""
    h = h.copy()
    cut = np.searchsorted(doc, np.arange(n_docs + 1))
    for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if e - s > 1:
            h[s:e].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[keep], doc[keep]
    return h, np.searchsorted(doc, np.arange(n_docs + 1))


def per_text(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of a byte mask over each text."""
    sums = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=sums[1:])
    return sums[off[1:]] - sums[off[:-1]]
