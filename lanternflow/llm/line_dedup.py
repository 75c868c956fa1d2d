"""Line dedup by sharded minimal perfect hashes.

Lines are known by a 128-bit hash.  One aggregation (combined per batch first)
finds the hashes seen in two documents or more; they are dealt to shards.  A
shard builds a minimal perfect hash over its hashes whose slot numbers index
three arrays: a fingerprint, the count, and the document that keeps the line.
Documents send bare hashes to the shards and get back which to drop, so no
line text is ever joined.

Lines so common that one shard would be flooded (at least one in ``HOT`` of
all repeated lines, thus ``HOT`` lines at most) have their arrays broadcast;
documents probe those on the spot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lanternflow.llm import core
from lanternflow.llm.core import U64, column, mix, numbers

#: Most lines whose arrays are broadcast: about 200 KB.
HOT = 8_192
MIN_CHARS = 10
#: Lines that documents ask one shard about, on average at most.
SHARD = 250_000


class MinimalHash:
    """A minimal perfect hash: n distinct 64-bit keys to 0..n-1.

    Each level is a bit array; a key takes its bit if no other key of the level
    hashes there, else it moves to the next level.  The slot is the rank of the
    bit.  Keys left after ``LEVELS`` (practically none) are kept sorted.
    """

    LEVELS, ROOM = 24, 2.0

    def __init__(self, keys: np.ndarray) -> None:
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        self.size = len(keys)
        base, rest = 0, keys.astype(np.uint64)
        for level in range(self.LEVELS):
            if not len(rest):
                break
            m = int(len(rest) * self.ROOM) + 64
            at = self._place(rest, level, m)
            hits = np.bincount(at, minlength=m)
            bits = np.packbits(np.pad(hits == 1, (0, -m % 64)), bitorder="little").view(np.uint64)
            ranks = np.zeros(len(bits), np.int64)
            np.cumsum(np.bitwise_count(bits[:-1]), out=ranks[1:])
            self.levels.append((m, bits, ranks + base))
            base += int((hits == 1).sum())
            rest = rest[hits[at] != 1]
        self.rest, self.base = np.sort(rest), base

    @staticmethod
    def _place(keys: np.ndarray, level: int, m: int) -> np.ndarray:
        return (mix(keys + U64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)) % U64(m)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; for others any slot or -1, which fingerprints tell apart."""
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        keys = keys.astype(np.uint64)
        for level, (m, bits, ranks) in enumerate(self.levels):
            if not len(todo):
                return out
            at = self._place(keys[todo], level, m)
            word, bit = bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & U64(1) == 1
            below = np.bitwise_count(word & ((U64(1) << bit) - U64(1)))
            out[todo[hit]] = ranks[at[hit] >> 6] + below[hit]
            todo = todo[~hit]
        if len(self.rest) and len(todo):
            i = np.searchsorted(self.rest, keys[todo])
            ok = (i < len(self.rest)) & (self.rest[np.minimum(i, len(self.rest) - 1)] == keys[todo])
            out[todo[ok]] = self.base + i[ok]
        return out


class LineIndex:
    """Minimal perfect hash with arrays: fingerprint, count, keeping document."""

    def __init__(self, h: np.ndarray, mark: np.ndarray, count: np.ndarray, keeper: np.ndarray) -> None:
        self.hash = MinimalHash(h)
        at = self.hash.slots(h)
        self.mark, self.count, self.keeper = np.empty_like(mark), np.empty_like(count), np.empty_like(keeper)
        self.mark[at], self.count[at], self.keeper[at] = mark, count, keeper

    def probe(self, h: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """Slot of each line that the index holds, else -1."""
        if not self.hash.size or not len(h):
            return np.full(len(h), -1, np.int64)
        at = self.hash.slots(h)
        return np.where((at >= 0) & (self.mark[np.maximum(at, 0)] == mark), at, -1)


def line_keys(text: bytes, min_chars: int) -> tuple[list[bytes], list[bytes | None]]:
    """The lines of a text and their 16-byte hashes; None for lines too short to matter."""
    lines = text.split(b"\n")
    digest = xxhash.xxh3_128_digest
    keys: list[bytes | None] = []
    for line in lines:
        k = line.strip().lower()
        short = len(k) < min_chars or (len(k) < 4 * min_chars and not k.isascii() and len(k.decode(errors="replace")) < min_chars)
        keys.append(None if short else digest(k))
    return lines, keys


def _split(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
    return np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1])


def _local_counts(min_chars: int):
    def fn(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list[int]] = {}
        for i, t in zip(numbers(b, "doc_id").tolist(), column(b, "text").cast(pa.binary()).to_pylist(), strict=True):
            for k in {k for k in line_keys(t, min_chars)[1] if k is not None}:
                if (x := seen.get(k)) is None:
                    seen[k] = [i, i, 1]
                else:
                    x[0], x[1], x[2] = min(x[0], i), max(x[1], i), x[2] + 1
        if seen:
            h, mark = _split(list(seen))
            lo, hi, n = np.array(list(seen.values()), np.int64).T
            yield core.batch_of(h=h, mark=mark, lo=lo.copy(), hi=hi.copy(), n=n.copy())

    return fn


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, seen: Observation | None = None) -> DataFrame:
    """(h, mark, lo, n): hashes of lines found in two documents or more, the smallest id, the documents.

    ``seen`` gets the number of all lines of documents, repeats inside one not counted.
    """
    found = core.arrow_map(core.id_text(docs), _local_counts(min_chars), "h long, mark long, lo long, hi long, n long")
    found = found.groupBy("h", "mark").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))
    if seen is not None:
        found = found.observe(seen, F.sum("n").alias("asks"))
    return found.where("lo < hi").drop("hi")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, hot_lines: int = HOT) -> DataFrame:
    """Drop lines that an earlier document has.

    A line's key is the line stripped of ASCII white space, A-Z lower-cased.
    Keys of at least ``min_chars`` code points found in two documents or more
    lose all their lines except in the smallest doc_id that holds one (there
    all stay).  Returns doc_id, n_lines, n_dropped, the new text
    and the other columns of ``docs`` in the struct ``rest``.

    Null or empty text: one empty line, kept.  A null doc_id counts as one
    document after all others.  Repeated rows of one id are one document and
    each is answered.  Very long texts are taken whole.  An empty table gives
    an empty table.
    """
    spark = docs.sparkSession
    seen = Observation()
    known = core.stored(repeated_lines(docs, min_chars, seen), "lines")
    total = known.agg(F.sum("n")).first()[0] or 0
    floor = max(2, -(-total // hot_lines))
    hot = spark.sparkContext.broadcast(_index([r.asDict() for r in known.where(F.col("n") >= floor).collect()]))
    shards = max(core.parts(spark), -(-(seen.get["asks"] or 0) // SHARD))
    shard = F.pmod(F.xxhash64("h"), F.lit(shards)).cast("int")
    base = core.with_rest(docs)
    asks = core.arrow_map(core.id_text(docs), _asks(hot, min_chars), "h long, mark long, doc_id long").withColumn("shard", shard)
    cold = known.where(F.col("n") < floor).withColumn("shard", shard)
    answers = cold.groupBy("shard").cogroup(asks.groupBy("shard")).applyInArrow(_answer, "doc_id long, h long")
    drops = answers.groupBy("doc_id").agg(F.collect_list("h").alias("drop"))
    joined = base.join(drops.hint("shuffle_hash"), "doc_id", "left")
    out = core.schema_of("doc_id long, n_lines long, n_dropped long, text string", rest=base.schema["rest"].dataType)
    return joined.select("doc_id", "text", "drop", "rest").mapInArrow(_rewriter(hot, min_chars), out)


def _index(rows: list[dict]) -> LineIndex:
    get = lambda k: np.array([r[k] for r in rows], np.int64)
    return LineIndex(get("h"), get("mark"), get("n"), get("lo"))


def _asks(hot, min_chars: int):
    def fn(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys: list[bytes] = []
        ids: list[int] = []
        for i, t in zip(numbers(b, "doc_id").tolist(), column(b, "text").cast(pa.binary()).to_pylist(), strict=True):
            own = {k for k in line_keys(t, min_chars)[1] if k is not None}
            keys += own
            ids += [i] * len(own)
        h, mark = _split(keys)
        cold = hot.value.probe(h, mark) < 0
        yield core.batch_of(h=h[cold], mark=mark[cold], doc_id=np.array(ids, np.int64)[cold])

    return fn


def _answer(known: pa.Table, asks: pa.Table) -> pa.Table:
    get = lambda t, k: t.column(k).to_numpy()
    index = LineIndex(get(known, "h"), get(known, "mark"), get(known, "n"), get(known, "lo"))
    h, ids = get(asks, "h"), get(asks, "doc_id")
    at = index.probe(h, get(asks, "mark"))
    hit = at >= 0
    hit[hit] = index.keeper[at[hit]] != ids[hit]
    return pa.table({"doc_id": ids[hit], "h": h[hit]})


def _rewriter(hot, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, n_lines, n_dropped = [], [], []
            for i, t, drop in zip(numbers(b, "doc_id").tolist(), column(b, "text").cast(pa.binary()).to_pylist(), column(b, "drop").to_pylist(), strict=True):
                lines, keys = line_keys(t, min_chars)
                own = [k for k in dict.fromkeys(keys) if k is not None]
                gone = set()
                if own:
                    h, mark = _split(own)
                    at = hot.value.probe(h, mark)
                    bad = at >= 0
                    bad[bad] = hot.value.keeper[at[bad]] != i
                    if drop:
                        bad |= np.isin(h, np.array(drop, np.int64))
                    gone = {k for k, x in zip(own, bad.tolist(), strict=True) if x}
                kept = [x for x, k in zip(lines, keys, strict=True) if k not in gone] if gone else lines
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
                texts.append(b"\n".join(kept) if gone else t)
            yield pa.RecordBatch.from_arrays(
                [column(b, "doc_id"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string()), column(b, "rest")],
                names=["doc_id", "n_lines", "n_dropped", "text", "rest"],
            )

    return run


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(core.documents(spark, sf_dir).select("doc_id", "text"))
    return core.give_back_ids(out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")))


_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
OP2_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents
), keyed AS (
  SELECT *, translate(trim(line, {_BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), rep AS (
  SELECT k, min(doc_id) AS keeper FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT keyed.*, keeper IS NOT NULL AND keeper <> doc_id AS gone FROM keyed LEFT JOIN rep USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
QUERIES = {"op2_line_dedup": op2_line_dedup}
SQL = {"op2_line_dedup": OP2_SQL}
