"""Token ids as files of patched frame-of-reference blocks, written and read by Spark.

A file holds the ids of neighbouring documents, without gaps, in blocks of
``BLOCK`` ids.  A block keeps its least id; what each id has over it is packed
at the width that ``PERCENTILE`` of the block's ids need, and the ids that need
more (the exceptions) keep their upper bits in a list of (place, upper bits).

    file     magic, blocks, footer, trailer (all numbers little-endian)
    block    least id u32, width u8, exceptions u16; packed ids, lowest bit
             first; places of the exceptions u16 each, upper bits u32 each
    footer   byte at which each block starts and where the last ends, u64;
             doc_id i64 of each document; number of its ids i64
    trailer  blocks, documents, ids, byte of the footer, u64 each; magic

The last block is filled up with its last id.  The index in the footer lets a
reader start at any document; ``_files.json`` beside the files says which of
them count, in order, and how many ids come before each.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from lanternflow.llm import core
from lanternflow.llm.core import column, numbers
from lanternflow.llm.alignment import Grow, byte_table, flat, ranks_of, spread
from lanternflow.llm.packing import ByteTokens, tokenizer_path

MAGIC = b"LFTOKEN1"
BLOCK, PERCENTILE = 1024, 98
END = 2
#: Blocks that are packed or unpacked in one step.
STEP = 256
#: Units that a worker remembers, about, and that are tokenised as one text.
UNITS, RUN = 300_000, 2_000
#: Ids of a reading task, about.
TASK = 8 << 20
INDEX = "_files.json"
HEAD, TRAILER = 7, struct.Struct("<QQQQ8s")
SCHEMA = "doc_id long, start long, n_tokens long, ids binary"


def _widths(x: np.ndarray) -> np.ndarray:
    """Bits that each number needs."""
    return np.ceil(np.log2(x.astype(np.float64) + 1)).astype(np.int64)


def pack_blocks(ids: np.ndarray, percentile: float = PERCENTILE) -> list[bytes]:
    """The bytes of each block; ``ids`` has a row for each block."""
    n, size = ids.shape
    least = ids.min(1)
    over = ids - least[:, None]
    at = min(size - 1, int(size * percentile / 100))
    width = _widths(np.partition(over, at, axis=1)[:, at])
    high = over.astype(np.uint64) >> width.astype(np.uint64)[:, None]
    packed: list[bytes] = [b""] * n
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        bits = np.unpackbits(np.ascontiguousarray(over[rows], "<u4").view(np.uint8), bitorder="little").reshape(len(rows), size, 32)[:, :, :w]
        for r, b in zip(rows.tolist(), np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little"), strict=True):
            packed[r] = b.tobytes()
    row, place = np.nonzero(high)
    cut = np.searchsorted(row, np.arange(n + 1))
    upper = high[row, place].astype("<u4")
    place = place.astype("<u2")
    return [
        struct.pack("<IBH", least[r], width[r], e - s) + packed[r] + place[s:e].tobytes() + upper[s:e].tobytes()
        for r, (s, e) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
    ]


def unpack_blocks(data: np.ndarray, starts: np.ndarray, size: int = BLOCK) -> np.ndarray:
    """The ids of blocks that begin at ``starts`` in ``data``; a row for each."""
    n = len(starts)
    head = data[starts[:, None] + np.arange(HEAD)]
    least = head[:, :4].copy().view("<u4")[:, 0]
    width, extra = head[:, 4].astype(np.int64), head[:, 5:7].copy().view("<u2")[:, 0].astype(np.int64)
    out = np.empty((n, size), np.uint32)
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        bits = np.zeros((len(rows), size, 32), np.uint8)
        if w:
            held = data[starts[rows, None] + HEAD + np.arange(size * w // 8)]
            bits[:, :, :w] = np.unpackbits(held, axis=1, bitorder="little").reshape(len(rows), size, w)
        out[rows] = np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little").view("<u4")
    for r in np.flatnonzero(extra).tolist():
        s, k, w = int(starts[r]) + HEAD + size * int(width[r]) // 8, int(extra[r]), int(width[r])
        place = data[s : s + 2 * k].copy().view("<u2")
        upper = data[s + 2 * k : s + 6 * k].copy().view("<u4")
        out[r, place] |= (upper.astype(np.uint64) << np.uint64(w)).astype(np.uint32)
    return out + least[:, None]


@dataclass
class Written(WriterCommitMessage):
    part: int
    name: str
    docs: int
    tokens: int


class TokenWriter(DataSourceArrowWriter):
    """One file for each task that has rows; ``commit`` writes the list of files, so files of lost or repeated tasks do not count."""

    def __init__(self, path: str, overwrite: bool, percentile: float) -> None:
        self.path, self.percentile = path, percentile
        fs, root = pafs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        if not overwrite and fs.get_file_info(f"{root}/{INDEX}").type != pafs.FileType.NotFound:
            raise ValueError(f"{path} holds token files; overwrite them or name another folder")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        part = TaskContext.get().partitionId()
        fs, root = pafs.FileSystem.from_uri(self.path)
        name = f"part-{part:07d}-{uuid.uuid4().hex}.tok"
        first = next((b for b in iterator if b.num_rows), None)
        if first is None:
            return Written(part, "", 0, 0)
        try:
            with fs.open_output_stream(f"{root}/{name}") as out:
                docs, tokens = self._fill(out, first, iterator)
        except BaseException:
            fs.delete_file(f"{root}/{name}")
            raise
        return Written(part, name, docs, tokens)

    def _fill(self, out, first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> tuple[int, int]:
        ids_of, lengths, starts, held = [], [], [], np.zeros(0, np.uint32)
        out.write(MAGIC)
        at, n = len(MAGIC), 0

        def put(ids: np.ndarray) -> None:
            nonlocal at
            for s in range(0, len(ids), STEP * BLOCK):
                blocks = pack_blocks(ids[s : s + STEP * BLOCK].reshape(-1, BLOCK), self.percentile)
                sizes = np.cumsum([0, *map(len, blocks)])
                starts.append(at + sizes[:-1])
                out.write(b"".join(blocks))
                at += int(sizes[-1])

        batch: pa.RecordBatch | None = first
        while batch is not None:
            data, off = core.text_bytes(column(batch, "ids"))
            ids_of.append(numbers(batch, "doc_id").astype("<i8"))
            lengths.append((np.diff(off) // 4).astype("<i8"))
            n += len(data) // 4
            held = np.concatenate([held, np.frombuffer(data.tobytes(), "<u4")])
            whole = len(held) // BLOCK * BLOCK
            put(held[:whole])
            held = held[whole:].copy()
            batch = next(rest, None)
        if len(held):
            put(np.pad(held, (0, BLOCK - len(held)), mode="edge"))
        index = np.concatenate([*starts, [at]]).astype("<u8")
        docs = np.concatenate(ids_of)
        out.write(index.tobytes() + docs.tobytes() + np.concatenate(lengths).tobytes())
        out.write(TRAILER.pack(len(index) - 1, len(docs), n, at, MAGIC))
        return len(docs), n

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = pafs.FileSystem.from_uri(self.path)
        files, before = [], 0
        for m in sorted((m for m in messages if m and m.name), key=lambda m: m.part):
            files.append({"name": m.name, "docs": m.docs, "tokens": m.tokens, "before": before})
            before += m.tokens
        with fs.open_output_stream(f"{root}/{INDEX}") as out:
            out.write(json.dumps({"tokens": before, "files": files}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = pafs.FileSystem.from_uri(self.path)
        for m in messages:
            if m and m.name:
                fs.delete_file(f"{root}/{m.name}")


@dataclass
class Share(InputPartition):
    """The documents of a file whose first id is in a share of its ids."""

    name: str
    before: int
    low: int
    high: int


class TokenReader(DataSourceReader):
    def __init__(self, path: str, task: int) -> None:
        self.path, self.task = path, task

    def partitions(self) -> list[Share]:
        fs, root = pafs.FileSystem.from_uri(self.path)
        with fs.open_input_stream(f"{root}/{INDEX}") as f:
            files = json.loads(f.read())["files"]
        shares = []
        for x in files:
            cuts = [*range(0, x["tokens"], self.task), max(1, x["tokens"])]
            shares += [Share(x["name"], x["before"], a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return shares

    def read(self, partition: Share | None) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, Share):  # no file
            return
        fs, root = pafs.FileSystem.from_uri(self.path)
        with fs.open_input_file(f"{root}/{partition.name}") as f:
            end = f.size() - TRAILER.size
            f.seek(end)
            blocks, docs, _, footer, magic = TRAILER.unpack(f.read(TRAILER.size))
            if magic != MAGIC:
                raise ValueError(f"{partition.name} is no token file")
            f.seek(footer)
            data = f.read(end - footer)
            index = np.frombuffer(data, "<u8", blocks + 1).astype(np.int64)
            ids = np.frombuffer(data, "<i8", docs, 8 * (blocks + 1))
            cut = np.concatenate([[0], np.cumsum(np.frombuffer(data, "<i8", docs, 8 * (blocks + 1 + docs)))])
            i, last = np.searchsorted(cut[:-1], [partition.low, partition.high]).tolist()
            while i < last:
                j = min(last, max(i + 1, int(np.searchsorted(cut, cut[i] + STEP * BLOCK, "right")) - 1))
                a, b = int(cut[i]), int(cut[j])
                p, q = a // BLOCK, -(-b // BLOCK)
                held = self._blocks(f, index, p, q)[a - p * BLOCK : b - p * BLOCK]
                yield core.batch_of(
                    doc_id=ids[i:j].copy(), start=partition.before + cut[i:j], n_tokens=np.diff(cut[i : j + 1]),
                    ids=core.binary_column(held.astype("<u4").tobytes(), np.diff(cut[i : j + 1]) * 4),
                )
                i = j

    @staticmethod
    def _blocks(f, index: np.ndarray, p: int, q: int) -> np.ndarray:
        out = np.empty((q - p, BLOCK), np.uint32)
        for s in range(p, q, STEP):
            e = min(q, s + STEP)
            f.seek(int(index[s]))
            data = np.frombuffer(f.read(int(index[e] - index[s])), np.uint8)
            out[s - p : e - p] = unpack_blocks(data, index[s:e] - index[s])
        return out.reshape(-1)


class TokenFiles(DataSource):
    """``spark.read.format("token_files").load(folder)``; the folder is a URI that pyarrow opens (file, hdfs, s3, gs)."""

    @classmethod
    def name(cls) -> str:
        return "token_files"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> TokenWriter:
        return TokenWriter(self.options["path"], overwrite, float(self.options.get("percentile", PERCENTILE)))

    def reader(self, schema) -> TokenReader:
        return TokenReader(self.options["path"], int(self.options.get("task", TASK)))


class Encoder(ByteTokens):
    """Token ids of many texts at once.

    A unit is white space and the word after it; no token reaches from a word
    to white space after it, so units are tokenised once, many joined to one
    text, and texts are put together from units.
    """

    def __init__(self, path: str) -> None:
        super().__init__(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        table = byte_table(self.tok.get_vocab())
        self.ranks, self.sizes = ranks_of(told, table), np.array([len(x) for x in table])
        self.units = re.compile(r"\s*\S+|\s+").findall
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.starts, self.ids = Grow(), Grow()
        self.starts.add([0])

    def _meet(self, fresh: dict[str, None], odd: set[str]) -> None:
        """Tokenise new units; those of ``odd`` apart."""
        alone = [u for u in odd if u in fresh]
        for u in alone:
            del fresh[u]
        rest = list(fresh)
        for s in range(0, len(rest), RUN):
            part = rest[s : s + RUN]
            text = "".join(part)
            ids = self.ranks.encode_to_numpy(text, allowed_special=set(), disallowed_special=()).astype(np.int64)
            sizes = list(map(len, part if text.isascii() else [u.encode() for u in part]))
            self._add(part, ids, np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum(sizes), "right"))
        if alone:
            ids, starts = flat([self.ranks.encode_ordinary(u) for u in alone])
            self._add(alone, ids, starts[1:])

    def _add(self, units: list[str], ids, ends: np.ndarray) -> None:
        self.number.update(zip(units, range(self.starts.n - 1, self.starts.n - 1 + len(units)), strict=True))
        self.starts.add(self.ids.n + ends)
        self.ids.add(ids)

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each has; texts that must be seen whole go to the library."""
        if self.ranks is None:
            ids, starts = flat([self.tok.encode(t, add_special_tokens=False).ids for t in texts])
            return ids, np.diff(starts)
        if len(self.number) > UNITS or self.ids.n > 8 * UNITS:
            self._forget()
        whole = {k: np.array(self.tok.encode(t, add_special_tokens=False).ids, np.int64) for k, t in enumerate(texts) if self.whole(t)}
        split = [[] if k in whole else self.units(t) for k, t in enumerate(texts)]
        every = list(chain.from_iterable(split))
        numbered = np.fromiter(map(self.number.get, every, repeat(-1)), np.int64, len(every))
        missing = np.flatnonzero(numbered < 0)
        if len(missing):
            new = [every[k] for k in missing.tolist()]
            # White space alone ends a text, and a word without any before it begins one: joined to others they would change.
            ends = {u for us in split if us for u in (us[0], us[-1]) if u.isspace() or not u[0].isspace()}
            self._meet(dict.fromkeys(new), ends)
            numbered[missing] = list(map(self.number.__getitem__, new))
        starts = self.starts.now
        at, _ = spread(numbered, starts)
        ids = self.ids.now[at]
        first = np.cumsum([0, *map(len, split)])
        total = np.concatenate([[0], np.cumsum(starts[numbered + 1] - starts[numbered])])
        cut = total[first]
        if not whole:
            return ids, np.diff(cut)
        parts = [whole[k] if k in whole else ids[cut[k] : cut[k + 1]] for k in range(len(texts))]
        return np.concatenate(parts), np.array([len(p) for p in parts])


_encoders: dict[str, Encoder] = {}


def _encode(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        for b in batches:
            texts, ids = column(b, "text"), numbers(b, "doc_id")
            for i, j in core.steps(core.text_bytes(texts)[1]):
                made, n = _encoders[path].encode_all(texts[i:j].to_pylist())
                made = np.insert(made, np.cumsum(n), end).astype("<u4")
                yield core.batch_of(doc_id=ids[i:j], ids=core.binary_column(made.tobytes(), 4 * (n + 1)))

    return run


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end: int = END, percentile: float = PERCENTILE, ranges: int | None = None) -> None:
    """Tokenise and write token files in ascending order of doc_id.

    Texts go to ranges of ids once; each range is sorted, tokenised and written
    by one task, and how many ids come before it is known when all are written,
    so ids are never shuffled.  Without ``ranges``, there are as many as
    ``spark.sql.shuffle.partitions`` and adaptive execution make.

    Null or empty text: the end id alone.  A null doc_id is the last id.
    Repeated rows are written each; rows of one id are ordered by a hash of the
    text, equal ones in any order (they have the same ids), and may be in
    several ranges.  A very long text is one document of one file.  An empty
    table gives an index without files.  Other columns are ignored.
    """
    docs.sparkSession.dataSource.register(TokenFiles)
    rows = core.id_text(docs).withColumns({"mark": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    dealt = rows.repartitionByRange(*([ranges] if ranges else []), "doc_id", "mark", "row")
    ordered = dealt.sortWithinPartitions("doc_id", "mark", "row").select("doc_id", "text")
    ids = ordered.mapInArrow(_encode(tokenizer, end), "doc_id long, ids binary")
    ids.write.format("token_files").option("percentile", percentile).mode("append").save(folder)


def read_tokens(spark: SparkSession, folder: str, task: int = TASK) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the files; ids as little-endian unsigned 32-bit numbers."""
    spark.dataSource.register(TokenFiles)
    return core.give_back_ids(spark.read.format("token_files").option("task", task).load(folder))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = core.scratch(spark, "tokens")
    core.small_batches(spark)
    write_tokens(core.documents(spark, sf_dir).select("doc_id", "text"), folder, tokenizer_path("byte_bpe_50k.json"))
    return read_tokens(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op11_token_files": op11_token_files}
SQL: dict[str, str] = {}
