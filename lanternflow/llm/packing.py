"""Best-fit packing of tokenised documents into fixed-length sequences.

Documents become pieces (only documents longer than a sequence are cut), and
pieces are packed by bounded-space online best-fit: at most ``OPEN`` bins are
open; a bitset over free space says in a few machine operations which open bin
fits most tightly.  When a piece needs a new bin and all places are taken, the
fullest open bin closes.

Pieces are dealt to tasks at random and come there in the order of their
documents; ``RUN`` of them arrive together and are placed from long to short.
A task streams its pieces through the same open bins from its first to its
last, so its memory does not depend on how many it has.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternflow.llm import core
from lanternflow.llm.core import column, numbers

LENGTH = 2048
#: Bins that are open at once in a task, and pieces that arrive together.
OPEN, RUN = 64, 256
#: Pieces of one task, on average; each task ends with some bins unfilled, at most ``OPEN``.
TASK = 1 << 16
SEPARATOR = 0
#: Words whose ids a Python worker keeps.
CACHE = 150_000

# The byte-level vocabulary splits text by this pattern before its merges; here spelt for
# characters up to U+024F, whose letters, numbers and spaces are these.
_L = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_N = "0-9²³¹¼-¾"
_S = "\t-\r \u0085 "
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"


class ByteTokens:
    """Token ids as little-endian bytes, word by word, each word encoded once by the tokenizers library."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.words = re.compile(SPLIT).findall
        special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.special = special
        self.beyond = re.compile("[^\x00-ɏ]").search
        # The byte-level alphabet: printable bytes stand for themselves, the others for U+0100 and on, in order.
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in own]
        self.letters = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.cache: dict[str, bytes] = {}

    def whole(self, text: str) -> bool:
        """Whether the library must see the text whole."""
        return not text.isascii() and self.beyond(text) is not None or any(s in text for s in self.special)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; texts beyond U+024F or with special tokens go to the library whole."""
        split = [None if self.whole(t) else self.words(t) for t in texts]
        if len(self.cache) > CACHE:
            self.cache.clear()
        cache = self.cache
        merged, letters, packed = self.tok.model.tokenize, self.letters, struct.pack
        for w in {w for ws in split if ws for w in ws if w not in cache}:
            ids = [t.id for t in merged(w.encode().decode("latin-1").translate(letters))]
            cache[w] = packed(f"<{len(ids)}I", *ids)
        get = cache.__getitem__
        return [np.array(self.tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() if ws is None else b"".join(map(get, ws)) for t, ws in zip(texts, split, strict=True)]


_tokens: dict[str, ByteTokens] = {}


def byte_tokens(path: str) -> ByteTokens:
    if path not in _tokens:
        _tokens[path] = ByteTokens(path)
    return _tokens[path]


def cut(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; all but the first are full."""
    first = n % length or length
    return [(0, min(first, n))] + [(s, length) for s in range(first, n, length)]


def _cutter(path: str, length: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw = np.random.default_rng(TaskContext.get().partitionId())
        end = np.array([SEPARATOR], "<u4").tobytes()
        for b in batches:
            ids, texts = numbers(b, "doc_id"), column(b, "text")
            for i, j in core.steps(core.text_bytes(texts)[1], 1 << 20):
                rows: list[tuple] = []
                for k, x in enumerate(byte_tokens(path).encode(texts[i:j].to_pylist()), i):
                    x += end
                    for p, (s, n) in enumerate(cut(len(x) // 4, length)):
                        piece = x[4 * s : 4 * (s + n)]
                        rows.append((k, p, s, n, zlib.crc32(piece), piece))
                at, p, s, n, crc = np.array([r[:5] for r in rows], np.int64).T
                out = {"doc_id": ids[at], "piece": p.astype(np.int32), "start": s.copy(), "length": n.copy(), "ids_crc32": crc.copy(), "slot": draw.integers(0, 2**31, len(rows))}
                if with_ids:
                    out["ids"] = pa.array([np.frombuffer(r[5], "<i4") for r in rows], pa.list_(pa.int32()))
                yield core.batch_of(**out)

    return run


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, slot long" + ", ids array<int>" * with_ids
    return core.id_text(docs).mapInArrow(_cutter(tokenizer, length, with_ids), schema)


class OpenBins:
    """Bounded-space online best-fit.

    ``bits`` has bit f set if an open bin has f free places; ``bins[f]`` are
    those bins.  The lowest set bit at or above a length is the best fit, the
    lowest of all is the fullest bin.  ``closed`` counts bins closed for want
    of a place.
    """

    def __init__(self, room: int, most_open: int) -> None:
        self.room, self.most_open = room, most_open
        self.bits, self.open, self.made, self.closed = 0, 0, 0, 0
        self.bins: list[list[int]] = [[] for _ in range(room + 1)]

    def _take(self, free: int) -> int:
        b = self.bins[free].pop()
        if not self.bins[free]:
            self.bits ^= 1 << free
        self.open -= 1
        return b

    def put(self, lengths: list[int]) -> tuple[list[int], list[int]]:
        """Bin and offset of each length, in the order given."""
        room, bins = self.room, self.bins
        at: list[int] = []
        place: list[int] = []
        for n in lengths:
            fits = self.bits >> n
            if fits:
                free = n + ((fits & -fits).bit_length() - 1)
                b = self._take(free)
            else:
                if self.open == self.most_open and n < room:
                    self._take((self.bits & -self.bits).bit_length() - 1)
                    self.closed += 1
                free, b = room, self.made
                self.made += 1
            at.append(b)
            place.append(room - free)
            if free > n:
                bins[free - n].append(b)
                self.bits |= 1 << (free - n)
                self.open += 1
        return at, place


def longest_first(lengths: np.ndarray, run: int) -> np.ndarray:
    """The order in which pieces are placed: run by run as they arrive, inside a run from long to short (ties as they came)."""
    return np.lexsort((-lengths, np.arange(len(lengths)) // run))


def _packer(room: int, most_open: int, run: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, high = OpenBins(room, most_open), TaskContext.get().partitionId() << 32
        for b in batches:
            if not b.num_rows:
                continue
            length = numbers(b, "length")
            order = longest_first(length, run)
            seq, place = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            seq[order], place[order] = bins.put(length[order].tolist())
            keep = [c for c in b.schema.names if c != "slot"]
            yield pa.RecordBatch.from_arrays([*(column(b, c) for c in keep), pa.array(seq + high), pa.array(place)], names=[*keep, "sequence_id", "offset"])

    return go


def pack(found: DataFrame, length: int = LENGTH, most_open: int = OPEN, run: int = RUN, task: int = TASK) -> DataFrame:
    """Give each piece a sequence and its place there."""
    found = core.stored(found, "pieces")
    tasks = max(1, -(-found.count() // task))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema if f.name != "slot")
    # Every column decides the order, so a task that runs again packs alike.
    dealt = found.repartition(tasks, "slot").sortWithinPartitions("doc_id", "piece", "slot", "length", "ids_crc32")
    return dealt.mapInArrow(_packer(length, most_open, run), f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, length: int = LENGTH, most_open: int = OPEN, with_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack; one row per piece.

    A document is its token ids and a separator 0.  Only documents longer than
    ``length`` are cut; the first piece takes the remainder, the others are
    full.  Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset
    (and ids if asked for).

    Null or empty text: the separator alone, a piece of length 1.  A null
    doc_id is packed and given back as null.  Repeated rows are packed once
    each.  Of open bins with equal space the last used is taken.  Very long
    texts are tokenised whole.  An empty table gives no pieces.
    """
    return core.give_back_ids(pack(pieces(docs, tokenizer, length, with_ids), length, most_open))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(core.documents(spark, sf_dir).select("doc_id", "text"), tokenizer_path("byte_bpe_50k.json"))


QUERIES = {"op7_best_fit_packing": op7_best_fit_packing}
SQL: dict[str, str] = {}
