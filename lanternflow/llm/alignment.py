"""Alignment of two tokenizers by a dictionary of groups.

Both tokenise the same bytes (a space and the text).  Where a token of A and
one of B end at the same byte, both sequences are cut; what lies between two
cuts is a group, a few ids of A and a few of B, and its links are all pairs of
them.  Texts consist of few distinct groups, so groups, not links, are what is
counted, expanded and joined:

1. A worker interns the groups it meets.  A document becomes the numbers of its
   distinct groups and how often each occurs; the dictionary of a run of
   documents (an epoch) is written once, each group with how many documents
   have it.
2. Equal groups of all epochs are added up, and each distinct one is expanded
   once to its distinct id pairs, weighted by its documents.  A document that
   holds a pair in k groups would count k times; k - 1 are taken off again,
   which the worker that reads the document knows.
3. Each distinct group gets what its links come to (sum of counts, links whose
   count is the highest of their A id).  This is joined to the dictionaries by
   group, and to the documents by epoch, where it is a table that a worker
   holds while the epoch's documents stream past.

A is a file of the tokenizers library with byte-level pieces, B a sentencepiece
model with byte fallback that adds a space.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternflow.llm import core
from lanternflow.llm.core import column, numbers
from lanternflow.llm.packing import tokenizer_path

#: Groups, links in the dictionary, documents and units of an epoch, about; it ends with the batch in which one is passed.
GROUPS, LINKS, DOCS, UNITS = 150_000, 600_000, 50_000, 300_000
#: Bytes of the longest unit that is remembered.
LONG = 64
#: Units that are tokenised as one text.
RUN = 2_000
SPACE = "▁"
# Fixed value: the pattern by which byte-level pieces split text before their merges.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_table(vocab: dict[str, int]) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [x for x in range(256) if x not in own]
    byte = {chr(x): x for x in own} | {chr(256 + i): x for i, x in enumerate(others)}
    out = [b""] * (max(vocab.values()) + 1)
    for piece, i in vocab.items():
        out[i] = bytes(byte[c] for c in piece) if all(c in byte for c in piece) else piece.encode()
    return out


def ranks_of(told: dict, table: list[bytes]):
    """A tokenizer file by ranks, which is several times as fast; None unless merges rank as their ids do and words are split by the usual pattern."""
    import tiktoken

    vocab, first = told["model"]["vocab"], told["pre_tokenizer"] or {}
    merged = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m)) for m in told["model"].get("merges", [])]
    plain = first.get("type") == "ByteLevel" and not first.get("add_prefix_space") and first.get("use_regex", True) and not told["normalizer"]
    if not plain or None in merged or merged != sorted(merged) or any(len(table[i]) == 1 and i > min(merged) for i in vocab.values()):
        return None
    special = {t["content"] for t in told["added_tokens"]}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={table[i]: i for p, i in vocab.items() if p not in special}, special_tokens={})


class Pair:
    """Both tokenizers, unit by unit.

    A unit is white space and what follows it.  Neither tokenizer has a token
    that reaches from a character that is no white space over one of
    ``self.edges``, so units are tokenised apart and remembered.
    """

    def __init__(self, a: str, b: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=b)
        with open(a, encoding="utf-8") as f:
            told = json.load(f)
        self.a_bytes = byte_table(self.a.get_vocab())
        self.ranks = ranks_of(told, self.a_bytes)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.a_len, self.b_len = (np.array([len(x) for x in t]) for t in (self.a_bytes, self.b_bytes))
        self.space = self.b.piece_to_id(SPACE)
        words = [p.replace(SPACE, " ") for i, p in enumerate(pieces) if not self.b.is_byte(i)]
        # A space may begin a piece; the others must be in none, so that the space that B adds stays a piece of its own.
        self.edges = "".join(e for e in " \n\t" if not any(re.search(rf"\S{e}", p) if e == " " else e in p for p in words))
        rest = rf"(?:(?![{self.edges}])\s+\S*)*" if self.edges else r"(?:\s+\S*)*"
        self.units = re.compile(rf"\s*\S+{rest}|\s+").findall

    def a_ids(self, texts: list[str]) -> list[list[int]]:
        if self.ranks is None:
            return [e.ids for e in self.a.encode_batch(texts, add_special_tokens=False)]
        return [self.ranks.encode_ordinary(t) for t in texts]

    def b_ids(self, units: list[str]) -> list[list[int]]:
        """B's ids of units as they stand, each beginning with a space or an edge."""
        bare = [u[1:] if u[0] == " " else u for u in units]
        found = self.b.encode(bare, num_threads=1)
        return [([self.space] if u == " " else ids) if u[0] == " " else ids[1:] for u, ids in zip(units, found, strict=True)]

    def tokens(self, units: list[str]) -> tuple[Tokens, np.ndarray]:
        """Both tokenisations of units, one after the other, and which units both give back byte by byte."""
        raw = [u.encode() for u in units]
        a, b = flat(self.a_ids(units)), flat(self.b_ids(units))
        joined = lambda table, ids, starts: [b"".join(map(table.__getitem__, ids[s:e].tolist())) for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
        same = [r == x == y for r, x, y in zip(raw, joined(self.a_bytes, *a), joined(self.b_bytes, *b), strict=True)]
        return Tokens(*a, *b), np.array(same, bool)

    def tokens_at_once(self, units: list[str]) -> Tokens | None:
        """The same of units that are no white space alone, ``RUN`` of them joined to one text; None if not all bytes come back."""
        if self.ranks is None:
            return None
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for s in range(0, len(units), RUN):
            text = "".join(units[s : s + RUN])
            a = self.ranks.encode_to_numpy(text, allowed_special=set(), disallowed_special=()).astype(np.int64)
            b = self.b_ids([text])[0]
            if not b"".join(map(self.a_bytes.__getitem__, a.tolist())) == b"".join(map(self.b_bytes.__getitem__, b)) == text.encode():
                return None
            found.append((a, np.array(b, np.int64)))
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        ends = np.cumsum([len(u.encode()) for u in units])
        starts = [np.concatenate([[0], np.searchsorted(np.cumsum(n[x]), ends, "right")]) for x, n in ((a, self.a_len), (b, self.b_len))]
        return Tokens(a, starts[0], b, starts[1])


def flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists one after the other, and where each begins (one more at the end)."""
    return np.fromiter(chain.from_iterable(lists), np.int64), np.cumsum([0, *map(len, lists)])


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The sum of each run of values."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[starts[1:]] - total[starts[:-1]]


@dataclass
class Tokens:
    """Ids of A and B for some texts, and where each text's begin."""

    a: np.ndarray
    a_start: np.ndarray
    b: np.ndarray
    b_start: np.ndarray

    def cut(self, a_len: np.ndarray, b_len: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cut texts of equal bytes to groups: where in A and B each group begins (one more at the end), and each text's first group."""
        ea, eb = np.cumsum(a_len[self.a]), np.cumsum(b_len[self.b])
        ends = np.intersect1d(ea, eb, assume_unique=True)
        ga, gb = np.searchsorted(ea, ends, "right"), np.searchsorted(eb, ends, "right")
        return np.concatenate([[0], ga]), np.concatenate([[0], gb]), np.concatenate([[0], np.searchsorted(ga, self.a_start[1:], "right")])


def links(group: tuple[tuple[int, ...], tuple[int, ...]]) -> dict[tuple[int, int], int]:
    """Distinct id pairs of a group and how many token pairs each is."""
    a, b = group
    if len(a) == len(b) == 1:
        return {(a[0], b[0]): 1}
    ca, cb = Counter(a), Counter(b)
    return {(x, y): n * m for x, n in ca.items() for y, m in cb.items()}


class Grow:
    """Numbers added at the end."""

    def __init__(self) -> None:
        self.held, self.n = np.zeros(1 << 12, np.int64), 0

    def add(self, values) -> None:
        need = self.n + len(values)
        if need > len(self.held):
            self.held = np.concatenate([self.held, np.zeros(max(need, len(self.held)), np.int64)])
        self.held[self.n : need] = values
        self.n = need

    @property
    def now(self) -> np.ndarray:
        return self.held[: self.n]


def spread(rows: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs named by ``rows`` with bounds ``starts``: the place of each of their entries, and which row it is from."""
    n = starts[rows + 1] - starts[rows]
    of = np.repeat(np.arange(len(rows)), n)
    first = np.cumsum(n) - n
    return starts[rows][of] + np.arange(len(of)) - first[of], of


class Epoch:
    """Units, groups and id pairs met so far, numbered in order of appearance."""

    def __init__(self) -> None:
        self.unit: dict[str, int] = {}
        self.said: list[str] = []
        self.unit_start, self.unit_group, self.unit_stats = Grow(), Grow(), [Grow() for _ in range(4)]
        self.group: dict[tuple, int] = {}
        #: Groups of one id each, by both ids in a number.
        self.single: dict[int, int] = {}
        self.group_start, self.group_pair = Grow(), Grow()
        self.pair: dict[tuple[int, int], int] = {}
        self.pair_groups = Grow()
        self.unit_start.add([0])
        self.group_start.add([0])
        self.docs = 0
        self.with_group, self.taken = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def full(self) -> bool:
        return len(self.group) > GROUPS or len(self.pair) > LINKS or self.docs > DOCS or len(self.unit) > UNITS

    def _intern(self, group: tuple[tuple[int, ...], tuple[int, ...]]) -> int:
        g = self.group.get(group)
        if g is None:
            g = self.group[group] = len(self.group)
            own = []
            for p in links(group):
                at = self.pair.get(p)
                if at is None:
                    at = self.pair[p] = len(self.pair)
                    self.pair_groups.add([0])
                own.append(at)
            self.group_pair.add(own)
            self.pair_groups.held[own] += 1
            self.group_start.add([self.group_pair.n])
            a, b = group
            self.said.append(",".join(map(str, a)) + "|" + ",".join(map(str, b)))
        return g

    def add_units(self, t: Tokens, a_len: np.ndarray, b_len: np.ndarray) -> int:
        """Number new units, all of equal bytes in A and B; the first one's number."""
        ga, gb, first = t.cut(a_len, b_len)
        na, nb = np.diff(ga), np.diff(gb)
        number = np.empty(len(na), np.int64)
        single = (na == 1) & (nb == 1)
        codes, back = np.unique((t.a[ga[:-1][single]] << 32) | t.b[gb[:-1][single]], return_inverse=True)
        have = self.single
        for c in codes.tolist():
            if c not in have:
                have[c] = self._intern(((c >> 32,), (c & 0xFFFFFFFF,)))
        number[single] = np.array(list(map(have.__getitem__, codes.tolist())), np.int64)[back]
        more = np.flatnonzero(~single)
        bounds = zip(ga[more].tolist(), ga[more + 1].tolist(), gb[more].tolist(), gb[more + 1].tolist(), strict=True)
        a, b = t.a.tolist(), t.b.tolist()
        keys = [(tuple(a[s:e]), tuple(b[p:q])) for s, e, p, q in bounds]
        for key in dict.fromkeys(keys):
            self._intern(key)
        number[more] = list(map(self.group.__getitem__, keys))
        before = self.unit_start.n - 1
        self.unit_start.add(self.unit_group.n + first[1:])
        self.unit_group.add(number)
        for g, x in zip(self.unit_stats, (np.diff(t.a_start), np.diff(t.b_start), np.diff(first), sums(na * nb, first)), strict=True):
            g.add(x)
        return before


#: Of the rows of the stored table: documents, groups of an epoch, pairs counted too often, and pairs of documents whose id may repeat.
DOC, GROUP, AGAIN, PAIRS = 0, 1, 2, 3
ROWS = "kind int, epoch long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, refs array<int>, times array<int>, num int, a array<int>, b array<int>, n long"
_TYPES = {
    "kind": pa.int32(), "epoch": pa.int64(), "doc_id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string(),
    "refs": pa.list_(pa.int32()), "times": pa.list_(pa.int32()), "num": pa.int32(), "a": pa.list_(pa.int32()), "b": pa.list_(pa.int32()), "n": pa.int64(),
}


def _lists(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values, pa.int32()))


def _rows(size: int, kind: int, **given) -> pa.RecordBatch:
    cols = [pa.array(np.full(size, kind, np.int32)) if c == "kind" else pa.nulls(size, t) if c not in given else given[c] if isinstance(given[c], pa.Array) else pa.array(given[c], t) for c, t in _TYPES.items()]
    return pa.RecordBatch.from_arrays(cols, names=list(_TYPES))


_pairs: dict[tuple[str, str], Pair] = {}


class Aligner:
    """Turns batches of texts into rows of documents and, at the end of each epoch, rows of its dictionary."""

    def __init__(self, a: str, b: str, repeated: bytes) -> None:
        if (a, b) not in _pairs:
            _pairs[a, b] = Pair(a, b)
        self.both, self.repeated = _pairs[a, b], repeated
        self.number, self.epoch = TaskContext.get().partitionId() << 32, Epoch()

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = column(batch, "text"), numbers(batch, "doc_id")
            apart = core.in_id_filter(self.repeated, numbers(batch, "at"))
            for i, j in core.steps(core.text_bytes(texts)[1]):
                yield from self._step(ids[i:j], texts[i:j].to_pylist(), apart[i:j])
                if self.epoch.full():
                    yield from self._end()
        yield from self._end()

    def _units(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Unit numbers of all texts, and where each text's begin; a text without tokens has none."""
        e, both = self.epoch, self.both
        split = [both.units(" " + t) if t else [] for t in texts]
        every = list(chain.from_iterable(split))
        numbers = np.fromiter(map(e.unit.get, every, repeat(-1)), np.int64, len(every))
        starts = np.cumsum([0, *map(len, split)])
        missing = np.flatnonzero(numbers < 0)
        if not len(missing):
            return numbers, starts
        new = [every[k] for k in missing.tolist()]
        met, bad = self._meet(list(dict.fromkeys(new)))
        numbers[missing] = list(map(met.get, new, repeat(-1)))
        if not bad:
            return numbers, starts
        # The bytes of a text with a unit that does not come back may agree over the whole of it all the same.
        found = []
        for k, t in enumerate(texts):
            own = numbers[starts[k] : starts[k + 1]]
            if (own < 0).any():
                whole, same = both.tokens([" " + t])
                own = np.array([e.add_units(whole, both.a_len, both.b_len)] if same[0] else [], np.int64)
            found.append(own)
        return np.concatenate(found), np.cumsum([0, *map(len, found)])

    def _meet(self, fresh: list[str]) -> tuple[dict[str, int], bool]:
        """Numbers of new units, and whether some have none as their bytes do not come back."""
        both, met, bad = self.both, {}, False
        blank = [u for u in fresh if u.isspace()]
        rest = [u for u in fresh if not u.isspace()]
        for units, joined in ((rest, True), (blank, False)):
            if not units:
                continue
            t = both.tokens_at_once(units) if joined else None
            if t is None:
                t, same = both.tokens(units)
                if not same.all():
                    bad = True
                    units = [u for u, ok in zip(units, same.tolist(), strict=True) if ok]
                    if not units:
                        continue
                    t, _ = both.tokens(units)
            met.update(zip(units, range(first := self.epoch.add_units(t, both.a_len, both.b_len), first + len(units)), strict=True))
        self.epoch.unit.update((u, k) for u, k in met.items() if len(u) <= LONG)
        return met, bad

    def _step(self, ids: np.ndarray, texts: list[str], apart: np.ndarray) -> Iterator[pa.RecordBatch]:
        e, n = self.epoch, len(texts)
        units, starts = self._units(texts)
        doc = np.repeat(np.arange(n), np.diff(starts))
        stats = [sums(g.now[units], starts) for g in e.unit_stats]
        at, of = spread(units, e.unit_start.now)
        every = e.unit_group.now[at]
        said = list(map(e.said.__getitem__, every.tolist()))
        cuts = np.concatenate([[0], np.cumsum(stats[2])]).tolist()
        sha = [hashlib.sha256(";".join(said[s:t]).encode()).hexdigest() if t > s else "" for s, t in zip(cuts[:-1], cuts[1:], strict=True)]
        code, times = np.unique((doc[of] << 32) | every, return_counts=True)
        owner, group = code >> 32, code & 0xFFFFFFFF
        cuts = np.searchsorted(owner, np.arange(n + 1))
        e.docs += n
        e.with_group = np.concatenate([e.with_group, np.zeros(max(0, len(e.group) - len(e.with_group)), np.int64)])
        e.taken = np.concatenate([e.taken, np.zeros(max(0, len(e.pair) - len(e.taken)), np.int64)])
        counted = ~apart[owner]
        e.with_group += np.bincount(group[counted], minlength=len(e.with_group))
        # Pairs that several groups have, once for each group of a document that has them.
        at, of = spread(group, e.group_start.now)
        pair = e.group_pair.now[at]
        some = counted[of] & (e.pair_groups.now[pair] > 1)
        seen, often = np.unique((owner[of][some] << 32) | pair[some], return_counts=True)
        np.add.at(e.taken, (seen & 0xFFFFFFFF)[often > 1], often[often > 1] - 1)
        yield _rows(
            n, DOC, epoch=np.full(n, self.number), doc_id=ids, n_a=stats[0], n_b=stats[1], n_groups=stats[2], n_links=stats[3],
            groups_sha256=sha, refs=_lists(group, cuts), times=_lists(times, cuts),
        )
        if apart.any():
            mine = ~counted[of]
            seen = np.unique((owner[of][mine] << 32) | pair[mine])
            names = np.array(list(e.pair), np.int64).reshape(-1, 2)[seen & 0xFFFFFFFF]
            cuts = np.searchsorted(seen >> 32, np.arange(n + 1))
            rows = _rows(n, PAIRS, doc_id=ids, a=_lists(names[:, 0], cuts), b=_lists(names[:, 1], cuts))
            yield rows.filter(pa.array(np.diff(cuts) > 0))

    def _end(self) -> Iterator[pa.RecordBatch]:
        e, size = self.epoch, 20_000
        groups = list(e.group)
        for s in range(0, len(groups), size):
            part = groups[s : s + size]
            k = len(part)
            yield _rows(k, GROUP, epoch=np.full(k, self.number), num=np.arange(s, s + k), a=[g[0] for g in part], b=[g[1] for g in part], n=e.with_group[s : s + k])
        again = np.flatnonzero(e.taken)
        if len(again):
            names = np.array(list(e.pair), np.int64).reshape(-1, 2)[again]
            one = np.arange(len(again) + 1)
            yield _rows(len(again), AGAIN, a=_lists(names[:, 0], one), b=_lists(names[:, 1], one), n=e.taken[again])
        self.number += 1
        self.epoch = Epoch()


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct id pairs of each group."""
    for batch in batches:
        cols = [column(batch, c) for c in ("group", "a", "b", "n")]
        out: list[tuple] = []
        for g, a, b, n in zip(*(c.to_pylist() for c in cols), strict=True):
            out += [(g, x, y, m, n) for (x, y), m in links((a, b)).items()]
            if len(out) > 50_000:
                yield _expanded(out)
                out = []
        if out:
            yield _expanded(out)


def _expanded(rows: list[tuple]) -> pa.RecordBatch:
    g, a, b, m, n = zip(*rows, strict=True)
    return core.batch_of(group=pa.array(g, pa.int64()), a=pa.array(a, pa.int32()), b=pa.array(b, pa.int32()), times=pa.array(m, pa.int64()), n=pa.array(n, pa.int64()))


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with the sums of their groups' values; of each epoch the values come first."""
    epoch, best, total = None, np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        of = numbers(batch, "epoch")
        cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            part = batch.slice(s, e - s)
            if of[s] != epoch:
                epoch, best, total = of[s], np.zeros(0, np.int64), np.zeros(0, np.int64)
            is_doc = numbers(part, "kind") == DOC
            held, docs = part.filter(pa.array(~is_doc)), part.filter(pa.array(is_doc))
            if held.num_rows:
                num = numbers(held, "num").astype(np.int64)
                grow = max(0, int(num.max()) + 1 - len(best))
                best, total = (np.concatenate([x, np.zeros(grow, np.int64)]) for x in (best, total))
                best[num], total[num] = numbers(held, "best"), numbers(held, "total")
            if docs.num_rows:
                refs, times = column(docs, "refs"), column(docs, "times").flatten().to_numpy().astype(np.int64)
                ref, off = refs.flatten().to_numpy(), np.concatenate([[0], np.cumsum(refs.value_lengths().to_numpy())])
                out = []
                for x in (best, total):
                    out.append(sums(x[ref] * times, off))
                kept = [column(docs, c) for c in OUT[:6]]
                yield pa.RecordBatch.from_arrays([*kept[:5], pa.array(out[0]), pa.array(out[1]), kept[5]], names=[*OUT[:5], "n_best", "count_sum", OUT[5]])


OUT = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")


def align(docs: DataFrame, a: str, b: str) -> DataFrame:
    """Align two tokenizers over every text and sum up each document's links.

    Returns doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and
    groups_sha256.

    Null and empty texts, and texts whose bytes A or B does not give back, have
    no tokens: zeros and an empty hash.  Rows of one id count as one document,
    a null doc_id being an id too; each is answered.  They are recognised by a
    filter over the repeated ids; what it lets through (with false hits) is
    counted by distinct (id, pair), all else by groups.  Ties for an A id's
    highest count are all best.  Very long texts are tokenised whole; very long
    runs without a common end are one group, whose links are counted by
    distinct ids.  An empty table gives an empty table.
    """
    spark = docs.sparkSession
    base = core.id_text(docs)
    repeated = core.id_filter(spark, base.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from Aligner(a, b, repeated.value).run(batches)

    found = core.stored(core.with_slot(base).mapInArrow(run, ROWS), "aligned")
    held = found.where(F.col("kind") == GROUP)
    groups = core.stored(held.groupBy("a", "b").agg(F.sum("n").alias("n")).withColumn("group", F.monotonically_increasing_id()), "groups")
    pairs = groups.mapInArrow(_expand, "group long, a int, b int, times long, n long")
    again = found.where(F.col("kind") == AGAIN).select(F.col("a")[0].alias("a"), F.col("b")[0].alias("b"), (-F.col("n")).alias("n"))
    apart = found.where(F.col("kind") == PAIRS).select("doc_id", F.explode(F.arrays_zip("a", "b")).alias("p")).select("doc_id", "p.a", "p.b").distinct().select("a", "b", F.lit(1).cast("long").alias("n"))
    counts = pairs.select("a", "b", "n").unionByName(again).unionByName(apart).groupBy("a", "b").agg(F.sum("n").alias("count"))
    counts = core.stored(counts, "pairs")
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    # One row for each id of A's vocabulary at most.
    marked = counts.join(F.broadcast(most), "a").select("a", "b", "count", (F.col("count") == F.col("most")).alias("top"))
    values = pairs.join(marked, ["a", "b"]).groupBy("group").agg(F.sum(F.col("times") * F.col("count")).alias("total"), F.sum(F.when(F.col("top"), F.col("times")).otherwise(0)).alias("best"))
    scored = groups.join(values, "group").select("a", "b", "best", "total")
    told = held.join(scored, ["a", "b"]).select("kind", "epoch", "num", "best", "total")
    rows = told.unionByName(found.where(F.col("kind") == DOC).select("kind", "epoch", "refs", "times", *OUT), allowMissingColumns=True)
    dealt = rows.repartition("epoch").sortWithinPartitions("epoch", F.desc("kind"))
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return core.give_back_ids(dealt.mapInArrow(_values, schema))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    core.small_batches(spark)
    return align(core.documents(spark, sf_dir).select("doc_id", "text"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


QUERIES = {"op13_alignment": op13_alignment}
SQL: dict[str, str] = {}
