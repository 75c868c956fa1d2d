"""Substring dedup by compact windows.

Texts are sequences of 5-word shingles.  For a hash function, the Cartesian
tree over the hashes of a text groups its subsequences: all subsequences
[i, j] with l <= i <= c <= j <= r have their least hash at c, so one compact
window (l, c, r) stands for them.  Only windows that hold a subsequence of the
least length asked for are kept, about 2 n / T of n positions.

Windows of two texts with one hash are joined on it: laid over each other at c
they share the interval that both cover, which must be long enough.  Pairs that
meet so under enough hash functions are candidates; both texts then meet and are
aligned: shingles of one are tied to places in the other, in order.  A stretch
of the alignment that is matched to the share asked for, gaps of both texts
counted, is a near-duplicate passage.

The join is a sweep.  Windows of a hash that reach equally far to both sides
have one extent (there are at most (T + 1)^2, as further reach does not count);
the document of smallest id stands for it.  Extents come in the order of these
ids; one that overlaps no leader of another document so far by a passage leads,
each other is tied to all earlier leaders that it overlaps.  What leads follows
from the windows alone, not from how rows are dealt to tasks.  A passage that
very many texts hold makes as many links as it has copies; of copies with one
extent in a batch only the first is sent to the sweep, the others are joined
with its outcome.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternflow.llm import core
from lanternflow.llm.core import U64, column, mix, numbers
from lanternflow.llm.jaccard_join import MEMBERS

WORDS, PCT = 5, 75
#: Least passage in words; hash functions; functions that must agree.
PASSAGE, FUNCTIONS, AGREE = 50, 8, 2
_PLACE = 28
_NAMES = ["key", "doc_id", "left", "right", "role"]
#: A window alone with its extent in a batch, the first of several, and the others of these.
ALONE, FIRST, OTHER = 0, 1, 2


def compact_windows(h: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of the compact windows of at least ``least`` places; r is exclusive.

    ``first`` are the bounds of the texts in ``h``.  The Cartesian trees of all
    texts are gone down together, a level at a time.
    """
    n = len(h)
    low = U64((1 << _PLACE) - 1)
    v = np.append((h & ~low) | np.arange(n, dtype=np.uint64), ~U64(0))
    s, e = first[:-1], first[1:]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while True:
        ok = e - s >= least
        s, e = s[ok], e[ok]
        if not len(s):
            break
        c = (np.minimum.reduceat(v, np.stack([s, e], axis=1).ravel())[::2] & low).astype(np.int64)
        found.append((s, c, e))
        s, e = np.stack([s, c + 1], axis=1).ravel(), np.stack([c, e], axis=1).ravel()
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([none, *(f[k] for f in found)]) for k in range(3))  # type: ignore[return-value]


def _widest(key: np.ndarray, row: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which windows of a text under a key no other of its windows covers (input sorted by key, row)."""
    own = np.cumsum((np.diff(key, prepend=key[:1]) != 0) | (np.diff(row, prepend=row[:1]) != 0))
    order = np.lexsort((-right, -left, own))
    z = own[order] * (int(right.max(initial=0)) + 1) + right[order]
    keep = np.zeros(len(key), bool)
    keep[order] = np.diff(np.maximum.accumulate(z), prepend=-1) > 0
    return keep


def _windows(size: int, functions: int, least: int):
    """The windows of each text, with their part in the batch."""
    seeds = [U64((k + 1) * 0xA0761D6478BD642F % 2**64) for k in range(functions)]

    def fn(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        doc_ids = numbers(b, "doc_id")
        data, off = core.text_bytes(column(b, "text"))
        parts: list[list[list[np.ndarray]]] = [[] for _ in seeds]
        for i, j in core.steps(off):
            h, doc, _ = core.shingles(core.Words(data, off[i : j + 1]), size)
            first = np.searchsorted(doc, np.arange(j - i + 1))
            for k, seed in enumerate(seeds):
                v = mix(h ^ seed)
                l, c, r = compact_windows(v, first, least)
                parts[k].append([v[c].view(np.int64), i + doc[c], np.minimum(c - l, least), np.minimum(r - c, least)])
        for k, part in enumerate(parts):
            key, row, left, right = (np.concatenate(x) for x in zip(*part, strict=True))
            if not len(key):
                continue
            # The low bits of a key name its function.
            key = (key & ~np.int64(7)) | np.int64(k)
            order = np.lexsort((row, key))
            order = order[_widest(key[order], row[order], left[order], right[order])]
            key, ids, left, right = key[order], doc_ids[row[order]], left[order], right[order]
            order = np.lexsort((ids, right, left, key))
            key, ids, left, right = key[order], ids[order], left[order], right[order]
            same = np.zeros(len(key) + 1, bool)
            same[1:-1] = (key[1:] == key[:-1]) & (left[1:] == left[:-1]) & (right[1:] == right[:-1])
            role = np.where(same[:-1], OTHER, np.where(same[1:], FIRST, ALONE))
            yield core.batch_of(key=key, doc_id=ids, left=left.astype(np.int32), right=right.astype(np.int32), role=role.astype(np.int32))

    return fn


def sweep(key: np.ndarray, ids: np.ndarray, left: np.ndarray, right: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Extents of windows sorted by key, id, left, right, and the leaders of each.

    Returns the first window of each extent, ascending; the extent of each
    window (a place among these); and ties: places of extents and of the
    leading extents that they belong to.  ``left`` and ``right`` of c count at
    most ``least`` places.
    """
    group = np.cumsum(np.diff(key, prepend=key[:1]) != 0)
    w = least + 1
    _, first, back = np.unique((group * w + left) * w + right, return_index=True, return_inverse=True)
    order = np.argsort(first)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    first, extent = first[order], place[back]
    g, d, l, r = group[first], ids[first], left[first], right[first]
    many = np.bincount(g, minlength=1)
    open_ = np.ones(len(first), bool)
    head = np.full(len(many), -1)
    live = np.flatnonzero(many[g] > 1)
    ties = [(x := np.flatnonzero(many[g] == 1), x)]
    while len(live):
        wait = live[open_[live]]
        head[:] = -1
        at = wait[np.diff(g[wait], prepend=-1) != 0]
        head[g[at]] = at
        # What comes before a leader was settled by earlier ones.
        live = live[(head[g[live]] >= 0) & (live >= head[g[live]])]
        to = head[g[live]]
        fits = (live == to) | ((d[live] != d[to]) & (np.minimum(l[live], l[to]) + np.minimum(r[live], r[to]) >= least))
        ties.append((live[fits], to[fits]))
        open_[live[fits]] = False
    return first, extent, *(np.concatenate([t[k] for t in ties]) for k in range(2))


def _sweep(least: int):
    """Windows sorted by key, id, left, right: links (b set), and the leaders of extents that other windows ask for (b null).

    Of a key that goes on in the next batch only the first window of each
    extent is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for b in batches:
            cols = [numbers(b, n).astype(np.int64) for n in _NAMES]
            if not len(cols[0]):
                continue
            old = 0
            if held is not None and held[0][0] == cols[0][0]:
                old = len(held[0])
                cols = [np.concatenate([x, y]) for x, y in zip(held, cols, strict=True)]
            key, ids, left, right, role = cols
            first, extent, use, to = sweep(key, ids, left, right, least)
            last = first[key[first] == key[-1]]
            held = [x[last] for x in cols]
            # Each window has its extent's leaders.
            order = np.argsort(use, kind="stable")
            use, to = use[order], to[order]
            start, count = np.searchsorted(use, np.arange(len(first))), np.bincount(use, minlength=len(first))
            row = np.arange(old, len(key))
            n = count[extent[row]]
            at = np.repeat(row, n)
            lead = ids[first[to[np.repeat(start[extent[row]], n) + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)]]]
            link = lead != ids[at]
            asked = role[at] == FIRST
            m, k = int(link.sum()), int(asked.sum())
            if m + k:
                at_all = np.concatenate([at[link], at[asked]])
                yield core.batch_of(
                    a=np.concatenate([lead[link], lead[asked]]), b=pa.concat_arrays([pa.array(ids[at[link]]), pa.nulls(k, pa.int64())]),
                    key=key[at_all], left=left[at_all].astype(np.int32), right=right[at_all].astype(np.int32),
                )

    return run


def stretches(s: np.ndarray, e: np.ndarray, pct: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, matched) for marked runs [s, e): the stretches from one run to another that are matched to pct % and that no other such stretch holds."""
    until = np.cumsum(e - s)
    before = until - (e - s)
    # A stretch of runs k to m is matched enough if gain[m] >= loss[k].
    loss, gain = 100 * before - pct * s, 100 * until - pct * e
    best = np.maximum.accumulate(gain[::-1])[::-1]
    far = np.searchsorted(-best, -loss, "right") - 1
    keep = np.diff(np.maximum.accumulate(far), prepend=-1) > 0
    return np.flatnonzero(keep), far[keep], (until[far] - before)[keep]


def runs(hit: np.ndarray, pct: int, least: int) -> list[tuple[int, int, int]]:
    """(start, end, matched) of the stretches from a marked place to a marked one, matched to pct %, of at least ``least`` places.

    All that no other such stretch holds, by start; they may overlap.
    """
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(s):
        return []
    first, last, matched = stretches(s, e, pct)
    ok = e[last] - s[first] >= least
    return list(zip(s[first[ok]].tolist(), e[last[ok]].tolist(), matched[ok].tolist(), strict=True))


class Leader:
    """A leader's shingles, to which those of members are aligned, and what members found of it."""

    def __init__(self, seq: np.ndarray) -> None:
        n = len(seq)
        self.n = n
        self.order = np.argsort(seq, kind="stable")
        self.ranked = seq[self.order]
        #: Ascends, so that a place near another can be looked up among those of one shingle.
        self.key = np.searchsorted(self.ranked, self.ranked) * (n + 1) + self.order
        self.mark = np.zeros(n, bool)
        self.found: list[tuple[int, int]] = []

    def _near(self, want: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the places order[lo:hi] the one nearest to ``want``, and how far it is."""
        k = np.clip(np.searchsorted(self.key, lo * (self.n + 1) + np.clip(want, 0, self.n)), lo, hi - 1)
        x, y = self.order[np.maximum(k - 1, lo)], self.order[k]
        x, y = np.where(abs(x - want) <= abs(y - want), x, y), abs(x - want)
        return x, np.minimum(y, abs(x - want))

    def align(self, own: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of ``own`` that the leader has as well, and where.

        A shingle that the leader has several times goes where the nearest
        shingle with one place, before or behind it, lets it be expected.  A
        few that leave the order which those around them keep are let go.
        """
        lo, hi = np.searchsorted(self.ranked, own), np.searchsorted(self.ranked, own, "right")
        i = np.flatnonzero(hi > lo)
        if not len(i):
            return i, i
        lo, hi = lo[i], hi[i]
        p = self.order[lo].copy()
        many = np.flatnonzero(hi - lo > 1)
        if len(many):
            once = np.flatnonzero(hi - lo == 1)
            shift = p[once] - i[once] if len(once) else np.zeros(1, np.int64)
            at = np.searchsorted(once, many)
            one, far = self._near(i[many] + shift[np.maximum(at - 1, 0)], lo[many], hi[many])
            two, near = self._near(i[many] + shift[np.minimum(at, len(shift) - 1)], lo[many], hi[many])
            p[many] = np.where(far <= near, one, two)
        start = np.flatnonzero(np.concatenate([[True], (np.diff(i) != 1) | (np.diff(p) != 1)]))
        if len(start) > 2:
            end = np.append(start[1:], len(i))
            before, behind = p[end[:-2] - 1], p[start[2:]]
            stray = (end - start)[1:-1] < size
            stray &= (before < behind) & ~((before < p[start[1:-1]]) & (p[end[1:-1] - 1] < behind))
            keep = np.repeat(np.concatenate([[True], ~stray, [True]]), end - start)
            i, p = i[keep], p[keep]
        return i, p

    def passages(self, own: np.ndarray, size: int, pct: int, least: int) -> list[tuple[int, int, int]]:
        """(start, end, matched) in ``own`` of the passages that both texts have; their places here are kept."""
        i, p = self.align(own, size)
        if len(i) * 100 < least * pct:
            return []
        # Columns of the alignment; where the leader's places do not go on, no passage does.
        step = np.where(np.diff(p) > 0, np.maximum(np.diff(i), np.diff(p)), 4 * (len(own) + self.n))
        u = np.concatenate([[0], np.cumsum(step)])
        first = np.flatnonzero(np.concatenate([[True], step != 1]))
        last = np.append(first[1:] - 1, len(u) - 1)
        k, m, matched = stretches(u[first], u[last] + 1, pct)
        a, z = first[k], last[m]
        ok = i[z] - i[a] + 1 >= least
        a, z, matched = a[ok], z[ok], matched[ok]
        for x, y in zip(a.tolist(), z.tolist(), strict=True):
            self.mark[p[x : y + 1]] = True
            self.found.append((int(p[x]), int(p[y]) + 1))
        return list(zip(i[a].tolist(), (i[z] + 1).tolist(), matched.tolist(), strict=True))

    def own_passages(self, least: int) -> list[tuple[int, int, int]]:
        """(start, end, matched) of what members found, overlapping places put together."""
        out: list[list[int]] = []
        for s, e in sorted(self.found):
            if out and s < out[-1][1]:
                out[-1][1] = max(out[-1][1], e)
            else:
                out.append([s, e])
        return [(s, e, int(self.mark[s:e].sum())) for s, e in out if e - s >= least]


def _passages(size: int, pct: int, least: int):
    """Rows sorted by leader, part and role: passages of members found in their leader, and of leaders in their members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: tuple | None = None
        leaders: list[Leader] = []
        out: list[tuple] = []

        def close() -> None:
            for lead in leaders:
                out.extend((group[0], group[0], s, e + size - 1, m / (e - s)) for s, e, m in lead.own_passages(least))

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            out.clear()
            return core.batch_of(doc_id=pa.array(cols[0], pa.int64()), class_id=pa.array(cols[1], pa.int64()), start_word=pa.array(cols[2], pa.int64()), end_word=pa.array(cols[3], pa.int64()), shared=pa.array(cols[4], pa.float64()))

        for b in batches:
            part, a, role, ids = (numbers(b, c).tolist() for c in ("part", "a", "role", "doc_id"))
            data, off = core.text_bytes(column(b, "text"))
            for i, j in core.steps(off):
                h, doc, _ = core.shingles(core.Words(data, off[i : j + 1]), size)
                first = np.searchsorted(doc, np.arange(j - i + 1))
                for k in range(i, j):
                    own = h[first[k - i] : first[k - i + 1]]
                    if (key := (a[k], part[k])) != group:
                        close()
                        group, leaders = key, []
                    if role[k] == 0:
                        leaders.append(Leader(own))
                    elif len(own):
                        for lead in leaders:
                            out.extend((ids[k], a[k], s, e + size - 1, m / (e - s)) for s, e, m in lead.passages(own, size, pct, least))
            if out:
                yield flush()
        close()
        if out:
            yield flush()

    return run


def repeated_passages(docs: DataFrame, passage: int = PASSAGE, pct: int = PCT, size: int = WORDS, functions: int = FUNCTIONS, agree: int = AGREE) -> DataFrame:
    """Find passages of at least ``passage`` words that other documents repeat, exactly or nearly.

    Returns a row for each document and passage: doc_id, class_id (the
    document the passage was matched with; its own id for that document),
    start_word, end_word (exclusive) and the share of the passage's shingles
    that match.  Words are numbered from 0.  Matched shingles stand in the same
    order in both, and both passages are matched to ``pct`` %: pieces that the
    other text scatters make no passage.

    Texts shorter than a passage (empty and null ones too) have none.  Repeats
    inside one document, and between rows of one id, do not count.  A null
    doc_id is one more document.  Of equal windows the smallest doc_id leads.
    Very long texts are taken whole.  An empty table gives no passages.  The
    rows are the same however ``docs`` is partitioned.
    """
    if not 1 <= functions <= 8:
        raise ValueError("between 1 and 8 hash functions")
    spark = docs.sparkSession
    least = passage - size + 1
    texts = core.id_text(docs)
    found = core.stored(core.arrow_map(texts, _windows(size, functions, least), "key long, doc_id long, left int, right int, role int"), "windows")
    dealt = found.where(F.col("role") != OTHER).repartition(core.parts(spark), "key").sortWithinPartitions("key", "doc_id", "left", "right")
    swept = core.stored(dealt.select(*_NAMES).mapInArrow(_sweep(least), "a long, b long, key long, left int, right int"), "swept")
    leaders = swept.where("b IS NULL").select("key", "left", "right", "a").distinct()
    others = found.where(F.col("role") == OTHER).select("key", "left", "right", F.col("doc_id").alias("b")).join(leaders, ["key", "left", "right"]).where("a <> b")
    links = swept.where("b IS NOT NULL").select("a", "b", "key").union(others.select("a", "b", "key"))
    bit = F.expr("shiftleft(1, CAST(key & 7 AS INT))")
    pairs = links.groupBy("a", "b").agg(F.bit_or(bit).alias("bits")).where(F.bit_count("bits") >= agree).select("a", "b")
    pairs = core.stored(pairs, "pairs")
    core.free(found, swept)

    counted = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("parts"))
    members = pairs.join(counted, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("role"), F.col("b").alias("doc_id"))
    leaders = counted.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"), F.col("a").alias("doc_id"))
    picked = core.pick(texts, core.id_filter(spark, pairs.select(F.explode(F.array("a", "b")).alias("id"))))
    sent = picked.join(leaders.union(members), "doc_id").repartition(core.parts(spark), "a", "part").sortWithinPartitions("a", "part", "role")
    schema = "doc_id long, class_id long, start_word long, end_word long, shared double"
    return sent.select("a", "part", "role", "doc_id", "text").mapInArrow(_passages(size, pct, least), schema)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core.give_back_ids(repeated_passages(core.documents(spark, sf_dir).select("doc_id", "text")), "doc_id", "class_id")


QUERIES = {"op8_substring_dedup": op8_substring_dedup}
SQL: dict[str, str] = {}
