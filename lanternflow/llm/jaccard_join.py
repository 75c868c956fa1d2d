"""N-gram Jaccard join by prefix lists with set-relation skipping.

A document is its set of 5-word shingles.  The join is exact: two sets link
when ``100 * |x & y| >= pct * |x | y|``.

1. One pass finds shingles that are frequent somewhere (a table of proven size,
   broadcast) and each set's digest.  All sets order their tokens alike: rare
   ones by hash, then the frequent ones by count, so lists of very common
   shingles are hardly ever built.
2. Each distinct set posts its prefix to index lists (token -> set, size,
   position).  If two sets link, they meet in a list.
3. A list is sorted by position.  The set with the earliest one has the fewest
   rare shingles, which makes it the middle of a group of near copies; it leads
   all sets of sizes that it can link with, the rest get a leader of their own.
   Every member is compared with its leader only.
4. Lists whose sets are still in several components are gone through once
   more.  A set that is like its leader is known by what differs, so whether
   two members link is derived from their leader's answers and two short deltas
   (answer-level skipping).  For other pairs, each block of equal sizes is
   skipped from the position on where the rest of the sets is too short
   (index-level skipping), and a pair is skipped if |x & y| <= min(|x & l|,
   |y & l|) + min(|x - l|, |y - l|) is too little.  Only what is left is
   compared.

Before a pair leaves a list and before texts travel to be compared, it must
pass a bound from a few bytes of each set: bits that tell the parity of the
tokens with each low part differ in at most |x - y| + |y - x| places.

No list is expanded into all pairs, and links between equal sets are one per
copy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternflow.llm import core
from lanternflow.llm.components import components
from lanternflow.llm.core import U64, column, numbers

WORDS, PCT = 5, 75
#: The most frequent shingles, at most so many, are ordered behind all others. 16 bytes each.
FREQUENT = 1 << 20
#: Lists up to this length are compared in one step instead of block by block; rows of a product of deltas.
SHORT, RUN = 256, 512
#: A leader with more members than this is sent to several tasks.
MEMBERS = 256
#: Members of a list, and members of a leader with deltas, that a cell of ``_dealt`` takes from each side.
LIST, GROUP = 512, 2_048


def needed(a: np.ndarray, b: np.ndarray, pct: int) -> np.ndarray:
    """The smallest overlap at which sets of these sizes link."""
    return -(-pct * (a + b) // (100 + pct))


def prefix_length(n: np.ndarray, pct: int) -> np.ndarray:
    return np.where(n > 0, n - -(-pct * n // 100) + 1, 0)


def sets_of(data: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles (63 bits) of each text, ascending, and where each text's begin."""
    h, doc, _ = core.shingles(core.Words(data, off), size)
    return core.unique_per_doc(h >> U64(1), doc, len(off) - 1)


def parity_bits(tokens: np.ndarray) -> bytes:
    """For each value of the tokens' low bits, whether an odd number of tokens has it; as many bits as a power of two holds the set."""
    b = 1 << max(6, (len(tokens) - 1).bit_length())
    at = (tokens & U64(b - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=b) & 1).astype(np.uint8), bitorder="little").tobytes()


def parity_gap(a: bytes, b: bytes) -> int:
    """A lower bound of |x - y| + |y - x|: each differing bit needs a token that one set alone has."""
    if len(a) < len(b):
        a, b = b, a
    x, y, n = int.from_bytes(a, "little"), int.from_bytes(b, "little"), 8 * len(a)
    while n > 8 * len(b):
        n >>= 1
        x = (x >> n) ^ (x & ((1 << n) - 1))
    return (x ^ y).bit_count()


def _plausible(pct: int):
    """Pairs that the sizes and parity bits of both sets leave possible."""

    def fn(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        na, nb = numbers(b, "na"), numbers(b, "nb")
        most = (na + nb - 2 * needed(na, nb, pct)).tolist()
        ok = [parity_gap(x, y) <= m for x, y, m in zip(column(b, "pa").to_pylist(), column(b, "pb").to_pylist(), most, strict=True)]
        yield b.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    return fn


def plausible(pairs: DataFrame, sets: DataFrame, pct: int) -> DataFrame:
    """``pairs`` without those that cannot link by sizes and parity bits; ``sets`` has doc_id, n, parity."""
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("doc_id").alias(side), F.col("n").alias(f"n{side}"), F.col("parity").alias(f"p{side}")), side)
    fits = (100 * F.least("na", "nb") >= pct * F.greatest("na", "nb")) & (F.col("na") > 0)
    return core.arrow_map(pairs.where(fits), _plausible(pct), "a long, b long").distinct()


def _census(size: int):
    """Per text: digest and size of its set.  Per batch: shingles frequent in it."""

    def fn(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = numbers(b, "doc_id")
        data, off = core.text_bytes(column(b, "text"))
        every: list[np.ndarray] = []
        n: list[int] = []
        digest: list[bytes] = []
        parity: list[bytes] = []
        for i, j in core.steps(off):
            s, first = sets_of(data, off[i : j + 1], size)
            every.append(s)
            for x, y in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                n.append(y - x)
                digest.append(xxhash.xxh3_128_digest(s[x:y]))
                parity.append(parity_bits(s[x:y]))
        d = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
        s = np.sort(np.concatenate(every))
        at = np.flatnonzero(np.diff(s, prepend=~s[:1])) if len(s) else np.zeros(0, np.int64)
        count = np.diff(np.append(at, len(s)))
        often = count >= max(2, -(-len(s) // FREQUENT))
        k, m = len(ids), int(often.sum())
        none = lambda t, x: pa.nulls(x, t)
        yield pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([pa.array(ids), none(pa.int64(), m)]), pa.concat_arrays([pa.array(n, pa.int64()), none(pa.int64(), m)]),
                pa.concat_arrays([pa.array(d[:, 0].copy()), none(pa.int64(), m)]), pa.concat_arrays([pa.array(d[:, 1].copy()), none(pa.int64(), m)]),
                pa.concat_arrays([pa.array(parity, pa.binary()), none(pa.binary(), m)]),
                pa.concat_arrays([none(pa.int64(), k), pa.array(s[at[often]].view(np.int64))]), pa.concat_arrays([none(pa.int64(), k), pa.array(count[often])]),
            ],
            names=["doc_id", "n", "d1", "d2", "parity", "token", "count"],
        )

    return fn


def _posts(size: int, pct: int, frequent):
    """Prefix entries of each text's set; of equal sets in a batch only the first's."""

    def fn(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = numbers(b, "doc_id")
        data, off = core.text_bytes(column(b, "text"))
        known = frequent.value
        seen: set[bytes] = set()
        for i, j in core.steps(off):
            s, first = sets_of(data, off[i : j + 1], size)
            doc = np.repeat(np.arange(j - i), np.diff(first))
            keep = np.zeros(j - i, bool)
            for k, (x, y) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                d = xxhash.xxh3_128_digest(s[x:y])
                if y > x and d not in seen:
                    seen.add(d)
                    keep[k] = True
            if len(known):
                # Frequent tokens move behind all others, ordered by their rank in the table.
                at = np.minimum(np.searchsorted(known[0], s), len(known[0]) - 1)
                hit = np.flatnonzero(known[0][at] == s)
                s[hit] = known[1][at[hit]] | U64(1 << 63)
                for k in np.unique(doc[hit]):
                    s[first[k] : first[k + 1]].sort()
            n = np.diff(first)
            pos = np.arange(len(s)) - first[:-1][doc]
            take = keep[doc] & (pos < prefix_length(n, pct)[doc])
            yield core.batch_of(token=s[take].view(np.int64), set=ids[i:j][doc[take]], n=n[doc[take]].astype(np.int32), pos=pos[take].astype(np.int32))

    return fn


def _lead(pct: int):
    """Entries sorted by token, position: each with its leader.  Entries alone in their list are dropped.

    Of a list that goes on in the next batch only the leaders are held (or its
    only entry so far), so a list may have any length.  ``many`` is the list's
    length, 3 at least where a batch ends in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        alone = False
        for b in batches:
            cols = [numbers(b, c) for c in ("token", "set", "n", "pos")]
            if not len(cols[0]):
                continue
            fresh = np.ones(len(cols[0]), bool)
            went_on = held is not None and held[0][0] == cols[0][0]
            if went_on:
                fresh = np.append(np.full(len(held[0]), alone), fresh)
                cols = [np.concatenate([x, y]) for x, y in zip(held, cols, strict=True)]
            token, ids, n, pos = cols
            group = np.cumsum(np.diff(token, prepend=token[:1]) != 0)
            many = np.bincount(group)
            lead = np.full(len(token), -1)
            rest = np.arange(len(token))
            while len(rest):
                first = np.diff(group[rest], prepend=-1) != 0
                head = rest[np.flatnonzero(first)][np.cumsum(first) - 1]
                small, large = np.minimum(n[head], n[rest]).astype(np.int64), np.maximum(n[head], n[rest]).astype(np.int64)
                fits = 100 * small >= pct * large
                lead[rest[fits]] = head[fits]
                rest = rest[~fits]
            use = np.flatnonzero(fresh & (many[group] > 1))
            last = np.flatnonzero((group == group[-1]) & (lead == np.arange(len(lead))))
            alone = many[-1] == 1
            held = [x[last] for x in cols]
            many[-1] = max(many[-1], 3)
            if went_on:
                many[0] = max(many[0], 3)
            if len(use):
                yield core.batch_of(token=token[use], set=ids[use], n=n[use], pos=pos[use], lead=ids[lead[use]], lead_n=n[lead[use]], lead_pos=pos[lead[use]], many=many[group[use]].astype(np.int32))

    return run


def _bounded(x, y, n, comp, lead, shared, known, need) -> np.ndarray:
    """Which pairs of places stay: of different components, not settled by their deltas, and able to link."""
    same = lead[x] == lead[y]
    ok = (comp[x] != comp[y]) & ~(same & known[x] & known[y])
    best = np.minimum(shared[x], shared[y]) + np.minimum(n[x] - shared[x], n[y] - shared[y])
    return ok & (~same | (shared[x] < 0) | (shared[y] < 0) | (best >= need))


#: Who meets whom: a home row every guest, a row that is both every other.
HOME, GUEST, BOTH = 0, 1, 2


def _roles(role: np.ndarray, comp: np.ndarray) -> np.ndarray:
    """Where all rows are both, those of the largest component need not meet each other: they are at home."""
    if len(role) < 3 or (role != BOTH).any():
        return role
    comps, back, count = np.unique(comp, return_inverse=True, return_counts=True)
    return np.where(back == np.argmax(count), HOME, BOTH)


def list_pairs(n: np.ndarray, pos: np.ndarray, comp: np.ndarray, lead: np.ndarray, shared: np.ndarray, known: np.ndarray, pct: int, role: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places (x, y) in one list, sorted by size and position, that may link and are in different components.

    shared is each set's overlap with its leader, -1 if unknown.  Pairs of
    ``known`` sets under one leader are left to ``delta_pairs``.  A block is the
    entries of one size; against another size it is skipped from the position
    on where what is left of the set is too short for a link.
    """
    role = _roles(np.full(len(n), BOTH) if role is None else role, comp)
    meet = np.array([[False, True, True], [True, False, False], [True, False, True]])
    if len(n) <= SHORT:
        x, y = np.triu_indices(len(n), 1)
        need = needed(n[x], n[y], pct)
        ok = meet[role[x], role[y]] & (n[x] - pos[x] >= need) & (n[y] - pos[y] >= need) & (100 * n[x] >= pct * n[y])
        x, y, need = x[ok], y[ok], need[ok]
        ok = _bounded(x, y, n, comp, lead, shared, known, need)
        return x[ok], y[ok]
    out_x, out_y = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if known.all() and (lead == lead[0]).all():
        return out_x[0], out_y[0]
    size, start = np.unique(n, return_index=True)
    stop = np.append(start[1:], len(n))
    for k in range(len(size)):
        for j in range(int(np.searchsorted(size, -(-pct * size[k] // 100))), k + 1):
            need = int(needed(size[j], size[k], pct))
            x_all = np.arange(start[j], start[j] + np.searchsorted(pos[start[j] : stop[j]], size[j] - need, "right"))
            y_all = np.arange(start[k], start[k] + np.searchsorted(pos[start[k] : stop[k]], size[k] - need, "right"))
            for r in (HOME, GUEST, BOTH):
                x, y = x_all[role[x_all] == r], y_all[meet[r, role[y_all]]]
                for s in range(0, len(y) if len(x) else 0, RUN):
                    gx, gy = (g.ravel() for g in np.meshgrid(x, y[s : s + RUN], indexing="ij"))
                    if j == k:
                        gx, gy = gx[gx < gy], gy[gx < gy]
                    ok = _bounded(gx, gy, n, comp, lead, shared, known, need)
                    out_x.append(gx[ok])
                    out_y.append(gy[ok])
    return np.concatenate(out_x), np.concatenate(out_y)


def delta_pairs(n: np.ndarray, comp: np.ndarray, deltas: list[np.ndarray], pct: int, role: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places (x, y) of different components that link, for sets known by how they differ from one leader.

    With dx = x ^ l, |x ^ y| = |dx| + |dy| - 2 |dx & dy|, so the overlap follows
    from the deltas.  Only tokens in two deltas or more matter; the counts of
    common ones are a product of matrices, taken in runs of rows.  Deltas are
    32-bit hashes.  The matrices hold how often a delta has a hash, so tokens
    that collide, in one delta or between two, can only raise a product: a
    collision can add a pair, which is compared later, but lose none.
    """
    role = _roles(np.full(len(n), BOTH) if role is None else role, comp)
    size = np.array([len(d) for d in deltas])
    flat = np.concatenate(deltas) if len(deltas) else np.zeros(0, np.uint32)
    _, back, count = np.unique(flat, return_inverse=True, return_counts=True)
    column_of = np.cumsum(count > 1) - 1
    use = count[back] > 1
    width = int((count > 1).sum())
    cell, times = np.unique(np.repeat(np.arange(len(n)), size)[use] * max(width, 1) + column_of[back[use]], return_counts=True)
    row, col = np.divmod(cell, max(width, 1))
    none = np.zeros(0, np.int64)
    out_x, out_y = [none], [none]
    guests, homes = np.flatnonzero(role != HOME), np.flatnonzero(role != GUEST)
    for s in range(0, len(guests), RUN):
        g = guests[s : s + RUN]
        common = np.zeros((len(g), len(homes)), np.float32)
        for c in range(0, width, 4096):
            a = np.zeros((len(n), min(4096, width - c)), np.float32)
            mine = (col >= c) & (col < c + 4096)
            a[row[mine], col[mine] - c] = times[mine]
            common += a[g] @ a[homes].T
        both = (n[g, None] + n[None, homes] - size[g, None] - size[None, homes]) / 2 + common
        x, y = np.nonzero((100 + pct) * both >= pct * (n[g, None] + n[None, homes]) - 1e-6)
        x, y = g[x], homes[y]
        ok = (comp[x] != comp[y]) & ((x < y) | (role[x] != BOTH) | (role[y] != BOTH))
        out_x.append(np.minimum(x[ok], y[ok]))
        out_y.append(np.maximum(x[ok], y[ok]))
    return np.concatenate(out_x), np.concatenate(out_y)


def _second(pct: int):
    """What the cells of lists leave to compare, besides pairs settled by deltas."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in core.whole_groups(batches, "cell"):
            cell, ids, n, pos, comp, lead, shared, known, role = (numbers(table, c) for c in ("cell", "set", "n", "pos", "comp", "lead", "shared", "known", "role"))
            n, pos, known = n.astype(np.int64), pos.astype(np.int64), known.astype(bool)
            parity = column(table, "parity")
            found: list[np.ndarray] = []
            cut = np.flatnonzero(np.diff(cell, prepend=cell[:1] - 1))
            for s, e in zip(cut.tolist(), [*cut[1:].tolist(), len(cell)], strict=True):
                x, y = list_pairs(n[s:e], pos[s:e], comp[s:e], lead[s:e], shared[s:e], known[s:e], pct, role[s:e])
                if len(x):
                    bits = parity.slice(s, e - s).to_pylist()
                    most = n[s:e][x] + n[s:e][y] - 2 * needed(n[s:e][x], n[s:e][y], pct)
                    ok = [parity_gap(bits[i], bits[j]) <= m for i, j, m in zip(x.tolist(), y.tolist(), most.tolist(), strict=True)]
                    found.append(np.stack([ids[s:e][x[ok]], ids[s:e][y[ok]]], axis=1))
            yield from _pairs(found)

    return run


def _by_deltas(pct: int):
    """Members of one leader that link by their deltas and are in different components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in core.whole_groups(batches, "cell"):
            cell, ids, n, comp, role = (numbers(table, c) for c in ("cell", "set", "n", "comp", "role"))
            delta = column(table, "delta")
            cut = np.flatnonzero(np.diff(cell, prepend=cell[:1] - 1))
            for s, e in zip(cut.tolist(), [*cut[1:].tolist(), len(cell)], strict=True):
                x, y = delta_pairs(n[s:e].astype(np.int64), comp[s:e], [np.frombuffer(delta[k].as_buffer(), np.uint32) for k in range(s, e)], pct, role[s:e])
                yield from _pairs([np.stack([ids[s:e][x], ids[s:e][y]], axis=1)])

    return run


def _pairs(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    pair = np.sort(np.concatenate(found), axis=1) if found else np.zeros((0, 2), np.int64)
    if len(pair):
        pair = np.unique(pair, axis=0)
        yield core.batch_of(a=pair[:, 0].copy(), b=pair[:, 1].copy())


def _verify(size: int, pct: int):
    """Rows sorted by leader group and role: each member's overlap with its leader, and how it differs if that is little."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, leaders = None, []
        for b in batches:
            part, a, role, ids = (numbers(b, c) for c in ("part", "a", "role", "doc_id"))
            data, off = core.text_bytes(column(b, "text"))
            out: list[tuple[int, int, int, bool, bytes | None]] = []
            for i, j in core.steps(off):
                s, first = sets_of(data, off[i : j + 1], size)
                for k in range(i, j):
                    own = s[first[k - i] : first[k - i + 1]]
                    if (key := (a[k], part[k])) != group:
                        group, leaders = key, []
                    if role[k] == 0:
                        leaders.append(own.copy())
                        continue
                    for x in leaders:
                        low, high = (own, x) if len(own) < len(x) else (x, own)
                        at = np.minimum(np.searchsorted(high, low), max(len(high) - 1, 0))
                        both = int((high[at] == low).sum()) if len(high) else 0
                        gap = len(own) + len(x) - 2 * both
                        delta = (np.setxor1d(own, x, True) & U64(0xFFFFFFFF)).astype(np.uint32).tobytes() if 3 * gap <= len(own) + len(x) else None
                        out.append((int(a[k]), int(ids[k]), both, 100 * both >= pct * (both + gap), delta))
            if out:
                va, vb, vo, vl, vd = zip(*out, strict=True)
                yield core.batch_of(a=pa.array(va, pa.int64()), b=pa.array(vb, pa.int64()), shared=pa.array(vo, pa.int64()), linked=pa.array(vl), delta=pa.array(vd, pa.binary()))

    return run


def compare_pairs(docs: DataFrame, pairs: DataFrame, size: int, pct: int) -> DataFrame:
    """(a, b, shared, linked) for the id pairs; ``docs`` has doc_id and text.

    Members travel to their leader a.  A leader of many members is copied to
    several parts, so no part grows with its group.
    """
    spark = docs.sparkSession
    counted = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("parts"))
    members = pairs.join(counted, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("role"), F.col("b").alias("doc_id"))
    leaders = counted.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"), F.col("a").alias("doc_id"))
    asked = leaders.union(members)
    texts = core.pick(docs, core.id_filter(spark, pairs.select(F.explode(F.array("a", "b")).alias("id"))))
    sent = texts.join(asked, "doc_id").repartition(core.parts(spark), "a", "part").sortWithinPartitions("a", "part", "role")
    return sent.select("a", "part", "role", "doc_id", "text").mapInArrow(_verify(size, pct), "a long, b long, shared long, linked boolean, delta binary")


def frequent_table(rows: DataFrame, floor: int = 8) -> tuple[np.ndarray, np.ndarray] | tuple:
    """The most frequent tokens, ascending, with their rank by count: at most ``FREQUENT``.

    A histogram of counts (four bins to a doubling) gives the least count that
    keeps the table within its bound, so only the table itself is collected.
    """
    t = rows.where("token IS NOT NULL").groupBy("token").agg(F.sum("count").alias("count")).where(F.col("count") >= floor)
    bins = t.groupBy(F.floor(4 * F.log2("count")).alias("k")).agg(F.count("*").alias("n")).orderBy(F.desc("k")).collect()
    total = 0
    for r in bins:
        total += r["n"]
        if total > FREQUENT:
            floor = max(floor, int(2 ** ((r["k"] + 1) / 4)) + 1)
            break
    t = t.where(F.col("count") >= floor).toArrow()
    token, count = t.column("token").to_numpy().view(np.uint64), t.column("count").to_numpy()
    if not len(token):
        return ()
    rank = np.empty(len(token), np.uint64)
    rank[np.lexsort((token, count))] = np.arange(len(token), dtype=np.uint64)
    order = np.argsort(token)
    return token[order], rank[order]


def jaccard_components(docs: DataFrame, pct: int = PCT, size: int = WORDS) -> DataFrame:
    """Link documents whose shingle sets have a Jaccard similarity of pct % or more.

    Returns doc_id (null ids as ``core.NULL_ID``), n_shingles and component_id,
    the smallest doc_id that links reach.  A text with fewer words than a
    shingle is one shingle; without words (empty, null) it has none and links
    with nothing.  Repeated rows of one id share its component.  Very long
    texts are taken whole.  An empty table gives an empty table.
    """
    spark = docs.sparkSession
    texts = core.id_text(docs)
    census = core.stored(core.arrow_map(texts, _census(size), "doc_id long, n long, d1 long, d2 long, parity binary, token long, count long"), "census")
    rows = census.where("token IS NULL")
    frequent = spark.sparkContext.broadcast(frequent_table(census))

    entries = core.arrow_map(texts, _posts(size, pct, frequent), "token long, set long, n int, pos int")
    dealt = entries.repartition(core.parts(spark), "token").sortWithinPartitions("token", "pos", "n", "set")
    lists = core.stored(dealt.mapInArrow(_lead(pct), "token long, set long, n int, pos int, lead long, lead_n int, lead_pos int, many int"), "lists")

    same = core.stored(_copies(rows), "copies")

    need = F.ceil(F.lit(pct) * (F.col("n") + F.col("lead_n")) / F.lit(100 + pct))
    near = (F.col("n") - F.col("pos") >= need) & (F.col("lead_n") - F.col("lead_pos") >= need)
    first = lists.where((F.col("set") != F.col("lead")) & near).select(F.col("lead").alias("a"), F.col("set").alias("b")).distinct()
    asked = core.stored(plausible(_without_copies(first, same), rows, pct), "pairs")
    first = core.stored(compare_pairs(texts, asked, size, pct), "links")
    links = first.where("linked").select("a", "b").union(same)
    stars = components(links)

    comp = stars.select(F.col("a").alias("set"), F.col("b").alias("comp"))
    known = core.stored(first.groupBy(F.col("a").alias("lead"), F.col("b").alias("set")).agg(F.max(F.struct("shared", "delta")).alias("x")).select("lead", "set", "x.*"), "known")
    derived = _derived(known, rows, comp, pct)
    left = lists.where("many > 2").join(comp, "set", "left").withColumn("comp", F.coalesce("comp", "set"))
    left = _dealt(left.select("token", "set", "pos", "n", "comp", "lead"), "token", LIST)
    left = left.join(known.select("lead", "set", "shared", F.col("delta").isNotNull().alias("known")), ["lead", "set"], "left")
    own = F.col("set") == F.col("lead")
    left = left.withColumns({"shared": F.when(own, F.col("n").cast("long")).otherwise(F.coalesce("shared", F.lit(-1))), "known": own | F.coalesce("known", F.lit(False))})
    left = left.join(rows.select(F.col("doc_id").alias("set"), F.col("n").cast("int").alias("n"), "parity").distinct(), ["set", "n"])
    left = left.repartition(core.parts(spark), "cell").sortWithinPartitions("cell", "n", "pos", "set", "role")
    second = left.select("cell", "set", "n", "pos", "comp", "lead", "shared", "known", "parity", "role").mapInArrow(_second(pct), "a long, b long").union(derived).distinct()
    done = first.select("a", "b").union(first.select("b", "a"))
    second = core.stored(plausible(second.join(done, ["a", "b"], "left_anti"), rows, pct), "pairs")
    core.free(lists, asked, known)
    more = core.stored(compare_pairs(texts, second, size, pct).where("linked").select("a", "b"), "links")
    if not more.isEmpty():
        stars = components(stars.union(more))
    core.free(first, same, second, more)
    out = rows.join(stars.select(F.col("a").alias("doc_id"), F.col("b").alias("component_id")), "doc_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _copies(rows: DataFrame) -> DataFrame:
    """(a, b): each document with an equal set in one of smaller id, and the smallest such id.

    Copies are counted and found again by digest and a salt, so a group of very
    many copies is spread over the tasks.
    """
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(core.parts(rows.sparkSession))).cast("int")
    own = rows.where("n > 0").select("doc_id", "d1", "d2", salt.alias("salt"))
    each = own.groupBy("d1", "d2", "salt").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("top"))
    least = each.groupBy("d1", "d2").agg(F.min("low").alias("b"), F.max("top").alias("top")).where("b < top").drop("top")
    spots = each.select("d1", "d2", "salt").join(least, ["d1", "d2"])
    return own.join(spots, ["d1", "d2", "salt"]).where("doc_id <> b").select(F.col("doc_id").alias("a"), "b").distinct()


def _dealt(rows: DataFrame, key: str, most: int) -> DataFrame:
    """The members (set, comp) of groups with several components, dealt to cells in which all pairs of different components meet.

    A group of up to ``most`` members is one cell.  In a larger one, members of
    the largest component are only at home, in one of its parts by their hash;
    the others are also guests of every part, in cells of their own, so a cell
    has about ``most`` home rows and as many guests whatever the group's size.
    """
    sizes = rows.groupBy(key).agg(F.count("*").alias("k"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select(key, "k")
    each = rows.join(sizes.where(F.col("k") > most).select(key), key, "left_semi").groupBy(key, "comp").agg(F.count("*").alias("m"))
    major = each.groupBy(key).agg(F.max(F.struct("m", "comp")).alias("x")).select(key, F.col("x.comp").alias("major"), "x.m")
    number = lambda x: F.greatest(F.lit(1), F.ceil(x / F.lit(most))).cast("int")
    sizes = sizes.join(major, key, "left").select(key, "major", number(F.col("k")).alias("homes"), number(F.col("k") - F.coalesce("m", "k")).alias("guests"))
    spot = lambda i, j, role: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(role).alias("role"))
    own, visit = (F.pmod(F.xxhash64("set", F.lit(seed)), F.col(c)) for seed, c in ((1, "homes"), (2, "guests")))
    home = F.transform(F.sequence(F.lit(0), F.col("guests") - 1), lambda j: spot(own, j, HOME))
    guest = F.transform(F.sequence(F.lit(0), F.col("homes") - 1), lambda i: spot(i, visit, GUEST))
    spots = F.when(F.col("major").isNull(), F.array(spot(F.lit(0), F.lit(0), BOTH))).when(F.col("comp") == F.col("major"), home).otherwise(F.concat(home, guest))
    dealt = rows.join(sizes, key).withColumn("spot", F.explode(spots))
    cell = F.when(F.col("major").isNull(), F.col(key)).otherwise(F.xxhash64(key, "spot.i", "spot.j"))
    return dealt.withColumns({"cell": cell, "role": F.col("spot.role")}).drop("spot", "major", "homes", "guests")


def _derived(known: DataFrame, rows: DataFrame, comp: DataFrame, pct: int) -> DataFrame:
    """Pairs that link by their deltas from a common leader."""
    sizes = rows.groupBy(F.col("doc_id").alias("set")).agg(F.max("n").alias("n"))
    members = known.where("delta IS NOT NULL").select("lead", "set", "delta")
    members = members.union(members.select("lead", F.col("lead").alias("set"), F.lit(b"").alias("delta")).distinct())
    members = members.join(sizes, "set").join(comp, "set", "left").withColumn("comp", F.coalesce("comp", "set"))
    dealt = _dealt(members, "lead", GROUP).repartition(core.parts(known.sparkSession), "cell").sortWithinPartitions("cell", "set", "role")
    return dealt.select("cell", "set", "n", "comp", "delta", "role").mapInArrow(_by_deltas(pct), "a long, b long")


def _without_copies(pairs: DataFrame, same: DataFrame) -> DataFrame:
    """Pairs between the first documents of their copies; pairs of copies are known to link already."""
    for c in ("a", "b"):
        to = same.select(F.col("a").alias(c), F.col("b").alias("to"))
        pairs = pairs.join(to, c, "left").withColumn(c, F.coalesce("to", c)).drop("to")
    return pairs.where("a <> b").distinct()


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest doc_id (all rows of that id).

    Null and empty texts link with nothing, so all of them stay; a null doc_id
    stays unless it is like another document.  An empty table gives an empty one.
    """
    gone = jaccard_components(docs, **options).where("component_id < doc_id").select("doc_id").distinct()
    return core.like(core.with_rest(docs).join(gone, "doc_id", "left_anti"), docs)


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core.give_back_ids(jaccard_components(core.documents(spark, sf_dir).select("doc_id", "text")), "doc_id", "component_id")


OP1_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) END AS s FROM words
), flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS root, doc_id AS v FROM documents
  UNION
  SELECT root, b FROM reach JOIN links ON v = a
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.component_id
FROM sets s JOIN (SELECT v AS doc_id, min(root) AS component_id FROM reach GROUP BY v) r USING (doc_id)
"""
QUERIES = {"op1_jaccard_join": op1_jaccard_join}
SQL = {"op1_jaccard_join": OP1_SQL}
