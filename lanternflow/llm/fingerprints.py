"""Document fingerprints by improved consistent weighted sampling.

A document is a weighted set: its lower-cased words, each weighing its count.
Sample k takes, for every word, r and c from Gamma(2, 1) and b from U(0, 1),
all fixed by the word and k, and from the weight w

    t = floor(ln w / r + b),   ln a = ln c - r (t - b) - r,

and keeps (word, t) of the least a.  Two documents keep the same pair with a
chance that equals their generalised Jaccard similarity (sum of the smaller
weights / sum of the larger), so the share of equal places estimates it.
The samples of a (word, weight) pair do not depend on the document; they are
computed once for each step's distinct pairs and then only compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternflow.llm import core
from lanternflow.llm.core import U64, column, mix, numbers

SAMPLES = 64
#: Bytes of text in a range of neighbouring ids, about; each range's first row is sent to two places.
RANGE = 4 << 20
#: Ranges at most, about: beyond, they grow with the text, so their starts stay within 16 MB.
RANGES = 1 << 20
#: Bytes of text taken at once.
STEP = 1 << 20
#: Weighted terms whose samples are held at once (8 bytes for each term and sample).
RUN = 1 << 15
#: Ranges of ids that one task streams, where there are over PARTS of them.
STREAM, PARTS = 16, 1024
#: Marks an empty text's samples; no other sample has it.
NONE = 0xFFFF


def _uniforms(h: np.ndarray) -> list[np.ndarray]:
    """Three numbers of (0, 1) from each hash."""
    return [(((h >> U64(s)) & U64(0x1FFFFF)).astype(np.float32) + np.float32(0.5)) * np.float32(2**-21) for s in (43, 22, 1)]


def weighted_samples(term: np.ndarray, weight: np.ndarray, samples: int) -> np.ndarray:
    """For each weighted term and sample, ln a (order kept) in the high half and (term, t) hashed in the low half."""
    out = np.empty((len(term), samples), np.uint64)
    lw = np.log(weight.astype(np.float32))
    for k in range(samples):
        h = mix(term + U64((k + 1) * 0x9E3779B97F4A7C15 % 2**64))
        u1, u2, b = _uniforms(h)
        h = mix(h + U64(0xD1B54A32D192ED03))
        u3, u4, _ = _uniforms(h)
        r, lc = -np.log(u1 * u2), np.log(-np.log(u3 * u4))
        t = np.floor(lw / r + b)
        la = lc - r * (t - b + np.float32(1))
        bits = la.view(np.uint32)
        bits = np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31)).astype(np.uint64)
        tag = (h ^ (t.astype(np.int64).view(np.uint64) * U64(0x9FB21C651E98DF25))) >> U64(32)
        out[:, k] = (bits << U64(32)) | tag
    return out


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the place of each key among them."""
    order = np.argsort(keys)
    s = keys[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    back = np.empty(len(s), np.int64)
    back[order] = np.cumsum(new) - 1
    return s[new], back


def fingerprints(data: np.ndarray, off: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    """A row of 16-bit samples for each text."""
    words = core.Words(data, off)
    n = len(off) - 1
    out = np.full((n, samples), NONE, np.uint16)
    if not len(words.hash):
        return out
    terms, back = _distinct(words.hash)
    key = np.sort(words.doc * len(terms) + back)
    at = np.flatnonzero(np.diff(key, prepend=-1))
    weight = np.diff(np.append(at, len(key)))
    doc, term = np.divmod(key[at], len(terms))
    least = np.empty((n, samples), np.uint64)
    # Long texts: their samples are drawn run by run and only the least are held.
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    stop = np.append(first[1:], len(doc))
    long = stop - first > RUN
    for s, e in zip(first[long].tolist(), stop[long].tolist(), strict=True):
        best = np.full(samples, ~U64(0))
        for i in range(s, e, RUN):
            j = min(i + RUN, e)
            best = np.minimum(best, weighted_samples(terms[term[i:j]], weight[i:j], samples).min(axis=0))
        least[doc[s]] = best
    # The rest: weighted terms of several texts are drawn once, in runs of terms; each run lowers the texts that have them.
    rest = np.repeat(~long, stop - first)
    doc_r, term_r, weight_r = doc[rest], term[rest], weight[rest]
    if len(doc_r):
        top = int(weight_r.max()) + 1
        pair, back = _distinct(term_r * top + weight_r)
        short = doc[first[~long]]
        least[short] = ~U64(0)
        for i in range(0, len(pair), RUN):
            table = weighted_samples(terms[pair[i : i + RUN] // top], pair[i : i + RUN] % top, samples)
            of = np.flatnonzero((back >= i) & (back < i + RUN)) if len(pair) > RUN else np.arange(len(back))
            # Rows gathered at once: a run of the same size, each with whole or parted texts.
            for u in range(0, len(of), RUN):
                own = of[u : u + RUN]
                d = doc_r[own]
                at = np.flatnonzero(np.diff(d, prepend=-1))
                least[d[at]] = np.minimum(least[d[at]], np.minimum.reduceat(table[back[own] - i], at, axis=0))
    full = doc[first]
    got = (least[full] & U64(0xFFFF)).astype(np.uint16)
    got[got == NONE] = NONE - 1
    out[full] = got
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1)


def hexed(prints: np.ndarray) -> list[str]:
    raw = prints.astype(">u2").tobytes().hex()
    w = 4 * prints.shape[1]
    return [raw[i : i + w] for i in range(0, len(raw), w)]


def edited(text: str, following: str) -> str:
    """The text with its later half replaced by as many characters of the next text's beginning."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    off = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(x) for x in raw], out=off[1:])
    return np.frombuffer(b"".join(raw), np.uint8), off


def fingerprint(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """(doc_id, fingerprint) of each row.

    Null or empty text: every place ``ffff``.  Equal texts have equal
    fingerprints; repeated rows are answered each; very long texts are read
    whole; an empty table gives an empty table.
    """

    def fn(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, off = core.text_bytes(column(b, "text"))
        for i, j in core.steps(off, STEP):
            yield core.batch_of(doc_id=numbers(b, "doc_id")[i:j], fingerprint=pa.array(hexed(fingerprints(data, off[i : j + 1], samples))))

    return core.give_back_ids(core.arrow_map(core.id_text(docs), fn, "doc_id long, fingerprint string"))


def _compare(samples: int):
    import hashlib

    def emit(ids: list[int], texts: list[str], following: str) -> pa.RecordBatch:
        new = [edited(t, f) for t, f in zip(texts, [*texts[1:], following], strict=True)]
        n = len(texts)
        prints = fingerprints(*_encode([*texts, following, *new]), samples)
        own, nxt, new_prints = prints[:n], prints[1 : n + 1], prints[n + 1 :]
        return core.batch_of(
            doc_id=np.array(ids, np.int64), n_chars=np.array([len(t) for t in texts], np.int64),
            edited_sha256=pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new]),
            fingerprint=pa.array(hexed(own)), edited_fingerprint=pa.array(hexed(new_prints)),
            near_edited=likeness(own, new_prints), near_next=likeness(own, nxt),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        texts: list[str] = []
        size, now = 0, None
        for b in batches:
            for r, look, i, t in zip(numbers(b, "range").tolist(), numbers(b, "look").tolist(), numbers(b, "doc_id").tolist(), column(b, "text").to_pylist(), strict=True):
                if r != now:
                    assert not ids, "a range has no row after its last"
                    now = r
                if look:
                    if ids:
                        yield emit(ids, texts, t)
                        ids, texts, size = [], [], 0
                    continue
                if size > STEP and ids:
                    yield emit(ids, texts, t)
                    ids, texts, size = [], [], 0
                ids.append(i)
                texts.append(t)
                size += len(t)
        assert not ids, "a range has no row after its last"

    return run


def _starts(room: int):
    """Keys sorted by id and mark, with sizes: the first key, and one whenever about so many bytes have passed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed, last = 0, -1
        for b in batches:
            size = numbers(b, "size").astype(np.int64)
            if not len(size):
                continue
            block = (passed + np.cumsum(size) - size) // room
            yield b.filter(pa.array(np.diff(block, prepend=last) > 0)).select(["doc_id", "mark"])
            passed, last = passed + int(size.sum()), int(block[-1])

    return run


def sort_keys(ids: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Byte strings in the order of (id, mark)."""
    both = (np.stack([ids, marks], axis=1).astype(np.int64) ^ np.int64(-(2**63))).astype(">i8")
    return np.ascontiguousarray(both).view("S16").ravel()


def _ranges(starts):
    """Twice the number of the range that a row falls in, and one more for the range's first key."""

    @F.pandas_udf("long")
    def at(ids: pd.Series, marks: pd.Series) -> pd.Series:
        keys, first = sort_keys(ids.to_numpy(), marks.to_numpy()), starts.value
        k = np.searchsorted(first, keys, "right") - 1
        return pd.Series(2 * k + (first[k] == keys))

    return at


def compare_neighbours(docs: DataFrame, samples: int = SAMPLES, room: int = RANGE) -> DataFrame:
    """Fingerprints of each document, of its edited text, and their likeness.

    The next document is the next row by doc_id (rows of one id by a hash of
    the text); after the last comes the first.  Ids alone are sorted first, to
    cut them to ranges of about ``room`` bytes of text (more, if there would be
    over ``RANGES`` of them).  Then each row goes to
    its range, sorted there by Spark, and streams through; the first row of a
    range also goes to the range before.  What the driver holds is 16 bytes for
    each range.

    Null or empty text: 0 characters, fingerprint of ``ffff`` only; it is like
    another empty text (1.0) and unlike all others (0.0).  A null doc_id sorts
    last.  A single row is its own next one.  Very long texts are a range of
    their own.  Equal samples (ties) cannot be told from each other.  An empty
    table gives an empty table.
    """
    spark = docs.sparkSession
    base = core.id_text(docs).withColumn("mark", F.xxhash64("text"))
    total = base.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    room = max(room, -(-total // RANGES))
    keys = base.select("doc_id", "mark", (F.octet_length("text") + 1).cast("long").alias("size"))
    starts = keys.repartitionByRange("doc_id", "mark").sortWithinPartitions("doc_id", "mark").mapInArrow(_starts(room), "doc_id long, mark long").toArrow()
    first = np.unique(sort_keys(*(starts.column(c).to_numpy() for c in ("doc_id", "mark"))))
    n = max(1, len(first))
    if not len(first):
        first = sort_keys(np.zeros(1, np.int64), np.zeros(1, np.int64))
    rows = base.withColumn("code", _ranges(spark.sparkContext.broadcast(first))("doc_id", "mark"))
    own = F.shiftright("code", 1).cast("int")
    spot = lambda r, look: F.struct(r.alias("range"), F.lit(look).alias("look"))
    before = F.pmod(own - 1, F.lit(n)).cast("int")
    spots = F.when(F.col("code") % 2 == 1, F.array(spot(own, 0), spot(before, 1))).otherwise(F.array(spot(own, 0)))
    sent = rows.withColumn("spot", F.explode(spots)).select("spot.range", "spot.look", "doc_id", "mark", "text")
    parts = min(n, max(PARTS, -(-n // STREAM)))
    dealt = sent.repartitionById(parts, F.pmod("range", F.lit(parts)).cast("int")).sortWithinPartitions("range", "look", "doc_id", "mark")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return core.give_back_ids(dealt.select("range", "look", "doc_id", "text").mapInArrow(_compare(samples), schema))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_neighbours(core.documents(spark, sf_dir).select("doc_id", "text"))


QUERIES = {"op9_fingerprints": op9_fingerprints}
SQL: dict[str, str] = {}
