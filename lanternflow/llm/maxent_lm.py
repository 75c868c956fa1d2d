"""LM scoring by a hashed maximum-entropy model with class-factored softmax.

A word's class is given by digits: a class, a class within it, and so on for
``LEVELS`` levels of ``FAN`` each, all read from the word's hash; few words share
all digits.  Each digit has a softmax of its own,

    P(w | history) = prod_k P(digit_k | digits before, history) * P(w | all digits),

so the history tells apart classes and, inside a class, the words of it.  The
features of each softmax are hashed: the word before, the two words before, and
(for the first two digits) the word before that one alone, a skip feature, each
taken together with the digits so far.  A softmax starts from the digits' shares in the corpus; the last
factor is the word's smoothed share among the words of its digits.

Tokens are packed to blocks (each with its own vocabulary, by hash) once and
stored.  Slices of the vocabularies are added up by hash range and only counts
are sent back to each block, so no vocabulary is ever broadcast.  Training
passes over the blocks: each partition takes gradient steps on its own tokens
from the common weights; the partitions' weights are averaged row by row,
weighted by how much gradient each has seen.  Only the model, whose size is
fixed, is broadcast or collected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternflow.llm import core
from lanternflow.llm.core import U64, column, mix, numbers

BITS, LEVELS = 4, 4
FAN, LEAVES = 1 << BITS, 1 << (BITS * LEVELS)
#: Hashed rows of ``FAN`` weights for each level: 17 MB in all.
BUCKETS = 1 << 16
#: Features of the history that each level has, of those that ``histories`` gives.
FEATURES = (3, 3, 2, 2)
#: Most slices that the weights are averaged in; there is one for every two training tasks.
SLICES = 4096
#: Tokens of a block, of a gradient step, and of a training task at least (each sends a model); vocabulary entries of a part.
BLOCK, STEP, TASK, PART = 1_000_000, 4096, 2_500_000, 1 << 19
ROUNDS, RATE = 2, 0.5
SMOOTH = 0.1
END = np.uint64(0x5EED0E11D0C5A11D)
_COLUMNS = {"doc_id": np.int64, "held": np.uint8, "first": np.int64, "vocab": np.uint64, "train": np.uint32, "tokens": np.uint32}
BLOCKS_SCHEMA = "block long, size long, length long, " + ", ".join(f"{c} binary" for c in _COLUMNS)


def held_out(folds: int = 10) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(False))


def squeeze(x: np.ndarray) -> bytes:
    """The bytes of an array, the first of all values, then the second and so on, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.dtype.itemsize).T).tobytes())


def unsqueeze(raw: memoryview | bytes, kind: type) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(raw)), np.uint8)
    return np.ascontiguousarray(flat.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _pack(n_block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        made = TaskContext.get().partitionId() << 32
        wait: list[tuple] = []
        for b in batches:
            ids, held = numbers(b, "doc_id"), numbers(b, "held").astype(np.uint8)
            data, off = core.text_bytes(column(b, "text"))
            for i, j in core.steps(off):
                words = core.Words(data, off[i : j + 1])
                wait.append((ids[i:j], held[i:j], words.count + 1, np.insert(words.hash, words.first[1:], END)))
                if sum(len(x[3]) for x in wait) >= n_block:
                    yield _block(made, wait)
                    made, wait = made + 1, []
        if wait:
            yield _block(made, wait)

    return run


def _block(number: int, wait: list[tuple]) -> pa.RecordBatch:
    ids, held, count, h = (np.concatenate(x) for x in zip(*wait, strict=True))
    vocab, tokens = np.unique(h, return_inverse=True)
    train = np.bincount(tokens, np.repeat(held == 0, count), len(vocab)).astype(np.uint32)
    cols = {"doc_id": ids, "held": held, "first": np.append(0, np.cumsum(count)), "vocab": vocab, "train": train, "tokens": tokens.astype(np.uint32)}
    return pa.RecordBatch.from_arrays(
        [pa.array([x], pa.int64()) for x in (number, len(vocab), len(tokens))] + [pa.array([squeeze(cols[c].astype(kind))], pa.binary()) for c, kind in _COLUMNS.items()],
        names=["block", "size", "length", *_COLUMNS],
    )


class Block:
    """Texts as tokens: places in the block's own vocabulary, which is sorted by hash."""

    def __init__(self, **columns: np.ndarray) -> None:
        self.doc_id, self.held, self.first, self.vocab, self.train, self.tokens = (columns.get(c) for c in _COLUMNS)

    @staticmethod
    def each(b: pa.RecordBatch | pa.Table, *only: str) -> Iterator[Block]:
        for i in range(b.num_rows):
            yield Block(**{c: unsqueeze(b.column(c)[i].as_buffer(), _COLUMNS[c]) for c in only or _COLUMNS})


def leaf(h: np.ndarray) -> np.ndarray:
    """All digits of a word as one number: the highest bits of its hash."""
    return (h >> U64(64 - BITS * LEVELS)).astype(np.int64)


def histories(block: Block, at: np.ndarray) -> np.ndarray:
    """Three hashes for the history of each token ``at``; a text's first words see a mark for its beginning."""
    h = block.vocab[block.tokens]
    one, two = np.roll(h, 1), np.roll(h, 2)
    first = block.first[:-1]
    second = first[np.diff(block.first) > 1] + 1
    one[first] = two[first] = two[second] = END
    one, two = one[at], two[at]
    return np.stack([mix(one + U64(1)), mix(mix(one + U64(2)) + two), mix(two + U64(3))])


@dataclass(frozen=True)
class Model:
    """Weights of each level's hashed rows, and the logits that digits start from by the digits before."""

    weights: np.ndarray  # levels, buckets, fan
    start: tuple[np.ndarray, ...]  # for each level: digits before, fan

    @staticmethod
    def of(mass: np.ndarray) -> Model:
        """The untrained model: each digit has its share of the leaves' counts."""
        start = []
        for k in range(LEVELS):
            m = mass.reshape(FAN ** (k + 1), -1).sum(axis=1).reshape(-1, FAN) + 0.5
            start.append(np.log(m / m.sum(axis=1, keepdims=True)).astype(np.float32))
        return Model(np.zeros((LEVELS, BUCKETS, FAN), np.float32), tuple(start))

    def softmax(self, k: int, hist: np.ndarray, before: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """For a run of histories and digits before: feature rows, logits x (kept where exp neither overflows nor vanishes), exp(x), its sums."""
        node = before.astype(np.uint64) * U64(0x9E3779B97F4A7C15) + U64(k)
        rows = [(((f ^ node) * U64(0xD6E8FEB86659FD93)) >> U64(48)).astype(np.uint16) for f in hist[: FEATURES[k]]]
        w = self.weights[k]
        x = np.take(self.start[k], before, axis=0)
        own = np.empty_like(x)
        for r in rows:
            x += np.take(w, r, axis=0, out=own, mode="clip")  # a row is below BUCKETS; any other mode copies
        np.clip(x, -30, 30, out=x)
        e = np.exp(x)
        return rows, x, e, e @ _ONES

    def log_likelihood(self, hist: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Log-probability of each leaf after its history."""
        out = np.zeros(len(word), np.float64)
        at = np.arange(len(word))
        for k in range(LEVELS):
            before, digit = word >> (BITS * (LEVELS - k)), (word >> (BITS * (LEVELS - 1 - k))) & (FAN - 1)
            _, x, _, z = self.softmax(k, hist, before)
            out += x[at, digit] - np.log(z)
        return out

    def step(self, square: np.ndarray, hist: np.ndarray, word: np.ndarray, rate: float) -> None:
        """One gradient step on a run of tokens; the weights and ``square`` change in place."""
        at = np.arange(len(word))
        for k in range(LEVELS):
            before, digit = word >> (BITS * (LEVELS - k)), (word >> (BITS * (LEVELS - 1 - k))) & (FAN - 1)
            rows, _, g, z = self.softmax(k, hist, before)
            g /= z[:, None]
            g.reshape(-1)[at * FAN + digit] -= 1
            w, seen = self.weights[k], square[k]
            for r in rows:
                use, total = sum_by_row(g, r)
                grown = np.take(seen, use) + np.einsum("ij,ij->i", total, total)
                seen[use] = grown
                total *= (rate / np.sqrt(grown + 1))[:, None]
                now = np.take(w, use, axis=0)
                now -= total
                put_rows(w, use, now)


def sum_by_row(g: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows in ``r``, sorted, and the sum of ``g`` over each; most occur once, and only the others are added up."""
    order = np.argsort(r, kind="stable")
    own = np.take(r, order)
    new = np.ones(len(own), bool)
    new[1:] = own[1:] != own[:-1]
    cut = np.flatnonzero(new)
    size = np.empty(len(cut), np.int64)
    np.subtract(cut[1:], cut[:-1], out=size[:-1])
    size[-1:] = len(own) - cut[-1:]
    total = np.take(g, np.take(order, cut), axis=0)
    more = np.flatnonzero(size > 1)
    if len(more):
        n = size[more]
        first = np.cumsum(n) - n
        places = np.repeat(cut[more] - first, n) + np.arange(n.sum())
        put_rows(total, more, np.add.reduceat(np.take(g, order[places], axis=0), first, axis=0))
    return np.take(own, cut).astype(np.intp), total


def put_rows(w: np.ndarray, use: np.ndarray, rows: np.ndarray) -> None:
    """``w[use] = rows``, each row as one value of its bytes, which NumPy stores far faster than rows of a matrix."""
    whole = np.dtype((np.void, w.shape[1] * w.itemsize))
    np.put(w.view(whole), use, rows.view(whole))


def aligned(w: np.ndarray) -> np.ndarray:
    """A copy whose rows of ``FAN`` begin at cache lines, so that reading one touches one line and not two."""
    raw = np.empty(w.nbytes + 64, np.uint8)
    first = -raw.ctypes.data % 64
    out = raw[first : first + w.nbytes].view(w.dtype).reshape(w.shape)
    out[...] = w
    return out


_ONES = np.ones(FAN, np.float32)


def train_on(model: Model, square: np.ndarray, block: Block, turn: int, rounds: int, rate: float = RATE) -> int:
    """Gradient steps over the training texts whose turn it is.  Returns the tokens used."""
    count = np.diff(block.first)
    mine = (block.held == 0) & (np.arange(len(count)) % rounds == turn)
    at = np.flatnonzero(np.repeat(mine, count))
    hist, word = histories(block, at), leaf(block.vocab)[block.tokens[at]]
    for s in range(0, len(at), STEP):
        model.step(square, hist[:, s : s + STEP], word[s : s + STEP], rate)
    return len(at)


def _train(model, turn: int, rounds: int, slices: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(aligned(model.value.weights), model.value.start)
        square, used = np.zeros((LEVELS, BUCKETS), np.float32), 0
        for b in batches:
            for block in Block.each(b, "held", "first", "vocab", "tokens"):
                used += train_on(own, square, block, turn, rounds)
        if used:
            w, q = (np.array_split(x.reshape(LEVELS * BUCKETS, -1).astype(np.float16), slices) for x in (own.weights, np.sqrt(square)))
            yield core.batch_of(slice=np.arange(slices, dtype=np.int32), n=np.full(slices, used, np.int64), w=pa.array([x.tobytes() for x in w], pa.binary()), q=pa.array([x.tobytes() for x in q], pa.binary()))

    return run


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weighted mean of each slice's rows; one slice's sum is held at a time."""
    now, total, weight = None, None, None

    def done() -> pa.RecordBatch:
        return core.batch_of(slice=pa.array([now], pa.int32()), w=pa.array([(total / weight).astype(np.float32).tobytes()], pa.binary()))

    for b in batches:
        for s, w, q in zip(numbers(b, "slice").tolist(), column(b, "w"), column(b, "q"), strict=True):
            if s != now:
                if now is not None:
                    yield done()
                now, total, weight = s, 0.0, 0.0
            # Rows that no task has used keep their weights.
            use = np.frombuffer(q.as_buffer(), np.float16).astype(np.float64)[:, None] ** 2 + 1e-6
            total, weight = total + use * np.frombuffer(w.as_buffer(), np.float16).reshape(-1, FAN), weight + use
    if now is not None:
        yield done()


def _parts(parts: int):
    """Each block's vocabulary, cut by hash range."""
    edges = np.array([(p << 64) // parts for p in range(1, parts)], np.uint64)

    def fn(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for number, block in zip(numbers(b, "block").tolist(), Block.each(b, "vocab", "train"), strict=True):
            cut = [0, *np.searchsorted(block.vocab, edges).tolist(), len(block.vocab)]
            part = [p for p in range(parts) if cut[p] < cut[p + 1]]
            yield core.batch_of(
                part=np.array(part, np.int32), block=np.full(len(part), number, np.int64),
                h=pa.array([block.vocab[cut[p] : cut[p + 1]].tobytes() for p in part], pa.binary()), n=pa.array([block.train[cut[p] : cut[p + 1]].tobytes() for p in part], pa.binary()),
            )

    return fn


_COUNTS = "part int, block long, c binary, leaf long, mass long, room long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part: the words' totals for each block's slice, and (block null) each leaf's total and number of known words."""
    for b in core.whole_groups(batches, "part"):
        part = numbers(b, "part")
        cut = np.flatnonzero(np.diff(part, prepend=part[:1] - 1))
        for s, e in zip(cut.tolist(), [*cut[1:].tolist(), len(part)], strict=True):
            h = [np.frombuffer(x.as_buffer(), np.uint64) for x in column(b, "h")[s:e]]
            n = [np.frombuffer(x.as_buffer(), np.uint32) for x in column(b, "n")[s:e]]
            words, back = np.unique(np.concatenate(h), return_inverse=True)
            c = np.bincount(back, np.concatenate(n), len(words)).astype(np.int64)
            known, at = np.unique(leaf(words), return_inverse=True)
            mass, room = np.bincount(at, c).astype(np.int64), np.bincount(at, c > 0).astype(np.int64)
            own = np.split(c[back], np.cumsum([len(x) for x in h])[:-1])
            k, m = e - s, len(known)
            none = lambda x, t=pa.int64(): pa.nulls(x, t)
            yield core.batch_of(
                part=np.full(k + m, part[s], np.int32), block=pa.concat_arrays([pa.array(numbers(b, "block")[s:e]), none(m)]), c=pa.concat_arrays([pa.array([squeeze(x) for x in own], pa.binary()), none(m, pa.binary())]),
                leaf=pa.concat_arrays([none(k), pa.array(known)]), mass=pa.concat_arrays([none(k), pa.array(mass)]), room=pa.concat_arrays([none(k), pa.array(room)]),
            )


def _scorer(model, mass: np.ndarray, room: np.ndarray):
    total, kinds = int(mass.sum()), int(room.sum())

    def fn(key: tuple, blocks: pa.Table, counts: pa.Table) -> pa.Table:
        out = []
        own = Model(aligned(model.value.weights), model.value.start)
        order = np.argsort(counts.column("part").to_numpy())
        c = np.concatenate([unsqueeze(counts.column("c")[i].as_buffer(), np.int64) for i in order.tolist()]).astype(np.float64)
        for block in Block.each(blocks.combine_chunks()):
            word = leaf(block.vocab)
            inside = np.log10((c + SMOOTH) / (mass[word] + SMOOTH * (room[word] + 1)))
            plain = np.log10((c + SMOOTH) / (total + SMOOTH * (kinds + 1)))
            y = word[block.tokens]
            score = inside[block.tokens]
            for s in range(0, len(y), BLOCK):
                e = min(s + BLOCK, len(y))
                hist = histories(block, np.arange(s, e))
                for i in range(s, e, STEP):
                    j = min(i + STEP, e)
                    score[i:j] += own.log_likelihood(hist[:, i - s : j - s], y[i:j]) / np.log(10)
            add = lambda v, cut=block.first[:-1]: np.add.reduceat(v, cut)
            out.append(pa.table({
                "doc_id": block.doc_id, "held_out": block.held.astype(bool), "n_tokens": np.diff(block.first), "n_known": add((c > 0).astype(np.int64)[block.tokens]),
                "train_tokens": np.full(len(block.doc_id), total, np.int64), "base_score": add(plain[block.tokens]), "score": add(score),
            }))
        return pa.concat_tables(out)

    return fn


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_documents(docs: DataFrame, rounds: int = ROUNDS, folds: int = 10) -> DataFrame:
    """Train on texts outside fold 0 and score all.

    Returns doc_id, held_out, n_tokens (words and one end), n_known (tokens seen
    in training), train_tokens, base_score (smoothed unigrams) and score, both
    log10.  Training goes over each text once, in ``rounds`` rounds; the weights
    are the same for the same files and splits, and differ a little with how
    the table is cut.  Null or empty text: the end alone.  A null doc_id is in
    training.  Repeated rows count and score each.  Very long texts stay whole,
    in a block of their own if need be.  An empty table gives an empty table;
    with no training text every count is 0 and all digits stay alike.
    """
    spark = docs.sparkSession
    texts = core.id_text(docs).select("doc_id", ((F.col("doc_id") != core.NULL_ID) & held_out(folds)).alias("held"), "text")
    blocks = core.stored(texts.mapInArrow(_pack(BLOCK), BLOCKS_SCHEMA), "blocks", per_file=8)
    n_blocks, size, length = blocks.agg(F.count("*"), F.sum("size"), F.sum("length")).first()

    # Parts of about equal size; as a power of two they share no leaf.
    parts = 1 << min(BITS * LEVELS, max(0, ((size or 0) // PART).bit_length()))
    slices = core.arrow_map(blocks.select("block", "vocab", "train"), _parts(parts), "part int, block long, h binary, n binary")
    counts = core.stored(slices.repartition(parts, "part").sortWithinPartitions("part", "block").mapInArrow(_count, _COUNTS), "counts")
    mass, room = np.zeros(LEAVES), np.zeros(LEAVES)
    for r in counts.where("block IS NULL").select("leaf", "mass", "room").collect():
        mass[r["leaf"]], room[r["leaf"]] = r["mass"], r["room"]

    trainers = max(1, -(-(length or 0) // TASK))
    n_slices = min(SLICES, max(16, trainers // 2))
    model = Model.of(mass)
    for turn in range(rounds):
        sent = spark.sparkContext.broadcast(model)
        # Small files make large training tasks, so that what the tasks send stays in proportion to the tokens.
        own = blocks.select("block", "held", "first", "vocab", "tokens").coalesce(trainers)
        got = own.mapInArrow(_train(sent, turn, rounds, n_slices), "slice int, n long, w binary, q binary")
        got = got.repartitionById(n_slices, F.col("slice")).sortWithinPartitions("slice", "n", "q").mapInArrow(_average, "slice int, w binary").collect()
        if got:
            rows = np.concatenate([np.frombuffer(r["w"], np.float32) for r in sorted(got, key=lambda r: r["slice"])])
            model = Model(rows.reshape(LEVELS, BUCKETS, FAN), model.start)
    scorer = _scorer(spark.sparkContext.broadcast(model), mass, room)
    tasks = max(1, 2 * n_blocks)
    answers = counts.where("block IS NOT NULL").select("block", "part", "c").repartition(tasks, "block")
    return core.give_back_ids(blocks.select("block", *_COLUMNS).repartition(tasks, "block").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(scorer, SCORES))


def op5_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(core.documents(spark, sf_dir).select("doc_id", "text"))


QUERIES = {"op5_maxent_lm": op5_maxent_lm}
SQL: dict[str, str] = {}
