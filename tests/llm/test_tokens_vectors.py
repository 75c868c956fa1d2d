"""Token files, centroid clustering and tokenizer alignment against plain versions."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanternflow.llm import alignment, core, kmeans, token_files
from lanternflow.llm.packing import tokenizer_path

DOCS = "doc_id long, text string, lang string, start long, ids binary, epoch long, a int, kind int, n int"
A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


def frame(spark, rows, parts=3):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", 1, b"x", 5, 6, 7, 8) for i, t in rows], DOCS).repartition(parts)


def texts(seed=2):
    rng = random.Random(seed)
    vocab = ["the", "naïve", "Über-all", "don't", "x=1;", "12345", "\t", "  ", "\n\n", "\r\n", "中文字", "é", "😀", "<|endoftext|>", "<s>", "<0x41>", "aaaaaaaa", "======", "\xa0", "."]
    rows = [" ".join(rng.choice(vocab) + rng.choice(["", "s", ","]) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    return rows + [None, "", " ", "\n", "a▁b", "one", "one", "=" * 3000, " " * 5000, "ab " * 4000, "é \x00  "]


TEXTS = texts()
ROWS = [(7 * i, t) for i, t in enumerate(TEXTS)] + [(None, "null id"), (None, "null id again one"), (7, TEXTS[1]), (7, TEXTS[1]), (7, TEXTS[2])]


def tokenizer():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(A)
    tok.no_truncation()
    tok.no_padding()
    return tok


# --- 11: token files


@pytest.mark.parametrize("percentile", [0, 50, 98, 100])
def test_blocks_round_trip(percentile):
    rng = np.random.default_rng(5)
    size = token_files.BLOCK
    rows = [rng.integers(0, 50257, size), np.full(size, 7), np.full(size, 2**32 - 1), rng.integers(0, 2**32, size), np.arange(size), np.where(rng.random(size) < 0.01, 2**32 - 1, 3), np.where(rng.random(size) < 0.3, 0, 2**31)]
    ids = np.array(rows, np.uint32)
    blocks = token_files.pack_blocks(ids, percentile)
    starts = np.cumsum([0, *map(len, blocks)])
    back = token_files.unpack_blocks(np.frombuffer(b"".join(blocks), np.uint8), starts[:-1])
    assert (back == ids).all()
    assert len(blocks[1]) == token_files.HEAD
    if percentile == 98:  # outliers are exceptions, and do not widen the block
        assert len(blocks[5]) < 100


def plain_tokens(rows):
    tok, out, start = tokenizer(), [], 0
    for i, t in sorted(rows, key=lambda r: core.NULL_ID if r[0] is None else r[0]):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, token_files.END]
        out.append((i, start, ids))
        start += len(ids)
    return out


def test_token_files(spark, tmp_path):
    unique = list(dict(ROWS).items())
    token_files.write_tokens(frame(spark, unique), f"file://{tmp_path}/t", A, ranges=4)
    assert len(list((tmp_path / "t").glob("*.tok"))) > 1
    for task in (50, 10_000, token_files.TASK):
        got = sorted(((r.doc_id, r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in token_files.read_tokens(spark, f"file://{tmp_path}/t", task).collect()), key=lambda r: r[1])
        assert got == plain_tokens(unique)
    with pytest.raises(Exception, match="holds token files"):
        token_files.write_tokens(frame(spark, unique), f"file://{tmp_path}/t", A)


def test_token_files_of_repeated_rows_and_empty_tables(spark, tmp_path):
    token_files.write_tokens(frame(spark, ROWS, 5), f"file://{tmp_path}/r", A, ranges=6)
    got = token_files.read_tokens(spark, f"file://{tmp_path}/r").select("doc_id", "start", "n_tokens", F.crc32("ids").alias("crc")).orderBy("start").collect()
    assert [r.doc_id for r in got] == [i for i, _, _ in plain_tokens(ROWS)]
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert Counter((r.doc_id, r.crc) for r in got) == Counter((i, crc(ids)) for i, _, ids in plain_tokens(ROWS))
    token_files.write_tokens(frame(spark, ROWS).limit(0), f"file://{tmp_path}/e", A)
    assert token_files.read_tokens(spark, f"file://{tmp_path}/e").collect() == []


def test_a_failed_write_leaves_nothing_that_counts(spark, tmp_path):
    spark.dataSource.register(token_files.TokenFiles)

    def fail(batches):
        for b in batches:
            yield b
            raise ValueError("lost")

    rows = spark.range(8).select(F.col("id").alias("doc_id"), F.lit(b"\1\0\0\0").alias("ids")).repartition(2)
    with pytest.raises(Exception, match="lost"):
        rows.mapInArrow(fail, "doc_id long, ids binary").write.format("token_files").mode("append").save(f"file://{tmp_path}/f")
    assert not list((tmp_path / "f").glob("*"))


def test_encoder_equals_the_library():
    enc, tok, rng = token_files.Encoder(A), tokenizer(), random.Random(9)
    made = ["".join(rng.choice(" \n\t\r\xa0\x1c\x85abcA1'.;é中😀<|>") for _ in range(30)) for _ in range(400)]
    batch = ["", *(t or "" for t in TEXTS), *made]
    for _ in range(2):  # units new, then known
        ids, n = enc.encode_all(batch)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [tok.encode(t, add_special_tokens=False).ids for t in batch]


# --- 12: centroid clustering

VECTORS = "vec_id long, embedding array<float>, label int, v array<int>, cluster string, n int"


def vector_rows(seed=3, n=300, wide=False):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(0, 1, (n, 64)) + 3 * rng.integers(0, 3, (n, 1)), 2).astype(np.float32)
    x[rng.random(n) < 0.3] = x[0]  # a third are one vector
    rows = [(int(i), [float(e) for e in v]) for i, v in enumerate(x)]
    if wide:
        rows[5] = (5, [1e6, *rows[5][1][1:]])
        rows[6] = (6, [1e30, *rows[6][1][1:]])
    odd = [(1000, None), (1001, [1.0] * 63), (1002, [1.0] * 65), (1003, [None, *[1.0] * 63]), (1004, [float("nan")] * 64), (1005, [float("-inf"), *[1.0] * 63]), (1006, []), (None, [0.5] * 64), (3, [2.0] * 64)]
    return rows + odd


def plain_kmeans(rows, k=8, rounds=10):
    import math

    kept = [(i, [max(-(2**63), min(2**63 - 1, math.floor(1024 * x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    mark = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=mark)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            mine = [v for (_, v), o in zip(kept, of, strict=True) if o == j]
            if mine:
                centroids[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    last = [(i, *near(v)) for i, v in kept]
    most = 2**63 - 1
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    inertia = Counter()
    for _, d, j in last:
        inertia[j] += min(d, most)
    return sorted(((i, j, min(d, most), min(inertia[j], most), min(sum(inertia.values()), most), sha[j]) for i, d, j in last), key=repr)


@pytest.mark.parametrize(("wide", "n", "parts"), [(False, 300, 3), (True, 60, 2), (False, 4, 1)])
def test_clusters(spark, wide, n, parts):
    rows = vector_rows(n=n, wide=wide)
    df = spark.createDataFrame([(i, v, 1, [1], "c", 2) for i, v in rows], VECTORS).repartition(parts)
    seen = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert sorted(map(tuple, kmeans.cluster_vectors(df).collect()), key=repr) == plain_kmeans(seen)


def test_no_vectors(spark):
    df = spark.createDataFrame([(1, [1.0], 1, [1], "c", 2)], VECTORS)
    assert kmeans.cluster_vectors(df).collect() == []


def test_bounds_spare_most_scans():
    """Vectors in clear clusters are scanned once; bounds never lie."""
    rng = np.random.default_rng(1)
    v = (1000 * rng.integers(0, 4, (500, 1)) + rng.integers(0, 50, (500, 64))).astype(np.int64)
    starts = [v[np.argmin(np.abs(v.mean(1) - 1000 * j))].tolist() for j in range(4)]
    step = kmeans.Round(starts, None)
    cluster, upper, lower, _, scanned = step.assign(v, np.full(500, -1, np.int32), np.zeros(500), np.zeros(500), False)
    assert scanned == 500
    moved = [(np.array(c) + 3).tolist() for c in starts]
    again = kmeans.Round(moved, starts).assign(v, cluster, upper, lower, False)
    assert again[4] == 0 and (again[0] == cluster).all()
    far = np.sqrt(np.stack([((v - np.array(c)) ** 2).sum(1) for c in moved], 1))
    at = np.arange(500)
    assert (again[1] >= far[at, cluster]).all()
    far[at, cluster] = np.inf
    assert (again[2] <= far.min(1)).all()


# --- 13: alignment


def plain_alignment(rows):
    from sentencepiece import SentencePieceProcessor

    both, sp, tok = alignment.Pair(A, B), SentencePieceProcessor(model_file=B), tokenizer()
    tok.encode_special_tokens = True
    docs, found = defaultdict(set), []
    for i, t in rows:
        groups = []
        if t:
            a, b = tok.encode(" " + t, add_special_tokens=False).ids, sp.encode(t)
            x, y = [both.a_bytes[k] for k in a], [both.b_bytes[k] for k in b]
            if b"".join(x) == b"".join(y) == (" " + t).encode():
                ea, eb = np.cumsum([*map(len, x)]).tolist(), np.cumsum([*map(len, y)]).tolist()
                p = 0
                for end in sorted(set(ea) & set(eb)):
                    groups.append(([k for k, e in zip(a, ea, strict=True) if p < e <= end], [k for k, e in zip(b, eb, strict=True) if p < e <= end]))
                    p = end
        found.append((i, groups))
        for a, b in groups:
            for pair in {(m, n) for m in set(a) for n in set(b)}:
                docs[pair].add(i)
    count = {p: len(d) for p, d in docs.items()}
    most = Counter()
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    out = []
    for i, groups in found:
        said = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        each = [((x, y), n * m) for a, b in groups for x, n in Counter(a).items() for y, m in Counter(b).items()]
        out.append((i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(n for _, n in each), sum(n for p, n in each if count[p] == most[p[0]]), sum(n * count[p] for p, n in each), hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr)


@pytest.mark.parametrize("small", [False, True])
def test_alignment(spark, monkeypatch, small):
    if small:  # many epochs, units tokenised anew
        monkeypatch.setattr(alignment, "GROUPS", 5)
        monkeypatch.setattr(alignment, "LONG", 3)
    rows = ROWS if not small else ROWS[:40] + ROWS[-5:]
    docs = frame(spark, rows)
    assert sorted(map(tuple, alignment.align(docs, A, B).collect()), key=repr) == plain_alignment(rows)
    assert alignment.align(docs.limit(0), A, B).collect() == []


def test_units_are_tokenised_as_in_the_whole_text():
    from sentencepiece import SentencePieceProcessor

    both, sp, rng = alignment.Pair(A, B), SentencePieceProcessor(model_file=B), random.Random(1)
    for t in filter(None, TEXTS + ["".join(rng.choice(" \n\t\r\xa0\x1c\x85abA1'.;é中😀<|> ") for _ in range(30)) for _ in range(500)]):
        if alignment.SPACE in t:
            continue
        units = both.units(" " + t)
        assert "".join(units) == " " + t
        whole = both.a.encode(" " + t, add_special_tokens=False).ids, sp.encode(t)
        apart, same = both.tokens(units)
        assert same.all() and (apart.a.tolist(), apart.b.tolist()) == whole
        if not any(u.isspace() for u in units):
            once = both.tokens_at_once(units)
            assert (once.a.tolist(), once.b.tolist()) == whole
            assert once.a_start.tolist() == apart.a_start.tolist() and once.b_start.tolist() == apart.b_start.tolist()
