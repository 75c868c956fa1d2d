"""The text operators against brute force on small fixtures."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from lanternflow.llm import bpe, compression_rules, core, fingerprints, jaccard_join, line_dedup, maxent_lm, packing, pii, quality_classifier, substring_dedup
from lanternflow.llm import components as components_module
from lanternflow.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_lines int, component_id string, rest string"


def frame(spark, rows, parts=3):
    """Documents with extra columns whose names the operators use themselves."""
    data = [(i, t, "en", "s", None if t is None else len(t), 7, "x", "y") for i, t in rows]
    return spark.createDataFrame(data, DOCS).repartition(parts)


def words(rng, n, vocab=400):
    return [f"w{int(rng.paretovariate(0.7)) % vocab}" for _ in range(n)]


def corpus(seed=1):
    """Copies, near copies, shared passages and lines, odd texts."""
    rng = random.Random(seed)
    rows = []
    base = [words(rng, rng.randint(60, 200), 5000) for _ in range(30)]
    passage, line = words(rng, 70, 9000), "This line is common to many documents."
    for k, w in enumerate(base):
        text = "\n".join(" ".join(w[i : i + 12]) for i in range(0, len(w), 12))
        rows.append(text)
        if k % 3 == 0:
            rows.append(text)
        if k % 2 == 0:
            v = list(w)
            for _ in range(2):
                v[rng.randrange(len(v))] = "changed"
            rows.append(" ".join(v).upper())
        if k % 4 == 0:
            rows.append(" ".join(words(rng, 50, 9000) + passage + words(rng, 40, 9000)))
        if k % 5 == 0:
            rows.append(f"{line}\nshort\n  {line.upper()} \n" + " ".join(words(rng, 30)))
    rows += [None, "", " \t\n", "one", "two words", "a b c d", "A B C D", "é" * 9, "É" * 12 + "\n" + "x" * 10, "x" * 10, " ".join(["again"] * 300), "\n\n"]
    rng.shuffle(rows)
    return [(3 * i, t) for i, t in enumerate(rows)] + [(None, "a null id with words in it"), (0, rows[0]), (0, rows[0])]


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def toks(t):
    return (t or "").encode().lower().split()


# --- 1: n-gram Jaccard join


def sets(t):
    w = toks(t)
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute_components(rows, pct=75):
    docs = defaultdict(set)
    own = [(core.NULL_ID if i is None else i, sets(t)) for i, t in rows]
    for i, s in own:
        docs[i].add(frozenset(s))
    ids = sorted(docs)
    to = {i: i for i in ids}

    def find(i):
        while to[i] != i:
            i = to[i]
        return i

    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if any(s and r and 100 * len(s & r) >= pct * len(s | r) for s in docs[a] for r in docs[b]):
                p, q = sorted((find(a), find(b)))
                to[q] = p
    return sorted((i, len(s), find(i)) for i, s in own)


@pytest.mark.parametrize("pct", [75, 40])
def test_jaccard_components(docs, pct):
    got = jaccard_join.jaccard_components(docs, pct)
    assert sorted(map(tuple, got.collect())) == brute_components(ROWS, pct)


def test_jaccard_long_lists_and_salting(spark, monkeypatch):
    """Many near copies and shared passages, with block skipping, small parts and no table of frequent shingles."""
    rng = random.Random(4)
    rows, seed = [], words(rng, 80, 9000)
    for i in range(60):
        w = list(seed)
        for _ in range(i % 7):
            w[rng.randrange(80)] = f"z{rng.randrange(9)}"
        rows.append((i, " ".join(w if i % 3 else words(rng, 30 + i, 9000) + seed[:60])))
    monkeypatch.setattr(jaccard_join, "SHORT", 2)
    monkeypatch.setattr(jaccard_join, "MEMBERS", 3)
    monkeypatch.setattr(jaccard_join, "GROUP", 4)
    monkeypatch.setattr(jaccard_join, "LIST", 4)
    monkeypatch.setattr(jaccard_join, "frequent_table", lambda *_: ())
    got = jaccard_join.jaccard_components(frame(spark, rows), 60)
    assert sorted(map(tuple, got.collect())) == brute_components(rows, 60)


@pytest.mark.parametrize("size", [2, 3, 5, 10_000])
def test_lists_that_go_on_over_batches_keep_every_entry(size):
    """Whatever the batches, each entry of a list of two or more is kept and has the leader that the whole list gives it."""
    rng = np.random.default_rng(size)
    token = np.sort(rng.integers(0, 40, 300))
    pos = np.zeros(300, np.int32)
    for t in range(40):
        pos[token == t] = np.sort(rng.integers(0, 9, (token == t).sum()))
    n, ids = rng.integers(10, 60, 300).astype(np.int32), np.arange(300)
    whole = pa.RecordBatch.from_pydict({"token": token, "set": ids, "n": n, "pos": pos})
    got = [r for b in jaccard_join._lead(75)(whole.slice(i, size) for i in range(0, 300, size)) for r in b.to_pylist()]
    want, count = {}, Counter(token.tolist())
    for t in set(token.tolist()):
        heads: list[int] = []
        for i in np.flatnonzero(token == t).tolist():
            h = next((h for h in heads if 100 * min(n[h], n[i]) >= 75 * max(n[h], n[i])), None)
            if h is None:
                heads.append(h := i)
            want[i] = h
    assert {r["set"]: r["lead"] for r in got} == {i: h for i, h in want.items() if count[token[i]] > 1} and len(got) == sum(c for c in count.values() if c > 1)
    assert all(r["many"] > 2 for r in got if count[r["token"]] > 2)


def brute_cells(rows, most):
    return {(min(a, b), max(a, b)) for g, a, p in rows for h, b, q in rows if g == h and p != q}


@pytest.mark.parametrize("most", [2, 5, 100])
def test_cells_hold_every_pair_of_components(spark, most):
    rng = random.Random(most)
    rows = [(g, i, 0 if g < 2 and rng.random() < 0.8 else rng.randrange(4)) for i in range(70) for g in range(4) if rng.random() < 0.5]
    got = jaccard_join._dealt(spark.createDataFrame(rows, "g long, set long, comp long"), "g", most).collect()
    cells = defaultdict(list)
    for r in got:
        cells[r.cell].append(r)
    met = set()
    for c in cells.values():
        role = jaccard_join._roles(np.array([r.role for r in c]), np.array([r.comp for r in c]))
        for x, p in zip(c, role, strict=True):
            for y, q in zip(c, role, strict=True):
                if x.comp != y.comp and p != jaccard_join.GUEST and q != jaccard_join.HOME:
                    met.add((min(x.set, y.set), max(x.set, y.set)))
    assert met == brute_cells(rows, most)
    if most < 100:
        assert max(len(c) for c in cells.values()) <= 5 * most + 10


def test_delta_pairs_survive_collisions():
    """Tokens of a delta with equal low halves do not lower an overlap: 78 shared of 102 link."""
    leader = np.arange(1, 91, dtype=np.uint64)
    more = (np.arange(12, dtype=np.uint64) % np.uint64(3)) + np.uint64(5000)  # twelve tokens of three hashes
    sets = [np.concatenate([leader[:78], more]), np.concatenate([leader[:66], more, np.arange(900, 912, dtype=np.uint64)])]
    low = [np.concatenate([leader[78:], more]).astype(np.uint32), np.concatenate([leader[66:], more, np.arange(900, 912, dtype=np.uint64)]).astype(np.uint32)]
    n, shared = np.array([len(s) for s in sets]), 66 + 12
    assert 100 * shared >= 75 * (n.sum() - shared)
    x, y = jaccard_join.delta_pairs(n, np.array([1, 2]), low, 75)
    assert (x.tolist(), y.tolist()) == ([0], [1])


def test_parity_gap_is_a_lower_bound():
    rng = np.random.default_rng(0)
    for _ in range(300):
        x = np.unique(rng.integers(0, 400, rng.integers(1, 300), dtype=np.uint64))
        y = np.unique(rng.integers(0, 400, rng.integers(1, 300), dtype=np.uint64))
        assert jaccard_join.parity_gap(jaccard_join.parity_bits(x), jaccard_join.parity_bits(y)) <= len(np.setxor1d(x, y))


def test_list_pairs_lose_no_link(monkeypatch):
    rng = np.random.default_rng(3)
    n = np.sort(rng.integers(10, 60, 80))
    pos = rng.integers(0, 10, 80)
    order = np.lexsort((pos, n))
    n, pos, comp = n[order], pos[order], rng.integers(0, 20, 80)
    lead, shared, known = rng.integers(0, 3, 80), np.minimum(rng.integers(-1, 60, 80), n), rng.random(80) < 0.5
    pairs = lambda: set(zip(*(x.tolist() for x in jaccard_join.list_pairs(n, pos, comp, lead, shared, known, 75)), strict=True))
    short = pairs()
    monkeypatch.setattr(jaccard_join, "SHORT", 0)
    assert pairs() == short and len(short) > 50


def test_delta_pairs_equal_the_sets(monkeypatch):
    rng = np.random.default_rng(5)
    leader = np.unique(rng.integers(0, 2**32, 90, dtype=np.uint32))
    sets = [np.union1d(rng.permutation(leader)[: rng.integers(70, 90)], rng.integers(0, 40, rng.integers(0, 9), dtype=np.uint32)) for _ in range(70)]
    comp = rng.integers(0, 5, 70)
    n = np.array([len(s) for s in sets])
    want = {(i, j) for i in range(70) for j in range(i + 1, 70) if comp[i] != comp[j] and 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))}
    monkeypatch.setattr(jaccard_join, "RUN", 16)
    x, y = jaccard_join.delta_pairs(n, comp, [np.setxor1d(s, leader) for s in sets], 75)
    assert set(zip(x.tolist(), y.tolist(), strict=True)) == want and 10 < len(want)


def test_keep_one(docs):
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    want = Counter(None if i == core.NULL_ID else i for i, _, c in brute_components(ROWS) if c == i)
    assert Counter(r.doc_id for r in kept.collect()) == want


@pytest.mark.parametrize("small", [0, 200_000])
def test_components(spark, monkeypatch, small):
    monkeypatch.setattr(components_module, "SMALL", small)
    rng = random.Random(1)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(110)] + [(i, i + 1) for i in range(300, 360)] + [(500, 500 + i) for i in range(1, 40)]
    got = {r.a: r.b for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    to = {v: v for x in links for v in x}
    for _ in to:
        for a, b in links:
            to[a] = to[b] = min(to[a], to[b])
    assert got == {v: m for v, m in to.items() if m != v}
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


# --- 2: line dedup


def brute_lines(rows):
    strip = lambda x: re.sub("[A-Z]+", lambda m: m[0].lower(), x.strip(" \t\n\r\x0b\x0c"))
    ids = defaultdict(set)
    own = [(core.NULL_ID if i is None else i, (t or "").split("\n")) for i, t in rows]
    for i, ls in own:
        for x in ls:
            ids[strip(x)].add(i)
    out = []
    for i, ls in own:
        kept = [x for x in ls if len(strip(x)) < 10 or len(ids[strip(x)]) < 2 or min(ids[strip(x)]) == i]
        out.append((i, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return sorted(out)


@pytest.mark.parametrize("hot", [1, 8192])
def test_line_dedup(docs, hot):
    got = line_dedup.dedup_lines(docs, hot_lines=hot)
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()) == brute_lines(ROWS)
    assert core.like(got, docs).columns == docs.columns


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_minimal_hash_is_minimal_and_perfect(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 2**63, n, dtype=np.uint64))
    h = line_dedup.MinimalHash(keys)
    assert sorted(h.slots(keys).tolist()) == list(range(len(keys)))
    assert line_dedup.LineIndex(keys.view(np.int64), keys.view(np.int64), keys.view(np.int64), keys.view(np.int64)).probe(keys.view(np.int64) ^ 1, keys.view(np.int64) ^ 1).max(initial=-1) == -1


# --- 3 and 7: tokens


ODD = ["Hello  World's É ﬁ\xa0x y", "a <|endoftext|> b<|STARTOFTEXT|>", "don't 12 __a!!! \x00\x1c z", "İ ǅ ẞ", "aaaa aaa!!!!!!!", "ΑΣ Σ ας", "日本語 x", "ée ½²³ªº \x85\x1d_", "'S 'LL'd it'S", ""]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return {n: Tokenizer.from_file(packing.tokenizer_path(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json")}


def test_bpe_equals_the_library(docs, library):
    t = library["word_bpe_49k.json"]
    b = bpe.word_bpe(packing.tokenizer_path("word_bpe_49k.json"))
    rng = random.Random(3)
    texts = [*ODD, *(x or "" for _, x in ROWS)] + ["".join(rng.choice("aAbBeEé '!1Σσςſ́\n<|endoftext|>日") for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    for x, ids, e in zip(texts, b.encode(texts), t.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids == e.ids and b.decimal(ids) == " ".join(map(str, e.ids)) and b.decode(ids) == t.decode(e.ids, skip_special_tokens=False), x
    got = bpe.encode_documents(docs, packing.tokenizer_path("word_bpe_49k.json")).collect()
    want = [(i, " ".join(map(str, t.encode(x or "", add_special_tokens=False).ids))) for i, x in ROWS]
    assert Counter((r.doc_id, r.ids) for r in got) == Counter(want)


def test_packing(docs, library):
    t = library["byte_bpe_50k.json"]
    enc = packing.byte_tokens(packing.tokenizer_path("byte_bpe_50k.json")).encode(ODD)
    assert [np.frombuffer(x, "<u4").tolist() for x in enc] == [t.encode(x, add_special_tokens=False).ids for x in ODD]
    rows = packing.pack_documents(docs, packing.tokenizer_path("byte_bpe_50k.json"), length=64, with_ids=True).collect()
    made = defaultdict(list)
    for r in rows:
        made[r.doc_id].append(r)
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
    for i, x in dict(ROWS).items():
        want = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        copies = [k for k, _ in ROWS].count(i)
        own = sorted(made[i], key=lambda r: r.piece)[:: copies]
        assert [a for r in own for a in r.ids] == want and [r.piece for r in own] == list(range(len(own)))
        assert [r.start for r in own] == [sum(q.length for q in own[:k]) for k in range(len(own))]
        assert all(r.length == 64 for r in own[1:]) and (len(want) > 64 or len(own) == 1)
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        s.sort()
        assert [o for o, _ in s] == [sum(n for _, n in s[:k]) for k in range(len(s))] and sum(n for _, n in s) <= 64
    assert len(seqs) <= 1.05 * math.ceil(sum(r.length for r in rows) / 64) + 1


@pytest.mark.parametrize("most", [1, 4, 500])
def test_best_fit(most):
    rng = random.Random(most)
    lengths = [rng.randint(1, 50) for _ in range(500)]
    bins = packing.OpenBins(50, most)
    at, place = (x + y for x, y in zip(bins.put(lengths[:200]), bins.put(lengths[200:]), strict=True))
    free: dict[int, int] = {}  # of bins that may be open
    for k, (n, b, p) in enumerate(zip(lengths, at, place, strict=True)):
        used_later = set(at[k:])
        if b in free:
            assert p == 50 - free[b] and free[b] >= n
            # No open bin that is used again fits more tightly.
            assert not [f for x, f in free.items() if x in used_later and n <= f < free[b]]
        else:
            assert p == 0 and b == len(set(at[:k]))
            assert not [f for x, f in free.items() if x in used_later and f >= n]
            free[b] = 50
        free[b] -= n
        assert sum(f > 0 for x, f in free.items() if x in set(at[k + 1 :])) <= most
    total: Counter = Counter()
    for n, b in zip(lengths, at, strict=True):
        total[b] += n
    assert max(total.values()) <= 50 and (bins.closed > 0) == (most < 500)


def test_packing_closes_bins_and_fills_them():
    """With the query's own settings bins close for want of a place, and sequences stay within 1 % of the least number."""
    rng = np.random.default_rng(2)
    lengths = np.minimum(2048, 1 + rng.lognormal(6.5, 1.1, packing.TASK).astype(np.int64))
    order = packing.longest_first(lengths, packing.RUN)
    assert (np.sort(order.reshape(-1, packing.RUN), axis=1).ravel() == np.arange(len(lengths))).all()
    bins = packing.OpenBins(packing.LENGTH, packing.OPEN)
    at, _ = bins.put(lengths[order].tolist())
    assert bins.closed > 0 and bins.open <= packing.OPEN and len(set(at)) <= 1.01 * lengths.sum() / packing.LENGTH


def test_packing_over_several_tasks(docs):
    tasks = packing.pack(packing.pieces(docs, packing.tokenizer_path("byte_bpe_50k.json"), 64), 64, 4, 8, 50).collect()
    assert len({r.sequence_id >> 32 for r in tasks}) > 3
    ends = {(r.sequence_id, r.offset + r.length) for r in tasks}
    assert all(r.offset == 0 or (r.sequence_id, r.offset) in ends for r in tasks) and max(e for _, e in ends) <= 64


# --- 4: compression rules


def brute_kept(t, size=4096, small=512):
    """The verdict from the definition, text by text and chunk by chunk."""

    def fits(x):
        packed, n = len(zstandard.ZstdCompressor(level=3).compress(x)), len(x.decode(errors="ignore")) if x == t else sum(c & 0xC0 != 0x80 for c in x)
        low = next(lo for top, lo, _ in compression_rules.BANDS if len(x) <= top)
        mean = math.sqrt(n * len(x))
        high = next(hi for top, _, hi in compression_rules.BANDS if mean <= top)
        return len(x) >= low * packed and mean <= high * packed

    if not t or not fits(t):
        return False
    parts = [t[k : k + size] for k in range(0, len(t), size)]
    if len(parts) > 1 and len(parts[-1]) < small:
        parts[-2:] = [parts[-2] + parts[-1]]
    return len(parts) == 1 or 2 * sum(len(x) for x in parts if not fits(x)) <= len(t)


def prose(rng, alphabet, n):
    """Words of a small vocabulary, the frequent ones short."""
    vocab = ["".join(rng.choice(alphabet) for _ in range(2 + min(6, k.bit_length()))) for k in range(1, 9000)]
    return " ".join(vocab[min(int(rng.paretovariate(0.22)) - 1, rng.randrange(8998))] for _ in range(n))


def test_compression_is_alike_in_all_alphabets():
    """A text and its twin in two-byte letters have one verdict: prose stays, loops go, and both are as brute force says."""
    latin, other = "abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщ"
    to = str.maketrans(latin, other)
    rng = random.Random(4)
    texts = [prose(rng, latin, n) for n in (80, 300, 600, 900, 2000) for _ in range(4)] + ["the same words again and again " * n for n in (20, 300)] + [prose(rng, latin, 60) * 9]
    every = [x.encode() for t in texts for x in (t, t.translate(to))]
    got = compression_rules.compress_verdict(every)[2].tolist()
    assert got == [brute_kept(x) for x in every]
    assert got[::2] == got[1::2] and not any(got[-6:]) and sum(got) >= 30
    tail = prose(rng, latin, 900).encode()[:4096] + b"z" * 300
    assert [len(c) for c in compression_rules.chunks(tail)] == [4396] and [len(c) for c in compression_rules.chunks(tail + b"z" * 300)] == [4096, 600]


def test_compression_rules(docs):
    got = {(r.doc_id, r.n_words): r for r in compression_rules.compression_rules(docs).collect()}
    for i, t in ROWS:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen = Counter(zip(w, w[1:], w[2:], strict=False))
        cover = {k + d for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for d in range(3)}
        ls = [x for x in t.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
        r = got[i, len(w)]
        assert (r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(ls) - len(set(ls)), len(cover))
        assert r.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w))
        assert r.kept == (not r.base_failed and brute_kept(t.encode()))


def test_compression_verdicts():
    rng = random.Random(1)
    prose = " ".join("".join(rng.choice("etaoin shrdlu") for _ in range(5)) for _ in range(2000)).encode()
    noise = bytes(rng.choice(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(9000))
    loop = b"the same words again and again " * 300
    assert compression_rules.compress_verdict([prose, noise, loop, b""])[2].tolist() == [True, False, False, False]


# --- 5: language model


def test_language_model(docs):
    rows = maxent_lm.score_documents(docs).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter(w for i, t in ROWS if not held(i) for w in [*toks(t), None])
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, t in ROWS:
        own = [*toks(t), None]
        want[(i, held(i), len(own), sum(w in c for w in own), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own), 6))] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == want
    assert all(r.score < 0 for r in rows)


def lm_block(words_of_texts):
    h = core.Words(np.frombuffer(" ".join(w for t in words_of_texts for w in t).encode(), np.uint8), np.array([0, sum(len(w) + 1 for t in words_of_texts for w in t) - 1])).hash
    vocab, tokens = np.unique(h, return_inverse=True)
    first = np.append(0, np.cumsum([len(t) for t in words_of_texts]))
    return maxent_lm.Block(doc_id=np.arange(len(first) - 1), held=np.zeros(len(first) - 1, np.uint8), first=first, vocab=vocab, train=np.bincount(tokens).astype(np.uint32), tokens=tokens.astype(np.uint32))


def test_class_model_is_a_distribution_and_learns():
    rng = np.random.default_rng(0)
    text = [0]
    for _ in range(20_000):  # the next word nearly follows from the last
        text.append((text[-1] * 7 + 3) % 40 if rng.random() < 0.9 else int(rng.integers(40)))
    block = lm_block([[f"w{i}" for i in text]])
    word = maxent_lm.leaf(block.vocab)[block.tokens]
    model = maxent_lm.Model.of(np.bincount(word, minlength=maxent_lm.LEAVES).astype(float))
    hist = maxent_lm.histories(block, np.arange(len(word)))
    before = -model.log_likelihood(hist, word).mean()
    assert maxent_lm.train_on(model, np.zeros((maxent_lm.LEVELS, maxent_lm.BUCKETS), np.float32), block, 0, 1) == len(word)
    every = np.arange(maxent_lm.LEAVES)
    for i in (0, 1, 77):
        assert abs(np.exp(model.log_likelihood(np.repeat(hist[:, i : i + 1], len(every), axis=1), every)).sum() - 1) < 1e-3
    assert -model.log_likelihood(hist, word).mean() < 0.5 * before


def test_log_likelihood_and_steps_equal_a_plain_softmax():
    """A digit's probability and its gradient, written out feature by feature in exact sums."""
    rng = random.Random(9)
    block = lm_block([words(rng, 60, 30) for _ in range(5)])
    word = maxent_lm.leaf(block.vocab)[block.tokens]
    model = maxent_lm.Model.of(np.bincount(word, minlength=maxent_lm.LEAVES).astype(float))
    hist = maxent_lm.histories(block, np.arange(len(word)))
    w = {}
    seen: Counter = Counter()
    fan, levels, bits = maxent_lm.FAN, maxent_lm.LEVELS, maxent_lm.BITS

    def digits(i):
        for k in range(levels):
            before = int(word[i]) >> (bits * (levels - k))
            rows = [(((int(f) ^ ((before * 0x9E3779B97F4A7C15 + k) % 2**64)) * 0xD6E8FEB86659FD93) % 2**64) >> 48 for f in hist[: maxent_lm.FEATURES[k], i]]
            x = [float(model.start[k][before][d]) + sum(w.get((k, r, d), 0.0) for r in rows) for d in range(fan)]
            z = sum(map(math.exp, x))
            yield k, rows, [math.exp(v) / z for v in x], (int(word[i]) >> (bits * (levels - 1 - k))) & (fan - 1)

    square = np.zeros((levels, maxent_lm.BUCKETS), np.float32)
    for s in (0, 150):
        # A step: the features of a level are changed one after another, from the same probabilities.
        total: dict = defaultdict(lambda: [0.0] * fan)
        for i in range(s, s + 150):
            for k, rows, p, y in digits(i):
                for q, r in enumerate(rows):
                    for d in range(fan):
                        total[k, q, r][d] += p[d] - (d == y)
        for (k, _, r), g in sorted(total.items()):
            seen[k, r] += sum(v * v for v in g)
            for d in range(fan):
                w[k, r, d] = w.get((k, r, d), 0.0) - maxent_lm.RATE / math.sqrt(seen[k, r] + 1) * g[d]
        model.step(square, hist[:, s : s + 150], word[s : s + 150], maxent_lm.RATE)
    want = [sum(math.log(p[y]) for _, _, p, y in digits(i)) for i in range(len(word))]
    assert np.allclose(model.log_likelihood(hist, word), want, atol=2e-3)


def test_steps_add_up_repeated_rows_only():
    """To the last bit the weights of steps that sum every row by ``reduceat``, in clearly less time."""

    def plain(model, square, hist, word):
        for k in range(maxent_lm.LEVELS):
            before, digit = word >> (maxent_lm.BITS * (maxent_lm.LEVELS - k)), (word >> (maxent_lm.BITS * (maxent_lm.LEVELS - 1 - k))) & (maxent_lm.FAN - 1)
            rows, _, g, z = model.softmax(k, hist, before)
            g /= z[:, None]
            g[np.arange(len(word)), digit] -= 1
            for r in rows:
                order = np.argsort(r, kind="stable")
                use, cut = np.unique(r[order], return_index=True)
                total = np.add.reduceat(np.take(g, order, axis=0), cut, axis=0)
                square[k][use] += np.einsum("ij,ij->i", total, total)
                model.weights[k][use] -= total * (maxent_lm.RATE / np.sqrt(square[k][use] + 1))[:, None]

    rng = np.random.default_rng(5)
    block = lm_block([[f"w{int(i)}" for i in rng.zipf(1.2, 15 * maxent_lm.STEP + 7) % 50_000]])
    word, hist = maxent_lm.leaf(block.vocab)[block.tokens], maxent_lm.histories(block, np.arange(len(block.tokens)))
    mass = np.bincount(word, minlength=maxent_lm.LEAVES).astype(float)
    (a, b), squares = (maxent_lm.Model.of(mass) for _ in range(2)), np.zeros((2, maxent_lm.LEVELS, maxent_lm.BUCKETS), np.float32)
    b = maxent_lm.Model(maxent_lm.aligned(b.weights), b.start)
    assert b.weights.ctypes.data % 64 == 0
    spent = [[], []]
    for s in range(0, len(word), maxent_lm.STEP):
        h, w, t = hist[:, s : s + maxent_lm.STEP], word[s : s + maxent_lm.STEP], time.process_time()
        plain(a, squares[0], h, w)
        spent[0].append(time.process_time() - t)
        t = time.process_time()
        b.step(squares[1], h, w, maxent_lm.RATE)
        spent[1].append(time.process_time() - t)
    assert (a.weights == b.weights).all() and (squares[0] == squares[1]).all() and a.weights.any()
    assert np.median(spent[1]) < 0.85 * np.median(spent[0])


def test_language_model_beats_the_unigrams(spark):
    rng = random.Random(2)
    chain = {f"w{i}": [f"w{rng.randrange(200)}" for _ in range(3)] for i in range(200)}
    rows = []
    for i in range(300):
        t = [f"w{rng.randrange(200)}"]
        while len(t) < 80:
            t.append(rng.choice(chain[t[-1]]))
        rows.append((i, " ".join(t)))
    got = maxent_lm.score_documents(frame(spark, rows)).where("held_out").agg(F.sum("n_tokens"), F.sum("base_score"), F.sum("score")).first()
    base, model = (10 ** (-x / got[0]) for x in got[1:])
    assert base > 150 and model < 0.4 * base


def test_weights_are_averaged_by_their_gradients():
    w = np.zeros((2, 3, maxent_lm.FAN), np.float16)
    w[0, :, 0], w[1, :, 0] = [1, 1, 1], [4, 4, 1]
    q = np.array([[1, 0, 0], [1, 2, 0]], np.float16)
    rows = pa.RecordBatch.from_pydict({"slice": pa.array([0, 0], pa.int32()), "n": [5, 6], "w": [x.tobytes() for x in w], "q": [x.tobytes() for x in q]})
    out = np.frombuffer(next(maxent_lm._average(iter([rows]))).column("w")[0].as_buffer(), np.float32).reshape(3, -1)
    assert np.allclose(out[:, 0], [2.5, 4, 1], atol=1e-4) and (out[:, 1:] == 0).all()


# --- 6: quality classifier


def labelled(spark):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(600):
        good = rng.random() < 0.8
        w = words(rng, rng.randint(40, 120))
        rows.append((i, " ".join(w) + "." if good else " ".join(x.upper() + "!!" if i % 2 else x + "###" for x in w)))
        if i % 2 == 0 or i % 5 == 0:
            labels.append((i, int(good)))
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int")


def test_quality_classifier(spark):
    docs, labels = labelled(spark)
    got = quality_classifier.scores(docs, labels).join(labels, "doc_id").withColumn("held", quality_classifier.fold() == 0)
    r = got.where("held").agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0]
    assert r > 0.97
    kept = quality_classifier.good_only(docs, labels)
    assert kept.columns == docs.columns and 400 < kept.count() < 560


def test_quality_learns_from_no_held_out_label(spark):
    docs, labels = labelled(spark)
    flipped = labels.withColumn("quality", F.when(quality_classifier.fold() == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    key = lambda x: sorted((r.doc_id, r.score) for r in quality_classifier.scores(docs, x).collect())
    assert key(labels) == key(flipped)


@pytest.mark.parametrize("share", [0.3, 0.6, 0.85])
def test_class_prior_from_positives_and_unlabelled(share):
    rng = np.random.default_rng(int(100 * share))
    make = lambda n, good: rng.normal(0.0, 1.0, (n, quality_classifier.N_FEATURES)) + np.where(good, 0.0, 2.0)[:, None]
    found = quality_classifier.class_prior(make(2000, np.ones(2000, bool)), make(4000, rng.random(4000) < share))
    assert abs(found - share) < 0.06


def test_quality_uses_no_negative_label(spark):
    docs, labels = labelled(spark)
    key = lambda x: sorted((r.doc_id, r.score) for r in quality_classifier.scores(docs, x).collect())
    assert key(labels) == key(labels.where("quality = 1"))


def test_quality_of_repeated_rows(spark):
    docs, labels = labelled(spark)
    got = quality_classifier.scores(docs.union(docs.limit(50)), labels).collect()
    seen = defaultdict(set)
    for r in got:
        seen[r.doc_id].add(r.score)
    assert len(got) == 650 and all(len(x) == 1 for x in seen.values())


def test_quality_without_labels(docs, spark):
    got = quality_classifier.scores(docs, spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert len(got) == len(ROWS) and {r.score for r in got} == {0.5}


# --- 8: substring dedup


def test_compact_windows_hold_every_subsequence_once():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 2**63, 60, dtype=np.uint64)
    h[10:20] = h[30:40]
    l, c, r = substring_dedup.compact_windows(h, np.array([0, 25, 25, 60]), 7)
    low = h & ~np.uint64((1 << 28) - 1)
    for s, e in ((0, 25), (25, 60)):
        for i in range(s, e):
            for j in range(i + 7, e + 1):
                hit = [(a, b, d) for a, b, d in zip(l, c, r, strict=True) if a <= i <= b < j <= d]
                assert len(hit) == 1 and low[hit[0][1]] == low[i:j].min()


def test_repeated_passages(docs):
    got = substring_dedup.repeated_passages(docs).collect()
    ids = defaultdict(set)
    texts = {core.NULL_ID if i is None else i: toks(t) for i, t in ROWS}
    for i, w in texts.items():
        for k in range(len(w) - 49):
            ids[tuple(w[k : k + 50])].add(i)
    want = {i for s in ids.values() if len(s) > 1 for i in s}
    assert want and want <= {r.doc_id for r in got}
    for r in got:
        own, other = texts[r.doc_id][r.start_word : r.end_word], texts[r.class_id]
        assert len(own) >= 50 and r.end_word <= len(texts[r.doc_id]) and r.shared >= 0.75
        five = {tuple(other[k : k + 5]) for k in range(len(other) - 4)}
        if r.doc_id != r.class_id:
            assert sum(tuple(own[k : k + 5]) in five for k in range(len(own) - 4)) >= 0.75 * (len(own) - 4)


def test_runs():
    m = np.array([1] * 10 + [0] * 3 + [1] * 10 + [0] * 9 + [1] * 4, bool)
    assert substring_dedup.runs(m, 75, 10) == [(0, 23, 20)]
    assert substring_dedup.runs(m, 75, 24) == [] == substring_dedup.runs(np.zeros(0, bool), 75, 1)


def test_windows_that_fit_no_leader_lead(spark):
    rng = random.Random(3)
    rows = []
    for k in range(20):
        own = [[f"u{rng.randrange(10**6)}" for _ in range(60)] for _ in range(3)]
        p = [f"p{k}x{i}" for i in range(56)]
        # The smallest id ends with the passage's first half.
        rows += [(3 * k, " ".join(own[0] + p[:30])), (3 * k + 1, " ".join(p + own[1])), (3 * k + 2, " ".join(p + own[2]))]
    got = {r.doc_id for r in substring_dedup.repeated_passages(frame(spark, rows), functions=1, agree=1).collect()}
    assert got == {i for i, _ in rows if i % 3}


@pytest.mark.parametrize("seed", range(8))
def test_sweep_ties_windows_as_the_definition_says(seed):
    rng = np.random.default_rng(seed)
    least, n = 6, 120
    rows = sorted({(int(k), int(d), int(x), int(y)) for k, d, x, y in zip(rng.integers(0, 6, n), rng.integers(0, 30, n), rng.integers(0, 7, n), rng.integers(0, 7, n), strict=True) if x + y >= least})
    key, ids, left, right = np.array(rows).T
    over = lambda s, t: min(s[0], t[0]) + min(s[1], t[1]) >= least
    want: dict = {}
    for k in range(6):
        lead: list = []
        for _, d, x, y in (r for r in rows if r[0] == k):
            if (k, x, y) not in want:
                fit = [(e, s) for e, s in lead if e != d and over(s, (x, y))]
                if not fit:
                    lead.append((d, (x, y)))
                    fit = [(d, (x, y))]
                want[k, x, y] = sorted(e for e, _ in fit)
    first, extent, use, to = substring_dedup.sweep(key, ids, left, right, least)
    got = defaultdict(list)
    for u, t in zip(use.tolist(), to.tolist(), strict=True):
        i = first[u]
        got[int(key[i]), int(left[i]), int(right[i])].append(int(ids[first[t]]))
    assert {k: sorted(v) for k, v in got.items()} == want and (first[extent] <= np.arange(len(rows))).all()
    # In batches of any size, with every window of an extent answered by its leaders.
    for size in (1, 7, 50):
        whole = pa.RecordBatch.from_pydict({"key": key, "doc_id": ids, "left": left, "right": right, "role": np.zeros(len(rows), np.int64)})
        links = {(r["key"], r["a"], r["b"], r["left"], r["right"]) for b in substring_dedup._sweep(least)(whole.slice(i, size) for i in range(0, len(rows), size)) for r in b.to_pylist()}
        assert links == {(k, a, d, x, y) for k, d, x, y in rows for a in want[k, x, y] if a != d}


def test_passages_do_not_depend_on_partitions(spark):
    got = [Counter(map(tuple, substring_dedup.repeated_passages(frame(spark, ROWS, n)).collect())) for n in (1, 3, 16)]
    assert got[0] == got[1] == got[2] and len(got[0]) > 20


def test_edited_passages_are_found(spark):
    rng = random.Random(5)
    w = lambda n: [f"t{rng.randrange(10**6)}" for _ in range(n)]
    rows, want = [], set()
    for k in range(400):
        p = w(rng.randint(50, 60))
        q = list(p)
        for i in rng.sample(range(4, 46), 2):
            q[i] = f"x{i}"
        pair = [w(rng.randint(20, 120)) + t + w(rng.randint(20, 120)) for t in (p, q)]
        five = [[tuple(t[i : i + 5]) for i in range(len(t) - 4)] for t in pair]
        if any(substring_dedup.runs(np.isin(np.arange(len(a)), [i for i, g in enumerate(a) if g in set(b)]), 75, 46) for a, b in (five, five[::-1])):
            want |= {2 * k, 2 * k + 1}
        rows += [(2 * k + i, " ".join(t)) for i, t in enumerate(pair)]
    got = {r.doc_id for r in substring_dedup.repeated_passages(frame(spark, rows)).collect()}
    assert len(want) > 500 and want <= got


@pytest.mark.parametrize("share", [75, 80, 85])
def test_recall_of_near_passages(spark, share):
    """Of pairs that brute force matches to about this share, nine in ten at least are found."""
    rng = random.Random(share)
    w = lambda n: [f"t{rng.randrange(10**6)}" for _ in range(n)]
    rows, want = [], []
    while len(want) < 80:
        n = rng.randint(55, 80)
        p = w(n)
        q = list(p)
        for i in rng.sample(range(n), max(1, round((100 - share) / 100 * n / 5))):
            q[i] = f"x{rng.randrange(10**6)}"
        pair = [w(rng.randint(20, 90)) + t + w(rng.randint(20, 90)) for t in (p, q)]
        five = [[tuple(t[i : i + 5]) for i in range(len(t) - 4)] for t in pair]
        found = [m / (e - s) for a, b in (five, five[::-1]) for s, e, m in substring_dedup.runs(np.array([g in set(b) for g in a]), 75, 46)]
        if found and share <= 100 * max(found) < share + 5:
            want.append(len(rows))
            rows += [(len(rows) + i, " ".join(t)) for i, t in enumerate(pair)]
    got = {r.doc_id for r in substring_dedup.repeated_passages(frame(spark, rows)).collect()}
    assert sum(i in got and i + 1 in got for i in want) >= 0.9 * len(want)


def test_scattered_pieces_are_no_passage(spark):
    rng = random.Random(6)
    w = lambda n: [f"t{rng.randrange(10**7)}" for _ in range(n)]
    p, pieces = w(70), [w(25) for _ in range(6)]
    one = w(30) + p + [x for piece in pieces for x in w(60) + piece] + w(30)
    two = w(30) + p + [x for piece in pieces for x in piece] + w(30)
    got = {(r.doc_id, r.class_id, r.start_word, r.end_word, r.shared) for r in substring_dedup.repeated_passages(frame(spark, [(1, " ".join(one)), (2, " ".join(two))])).collect()}
    assert got == {(1, 1, 30, 100, 1.0), (2, 1, 30, 100, 1.0)}


def test_alignment_of_passages():
    rng = np.random.default_rng(9)
    w = lambda n: rng.integers(1 << 20, 1 << 62, n, dtype=np.uint64)
    p, q, common = w(60), w(60), w(3)
    # The passages change places; each is found for itself, on both sides.
    lead = substring_dedup.Leader(np.concatenate([w(10), p, w(5), q, w(10)]))
    assert lead.passages(np.concatenate([q, w(2), p]), 5, 75, 46) == [(0, 60, 60), (62, 122, 60)]
    assert lead.own_passages(46) == [(10, 70, 60), (75, 135, 60)]
    # Shingles that the leader has many times go where the passage has them; a stray one does not cut it.
    x = np.concatenate([p[:20], common, p[20:], w(4)])
    lead = substring_dedup.Leader(np.concatenate([common, w(9), common, x, common, q[:1]]))
    own = x.copy()
    own[30] = q[0]
    assert lead.passages(own, 5, 75, 46) == [(0, len(x), len(x) - 1)]
    # A text of one shingle only, and one with nothing in common.
    lead = substring_dedup.Leader(np.full(80, 7, np.uint64))
    assert lead.passages(np.full(70, 7, np.uint64), 5, 75, 46) == [(0, 70, 70)]
    assert lead.passages(w(70), 5, 75, 46) == [] == substring_dedup.Leader(w(0)).passages(w(70), 5, 75, 46)
    # Words put in or left out on either side count as gaps.
    lead = substring_dedup.Leader(np.concatenate([p[:30], w(15), p[30:]]))
    assert lead.passages(p, 5, 75, 46) == [(0, 60, 60)] and lead.own_passages(46) == [(0, 75, 60)]
    assert substring_dedup.Leader(np.concatenate([p[:30], w(40), p[30:]])).passages(p, 5, 75, 46) == []


def test_runs_against_all_stretches():
    m = np.zeros(80, bool)
    m[0:5] = m[15:40] = m[48:68] = True
    assert substring_dedup.runs(m, 75, 46) == [(15, 68, 45)]
    rng = np.random.default_rng(4)
    for n in range(60):
        m = np.repeat(rng.random(n) < 0.7, rng.integers(1, 5, n))
        ends = [(i, j, int(m[i:j].sum())) for i in range(len(m)) for j in range(i + 1, len(m) + 1) if m[i] and m[j - 1]]
        good = [x for x in ends if x[1] - x[0] >= 6 and 100 * x[2] >= 75 * (x[1] - x[0])]
        far = {}
        for i, j, k in good:
            far[i] = max(far.get(i, (0, 0)), (j, k))
        want, top = [], 0
        for i in sorted(far):
            if far[i][0] > top:
                top = far[i][0]
                want.append((i, *far[i]))
        assert substring_dedup.runs(m, 75, 6) == want


# --- 9: fingerprints


def test_keys_sort_as_numbers():
    rng = np.random.default_rng(1)
    ids, marks = rng.integers(-(2**63), 2**63 - 1, 500), rng.integers(-(2**63), 2**63 - 1, 500)
    ids[:300] = ids[0]
    assert (np.argsort(fingerprints.sort_keys(ids, marks)) == np.lexsort((marks, ids))).all()


def brute_sample(text, k):
    """The least term of one consistent weighted sample, from the formulas, with the library's own uniforms."""
    best = None
    for w, n in Counter(toks(text)).items():
        h = core.Words(np.frombuffer(w, np.uint8), np.array([0, len(w)])).hash + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64)
        (u1, u2, b), (u3, u4, _) = (tuple(float(u[0]) for u in fingerprints._uniforms(x)) for x in (core.mix(h), core.mix(core.mix(h) + np.uint64(0xD1B54A32D192ED03))))
        r, c = -math.log(u1) - math.log(u2), -math.log(u3) - math.log(u4)
        t = math.floor(math.log(n) / r + b)
        a = c / math.exp(r * (t - b)) / math.exp(r)
        best = min(best or (math.inf,), (a, w, t))
    return best[1:]


def test_samples_equal_brute_force():
    """Two texts share a place just where the brute-force samples are one and the same term and step."""
    rng = random.Random(3)
    texts = [" ".join(words(rng, 40, 60)) for _ in range(6)]
    p = fingerprints.fingerprints(*fingerprints._encode(texts), 48)
    want = [[brute_sample(t, k) for k in range(48)] for t in texts]
    same = [(a, b, k) for a in range(6) for b in range(a) for k in range(48)]
    agree = sum((p[a, k] == p[b, k]) == (want[a][k] == want[b][k]) for a, b, k in same)
    assert agree >= len(same) - 2 and 50 < sum(want[a][k] == want[b][k] for a, b, k in same) < len(same)


@pytest.mark.parametrize("room", [1, 2000, 4 << 20])
def test_neighbours(docs, room):
    rows = [tuple(r) for r in core.id_text(docs).orderBy("doc_id", F.xxhash64("text")).collect()]
    found = fingerprints.compare_neighbours(docs, room=room).collect()
    got = sorted((core.NULL_ID if r.doc_id is None else r.doc_id, r.edited_sha256, r.n_chars, r.fingerprint) for r in found)
    # The likenesses are the shares of equal places of the fingerprints.
    place = lambda x: [x[k : k + 4] for k in range(0, 4 * fingerprints.SAMPLES, 4)]
    share = lambda x, y: sum(p == q for p, q in zip(place(x), place(y), strict=True)) / fingerprints.SAMPLES
    prints = dict(zip([t for _, t in rows], fingerprints.hexed(fingerprints.fingerprints(*fingerprints._encode([t for _, t in rows]))), strict=True))
    following = defaultdict(set)
    for k, (i, t) in enumerate(rows):
        following[i, prints[t]].add(round(share(prints[t], prints[rows[(k + 1) % len(rows)][1]]), 6))
    for r in found:
        assert r.near_edited == share(r.fingerprint, r.edited_fingerprint)
        assert round(r.near_next, 6) in following[core.NULL_ID if r.doc_id is None else r.doc_id, r.fingerprint]
    want = []
    for k, (i, t) in enumerate(rows):
        new = t[: len(t) - len(t) // 2] + rows[(k + 1) % len(rows)][1][: len(t) // 2]
        want.append((i, hashlib.sha256(new.encode()).hexdigest(), len(t)))
    assert [g[:3] for g in got] == sorted(want)
    alone = {(core.NULL_ID if r.doc_id is None else r.doc_id, r.fingerprint) for r in fingerprints.fingerprint(docs).collect()}
    assert {(g[0], g[3]) for g in got} == alone


def test_fingerprints_do_not_depend_on_runs(monkeypatch):
    """Long texts are drawn run by run, the others' terms in runs: whatever their size, the samples are the same."""
    rng = random.Random(12)
    texts = [" ".join(f"t{rng.randrange(4000)}" for _ in range(rng.randrange(900))) for _ in range(60)] + ["", " ".join(f"w{i}" for i in range(3000)), "a a b"]
    want = fingerprints.fingerprints(*fingerprints._encode(texts))
    for run in (64, 500, 5000):
        monkeypatch.setattr(fingerprints, "RUN", run)
        assert (fingerprints.fingerprints(*fingerprints._encode(texts)) == want).all()


def test_fingerprint_of_a_text_of_many_words_is_bounded():
    """A million distinct words: beyond the peak of splitting the text, sampling adds a run's samples at most, not a million's (512 MB)."""
    import tracemalloc

    data, off = fingerprints._encode([" ".join(f"w{i}" for i in range(1_000_000))])

    def peak(f):
        tracemalloc.start()
        f(data, off)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    core.Words(data, off)  # fills the table of powers, which stays
    assert peak(fingerprints.fingerprints) <= peak(core.Words) + (64 << 20)


def test_ranges_stream_through_fewer_tasks(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"word{i} and {i % 7}") for i in range(200)], "doc_id long, text string")
    want = sorted(map(tuple, fingerprints.compare_neighbours(docs).collect()))
    monkeypatch.setattr(fingerprints, "PARTS", 3)
    assert sorted(map(tuple, fingerprints.compare_neighbours(docs, room=20).collect())) == want

def test_likeness_estimates_generalised_jaccard():
    rng = random.Random(8)
    texts = [" ".join(f"t{i // 2}{x}" for x in words(rng, 150, 300)) for i in range(120)]
    mixed = [t[: len(t) // 2] + u[len(u) // 2 :] for t, u in zip(texts[::2], texts[1::2], strict=True)]
    p = fingerprints.fingerprints(*fingerprints._encode(texts[::2] + mixed), 256)
    near = fingerprints.likeness(p[:60], p[60:])
    true = []
    for t, u in zip(texts[::2], mixed, strict=True):
        a, b = Counter(toks(t)), Counter(toks(u))
        true.append(sum((a & b).values()) / sum((a | b).values()))
    assert abs(near - true).mean() < 0.04 and abs((near - true).mean()) < 0.012
    one = fingerprints.fingerprints(*fingerprints._encode(["a b", "A  b\n", "", " "]))
    assert (one[0] == one[1]).all() and (one[2] == fingerprints.NONE).all() and (one[0] != fingerprints.NONE).all()


# --- 10: personal data


def brute_pii(t):
    out = [(m.start(), 0, m.end()) for m in pii.EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in pii.IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in pii.CARD.finditer(t):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in pii.PHONE.finditer(t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_base_spans():
    rng = random.Random(1)
    for _ in range(20_000):
        t = "".join(rng.choice("ab.@-+12345 ()é") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t) == brute_pii(t), t
    for t in ("a@b.c", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111 +1 (555) 123-4567", "x" * 5000 + "@" * 50 + "a.b", "9" * 6000, "1.1.1." + "0" * 5000 + "7"):
        if len(t) < 5000 or "@" in t:
            assert pii.base_spans(t) == brute_pii(t)
        else:
            pii.base_spans(t)


def test_disclosing_terms_and_masks(spark):
    rows = [(i, f"please ask Zyxwv{k} or Qrst{k} about it at zy{k}@corp.example or later {'the words ' * 5}") for i in range(6) for k in [i % 2]]
    rows += [(100 + i, f"please ask anybody about it at home or later the words number {i}") for i in range(200)]
    rows += [(300, "zyxwv0 alone"), (301, "zyxwv1 alone"), (400, None), (401, ""), (None, "ring +1 555 123 4567 now")]
    docs = frame(spark, rows)
    got = {r.doc_id: r for r in pii.find_pii(docs).collect()}
    assert len(got) == len(rows) and got[400].spans == [] and got[core.NULL_ID].n_phone == 1
    for i in range(6):
        text = dict(rows)[i]
        kinds = {text[s.s : s.e]: pii.KINDS[s.k] for s in got[i].spans}
        # Of 211 documents 3 have the entity; a term in 4, 3 of them with it, tells nearly all of it.
        assert kinds == {f"zy{i % 2}@corp.example": "email", f"Zyxwv{i % 2}": "generalise", f"Qrst{i % 2}": "remove"}
    out = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert out[0].startswith("please ask [CODE] or  about it at [EMAIL] or later") and out[100] == dict(rows)[100] and out[None] == "ring [PHONE] now"
    assert pii.sanitise(docs).columns == docs.columns


def test_disclosing_terms_are_masked_away_from_the_mention(spark):
    rows = [(i, f"Zyxwv wrote this {'and so on ' * 5} write to Zyxwv at zy@corp.example {'and so on ' * 5} yours Zyxwv") for i in range(4)]
    rows += [(100 + i, f"wrote this and so on write to him at home yours number {i}") for i in range(200)]
    out = {r.doc_id: r.text for r in pii.sanitise(frame(spark, rows)).collect()}
    assert all("[EMAIL]" in out[i] and "Zyxwv" not in out[i] for i in range(4)) and out[100] == dict(rows)[100]


def brute_terms(rows, alpha=pii.ALPHA, support=pii.SUPPORT):
    """{entity: {term: kind}} by whole documents, from the definition."""
    docs, shape_in = defaultdict(lambda: (set(), set())), defaultdict(set)
    for i, t in rows:
        spans, t = brute_pii(t or ""), t or ""
        docs[i][0].update((k, t[s:e].lower()) for s, k, e in spans)
        for m in re.finditer(r"[^\x20\x09-\x0D]+", t):
            shape_in[pii.shape_of(m[0])].add(i)
            if not any(s < m.end() and m.start() < e for s, _, e in spans):
                docs[i][1].add(m[0].lower())
    n = len(docs)
    words_in = defaultdict(set)
    for i, t in rows:
        for w in toks(t):
            words_in[w.decode()].add(i)
    n_e = Counter(e for es, _ in docs.values() for e in es)
    n_et = Counter((e, t) for es, ts in docs.values() for e in es for t in ts)
    out = defaultdict(dict)
    for (e, t), k in n_et.items():
        ic, df = math.log(n / n_e[e]), len(words_in[t])
        if k >= support and ic > 0 and math.log(n * k / (n_e[e] * df)) >= alpha * ic - 1e-12:
            out[e][t] = "remove" if k >= df else "generalise"
    return out, {s: len(i) for s, i in shape_in.items()}, n, n_e


def test_disclosing_terms_equal_brute_force(spark):
    """Random documents, some of them repeated rows, one id with different texts, terms far from the mentions."""
    rng = random.Random(12)
    rows = []
    for i in range(260):
        w = [f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(rng.randint(5, 60))]
        k = rng.randrange(12)
        if i % 4 == 0:
            w.insert(rng.randrange(len(w)), f"user{k}@mail.example")
            w += rng.choice([[], [f"Term{k}"], [f"Term{k}", f"Mark{k}"], [f"term{k}", f"BIG{k}"]])
        elif i % 9 == 0:
            w.insert(0, f"Term{k}")
        rows.append((i, " ".join(w)))
    rows += rows[:60:4] * 3 + [(4, "user1@mail.example and Term1 and MARK1 again"), (None, None), (None, "user2@mail.example Term2")]
    want, cover, n, n_e = brute_terms(rows)
    kinds = {k for x in want.values() for k in x.values()}
    assert kinds == {"remove", "generalise"} and sum(map(len, want.values())) >= 8
    got = pii.find_pii(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    seen = 0
    for r in got:
        for t in {t or "" for i, t in rows if (core.NULL_ID if i is None else i) == r.doc_id}:
            own = {(k, t[s:e].lower()) for s, k, e in brute_pii(t)}
            expect = set()
            for m in re.finditer(r"[^ ]+", t):
                hits = [(e, want[e][m[0].lower()]) for e in own if m[0].lower() in want[e]]
                if hits and not any(s < m.end() and m.start() < e for s, _, e in brute_pii(t)):
                    floor = max(n_e[e] for e, _ in hits) ** pii.ALPHA * n ** (1 - pii.ALPHA)
                    expect.add((m.start(), "remove" if any(k == "remove" for _, k in hits) or cover[pii.shape_of(m[0])] <= floor else "generalise"))
            if {(x.s, pii.KINDS[x.k]) for x in r.spans if x.k >= 4} == expect:
                seen += 1
                break
    assert seen == len(rows)
    out = pii.sanitise(frame(spark, rows)).collect()
    assert len(out) == len(rows) and not [r.text for r in out if "@" in r.text]


def test_related_entities_equal_brute_force(spark):
    """Accounts, hosts and networks are protected too: a host's name beside its addresses goes, a repeated row changes nothing."""
    rng = random.Random(8)
    rows = [(i, f"mail acct{i}@host{i % 3}.example the Firm{i % 3} desk word{rng.randrange(40)} from 10.0.{i % 4}.{i} rack{i % 4}x{i % 2}") for i in range(36)]
    rows += [(100 + i, f"mail the desk word{rng.randrange(40)} from here") for i in range(300)]

    def parts(k, v):
        return {(k, v), *({("account", v.split("@")[0]), ("host", v.split("@")[1])} if k == 0 else {("network", v.rsplit(".", 1)[0])} if k == 1 else ())}

    own = {i: set().union(*[parts(k, t[s:e]) for s, k, e in brute_pii(t)]) for i, t in rows}
    words = {i: {w.decode() for w in toks(t) if not re.search(rb"@|\.", w)} for i, t in rows}
    n_e, n_t = Counter(e for x in own.values() for e in x), Counter(w for x in words.values() for w in x)
    n_et = Counter((e, w) for i in own for e in own[i] for w in words[i])
    bad = {x for x, k in n_et.items() if k >= 2 and n_e[x[0]] < len(rows) and math.log(len(rows) * k / (n_e[x[0]] * n_t[x[1]])) >= pii.ALPHA * math.log(len(rows) / n_e[x[0]]) - 1e-12}
    want = {i: {w for w in words[i] if any((e, w) in bad for e in own[i])} for i in own}
    assert {"firm0", "firm1", "firm2"} <= set().union(*want.values())
    for more in ([], rows[:1]):
        got = pii.find_pii(frame(spark, rows + more), related=True).collect()
        texts = dict(rows)
        assert all({texts[r.doc_id][x.s : x.e].lower() for x in r.spans if x.k >= 4} == want[r.doc_id] for r in got)
    assert not any(x.k >= 4 and "Firm" in texts[r.doc_id][x.s : x.e] for r in pii.find_pii(frame(spark, rows)).collect() for x in r.spans)


def test_repeated_rows_change_no_finding(spark):
    rows = [(i, f"ask Zyxwv{k} or Qrst{k} at zy{k}@corp.example") for i in range(6) for k in [i % 2]] + [(100 + i, f"ask anybody or at home number {i}") for i in range(200)]
    find = lambda x: {(r.doc_id, str(r.spans)) for r in pii.find_pii(frame(spark, x)).collect()}
    assert find(rows) == find(rows + rows[:6] * 2)


def test_shapes():
    assert [pii.shape_of(x) for x in ("12.5", "a1", "word", "ABC", "Name", "A", "iPhone", "...", "é", "Éa")] == ["[NUMBER]", "[CODE]", "[WORD]", "[CAPITALS]", "[NAME]", "[NAME]", "[TERM]", "[TERM]", "[WORD]", "[WORD]"]


# --- all of them


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    path = packing.tokenizer_path
    made = [
        jaccard_join.jaccard_components(empty), line_dedup.dedup_lines(empty), bpe.encode_documents(empty, path("word_bpe_49k.json")), compression_rules.compression_rules(empty),
        maxent_lm.score_documents(empty), quality_classifier.classify(empty, labels), packing.pack_documents(empty, path("byte_bpe_50k.json")), substring_dedup.repeated_passages(empty),
        fingerprints.compare_neighbours(empty), fingerprints.fingerprint(empty), pii.find_pii(empty), pii.sanitise(empty), jaccard_join.keep_one(empty),
    ]
    assert [df.count() for df in made] == [0] * len(made)


def test_columns_that_differ_by_case_only(spark):
    rows = [(i, f"a line that is the same\nand number {i} ends user{i}@mail.example", f"T{i}", f"l{i}", f"L{i}", 0) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, TEXT string, lang string, Lang string, n_chars int")
    labels = spark.createDataFrame([(i, 1) for i in range(5)], "doc_id long, quality int")
    for made in (core.like(line_dedup.dedup_lines(docs), docs), pii.sanitise(docs), jaccard_join.keep_one(docs), quality_classifier.good_only(docs, labels)):
        assert made.columns == docs.columns
        assert {(r[0], r[2], r[3], r[4]) for r in made.collect()} <= {(r[0], r[2], r[3], r[4]) for r in rows}
    n = [x.count() for x in (jaccard_join.jaccard_components(docs), maxent_lm.score_documents(docs), fingerprints.compare_neighbours(docs), compression_rules.compression_rules(docs), pii.find_pii(docs))]
    assert n == [5] * 5


def test_very_long_text(spark):
    rng = random.Random(3)
    long = " ".join(words(rng, 600_000, 50_000)) + "\nmail me@example.com please"
    docs = frame(spark, [(1, long), (2, long), (3, "short text of a few words")], 1)
    assert {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs).collect()} == {1: 1, 2: 1, 3: 3}
    assert {r.doc_id: r.n_dropped for r in line_dedup.dedup_lines(docs).collect()} == {1: 0, 2: 2, 3: 0}
    assert {r.doc_id: r.n_email for r in pii.find_pii(docs).collect()} == {1: 1, 2: 1, 3: 0}
    assert {r.doc_id for r in substring_dedup.repeated_passages(docs).collect()} == {1, 2}
    assert compression_rules.compression_rules(docs).where("doc_id = 1").first().n_words == 600_003
    assert {r.doc_id: r.n_tokens for r in maxent_lm.score_documents(docs).collect()} == {1: 600_004, 2: 600_004, 3: 7}
    path = packing.tokenizer_path
    assert len({r.ids_sha256 for r in bpe.encode_documents(docs, path("word_bpe_49k.json"), digests=True).collect()}) == 2
    made = packing.pack_documents(docs, path("byte_bpe_50k.json")).collect()
    assert len({r.ids_crc32 for r in made if r.doc_id == 1 and r.piece == 0} | {r.ids_crc32 for r in made if r.doc_id == 2 and r.piece == 0}) == 1 and max(r.length for r in made) == 2048
    near = {r.doc_id: r for r in fingerprints.compare_neighbours(docs).collect()}
    assert near[1].near_next == 1.0 and near[1].fingerprint == near[2].fingerprint and near[2].near_next < 0.1
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")
    assert quality_classifier.scores(docs, labels).count() == 3


def test_ip_pattern_on_runs_of_digits():
    """The same matches as the plain pattern, in linear time."""
    import time

    plain, rng = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), random.Random(5)
    for _ in range(3000):
        t = "".join(rng.choice("019..a ") for _ in range(40))
        assert [m.span() for m in pii.IP.finditer(t)] == [m.span() for m in plain.finditer(t)]
    began = time.perf_counter()
    assert list(pii.IP.finditer("1.2" + "7" * 1_000_000 + " 1.2.3.4"))[0][0] == "1.2.3.4"
    assert time.perf_counter() - began < 1
