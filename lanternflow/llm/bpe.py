"""BPE encoding and decoding by a pair occurrence index.

A partition's new words are laid out in one array of symbols.  The index maps
each adjacent pair to all its places there.  Ranks that occur are kept in a
heap and applied in ascending order: the places of the lowest pair are merged
at once, and only the lists of the pairs to the left and right of them change.
Each distinct word is encoded once and its ids are kept, so that encoding a
document is a look-up for each word; decoding goes from the ids to the text.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lanternflow.llm import core
from lanternflow.llm.core import column, numbers
from lanternflow.llm.packing import tokenizer_path

#: Words kept by a Python worker.
CACHE = 400_000

# This vocabulary folds white space, lower-cases, and takes these pieces; spelt for characters up to U+024F.
_L = "a-zªµºß-öø-ɏ"
_N = "0-9²³¹¼-¾"
_S = "\t-\r \u0085 "
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+"


class PairMerges:
    """Merge rules as arrays: a pair of symbols -> rank, and a rank -> the symbol it makes."""

    def __init__(self, model: dict) -> None:
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.width = max(self.vocab.values()) + 1
        self.token = [""] * self.width
        for t, i in self.vocab.items():
            self.token[i] = t
        pairs, made = [], []
        for m in model["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            pairs.append(self.vocab[a] * self.width + self.vocab[b])
            made.append(self.vocab[a + b])
        self.made = np.array(made, np.int64)
        order = np.argsort(np.array(pairs, np.int64), kind="stable")
        self.pairs, self.ranks = np.array(pairs, np.int64)[order], order

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or -1."""
        code = left * self.width + right
        at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
        return np.where(self.pairs[at] == code, self.ranks[at], -1)

    def encode(self, words: list[list[int]]) -> list[list[int]]:
        """Symbols of each word to token ids.

        Symbols are linked both ways so that a merge costs its own places
        only.  A list of places may hold stale ones; they are told by the pair
        found there now.
        """
        lengths = np.array([len(w) for w in words], np.int64)
        n = int(lengths.sum())
        if not n:
            return [[] for _ in words]
        sym = np.fromiter((s for w in words for s in w), np.int64, n)
        word = np.repeat(np.arange(len(words)), lengths)
        nxt = np.arange(1, n + 1)
        ends = np.cumsum(lengths) - 1
        nxt[ends[lengths > 0]] = n
        prv = np.arange(-1, n - 1)
        prv[(ends - lengths + 1)[lengths > 0]] = -1
        alive = np.ones(n, bool)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(at: np.ndarray) -> None:
            at = at[(at >= 0)]
            at = at[nxt[at] < n]
            if not len(at):
                return
            r = self.rank(sym[at], sym[nxt[at]])
            at, r = at[r >= 0], r[r >= 0]
            if not len(at):
                return
            order = np.argsort(r, kind="stable")
            at, r = at[order], r[order]
            cut = np.flatnonzero(np.diff(r, prepend=-1))
            for k, s, e in zip(r[cut].tolist(), cut.tolist(), [*cut[1:].tolist(), len(r)], strict=True):
                if k in index:
                    index[k].append(at[s:e])
                else:
                    index[k] = [at[s:e]]
                    heapq.heappush(heap, k)

        add(np.arange(n))
        left, right = np.full(len(self.made), -1), np.full(len(self.made), -1)
        left[self.ranks], right[self.ranks] = np.divmod(self.pairs, self.width)
        while heap:
            k = heapq.heappop(heap)
            lists = index.pop(k)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            a, b = left[k], right[k]
            at = at[alive[at] & (sym[at] == a)]
            at = at[nxt[at] < n]
            at = at[sym[nxt[at]] == b]
            if a == b and len(at) > 1:
                # In a run like "aaa" every second place merges, from the left.
                at = np.sort(at)
                run = np.zeros(len(at), np.int64)
                follows = nxt[at[:-1]] == at[1:]
                start = np.flatnonzero(~np.concatenate([[False], follows]))
                run = np.arange(len(at)) - np.repeat(start, np.diff(np.append(start, len(at))))
                at = at[run % 2 == 0]
            if not len(at):
                continue
            gone = nxt[at]
            sym[at] = self.made[k]
            alive[gone] = False
            after = nxt[gone]
            nxt[at] = after
            prv[after[after < n]] = at[after < n]
            before = prv[at]
            # Where merges stand side by side, "before" and "at" name the same pair twice; the heap's step removes that.
            add(np.unique(np.concatenate([before[before >= 0], at])))
        ids, word = sym[alive].tolist(), word[alive]
        cut = np.searchsorted(word, np.arange(len(words) + 1)).tolist()
        return [ids[s:e] for s, e in zip(cut, cut[1:], strict=False)]


class WordBpe:
    """The tokenizer of a ``tokenizers`` file with word ends: encode to ids, decode to text."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.merges = PairMerges(spec["model"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pieces = re.compile(PIECES).findall
        self.beyond = re.compile("[^\x00-ɏ]").search
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split
        # The byte-level alphabet: printable bytes stand for themselves, the others for U+0100 and on, in order.
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in own]
        letter = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}
        v, end = self.merges.vocab, self.merges.suffix
        self.inner = [v[letter[b]] for b in range(256)]
        self.final = [v[letter[b] + end] for b in range(256)]
        self.names = [*self.merges.token]
        for t, i in self.special.items():
            self.names += [""] * (i + 1 - len(self.names))
            self.names[i] = t
        self.digits = [str(i) for i in range(len(self.names))]
        self.cache: dict[str, list[int]] = {}
        self.path, self._library = path, None

    def split(self, text: str) -> list[str]:
        """The pieces of a text without special tokens."""
        if text.isascii():
            return self.pieces(text.lower())
        if self.beyond(text) is None:
            low = unicodedata.normalize("NFC", text).lower()
            if self.beyond(low) is None:
                return self.pieces(low)
        return self._rare(text)

    def _rare(self, text: str) -> list[str]:
        """Pieces of a text with characters beyond U+024F, by the library's own normaliser and splitter."""
        if self._library is None:
            from tokenizers import Tokenizer, pre_tokenizers

            self._library = Tokenizer.from_file(self.path).normalizer
            with open(self.path, encoding="utf-8") as f:
                split = json.load(f)["pre_tokenizer"]["pretokenizers"][0]
            from tokenizers import Regex

            self._splitter = pre_tokenizers.Split(Regex(split["pattern"]["Regex"]), split["behavior"].lower(), split["invert"])
        return [w for w, _ in self._splitter.pre_tokenize_str(self._library.normalize_str(text))]

    def learn(self, pieces: set[str]) -> None:
        """Encode new pieces together and keep them."""
        new = [p for p in pieces if p not in self.cache]
        if not new:
            return
        inner, final = self.inner, self.final
        symbols = []
        for p in new:
            raw = p.encode()
            symbols.append([*[inner[b] for b in raw[:-1]], final[raw[-1]]])
        self.cache.update(zip(new, self.merges.encode(symbols), strict=True))

    def parts(self, text: str) -> list[str]:
        """Pieces and special tokens of a text, in order."""
        if not any(s in text for s in self.special):
            return self.split(text)
        out: list[str] = []
        for part in self.at_special(text):
            out += [part] if part in self.special else self.split(part)
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text."""
        if len(self.cache) > CACHE:
            self.cache.clear()
        for t, i in self.special.items():
            self.cache[t] = [i]
        split = [self.parts(t) for t in texts]
        self.learn({p for ps in split for p in ps})
        get = self.cache.__getitem__
        return [list(chain.from_iterable(map(get, ps))) for ps in split]

    def decimal(self, ids: list[int]) -> str:
        return " ".join(map(self.digits.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """The tokens joined by a space, special ones included; the vocabulary has no other decoder.  Unknown ids are left out."""
        names, n = self.names, len(self.names)
        return " ".join([names[i] for i in ids if i < n and names[i]])


_loaded: dict[str, WordBpe] = {}


def word_bpe(path: str) -> WordBpe:
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def _encoder(path: str):
    def fn(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, texts = numbers(b, "doc_id"), column(b, "text")
        for i, j in core.steps(core.text_bytes(texts)[1], 4 << 20):
            bpe = word_bpe(path)
            rows = bpe.encode(texts[i:j].to_pylist())
            yield core.batch_of(doc_id=ids[i:j], n_tokens=np.array([len(r) for r in rows], np.int64), ids=pa.array([bpe.decimal(r) for r in rows]), decoded=pa.array([bpe.decode(r) for r in rows]))

    return fn


def _digester(path: str):
    sha = hashlib.sha256

    def fn(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, texts = numbers(b, "doc_id"), column(b, "text")
        for i, j in core.steps(core.text_bytes(texts)[1], 4 << 20):
            bpe = word_bpe(path)
            rows = bpe.encode(texts[i:j].to_pylist())
            yield core.batch_of(
                doc_id=ids[i:j], n_tokens=np.array([len(r) for r in rows], np.int64),
                ids_sha256=pa.array([sha(bpe.decimal(r).encode()).hexdigest() for r in rows]), decoded_sha256=pa.array([sha(bpe.decode(r).encode()).hexdigest() for r in rows]),
            )

    return fn


def encode_documents(docs: DataFrame, tokenizer: str, digests: bool = False) -> DataFrame:
    """Encode and decode each text; one narrow pass.

    Returns doc_id, n_tokens, ids (decimal, joined by a space) and decoded; or
    with ``digests`` the SHA-256 of both instead, made where the text is.  Null
    or empty text: no ids, empty decoded text.  Very long texts are encoded
    whole.  Repeated rows are encoded alike; a null doc_id stays null; an empty
    table gives an empty table.
    """
    out = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids string, decoded string")
    return core.give_back_ids(core.arrow_map(core.id_text(docs), (_digester if digests else _encoder)(tokenizer), out))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(core.documents(spark, sf_dir).select("doc_id", "text"), tokenizer_path("word_bpe_49k.json"), digests=True)


QUERIES = {"op3_bpe": op3_bpe}
SQL: dict[str, str] = {}
