"""Personal data: fixed patterns, and terms that disclose them by corpus statistics.

The base finds e-mail addresses, IP addresses, card and phone numbers.  Each
value found is a protected entity; on demand (``related``) so are the host and the
account of an address and the network of an IP, which recur in more documents
than whole values do.  A term discloses an entity when the two go together
far more than by chance; it is then masked wherever it stands in a document
with the entity.  With counts of documents,

    PMI(e; t) = log(N * n(e,t) / (n(e) * n(t)))  >=  alpha * IC(e),  IC(e) = log(N / n(e)),

the information-theoretic condition for t to give away the share alpha of what
naming e would.  n(e), n(e,t) and n(t) cover all documents and whole texts; a
document is an id, however many rows it has.

Terms that give away everything (they occur in no document without the entity)
are removed.  The others that exceed the threshold are generalised to their
shape (a name, a word, a code ...), if the shape stays under the threshold
itself: it stands in n(s) documents, so it gives away log(N / n(s)) at most.  A
shape that is too rare is no cover, and its terms are removed.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternflow.llm import core
from lanternflow.llm.core import column, numbers

# The kinds in their order, and their patterns.
KINDS = ("email", "ip", "card", "phone", "generalise", "remove")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A run of digits that fails from its first digit fails from all others; starting there alone keeps a long run linear.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MASK = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}
#: What a term is generalised to, by its shape: digits; digits and letters; small letters; capitals; a capital first; anything else.
SHAPES = ("[NUMBER]", "[CODE]", "[WORD]", "[CAPITALS]", "[NAME]", "[TERM]")

_DIGITS = re.compile("[^0-9]")
_DOTTED = re.compile(r"[0-9]\.[0-9]").search
_LONG = re.compile(r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]").search
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
ALPHA, SUPPORT = 0.9, 2
#: Pairs of entity and term that a step makes before it adds them up.
PAIRS = 2_000_000
_ALONE = -(2**63)
#: Bits of the filter over candidate terms that is broadcast (1 MB); false hits are removed by a join.
FILTER_BITS = 1 << 23


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The matches of EMAIL, tried only where a run of its first characters ends at an @."""
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        if m:
            yield m.span()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the base's finds, by start and kind."""
    found = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if _DOTTED(text):
        found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    if _LONG(text):
        for m in CARD.finditer(text):
            digits = _DIGITS.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(_DIGITS.sub("", m[0])) <= 15]
    return sorted(found)


def entity(kind: int, value: str) -> int:
    """A protected entity: numbers by their digits, addresses in lower case."""
    value = _DIGITS.sub("", value) if kind >= 2 else value.lower()
    return xxhash.xxh3_64_intdigest(f"{kind}:{value}") - 2**63


def related_entities(kind: int, value: str) -> list[int]:
    """What a value shares with others: an address's account and host, an IP's network."""
    if kind > 1:
        return []
    parts = {"account": value.lower().split("@")[0], "host": value.lower().split("@")[1]} if kind == 0 else {"network": value.rpartition(".")[0]}
    return [xxhash.xxh3_64_intdigest(f"{k}:{v}") - 2**63 for k, v in parts.items()]


def entities_of(text: str, spans: list[tuple[int, int, int]], related: bool) -> set[int]:
    found = {entity(k, text[s:e]) for s, k, e in spans}
    return found.union(*[related_entities(k, text[s:e]) for s, k, e in spans]) if related else found


def clear_words(text: str, spans: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(term, start, end) of the words, in code points, and which are clear of all spans."""
    raw = np.frombuffer(text.encode(), np.uint8)
    words = core.Words(raw, np.array([0, len(raw)]))
    point = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=point[1:])
    start, end = point[words.start], point[words.end]
    clear = np.ones(len(start), bool)
    for s, _, e in spans:
        clear[np.searchsorted(end, s, "right") : np.searchsorted(start, e, "left")] = False
    return words.hash.view(np.int64), start, end, clear


_UPPER, _DIGIT = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91], _DIGIT[48:58] = True, True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def shapes(words: core.Words) -> np.ndarray:
    """The shape of each word (its place in ``SHAPES``); letters beyond ASCII count as small ones.  ``words`` keep their case."""
    if not len(words.start):
        return np.zeros(0, np.int64)
    cut = np.stack([words.start, words.end], axis=1).ravel()
    count = lambda m: np.add.reduceat(np.append(m[words.data], False).astype(np.int32), cut)[::2]
    upper, digit, letter = count(_UPPER), count(_DIGIT), count(_LETTER)
    first = _UPPER[words.data[words.start]]
    return np.select([(digit > 0) & (letter == 0), digit > 0, letter == 0, upper == 0, (upper == letter) & (upper > 1), first & (upper == 1)], [0, 1, 5, 2, 3, 4], 5)


_SPAN = "array<struct<s:int,k:int,e:int>>"
_FOUND = f"doc_id long, mark long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base {_SPAN}, entities array<long>"
_SPANS = pa.list_(pa.struct([("s", pa.int32()), ("k", pa.int32()), ("e", pa.int32())]))


def _find(related: bool):
    def fn(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        empty = hashlib.sha256(b"").hexdigest()
        rows: dict[str, list] = {k: [] for k in ("count", "sha", "base", "entities")}
        for t in column(b, "text").to_pylist():
            spans = base_spans(t)
            rows["count"].append([sum(k == x for _, k, _ in spans) for x in range(4)] if spans else [0, 0, 0, 0])
            rows["sha"].append(hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest() if spans else empty)
            rows["base"].append([{"s": s, "k": k, "e": e} for s, k, e in spans])
            rows["entities"].append(sorted(entities_of(t, spans, related)))
        n = np.array(rows["count"], np.int64).reshape(-1, 4)
        yield core.batch_of(
            doc_id=numbers(b, "doc_id"), mark=numbers(b, "mark"), n_email=n[:, 0].copy(), n_ip=n[:, 1].copy(), n_card=n[:, 2].copy(), n_phone=n[:, 3].copy(),
            base_sha256=pa.array(rows["sha"], pa.string()), base=pa.array(rows["base"], _SPANS), entities=pa.array(rows["entities"], pa.list_(pa.int64())),
        )

    return fn


def _slots(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return t & (FILTER_BITS - 1), (t >> np.int64(23)) & (FILTER_BITS - 1)


def _in_filter(bits: bytes, t: np.ndarray) -> np.ndarray:
    has = np.frombuffer(bits, np.uint8)
    one, two = _slots(t)
    return ((has[one >> 3] >> (one & 7)) & (has[two >> 3] >> (two & 7)) & 1).astype(bool)


def _term_filter(spark: SparkSession, t: DataFrame):
    """A broadcast bit filter over the terms of ``t``, of fixed size."""
    slot = lambda x: x.bitwiseAND(F.lit(FILTER_BITS - 1))
    slots = t.select(F.explode(F.array(slot(F.col("t")), slot(F.shiftright("t", 23)))).alias("at"))
    return spark.sparkContext.broadcast(core.bit_filter(slots, FILTER_BITS))


def _own_terms(text: str) -> np.ndarray:
    term, _, _, clear = clear_words(text, base_spans(text))
    return np.unique(term[clear])


def _common_terms(repeated):
    """Documents with entities to the terms of their texts and, for each, the documents; those of ids that may repeat come with the id."""

    def fn(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        every = [_own_terms(t) for t in column(b, "text").to_pylist()]
        one = core.in_id_filter(repeated.value, numbers(b, "at"))
        t, n = np.unique(np.concatenate([np.zeros(0, np.int64), *[x for x, again in zip(every, one, strict=True) if not again]]), return_counts=True)
        yield _sent(t, n)
        for x, i in zip([x for x, again in zip(every, one, strict=True) if again], numbers(b, "doc_id")[one].tolist(), strict=True):
            yield core.batch_of(t=x, n=np.zeros(len(x), np.int64), doc_id=np.full(len(x), i))

    return fn


def _term_counts(terms, repeated):
    """Documents with each term of the filter (t) and each shape (below 0: -1 - shape); rows of ids that may repeat are told one by one.

    Counts are added up over the whole task, so it sends each term about once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for b in batches:
            ids = numbers(b, "doc_id")
            data, off = core.text_bytes(column(b, "text"))
            one = core.in_id_filter(repeated.value, numbers(b, "at"))
            for i, j in core.steps(off):
                words, cased = core.Words(data, off[i : j + 1]), core.Words(data, off[i : j + 1], lower=False)
                hit = _in_filter(terms.value, words.hash.view(np.int64))
                h, first = core.unique_per_doc(words.hash[hit], words.doc[hit], j - i)
                kind = np.zeros((j - i, len(SHAPES)), bool)
                kind[cased.doc, shapes(cased)] = True
                doc, shape = np.nonzero(kind)
                t = np.concatenate([h.view(np.int64), -1 - shape])
                doc = np.concatenate([np.repeat(np.arange(j - i), np.diff(first)), doc])
                alone = ~one[i:j][doc]
                if not alone.all():
                    told = t[~alone]
                    yield core.batch_of(t=told, n=np.zeros(len(told), np.int64), doc_id=ids[i:j][doc[~alone]])
                held.append(np.unique(t[alone], return_counts=True))
                size += len(held[-1][0])
                if size > PAIRS:
                    held = [_added(held)]
                    size = len(held[0][0])
                    if size > PAIRS // 2:
                        yield _sent(*held.pop())
                        size = 0
        if held:
            yield _sent(*_added(held))

    return run


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Partial counts of terms as one."""
    t, back = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
    return t, np.bincount(back, np.concatenate([n for _, n in parts]), len(t)).astype(np.int64)


def _sent(t: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return core.batch_of(t=t, n=n.astype(np.int64), doc_id=pa.nulls(len(t), pa.int64()))


def _pair_counts(terms, repeated):
    """Documents (text, and their entities) to pairs of entity and term of the filter, added up here before they are shuffled; those of ids that may repeat come with the id."""

    def fn(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        wait: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            pair, n = np.unique(np.concatenate(wait), axis=0, return_counts=True)
            wait.clear()
            alone = pair[:, 2] == _ALONE
            return core.batch_of(e=pair[:, 0].copy(), t=pair[:, 1].copy(), n=np.where(alone, n, 0), doc_id=pa.array(pair[:, 2], mask=alone))

        one = core.in_id_filter(repeated.value, numbers(b, "at"))
        for text, own, i, again in zip(column(b, "text").to_pylist(), column(b, "entities").to_pylist(), numbers(b, "doc_id").tolist(), one.tolist(), strict=True):
            t = _own_terms(text)
            t = t[_in_filter(terms.value, t)]
            for e in own if len(t) else ():
                wait.append(np.stack([np.full(len(t), e), t, np.full(len(t), i if again else _ALONE)], axis=1))
                size += len(t)
                if size > PAIRS:
                    yield flush()
                    size = 0
        if wait:
            yield flush()

    return fn


def _documents(counted: DataFrame, *keys: str) -> DataFrame:
    """Documents for each key from partial counts n (doc_id null) and single rows with an id, which count once."""
    each = counted.groupBy(*keys, "doc_id").agg(F.sum("n").alias("n"))
    return each.groupBy(*keys).agg(F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(1)).alias("n"))


def _is_disclosing(n_et: Column, n_e: Column, n_t: Column, total: int, alpha: float) -> Column:
    n_et, n_e, n_t = (F.greatest(x, F.lit(1)).cast("double") for x in (n_et, n_e, n_t))
    pmi, ic = F.log(F.lit(float(max(total, 1))) * n_et / (n_e * n_t)), F.log(F.lit(float(max(total, 1))) / n_e)
    return (ic > 0) & (pmi >= F.lit(alpha) * ic)


def _told(terms, related: bool):
    """Texts of documents with entities to (doc_id, mark, e, t): a text's entities with those of its own terms that disclose something."""

    def fn(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i, mark, text, known in zip(numbers(b, "doc_id").tolist(), numbers(b, "mark").tolist(), column(b, "text").to_pylist(), column(b, "entities").to_pylist(), strict=True):
            spans = base_spans(text)
            term, _, _, clear = clear_words(text, spans)
            t = np.unique(term[clear])
            t = t[_in_filter(terms.value, t)]
            own = np.array(sorted(entities_of(text, spans, related).intersection(known)), np.int64)
            if len(t) and len(own):
                n = len(t) * len(own)
                yield core.batch_of(doc_id=np.full(n, i), mark=np.full(n, mark), e=np.repeat(own, len(t)), t=np.tile(t, len(own)))

    return fn


def disclosing_terms(docs: DataFrame, found: DataFrame, alpha: float, support: int, related: bool) -> tuple[DataFrame, list[int]]:
    """(doc_id, mark, e, t, kind, floor): terms of a text that disclose one of its entities, with the number of their kind; and the documents of each shape.

    Only entities in ``support`` documents or more can have such terms, and a
    term must be in as many with an entity.  n(e,t) is at most n(e), so a term
    discloses nothing if n(t) > n(e)^alpha N^(1 - alpha) for the largest n(e):
    what is left after these two bounds is counted against entities.
    """
    spark = docs.sparkSession
    texts = core.id_text(docs)
    rows = texts.groupBy("doc_id").agg(F.count("*").alias("rows"))
    total, again = rows.agg(F.count("*"), F.sum((F.col("rows") > 1).cast("long"))).first()
    repeated = core.id_filter(spark, rows.where("rows > 1").select(F.col("doc_id").alias("id")) if again else None)
    mentions = found.where(F.size("entities") > 0).select("doc_id", F.explode("entities").alias("e")).distinct()
    entities = core.stored(mentions.groupBy("e").agg(F.count("*").alias("n_e")).where(F.col("n_e") >= support), "entities")
    most = entities.agg(F.max("n_e")).first()[0] or 0
    bound = alpha * math.log(max(most, 1)) + (1 - alpha) * math.log(max(total, 1)) + 1e-9

    # An id's entities; a filter, then a join, brings them to its texts.
    holders = mentions.join(entities.select("e"), "e").groupBy("doc_id").agg(F.collect_list("e").alias("entities"))
    bits = core.id_filter(spark, holders.select(F.col("doc_id").alias("id")))
    picked = core.stored(core.with_slot(core.pick(texts, bits)).join(holders, "doc_id"), "mentions")
    common = _documents(core.arrow_map(picked.select("doc_id", "text", "at"), _common_terms(repeated), "t long, n long, doc_id long"), "t")
    # n(t) is n at least, so terms of very many such documents need not be counted.
    common = common.where((F.col("n") >= support) & (F.log("n") <= bound))
    counted = core.with_slot(texts).mapInArrow(_term_counts(_term_filter(spark, common), repeated), "t long, n long, doc_id long")
    n_t = core.stored(_documents(counted, "t").withColumnRenamed("n", "n_t"), "terms")
    by_shape = {r["t"]: r["n_t"] for r in n_t.where(F.col("t").between(-len(SHAPES), -1)).collect()}

    able = n_t.where(F.log("n_t") <= bound).select("t", "n_t")
    pairs = core.arrow_map(picked, _pair_counts(_term_filter(spark, able), repeated), "e long, t long, n long, doc_id long")
    pairs = _documents(pairs, "e", "t").withColumnRenamed("n", "n_et").where(F.col("n_et") >= support)
    out = pairs.join(entities, "e").join(able, "t").where(_is_disclosing(F.col("n_et"), F.col("n_e"), F.col("n_t"), total, alpha))
    kind = F.when(F.col("n_et") >= F.col("n_t"), F.lit(5)).otherwise(F.lit(4))
    # A shape in at most n(e)^alpha N^(1 - alpha) documents would disclose the entity as well.
    cover = [by_shape.get(-1 - k, 0) for k in range(len(SHAPES))]
    floor = F.pow(F.col("n_e").cast("double"), F.lit(alpha)) * F.lit(float(max(total, 1)) ** (1 - alpha))
    out = core.stored(out.select("e", "t", kind.alias("kind"), floor.alias("floor")), "disclosing")
    # Only terms that a text has meet its entities, so a hot entity makes no more rows than its texts have such terms.
    rows = core.arrow_map(picked.select("doc_id", "text", "entities", F.xxhash64("text").alias("mark")), _told(_term_filter(spark, out), related), "doc_id long, mark long, e long, t long")
    return rows.join(out, ["e", "t"]), cover


def _mark_terms(cover: list[int]):
    """The places of each text's terms, wherever they stand clear of the base's finds."""

    def fn(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        more: list[list[dict]] = []
        for text, terms in zip(column(b, "text").to_pylist(), column(b, "terms").to_pylist(), strict=True):
            rule = {x["t"]: (x["k"], x["f"]) for x in terms}
            term, start, end, clear = clear_words(text, base_spans(text))
            raw = np.frombuffer(text.encode(), np.uint8)
            shape = shapes(core.Words(raw, np.array([0, len(raw)]), lower=False))
            own = []
            for w in np.flatnonzero(clear & np.isin(term, np.fromiter(rule, np.int64, len(rule)))).tolist():
                k, floor = rule[int(term[w])]
                own.append({"s": int(start[w]), "k": 5 if cover[shape[w]] <= floor else k, "e": int(end[w])})
            more.append(own)
        yield core.batch_of(doc_id=numbers(b, "doc_id"), mark=numbers(b, "mark"), more=pa.array(more, _SPANS))

    return fn


def find_pii(docs: DataFrame, alpha: float = ALPHA, support: int = SUPPORT, related: bool = False) -> DataFrame:
    """Find personal data and the terms that disclose it.

    Returns doc_id, mark (a hash of the text), the base's counts and digest,
    and ``spans``: array<struct<s, k, e>> by start and kind (code points, end
    exclusive; k indexes ``KINDS``).  With ``related``, accounts, hosts and
    networks are protected beside whole values.

    Null or empty text: no spans.  Repeated rows get the same spans; rows of
    one id count as one document, whose texts are taken together.  A null
    doc_id is one more document.  A term with ties between entities takes the
    stricter kind.  Very long texts are read whole.  An empty table gives an
    empty table.
    """
    texts = core.id_text(docs).withColumn("mark", F.xxhash64("text"))
    found = core.stored(core.arrow_map(texts, _find(related), _FOUND), "pii")
    told, cover = disclosing_terms(docs, found, alpha, support, related)
    told = told.groupBy("doc_id", "mark", "t").agg(F.max("kind").alias("k"), F.max("floor").alias("f")).groupBy("doc_id", "mark")
    told = core.stored(told.agg(F.collect_list(F.struct("t", "k", "f")).alias("terms")), "told")
    picked = core.pick(core.id_text(docs), core.id_filter(docs.sparkSession, told.select(F.col("doc_id").alias("id"))))
    hold = picked.withColumn("mark", F.xxhash64("text")).join(told, ["doc_id", "mark"]).select("doc_id", "mark", "text", "terms")
    more = core.arrow_map(hold, _mark_terms(cover), f"doc_id long, mark long, more {_SPAN}").groupBy("doc_id", "mark").agg(F.first("more").alias("more"))
    spans = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(_SPAN))))
    return found.drop("entities").join(more, ["doc_id", "mark"], "left").withColumn("spans", spans).drop("more", "base")


def spans_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def shape_of(word: str) -> str:
    raw = np.frombuffer(word.encode(), np.uint8)
    return SHAPES[shapes(core.Words(raw, np.array([0, len(raw)]), lower=False))[0]]


def mask(text: str, spans: list) -> str:
    """The text with each span masked; where spans overlap, the earlier (then the first kind) decides."""
    out, done = [], 0
    for x in spans:
        if x["s"] < done:
            if x["e"] > done:
                done = x["e"]
            continue
        out += [text[done : x["s"]], "" if x["k"] == 5 else shape_of(text[x["s"] : x["e"]]) if x["k"] == 4 else MASK[KINDS[x["k"]]]]
        done = x["e"]
    return "".join([*out, text[done:]])


def _masker(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    texts = [mask(t, s) if s else t for t, s in zip(column(b, "text").to_pylist(), column(b, "spans").to_pylist(), strict=True)]
    yield pa.RecordBatch.from_arrays([column(b, "doc_id"), pa.array(texts, pa.string()), column(b, "rest")], names=["doc_id", "text", "rest"])


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with its personal data masked and disclosing terms generalised or removed; same columns and rows.

    Null and empty texts come back empty.  Repeated rows are masked alike.  An
    empty table gives an empty table.
    """
    spans = find_pii(docs, **options).where(F.size("spans") > 0).groupBy("doc_id", "mark").agg(F.first("spans").alias("spans"))
    base = core.with_rest(docs).withColumn("mark", F.xxhash64("text"))
    joined = base.join(spans.hint("shuffle_hash"), ["doc_id", "mark"], "left").select("doc_id", "text", "spans", "rest")
    out = core.schema_of("doc_id long, text string", rest=base.schema["rest"].dataType)
    return core.like(core.arrow_map(joined, _masker, out), docs)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_pii(core.documents(spark, sf_dir).select("doc_id", "text"), related=True)
    return core.give_back_ids(out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", spans_text(F.col("spans")).alias("spans")))


QUERIES = {"op10_pii": op10_pii}
SQL: dict[str, str] = {}
