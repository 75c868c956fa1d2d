"""Quality classifier from positive and unlabelled texts.

A logistic model over form features of a text minimises the non-negative
unbiased risk

    pi R_p(+) + max(0, R_u(-) - pi R_p(-)),

with trusted positives p, unlabelled web text u and the class prior pi.  When
the second term falls below zero, a step goes against it, so that the model
cannot profit from overfitting.  The prior is estimated from positives and
unlabelled text alone: positives make up at least the share pi of unlabelled
texts over any score, so the share of unlabelled texts over the best score,
divided by that of positives, bounds pi from above, and comes close to it where
a model parts the classes.  Negative labels are never used.
Labels, language, source and doc_id never enter a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternflow.llm import core
from lanternflow.llm.core import column, numbers

#: The model is fitted on about this many positives and unlabelled texts at most, taken by a hash of doc_id.
SAMPLE = 20_000
FOLDS, THRESHOLD = 5, 0.3


def _bytes(chars: str) -> np.ndarray:
    m = np.zeros(256, bool)
    m[[ord(c) for c in chars]] = True
    return m


_UPPER, _DIGIT = _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _bytes("0123456789")
_LETTER = _UPPER | _bytes("abcdefghijklmnopqrstuvwxyz")
_LETTER[128:] = True
_MASKS = (_UPPER, _DIGIT, _LETTER, _bytes("\n"), _bytes("#*$%&"), _bytes("|"), _bytes("!?"), _bytes("<>{}[]=_\\/@~^"), _bytes(".,;:"))
N_FEATURES = len(_MASKS) + 6


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of form features for each text; zeros for an empty one."""
    own, cut = data[off[0] : off[-1]], off - off[0]
    n_bytes = np.diff(off)
    words = core.Words(data, off, lower=False)
    n = words.count
    counts = [core.per_text(m[own], cut) for m in _MASKS]
    per = np.maximum(n_bytes, 1)
    out = [np.sqrt(c / per) for c in counts]
    out[0] = counts[0] / np.maximum(counts[2], 1)
    same = np.zeros(len(words.hash), bool)
    same[1:] = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])
    first = core.unique_per_doc(words.hash, words.doc, len(n))[1]
    distinct = np.diff(first)
    length = np.bincount(words.doc, words.end - words.start, len(n)) / np.maximum(n, 1)
    long = np.bincount(words.doc, (words.end - words.start) > 24, len(n)) / np.maximum(n, 1)
    out += [
        np.log1p(n), np.bincount(words.doc, same, len(n)) / np.maximum(n, 1), np.log1p(distinct) / np.log1p(np.maximum(n, 1)),
        distinct / np.maximum(n, 1), length, long,
    ]
    x = np.stack(out, axis=1)
    x[n == 0] = 0
    return x


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def inputs(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.concatenate([z, np.minimum(z * z, 16) / 4, np.ones((len(z), 1))], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        # Added up row by row, so that a text's score does not depend on its batch.
        return 1 / (1 + np.exp(-np.clip((self.inputs(x) * self.weights).sum(axis=1), -30, 30)))


def nn_pu_fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 1500, rate: float = 0.03, decay: float = 1e-4) -> Model:
    """Full-batch Adam on the non-negative PU risk with logistic loss."""
    if not len(unlabelled):
        unlabelled = positive
    every = np.concatenate([positive, unlabelled])
    mean, scale = (every.mean(axis=0), every.std(axis=0) + 1e-3) if len(every) else (np.zeros(N_FEATURES), np.ones(N_FEATURES))
    model = Model(mean, scale, np.zeros(2 * N_FEATURES + 1), prior)
    if not len(positive):
        return model
    p, u = model.inputs(positive), model.inputs(unlabelled)
    w, m, v = model.weights.copy(), 0.0, 0.0
    w[-1] = np.log(prior / (1 - prior))
    for k in range(1, steps + 1):
        fp, fu = 1 / (1 + np.exp(-p @ w)), 1 / (1 + np.exp(-u @ w))
        # d/dz of the loss as positive is f - 1, as negative f.
        negative = -np.log1p(-np.minimum(fu, 1 - 1e-12)).mean() + prior * np.log1p(-np.minimum(fp, 1 - 1e-12)).mean()
        g_neg = u.T @ fu / len(u) - prior * (p.T @ fp) / len(p)
        g = prior * (p.T @ (fp - 1)) / len(p) + g_neg if negative >= 0 else -g_neg
        g = g + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return Model(mean, scale, w, prior)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, doubt: float = 0.1) -> float:
    """The share of positives in unlabelled texts, by the best bin of a model's scores.

    A model fitted on one half scores the other.  Of all thresholds the one is
    taken whose quotient is least once it is charged with the error of its two
    shares.  Too few texts give 0.5.
    """
    if min(len(positive), len(unlabelled)) < 20:
        return 0.5
    model = nn_pu_fit(positive[::2], unlabelled[::2], 0.5, steps=400)
    p, u = (np.sort(model.score(x[1::2])) for x in (positive, unlabelled))
    at = np.unique(p)
    share_p, share_u = (1 - np.searchsorted(x, at) / len(x) for x in (p, u))
    error = sum(np.sqrt(np.log(4 / doubt) / (2 * len(x))) for x in (p, u))
    k = np.argmin((share_u + error) / share_p)
    return float(np.clip(share_u[k] / share_p[k], 0.05, 0.95))


def fold(folds: int = FOLDS) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds


def _featurise(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    data, off = core.text_bytes(column(b, "text"))
    for i, j in core.steps(off):
        x = features(data, off[i : j + 1])
        flat = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * N_FEATURES, x.ravel())
        yield core.batch_of(positive=numbers(b, "positive")[i:j], unlabelled=numbers(b, "unlabelled")[i:j], x=flat)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = FOLDS) -> Model:
    """Fit on rows outside fold 0; only ``sample`` texts of each kind (about) reach the driver, as features."""
    spread = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30))
    train = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (fold(folds) != 0)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    seen = train.agg(F.sum((F.col("quality") == 1).cast("long")).alias("p")).first()
    n_pos, total = seen["p"] or 0, docs.count()
    take = lambda n: int(min(1.0, sample / max(n, 1)) * (1 << 30))
    trusted = train.where((F.col("quality") == 1) & (spread < take(n_pos))).select("doc_id", F.lit(True).alias("positive"))
    chosen = (
        core.id_text(docs).join(F.broadcast(trusted), "doc_id", "left")
        .select("text", F.coalesce("positive", F.lit(False)).alias("positive"), (spread < take(total)).alias("unlabelled"))
        .where("positive OR unlabelled")
    )
    rows = core.arrow_map(chosen, _featurise, "positive boolean, unlabelled boolean, x array<double>").toArrow()
    x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(-1, N_FEATURES) if rows.num_rows else np.zeros((0, N_FEATURES))
    pos, unl = (rows.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("positive", "unlabelled"))
    # Rows come in no order of their own; sorted, equal tables give equal models.
    x_pos, x_unl = (y[np.lexsort(y.T)] for y in (x[pos], x[unl]))
    return nn_pu_fit(x_pos, x_unl, class_prior(x_pos, x_unl))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """Score every text; the columns of ``docs`` come back in the struct ``rest``.

    Returns doc_id, text, rest, score (0 to 1, higher: good) and predicted (1
    from ``threshold`` on).  Null or empty text is scored from zero features.
    Without a trusted positive every score is 0.5.  Repeated rows score alike;
    very long texts are read whole; an empty table gives an empty table.
    """
    model = fit(docs, labels, sample)
    base = core.with_rest(docs)
    out = core.schema_of("doc_id long, text string", rest=base.schema["rest"].dataType).add("score", "double")

    def fn(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, off = core.text_bytes(column(b, "text"))
        score = [model.score(features(data, off[i : j + 1])) for i, j in core.steps(off)]
        yield pa.RecordBatch.from_arrays([column(b, "doc_id"), column(b, "text"), column(b, "rest"), pa.array(np.concatenate(score))], names=["doc_id", "text", "rest", "score"])

    return core.arrow_map(base, fn, out).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) alone; texts do not come back from the workers."""
    model = fit(docs, labels, sample)

    def fn(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, off = core.text_bytes(column(b, "text"))
        for i, j in core.steps(off):
            yield core.batch_of(doc_id=numbers(b, "doc_id")[i:j], score=model.score(features(data, off[i : j + 1])))

    found = core.arrow_map(core.id_text(docs), fn, "doc_id long, score double")
    return core.give_back_ids(found).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def good_only(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that the classifier rejects.

    Null and empty texts are judged from zero features like any other; repeated
    rows stay or go together; an empty table gives an empty table.
    """
    return core.like(classify(docs, labels, **options).where("predicted = 1"), docs)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    out = scores(core.documents(spark, sf_dir).select("doc_id", "text"), labels)
    return out.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", "predicted")


QUERIES = {"op6_quality_classifier": op6_quality_classifier}
SQL: dict[str, str] = {}
