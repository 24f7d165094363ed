"""Non-negative positive-unlabelled learning of linear text classifiers, in numpy.

Training reads a bounded sample: MAX_POSITIVE labelled positives and MAX_UNLABELLED documents whose
label is not used, both chosen by a hash of the id before any text is read; executors make the features of the
chosen texts, whole and of any length, and only those come to the driver. An id with several labels is positive if one is; an id with
several texts gives the least of them. Features are style rates (share of capitals, symbols, repeats ...)
and the presence of words and of word stems, by hash; one is selected when it is far more frequent among positives
than among the unlabelled. The class prior is estimated from the same two samples, and the
classifier minimises the non-negative risk estimate

    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)).

Scores are computed document by document over whole texts. Nulls and empty texts have no words and
get the score of the features zero; without any training rows every score is the prior 0.5.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _LOWER, U64, crc_label_fold, keep_rows, map_arrow, mix64, raw_bytes, slices, word_hashes

STEMS = (4, 5)
MAX_POSITIVE, MAX_UNLABELLED = 2000, 4000
Z_LEAST, Z_SHARE, FEW_WORDS, Z_SMALL = 5.0, 0.35, 8, 3.0
STYLE = ("length", "upper", "symbol", "digit", "blank", "repeat", "pipe", "mean_word", "newline", "one_letter", "twice", "root_symbol", "root_upper", "root_pipe", "root_twice")


def features(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Style vector and the sorted distinct word buckets of one text's bytes."""
    n = len(raw)
    words, first, end = _bare_words(raw)
    m = len(words)
    if not n or not m:
        return np.zeros(len(STYLE)), np.zeros(0, U64)
    low = (raw >= 97) & (raw <= 122) | (raw >= 128)
    upper = (raw >= 65) & (raw <= 90)
    digit = (raw >= 48) & (raw <= 57)
    blank = raw <= 32
    kinds = np.unique(words)
    letters = max(1, int(low.sum() + upper.sum()))
    symbol = (~(low | upper | digit | blank)).sum() / n
    twice = (words[1:] == words[:-1]).sum() / m
    pipe = (raw == 124).sum() / n
    style = np.array(
        [
            np.log1p(n) / 12,
            upper.sum() / letters,
            symbol * 4,
            digit.sum() / n * 4,
            blank.sum() / n,
            1 - len(kinds) / m,
            pipe * 8,
            min(4.0, (end - first).mean() / 8),
            (raw == 10).sum() / n * 8,
            ((end - first) == 1).mean(),
            twice,
            np.sqrt(symbol) * 2,
            np.sqrt(upper.sum() / letters),
            np.sqrt(pipe) * 3,
            np.sqrt(twice),
        ]
    )
    stems = [kinds]
    for size in STEMS:  # words of one stem count together
        at = first[end - first > size]
        stems.append(np.unique(mix64(sum((_LOWER[raw[at + k]].astype(U64) << U64(8 * k) for k in range(size)), start=np.full(len(at), U64(size) << U64(56))))))
    return style, np.unique(np.concatenate(stems))


_EDGE = np.zeros(256, bool)
_EDGE[:65] = True
_EDGE[91:97] = True
_EDGE[123:128] = True


def _bare_words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of letters alone, in lower case: punctuation and digits part them."""
    return word_hashes(np.where(_EDGE[raw], np.uint8(32), raw))


@dataclass
class Model:
    chosen: np.ndarray = field(default_factory=lambda: np.zeros(0, U64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(len(STYLE)))
    bias: float = 0.0
    centre: np.ndarray = field(default_factory=lambda: np.zeros(len(STYLE)))
    spread: np.ndarray = field(default_factory=lambda: np.ones(len(STYLE)))
    prior: float = 0.5

    def vector(self, style: np.ndarray, words: np.ndarray, use_style: bool) -> np.ndarray:
        x = np.zeros(len(STYLE) + len(self.chosen), np.float32)
        if use_style:
            x[: len(STYLE)] = np.clip((style - self.centre) / self.spread, -4, 4)
        if len(words) and len(self.chosen):
            at = np.minimum(np.searchsorted(words, self.chosen), len(words) - 1)
            x[len(STYLE) + np.flatnonzero(words[at] == self.chosen)] = 1
        return x


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, floor: float = 0.01) -> float:
    """Share of positives among the unlabelled: the least ratio of upper tails of a score, where both are well sampled."""
    best = 1.0
    n, m = len(positive), len(unlabelled)
    if not n or not m:
        return 0.5
    for t in np.quantile(positive, np.linspace(0.02, 0.9, 45)):
        p, u = (positive >= t).mean(), (unlabelled >= t).mean()
        if p >= 0.3:  # below, the ratio's sampling error is larger than what it could still fall
            best = min(best, u / p)
    return float(np.clip(best, floor, 0.99))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit_risk(xp: np.ndarray, xu: np.ndarray, prior: float, epochs: int = 500, decay: float = 1e-5, non_negative: bool = True, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Adam on the non-negative risk with the logistic loss; where the bracket is negative its gradient is reversed."""
    rng = np.random.default_rng(7)
    w = np.zeros(xp.shape[1] + 1)
    mean, square, step = np.zeros_like(w), np.zeros_like(w), 0
    xp = np.hstack([xp, np.ones((len(xp), 1), xp.dtype)])
    xu = np.hstack([xu, np.ones((len(xu), 1), xu.dtype)])
    for _ in range(epochs):
        up, uu = rng.permutation(len(xp)), rng.permutation(len(xu))
        parts = max(1, len(xu) // 4096)  # in small batches the bracket turns negative by chance
        for k in range(parts):
            p = xp[up[k * len(xp) // parts : (k + 1) * len(xp) // parts]] if len(xp) >= parts else xp
            u = xu[uu[k * len(xu) // parts : (k + 1) * len(xu) // parts]]
            if not len(p) or not len(u):
                continue
            zp, zu = p @ w, u @ w
            plus = -p.T @ _sigmoid(-zp) / len(p)
            minus_p, minus_u = p.T @ _sigmoid(zp) / len(p), u.T @ _sigmoid(zu) / len(u)
            bracket = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            if bracket >= 0 or not non_negative:
                g = prior * plus + minus_u - prior * minus_p
            else:
                g = -(minus_u - prior * minus_p)
            g = g + decay * np.append(w[:-1], 0)
            step += 1
            mean = 0.9 * mean + 0.1 * g
            square = 0.999 * square + 0.001 * g * g
            w -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


Features = tuple[np.ndarray, np.ndarray]


def train(fp: list[Features], fu: list[Features], words: int, use_style: bool) -> Model:
    """A model from the features of trusted positives and of unlabelled texts."""
    if not fp or not fu:
        return Model()
    np_, nu = len(fp), len(fu)
    kinds, cp = np.unique(np.concatenate([b for _, b in fp]), return_counts=True)
    other, n_other = np.unique(np.concatenate([b for _, b in fu]), return_counts=True)
    # only words of the positives can be chosen, so only theirs are looked up among the others
    at = np.minimum(np.searchsorted(other, kinds), max(len(other) - 1, 0))
    cu = np.where(other[at] == kinds, n_other[at], 0) if len(other) else np.zeros_like(cp)
    rate = (cp + cu) / (np_ + nu)
    z = (cp / np_ - cu / nu) / np.sqrt(np.maximum(rate * (1 - rate), 1e-9) * (1 / np_ + 1 / nu))
    z[cp + cu < max(5, 0.002 * (np_ + nu))] = 0
    order = np.argsort(-z, kind="stable")[:words]
    # words of the positives only, far beyond chance and not far below the best: others would be learned by heart
    far = order[z[order] > max(Z_LEAST, Z_SHARE * z[order[0]])] if len(order) else order
    if len(far) < FEW_WORDS:  # a small sample can't reach that far; its best words have to do
        far = order[:FEW_WORDS]
        far = far[z[far] > Z_SMALL]
    model = Model(chosen=np.sort(kinds[far]))
    if not use_style and not len(far):
        model.bias = -3.0  # nothing tells positives from the rest: nothing is flagged
        return model
    styles = np.array([s for s, _ in fu])
    model.centre, model.spread = styles.mean(0), np.maximum(styles.std(0), 1e-3)
    xp = np.stack([model.vector(s, b, use_style) for s, b in fp])
    xu = np.stack([model.vector(s, b, use_style) for s, b in fu])
    # the prior is read off a first classifier of positives against unlabelled, on halves it wasn't fitted on
    tails_p, tails_u = np.zeros(np_), np.zeros(nu)
    for k in (0, 1):
        w, b = fit_risk(xp[k::2], xu[k::2], 0.5, 200)
        tails_p[1 - k :: 2], tails_u[1 - k :: 2] = xp[1 - k :: 2] @ w + b, xu[1 - k :: 2] @ w + b
    model.prior = class_prior(tails_p, tails_u)
    model.weights, model.bias = fit_risk(xp, xu, model.prior)
    return model


def score_texts(model: Model, use_style: bool, raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    out = np.empty(len(bounds) - 1)
    for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        out[i] = float(model.vector(*features(raw[a:b]), use_style) @ model.weights) + model.bias
    return _sigmoid(out)


def _drawn(ids: DataFrame, n: int) -> list[int]:
    """The n ids of least hash (all, if fewer), however the table is split and however often an id occurs."""
    draw = F.xxhash64("doc_id", F.lit(17))
    about = ids.agg(F.approx_count_distinct("doc_id", 0.02)).first()[0]
    share = 1.25 * n / max(about, 1)  # the hash bound lets a few more through than wanted
    bound = (1 << 63) - 1 if share >= 1 else int(2**64 * share) - (1 << 63)
    return [r["doc_id"] for r in ids.where(draw <= bound).distinct().orderBy(draw, "doc_id").limit(n).collect()]


def samples(docs: DataFrame, labels: DataFrame, column: str, allowed: Column) -> tuple[list[Features], list[Features]]:
    """Features of bounded samples of trusted positives and of texts whose label is not looked at, both where ``allowed``.

    Positives are drawn among the labelled ids; one without a document gives nothing.
    """
    marked = labels.where(F.col(column) == 1).select(F.col("doc_id").cast("long").alias("doc_id")).where(allowed & F.col("doc_id").isNotNull())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("doc_id is not null")
    trusted, others = set(_drawn(marked, MAX_POSITIVE)), set(_drawn(rows.select("doc_id").where(allowed), MAX_UNLABELLED))
    wanted = sorted(trusted | others)
    if not wanted:
        return [], []
    chosen = docs.sparkSession.createDataFrame([(i,) for i in wanted], "doc_id long")  # MAX_POSITIVE + MAX_UNLABELLED rows at most
    texts = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, bounds = raw_bytes(batch.column("text"))
            own = [features(raw[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x[0].tobytes() for x in own], pa.binary()), pa.array([x[1].tobytes() for x in own], pa.binary())], names=["doc_id", "style", "words"])

    got = map_arrow(texts, measure, "doc_id long, style binary, words binary").toArrow()
    found = {i.as_py(): (np.frombuffer(a.as_buffer()), np.frombuffer(b.as_buffer(), U64)) for i, a, b in zip(*got.columns, strict=True)}
    return [found[i] for i in wanted if i in trusted and i in found], [found[i] for i in wanted if i in others and i in found]


def classify(spark: SparkSession, docs: DataFrame, model: Model, use_style: bool, cut: float) -> DataFrame:
    """The documents' rows with held_out, score and predicted; other columns of the table are not read."""
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = score_texts(shared.value, use_style, *raw_bytes(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(found)], names=["doc_id", "held_out", "score"])

    rows = docs.select("doc_id", F.coalesce(crc_label_fold() == 0, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    scored = map_arrow(rows, score, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= cut).cast("int"))


#: name -> label column, word features, style features, threshold
TASKS = {"quality": ("quality", 400, True, 0.3), "toxicity": ("toxic", 400, False, 0.5)}


def run(spark: SparkSession, docs: DataFrame, labels: DataFrame, task: str) -> DataFrame:
    column, words, style, cut = TASKS[task]
    positive, unlabelled = samples(docs, labels, column, crc_label_fold() != 0)
    return classify(spark, docs, train(positive, unlabelled, words, style), style, cut)


def keep_below(spark: SparkSession, docs: DataFrame, model: Model, use_style: bool, cut: float) -> DataFrame:
    """The rows of ``docs`` that score under ``cut``, in one pass and with all their columns."""
    shared = spark.sparkContext.broadcast(model)
    return keep_rows(docs, lambda texts: score_texts(shared.value, use_style, *raw_bytes(texts)) < cut)
