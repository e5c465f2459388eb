"""Toxic passages as maximal scoring segments of token log-odds.

Each token scores its log-odds of toxic against clean text under a Dirichlet
prior, less a small drift. A linear scan finds every maximal scoring segment
of a text; extreme-value statistics of such segments say how surprising each
is in clean text of that length, and the surprise of a document's segments above
the expected best one, summed, is calibrated to a probability.

Only labelled rows that ``train`` admits are learned from, and of those a
bounded, hashed sample of about ``max_train`` documents. Every token of the
sample has a score; how far it stands from zero follows how often the token was
seen. The calibration is cross-fitted: each of ``FOLDS`` parts of the sample is
judged by scores that the other parts gave. Scores look at the text alone.

Defined cases: a null or empty text has no token and gets the calibrated base
rate. Labels that are null or belong to no document are not used; of labels
that disagree on an id the larger one is used. Without labels, or with one
class of them, every score is a smoothed base rate. Ties and repeated rows
score alike. Texts are scanned whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.llm import textnum as tn
from frameloom.llm.shared import written

RESULT = (
    "doc_id long, n_tokens long, score double, surprise double, "
    "passages array<struct<start: long, end: long, score: double>>"
)
#: Parts of the sample for the cross-fitted calibration.
FOLDS = 5
#: A passage is significant if clean text of that length is expected to have
#: fewer than this number of segments that score as much.
EXPECTED = 0.05
_PASSAGES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


@dataclass
class Model:
    """Token scores by hash, the law of segment scores, and the calibration."""

    tokens: np.ndarray = field(default_factory=lambda: np.zeros(0, tn.U64))
    scores: np.ndarray = field(default_factory=lambda: np.zeros(0))
    drift: float = 0.1
    rate: float = 1.0  # lambda of the extreme-value law
    size: float = 1.0  # K of that law
    base: float = -3.0
    slope: float = 0.0

    def token_scores(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.tokens):
            return np.full(len(hashes), -self.drift)
        at = np.searchsorted(self.tokens, hashes)
        at[at == len(self.tokens)] = 0
        return np.where(self.tokens[at] == hashes, self.scores[at], 0.0) - self.drift

    def surprise(self, segments: list[tuple[int, int, float]], n: int) -> float:
        """Sum of what each segment's score exceeds its expected maximum by."""
        bar = np.log(max(self.size * n, 1e-12))
        return float(sum(max(0.0, self.rate * s - bar) for _, _, s in segments))

    def probability(self, surprise: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-(self.base + self.slope * np.log1p(surprise))))


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments [start, end) with their scores, in order.

    Linear: only positive scores open a segment, each is pushed and merged away
    at most once, and remembers the last one before it that starts lower, so that
    none between is looked at again. Runs of other scores enter through the
    running sum.
    """
    total = np.cumsum(scores)
    stack: list[tuple[float, float, int, int, int]] = []
    for i in np.flatnonzero(scores > 0).tolist():
        left, right, start, end = total[i] - scores[i], total[i], i, i + 1
        j = len(stack) - 1
        while True:
            while j >= 0 and stack[j][0] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][1] >= right:
                break
            left, _, start, _, back = stack[j]
            del stack[j:]
            j = back
        stack.append((left, right, start, end, j))
    return [(a, b, float(r - l)) for l, r, a, b, _ in stack]


def _tokens(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first document, hashes, starts, ends, token offsets) block by block."""
    data, offs = tn.utf8(column)
    for a, b in tn.blocks(offs):
        part, at = tn.lower(data[offs[a] : offs[b]]), offs[a : b + 1] - offs[a]
        s, e, w = tn.word_spans(part, at, letters_only=True)
        first = np.repeat(at[:-1], np.diff(w))
        yield a, tn.word_hashes(part, s, e), s - first, e - first, w


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, fold, toxic, clean) counts of documents of batches of (text, toxic, fold).

    A token counts once for each document, or one that repeats a word a
    thousand times would make a rule of it.
    """
    kind = np.dtype([("token", tn.U64), ("fold", np.int64)])
    for batch in batches:
        toxic = batch.column(1).to_numpy(zero_copy_only=False) > 0
        fold = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
        found = []
        for a, h, _, _, w in _tokens(batch.column(0)):
            owner = np.repeat(np.arange(a, a + len(w) - 1), np.diff(w))
            order = np.lexsort((h, owner))
            h, owner = h[order], owner[order]
            fresh = np.ones(len(h), bool)
            fresh[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
            found.append((h[fresh], fold[owner[fresh]], toxic[owner[fresh]]))
        if not found:
            continue
        h, f, t = (np.concatenate(x) for x in zip(*found))
        pairs = np.empty(len(h), kind)
        pairs["token"], pairs["fold"] = h, f
        order = np.lexsort((f, h))
        pairs, t = pairs[order], t[order]
        first = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])[: len(pairs)])
        n = np.diff(np.append(first, len(pairs)))
        y = np.add.reduceat(t.astype(np.int64), first) if len(first) else n
        yield pa.RecordBatch.from_arrays(
            [pa.array(pairs["token"][first].view(np.int64)), pa.array(pairs["fold"][first]), pa.array(y), pa.array(n - y)],
            names=["token", "fold", "toxic", "clean"],
        )


def log_odds(toxic: np.ndarray, clean: np.ndarray, all_toxic: int, all_clean: int, prior: float) -> np.ndarray:
    """Log-odds of tokens, with a Dirichlet prior of ``prior`` tokens shaped like
    the text of both classes, shrunk by their variance.

    That prior grows with a token's own count, so by itself it leaves a token
    seen once as far from zero as one seen a thousand times with the same
    shares. Hence a second one, normal with variance 1 around zero, of which the
    mean after seeing the log-odds is taken.
    """
    shape = (toxic + clean) * (prior / (all_toxic + all_clean))
    y, x = toxic + shape, clean + shape
    odds = np.log(y / (all_toxic + prior - y)) - np.log(x / (all_clean + prior - x))
    return odds / (1 + 1 / y + 1 / x)


def _learn(tokens: np.ndarray, toxic: np.ndarray, clean: np.ndarray, prior: float, drift: float) -> Model:
    """A model of sorted ``tokens`` from their counts; without one class, none."""
    model, t, c = Model(drift=drift), int(toxic.sum()), int(clean.sum())
    if not t or not c:
        return model
    # A score depends on the two counts alone, and few pairs of them differ.
    pairs = toxic.astype(np.int64) << 32 | clean.astype(np.int64)
    pairs, at, n = np.unique(pairs, return_inverse=True, return_counts=True)
    y, x = (pairs >> 32).astype(float), (pairs & 0xFFFFFFFF).astype(float)
    seen = y + x > 0
    scores = np.zeros(len(pairs))
    scores[seen] = log_odds(y[seen], x[seen], t, c, prior * (t + c))
    model.tokens, model.scores = tokens, scores.astype(np.float32)[at]
    model.rate = _law(scores, n * (x + prior * (y + x)) / (c + prior * (t + c)), drift)
    return model


def _law(scores: np.ndarray, chance: np.ndarray, drift: float) -> float:
    """The positive root of sum p * exp(rate * s) = 1 over clean tokens."""
    s = np.append(scores, 0.0) - drift
    p = np.append(chance, max(0.0, 1.0 - chance.sum()))
    if not (s > 0).any():
        return 1.0
    low, high = 1e-6, 1.0
    with np.errstate(over="ignore"):
        while (p * np.exp(high * s)).sum() < 1 and high < 1e3:
            high *= 2
        for _ in range(80):
            mid = (low + high) / 2
            low, high = (mid, high) if (p * np.exp(mid * s)).sum() < 1 else (low, mid)
    return high


def _segments_of(models: list[Model]):
    """One row per document: toxic, n_tokens and the scores of its segments, by
    the model of its fold and in units of that model's extreme-value law."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold, n, found = batch.column(2).to_pylist(), [], []
            for a, h, _, _, w in _tokens(batch.column(0)):
                for i in range(len(w) - 1):
                    model = models[fold[a + i]]
                    scores = model.token_scores(h[w[i] : w[i + 1]])
                    n.append(int(w[i + 1] - w[i]))
                    found.append([x[2] * model.rate for x in maximal_segments(scores)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(n, pa.int64()), pa.array(found, pa.list_(pa.float64()))],
                names=["toxic", "n", "segments"],
            )

    return run


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression of y on x with a weak ridge, by Newton steps."""
    z, w = np.column_stack([np.ones(len(x)), x]), np.zeros(2)
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2), z.T @ (y - p) - 1e-3 * w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(max(w[1], 0.0))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    toxic: str = "toxic",
    train: Column | None = None,
    max_train: int = 40_000,
    prior: float = 0.1,
    drift: float = 0.1,
) -> Model:
    """Learn a model from ``labels`` (id and ``toxic`` 0 or 1) of ``docs``.

    ``max_train`` bounds the sample of labelled documents (in expectation; ids
    are drawn by hash), hence also the broadcast of its ids, the vocabulary that
    the driver gets and sends out as the model, and the rows of the calibration.
    ``prior`` is the weight of the Dirichlet prior as a share of what was counted.
    """
    known = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(toxic).alias("toxic")).where(
        "doc_id is not null and toxic is not null"
    )
    if train is not None:
        known = known.where(train)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 20))
    share = min(1.0, max_train / max(known.count(), 1))
    sample = known.where(draw < int(share * (1 << 20))).withColumn(
        "fold", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int")
    )
    texts = (
        docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
        .join(F.broadcast(sample), "doc_id")
        .select("text", "toxic", "fold")
    )

    by_fold = [
        F.sum(F.when(F.col("fold") == k, F.col(x)).otherwise(0)).cast("int").alias(f"{x}{k}")
        for x in ("toxic", "clean")
        for k in range(FOLDS)
    ]
    counts = texts.mapInArrow(_count, "token long, fold long, toxic long, clean long").groupBy("token").agg(*by_fold)
    rows = written(counts, "token-counts").toArrow()
    tokens = rows["token"].to_numpy().astype(np.int64).view(tn.U64)
    order = np.argsort(tokens)
    tokens = tokens[order]
    y, x = (np.column_stack([rows[f"{c}{k}"].to_numpy() for k in range(FOLDS)])[order] for c in ("toxic", "clean"))
    del rows
    model = _learn(tokens, y.sum(1), x.sum(1), prior, drift)
    others = [_learn(tokens, y.sum(1) - y[:, k], x.sum(1) - x[:, k], prior, drift) for k in range(FOLDS)]
    seen = texts.mapInArrow(_segments_of(others), "toxic int, n long, segments array<double>")
    return _finish(model, written(seen, "segments"))


def _finish(model: Model, seen: DataFrame) -> Model:
    """Size of the extreme-value law from clean documents; calibration of all."""
    if len(model.tokens):
        # Most likely size, given the best segment of each clean document.
        best = F.coalesce(F.array_max("segments"), F.lit(0.0))
        m, e = seen.where("toxic <= 0 and n > 0").agg(F.count("*"), F.sum(F.col("n") * F.exp(-best))).first()
        model.size = m / e if e else 1.0
    bar = F.log(F.greatest(model.size * F.col("n"), F.lit(1e-12)))
    surprise = F.aggregate("segments", F.lit(0.0), lambda a, s: a + F.greatest(s - bar, F.lit(0.0)))
    rows = seen.select("toxic", surprise.alias("surprise")).toArrow()
    x, y = rows["surprise"].to_numpy(), (rows["toxic"].to_numpy() > 0).astype(float)
    # In one order, so that sums don't follow that of the rows.
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    model.base = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 9.5)))
    if len(model.tokens) and 0 < y.sum() < len(y):
        model.base, model.slope = _calibrate(np.log1p(x), y)
    return model


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, surprises, passages = [], [], []
            for _, h, s, e, w in _tokens(batch.column(1)):
                scores = model.token_scores(h)
                positive = np.searchsorted(np.flatnonzero(scores > 0), w)
                for i in range(len(w) - 1):
                    a, b = int(w[i]), int(w[i + 1])
                    found = maximal_segments(scores[a:b]) if positive[i + 1] > positive[i] else []
                    n.append(b - a)
                    surprises.append(model.surprise(found, b - a))
                    bar = np.log(max(model.size * (b - a), 1e-12) / EXPECTED)
                    passages.append(
                        [
                            {"start": int(s[a + x]), "end": int(e[a + y - 1]), "score": v}
                            for x, y, v in found
                            if model.rate * v > bar
                        ]
                    )
            surprise = np.array(surprises, float)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(2),
                    batch.column(0),
                    pa.array(n, pa.int64()),
                    pa.array(model.probability(surprise)),
                    pa.array(surprise),
                    pa.array(passages, _PASSAGES),
                ],
                names=["carried", "doc_id", "n_tokens", "score", "surprise", "passages"],
            )

    return run


def score(
    docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()
) -> DataFrame:
    """One row per document: id, n_tokens, score, surprise, and the significant
    passages as byte ranges of the text with their scores; ``carried`` is a struct
    of the columns named in ``carry``, so that a row's score needs no join."""
    carried = F.struct(*carry) if carry else F.struct(F.lit(0).alias("none"))
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), carried.alias("carried"))
    kind = own.schema["carried"].dataType.simpleString()
    scored = own.mapInArrow(_score(model), f"carried {kind}, {RESULT}")
    return scored if carry else scored.drop("carried")


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept out of training: crc32 of its id, modulo 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def rate_toxicity(docs: DataFrame, labels: DataFrame, *, carry: tuple[str, ...] = (), **options) -> DataFrame:
    """Fit on the labels of documents that aren't held out; score all of them."""
    model = fit(docs, labels, train=~held_out(F.col("doc_id")), **options)
    return score(docs, model, carry=carry).withColumns(
        {
            "held_out": F.coalesce(held_out(F.col("doc_id")), F.lit(False)),
            "predicted": (F.col("score") >= 0.5).cast("int"),
        }
    )
