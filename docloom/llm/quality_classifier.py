"""Quality classifier: regularised quadratic discriminant analysis.

Document statistics (shares of character classes, word shape, repetition,
...) are transformed to be roughly normal. Each class has a mean and a
covariance shrunk towards the pooled covariance and its own diagonal, the more
the fewer rows the class has; the
Cholesky factors are computed once with the model. A text's score comes from
the difference of the two Mahalanobis log densities, made a probability by a
logistic curve fitted on the training rows' differences.

Scale: a text's statistics come from one pass over its bytes and are written
as narrow rows (id and 17 numbers), which meet the labels in the only join;
texts are never shuffled. Labelled rows add to a fixed number of sums in each
task (no training row is collected; all labelled rows count). Scoring is a map
over rows with a model of a few KB.

Defined cases: a null or empty text has the statistics of no words and is
scored like any other. Rows without a label or with a null label don't train.
A document with several labels trains once for each. Without training rows of
both classes every score is 0.5. Extra columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import SEGMENT, bitmap, buffers, fresh, in_arrow, in_bitmap, mix, prepare, stored, word_hashes

#: Shrinkage: the least share of the pooled covariance, then of the diagonal,
#: and the rows that weigh as much as a class's own covariance.
POOLED, DIAGONAL, PRIOR_ROWS = 0.02, 0.02, 85
KEEP_SCORE = 0.7

#: Byte classes of UTF-8: later lines overrule earlier ones.
_CLASS = np.zeros(256, np.uint8)
for _i, _members in enumerate([b"", bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", b" \t\x0b\x0c\r", b"\n", b".,;:?'\"()-", b"!", b"#*$%&<>@^~=+/\\{}[]_`", b"|", bytes(range(128, 192)), bytes(range(192, 256))]):
    _CLASS[list(_members)] = _i
CLASSES = 12
NAMES = ("size", "lower", "upper", "digit", "space", "newline", "point", "exclaim", "symbol", "bar", "lead", "word_length", "distinct", "repeated_pairs", "runs", "top_share", "repeated_triples")
WIDTH = len(NAMES)


def _class_counts(body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bytes of each class in each text, in pieces of bounded size."""
    out = np.zeros((len(offsets) - 1, CLASSES), np.int64)
    for i, (start, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        for a in range(start, end, SEGMENT):
            out[i] += np.bincount(_CLASS[body[a : min(a + SEGMENT, end)]], minlength=CLASSES)
    return out


def _grouped(keys: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text: its distinct keys, and its most frequent key's count."""
    if not len(keys):
        return np.zeros(n), np.zeros(n)
    own = mix(keys + (doc.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(own, kind="stable")
    own, doc = own[order], doc[order]
    first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    counts, top = np.diff(first, append=len(own)), np.zeros(n)
    np.maximum.at(top, doc[first], counts)
    return np.bincount(doc[first], minlength=n).astype(float), top


def statistics(column) -> np.ndarray:
    """The transformed statistics of each text of an Arrow column."""
    body, offsets = buffers(column)
    counts = _class_counts(body, offsets).astype(float)
    parts = []
    for h, sizes in word_hashes(body, offsets, lower=False):
        n = len(sizes)
        doc = np.repeat(np.arange(n), sizes)
        distinct, top = _grouped(h, doc, n)
        same = doc[1:] == doc[:-1]
        pairs = (h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[1:])[same]
        pair_kinds, _ = _grouped(pairs, doc[1:][same], n)
        n_pairs = np.bincount(doc[1:][same], minlength=n)
        three = same[1:] & same[:-1]
        triples = (h[:-2] * np.uint64(0xC2B2AE3D27D4EB4F) * np.uint64(31) + h[1:-1] * np.uint64(0x9E3779B97F4A7C15) + h[2:])[three] if len(h) > 2 else h[:0]
        triple_docs = doc[2:][three] if len(h) > 2 else doc[:0]
        triple_kinds, _ = _grouped(triples, triple_docs, n)
        n_triples = np.bincount(triple_docs, minlength=n)
        runs = np.bincount(doc[1:][same & (h[1:] == h[:-1])], minlength=n)
        parts.append(np.stack([sizes, distinct, top, n_pairs, pair_kinds, runs, n_triples, triple_kinds], 1))
    words = np.concatenate(parts) if parts else np.zeros((0, 8))
    n, distinct, top, n_pairs, pair_kinds, runs, n_triples, triple_kinds = words.T
    total = counts.sum(axis=1)
    chars = total - counts[:, 10]  # code points
    share = lambda a, b, k=0.5: np.log((a + k) / (b - a + k + 20 * k))  # noqa: E731  smoothed log odds
    letters = counts[:, 1] + counts[:, 2] + counts[:, 11]
    columns = [np.log1p(chars), share(letters, chars), share(counts[:, 2], chars), share(counts[:, 3], chars), share(counts[:, 4], chars), share(counts[:, 5], chars), share(counts[:, 6], chars), share(counts[:, 7], chars), share(counts[:, 8], chars), share(counts[:, 9], chars), share(counts[:, 11], chars)]
    columns += [np.log1p(letters / np.maximum(n, 1)), share(n - distinct, n), share(n_pairs - pair_kinds, n_pairs), share(runs, n_pairs), share(top, n), share(n_triples - triple_kinds, n_triples)]
    return np.stack(columns, 1)


@dataclass(frozen=True)
class Model:
    """Means, inverse Cholesky factors, log determinants and the logistic
    curve (slope, intercept); None: nothing was learned."""

    means: tuple[np.ndarray, np.ndarray] | None = None
    factors: tuple[np.ndarray, np.ndarray] | None = None
    logdets: tuple[float, float] = (0.0, 0.0)
    curve: tuple[float, float] = (1.0, 0.0)

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0."""
        logs = []
        for mean, inverse, logdet in zip(self.means, self.factors, self.logdets):
            z = (x - mean) @ inverse.T
            logs.append(-0.5 * ((z * z).sum(axis=1) + logdet))
        return logs[1] - logs[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), 0.5)
        slope, intercept = self.curve
        return 1 / (1 + np.exp(-np.clip(slope * squash(self.difference(x)) + intercept, -30, 30)))


def squash(d: np.ndarray) -> np.ndarray:
    """Signed logarithm: differences of densities have very long tails."""
    return np.sign(d) * np.log1p(np.abs(d))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", wanted: np.ndarray | None = None) -> DataFrame:
    """doc_id and the statistics x of every row of docs, stored; with a bitmap
    of wanted ids, of those rows that it lets through."""
    prepare(docs.sparkSession)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        if wanted is not None:
            batch = batch.filter(pa.array(in_bitmap(wanted, [str(i).encode() for i in batch.column(0).to_pylist()])))
        x = statistics(batch.column(1))
        made = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * WIDTH, pa.int32()), pa.array(x.ravel()))
        return pa.record_batch([batch.column(0), made], ["doc_id", "x"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return stored(in_arrow(rows, step, "doc_id long, x array<double>"), "quality-features")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH)


def _sums(rows: DataFrame, step, width: int) -> dict[int, np.ndarray]:
    """Sum of step(x) by label over rows (x, label): 2 * width numbers come
    back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, width))
        for batch in batches:
            x, y = _matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
            for c in (0, 1):
                if (y == c).any():
                    total[c] += step(x[y == c])
        yield pa.record_batch([pa.array([0, 1], pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["label", "sums"])

    made = rows.mapInArrow(run, "label int, sums array<double>").select("label", F.posexplode("sums").alias("i", "x"))
    out = {c: np.zeros(width) for c in (0, 1)}
    for r in made.groupBy("label", "i").agg(F.sum("x").alias("x")).collect():
        out[r.label][r.i] = r.x
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", pooled: float = POOLED, diagonal: float = DIAGONAL) -> Model:
    """Learn from the rows of docs that have a label (joined by id)."""
    wanted = bitmap(labels.select(F.col(id_col).cast("long").cast("string").cast("binary")).dropna())
    return fit_features(features(docs, id_col, text_col, wanted), labels, id_col, label_col, pooled, diagonal)


def fit_features(known: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", pooled: float = POOLED, diagonal: float = DIAGONAL) -> Model:
    """As fit, from a table of features."""
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1) and doc_id is not null")
    rows = known.join(marks, "doc_id").select("x", "label")
    d = WIDTH
    moments = lambda x: np.concatenate(([len(x)], x.sum(axis=0), (x.T @ x).ravel()))
    got = _sums(rows, moments, 1 + d + d * d)
    counts = [got[c][0] for c in (0, 1)]
    if min(counts) < 2:
        return Model()
    means = [got[c][1 : 1 + d] / counts[c] for c in (0, 1)]
    scatter = [got[c][1 + d :].reshape(d, d) - counts[c] * np.outer(means[c], means[c]) for c in (0, 1)]
    both = (scatter[0] + scatter[1]) / (sum(counts) - 2)
    factors, logdets = [], []
    for c in (0, 1):
        few = PRIOR_ROWS / (PRIOR_ROWS + counts[c])
        to_both, to_diagonal = max(pooled, few), max(diagonal, few)
        cov = (1 - to_both) * scatter[c] / (counts[c] - 1) + to_both * both
        cov = (1 - to_diagonal) * cov + to_diagonal * np.diag(np.diag(cov)) + 1e-3 * np.eye(d)
        lower = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(lower))
        logdets.append(float(2 * np.log(np.diag(lower)).sum()))
    model = Model(tuple(means), tuple(factors), tuple(logdets))
    return Model(model.means, model.factors, model.logdets, _curve(rows, model, counts))


def _curve(rows: DataFrame, model: Model, counts: list[float], bins: int = 256, reach: float = 16.0) -> tuple[float, float]:
    """A logistic curve through the classes' histograms of differences."""

    def step(x: np.ndarray) -> np.ndarray:
        at = (np.clip(squash(model.difference(x)), -reach, reach - 1e-9) + reach) / (2 * reach) * bins
        return np.bincount(at.astype(int), minlength=bins).astype(float)

    got = _sums(rows, step, bins)
    x = (np.arange(bins) + 0.5) / bins * 2 * reach - reach
    return logistic(x, got[0], got[1])


def logistic(x: np.ndarray, n0: np.ndarray, n1: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """(slope, intercept) of the logistic curve through counts of both classes
    at x: Newton steps, each halved until the penalised likelihood grows, as
    the classes may be all but separable."""
    middle = ((x * n0).sum() / n0.sum() + (x * n1).sum() / n1.sum()) / 2
    z = x - middle

    def gain(s: float, b: float) -> float:
        t = s * z + b
        return -(n1 * np.logaddexp(0, -t) + n0 * np.logaddexp(0, t)).sum() - ridge * (s * s + b * b) / 2

    s, b = 1.0, 0.0
    for _ in range(100):
        p = 0.5 * (1 + np.tanh(0.5 * (s * z + b)))
        w, residual = (n0 + n1) * p * (1 - p), n1 - (n0 + n1) * p
        grad = np.array([(residual * z).sum() - ridge * s, residual.sum() - ridge * b])
        hess = np.array([[(w * z * z).sum() + ridge, (w * z).sum()], [(w * z).sum(), w.sum() + ridge]])
        move, before = np.linalg.solve(hess, grad), gain(s, b)
        while gain(s + move[0], b + move[1]) < before and np.abs(move).max() > 1e-9:
            move = move / 2
        s, b = s + move[0], b + move[1]
        if np.abs(move).max() < 1e-8:
            break
    s = max(float(s), 0.0)
    return s, float(b - s * middle)


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with the score of every whole text; a column of that name goes."""
    prepare(docs.sparkSession)
    names = [c for c in docs.columns if c != score_col]
    body = fresh(names, "body")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([*batch.columns[1:], pa.array(model.score(statistics(batch.column(0))), pa.float64())], [*names, score_col])

    return in_arrow(docs.select(F.col(text_col).cast("string").alias(body), *names), step, f"{kinds}, `{score_col}` double")


def score_features(known: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row of a table of features."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([batch.column(0), pa.array(model.score(_matrix(batch.column(1))), pa.float64())], ["doc_id", "score"])

    return in_arrow(known.select("doc_id", "x"), step, "doc_id long, score double")


def drop_poor(docs: DataFrame, model: Model, text_col: str = "text", least: float = KEEP_SCORE) -> DataFrame:
    """The rows of docs that score at least `least`, with their own columns;
    all of them where the model has learned nothing."""
    if model.means is None:
        return docs
    name = fresh(docs.columns, "score")
    return score(docs, model, text_col, name).where(F.col(name) >= least).select(*docs.columns)
