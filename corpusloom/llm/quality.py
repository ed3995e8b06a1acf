"""Document quality by co-training: a text-content view and a page-metadata view teach each other.

A bounded sample of labelled documents starts both views. Then, in rounds, every other
document is judged by both; each view learns from all documents that the other one is
sure of, by sums of gradients and Hessians that Spark adds up over the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.shared import materialize
from corpusloom.llm.words import SPACE, distinct, slices, texts_of, words_of

MARKS = [c for c in range(0x21, 0x7F) if not chr(c).isalnum()]
N_TEXT = len(MARKS) + 12
SOURCES, LANGS = 64, 16
N_META = SOURCES + LANGS + 4


def _classes() -> np.ndarray:
    """From a byte histogram to counts of each punctuation mark, and of upper, lower, digit, white-space, line and non-ASCII bytes."""
    table = np.zeros((256, len(MARKS) + 6))
    for i, c in enumerate(MARKS):
        table[c, i] = 1
    n = len(MARKS)
    table[ord("A") : ord("Z") + 1, n] = 1
    table[ord("a") : ord("z") + 1, n + 1] = 1
    table[ord("0") : ord("9") + 1, n + 2] = 1
    table[SPACE, n + 3] = 1
    table[10, n + 4] = 1
    table[0x80:, n + 5] = 1
    return table


CLASSES = _classes()


def text_features(texts: pa.Array) -> np.ndarray:
    """One row a text of a large_string array without nulls: shares of character classes, word shape and repetition."""
    out = []
    for a, b in slices(texts):
        part = texts.slice(a, b - a)
        words = words_of(part)
        offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
        offsets = offsets - offsets[0]
        h, lengths = words.hashes(), words.ends - words.starts
        for i in range(len(part)):
            raw = words.data[offsets[i] : offsets[i + 1]]
            w0, w1 = words.first[i], words.first[i + 1]
            n, size = int(w1 - w0), len(raw)
            counts = np.bincount(raw, minlength=256) @ CLASSES
            own = lengths[w0:w1]
            lines = raw.tobytes().split(b"\n") if n else []
            out.append([*(counts / max(1, size)), np.log1p(n), own.mean() / 16 if n else 0, min(own.max(), 200) / 64 if n else 0, len(distinct(h[w0:w1])) / n if n else 0, len(set(lines)) / len(lines) if n else 0, np.log1p(len(lines))])
    return np.array(out, np.float64).reshape(len(texts), N_TEXT)


def _bucket(values: list, n: int) -> np.ndarray:
    known = {v: xxhash.xxh64_intdigest(str(v).encode("utf-8", "replace")) % n for v in set(values)}
    return np.array([known[v] for v in values], np.int64)


def meta_numbers(source: list, lang: list, n_chars: list) -> np.ndarray:
    """One row a document from its metadata alone: source and language by hash of the whole string, stated length, and what is missing."""
    size = [float(c) if c is not None and c >= 0 else 0.0 for c in n_chars]
    return np.c_[_bucket(source, SOURCES), _bucket(lang, LANGS), size, [c is None for c in n_chars], [s is None for s in source]].reshape(-1, 5).astype(np.float64)


def meta_features(numbers: np.ndarray) -> np.ndarray:
    """Features from ``meta_numbers``, one column a bucket."""
    n, size = len(numbers), numbers[:, 2]
    out = np.zeros((n, N_META))
    out[np.arange(n), numbers[:, 0].astype(int)] = 1
    out[np.arange(n), SOURCES + numbers[:, 1].astype(int)] = 1
    out[:, -4] = np.log1p(size) / 8
    out[:, -3] = size < 100
    out[:, -2:] = numbers[:, 3:]
    return out


@dataclass
class Linear:
    """Logistic regression on standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def design(self, x: np.ndarray) -> np.ndarray:
        return np.c_[np.ones(len(x)), np.clip((x - self.mean) / self.scale, -8, 8)]

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.design(x) @ self.weights

    def sums(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and Hessian of the log loss over some rows."""
        z = self.design(x)
        p = _sigmoid(z @ self.weights)
        return z.T @ (p - y), (z * (p * (1 - p) + 1e-6)[:, None]).T @ z

    def step(self, gradient: np.ndarray, hessian: np.ndarray, ridge: float = 1.0) -> float:
        """One Newton step on sums over all rows; the largest change."""
        penalty = np.full(len(self.weights), ridge)
        penalty[0] = 1e-6
        change = np.linalg.solve(hessian + np.diag(penalty), gradient + penalty * self.weights)
        self.weights = self.weights - change
        return float(np.abs(change).max())


def fit_linear(x: np.ndarray, y: np.ndarray, steps: int = 25) -> Linear:
    mean, scale = x.mean(0), x.std(0)
    out = Linear(mean, np.where(scale < 1e-9, 1.0, scale), np.zeros(x.shape[1] + 1))
    for _ in range(steps):
        if out.step(*out.sums(x, y)) < 1e-6:
            break
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class CoTrained:
    """Both views, the calibration of each, and the combination; None for views means no usable labels."""

    text: Linear | None
    meta: Linear | None
    text_scale: Linear | None = None
    meta_scale: Linear | None = None
    both: Linear | None = None

    def score(self, texts: pa.Array, source: list, lang: list, n_chars: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.text is None:
            ones = np.ones(len(texts))
            return ones, ones, ones
        a, b = self.text.logit(text_features(texts)), self.meta.logit(meta_features(meta_numbers(source, lang, n_chars)))
        return _sigmoid(self.text_scale.logit(a[:, None])), _sigmoid(self.meta_scale.logit(b[:, None])), _sigmoid(self.both.logit(np.c_[a, b]))


def taught_sums(x: tuple[np.ndarray, np.ndarray], judges: list[Linear], scales: list[Linear], pupils: list[Linear], confident: float) -> np.ndarray:
    """What each view learns from the rows that the other one is sure of: for each view and class their number, gradient and Hessian, in one row of numbers."""
    out = []
    for pupil in (0, 1):
        p = _sigmoid(scales[1 - pupil].logit(judges[1 - pupil].logit(x[1 - pupil])[:, None]))
        for label, sure in ((1.0, p >= confident), (0.0, p <= 1 - confident)):
            gradient, hessian = pupils[pupil].sums(x[pupil][sure], np.full(int(sure.sum()), label))
            out += [[sure.sum()], gradient, hessian.ravel()]
    return np.concatenate(out)


def learn(pupils: list[Linear], teach: list[tuple[np.ndarray, np.ndarray]], total: np.ndarray) -> None:
    """One step of each view on its labelled rows and on ``taught_sums`` over all others, which weigh as much, class by class, as the labelled ones at most."""
    at = 0
    for v, n in enumerate(len(pupil.weights) for pupil in pupils):
        x, y = teach[v]
        gradient, hessian = pupils[v].sums(x, y)
        for label in (1.0, 0.0):
            rows = total[at]
            weight = min(1.0, float((y == label).sum()) / rows) if rows else 0.0
            gradient = gradient + weight * total[at + 1 : at + 1 + n]
            hessian = hessian + weight * total[at + 1 + n : at + 1 + n + n * n].reshape(n, n)
            at += 1 + n + n * n
        pupils[v].step(gradient, hessian)
        pupils[v].weights = np.round(pupils[v].weights, 7)  # sums may come in another order in another run


def cotrain(xa: np.ndarray, xb: np.ndarray, y: np.ndarray, sums_over_pool: Callable, rounds: int, steps: int) -> CoTrained:
    """Three quarters of the labelled rows teach; the last quarter calibrates the views and their combination.

    ``sums_over_pool(judges, scales, pupils)`` adds up ``taught_sums`` over all other
    documents. In a round the judges stay as they were at its start.
    """
    if min(y.sum(), len(y) - y.sum()) < 10:
        return CoTrained(None, None)
    held = np.arange(len(y)) % 4 == 3
    teach, held_x = [(xa[~held], y[~held]), (xb[~held], y[~held])], (xa[held], xb[held])
    views = [fit_linear(*teach[0]), fit_linear(*teach[1])]
    scales = lambda: [fit_linear(views[v].logit(held_x[v])[:, None], y[held]) for v in (0, 1)]
    for _ in range(rounds):
        judges, sure = [replace(v) for v in views], scales()
        for _ in range(steps):
            learn(views, teach, sums_over_pool(judges, sure, views))
    both = fit_linear(np.c_[views[0].logit(held_x[0]), views[1].logit(held_x[1])], y[held])
    return CoTrained(*views, *scales(), both)


COLUMNS = ["doc_id", "text", "source", "lang", "n_chars"]


def _features(docs: DataFrame, *more: str) -> DataFrame:
    """x (text features), m (``meta_numbers``) and some columns of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, source, lang, n_chars, *others = batch.columns
            x, m = text_features(texts_of(text)), meta_numbers(source.to_pylist(), lang.to_pylist(), n_chars.to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(list(x.astype(np.float32)), pa.list_(pa.float32())), pa.array(list(m), pa.list_(pa.float64())), *others], ["x", "m", *more])

    kinds = dict(docs.dtypes)
    return docs.select(*COLUMNS[1:], *more).mapInArrow(run, ", ".join(["x array<float>", "m array<double>", *(f"{c} {kinds[c]}" for c in more)]))


def _matrices(x: pa.Array, m: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return np.asarray(x.flatten(), np.float64).reshape(-1, N_TEXT), meta_features(np.asarray(m.flatten(), np.float64).reshape(-1, 5))


def train(docs: DataFrame, labels: DataFrame, labelled_rows: int = 6000, rounds: int = 2, steps: int = 3, confident: float = 0.99) -> CoTrained:
    """Fits both views on a bounded sample of labelled documents and on all others.

    ``labelled_rows`` bounds the rows of ``labels(doc_id, quality)`` that teach, the
    smallest by a hash of doc_id; their features come to the driver (about 300 bytes a
    row). Features of all other documents are written once; each of ``rounds`` times
    ``steps`` passes over them returns some 19,000 sums. A view learns from the
    documents for which the other one's calibrated probability of a class is
    ``confident``. Null labels are left out. With fewer than ten labels of either class
    the model keeps everything.
    """
    draw = F.xxhash64(F.lit("quality"), F.col("doc_id"))
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    chosen = materialize(known.orderBy(draw, "doc_id").limit(labelled_rows), "labelled")
    rows = _features(docs.select(*COLUMNS).join(F.broadcast(chosen), "doc_id"), "doc_id", "quality").toArrow()
    order = np.argsort(np.array(rows["doc_id"]), kind="stable") if rows.num_rows else np.zeros(0, np.int64)
    x, m = (rows[c].combine_chunks() if rows.num_rows else pa.array([], pa.list_(pa.float64())) for c in ("x", "m"))
    xa, xb = (v[order] for v in _matrices(x, m))
    others = docs.select(*COLUMNS).join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_anti")
    pool: list[DataFrame] = []

    def sums_over_pool(judges: list[Linear], scales: list[Linear], pupils: list[Linear]) -> np.ndarray:
        size = sum(2 * (1 + n + n * n) for n in (len(pupil.weights) for pupil in pupils))
        if not pool:
            pool.append(materialize(_features(others), "features"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for batch in batches:
                total += taught_sums(_matrices(*batch.columns), judges, scales, pupils, confident)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], ["i", "v"])

        added = pool[0].mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
        out = np.zeros(size)
        out[np.array(added["i"], np.int64)] = np.array(added["v"])
        return out

    return cotrain(xa, xb, np.array(rows["quality"], np.float64)[order], sums_over_pool, rounds, steps)


def score_quality(docs: DataFrame, model: CoTrained, threshold: float = 0.5) -> DataFrame:
    """``docs(doc_id, text, source, lang, n_chars)`` -> doc_id, p_text, p_meta, score, kept.

    ``p_text`` and ``p_meta`` are the calibrated views, ``score`` their combination; a
    document is kept if its score is at least ``threshold``. Null text counts as empty;
    null metadata has features of its own. Repeated rows are scored alike. Texts are
    read whole. Other columns are not read. An empty table gives no rows. A model
    without usable labels scores 1 and keeps everything.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, text, source, lang, n_chars = batch.columns
            a, b, both = model.score(texts_of(text), source.to_pylist(), lang.to_pylist(), n_chars.to_pylist())
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(v, pa.float64()) for v in (a, b, both)), pa.array(both >= threshold)], ["doc_id", "p_text", "p_meta", "score", "kept"])

    return docs.select(*COLUMNS).mapInArrow(run, "doc_id long, p_text double, p_meta double, score double, kept boolean")


def keep_good(docs: DataFrame, model: CoTrained, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that ``score_quality`` would keep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, source, lang, n_chars = (batch.column(batch.schema.get_field_index(c)) for c in COLUMNS[1:])
            both = model.score(texts_of(text), source.to_pylist(), lang.to_pylist(), n_chars.to_pylist())[2]
            yield batch.filter(pa.array(both >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op10_cotraining_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_quality(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
