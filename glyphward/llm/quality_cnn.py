"""Document quality by a byte-level convolutional network in numpy.

Filters of WIDTH bytes run over the whole UTF-8 text. Their responses are max-pooled over
overlapping chunks (two neighbouring segments each), rectified, and a dense layer turns every
chunk into a logit. A logistic layer over the mean, least and largest chunk logit gives the
document's one probability.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphward.llm.labelled import Sample, labelled_sample, logistic, sigmoid
from glyphward.llm.tables import small_batches
from glyphward.llm.worker import give_back, held

WIDTH = 6  # bytes under a filter; even, as scoring looks bytes up in pairs
FILTERS = 16
SEGMENT = 256  # a chunk is two segments, so chunks overlap by half
STRIPE = 64 * SEGMENT  # bytes that are convolved at once
MANY = 1 << 20  # bytes of texts that are scored together


@dataclass
class Network:
    table: np.ndarray  # (WIDTH, 256, FILTERS): what each byte adds at each place of each filter
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: float
    calibration: np.ndarray


class Scorer:
    def __init__(self, net: Network):
        self.net = net
        t = net.table.astype(np.float32)
        self.pairs = [(t[j][:, None, :] + t[j + 1][None, :, :]).reshape(65536, FILTERS) for j in range(0, WIDTH, 2)]

    def pooled(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(segment maxima of all texts in a row, number of segments of each); a text has one at least."""
        sizes = np.array([-(-(len(t) + WIDTH) // SEGMENT) for t in texts], np.int64)
        data = np.zeros(int(sizes.sum()) * SEGMENT + WIDTH, np.uint8)
        # a filter's width of padding before each text, so that no filter sees two texts
        for start, t in zip((np.cumsum(sizes) - sizes) * SEGMENT + WIDTH, texts, strict=True):
            data[start : start + len(t)] = np.frombuffer(t, np.uint8)
        pair = data[:-1].astype(np.uint16) << 8
        pair |= data[1:]
        out = np.empty((int(sizes.sum()), FILTERS), np.float32)
        for at in range(0, len(data) - WIDTH, STRIPE):
            n = min(STRIPE, len(data) - WIDTH - at)
            response = self.pairs[0].take(pair[at : at + n], axis=0)
            for j in range(1, len(self.pairs)):
                response += self.pairs[j].take(pair[at + 2 * j : at + 2 * j + n], axis=0)
            out[at // SEGMENT : (at + n) // SEGMENT] = response.reshape(-1, SEGMENT, FILTERS).max(axis=1)
        return out, sizes

    def summaries(self, texts: list[bytes]) -> np.ndarray:
        """(documents, 3): mean, least and largest logit of the chunks of each text."""
        segments, sizes = self.pooled(texts)
        first = np.cumsum(sizes) - sizes
        last = first + sizes - 1
        chunks = np.maximum(segments, np.r_[segments[1:], segments[-1:]])
        chunks[last] = segments[last]
        keep = np.ones(len(chunks), bool)
        keep[last[sizes > 1]] = False  # the last chunk of a longer text already holds its last segment
        logit = np.maximum(chunks + self.net.bias, 0) @ self.net.dense + self.net.dense_bias
        number = np.maximum(sizes - 1, 1)
        start = np.cumsum(number) - number
        logit = logit[keep]
        return np.c_[np.add.reduceat(logit, start) / number, np.minimum.reduceat(logit, start), np.maximum.reduceat(logit, start)]

    def score(self, texts: list[bytes]) -> np.ndarray:
        out = [np.empty(0)]
        at, size = 0, 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= MANY or i + 1 == len(texts):
                out.append(sigmoid(np.c_[self.summaries(texts[at : i + 1]), np.ones(i + 1 - at)] @ self.net.calibration))
                at, size = i + 1, 0
        return np.concatenate(out)


def fit(sample: Sample, epochs: int = 6, batch: int = 128, seed: int = 11) -> Network:
    """Learn filters and layers from all chunks of the sample by Adam; then calibrate on whole documents.

    A document's chunks share its weight by the root of their number, so that a very long one counts
    for more than a short one, but not for as many as it has chunks.
    """
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.25, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.3, FILTERS).astype(np.float32), 0.0, np.zeros(4))
    texts = [t.encode() for t in sample.texts]
    if len(set(sample.y)) < 2:
        net.calibration[3] = math.log(max(sample.prior, 1e-6) / max(1 - sample.prior, 1e-6))
        return net
    size = 2 * SEGMENT
    # every text is cut into chunks; they are read from one row of bytes
    number = np.array([max(1, -(-len(t) // size)) for t in texts])
    data = np.zeros(int(number.sum()) * size + WIDTH, np.uint8)
    for start, t in zip((np.cumsum(number) - number) * size, texts, strict=True):
        data[start : start + len(t)] = np.frombuffer(t, np.uint8)
    first, behind = np.arange(number.sum()) * size, np.arange(size + WIDTH)
    last = np.zeros(len(first), bool)
    last[np.cumsum(number) - 1] = True
    y = np.repeat(sample.y, number).astype(np.float32)
    weight = np.repeat(1 / np.sqrt(number), number).astype(np.float32)
    for label in (0, 1):
        weight[y == label] *= 0.5 / weight[y == label].sum() * len(y)
    params = [net.table, net.bias, net.dense, np.zeros(1, np.float32)]
    mean, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    k = 0
    for epoch in range(epochs):
        order = rng.permutation(len(first))
        rate = 0.02 if epoch < epochs - 3 else 0.005
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            xb, n = data[first[pick][:, None] + behind], len(pick)
            xb[last[pick], size:] = 0  # what follows is another text
            response = params[0][0].take(xb[:, :size], axis=0)
            for j in range(1, WIDTH):
                response += params[0][j].take(xb[:, j : j + size], axis=0)
            best = response.argmax(axis=1)  # (n, FILTERS)
            top = np.take_along_axis(response, best[:, None, :], axis=1)[:, 0, :] + params[1]
            hidden = np.maximum(top, 0)
            gap = (sigmoid(hidden @ params[2] + params[3]) - y[pick]) * weight[pick] / n
            back = gap[:, None] * params[2] * (top > 0)
            table = np.zeros_like(params[0])
            filters = np.arange(FILTERS)
            for j in range(WIDTH):
                hit = xb[np.arange(n)[:, None], best + j].astype(np.int64) * FILTERS + filters
                table[j] = np.bincount(hit.ravel(), back.ravel(), 256 * FILTERS).reshape(256, FILTERS)
            grads = [table, back.sum(axis=0), hidden.T @ gap + 1e-4 * params[2], gap.sum(keepdims=True)]
            k += 1
            for p, g, f, s in zip(params, grads, mean, square, strict=True):
                f += 0.1 * (g - f)
                s += 0.01 * (g * g - s)
                p -= (rate * (f / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.99**k)) + 1e-7)).astype(np.float32)
    net.table, net.bias, net.dense, net.dense_bias = params[0], params[1], params[2], float(params[3][0])
    scorer = Scorer(net)
    features = np.concatenate([scorer.summaries(texts[i : i + 200]) for i in range(0, len(texts), 200)])
    balance = np.where(sample.y == 1, sample.prior / sample.y.mean(), (1 - sample.prior) / (1 - sample.y.mean()))
    net.calibration = logistic(features, sample.y, balance)
    del data, first, behind, features
    give_back()
    return net


def quality(net: Network) -> Callable:
    """A column function: binary UTF-8 text -> probability of label 1 by ``net``."""
    number = hash((net.table.tobytes(), net.calibration.tobytes()))

    @F.arrow_udf("double")
    def cnn(text: pa.Array) -> pa.Array:
        return pa.array(held(("quality", number), lambda: Scorer(net)).score([t.as_py() or b"" for t in text]), pa.float64())

    return cnn


def fit_quality(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, good_docs: int = 3000, bad_docs: int = 3000) -> Network:
    """Fit on at most ``good_docs`` and ``bad_docs`` labelled documents outside the held-out fold."""
    return fit(labelled_sample(docs, labels, "quality", folds, held_out, {1: good_docs, 0: bad_docs}))


def score_quality(docs: DataFrame, net: Network, column: str = "quality") -> DataFrame:
    """``docs`` with a double column, the probability of label 1 of the whole text.

    Null and empty texts count as one chunk of padding. Repeated rows score alike; other columns stay.
    """
    return small_batches(docs).withColumn(column, quality(net)(F.col("text").cast("binary")))
