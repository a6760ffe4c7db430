"""Operator 4, document quality by a linear-chain conditional random field over lines.

A document's lines are a chain of labels, bad or good.  A line's features are shares and counts of
its characters and words (symbols, bars, capitals, digits, repeated words, repeated lines, lengths), cut
into bins; the emission of a line adds the weights of its own bins and of those of the lines before and
after it, and a transition weight joins neighbouring labels.  Weights are trained in numpy by the exact
gradient of the conditional likelihood (forward-backward) on a bounded sample of labelled documents,
each line bearing its document's label.  A document's score is the mean of its lines' marginal
probabilities of being good, weighted by their lengths.

Scoring is batched: the chains of a batch advance together, one position at a time.

Defined results: a null or empty text, and one of white space only, scores 0; with no labelled row,
or labels of one kind only, the score is the labels' mean (0.5 without any); rows with a null doc_id are
scored and not held out; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .samples import bounded_sample, held_out
from .words import _SPACE, Words, slices, text_bytes

BINS = 6
_KIND = np.zeros(256, dtype=np.int8)  # 1 lower, 2 upper, 3 digit, 4 full stop or comma, 5 bar, 6 other symbol
_KIND[97:123] = 1
_KIND[128:] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3
_KIND[[44, 46]] = 4
_KIND[124] = 5
_KIND[[c for c in range(33, 127) if not _KIND[c]]] = 6


def line_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document of each line, its bytes, its features); lines of white space only are left out."""
    offsets, data = text_bytes(column)
    n = len(data)
    # lines as spans: cut at every newline and at every row's end
    stop = np.zeros(n + 1, bool)
    stop[offsets] = True
    stop[:n] |= data == 10
    ends = np.flatnonzero(stop[1:]) + 1 if n else np.zeros(0, np.int64)
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64) if len(ends) else ends
    words = Words(column)
    # words of a line; a newline is white space, so that no word crosses a line
    first = np.searchsorted(words.start, starts)
    count = np.diff(np.append(first, len(words.start)))
    keep = count > 0
    starts, ends, first, count = starts[keep], ends[keep], first[keep], count[keep]
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 12))
    doc = np.searchsorted(offsets, starts, side="right") - 1
    size = (ends - starts).astype(np.float64)
    kind = _KIND[data]
    per = [np.diff(np.concatenate(([0], np.cumsum(kind == k, dtype=np.int64)))[np.stack((starts, ends))], axis=0)[0] / size
           for k in range(1, 7)]
    h = words.hash
    again = np.zeros(len(h) + 1)
    again[1:len(h)] = h[1:] == h[:-1]
    again[first] = 0
    repeat = np.add.reduceat(again[:-1], first) / count
    line = np.repeat(np.arange(len(first)), count)
    covered = np.zeros(len(h), bool)
    order = np.lexsort((h, line))
    covered[order[1:]] = (h[order][1:] == h[order][:-1]) & (line[order][1:] == line[order][:-1])
    seen = np.add.reduceat(covered.astype(float), first) / count
    length = np.add.reduceat((words.end - words.start).astype(float), first) / count
    with np.errstate(over="ignore"):
        whole = np.add.reduceat(h * np.uint64(0x9E3779B97F4A7C15) + (h >> np.uint64(7)), first)
    key = np.lexsort((whole, doc))
    twice = np.zeros(len(whole))
    twice[key[1:]] = (whole[key][1:] == whole[key][:-1]) & (doc[key][1:] == doc[key][:-1])
    tail = kind[words.end[first + count - 1] - 1] == 6
    capital = per[1] / np.maximum(per[0] + per[1], 1e-9)
    features = np.stack((np.log1p(size), capital, per[2], per[3], per[4], per[5], repeat, seen, length,
                         twice, tail.astype(float), np.log1p(count)), axis=1)
    return doc, ends - starts, features


@dataclass
class LineModel:
    edges: np.ndarray     # features x (BINS - 1): where bins end
    weights: np.ndarray   # (before, own, after) x features x BINS: log-odds of a good line
    bias: float
    change: np.ndarray    # 2 x 2 transition weights
    constant: float | None = None

    def emissions(self, doc: np.ndarray, features: np.ndarray) -> np.ndarray:
        return self._sum(self.bins(features), doc) + self.bias

    def bins(self, features: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, features[:, i], side="left") for i, e in enumerate(self.edges)], axis=1)

    def _sum(self, bins: np.ndarray, doc: np.ndarray) -> np.ndarray:
        f = np.arange(bins.shape[1])
        own = self.weights[1][f, bins].sum(axis=1)
        before, after = self.weights[0][f, bins].sum(axis=1), self.weights[2][f, bins].sum(axis=1)
        same = doc[1:] == doc[:-1]
        own[1:] += np.where(same, before[:-1], 0)
        own[:-1] += np.where(same, after[1:], 0)
        return own


def marginals(emission: np.ndarray, doc: np.ndarray, change: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(P(good) of each line, expected transition counts), forward-backward over all chains at once."""
    head = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))) if len(doc) else np.zeros(0, np.int64)
    size = np.diff(np.append(head, len(doc)))
    order = np.argsort(-size, kind="stable")
    head, size = head[order], size[order]
    ahead = np.zeros((len(doc), 2))
    back = np.zeros((len(doc), 2))
    e = np.stack((np.zeros(len(doc)), emission), axis=1)
    longest = int(size[0]) if len(size) else 0
    for t in range(longest):
        active = int(np.searchsorted(-size, -t, side="left"))  # chains longer than t
        at = head[:active] + t
        if t == 0:
            ahead[at] = e[at]
        else:
            before = ahead[at - 1][:, :, None] + change
            ahead[at] = np.logaddexp(before[:, 0], before[:, 1]) + e[at]
            ahead[at] -= ahead[at].max(axis=1, keepdims=True)
    for t in range(longest - 2, -1, -1):
        active = int(np.searchsorted(-size, -(t + 1), side="left"))
        at = head[:active] + t
        after = change + (e[at + 1] + back[at + 1])[:, None, :]
        back[at] = np.logaddexp(after[:, :, 0], after[:, :, 1])
        back[at] -= back[at].max(axis=1, keepdims=True)
    both = ahead + back
    good = 1.0 / (1.0 + np.exp(np.clip(both[:, 0] - both[:, 1], -700, 700)))
    pairs = np.zeros((2, 2))
    link = np.flatnonzero(doc[1:] == doc[:-1]) if len(doc) else head
    if len(link):
        joint = ahead[link][:, :, None] + change + (e[link + 1] + back[link + 1])[:, None, :]
        joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
        pairs = (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return good, pairs


def train(column: pa.Array, labels: np.ndarray, steps: int = 150, rate: float = 0.1, decay: float = 1e-3) -> LineModel:
    labels = np.asarray(labels, dtype=float)
    parts = []
    for start in range(0, len(column), 64):  # a few rows at a time: byte tables of all would be large
        d, _, f = line_features(column.slice(start, 64))
        parts.append((d + start, f))
    doc = np.concatenate([d for d, _ in parts] or [np.zeros(0, np.int64)])
    features = np.concatenate([f for _, f in parts] or [np.zeros((0, 12))])
    empty = LineModel(np.zeros((12, BINS - 1)), np.zeros((3, 12, BINS)), 0.0, np.zeros((2, 2)))
    if not len(doc) or labels[np.unique(doc)].min() == labels[np.unique(doc)].max():
        empty.constant = float(labels.mean()) if len(labels) else 0.5
        return empty
    edges = []
    for i in range(features.shape[1]):  # bins at quantiles of the values above the least one
        x = features[:, i]
        rest = x[x > x.min()]
        edges.append(np.concatenate(([x.min()], np.quantile(rest, np.linspace(0, 1, BINS)[1:-1]))) if len(rest)
                     else np.full(BINS - 1, x.min()))
    model = LineModel(np.array(edges), np.zeros((3, 12, BINS)), 0.0, np.zeros((2, 2)))
    bins, truth = model.bins(features), labels[doc]
    same = np.flatnonzero(doc[1:] == doc[:-1])
    seen = np.zeros((2, 2))
    np.add.at(seen, (truth[same].astype(int), truth[same + 1].astype(int)), 1)
    # each document counts the same, whatever its number of lines
    flat = (np.arange(12) * BINS + bins)
    parts = [np.zeros((3, 12, BINS)), np.zeros(1), np.zeros((2, 2))]
    moment, square = [p.copy() for p in parts], [p.copy() for p in parts]
    for step in range(1, steps + 1):
        good, pairs = marginals(model._sum(bins, doc) + model.bias, doc, model.change)
        gap = truth - good
        count = lambda which, value: np.bincount(flat[which].ravel(), weights=np.repeat(value, 12), minlength=12 * BINS).reshape(12, BINS)
        grads = [np.stack((count(same, gap[same + 1]), count(np.arange(len(doc)), gap), count(same + 1, gap[same]))) / len(doc)
                 - decay * model.weights,
                 np.array([gap.mean()]), (seen - pairs) / len(doc) - decay * model.change]
        for i, g in enumerate(grads):  # Adam
            moment[i] = 0.9 * moment[i] + 0.1 * g
            square[i] = 0.99 * square[i] + 0.01 * g * g
            move = rate * (moment[i] / (1 - 0.9 ** step)) / (np.sqrt(square[i] / (1 - 0.99 ** step)) + 1e-8)
            if i == 0:
                model.weights = model.weights + move
            elif i == 1:
                model.bias += float(move[0])
            else:
                model.change = model.change + move
    return model


def scores(model: LineModel, column: pa.Array) -> np.ndarray:
    if model.constant is not None:
        return np.full(len(column), model.constant)
    doc, size, features = line_features(column)
    good, _ = marginals(model.emissions(doc, features), doc, model.change)
    total = np.bincount(doc, weights=size, minlength=len(column))
    return np.clip(np.bincount(doc, weights=size * good, minlength=len(column)) / np.maximum(total, 1), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text",
        bound: int = 4000) -> LineModel:
    """Train on at most ``bound`` labelled documents, none of them held out."""
    marks = labels.select(labels[key].alias("k"), labels[label].cast("int").alias("l")).where(
        "k IS NOT NULL AND l IN (0, 1)").dropDuplicates(["k"]).where(~held_out(F.col("k")))
    some = bounded_sample(marks.withColumn("any", F.lit(1)), "any", "k", bound)
    rows = sorted(docs.select(docs[key].alias("k"), docs[text].alias("t")).where("t IS NOT NULL")
                  .join(F.broadcast(some), "k").select("k", "t", "l").collect())
    return train(pa.array([r.t for r in rows], pa.string()), np.array([r.l for r in rows]))


def score_documents(docs: DataFrame, model: LineModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and the score, 0 to 1, higher for likelier good."""
    rows = docs.select(*(docs[c] for c in keep), docs[text].alias("_text"))
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, len(keep)):
            yield pa.RecordBatch.from_arrays(
                [*(piece.column(i) for i in range(len(keep))), pa.array(scores(model, piece.column(len(keep))), pa.float64())],
                names=[*keep, "score"])

    return rows.mapInArrow(run, f"{out}, score double")
