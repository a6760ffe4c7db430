"""Operator 8, language identification by averaged subword embeddings.

A text's features are its hashed byte 2-, 3- and 4-grams (letters only, lower case, every other
character a word boundary, no gram across one).  Their embeddings are averaged and a linear softmax
names the language.  Embeddings and weights are trained together by stochastic gradient descent in numpy
on a bounded sample of labelled documents: whole texts and short excerpts of them, so that texts
of a few words are known too.  A fifth of the sample is kept back; on it a temperature is fitted
(with excerpts) that makes the scores probabilities, and the rejection bound is set: the least score at
which the accepted rows are right in ``precision`` of the cases, but never above the score that all but
``loss`` of the right rows reach, nor above one half, so that clean documents stay.

Since the average is linear, each gram's embedding is multiplied with the weights once; a prediction adds
up rows of that table (a few hundred kB, whatever the corpus) over the whole text.

Defined results: a null text or one without letters is ``und`` with score 0 and rejected; with no labelled
row at all every text is ``und``; equal scores go to the alphabetically first language; rows with a
null doc_id are predicted and not held out; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .samples import bounded_sample, held_out
from .words import slices, text_bytes

BUCKETS = 1 << 15
SIZES = (2, 3, 4)


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # BUCKETS x languages: a gram's share in the scores
    bias: np.ndarray
    temperature: float = 1.0
    bound: float = 0.0

    def probabilities(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(rows x languages, which rows have letters)."""
        row, bucket = subwords(column)
        n = np.bincount(row, minlength=len(column))
        total = np.stack([np.bincount(row, weights=self.table[bucket, k], minlength=len(column))
                          for k in range(len(self.languages))], axis=1)
        scores = (total / np.maximum(n, 1)[:, None] + self.bias) / self.temperature
        scores = np.exp(scores - scores.max(axis=1, keepdims=True))
        letters = pc.match_substring_regex(column.fill_null(""), r"\pL").to_numpy(zero_copy_only=False)
        return scores / scores.sum(axis=1, keepdims=True), letters


def subwords(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each gram of a text column."""
    offsets, data = text_bytes(pc.utf8_lower(column.fill_null("")))
    letter = (data >= 128) | ((data >= 97) & (data <= 122))
    n = len(data) + 2
    code = np.zeros(n, dtype=np.uint32)  # 0: boundary
    code[1:-1][letter] = data[letter]
    owner = np.zeros(n, dtype=np.int32)
    owner[1:-1] = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    owner[-1] = len(offsets) - 2
    # between two rows that touch, the grams of the later row would miss their boundary: that byte counts
    rows, buckets = [], []
    for size in SIZES:
        m = n - size + 1
        if m <= 0:
            continue
        ok = (owner[:m] == owner[size - 1:]) | (code[:m] == 0)
        hashed = np.full(m, size, dtype=np.uint32)
        for j in range(size):
            hashed = hashed * np.uint32(0x01000193) ^ code[j:j + m]
            if 0 < j < size - 1 or size == 2:
                ok &= code[j:j + m] != 0
        if size == 2:
            ok &= (code[:m] != 0)
        at = np.flatnonzero(ok)
        h = hashed[at]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        rows.append(owner[at + size - 1] if size == 2 else owner[at + 1])
        buckets.append((h >> np.uint32(17)).astype(np.int32))
    if not rows:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    return np.concatenate(rows), np.concatenate(buckets)


def _bags(column: pa.Array, rows: int = 64) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, weights that add up to 1) of each row; a few rows at a time, since all grams of all are many."""
    out = []
    for start in range(0, len(column), rows):
        part = column.slice(start, rows)
        row, bucket = subwords(part)
        both, count = np.unique(row.astype(np.int64) << 32 | bucket, return_counts=True)
        cuts = np.searchsorted(both >> 32, np.arange(len(part) + 1))
        out += [((both[a:b] & 0xFFFFFFFF).astype(np.int32), (count[a:b] / max(1, count[a:b].sum())).astype(np.float32))
                for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return out


def train(texts: list[str], labels: list[str], dim: int = 16, epochs: int = 4, rate: float = 3.0,
          precision: float = 0.995, loss: float = 0.002, seed: int = 7) -> LanguageModel:
    languages = sorted(set(labels))
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0))
    rng = np.random.default_rng(seed)
    target = np.array([languages.index(x) for x in labels])
    order = rng.permutation(len(texts))
    keep = order[:len(order) // 5] if len(order) >= 50 else order[:0]
    samples, goal = [], []
    for i in (order[len(keep):] if len(keep) else order):
        words = texts[i].split()
        samples.append(texts[i])
        goal.append(target[i])
        for length in (4, 15):
            if len(words) > length:
                at = int(rng.integers(0, len(words) - length))
                samples.append(" ".join(words[at:at + length]))
                goal.append(target[i])
    bags = _bags(pa.array(samples))
    embed = rng.normal(0, 0.1, (BUCKETS, dim))
    weight, bias = rng.normal(0, 0.1, (dim, len(languages))), np.zeros(len(languages))
    epochs = max(epochs, -(-6000 // len(bags)))  # a small sample is gone through more often
    steps = epochs * len(bags)
    done = 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            bucket, share = bags[i]
            done += 1
            if not len(bucket):
                continue
            lr = rate * (1 - done / (steps + 1))
            mean = share @ embed[bucket]
            score = mean @ weight + bias
            p = np.exp(score - score.max())
            p /= p.sum()
            p[goal[i]] -= 1.0
            back = weight @ p
            weight -= 0.05 * lr * np.outer(mean, p)
            bias -= 0.01 * lr * p
            embed[bucket] -= lr * share[:, None] * back
    model = LanguageModel(languages, (embed @ weight).astype(np.float32), bias)
    if len(keep):
        excerpts = [" ".join(texts[i].split()[:4]) for i in keep]
        _calibrate(model, [texts[i] for i in keep] + excerpts, np.tile(target[keep], 2), precision, loss)
    return model


def _calibrate(model: LanguageModel, texts: list[str], target: np.ndarray, precision: float, loss: float) -> None:
    raw = np.concatenate([np.log(model.probabilities(pa.array(texts[i:i + 64]))[0] + 1e-300) for i in range(0, len(texts), 64)])

    def shares(t: float) -> np.ndarray:
        p = np.exp((raw - raw.max(axis=1, keepdims=True)) / t)
        return p / p.sum(axis=1, keepdims=True)

    best = (np.inf, 1.0)
    for t in np.geomspace(0.1, 10, 41):
        p = shares(float(t))
        best = min(best, (-np.log(p[np.arange(len(target)), target] + 1e-9).mean(), float(t)))
    model.temperature = best[1]
    p = shares(model.temperature)
    score, right = p.max(axis=1), p.argmax(axis=1) == target
    order = np.argsort(-score)
    exact = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(exact >= precision)
    wanted = score[order[good[-1]]] if len(good) else 1.0
    allowed = np.quantile(score[right], loss) if right.any() else 0.0
    model.bound = float(min(wanted, allowed, 0.5))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang",
        bound: int = 300) -> LanguageModel:
    """Train on at most ``bound`` documents a language, none of them held out."""
    rows = docs.select(docs[key].alias("k"), docs[text].alias("t"), docs[label].alias("l")).where(
        "k IS NOT NULL AND t IS NOT NULL AND l IS NOT NULL").where(~held_out(F.col("k")))
    chosen = bounded_sample(rows.select("k", "l"), "l", "k", bound).select("k").distinct()
    some = sorted(rows.join(F.broadcast(chosen), "k").dropDuplicates(["k"]).select("k", "t", "l").collect())
    return train([r.t for r in some], [r.l for r in some])


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns with lang_pred, score (a probability) and rejected (below the bound)."""
    rows = docs.select(*(docs[c] for c in keep), docs[text].alias("_text"))
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, len(keep)):
            column = piece.column(len(keep))
            if model.languages:
                p, letters = model.probabilities(column)
                score, best = p.max(axis=1) * letters, p.argmax(axis=1)
            else:
                letters = np.zeros(len(column), bool)
                score, best = np.zeros(len(column)), np.zeros(len(column), np.int64)
            name = np.array([*model.languages, "und"], dtype=object)[np.where(letters, best, len(model.languages))]
            yield pa.RecordBatch.from_arrays(
                [*(piece.column(i) for i in range(len(keep))), pa.array(name, pa.string()),
                 pa.array(score.astype(np.float64)), pa.array(~letters | (score < model.bound))],
                names=[*keep, "lang_pred", "score", "rejected"])

    return rows.mapInArrow(run, f"{out}, lang_pred string, score double, rejected boolean")
