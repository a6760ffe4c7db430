"""Operator 6, mixing sources to target weights by soft membership (DataFrame functions only).

A labelled table trains a naive Bayes classifier over the distinct words of a text, by grouped counts on a
bounded sample of labelled documents: the ``vocabulary`` letter runs (and marks for texts that repeat
themselves, or are full of symbols or capitals) that tell the domains apart best.  Only words that are there count, so that a short text stays near the prior.  Every document then gets posterior probabilities of the domains, so it
belongs to several domains softly.  Rates r >= 0 are fitted by projected gradient least squares:

    minimise  sum_k (sum_d n_d r_d p_dk - T_k)^2,   r_d >= 0,   from r_d = ``fraction``

with n_d the tokens of document d, p_dk its posteriors and T_k the target tokens of domain k (its weight
times ``fraction`` of all tokens).  The gradient step of a document needs only its own posteriors and the K gaps
T_k - sum, which are scaled by K x K sums of the posteriors; so a step is one aggregate over all documents of
K (K + 2) sums that reach the driver, and one more vector in a literal array that a short fold applies.  Every
``STEPS_PER_CUT`` steps the rates so far are written, so that a pass does not repeat all former ones.  No document is
collected and nothing is shuffled but partial sums.  A rate above 1 means repeats; ``copies`` turns the
rate into a whole number with the expectation of the rate, by a hash of the id.

A token is a run of letters, combining marks and digits of any script.  Defined results: a null or empty text has no tokens, the prior's posteriors and a rate like any other;
without labelled rows the posteriors are even; a domain with no expected tokens can't be raised (its gap
stays and does no harm); rows with a null doc_id get a rate and copies by the hash of null; repeated rows
count each; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import warnings
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .samples import bounded_sample
from .tables import cut, texts


def words_of(text: str = "text") -> Column:
    """The words of a text as white space parts them, none for a null one."""
    parts = F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+")
    return F.filter(parts, lambda w: w != "")


def _described(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens (runs of letters, marks and digits) and m: the distinct ones and marks of the text's form.

    One split of each text; marks hold a space, which no run does.
    """
    rows = texts(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.split(F.lower("text"), r"[^\p{L}\p{M}\p{N}]+").alias("runs"))
    empty = lambda at: F.when(F.element_at("runs", at) == "", 1).otherwise(0)
    rows = rows.select("doc_id", "text", F.array_distinct("runs").alias("distinct"),
                       F.greatest(F.lit(0), F.size("runs") - empty(1) - empty(-1)).cast("long").alias("n_tokens"))
    without = lambda pattern: F.length("text") - F.length(F.regexp_replace("text", pattern, ""))
    mark = lambda name, test: F.when(test, F.array(F.lit(f" {name}"))).otherwise(F.array().cast("array<string>"))
    return rows.select("doc_id", "n_tokens", F.concat(
        "distinct", mark("repeated", F.size("distinct") * 3 < F.col("n_tokens")), mark("symbols", without("[*$#&%|!]+") * 25 > F.length("text")),
        mark("capitals", without("[A-Z]+") * 3 > F.length("text"))).alias("m"))


def fit_classifier(docs: DataFrame, labelled: DataFrame, domains: list[str], vocabulary: int = 120, bound: int = 1500) -> list[tuple]:
    """(word or None for the prior, log-probability in each domain), from at most ``bound`` documents a domain.

    ``labelled`` has doc_id and domain.  The priors are those of the whole labelled table.
    """
    labelled = labelled.where(F.col("doc_id").isNotNull() & F.col("domain").isin(domains)).dropDuplicates(["doc_id"])
    known = {r.domain: r.n for r in labelled.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    some = bounded_sample(labelled, "domain", "doc_id", bound)
    rows = texts(docs).join(F.broadcast(some), "doc_id")
    rows = _described(rows).join(F.broadcast(some), "doc_id").select("doc_id", "domain", F.array_remove("m", "").alias("w"))
    rows = cut(rows.dropDuplicates(["doc_id"]))
    size = {r.domain: r.n for r in rows.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    total = sum(size.values())
    if not total:
        return [(None, tuple(0.0 for _ in domains))]
    per = cut(rows.select("domain", F.explode("w").alias("word")).groupBy("word")
              .agg(*(F.sum((F.col("domain") == d).cast("int")).alias(f"c{i}") for i, d in enumerate(domains))))
    rate = [(F.col(f"c{i}") + 0.5) / (size.get(d, 0) + 1.0) for i, d in enumerate(domains)]
    weight = [size.get(d, 0) / total for d in domains]
    mean = reduce(lambda a, b: a + b, (r * w for r, w in zip(rate, weight, strict=True)))
    gain = reduce(lambda a, b: a + b, (w * (r * F.log(r / mean) + (1 - r) * F.log((1 - r) / (1 - mean)))
                                       for r, w in zip(rate, weight, strict=True)))
    best = per.select("word", gain.alias("g"), *(f"c{i}" for i in range(len(domains)))).orderBy(F.desc("g"), "word").limit(vocabulary).collect()
    base = [math.log((known.get(d, 0) + 0.5) / (sum(known.values()) + 0.5 * len(domains))) for d in domains]
    # chances among the vocabulary's words alone: then a word as common in every domain tells nothing, however long its documents are
    drawn = [sum(r[f"c{i}"] for r in best) + 0.5 * len(best) for i in range(len(domains))]
    return [(None, tuple(base))] + [(r.word, tuple(math.log((r[f"c{i}"] + 0.5) / n) for i, n in enumerate(drawn))) for r in best]


def posteriors(docs: DataFrame, model: list[tuple], domains: list[str]) -> DataFrame:
    """doc_id, n_tokens, p (array of probabilities in the order of ``domains``) of every row."""
    vocabulary = {w: shifts for w, shifts in model if w is not None}
    base = next(shifts for w, shifts in model if w is None)
    rows = _described(docs)
    if vocabulary:
        found = F.array_intersect("m", F.array(*map(F.lit, vocabulary)))
        shift = F.create_map(*(F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for pair in vocabulary.items() for x in pair))
        rows = rows.withColumn("found", F.transform(found, lambda w: shift[w]))
        add = lambda i: lambda total, shifts: total + shifts[i]
        score = [F.aggregate("found", F.lit(b), add(i)) for i, b in enumerate(base)]
    else:
        score = [F.lit(b) for b in base]
    rows = rows.select("doc_id", "n_tokens", *(s.alias(f"s{i}") for i, s in enumerate(score)))
    top = F.greatest(*(f"s{i}" for i in range(len(domains)))) if len(domains) > 1 else F.col("s0")
    rows = rows.select("doc_id", "n_tokens", *(F.exp(F.col(f"s{i}") - top).alias(f"e{i}") for i in range(len(domains))))
    total = reduce(lambda a, b: a + b, (F.col(f"e{i}") for i in range(len(domains))))
    return rows.select("doc_id", "n_tokens", F.array(*(F.col(f"e{i}") / total for i in range(len(domains)))).alias("p"))


#: Steps after which the rates so far are written, so that no pass repeats more than these.
STEPS_PER_CUT = 8


def _stepped(rate: Column, moves: list[list[float]]) -> Column:
    """``rate`` after projected gradient steps along these combinations of the posteriors: one short fold, whatever their number."""
    if not moves:
        return rate
    k = range(len(moves[0]))
    step = lambda r, m: F.greatest(F.lit(0.0), reduce(lambda a, b: a + b, (F.get("p", F.lit(i)) * F.get(m, F.lit(i)) for i in k), r))
    return F.aggregate(F.array(*(F.array(*map(F.lit, m)) for m in moves)), rate, step)


def scaled_step(goal: np.ndarray, now: np.ndarray, there: np.ndarray, moments: np.ndarray, worse: bool) -> np.ndarray:
    """The move lambda of the next step r <- max(0, r + p . lambda).

    The gradient's gaps, scaled by the inverse of sum n p p' over the documents with a rate above 0: exact as long as no other
    rate reaches 0.  After a step that did not help, the plain one, gap / tokens, which always descends.
    """
    gap = np.where(there > 1e-9 * there.sum(), goal - now, 0.0)
    if worse:
        return gap / np.maximum(there, 1e-9 * there.sum())
    return np.linalg.lstsq(moments, gap, rcond=1e-9)[0]


def fit_rates(members: DataFrame, targets: list[float], fraction: float = 0.5, steps: int = 60, tolerance: float = 1e-4) -> Column:
    """The fitted rate as a column of ``members`` (n_tokens, p).

    Stops when each domain's tokens are within ``tolerance`` of its target; a RuntimeWarning tells what is left after ``steps``.
    Domains without tokens can't be raised and don't count.
    """
    k = len(targets)
    state = members.select(F.col("n_tokens").cast("double").alias("n"), "p", F.lit(float(fraction)).alias("r"))

    def sums(moves: list[list[float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of each domain, those drawn, and the second moments of the posteriors where the rate is above 0."""
        now = state.select("n", "p", _stepped(F.col("r"), moves).alias("r")).select("n", "r", *(F.col("p")[i].alias(f"p{i}") for i in range(k)))
        active = F.when(F.col("r") > 0, F.col("n")).otherwise(0.0)
        row = now.agg(*(F.sum(F.col("n") * F.col(f"p{i}")) for i in range(k)), *(F.sum(F.col("n") * F.col("r") * F.col(f"p{i}")) for i in range(k)),
                      *(F.sum(active * F.col(f"p{i}") * F.col(f"p{j}")) for i in range(k) for j in range(k))).first()
        row = np.array([x or 0.0 for x in row])
        return row[:k], row[k:2 * k], row[2 * k:].reshape(k, k)

    there, now, moments = sums([])
    if not there.sum():
        return F.lit(float(fraction))
    goal = np.array(targets, float) / sum(targets) * fraction * there.sum()
    off = lambda: max((abs(g - s) / g for g, s, t in zip(goal, now, there, strict=True) if g and t > 1e-9 * there.sum()), default=0.0)
    done: list[list[float]] = []
    recent: list[list[float]] = []
    before = math.inf
    for _ in range(steps):
        left = off()
        if left < tolerance:
            break
        move = scaled_step(goal, now, there, moments, left > 0.9 * before).tolist()
        before = left
        done.append(move)
        recent.append(move)
        _, now, moments = sums(recent)
        if len(recent) == STEPS_PER_CUT:
            state, recent = cut(state.select("n", "p", _stepped(F.col("r"), recent).alias("r"))), []
    if tolerance and off() >= tolerance:
        warnings.warn(f"token totals are up to {off():.2%} off their targets after {steps} steps", RuntimeWarning, stacklevel=2)
    return _stepped(F.lit(float(fraction)), done)


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], fraction: float = 0.5, vocabulary: int = 120,
        bound: int = 1500) -> DataFrame:
    """doc_id, n_tokens, p_<domain> for each domain, rate and copies of every row of ``docs``."""
    domains = sorted(targets)
    members = cut(posteriors(docs, fit_classifier(docs, labelled, domains, vocabulary, bound), domains))
    out = members.withColumn("rate", fit_rates(members, [targets[d] for d in domains], fraction))
    draw = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)), F.lit(6)), F.lit(1 << 30)) / float(1 << 30)
    return out.select("doc_id", "n_tokens", *(F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(domains)), "rate",
                      (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("long")).alias("copies"))


#: Domains of the labels table and the token weights wanted.
TARGETS = {"good": 0.85, "low": 0.05, "toxic": 0.10}


def label_domains(labels: DataFrame) -> DataFrame:
    """doc_id and domain: toxic texts, else those of low quality, else good ones; unlabelled rows are left out."""
    return labels.select(labels["doc_id"].cast("long").alias("doc_id"), F.when(labels["toxic"] == 1, "toxic").when(labels["quality"] == 0, "low")
                         .when(labels["quality"] == 1, "good").alias("domain")).where("domain IS NOT NULL")
