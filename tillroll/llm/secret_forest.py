"""Operator 5, secret scans with a random forest that removes false positives.

Candidates are long runs of ``[A-Za-z0-9+/=_.-]`` (leftmost, maximal, cut after ``name=``, marks at their ends cut
off), and whatever is assigned to a secret-like name or stands as the password of an address, of any length and characters.
Each gets features: its length, its characters (share of
digits, capitals, hexadecimal characters; entropy; digits or letters at all), its transitions between character classes, how much
of it a dictionary of common word pieces covers, whether it stands in a path or an address, whether it is a usual
placeholder, and the words beside it (assigned to a secret-like name, a checksum or identifier name, quoted, followed by prose).
A random forest trained in numpy from the candidates of labelled texts decides; the default texts are made by rule in
``labelled_findings``.  Candidates may lie in one another; findings that overlap become one.

The scan is a pure projection: no shuffle, so hot sources and copies don't matter.

Defined results: a null or empty text has no findings; columns outside ``keep`` are dropped; an empty table gives no
rows; very long texts are scanned whole in linear time.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .words import slices

_RUN = re.compile(r"[A-Za-z0-9+/=_.-]{16,}")
_LETTER, _DIGIT = re.compile(r"[A-Za-z]"), re.compile(r"[0-9]")
# fixed values: names beside a candidate that tell what it is, and common pieces of words
SECRET_NAMES = ("token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "key", "auth", "bearer", "credential", "private")
HARMLESS_NAMES = ("sha", "sha1", "sha256", "md5", "commit", "checksum", "digest", "hash", "uuid", "guid", "id", "revision", "etag", "version", "integrity")
PIECES = ("the", "ing", "tion", "and", "ent", "er", "on", "in", "re", "th", "an", "es", "ed", "or", "st", "user", "name", "file", "test", "data",
          "page", "http", "www", "com", "index", "html", "image", "lib", "src", "main", "example", "value", "config", "default", "list", "item")
PLACEHOLDERS = frozenset("null none nil true false yes no str string text int bool bytes object required optional missing unset undefined empty default "
                         "example changeme placeholder redacted hidden secret password token key value name user username your here input env any".split())
FEATURES = 20
_CUT = re.compile(r"=+(?=[^=])")
_ASSIGN = re.compile(r"(?:=>|:=|={1,3}|:(?!//))[ \t]{0,4}")
_ASSIGN_END = re.compile(_ASSIGN.pattern + r"[A-Za-z]{0,2}[\"'`]{0,3}$")
# a secret-like name, whole or at the end of a longer one, with its type if it has one; or the user of an address
_NAMED = re.compile(
    r"(?:(?:(?<![A-Za-z])(?i:api_?key|token|secret|passw(?:or)?d|pwd|key|auth|bearer|credential|private)|(?i:passw(?:or)?d|pwd|api_?key|secret)"
    r"|(?<=[a-z0-9])(?:Token|Key|Auth|Credential))s?[\"'\]]{0,2}(?:[ \t]{0,4}:[ \t]{0,4}[A-Za-z]{1,20})?[ \t]{0,4}|://[^\s/:@]{0,64})$")
_PASSWORD = re.compile(r"[^\s/]{1,200}@")
_QUOTED = re.compile(r"[A-Za-z]{0,2}(?:\"((?:[^\"\\\n]|\\.)+)\"|'((?:[^'\\\n]|\\.)+)')")
_VALUE = re.compile(r"[\"'`]{0,3}((?:(?![&,;][ \t]?[\"']?[\w.-]{1,40}[ \t]?[:=])\S)+)")
_OPEN = {")": "(", "]": "[", "}": "{", ">": "<"}


def _assigned(text: str) -> list[tuple[int, int]]:
    """What follows each secret-like name, in quotes or up to white space, the next parameter or the next such name."""
    out, names = [], []
    for m in _ASSIGN.finditer(text):
        low = max(0, m.start() - 72)
        if (name := _NAMED.search(text[low:m.start()])) and (name.group()[0] != ":" or _PASSWORD.match(text, m.end())):
            names.append((low + name.start(), m.end(), name.group()[0] == ":"))
    for (_, at, address), after in zip(names, [*names[1:], None]):
        stop = max(at, after[0]) if after else len(text)
        if address:
            out.append((at, text.rfind("@", at, _PASSWORD.match(text, at).end())))
        elif quoted := _QUOTED.match(text, at, stop):
            out.append(quoted.span(1 if quoted.group(1) else 2))
        elif value := _VALUE.match(text, at, stop):
            start, end = value.span(1)
            unopened = {close for close, opening in _OPEN.items() if opening not in value.group(1)}  # trimming takes no opening one
            while end > start and (text[end - 1] in ",;.\"'`" or text[end - 1] in unopened):
                end -= 1
            out.append((start, end))
    return [(a, b) for a, b in out if a < b]


def _trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    word = text[start:end]
    return end - len(word.lstrip(".=/-")), start + len(word.rstrip(".-/"))


def candidates(text: str) -> list[tuple[int, int]]:
    assigned = _assigned(text)
    out, starts = set(assigned), [a for a, _ in assigned]
    for m in _RUN.finditer(text):
        ends = [m.start(), *(m.start() + c.end() for c in _CUT.finditer(m.group())), m.end()]
        pieces = [_trimmed(text, a, b) for a, b in zip(ends, ends[1:])]
        i = bisect_left(starts, m.start())
        if all(b - a < 16 for a, b in pieces) and not (i < len(starts) and starts[i] < m.end()):  # as one run, if no part of it is long
            pieces = [_trimmed(text, *m.span())]
        out.update((a, b) for a, b in pieces if b - a >= 16)
    return sorted(out)


def features(text: str, start: int, end: int) -> list[float]:
    word = text[start:end]
    # a very long run is judged by its ends and by whole-run counts
    n = len(word)
    count = Counter(word)
    entropy = -sum(c / n * math.log2(c / n) for c in count.values())
    kinds = np.frombuffer(word.encode("utf-32-le"), np.uint32)
    cls = np.select([(kinds >= 48) & (kinds <= 57), (kinds >= 65) & (kinds <= 90), (kinds >= 97) & (kinds <= 122)], [0, 1, 2], 3)
    change = float((cls[1:] != cls[:-1]).mean())
    hexed = sum(count[c] for c in "0123456789abcdefABCDEF") / n
    low = word.lower()
    covered = np.zeros(n, bool)
    for piece in PIECES:
        at = low.find(piece)
        while at >= 0:
            covered[at:at + len(piece)] = True
            at = low.find(piece, at + 1)
    before, after = text[max(0, start - 40):start].lower(), text[end:end + 20].lower()
    names = re.findall(r"[a-z0-9_]+", before)[-3:]
    own = _ASSIGN_END.search(text, max(0, start - 16), start)
    own = own is not None and _NAMED.search(text[max(0, own.start() - 72):own.start()]) is not None
    pieces = re.findall(r"[a-z]+", low)
    return [math.log(n), entropy, float((cls == 0).mean()), float((cls == 1).mean()), float((cls == 3).mean()), hexed, change,
            float(covered.mean()), float("/" in word or before.endswith(("/", ":/")) or ".com" in low or ".org" in low),
            float(any(x in SECRET_NAMES or x.endswith(("_key", "_token", "_secret", "password")) for x in names)),
            float(any(x in HARMLESS_NAMES for x in names)), float(before.rstrip().endswith(("=", ":", "=\"", "='", "\"", "'"))),
            float(before[-1:] in ("\"", "'") and after[:1] == before[-1:]),
            float(bool(re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", word))),
            float(bool((cls == 0).any())), float(bool(((cls == 1) | (cls == 2)).any())), float(own),
            float(word[0] in "$<{%*" or word[-1] in ")>" or (bool(pieces) and all(x in PLACEHOLDERS for x in pieces)) or len(count) == 1),
            float(bool(re.match(r"[.,;:!?)]? [a-z]", text[end:end + 4]))), float(bool((cls == 1).any() and (cls == 2).any()))]


def labelled_findings(count: int = 1800, seed: int = 5) -> list[tuple[str, int, int, int]]:
    """(text, start, end, is it a secret) of the candidates of texts made by rule: keys, tokens and passwords against
    checksums, ids, paths, words, placeholders and prose."""
    rng = random.Random(seed)
    some = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    hexa, alnum, figures = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "0123456789"
    plain = lambda: "".join(rng.choice(PIECES[:15]) for _ in range(rng.randint(1, 3)))
    word = lambda: "".join(some("bcdfghklmnprstvwz", 1) + some("aeiou", 1) + rng.choice(["", "", "n", "r", "st"]) for _ in range(rng.randint(1, 4)))
    long = lambda: "".join(word() for _ in range(9))[:rng.randint(16, 28)]
    # found by themselves, and only where they are assigned to a secret name
    secrets = (lambda: some(hexa, rng.choice((32, 40, 64))), lambda: some(alnum, rng.randint(20, 64)), lambda: "ghp_" + some(alnum, 36),
               lambda: "AKIA" + some(alnum[:26] + "234567", 16), lambda: "sk-" + some(alnum, 48), lambda: some(alnum + "+/", 40) + "==",
               lambda: some(hexa, 40).upper(), lambda: some(alnum[:52], rng.randint(24, 48)), lambda: "AKIA" + some(alnum[:26], 16))
    passwords = (lambda: some(alnum + "!@#$%&*?+-_", rng.randint(6, 20)), lambda: word() + some("!@#$%&*?", 1) + word(), lambda: word() + some(figures, 2),
                 lambda: some(alnum[:52], rng.randint(6, 20)), lambda: "".join(word() for _ in range(3)), lambda: some(figures, rng.randint(4, 10)),
                 lambda: some(alnum[26:52], rng.randint(8, 20)), lambda: word().capitalize() + some(figures, 4) + some("!?", 1))
    named = (lambda: rng.choice(SECRET_NAMES) + rng.choice([" = \"", "=", ": ", ": \"", " = '", "=\""]),
             lambda: rng.choice(["db_", "MY_", "app."]) + rng.choice(SECRET_NAMES) + rng.choice([" = \"", "="]), lambda: rng.choice(SECRET_NAMES) + " ")
    assigned = (lambda: rng.choice(["", "db_", "APP_"]) + rng.choice(SECRET_NAMES) + rng.choice(["=", "=\"", " = \"", " = '", "\": \""]),
                lambda: rng.choice(("password", "passwd", "pwd", "secret", "token")) + ": ", lambda: f"https://{word()}:")
    harmless = (
        lambda: (rng.choice(HARMLESS_NAMES) + rng.choice([" ", ": ", "=", " = \""]), some(hexa, rng.choice((32, 40, 64)))),
        lambda: (rng.choice(["id ", "uuid: ", "", "request "]), "-".join(some(hexa, k) for k in (8, 4, 4, 4, 12))),
        lambda: ("", "/".join([plain() for _ in range(4)] + [plain() + some(figures, 2) + ".html"])),
        lambda: (rng.choice(["see ", "https://", ""]), f"www.{plain()}.com/{plain()}/{some(figures, 4)}"),
        lambda: ("", "_".join(plain() for _ in range(4)) + some(figures, rng.randint(0, 3))),
        lambda: ("", "".join(plain() for _ in range(5)) + some(figures, rng.randint(0, 1))),
        lambda: ("", f"{plain()}.{some(figures, 2)}-mail{some(figures, 1)}.example.com"),
        lambda: ("", f"{some(figures, 4)}-{some(figures, 2)}-{some(figures, 2)}T{some(figures, 2)}.{some(figures, 6)}Z"),
        lambda: ("", rng.choice([long(), long().capitalize(), long().upper(), "-".join(word() for _ in range(8)), "/".join(word() for _ in range(8)), "...".join([word(), word(), long()])])),
        lambda: ("", rng.choice([some(figures, rng.randint(16, 24)), "-".join(some(figures, 4) for _ in range(4)), some("-_=", 1) * rng.randint(16, 60)])),
        lambda: (rng.choice(SECRET_NAMES) + rng.choice([": ", " = ", "=", "=\""]),
                 rng.choice([*sorted(PLACEHOLDERS), "${" + word().upper() + "}", f"<{word()}>", "****", "xxxxxxxx", "your_token_here", f"get_{word()}()", "%s"])),
        lambda: (f"the {rng.choice(('key', 'secret', 'private', 'token'))}: ", word() + " " + " ".join(word() for _ in range(4))))
    out = []
    for i in range(count):
        lead = " ".join(rng.choice((plain, word))() for _ in range(rng.randint(0, 5)))
        lead += " " if lead else ""
        if rng.random() < 0.15:
            lead = lead.upper()
        close = None
        if i % 4 == 3:
            name, value = rng.choice(assigned)(), rng.choice(passwords)()
            close = f"@{word()}.com" if name.startswith("https") else rng.choice(["", "", "\n"]) if name.endswith(": ") else None
        elif i % 2:
            name, value = rng.choice(named)(), rng.choice(secrets)()
            if rng.random() < 0.1:
                name, value = name.upper(), value.upper()
        else:
            name, value = rng.choice(harmless)()
        if close is None:
            close = "\"" if name.endswith("\"") else "'" if name.endswith("'") else ""
        tail = "\n" if i % 4 == 3 and name.endswith(": ") else rng.choice([" ", ". ", "### ", ", ", "\n"])
        text = lead + name + value + close + tail + plain()
        start = len(lead) + len(name)
        end = start + len(value)
        # a candidate is a secret if it is most of the one that the text holds
        out += [(text, a, b, int(i % 2 == 1 and 2 * (min(b, end) - max(a, start)) > max(b - a, len(value)))) for a, b in candidates(text)]
    return out


@dataclass
class Forest:
    """The trees of a fitted forest as arrays: feature (-1: leaf), threshold, children, P(secret)."""

    trees: list[tuple[np.ndarray, ...]]

    def probability(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, limit, left, right, value in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            while (inner := feature[node] >= 0).any():
                at = node[inner]
                go = x[inner, feature[at]] <= limit[at]
                node[inner] = np.where(go, left[at], right[at])
            total += value[node]
        return total / max(1, len(self.trees))


def _grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, nodes: list[list]) -> int:
    """Add the best tree of at most ``depth`` splits on these rows; each split tries a few features."""
    at = len(nodes)
    nodes.append([-1, 0.0, 0, 0, float(y.mean())])
    if depth == 0 or len(y) < 4 or y.min() == y.max():
        return at
    best = (np.inf, -1, 0.0)
    for f in rng.choice(x.shape[1], size=math.isqrt(x.shape[1]) + 1, replace=False):
        order = np.argsort(x[:, f], kind="stable")
        v, left = x[order, f], np.cumsum(y[order])[:-1]
        n = np.arange(1, len(y))
        right, m = y.sum() - left, len(y) - n
        impurity = left * (1 - left / n) + right * (1 - right / m)
        impurity[v[1:] == v[:-1]] = np.inf
        i = int(impurity.argmin())
        if impurity[i] < best[0]:
            best = (impurity[i], int(f), (v[i] + v[i + 1]) / 2)
    if best[1] >= 0:
        go = x[:, best[1]] <= best[2]
        nodes[at][:2] = best[1], best[2]
        nodes[at][2] = _grow(x[go], y[go], rng, depth - 1, nodes)
        nodes[at][3] = _grow(x[~go], y[~go], rng, depth - 1, nodes)
    return at


def train(findings: list[tuple[str, int, int, int]], trees: int = 40, depth: int = 8, seed: int = 9) -> Forest:
    """A random forest of the labelled findings: bootstrap rows, random features at each split."""
    x = np.array([features(t, a, b) for t, a, b, _ in findings]).reshape(-1, FEATURES)
    y = np.array([float(label) for *_, label in findings])
    rng, out = np.random.default_rng(seed), []
    for _ in range(trees if len(y) else 0):
        rows, nodes = rng.integers(0, len(y), len(y)), []
        _grow(x[rows], y[rows], rng, depth, nodes)
        out.append(tuple(np.array(c) for c in zip(*nodes, strict=True)))
    return Forest(out)


def scan(docs: DataFrame, forest: Forest, text: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.5,
         mark: str = "[secret]") -> DataFrame:
    """The ``keep`` columns, n_candidates, findings (start, end in code points, score) and redacted.

    ``redacted`` is the text with each finding replaced by ``mark``; null for a null text.
    """
    rows = docs.select(*(docs[c] for c in keep), docs[text].alias("_text"))
    head = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, len(keep)):
            texts = piece.column(len(keep)).to_pylist()
            where = [candidates(t) if t else [] for t in texts]
            flat = [features(t, a, b) for t, spans in zip(texts, where, strict=True) for a, b in spans]
            score = iter(forest.probability(np.array(flat)).tolist() if flat else ())
            found = [_merged([(a, b, s) for a, b in spans if (s := next(score)) >= threshold]) for spans in where]
            yield pa.RecordBatch.from_arrays(
                [*(piece.column(i) for i in range(len(keep))), pa.array([len(x) for x in where], pa.int64()), pa.array(found, kind),
                 pa.array([_redact(t, f, mark) for t, f in zip(texts, found, strict=True)], pa.string())],
                names=[*keep, "n_candidates", "findings", "redacted"])

    return rows.mapInArrow(run, f"{head}n_candidates long, findings array<struct<start:long,end:long,score:double>>, redacted string")


def _merged(found: list[tuple[int, int, float]]) -> list[dict]:
    """Findings in order; those that overlap are one."""
    out: list[dict] = []
    for start, end, score in found:
        if out and start < out[-1]["end"]:
            out[-1]["end"], out[-1]["score"] = max(end, out[-1]["end"]), max(score, out[-1]["score"])
        else:
            out.append({"start": start, "end": end, "score": score})
    return out


def _redact(text: str | None, found: list[dict], mark: str) -> str | None:
    if not found:
        return text
    parts, at = [], 0
    for f in found:
        parts += [text[at:f["start"]], mark]
        at = f["end"]
    return "".join([*parts, text[at:]])
