"""Operator 3, personal data: four base patterns, and a word-shape conditional random field beside them.

*Base* spans follow fixed patterns (email, ip, card, phone), leftmost and without overlap within a kind.
*Model* spans come from a linear-chain CRF with the labels none, email, ip, card and phone over the words
of a line.  A word's features are its shape (runs of capitals, letters, digits and marks), its length
class, and the shapes and lower-cased cue words beside it, all hashed into one table.  The CRF is
trained in numpy from a small labelled table (``labelled_lines`` by default, any table of lines
and spans otherwise) and decoded by Viterbi for a batch of lines at a time.  It finds forms that the
patterns miss, such as phone numbers without a country code.  Runs of one label are spans; those that touch a
base span are left out, so base spans always stay.

By definition a model span holds a digit or an @; a line without either has none and isn't decoded.
Offsets are code points, ends exclusive.

Defined results: a null or empty text has no spans; rows with a null doc_id are scanned; extra columns
are ignored; an empty table gives no rows; texts of any length are scanned whole, in linear time.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .words import slices

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_CLUE = re.compile(r"[0-9@]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_RUN = re.compile(r"[A-Z]+|[a-z]+|[0-9]+|[^A-Za-z0-9]")

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    double = [sum(divmod(2 * int(c), 10)) for c in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(double)) % 10 == 0


def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    if "@" in text:
        end = 0
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                end = m.end()
                out.append((0, start, end))
    if not _CLUE.search(text):
        return out
    if "." in text:
        out += [(1, *m.span()) for m in _IP.finditer(text)
                if all(len(p := x.lstrip("0")) < 4 and int(p or 0) <= 255 for x in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NOT_DIGIT.sub("", m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text)
                if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]
    return out


# ---- the conditional random field

SPACE = 1 << 14
LABELS = 5


def _shape(word: str) -> str:
    """Runs as letters with lengths, of long words the first and the last runs."""
    runs = _RUN.findall(word if len(word) <= 64 else word[:32] + word[-32:])
    runs = runs if len(runs) <= 12 else runs[:6] + runs[-6:]
    kinds = [("A" if r[0].isupper() and r.isascii() else "a" if r.isalpha() else "9" if r.isdigit() else r)
             + (str(min(len(r), 9)) if r.isdigit() else "") for r in runs]
    return "".join(kinds)


def _slot(text: str) -> int:
    return zlib.crc32(text.encode()) % SPACE


def word_features(words: list[str], memory: dict[str, tuple] | None = None) -> np.ndarray:
    """words x features, each a slot of the weight table."""
    memory = {} if memory is None else memory
    per = []
    for word in words:
        f = memory.get(word)
        if f is None:
            shape, core = _shape(word), word.strip(".,;:!?()[]\"'*$#%&|").lower()
            digits = sum(c in "0123456789" for c in word)
            f = (_slot("s" + shape), _slot("t" + re.sub(r"[0-9]+", "", shape)), _slot(f"d{min(digits, 20)},{'@' in word},{word.count('.')}"),
                 _slot("w" + core if not digits and len(core) < 12 else "w#"),
                 _slot("p" + shape), _slot("q" + (core if not digits and len(core) < 12 else "#")),
                 _slot("n" + shape), _slot("m" + (core if not digits and len(core) < 12 else "#")))
            if len(memory) < 200_000:
                memory[word] = f
        per.append(f)
    a = np.array(per, dtype=np.int32).reshape(-1, 8)
    edge = np.array([[_slot("p<"), _slot("q<"), _slot("n>"), _slot("m>")]], dtype=np.int32)
    before = np.concatenate((edge[:, :2], a[:-1, 4:6]))
    after = np.concatenate((a[1:, 6:8], edge[:, 2:]))
    return np.concatenate((a[:, :4], before, after), axis=1)


@dataclass
class ShapeModel:
    weights: np.ndarray  # SPACE x LABELS
    change: np.ndarray   # LABELS x LABELS

    def decode(self, lines: list[np.ndarray]) -> list[np.ndarray]:
        """The best label sequence of each line, by Viterbi over all lines together."""
        order = sorted(range(len(lines)), key=lambda i: -len(lines[i]))
        size = np.array([len(lines[i]) for i in order])
        flat = np.concatenate([self.weights[lines[i]].sum(axis=1) for i in order])
        head = np.cumsum(size) - size
        best = np.zeros((len(flat), LABELS), dtype=np.float32)
        came = np.zeros((len(flat), LABELS), dtype=np.int8)
        for t in range(int(size[0])):
            at = head[:int(np.searchsorted(-size, -t, side="left"))] + t
            if t == 0:
                best[at] = flat[at]
                continue
            through = best[at - 1][:, :, None] + self.change
            came[at] = through.argmax(axis=1)
            best[at] = through.max(axis=1) + flat[at]
        out: list[np.ndarray] = [None] * len(lines)
        label = np.zeros(len(flat), dtype=np.int8)
        for t in range(int(size[0]) - 1, -1, -1):
            active = int(np.searchsorted(-size, -t, side="left"))
            at = head[:active] + t
            last = size[:active] == t + 1
            label[at[last]] = best[at[last]].argmax(axis=1)
            rest = at[~last]
            label[rest] = came[rest + 1, label[rest + 1]]
        for k, i in enumerate(order):
            out[i] = label[head[k]:head[k] + size[k]]
        return out


def labelled_lines(count: int = 1200, seed: int = 11) -> list[tuple[str, list[Span]]]:
    """The default labelled table: lines with one or no datum among plain words and look-alikes."""
    rng = random.Random(seed)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    plain = lambda: "".join(rng.choice("aeionrstldmu") for _ in range(rng.randint(1, 9)))
    host = lambda: f"{plain()}.{rng.choice(['com', 'org', 'net', 'example.com', 'co.uk', 'de'])}"
    makers = (
        (0, lambda: f"{plain()}.{digits(2)}@{host()}"), (0, lambda: f"{plain()}@{host()}"),
        (1, lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4))),
        (2, lambda: digits(16)), (2, lambda: " ".join(digits(4) for _ in range(4))), (2, lambda: "-".join(digits(4) for _ in range(4))),
        (3, lambda: f"+{rng.randint(1, 99)} ({digits(3)}) {digits(3)}-{digits(4)}"), (3, lambda: f"({digits(3)}) {digits(3)}-{digits(4)}"),
        (3, lambda: f"{digits(3)}-{digits(3)}-{digits(4)}"), (3, lambda: f"+{digits(2)} {digits(3)} {digits(4)} {digits(3)}"),
    )
    others = (lambda: digits(rng.randint(1, 5)), lambda: f"{digits(1)}.{digits(2)}", lambda: f"{digits(4)}-{digits(2)}-{digits(2)}",
              lambda: f"v{digits(1)}.{digits(1)}.{digits(1)}", lambda: f"{digits(2)}:{digits(2)}", lambda: f"${digits(3)},{digits(3)}",
              lambda: "%x" % rng.getrandbits(160), lambda: f"token = \"{rng.getrandbits(160):x}\"", lambda: f"@{plain()}", lambda: f"{digits(3)} {plain()} {digits(3)}",
              lambda: f"#{digits(6)}", lambda: f"{digits(2)}%", lambda: digits(rng.randint(6, 24)), lambda: f"{plain()}{digits(2)}")
    cues = {0: ("mail", "email:", "contact", "write to"), 1: ("ip", "host", "server"), 2: ("card", "card:", "visa", "paid with"),
            3: ("phone", "call", "tel:", "mobile")}
    dress = lambda w: w + rng.choice(["", "", "", "", "***", "$$$", "&&&", "###", "%%%", "!!", " |", ",", "."])
    out = []
    for _ in range(count):
        words = [plain() for _ in range(rng.randint(0, 8))]
        tail = [plain() for _ in range(rng.randint(0, 8))]
        if rng.random() < 0.2:
            words = [w.upper() for w in words]
        if rng.random() < 0.55:
            kind, make = rng.choice(makers)
            datum = make()
            # bare long digit runs are cards only by their check digit, which the patterns test
            if kind == 2 and not luhn(_NOT_DIGIT.sub("", datum)):
                kind = None
            if kind is not None and rng.random() < 0.4:
                words.append(rng.choice(cues[kind]))
        else:
            kind, datum = None, rng.choice(others)()
        before = " ".join(dress(w) for w in words)
        start = len(before) + 1 if before else 0
        line = (before + " " if before else "") + datum + rng.choice(["", "", ".", ",", "***", "!!"])
        line += (" " + " ".join(dress(w) for w in tail)) if tail else ""
        out.append((line, [] if kind is None else [(kind, start, start + len(datum))]))
    return out


def train(lines: list[tuple[str, list[Span]]], epochs: int = 6, seed: int = 3) -> ShapeModel:
    """Averaged gradient steps of the conditional likelihood (forward-backward), line by line."""
    rng = np.random.default_rng(seed)
    data = []
    for text, spans in lines:
        words = [(m.start(), m.end()) for m in _WORD.finditer(text)]
        if not words:
            continue
        truth = np.zeros(len(words), dtype=np.int64)
        for kind, a, b in spans:
            for i, (s, e) in enumerate(words):
                if s < b and e > a:
                    truth[i] = kind + 1
        data.append((word_features([text[s:e] for s, e in words]), truth))
    model = ShapeModel(np.zeros((SPACE, LABELS)), np.zeros((LABELS, LABELS)))
    total = ShapeModel(np.zeros((SPACE, LABELS)), np.zeros((LABELS, LABELS)))
    for epoch in range(epochs):
        rate = 0.5 / (1 + epoch)
        for i in rng.permutation(len(data)):
            features, truth = data[i]
            n = len(truth)
            e = model.weights[features].sum(axis=1)
            ahead, back = np.zeros((n, LABELS)), np.zeros((n, LABELS))
            ahead[0] = e[0]
            for t in range(1, n):
                ahead[t] = np.logaddexp.reduce(ahead[t - 1][:, None] + model.change, axis=0) + e[t]
            for t in range(n - 2, -1, -1):
                back[t] = np.logaddexp.reduce(model.change + (e[t + 1] + back[t + 1])[None, :], axis=1)
            z = np.logaddexp.reduce(ahead[-1])
            gap = -np.exp(ahead + back - z)
            gap[np.arange(n), truth] += 1
            np.add.at(model.weights, features.ravel(), rate * np.repeat(gap, features.shape[1], axis=0))
            if n > 1:
                joint = np.exp(ahead[:-1, :, None] + model.change + (e[1:] + back[1:])[:, None, :] - z)
                step = -joint.sum(axis=0)
                np.add.at(step, (truth[:-1], truth[1:]), 1)
                model.change += 0.3 * rate * step
        total.weights += model.weights
        total.change += model.change
    return ShapeModel((total.weights / epochs).astype(np.float32), (total.change / epochs).astype(np.float32))


def _trim(text: str, start: int, end: int) -> tuple[int, int]:
    """A span without the marks around it."""
    while start < end and not (text[start].isalnum() or text[start] in "+("):
        start += 1
    while end > start and not text[end - 1].isalnum():
        end -= 1
    return start, end


def _plausible(kind: int, datum: str) -> bool:
    """The definition of a model span: what its kind must hold at least."""
    digits = len(_NOT_DIGIT.sub("", datum))
    return ("@" in datum and "." in datum if kind == 0 else 4 <= digits <= 12 and datum.count(".") == 3 if kind == 1
            else 13 <= digits <= 19 and luhn(_NOT_DIGIT.sub("", datum)) if kind == 2
            else 8 <= digits <= 15 and any(c in datum for c in " -()."))


def model_spans(texts: list[str], base: list[list[Span]], model: ShapeModel, memory: dict | None = None) -> list[list[Span]]:
    """Spans that the CRF adds to the base spans of each text."""
    where, lines = [], []
    for t, text in enumerate(texts):
        at = 0
        while (clue := _CLUE.search(text, at)) is not None:
            a = text.rfind("\n", 0, clue.start()) + 1
            b = text.find("\n", clue.start())
            b = len(text) if b < 0 else b
            spans = [m.span() for m in _WORD.finditer(text, a, b)]
            if spans:
                where.append((t, spans))
                lines.append(word_features([text[s:e] for s, e in spans], memory))
            at = b
    out: list[list[Span]] = [[] for _ in texts]
    if not lines:
        return out
    for (t, spans), labels in zip(where, model.decode(lines), strict=True):
        i, text = 0, texts[t]
        while i < len(spans):
            j = i + 1
            if labels[i]:
                while j < len(spans) and labels[j] == labels[i]:
                    j += 1
                kind = int(labels[i]) - 1
                start, end = _trim(text, spans[i][0], spans[j - 1][1])
                if start < end and _plausible(kind, text[start:end]) and not any(a < end and start < b for _, a, b in base[t]):
                    out[t].append((kind, start, end))
            i = j
    return out


def find_personal(docs: DataFrame, model: ShapeModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, base and added: arrays of (kind, start, end), by kind as in KINDS and start."""
    rows = docs.select(*(docs[c] for c in keep), docs[text].alias("_text"))
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict = {}
        named = lambda spans: [{"kind": KINDS[k], "start": a, "end": b} for k, a, b in sorted(spans)]
        for piece in slices(batches, len(keep)):
            texts = [x or "" for x in piece.column(len(keep)).to_pylist()]
            base = [base_spans(x) for x in texts]
            added = model_spans(texts, base, model, memory)
            yield pa.RecordBatch.from_arrays(
                [*(piece.column(i) for i in range(len(keep))), pa.array(map(named, base), span), pa.array(map(named, added), span)],
                names=[*keep, "base", "added"])

    kind = "array<struct<kind:string,start:long,end:long>>"
    return rows.mapInArrow(run, f"{head}, base {kind}, added {kind}")
