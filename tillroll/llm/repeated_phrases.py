"""Operator 1, substring dedup by repeated-phrase automata.

Words covered by a run of ``window`` consecutive words that also starts in a document with a smaller
id are removed; windows are judged on the input.  Four steps, all partitioned:

1. *Sketch.*  Each window is represented by its minimizer, the ``gram``-word run in it with the least
   hash: equal windows have equal minimizers, and neighbouring windows share theirs, so a fifth of
   the words is enough.  Each task settles the minimizers that it sees in two documents itself and sends
   one entry for every other one, packed by shard; hot phrases so cost one entry a task.
2. *Confirm.*  A shard finds the minimizers of two or more documents.  Their occurrences go back to
   the documents, which cut the surrounding words (at most ``2 * window - gram`` words) out as passages.
3. *Automata.*  Distinct passages, with the least and largest document that hold them, meet in the
   shard of their minimizer.  Windows of at least two documents are confirmed phrases; they are
   compiled into Aho-Corasick automata over the numbers of their words, and all passages of all documents stream through it, which gives for every window of
   every passage the first document that has it.
4. *Cover.*  Passages return to their documents, whose words inside a window with an earlier first
   document are dropped.

Hot passages are merged in each task before the shuffle, and the join that returns them is an
ordinary shuffle join that adaptive execution splits.  The texts are shuffled once, compressed, for the three steps
that need them.  Only step 1 compares hashes (of 64 bits); it
can only make extra passages, because steps 3 compares words themselves.

Defined results: a null or empty text and one without words has no words and stays empty; documents
with fewer than ``window`` words keep all of them; rows with one doc_id are judged one by one and never
against each other; extra columns are ignored; a row with a null doc_id is kept whole, since no order
is defined for it; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import cut, texts
from .words import Words, grams, pack, packed, slices, unpack, unpacked, zipped

#: Occurrences that a task gathers before it sends them.
FLUSH = 1_000_000
#: Documents that a shard stands for; shards grow with the input.
DOCS_PER_SHARD = 2048


def _occurrences(words: Words, window: int, gram: int):
    """(row, start, windows, minimizer) of each maximal run of windows with the same minimizer."""
    h = words.hash
    n = len(h) - window + 1
    if n <= 0:
        return None
    g = grams(h, gram)
    best = g[:n].copy()
    at = np.zeros(n, dtype=np.int8)
    for j in range(1, window - gram + 1):
        less = g[j:j + n] < best
        np.copyto(best, g[j:j + n], where=less)
        at[less] = j
    row = words.row()
    valid = row[:n] == row[window - 1:]
    pos = np.arange(n) + at
    new = valid.copy()
    new[1:] &= (pos[1:] != pos[:-1]) | ~valid[:-1]
    begin = np.flatnonzero(new)
    if not len(begin):
        return None
    count = np.add.reduceat(valid.astype(np.int32), begin)
    rows = row[begin]
    return rows, begin - words.first[rows], count, best[begin]


def _sketch(shards: int, window: int, gram: int):
    """Task side of step 1: rows (shard, anchors, docs, row_keys, places, settled)."""
    schema = pa.schema([("shard", pa.int32()), ("anchors", pa.binary()), ("docs", pa.binary()),
                        ("row_keys", pa.binary()), ("places", pa.binary())])

    def flush(parts, task):
        def column(i):  # its pieces are let go before the next one is put together
            out = np.concatenate(parts[i])
            parts[i].clear()
            return out

        anchor, doc = column(0), column(1)
        order = np.lexsort((doc, anchor))
        anchor, doc = anchor[order], doc[order]
        own = column(2)[order] if any(p.any() for p in parts[2]) else None
        place = column(3)[order]
        del order
        keys = lambda i: pack(own[i]) if own is not None and own[i].any() else b""
        head = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        group = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(anchor))))
        last = np.append(head[1:], len(anchor)) - 1
        settled = (doc[head] != doc[last])[group]
        first = np.zeros(len(anchor), bool)
        first[head] = True
        # bit 0 of a place: an entry of a minimizer that this task has seen in two documents
        send = ~settled | first
        shard = (anchor % np.uint64(shards)).astype(np.int32)
        rows = []
        for s, index in _by_shard(shard, np.flatnonzero(send), shards):
            rows.append((s, pack(anchor[index]), pack(doc[index]), keys(index), pack(place[index] << 1 | settled[index])))
        index = np.flatnonzero(settled)
        if len(index):  # known to recur: they only travel along, spread over the shards
            spread = ((doc[index] * 31 + task) % shards).astype(np.int32)
            for s, sub in _by_shard(spread, np.arange(len(index)), shards):
                i = index[sub]
                rows.append((s, b"", pack(doc[i]), keys(i), pack(place[i] << 1)))
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, flushed = ([], [], [], []), 0, 0
        for piece in slices(batches, "text", 1 << 20):
            found = _occurrences(Words(piece.column("text")), window, gram)
            if found is None:
                continue
            rows, start, count, anchor = found
            ids = piece.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            own = piece.column("row_key").to_numpy(zero_copy_only=False).astype(np.int64)
            keys = own[rows] if own.any() else np.broadcast_to(np.int64(0), len(rows))  # almost always none: takes no memory
            for part, values in zip(parts, (anchor, ids[rows], keys, start.astype(np.int64) << 4 | count), strict=True):
                part.append(values)
            held += len(rows)
            if held >= FLUSH:
                yield flush(parts, flushed)
                parts, held, flushed = ([], [], [], []), 0, flushed + 1
        if held:
            yield flush(parts, flushed)

    return run, "shard int, anchors binary, docs binary, row_keys binary, places binary"


def _by_shard(shard: np.ndarray, index: np.ndarray, shards: int):
    order = index[np.argsort(shard[index], kind="stable")]
    cuts = np.searchsorted(shard[order], np.arange(shards + 1))
    return [(s, order[cuts[s]:cuts[s + 1]]) for s in range(shards) if cuts[s] < cuts[s + 1]]


def _confirm(group: pa.Table) -> pa.Table:
    """Shard side of step 1: the occurrences of minimizers that two documents have."""
    new, known = [], []
    for a, d, r, p in zip(*(group.column(c).to_pylist() for c in ("anchors", "docs", "row_keys", "places")), strict=True):
        doc, place = unpack(d, np.int64), unpack(p, np.int64)
        own = unpack(r, np.int64) if r else np.zeros(len(doc), np.int64)
        if a:
            new.append((unpack(a, np.uint64), doc, own, place))
        else:
            known.append((doc, own, place))
    if new:
        anchor, doc, own, place = (np.concatenate(x) for x in zip(*new, strict=True))
        order = np.argsort(anchor, kind="stable")
        anchor, doc, own, place = anchor[order], doc[order], own[order], place[order]
        head = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        size = np.diff(np.append(head, len(anchor)))
        told = place & 1
        recurs = (np.minimum.reduceat(doc, head) != np.maximum.reduceat(doc, head)) \
            | (np.maximum.reduceat(told, head) == 1)
        keep = np.repeat(recurs, size) & (told == 0)
        known.append((doc[keep], own[keep], place[keep]))
    doc, own, place = (np.concatenate(x) for x in zip(*known, strict=True)) if known else [np.zeros(0, np.int64)] * 3
    return pa.table({"doc_id": doc, "row_key": own, "place": place >> 1})


def _passages(window: int, gram: int, shards: int, dictionary: bool):
    """Step 2.  ``dictionary``: each distinct passage of the task with its documents, else each use."""
    if dictionary:
        kind = "shard int, passages binary"
    else:
        kind = "doc_id long, row_key long, start int, anchor long, passage_key long"
        schema = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("start", pa.int32()),
                            ("anchor", pa.int64()), ("passage_key", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], list] = {}
        for piece in unpacked(batches, 1 << 18):
            words = Words(piece.column("text"))
            places = piece.column("places")
            row = np.repeat(np.arange(piece.num_rows), places.value_lengths().to_numpy(zero_copy_only=False))
            place = places.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            start, count = place >> 4, place & 15
            at = words.first[row] + start
            length = count + window - 1
            doc = piece.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)[row]
            # the passage's key: its words' hashes and its length; its minimizer: the anchor of step 1
            key = _span_hash(words.hash, at, length)
            anchor = _least_gram(words.hash, at, count, window, gram)
            if not dictionary:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc), piece.column("row_key").take(pa.array(row)), pa.array(start.astype(np.int32)), pa.array(anchor.view(np.int64)),
                     pa.array(key.view(np.int64))], schema=schema)
                continue
            data, begin, end = words.data.tobytes(), words.start, words.end
            for k, a, d, p, m in zip(key.tolist(), anchor.tolist(), doc.tolist(), at.tolist(), length.tolist(),
                                     strict=True):
                have = seen.get((a, k))
                if have is None:
                    seen[a, k] = [b" ".join(data[begin[p]:end[p + m - 1]].split()), d, d]
                elif d < have[1]:
                    have[1] = d
                elif d > have[2]:
                    have[2] = d
            if len(seen) >= FLUSH // 10:
                yield batch(seen)
                seen = {}
        if dictionary and seen:
            yield batch(seen)

    def batch(seen):
        shard = (np.array([a for a, _ in seen], dtype=np.uint64) % np.uint64(shards)).astype(np.int32)
        text, least, most = zip(*seen.values(), strict=True)
        rows = pa.RecordBatch.from_arrays([pa.array(text, pa.binary()), pa.array(least, pa.int64()), pa.array(most, pa.int64())],
                                          names=["passage", "least", "most"])
        parts = [(s, _compressed(rows.take(pa.array(index)))) for s, index in _by_shard(shard, np.arange(len(shard)), shards)]
        return pa.RecordBatch.from_arrays([pa.array([s for s, _ in parts], pa.int32()), pa.array([b for _, b in parts], pa.binary())],
                                          names=["shard", "passages"])

    return run, kind


def _compressed(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(rows)
    return sink.getvalue().to_pybytes()


def _span_hash(hashes: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    out = length.astype(np.uint64)
    with np.errstate(over="ignore"):
        for j in range(int(length.max(initial=0))):
            inside = j < length
            out[inside] = out[inside] * np.uint64(0x9E3779B97F4A7C15) + hashes[at[inside] + j]
    return out ^ (out >> np.uint64(32))


def _least_gram(hashes, at, count, window, gram):
    """The least gram that all windows of a passage hold."""
    g = grams(hashes, gram)
    out = np.full(len(at), np.iinfo(np.uint64).max, dtype=np.uint64)
    for j in range(window - gram + 1):  # grams from the last window's start to the first window's end
        inside = j >= count - 1
        out[inside] = np.minimum(out[inside], g[at[inside] + j])
    return out


#: Letters of the automata, and the words that two of them tell apart.  An automaton looks a node's
#: children up one by one, so that a small alphabet is fast.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
VOCABULARY = len(ALPHABET) ** 2
#: Words of the passages that an automaton is made of, about: it has a node for each letter that they don't share.
AUTOMATON_WORDS = 1 << 16


def _automaton(window: int, gram: int):
    """Step 3: first documents of the windows of each passage of one shard.

    The passages of a minimizer stay together; minimizers are put into one automaton until it has
    ``VOCABULARY`` words (one minimizer alone may have more, its words just get longer numbers) or is
    made of ``AUTOMATON_WORDS``, so that frequent words don't make it as large as the shard.
    """

    def run(group: pa.Table) -> pa.Table:
        merged: dict[bytes, list] = {}
        for blob in group.column("passages"):
            part = pa.ipc.open_stream(blob.as_buffer()).read_all()
            for t, low, high in zip(*(part.column(c).to_pylist() for c in ("passage", "least", "most")), strict=True):
                have = merged.setdefault(t, [low, high])
                have[0], have[1] = min(have[0], low), max(have[1], high)
        spoken = Words(pa.array(list(merged), pa.binary()))  # the keys of step 2, from the words again
        at, length = spoken.first[:-1], spoken.count
        anchor = _least_gram(spoken.hash, at, length - window + 1, window, gram).view(np.int64)
        key = _span_hash(spoken.hash, at, length).view(np.int64)
        passages = sorted(((a, k, low, high, t) for a, k, (t, (low, high)) in zip(
            anchor.tolist(), key.tolist(), merged.items(), strict=True)), key=lambda p: p[0])
        del merged, spoken
        found: tuple[list, list, list] = ([], [], [])
        some, number, total = [], {}, 0
        for a, k, low, high, text in passages:
            if some and some[-1][0] != a and (len(number) > VOCABULARY * 3 // 4 or total > AUTOMATON_WORDS):
                _locate(some, number, window, found)
                some, number, total = [], {}, 0
            words = text.split(b" ")
            words = [number.setdefault(w, len(number)) for w in words]
            some.append((a, k, low, high, np.array(words, np.int32)))
            total += len(words)
        _locate(some, number, window, found)
        return pa.table({"anchor": pa.array(found[0], pa.int64()), "passage_key": pa.array(found[1], pa.int64()),
                         "firsts": pa.array(found[2], pa.list_(pa.int64()))})

    return run


def _locate(passages: list[tuple], number: dict[bytes, int], window: int, found: tuple[list, list, list]) -> None:
    """Confirm the windows of two documents, compile them and stream the passages through."""
    width, base = 2, len(ALPHABET)
    while base ** width < len(number):
        width += 1
    letters = ["".join(ALPHABET[n // base ** j % base] for j in range(width)) for n in range(len(number))]
    coded = ["".join([letters[n] for n in words.tolist()]) for *_, words in passages]
    span, extent = window * width, {}
    for text, (_, _, low, high, _) in zip(coded, passages, strict=True):
        for i in range(0, len(text) - span + 1, width):
            have = extent.get(piece := text[i:i + span])
            if have is None:
                extent[piece] = (low, high)
            elif low < have[0] or high > have[1]:
                extent[piece] = (min(low, have[0]), max(high, have[1]))
    phrases = ahocorasick.Automaton()
    for piece, (low, high) in extent.items():
        if low != high:
            phrases.add_word(piece, low)
    if not len(phrases):
        return
    phrases.make_automaton()
    never = np.iinfo(np.int64).max
    for text, (a, k, _, high, _) in zip(coded, passages, strict=True):
        first, some = [never] * ((len(text) - span) // width + 1), False
        for end, low in phrases.iter(text):
            if (end + 1) % width == 0:
                first[(end + 1 - span) // width] = low
                some = some or low < high
        if some:
            found[0].append(a)
            found[1].append(k)
            found[2].append(first)


def _cover(window: int):
    """Step 4: the kept words of each document."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
                        ("kept_text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in unpacked(batches, 1 << 18):
            words = Words(piece.column("text"), hashes=False)
            total = len(words.start)
            edge = np.zeros(total + 1, dtype=np.int32)
            hits = piece.column("hits")
            ids = piece.column("doc_id")
            if len(flat := hits.flatten()):
                hit_row = np.repeat(np.arange(piece.num_rows), hits.value_lengths().fill_null(0).to_numpy())
                flat = flat.to_numpy(zero_copy_only=False)
                start = (flat >> 16) + words.first[hit_row]
                for bit in range(16):
                    at = start[flat >> bit & 1 == 1]
                    edge += np.bincount(at, minlength=total + 1).astype(np.int32)
                    edge -= np.bincount(at + window, minlength=total + 1).astype(np.int32)
                    start = start + 1
            kept = np.cumsum(edge[:-1]) == 0
            data, begin, end = words.data.tobytes(), words.start, words.end
            out, removed = [], []
            for r in range(piece.num_rows):
                a, b = words.first[r], words.first[r + 1]
                keep = kept[a:b]
                n = int(keep.sum())
                removed.append(b - a - n)
                if n == b - a:
                    pieces = data[words.offsets[r]:words.offsets[r + 1]].split()
                else:
                    which = np.flatnonzero(keep) + a
                    pieces = [data[s:e] for s, e in zip(begin[which].tolist(), end[which].tolist(), strict=True)]
                out.append(b" ".join(pieces).decode())
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(words.count.astype(np.int64)), pa.array(removed, pa.int64()),
                 pa.array(out, pa.string())], schema=schema)

    return run, "doc_id long, n_words long, n_removed long, kept_text string"


def _unhit(cover):
    """``cover`` for rows without windows; one Python worker a task does both steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return cover(piece.append_column("hits", pa.nulls(piece.num_rows, pa.list_(pa.int64()))) for piece in packed(batches))

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with compressed texts."""
    for piece in slices(batches, "text"):
        yield piece.set_column(piece.schema.get_field_index("text"), "text", zipped(piece.column("text")))


def _keyed(known: DataFrame) -> DataFrame:
    """doc_id, row_key, text: the key is a hash of the text if rows of that doc_id differ, else 0."""
    h = F.xxhash64("text")
    clashing = cut(known.groupBy("doc_id").agg(F.min(h).alias("a"), F.max(h).alias("b")).where("a <> b").select("doc_id"))
    n = clashing.count()
    if not n:
        return known.select("doc_id", F.lit(0).cast("long").alias("row_key"), "text")
    marks = clashing.withColumn("clash", F.lit(True))
    return (known.join(F.broadcast(marks) if n <= 1 << 20 else marks, "doc_id", "left")
            .select("doc_id", F.when(F.col("clash"), h).otherwise(0).alias("row_key"), "text"))


def remove_repeated(docs: DataFrame, window: int = 13, gram: int = 5, key: str = "doc_id",
                    text: str = "text", shards: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (kept words joined by one space) of every row of ``docs``."""
    if not 0 < gram <= window or window - gram > 14:
        raise ValueError("gram must be at most window, and at least window - 14")
    rows = texts(docs, key, text)
    known = _keyed(rows.where("doc_id IS NOT NULL AND text IS NOT NULL"))
    shards = shards or max(8, -(-docs.count() // DOCS_PER_SHARD))
    run, kind = _sketch(shards, window, gram)
    places = (known.mapInArrow(run, kind).groupBy("shard").applyInArrow(_confirm, "doc_id long, row_key long, place long")
              .groupBy("doc_id", "row_key").agg(F.collect_list("place").alias("places")))
    small = known.mapInArrow(_packed, "doc_id long, row_key long, text binary")
    marked = small.join(places, ["doc_id", "row_key"]).select("doc_id", "row_key", "text", "places")
    run, kind = _passages(window, gram, shards, dictionary=True)
    firsts = (marked.mapInArrow(run, kind).groupBy("shard")
              .applyInArrow(_automaton(window, gram), "anchor long, passage_key long, firsts array<long>"))
    run, kind = _passages(window, gram, shards, dictionary=False)
    # windows to remove, as bits beside their passage's start
    bits = F.aggregate(F.sequence(F.lit(0), F.size("firsts") - 1), F.col("start").cast("long") * 65536, lambda total, i: total + F.when(
        F.get("firsts", i) < F.col("doc_id"), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(0))
    hits = (marked.mapInArrow(run, kind).join(firsts, ["anchor", "passage_key"])
            .where(F.array_min("firsts") < F.col("doc_id")).select("doc_id", "row_key", bits.alias("hit"))
            .groupBy("doc_id", "row_key").agg(F.collect_list("hit").alias("hits")))
    run, kind = _cover(window)
    rest = rows.where("doc_id IS NULL OR text IS NULL").mapInArrow(_unhit(run), kind)
    return small.join(hits, ["doc_id", "row_key"], "left").select("doc_id", "text", "hits").mapInArrow(run, kind).union(rest)
