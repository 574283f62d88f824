"""Bringing together the places where texts repeat a stretch of a fixed span (words or bytes), without comparing documents pairwise.

Every stretch of ``span`` units holds grams of ``gram`` units; the gram with the least hash owns the stretch. Equal
stretches have equal owners at equal places, so they meet under the owner's hash. Hashes only bring strings together:

1. ``census``: each document gives the hashes of its owners. A gram that one document alone holds (one place alone, for
   bytes) can repeat nothing. Documents are told which of their grams are held elsewhere.
2. ``contexts``: of each such gram the text that the stretches owned by it cover is shipped, dealt by the gram and sorted by
   document and place.
3. The operator's own matcher (Lempel-Ziv parse, suffix array) reads those strings and alone decides what is repeated, by
   comparing words or bytes.

A gram with more than ``many`` places is hot, as at the edge of a passage that a third of all documents share. Its
stretches are shipped one by one, dealt by a hash of each, so its work is spread over all tasks; equal ones of one Arrow
batch are told apart from their first before the shuffle, about a million at a time, so a stretch sends one row for each batch. Words count once a
document, so equal strings of one document are one row with several places.
Texts are shuffled by document once: both joins with them read the same exchange.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow
from .kernels import BLANK, BYTE_BASE, WORD_BASE, Rolling, byte_view, mix, pieces, words

U = np.uint64
#: Different stretches of hot grams that a task remembers, and how many more it compares with them at a time.
HOT_ROWS = 1 << 20
HOT_PART = 1 << 18
#: Places in one piece of text; Arrow strings hold no more.
PLACE = (1 << 31) - 1
CONTEXTS = "key long, doc long, lo int, hi int, text binary"
#: Of words, the other places in the document. Never null: for each row that Spark hands to Python it walks again over the
#: null lists at the end of the batch.
PLACES = ", more array<int>"
SPANS = "doc long, lo int, hi int"


@dataclass(frozen=True)
class Stretch:
    """What repeats: ``span`` words or bytes; ``gram`` units make an anchor."""

    span: int
    gram: int
    words: bool

    def __post_init__(self):
        if not 1 <= self.gram <= self.span:
            raise ValueError(f"a stretch has one unit at least, and its gram no more than it: {self}")

    @property
    def margin(self) -> int:
        return self.span - self.gram

    @property
    def base(self) -> int:
        return WORD_BASE if self.words else BYTE_BASE


@dataclass
class Units:
    """The units of a piece of a text column: a number for each, where its bytes begin and end, and each text's first unit."""

    raw: np.ndarray
    number: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    at: np.ndarray

    @classmethod
    def read(cls, texts: pa.Array, s: Stretch) -> Units:
        raw, at = byte_view(texts)
        if s.words:
            begin, end, at = words(raw, at, BLANK)
            return cls(raw, Rolling(raw, BYTE_BASE).of(begin, end), begin, end, at)
        place = np.arange(len(raw) + 1)
        return cls(raw, raw, place[:-1], place[1:], at)

    def joined(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The units with one blank after each, and where each begins and ends there."""
        size = self.end - self.begin
        end = np.cumsum(size + 1) - 1
        begin = end - size
        out = np.full(int(end[-1]) + 1 if len(end) else 0, 32, np.uint8)
        inside = np.zeros(len(self.raw) + 1, np.int8)
        np.add.at(inside, self.begin, 1)
        np.add.at(inside, self.end, -1)
        there = np.ones(len(out), bool)
        there[end] = False
        out[there] = self.raw[np.cumsum(inside[:-1], dtype=np.int8) > 0]
        return out, begin, end


def alike(text: np.ndarray, a: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """Whether the stretches of text from a and from b are equal: compared eight bytes at a time, the last eight overlapping
    (one at a time where there are fewer)."""
    same = a_size == b_size
    wide = np.ndarray((max(0, len(text) - 7),), "<u8", text, strides=(1,)) if len(text) > 7 else text
    for step, of in ((8, wide), (1, text)):
        todo = np.flatnonzero(same & (a != b) & ((a_size >= 8) if step == 8 else (a_size < 8)))
        at = 0
        while len(todo := todo[a_size[todo] > at]):
            place = np.minimum(at, a_size[todo] - step)
            equal = of[a[todo] + place] == of[b[todo] + place]
            same[todo[~equal]] = False
            todo, at = todo[equal], at + step
    return same


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours."""
    n, size = len(x) - width + 1, 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:n], x[width - size : width - size + n])


def owners(x: Units, s: Stretch) -> dict[str, np.ndarray]:
    """For each gram that owns stretches: its hash (even), its text's row, and the first and last stretch owned, as places of the piece."""
    grams = Rolling(x.number, s.base).grams(s.gram)
    width = s.margin + 1
    if len(grams) < width:
        return {k: np.zeros(0, np.int64) for k in ("h", "row", "first", "last")}
    key = (grams & ~U(PLACE)) | np.arange(len(grams), dtype=U)
    owner = (sliding_least(key, width) & U(PLACE)).astype(np.int64)
    valid = np.ones(len(owner), bool)
    for a, b in zip(x.at[:-1].tolist(), x.at[1:].tolist(), strict=True):
        valid[max(a, b - s.span + 1) : b] = False
    start = np.flatnonzero(valid)
    own = owner[start]
    new = np.ones(len(own), bool)
    new[1:] = own[1:] != own[:-1]
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(own))[: len(head)] - 1
    h = (grams[own[head]] & ~U(1)).view(np.int64)
    return {"h": h, "row": np.searchsorted(x.at, start[head], "right") - 1, "first": start[head], "last": start[tail]}


def _census(s: Stretch) -> Callable:
    """A row for each gram of an Arrow batch: its hash, at how many places it owns stretches, and the documents of these."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = batch.column(0).to_numpy(), []
            for a, b in pieces(batch.column(1)):
                x = owners(Units.read(batch.column(1).slice(a, b - a), s), s)
                found.append((x["h"], ids[x["row"] + a]))
            if not found:
                continue
            h, doc = (np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True))
            order = np.lexsort((doc, h))
            h, doc = h[order], doc[order]
            new = np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            places = np.diff(np.append(np.flatnonzero(new), len(h)))
            other = new.copy()
            other[1:] |= doc[1:] != doc[:-1]
            h, doc, new = h[other], doc[other], new[other]
            head = np.flatnonzero(new)
            lists = pa.ListArray.from_arrays(pa.array(np.append(head, len(h)).astype(np.int32)), pa.array(doc))
            yield pa.RecordBatch.from_arrays([pa.array(h[head]), pa.array(places.astype(np.int32)), lists], ["h", "places", "docs"])

    return run


def _marked(marks: pa.Array, x: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Which owners have a mark of their row, and whether the mark says that the gram is hot."""
    offsets = np.asarray(marks.offsets)
    value = marks.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    row = np.repeat(np.arange(len(marks)), np.diff(offsets))
    h = value & ~1
    together = lambda r, v: mix(v.view(U) ^ mix(r.astype(U) + U(1)))
    have = together(row, h)
    order = np.argsort(have)
    have, row, h, value = have[order], row[order], h[order], value[order]
    if not len(have):
        return np.zeros(len(x["h"]), bool), np.zeros(len(x["h"]), bool)
    at = np.minimum(np.searchsorted(have, together(x["row"], x["h"])), len(have) - 1)
    known = (row[at] == x["row"]) & (h[at] == x["h"])
    return known, known & ((value[at] & 1) == 1)


def _contexts(s: Stretch, doc_at: int, text_at: int, marks_at: int) -> Callable:
    names = ["key", "doc", "lo", "hi", "text", "more"][: 6 if s.words else 5]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32()))

    def rows(*columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t, _ in zip(columns, kinds, names, strict=False)], names)

    def string(text: bytes) -> bytes:
        return b" ".join(text.split()) if s.words else text

    def once(key, doc, lo, hi, text) -> pa.RecordBatch:
        """Rows of contexts. Of words, those of one gram and document that are equal are one row."""
        keep, more = np.ones(len(key), bool), [[]] * len(key)
        if s.words and len(key):
            order = np.lexsort((doc, key))
            same = (key[order][1:] == key[order][:-1]) & (doc[order][1:] == doc[order][:-1])
            first: dict[tuple, int] = {}
            for i in order[np.append(same, False) | np.append(False, same)].tolist():
                at = first.setdefault((int(key[i]), int(doc[i]), string(text[i])), i)
                if at != i:
                    keep[i] = False
                    more[at] = [*more[at], int(lo[i])]
        i = np.flatnonzero(keep)
        return rows(key[i], doc[i], lo[i], hi[i], [text[j] for j in i], [more[j] for j in i])

    def hot_rows(parts: list, kept: list) -> Iterator[pa.RecordBatch]:
        """Stretches of hot grams, of a bounded number of texts: each different one once, at its earliest document and place.

        Those with one hash are compared with the earliest of them, unit by unit, on the text itself; those that equal it
        in a later document (or place, for bytes) are settled. Nothing is cut out but what is sent. ``kept`` holds what was
        sent of the texts before, with no more text than that covers, so that it is not sent again; if that grows beyond
        HOT_ROWS it is forgotten, and sent again.
        """
        n_kept = sum(len(part[0]) for part in kept)
        parts = [*kept, *parts]
        key, doc, lo, begin, end = (np.concatenate(x) for x in list(zip(*parts, strict=True))[:5])
        text = np.concatenate([part[5] for part in parts])
        shift = np.cumsum([0, *[len(part[5]) for part in parts[:-1]]])
        shift = np.repeat(shift, [len(part[0]) for part in parts])
        begin, size = begin + shift, end - begin
        order = np.lexsort((lo, doc, key))
        new = np.ones(len(order), bool)
        new[1:] = key[order][1:] != key[order][:-1]
        earliest = np.repeat(order[new], np.diff(np.append(np.flatnonzero(new), len(order))))
        same = new | alike(text, begin[order], size[order], begin[earliest], size[earliest])
        fresh = order >= n_kept
        i, first = order[~new & same & fresh], earliest[~new & same & fresh]
        past = doc[i] > doc[first] if s.words else (doc[i] > doc[first]) | ((doc[i] == doc[first]) & (lo[i] > lo[first]))
        sent = order[(new | ~same) & fresh]
        more: dict[int, list[int]] = {}
        if s.words:
            sent = np.concatenate([sent, i[~past & (first < n_kept)]])
            beside = ~past & (first >= n_kept)
            for k, place in zip(first[beside].tolist(), lo[i[beside]].tolist(), strict=True):
                more.setdefault(k, []).append(place)
        kept.clear()
        hold = order[new]
        if len(hold) <= HOT_ROWS:
            hold = hold[np.argsort(begin[hold], kind="stable")]
            x, y = merged(begin[hold], begin[hold] + size[hold])
            run = np.searchsorted(x, begin[hold], "right") - 1
            place = begin[hold] - x[run] + (np.cumsum(y - x) - (y - x))[run]
            covered = np.concatenate([text[a:b] for a, b in zip(x.tolist(), y.tolist(), strict=True)])
            kept.append((key[hold], doc[hold], lo[hold], place, place + size[hold], covered))
        for k in range(0, len(sent), 20_000):
            j = sent[k : k + 20_000]
            yield rows(key[j], doc[j], lo[j], lo[j] + s.span, [text[x : x + n].tobytes() for x, n in zip(begin[j].tolist(), size[j].tolist(), strict=True)], [more.get(x, []) for x in j.tolist()])
        i = i[past]
        i = i[np.lexsort((lo[i], doc[i]))]
        new = np.ones(len(i), bool)
        new[1:] = (doc[i][1:] != doc[i][:-1]) | (lo[i][1:] > lo[i][:-1] + 1)
        a = np.flatnonzero(new)
        b = np.append(a[1:], len(i))[: len(a)] - 1
        d, p = doc[i[a]], lo[i[a]]
        yield rows(mix(d.view(U) + p.astype(U)).view(np.int64), d, p, lo[i[b]] + s.span, [None] * len(a), [[]] * len(a))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            batch, hot, n_hot, kept, part = whole.filter(whole.column(marks_at).is_valid()), [], 0, [], min(HOT_PART, HOT_ROWS)
            ids = batch.column(doc_at).to_numpy()
            for a, b in pieces(batch.column(text_at)):
                units = Units.read(batch.column(text_at).slice(a, b - a), s)
                x = owners(units, s)
                known, many = _marked(batch.column(marks_at).slice(a, b - a), x)
                i = np.flatnonzero(known & ~many)
                for k in range(0, len(i), 20_000):
                    j = i[k : k + 20_000]
                    first, last, row = x["first"][j], x["last"][j], x["row"][j]
                    begin, end, lo = units.begin[first].tolist(), units.end[last + s.span - 1].tolist(), first - units.at[row]
                    yield once(x["h"][j], ids[a + row], lo, lo + (last - first) + s.span, [units.raw[m:n].tobytes() for m, n in zip(begin, end, strict=True)])
                i = np.flatnonzero(many)
                if not len(i):
                    continue
                text, begin, end = units.joined() if s.words else (units.raw, units.begin, units.end)
                roll = Rolling(units.number, s.base)
                n = x["last"][i] - x["first"][i] + 1
                upto = np.cumsum(n)
                k = 0
                while k < len(i):  # a part of the owners whose stretches are about ``part``, of a long text too
                    stop = max(k + 1, int(np.searchsorted(upto, (upto[k - 1] if k else 0) + part, "right")))
                    j, m = i[k:stop], n[k:stop]
                    first = np.repeat(x["first"][j], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                    row = np.repeat(x["row"][j], m)
                    hot.append((roll.of(first, first + s.span).view(np.int64), ids[a + row], first - units.at[row], begin[first], end[first + s.span - 1], text))
                    n_hot += len(first)
                    if n_hot >= part:
                        yield from hot_rows(hot, kept)
                        hot, n_hot = [], 0
                    k = stop
            if hot:
                yield from hot_rows(hot, kept)

    return run


def settled_spans(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, pa.RecordBatch]:
    """Rows of contexts that came as spans already, and those whose text is still to be matched."""
    waits = batch.column(4).is_valid()
    done = batch.filter(pa.compute.invert(waits))
    return pa.RecordBatch.from_arrays([done.column(i) for i in (1, 2, 3)], ["doc", "lo", "hi"]), batch.filter(waits)


def with_spans(base: DataFrame, s: Stretch, matcher: Callable, many: int) -> DataFrame:
    """base (doc_id, hx_text, and more) with hx_spans: (lo, hi) of the units that its matched stretches cover, null for none.

    Rows that repeat an id each get its spans. Where rows of one id differ in text, each is given the spans of both.
    """
    texts = base.select(F.col("doc_id").alias("doc"), F.col("hx_text").alias("text")).where("doc is not null and text is not null")
    census = map_arrow(texts, _census(s), "h long, places int, docs array<long>").repartition("h")
    all_of = Window.partitionBy("h")
    held = {"n": F.sum("places").over(all_of), "a": F.min(F.array_min("docs")).over(all_of), "b": F.max(F.array_max("docs")).over(all_of)}
    census = census.withColumns(held).where("a < b" if s.words else "n > 1")
    shared = census.select(F.explode("docs").alias("hx_doc"), F.col("h").bitwiseOR((F.col("n") > many).cast("long")).alias("mark"))
    marks = shared.groupBy("hx_doc").agg(F.collect_set("mark").alias("hx_marks"))
    # both joins merge the same exchange of texts; neither side is bounded, so neither is broadcast
    marked = base.hint("merge").join(marks, F.col("doc_id") == F.col("hx_doc"), "left").drop("hx_doc")
    names = marked.columns
    contexts = map_arrow(marked, _contexts(s, names.index("doc_id"), names.index("hx_text"), names.index("hx_marks")), CONTEXTS + (PLACES if s.words else ""))
    dealt = contexts.repartition("key").sortWithinPartitions("key", "doc", "lo")
    spans = map_arrow(dealt, matcher, SPANS)
    by_doc = spans.groupBy(F.col("doc").alias("hx_doc")).agg(F.collect_set(F.struct("lo", "hi")).alias("hx_spans"))
    return base.hint("merge").join(by_doc, F.col("doc_id") == F.col("hx_doc"), "left").drop("hx_doc")


def merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of overlapping or touching spans."""
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > hi[:-1]
    first = np.flatnonzero(new)
    return lo[first], hi[np.append(first[1:], len(lo)) - 1]


def row_spans(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
    """The merged spans of each row of hx_spans."""
    offsets, values = np.asarray(column.offsets), column.values
    lo, hi = (values.field(i).to_numpy(zero_copy_only=False) for i in range(2))
    valid = np.asarray(column.is_valid())
    for i in range(len(column)):
        a, b = offsets[i], offsets[i + 1]
        yield merged(lo[a:b], hi[a:b]) if valid[i] and b > a else None


def base_table(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...], made: list[str]) -> DataFrame:
    """doc_id, hx_text and the carried columns; a carried column may not be named as one that the operator makes."""
    if clash := {"doc_id", *made} & set(carry):
        raise ValueError(f"columns that the operator makes can't be carried as well: {sorted(clash)}")
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("hx_text"), *[F.col(f"`{c}`") for c in carry])
