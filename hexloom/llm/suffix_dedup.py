"""Removal of bytes covered by a long string that occurs earlier, by suffix arrays of shards of the corpus."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow
from .repeats import Stretch, base_table, row_spans, settled_spans, with_spans

U = np.uint64
GRAM = 20
#: Places of a gram from which it counts as hot; the distinct strings of fewer are carried from shard to shard in 41 MB at most.
MANY = 10_000
#: Bytes of distinct text that one suffix array holds, about.
SHARD = 1 << 20
MADE = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "hx_kept"]


def first_bytes(text: np.ndarray, room: int) -> np.ndarray:
    """The next eight bytes at each place as one number in text order; ``room`` places past the end hold zeros."""
    n = len(text) + room
    padded = np.zeros(n + 8, np.uint8)
    padded[: len(text)] = text
    key = np.zeros(n, U)
    for j in range(8):
        key = (key << U(8)) | padded[j : j + n]
    return key


def suffix_array(text: np.ndarray, key: np.ndarray | None = None) -> np.ndarray:
    """All suffixes in order, by Larsson-Sadakane refinement.

    Suffixes are sorted by eight bytes; then each group of equal ones is sorted by the group numbers of the suffixes h
    places on, h doubling each round. Groups of one are sorted and are not visited again. Past the end of the text the
    suffix that ends first comes first, so texts may end in zero bytes.
    """
    n = len(text)
    key = first_bytes(text, 0) if key is None else key[:n]
    sa = np.argsort(key)
    ordered = key[sa]
    head = np.ones(n, bool)
    head[1:] = ordered[1:] != ordered[:-1]
    index = np.arange(n)
    group = np.maximum.accumulate(np.where(head, index, 0))
    rank = np.empty(n, np.int64)
    rank[sa] = group
    h = 8
    while True:
        alone = head.copy()
        alone[:-1] &= head[1:]
        todo = np.flatnonzero(~alone)
        if not len(todo):
            break
        place = sa[todo]
        after = place + h
        after = np.where(after < n, rank[np.minimum(after, n - 1)], n - 1 - after) + (h + 1)
        both = (group[todo] << 32) | after
        order = np.argsort(both)
        sa[todo], both = place[order], both[order]
        new = np.ones(len(todo), bool)
        new[1:] = both[1:] != both[:-1]
        head[todo] = new
        group = np.maximum.accumulate(np.where(head, index, 0))
        rank[sa[todo]] = group[todo]
        h *= 2
    return sa


def common_prefixes(text: np.ndarray, sa: np.ndarray, cap: int, key: np.ndarray) -> np.ndarray:
    """lcp[i]: bytes that suffixes sa[i - 1] and sa[i] share, at most cap; lcp[0] is 0.

    Kasai's inequality says that the suffix one place on shares one byte less at most with its own predecessor. It is
    used in rounds over places at halving strides, so that each round is one array operation and starts from the bound
    that the last one left.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    shared = np.zeros(n, np.int64)

    def extend(place: np.ndarray, least: np.ndarray) -> None:
        other = before[place]
        place, other, least = place[other >= 0], other[other >= 0], least[other >= 0]
        length, live = least.copy(), np.arange(len(place))
        while len(live):
            a, b = place[live] + length[live], other[live] + length[live]
            same = key[a] == key[b]
            rest = live[~same]
            apart = key[a[~same]] ^ key[b[~same]]
            for step in (4, 2, 1):  # whole bytes before the first that differs
                clear = apart < (U(1) << U(64 - 8 * step))
                length[rest[clear]] += step
                apart[clear] <<= U(8 * step)
            live = live[same]
            length[live] += 8
            live = live[length[live] < cap]
        limit = n - np.maximum(place, other)
        shared[place] = np.minimum(np.minimum(length, cap), limit)

    stride = 64
    whole = np.arange(0, n, stride)
    extend(whole, np.zeros(len(whole), np.int64))
    while stride > 1:
        stride //= 2
        place = np.arange(stride, n, 2 * stride)
        extend(place, np.maximum(shared[place - stride] - stride, 0))
    lcp = shared[sa]
    if n:
        lcp[0] = 0
    return lcp


@dataclass
class Carried:
    """The distinct strings of the gram that goes on over a shard's edge, sorted, and where each starts first."""

    key: int
    string: np.ndarray
    doc: np.ndarray
    place: np.ndarray


class Shard:
    """Rows in the order of gram, document and place; a text that several rows have stands once, for the first of them."""

    def __init__(self, span: int):
        self.span = span
        self.rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # gram, document and place
        self.number: list[int] = []  # of each row's text
        self.texts: dict[bytes, int] = {}
        self.first: list[int] = []  # the first row of each text
        self.size = 0

    def add(self, key: np.ndarray, doc: np.ndarray, lo: np.ndarray, texts: list[bytes], most: int) -> int:
        """Adds rows until the shard's texts are ``most`` bytes, or its rows a quarter of that number; says how many."""
        known, number, room = self.texts, self.number, max(1, most // 4 - len(self.number))
        for text in texts[:room]:
            n = known.setdefault(text, len(known))
            if n == len(self.first):
                self.first.append(len(number))
                self.size += len(text)
            number.append(n)
            if self.size >= most:
                break
        added = len(number) - sum(len(x[0]) for x in self.rows)
        self.rows.append(tuple(x[:added].astype(np.int64) for x in (key, doc, lo)))
        return added

    def full(self, most: int) -> bool:
        return self.size >= most or len(self.number) * 4 >= most

    def match(self, before: Carried | None) -> tuple[pa.RecordBatch, Carried]:
        """Spans (doc, lo, hi) of the strings that start earlier in the shard, or in the shards before, and what the next shard needs.

        Strings whose suffixes share ``span`` bytes or more with their neighbours in the suffix array are equal; the
        first of each group is where it starts first. Strings of a gram that began in the shard before are looked up
        among that one's by binary search. A text without another one of its gram is in no suffix array: its strings
        hold the gram at different places, so they all differ, and what starts earlier is the whole text or none of it.
        """
        span = self.span
        key, doc, lo = (np.concatenate(x) for x in zip(*self.rows, strict=True))
        number, first = np.array(self.number), np.array(self.first)
        whole = np.array([len(t) for t in self.texts], np.int64)
        _, gram, texts = np.unique(key[first], return_inverse=True, return_counts=True)
        # what a gram that goes on over the shard's edges has in the other shards isn't known here
        looked = np.flatnonzero((texts[gram] > 1) | (key[first] == key[0]) | (key[first] == key[-1]))
        known = list(self.texts)
        units = np.frombuffer(b"".join([known[k] for k in looked.tolist()]), np.uint8)
        head, length = first[looked], whole[looked]
        edge = np.cumsum(length) - length
        n = length - span + 1
        text = np.repeat(np.arange(len(n)), n)  # of each string that counts
        inner = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
        start = edge[text] + inner

        head_bytes = first_bytes(units, span + 16)
        sa = suffix_array(units, head_bytes)
        lcp = common_prefixes(units, sa, span, head_bytes)
        owned = np.full(len(units), -1, np.int64)
        owned[start] = np.arange(len(start))
        group = np.cumsum(lcp < span)
        here = owned[sa] >= 0
        index, group = owned[sa[here]], group[here]
        heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        first_of = np.empty(len(start), np.int64)
        first_of[index] = np.repeat(np.minimum.reduceat(index, heads), np.diff(np.append(heads, len(index))))

        own_doc, own_place = doc[head][text], lo[head][text] + inner
        ref_doc, ref_place = own_doc[first_of], own_place[first_of]
        windows = np.lib.stride_tricks.sliding_window_view(units, span)
        strings = lambda which: np.ascontiguousarray(windows[start[which]]).view(f"S{span}").ravel()
        of_key = lambda k: np.flatnonzero(key[head][text] == k)
        if before is not None and before.key == key[0]:
            which = of_key(before.key)
            leads = np.unique(first_of[which])
            wanted = strings(leads)
            at = np.minimum(np.searchsorted(before.string, wanted), len(before.string) - 1)
            hit = before.string[at] == wanted
            to_doc, to_place = ref_doc.copy(), ref_place.copy()
            to_doc[leads[hit]], to_place[leads[hit]] = before.doc[at[hit]], before.place[at[hit]]
            ref_doc[which], ref_place[which] = to_doc[first_of[which]], to_place[first_of[which]]
        last = np.unique(first_of[of_key(key[-1])])
        kept = [strings(last), ref_doc[last], ref_place[last]]
        if before is not None and before.key == key[-1]:
            new = ~np.isin(kept[0], before.string)
            kept = [np.concatenate([a, b[new]]) for a, b in zip((before.string, before.doc, before.place), kept, strict=True)]
        order = np.argsort(kept[0], kind="stable")
        carried = Carried(int(key[-1]), *(x[order] for x in kept))

        # the row that a text stands for: runs of its strings that start earlier
        early = (ref_doc < own_doc) | ((ref_doc == own_doc) & (ref_place < own_place))
        i = np.flatnonzero(early)
        new = np.ones(len(i), bool)
        new[1:] = (text[i][1:] != text[i][:-1]) | (inner[i][1:] != inner[i][:-1] + 1)
        a = i[np.flatnonzero(new)]
        b = i[np.append(np.flatnonzero(new)[1:], len(i))[: len(a)] - 1] if len(i) else a
        out = [(own_doc[a], own_place[a], own_place[b] + span)]
        # the rows after it with the same text, at another place: all their strings start in that one
        base = first[number]
        copy = (doc[base] < doc) | ((doc[base] == doc) & (lo[base] < lo))
        out.append((doc[copy], lo[copy], lo[copy] + whole[number[copy]]))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)]
        kinds = (pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c.astype(k.to_pandas_dtype()), k) for c, k in zip(columns, kinds, strict=True)], ["doc", "lo", "hi"]), carried


def _shards(s: Stretch, shard_bytes: int) -> Callable:
    def run(batches) -> Iterator[pa.RecordBatch]:
        shard, carried = Shard(s.span), None
        for batch in batches:
            done, waits = settled_spans(batch)
            yield done
            key, doc, lo = (waits.column(i).to_numpy() for i in range(3))
            texts, at = waits.column(4).to_pylist(), 0
            while at < len(texts):
                at += shard.add(key[at:], doc[at:], lo[at:], texts[at:], shard_bytes)
                if shard.full(shard_bytes):
                    out, carried = shard.match(carried)
                    yield out
                    shard = Shard(s.span)
        if shard.number:
            yield shard.match(carried)[0]

    return run


def _remove(span_index: int, text_index: int):
    """Adds n_bytes, n_removed, n_spans, kept_sha256 and hx_kept, the text without the removed bytes.

    In hx_kept a character that a span cuts stays whole.
    """

    def run(batches):
        for batch in batches:
            out = [[], [], [], [], []]
            for text, spans in zip(batch.column(text_index), row_spans(batch.column(span_index)), strict=True):
                raw = (text.as_py() or "").encode()
                if spans is None:
                    row = (len(raw), 0, 0, hashlib.sha256(raw).hexdigest(), raw.decode())
                else:
                    lo, hi = (x.clip(0, len(raw)) for x in spans)
                    lo, hi = lo[hi > lo], hi[hi > lo]
                    keep = zip([0, *hi.tolist()], [*lo.tolist(), len(raw)], strict=True)
                    kept = b"".join(raw[a:b] for a, b in keep)
                    data = np.frombuffer(raw, np.uint8)
                    inner = (data & 0xC0) == 0x80
                    whole = np.flatnonzero(~np.append(inner, False))
                    a, b = whole[np.searchsorted(whole, lo)], whole[np.searchsorted(whole, hi, "right") - 1]
                    edges = zip([0, *np.maximum(a, b).tolist()], [*a.tolist(), len(raw)], strict=True)
                    row = (len(raw), int((hi - lo).sum()), len(lo), hashlib.sha256(kept).hexdigest(), b"".join(raw[x:y] for x, y in edges).decode())
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            added = [pa.array(x, k) for x, k in zip(out, kinds, strict=True)]
            rest = [i for i in range(batch.num_columns) if i not in (span_index, text_index)]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in rest] + added, [batch.schema.names[i] for i in rest] + MADE)

    return run


def remove_repeated_bytes(
    docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), many: int = MANY, shard_bytes: int = SHARD
) -> DataFrame:
    """doc_id, the columns of ``carry``, n_bytes, n_removed, n_spans, kept_sha256 and hx_kept (the remaining text).

    A byte goes if a string of ``length`` bytes that covers it also starts earlier: in a document with a smaller id, or
    before in the same one. Strings are judged on the input. A null text is empty; a text shorter than ``length`` keeps
    all; rows that repeat a document (same id) are one document and get the same answer; a row without an id keeps all
    and takes nothing from others; an empty table gives an empty result; other columns are not read, and a carried one
    may not be named as one of the result. Grams at more than ``many`` places are spread over all tasks.
    """
    s = Stretch(length, min(GRAM, length), words=False)
    x = with_spans(base_table(docs, id_col, text_col, carry, MADE), s, _shards(s, shard_bytes), many)
    names = x.columns
    rest = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in x.schema if f.name not in ("hx_spans", "hx_text"))
    schema = f"{rest}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, hx_kept string"
    return map_arrow(x, _remove(names.index("hx_spans"), names.index("hx_text")), schema)


def op9_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents without the bytes that a string of 100 bytes repeats."""
    return remove_repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("hx_kept")
