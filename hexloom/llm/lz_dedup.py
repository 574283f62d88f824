"""Removal of words covered by a long run of words of an earlier document, by relative Lempel-Ziv parsing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow
from .repeats import Stretch, base_table, row_spans, settled_spans, with_spans

GRAM = 13
#: Places of a gram from which it counts as hot.
MANY = 2000
MADE = ["n_words", "n_removed", "kept_sha256", "hx_kept"]


class Reference:
    """A block of earlier texts, indexed by every run of ``span`` words in it: its first document and place there."""

    def __init__(self, span: int):
        self.span = span
        self.index: dict[bytes, tuple[int, list[bytes], int]] = {}

    def factors(self, doc: int, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """Parse the words greedily into factors of ``span`` words at least that the block has of other documents; add the rest to it.

        Where the next ``span`` words are in the block, the factor grows word by word while the block's text goes on
        alike. It ends at the first word that differs, and the next factor is looked for from the first run on that
        reaches over this boundary, so no run that begins inside a factor and ends beyond it is missed. Texts must come
        in the order of their documents.
        """
        span, text = self.span, b" ".join(words)
        edge = [0, *accumulate(len(w) + 1 for w in words)]
        at, last = 0, len(words) - span
        while at <= last:
            run = text[edge[at] : edge[at + span] - 1]
            ref_doc, ref, place = self.index.setdefault(run, (doc, words, at))
            if ref_doc == doc:
                at += 1
                continue
            n, most = span, min(len(words) - at, len(ref) - place)
            while n < most and words[at + n] == ref[place + n]:
                n += 1
            yield at, at + n
            at += n - span + 1


def _parse(s: Stretch):
    """The texts of one gram make one reference block, which is dropped at the next gram."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        key, block = None, Reference(s.span)
        for batch in batches:
            done, waits = settled_spans(batch)
            yield done
            out: list[list[int]] = [[], [], []]
            for k, doc, lo, text, more in zip(*(waits.column(i).to_pylist() for i in (0, 1, 2, 4, 5)), strict=True):
                if k != key:
                    key, block = k, Reference(s.span)
                for a, b in block.factors(doc, text.split()):
                    for place in (lo, *more):
                        for column, value in zip(out, (doc, place + a, place + b), strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32())], ["doc", "lo", "hi"])

    return run


def _remove(span_index: int, text_index: int):
    def run(batches):
        for batch in batches:
            out = [[], [], [], []]
            for text, spans in zip(batch.column(text_index), row_spans(batch.column(span_index)), strict=True):
                # bytes.split() parts at exactly the six ASCII blanks
                words = (text.as_py() or "").encode().split()
                n, kept = len(words), words
                if spans is not None:
                    lo, hi = (x.clip(0, n) for x in spans)
                    edges = zip([0, *hi.tolist()], [*lo.tolist(), n], strict=True)
                    kept = [w for x, y in edges for w in words[x:y]]
                raw = b" ".join(kept)
                for column, value in zip(out, (n, n - len(kept), hashlib.sha256(raw).hexdigest(), raw.decode()), strict=True):
                    column.append(value)
            added = [pa.array(x, k) for x, k in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
            rest = [i for i in range(batch.num_columns) if i not in (span_index, text_index)]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in rest] + added, [batch.schema.names[i] for i in rest] + MADE)

    return run


def remove_repeated_words(
    docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), many: int = MANY
) -> DataFrame:
    """doc_id, the columns of ``carry``, n_words, n_removed, kept_sha256 and hx_kept (kept words joined by one space).

    A word goes if a window of ``window`` consecutive words that covers it also starts in a document with a smaller id.
    Windows are judged on the input, and found by comparing words. A null text has no words; a text of fewer words keeps
    all; rows that repeat a document (same id) get the same answer; a row without an id keeps all and takes nothing from
    others; an empty table gives an empty result; other columns are not read, and a carried one may not be named as one
    of the result. Grams at more than ``many`` places are spread over all tasks.
    """
    s = Stretch(window, min(GRAM, window), words=True)
    x = with_spans(base_table(docs, id_col, text_col, carry, MADE), s, _parse(s), many)
    names = x.columns
    rest = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in x.schema if f.name not in ("hx_spans", "hx_text"))
    return map_arrow(x, _remove(names.index("hx_spans"), names.index("hx_text")), f"{rest}, n_words long, n_removed long, kept_sha256 string, hx_kept string")


def op6_lempel_ziv_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents without the words that a window of 50 words repeats from an earlier document."""
    return remove_repeated_words(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("hx_kept")
