"""Ranked lexical search: term at a time, rarest first, with accumulators only for documents that can still be among the best."""

from __future__ import annotations

import math
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, map_arrow, materialise
from .kernels import NOT_WORD, byte_view, pieces

POSTINGS = "doc_id long, n long, terms array<int>, tfs array<long>"
SCORED = "item_id long, doc_id long, score long"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[NOT_WORD] = 32


def split_terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts and the offsets of each one's: runs of ASCII letters and digits and of all other characters
    beyond ASCII, of which only A-Z are lower-cased."""
    raw, at = byte_view(texts)
    clean = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(at), pa.py_buffer(_LOWER[raw]))
    lists = pc.ascii_split_whitespace(clean)
    flat = lists.flatten()
    some = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    before = np.zeros(len(flat) + 1, np.int64)
    np.cumsum(some, out=before[1:])
    edges = np.zeros(len(lists) + 1, np.int64)
    np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), out=edges[1:])
    return flat.filter(pa.array(some)), before[edges]


def _item_terms(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        terms, at = split_terms(batch.column(1))
        lists = [sorted(set(terms[a:b].to_pylist())) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.string()))], ["item_id", "terms"])


def _post(terms: list[str]):
    """For each document with a term: how many it has, and which of the items' terms how often."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        known = pa.array(terms, pa.large_string())
        for batch in batches:
            for a, b in pieces(batch.column(1), 8 << 20):
                part = batch.slice(a, b - a)
                found, at = split_terms(part.column(1))
                n = np.diff(at)
                term = pc.fill_null(pc.index_in(found, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                doc = np.repeat(np.arange(len(n)), n)
                mine = term >= 0
                key, tf = np.unique(doc[mine] * len(terms) + term[mine], return_counts=True)
                edge = np.searchsorted(key, np.arange(len(n) + 1) * len(terms))
                lists = [pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), x) for x in (pa.array((key % max(1, len(terms))).astype(np.int32)), pa.array(tf.astype(np.int64)))]
                some = pa.array(n > 0)
                yield pa.RecordBatch.from_arrays([x.filter(some) for x in (part.column(0), pa.array(n), *lists)], ["doc_id", "n", "terms", "tfs"])

    return run


class Block:
    """The postings of a block of documents, by term."""

    def __init__(self, ids: np.ndarray, norms: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, n_terms: int):
        order = np.argsort(term, kind="stable")
        self.ids, self.doc = ids, doc[order]
        tf = tf[order]
        self.gain = (1_000_000_000 * tf) // (1000 * tf + 20 * norms[self.doc])
        self.edge = np.searchsorted(term[order], np.arange(n_terms + 1))
        self.acc = np.zeros(len(ids), np.int64)

    def of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.edge[term], self.edge[term + 1]
        return self.doc[a:b], self.gain[a:b]

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of all documents that can be among the k best of an item; terms come rarest first.

        ``floor`` is a score that k documents of other blocks reach. A document first met at a term can get no more than
        the greatest gains of that term and those after it; once that is under the kth partial score, terms make no new
        accumulators, and those that exist are only brought up to date.
        """
        lists = [self.of(t) for t in terms.tolist()]
        bounds = np.array([int(w) * int(g.max(initial=0)) for w, (_, g) in zip(weights, lists, strict=True)], np.int64)
        left = np.cumsum(bounds[::-1])[::-1]
        acc, held = self.acc, np.zeros(0, np.int64)
        least, closed = floor, False
        for j, (docs, gain) in enumerate(lists):
            if not closed and left[j] < least:
                closed, held = True, np.flatnonzero(acc)
            if closed:
                if not len(held):
                    break
                if len(docs) > 16 * len(held):
                    at = np.minimum(np.searchsorted(docs, held), len(docs) - 1)
                    same = docs[at] == held
                    acc[held[same]] += weights[j] * gain[at[same]]
                else:
                    mine = acc[docs] > 0
                    acc[docs[mine]] += weights[j] * gain[mine]
                continue
            acc[docs] += weights[j] * gain
            if j + 1 < len(lists):
                partial = acc[acc > 0]
                if len(partial) >= k:
                    least = max(least, int(np.partition(partial, len(partial) - k)[len(partial) - k]))
        held = held if closed else np.flatnonzero(acc)
        scores = acc[held]
        acc[:] = 0
        keep = scores >= floor
        return held[keep], scores[keep]


def _search(items: list[tuple[int, np.ndarray, np.ndarray]], n_terms: int, documents: int, total: int, k: int, block: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in items]

        def search(rows: list[pa.RecordBatch]) -> None:
            t = pa.Table.from_batches(rows).combine_chunks()
            n = t.column("n").to_numpy()
            counts = pc.list_value_length(t.column("terms")).to_numpy()
            norms = 100 - 50 + (50 * n * documents) // total
            flat = [pc.list_flatten(t.column(c)).to_numpy().astype(np.int64) for c in ("terms", "tfs")]
            part = Block(t.column("doc_id").to_numpy(), norms, np.repeat(np.arange(len(n)), counts), *flat, n_terms)
            for i, (_, terms, weights) in enumerate(items):
                ids, scores = best[i]
                place, found = part.best(terms, weights, k, int(scores[-1]) if len(scores) >= k else 1)
                if len(place):
                    ids, scores = np.concatenate([ids, part.ids[place]]), np.concatenate([scores, found])
                    order = np.lexsort((ids, -scores))[:k]
                    best[i] = ids[order], scores[order]

        rows, size = [], 0
        for batch in batches:
            ends = np.cumsum(pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False) + 1)
            start = 0
            while start < batch.num_rows:
                done = int(ends[start - 1]) if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, done + block - size, "right")))
                rows.append(batch.slice(start, stop - start))
                size += int(ends[min(stop, batch.num_rows) - 1]) - done
                start = stop
                if size >= block or start < batch.num_rows:
                    search(rows)
                    rows, size = [], 0
        if rows:
            search(rows)
        for (item, _, _), (ids, scores) in zip(items, best, strict=True):
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), item)), pa.array(ids), pa.array(scores)], ["item_id", "doc_id", "score"])

    return run


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", most_terms: int = 1_000_000, block: int = 2_000_000) -> DataFrame:
    """The ``k`` best documents of each item: item_id, rank (from 1), doc_id, long score; equal scores by ascending doc_id.

    Terms are those of ``split_terms``. N documents hold a term, L terms are in them, n in this one, df documents hold
    this term, tf times this one. weight = floor(1000 ln((2N + 2) / (2 df + 1))), m = 100 - 50 + (50 n N) div L, and a
    score sums weight * ((10**9 tf) div (1000 tf + 20 m)) over an item's distinct terms. Only scores above 0 are returned.

    Items are taken in blocks of about ``most_terms`` terms, which are broadcast; a pass over whole documents writes
    each one's postings of these terms beside it, df is one aggregate over them, and a second pass scores blocks of about
    ``block`` postings, term at a time. No posting is shuffled: a document's postings are where its row is; a task returns
    its ``k`` best of each item, and only those are ranked together.

    A null text has no term; a row without an id is left out; repeated rows are documents each, and rank one after the
    other. Of several texts of one item the smallest is taken; a null one, or one without a term, finds nothing. Other
    columns, whatever their names, are not read. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    given = items.select(F.col(item_col).cast("long").alias("item_id"), F.col("text")).where("item_id is not null and text is not null")
    asked = map_arrow(given.groupBy("item_id").agg(F.min("text").alias("text")), _item_terms, "item_id long, terms array<string>").where(F.size("terms") > 0)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    blocks = ceil((asked.agg(F.sum(F.size("terms"))).first()[0] or 0) / most_terms)
    out = []
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).orderBy("item_id").collect()
        terms = sorted({t for r in part for t in r.terms})
        number = {t: i for i, t in enumerate(terms)}
        postings = materialise(map_arrow(texts, _post(terms), POSTINGS), "postings")
        documents, total = postings.agg(F.count(F.lit(1)), F.sum("n")).first()
        df = dict(postings.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
        weight = {t: math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1))) for t in df}
        plan = []
        for r in part:
            mine = sorted((df[t], t) for t in (number[x] for x in r.terms) if weight.get(t, 0) > 0)
            plan.append((r.item_id, np.array([t for _, t in mine], np.int64), np.array([weight[t] for _, t in mine], np.int64)))
        if documents:
            found = map_arrow(postings, _search(plan, len(terms), documents, total, k, block), SCORED)
            order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
            ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            out.append(materialise(ranked.select("item_id", "rank", "doc_id", "score"), "ranked"))
        discard(spark, postings)
    result = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for x in out:
        result = x if len(out) == 1 else result.union(x)
    return result


def op12_ranked_search(spark, sf_dir: str) -> DataFrame:
    """All documents for each benchmark item."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return ranked_search(read("documents"), read("benchmark"))
