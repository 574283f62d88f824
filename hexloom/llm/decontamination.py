"""Benchmark items inside documents, by size-partitioned MinHash sketches and exact shingle containment."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, floor

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow
from .kernels import NOT_WORD, WORD_BASE, Rolling, byte_view, mix, pieces, shingles, word_hashes

U = np.uint64
WIDTH = 5
BITS = 20
MATCHES = "doc_id long, item_id long, n_item long, n_shared long, containment double"


def _items(batches) -> Iterator[pa.RecordBatch]:
    """For each item with a word: the words of a shingle (five, or all of a shorter item) and its shingles."""
    for batch in batches:
        hashes, at = word_hashes(*byte_view(pc.utf8_lower(batch.column(1))), NOT_WORD)
        value, edge = shingles(hashes, at, WIDTH)
        some = np.flatnonzero(np.diff(edge))
        lists = pa.ListArray.from_arrays(pa.array(np.append(edge[some], len(value)).astype(np.int32)), pa.array(value.view(np.int64)))
        width = np.minimum(np.diff(at), WIDTH)[some]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), pa.array(width), lists], ["item_id", "width", "shingles"])


@dataclass
class Sketches:
    """The items whose shingles have one width: their shingle sets, and the sorted sketch values with their items."""

    width: int
    ids: np.ndarray
    sets: list[np.ndarray]
    need: np.ndarray
    hits: np.ndarray
    value: np.ndarray
    owner: np.ndarray
    bitmap: np.ndarray


def sketches(width: int, ids: np.ndarray, sets: list[np.ndarray], threshold: float, hits: int = 3) -> Sketches:
    """Items are parted by size in doubling classes; a class's sketch is as wide as its largest item needs.

    A document that holds ``threshold`` of an item misses at most (1 - threshold) of its n shingles, so among the
    floor((1 - threshold) * largest) + hits least MinHash values of the item it holds ``hits`` at least.
    """
    n = np.array([len(x) for x in sets])
    need = np.ceil(threshold * n - 1e-9).astype(np.int64)
    kept, owner = [], []
    for size in np.unique(np.log2(n).astype(int)):
        wide = floor((1 - threshold) * (2 ** (size + 1) - 1) + 1e-9) + hits
        for i in np.flatnonzero(np.log2(n).astype(int) == size):
            least = sets[i][np.argsort(mix(sets[i] ^ U(0xA0761D6478BD642F)))[:wide]]
            kept.append(least)
            owner.append(np.full(len(least), i))
    value, owner = np.concatenate(kept), np.concatenate(owner)
    order = np.argsort(value, kind="stable")
    bitmap = np.zeros(1 << BITS, bool)
    bitmap[(value >> U(64 - BITS)).astype(np.int64)] = True
    return Sketches(width, ids, sets, need, np.minimum(need, hits), value[order], owner[order], bitmap)


def _search(tables: list[Sketches]):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in pieces(batch.column(1)):
                part = batch.slice(a, b - a)
                hashes, at = word_hashes(*byte_view(pc.utf8_lower(part.column(1))), NOT_WORD)
                roll = Rolling(hashes, WORD_BASE)
                ids = part.column(0).to_numpy()
                for t in tables:
                    grams = roll.grams(t.width)
                    place = np.flatnonzero(t.bitmap[(grams >> U(64 - BITS)).astype(np.int64)])
                    low, high = np.searchsorted(t.value, grams[place], "left"), np.searchsorted(t.value, grams[place], "right")
                    place, low, high = place[high > low], low[high > low], high[high > low]
                    doc = np.searchsorted(at, place, "right") - 1
                    inside = place + t.width <= at[doc + 1]
                    doc, low, n = doc[inside], low[inside], (high - low)[inside]
                    entry = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
                    pair = np.unique(np.stack([np.repeat(doc, n), t.owner[entry], entry]), axis=1)[:2]
                    (doc, item), hits = np.unique(pair, axis=1, return_counts=True) if pair.size else (pair, np.zeros(0, int))
                    enough = hits >= t.hits[item] if len(hits) else np.zeros(0, bool)
                    rows = []
                    for d, i in zip(doc[enough].tolist(), item[enough].tolist(), strict=True):
                        shared = int(np.isin(t.sets[i], grams[at[d] : max(at[d], at[d + 1] - t.width + 1)]).sum())
                        if shared >= t.need[i]:
                            rows.append((ids[d], t.ids[i], len(t.sets[i]), shared, shared / len(t.sets[i])))
                    if rows:
                        columns = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), [pa.int64()] * 4 + [pa.float64()], strict=True)]
                        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "n_item", "n_shared", "containment"])

    return run


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", block: int = 1_000_000) -> DataFrame:
    """A row for each document that holds at least ``threshold`` of an item's distinct five-word shingles.

    doc_id, item_id, n_item (its shingles), n_shared, containment. Whole documents are searched, whatever their length.
    Items are taken in blocks of about ``block`` shingles: a block's sketches are broadcast (its size is what bounds
    them) and one pass over the documents searches it, so any number of items is a number of passes; candidates are
    verified against the document's own shingles in the same task, and nothing is shuffled.

    Words are runs of letters and digits in lower case. An item of under five words is one shingle of all its words. A
    null text, or one without words, holds and is held by nothing; rows without an id are left out; repeated documents
    each get their rows, of several texts of one item the smallest is taken; empty tables give an empty result.
    """
    spark = docs.sparkSession
    given = items.select(F.col(item_col).cast("long").alias("item_id"), F.col("text")).where("item_id is not null and text is not null")
    held = map_arrow(given.groupBy("item_id").agg(F.min("text").alias("text")), _items, "item_id long, width long, shingles array<long>")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    total = held.agg(F.sum(F.size("shingles"))).first()[0] or 0
    blocks = ceil(total / block)
    out = spark.createDataFrame([], MATCHES)
    for k in range(blocks):
        part = held.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).orderBy("item_id").toArrow()
        width = part.column("width").to_numpy()
        ids = part.column("item_id").to_numpy()
        sets = [np.array(x, np.int64).view(U) for x in part.column("shingles").to_pylist()]
        tables = [sketches(int(w), ids[width == w], [s for s, x in zip(sets, width, strict=True) if x == w], threshold) for w in np.unique(width)]
        shared = spark.sparkContext.broadcast(tables)
        found = map_arrow(texts, lambda batches, shared=shared: _search(shared.value)(batches), MATCHES)
        out = found if k == 0 else out.union(found)
    return out


def op5_containment_search(spark, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return contained_items(read("documents"), read("benchmark"))
