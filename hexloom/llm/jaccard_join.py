"""Documents whose word shingles have a Jaccard similarity over a threshold, with Bayesian pruning of candidates."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, local_components, map_arrow, materialise, with_group
from .kernels import NOT_WORD, byte_view, mix, pieces, shingles, word_hashes

U = np.uint64
WIDTH = 5
BANDS, ROWS = 24, 4


def permutations(n: int = BANDS * ROWS, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return (rng.integers(0, 1 << 31, n, dtype=np.uint32) << np.uint32(1)) | np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def text_shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct five-word shingles of each text in lower case; words are runs of letters and digits."""
    import pyarrow.compute as pc

    return shingles(*word_hashes(*byte_view(pc.utf8_lower(texts)), NOT_WORD), WIDTH)


def signatures(value: np.ndarray, at: np.ndarray) -> np.ndarray:
    """MinHash values of each text, a row each; of a text without shingles all ones."""
    out = np.full((len(at) - 1, BANDS * ROWS), 0xFFFFFFFF, np.uint32)
    some = np.flatnonzero(np.diff(at))
    if len(some):
        x = (value >> U(32)).astype(np.uint32)
        for p, (a, b) in enumerate(zip(*permutations(), strict=True)):
            out[some, p] = np.minimum.reduceat(x * a + b, at[some])
    return out


def set_sums(value: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """128 bits that stand for each text's shingle set; texts must have shingles."""
    return [np.add.reduceat(mix(value ^ U(seed)), at[:-1]).view(np.int64) for seed in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]


def _sketch(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in pieces(batch.column(1)):
            value, at = text_shingles(batch.column(1).slice(a, b - a))
            n = np.diff(at)
            some = np.flatnonzero(n)
            if not len(some):
                continue
            raw = np.ascontiguousarray(signatures(value, at)[some]).tobytes()
            sig = pa.array([raw[k : k + 4 * BANDS * ROWS] for k in range(0, len(raw), 4 * BANDS * ROWS)], pa.binary())
            doc = batch.column(0).slice(a, b - a).take(pa.array(some))
            sums = set_sums(value, np.append(at[some], at[-1]))
            yield pa.RecordBatch.from_arrays([doc, *(pa.array(x) for x in sums), pa.array(n[some]), sig], ["doc", "key_a", "key_b", "n", "sig"])


def least_matches(threshold: float, tolerance: float, step: int = 16) -> list[tuple[int, int]]:
    """(values compared, matches needed): with fewer, the posterior chance of reaching the threshold is below tolerance.

    Under a uniform prior the similarity given m matches among n is Beta(m + 1, n - m + 1), whose upper tail at t is
    the chance that a Binomial(n + 1, t) is at most m.
    """
    out = []
    for n in range(step, BANDS * ROWS + 1, step):
        tail, m = 0.0, 0
        while m <= n:
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                break
            m += 1
        out.append((n, m))
    return out


def candidates(left: np.ndarray, right: np.ndarray, needed: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that agree in a whole band and that no step of the comparison prunes."""
    shared = np.zeros((len(left), len(right)), bool)
    for b in range(0, BANDS * ROWS, ROWS):
        same = left[:, None, b] == right[None, :, b]
        for r in range(1, ROWS):
            same &= left[:, None, b + r] == right[None, :, b + r]
        shared |= same
    i, j = np.nonzero(shared)
    matches, done = np.zeros(len(i), np.int64), 0
    for n, least in needed:
        matches += (left[i, done:n] == right[j, done:n]).sum(axis=1)
        live = matches >= least
        i, j, matches, done = i[live], j[live], matches[live], n
    return i, j


def spanning(signature: np.ndarray, needed: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that no step of the comparison prunes, as far as they join what others did not join before.

    A row is compared with the rows after it that it isn't joined with, so a group of copies costs one comparison a row.
    """
    label, a, b = np.arange(len(signature)), [], []
    for r in range(len(signature) - 1):
        other = r + 1 + np.flatnonzero(label[r + 1 :] != label[r])
        if not len(other):
            continue
        matches, done = np.zeros(len(other), np.int64), 0
        for n, least in needed:
            matches += (signature[other, done:n] == signature[r, done:n]).sum(axis=1)
            live = matches >= least
            other, matches, done = other[live], matches[live], n
            if not len(other):
                break
        if len(other):
            joined, first = np.unique(label[other], return_index=True)
            a.append(np.full(len(first), r))
            b.append(other[first])
            label[np.isin(label, joined)] = label[r]
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _prune(threshold: float, tolerance: float):
    """Rows (band, doc, sig) sorted by band: edges between the documents of one band that may be similar enough."""
    needed = least_matches(threshold, tolerance)

    def run(batches) -> Iterator[pa.RecordBatch]:
        band, docs, sigs = None, [], []

        def finish():
            i, j = spanning(np.frombuffer(b"".join(sigs), np.uint32).reshape(len(docs), -1), needed)
            doc = np.array(docs, np.int64)
            return doc[i], doc[j]

        for batch in batches:
            found = []
            for k, doc, sig in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != band:
                    if len(docs) > 1:
                        found.append(finish())
                    band, docs, sigs = k, [], []
                docs.append(doc)
                sigs.append(sig)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["a", "b"])
        if len(docs) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in finish()], ["a", "b"])

    return run


def overlaps(values: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact numbers of shingles that the sets i and j share."""
    if len(i) < 64:
        return np.array([np.intersect1d(values[a], values[b], assume_unique=True).size for a, b in zip(i, j, strict=True)], np.int64)
    doc = np.repeat(np.arange(len(values)), [len(v) for v in values])
    _, column, n = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
    several = n > 1
    column = np.where(several, np.cumsum(several) - 1, -1)[column]
    doc, column = doc[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    doc, column = doc[order], column[order]
    total = np.zeros((len(values), len(values)), np.float64)
    step = max(256, 4_000_000 // len(values))
    for start in range(0, int(several.sum()), step):
        a, b = np.searchsorted(column, [start, start + step])
        has = np.zeros((len(values), step), np.float32)
        has[doc[a:b], column[a:b] - start] = 1
        total += has @ has.T
    return total[i, j].astype(np.int64)


def _payload(batches) -> Iterator[pa.RecordBatch]:
    """Each candidate document for each pair of blocks that it takes part in, with its shingles."""
    for batch in batches:
        text = batch.schema.names.index("text")
        for a, b in pieces(batch.column(text)):
            part = batch.slice(a, b - a)
            value, at = text_shingles(part.column(text))
            group, blocks, block, key_a, key_b = (part.column(i).to_numpy() for i in (1, 3, 4, 5, 6))
            some = np.flatnonzero(np.diff(at))
            same = np.zeros(part.num_rows, bool)
            if len(some):
                sums = set_sums(value, np.append(at[some], at[-1]))
                same[some] = (sums[0] == key_a[some]) & (sums[1] == key_b[some])
            raw = value.tobytes()
            rows, first, second = [], [], []
            for r, n, own in zip(np.flatnonzero(same).tolist(), blocks[same].tolist(), block[same].tolist(), strict=True):
                for other in range(n):
                    rows.append(r)
                    first.append(min(own, other))
                    second.append(max(own, other))
                    if len(rows) >= 5000:
                        yield _payload_rows(part, group, raw, at, block, rows, first, second)
                        rows, first, second = [], [], []
            if rows:
                yield _payload_rows(part, group, raw, at, block, rows, first, second)


def _payload_rows(part, group, raw, at, block, rows, first, second) -> pa.RecordBatch:
    take = np.array(rows)
    sets = pa.array([raw[8 * at[r] : 8 * at[r + 1]] for r in rows], pa.binary())
    columns = [pa.array(group[take]), pa.array(first, pa.int64()), pa.array(second, pa.int64()), part.column(0).take(pa.array(take)), part.column(2).take(pa.array(take)), pa.array(block[take]), sets]
    return pa.RecordBatch.from_arrays(columns, ["component", "first", "second", "doc", "weight", "block", "sets"])


def _verify(threshold: float, tolerance: float):
    needed = least_matches(threshold, tolerance)

    def group_links(doc, weight, block, same: bool, sets):
        values = [np.frombuffer(x, U) for x in sets]
        at = np.concatenate([[0], np.cumsum([len(v) for v in values])])
        sig = signatures(np.concatenate(values), at)
        left = np.arange(len(doc)) if same else np.flatnonzero(block == block.min())
        right = left if same else np.flatnonzero(block != block.min())
        if not len(right):
            return None
        found = []
        for k in range(0, len(left), 256):
            i, j = candidates(sig[left[k : k + 256]], sig[right], needed)
            found.append((left[i + k], right[j]))
        i, j = (np.concatenate(x) for x in zip(*found, strict=True))
        if same:
            i, j = i[i < j], j[i < j]
        n = np.diff(at)
        fits = np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j]) - 1e-9
        i, j = i[fits], j[fits]
        both = overlaps(values, i, j)
        linked = both >= threshold * (n[i] + n[j] - both) - 1e-9
        i, j = i[linked], j[linked]
        if not len(i):
            return None
        links = (np.bincount(i, weight[j], len(doc)) + np.bincount(j, weight[i], len(doc))).astype(np.int64)
        node, root = local_components(doc[i], doc[j])
        node, root = node[node != root], root[node != root]
        a = np.concatenate([doc[links > 0], node])
        b = np.concatenate([np.zeros((links > 0).sum(), np.int64), root])
        is_edge = np.arange(len(a)) >= (links > 0).sum()
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=~is_edge), pa.array(np.concatenate([links[links > 0], 0 * node]), mask=is_edge)], ["a", "b", "links"])

    def run(batches) -> Iterator[pa.RecordBatch]:
        key, rows = None, {}

        def finish():
            doc = np.array(list(rows), np.int64)
            weight, block, sets = (list(x) for x in zip(*rows.values(), strict=True))
            return group_links(doc, np.array(weight, np.float64), np.array(block), key[1] == key[2], sets)

        for batch in batches:
            for *k, doc, weight, block, sets in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key:
                    if len(rows) > 1 and (out := finish()) is not None:
                        yield out
                    key, rows = k, {}
                rows.setdefault(doc, (weight, block, sets))
        if len(rows) > 1 and (out := finish()) is not None:
            yield out

    return run


def similar_documents(
    docs: DataFrame, threshold: float = 0.8, tolerance: float = 1e-7, id_col: str = "doc_id", text_col: str = "text", block_rows: int = 256, band_rows: int = 4096
) -> DataFrame:
    """A row for each row of docs: id, rep_id (least document with the same shingle set), class_id, n_links, kept.

    Documents link if their sets of five-word shingles (lower case, letters and digits) have a Jaccard similarity of
    ``threshold`` or more; class_id is the least id that links lead to and n_links counts other documents linked
    directly, copies included. Documents with one shingle set stand for one with a weight.

    1. MinHash bands bring documents together (at 0.8, 24 bands of 4 miss 3 pairs in a million). Bands that hold the same
       documents are one.
    2. Within a band signatures alone are compared, 16 MinHash values at a time, and a pair is dropped once the posterior
       chance of reaching the threshold is below ``tolerance``. What is left joins documents into groups. A band of more
       than ``band_rows`` documents is joined whole.
    3. Texts are read for the members of groups only. A group is cut into blocks of about ``block_rows`` documents whose
       pairs are separate tasks; a task prunes once more and verifies what is left on the shingles. Tasks return counts
       and spanning edges, never pairs.

    A null text, and one without a word, links with nothing; a text of under five words is one shingle; rows with one
    id are one document, that of the least shingle set by its hash; a row without an id links with nothing. An empty
    table gives an empty result. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    texts = rows.where("doc is not null and text is not null")
    sketch = map_arrow(texts, _sketch, "doc long, key_a long, key_b long, n long, sig binary")
    sketch = sketch.groupBy("doc").agg(F.min(F.struct("key_a", "key_b", "n", "sig")).alias("x")).select("doc", "x.*")
    sketch = materialise(with_group(sketch, ["key_a", "key_b", "n"], "doc"), "sketch")
    reps = sketch.where("doc = group_id")

    keys = [F.xxhash64(F.lit(b), F.substring("sig", 1 + 4 * ROWS * b, 4 * ROWS)) for b in range(BANDS)]
    bands = reps.select("doc", F.explode(F.array(*keys)).alias("band"))
    same_docs = [F.bit_xor(F.xxhash64("doc")).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), "doc")).alias("y")]
    shared = bands.groupBy("band").agg(F.count(F.lit(1)).alias("m"), F.min("doc").alias("least"), *same_docs).where("m > 1")
    shared = shared.groupBy("m", "x", "y", "least").agg(F.min("band").alias("band")).select("band", "m", "least")
    held = bands.join(shared, "band")
    whole = held.where((F.col("m") > band_rows) & (F.col("doc") != F.col("least"))).select(F.col("doc").alias("a"), F.col("least").alias("b"))
    few = held.where(F.col("m") <= band_rows).select("band", "doc").hint("merge").join(reps.select("doc", "sig"), "doc")
    few = few.select("band", "doc", "sig").repartition("band").sortWithinPartitions("band")
    # written first, so that a task runs one Python worker at a time
    near = materialise(whole.union(map_arrow(few, _prune(threshold, tolerance), "a long, b long")), "near")
    together = components(near).withColumnRenamed("node", "doc")

    member = materialise(reps.select("doc", "n", "key_a", "key_b", F.col("group_size").alias("weight")).join(together, "doc"), "candidates")
    sizes = member.groupBy("component").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("total"))
    blocks = F.greatest(F.ceil(F.col("m") / block_rows), F.ceil(F.col("total") / 1_000_000))
    member = member.join(sizes.select("component", blocks.alias("blocks")), "component")
    member = member.select("doc", "component", "weight", "blocks", F.pmod(F.xxhash64("doc"), F.col("blocks")).alias("block"), "key_a", "key_b")
    # candidates grow with the corpus, so they are merged with the texts at every size and never broadcast
    payload = map_arrow(member.hint("merge").join(texts, "doc"), _payload, "component long, first long, second long, doc long, weight long, block long, sets binary")
    dealt = payload.repartition("component", "first", "second").sortWithinPartitions("component", "first", "second", "doc")
    found = materialise(map_arrow(dealt, _verify(threshold, tolerance), "a long, b long, links long"), "links")

    links = found.where("b is null").groupBy(F.col("a").alias("group_id")).agg(F.sum("links").alias("links"))
    classes = components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "group_id")
    by_group = links.join(classes, "group_id", "full")
    known = sketch.select("doc", "group_id", "group_size").join(by_group, "group_id", "left")
    out = rows.select("doc").join(known, "doc", "left").select(
        F.col("doc").alias(id_col),
        F.coalesce("group_id", "doc").alias("rep_id"),
        F.coalesce("component", "group_id", "doc").alias("class_id"),
        (F.coalesce("group_size", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
    )
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("class_id"), F.lit(True)))


def op8_bayesian_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """All documents, linked at a Jaccard similarity of 0.8 of their five-word shingles."""
    return similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
