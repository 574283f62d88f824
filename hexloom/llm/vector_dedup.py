"""Near-duplicate vectors by an inverted multi-index: two codebooks, a product grid, multi-sequence visits, verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, local_components, map_arrow, materialise, with_group

CHUNKS = 1 << 20
#: How finely the reach of real pairs is told.
NEED_BINS = 4096


def unit_rows(column: pa.Array) -> np.ndarray:
    """The vectors of a list column at length one, in double precision."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = values.reshape(len(column), -1) if len(column) else values.reshape(0, 1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x[:, : x.shape[1] // 2], x[:, x.shape[1] // 2 :]


def kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = np.unique(x, axis=0)
    centres = centres[rng.permutation(len(centres))[:k]]
    for _ in range(rounds):
        nearest = distances(x, centres).argmin(axis=1)
        n = np.bincount(nearest, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return np.unique(centres, axis=0)


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None, :], 0)


class Grid:
    """Cells are pairs of centroids, one from each codebook."""

    def __init__(self, books: tuple[np.ndarray, np.ndarray]):
        self.books = books
        self.width = len(books[1])
        self.apart = [np.sqrt(distances(b, b)) for b in books]

    def reach(self, x: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each half: the nearest centroid, and squared distances to the bounds of all centroids' regions."""
        near, bounds = [], []
        for half, book, apart in zip(halves(x), self.books, self.apart, strict=True):
            d = distances(half, book)
            a = d.argmin(axis=1)
            gap = (d - d[np.arange(len(d)), a][:, None]) / (2 * np.maximum(apart[a], 1e-12))
            gap[np.arange(len(d)), a] = 0
            near.append(a)
            bounds.append(np.maximum(gap, 0) ** 2)
        return near, bounds

    def cells(self, x: np.ndarray) -> np.ndarray:
        near, _ = self.reach(x)
        return near[0].astype(np.int64) * self.width + near[1]

    def visits(self, x: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of the cells that the multi-sequence traversal of each row meets up to the limit, nearest first.

        Both halves' centroids are sorted by distance. For each place in the first list a pointer says how far the second
        was followed; a step takes, of all pointers, the cell with the least sum and moves that pointer on. It ends
        where the next cell lies beyond the limit. All rows take their steps together.
        """
        _, bounds = self.reach(x)
        order = [b.argsort(axis=1, kind="stable") for b in bounds]
        near = [np.take_along_axis(b, o, axis=1) for b, o in zip(bounds, order, strict=True)]
        first = near[0][:, : max(1, int((near[0] <= limit).sum(axis=1).max(initial=1)))]
        second = np.concatenate([near[1], np.full((len(x), 1), np.inf)], axis=1)
        pointer = np.zeros(first.shape, np.int64)
        front = first + second[:, :1]
        live, rows, cells = np.arange(len(x)), [], []
        while len(live):
            i = front[live].argmin(axis=1)
            on = front[live, i] <= limit
            live, i = live[on], i[on]
            j = pointer[live, i]
            rows.append(live)
            cells.append(order[0][live, i].astype(np.int64) * self.width + order[1][live, j])
            pointer[live, i] = j + 1
            front[live, i] = first[live, i] + second[live, j + 1]
        return np.concatenate(rows or [np.zeros(0, np.int64)]), np.concatenate(cells or [np.zeros(0, np.int64)])


def lossless_limit(threshold: float) -> float:
    """No two vectors of that cosine lie further apart than this (squared), whatever their directions."""
    return 2 * (1 - threshold) + 1e-9


def _needs(grid: Grid, ids: np.ndarray, x: np.ndarray, threshold: float):
    """Counts of real pairs (query, row) by how far a visit must go to meet them, in bins up to the lossless limit."""
    q_near, q_bounds = grid.reach(x)

    def run(batches) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(NEED_BINS, np.int64)
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                batch = whole.slice(k, 1000)
                rows, row_ids = unit_rows(batch.column(1)), batch.column(0).to_numpy()
                q, m = np.nonzero(x @ rows.T >= threshold)
                other = ids[q] != row_ids[m]
                q, m = q[other], m[other]
                if not len(q):
                    continue
                near, bounds = grid.reach(rows)
                forth = q_bounds[0][q, near[0][m]] + q_bounds[1][q, near[1][m]]
                back = bounds[0][m, q_near[0][q]] + bounds[1][m, q_near[1][q]]
                need = np.minimum(forth, back) * (NEED_BINS / lossless_limit(threshold))
                seen += np.bincount(np.minimum(need.astype(np.int64), NEED_BINS - 1), minlength=NEED_BINS)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["bin", "n"])

    return run


def traversal_limit(needs: dict[int, int], threshold: float, target_recall: float) -> float:
    """How far visits must go to meet the counted pairs; half of what the target lets them miss is left for chance.

    Where too few pairs were seen to tell, it is the lossless limit.
    """
    most, total, left = lossless_limit(threshold), sum(needs.values()), 1 - target_recall
    if total * left < 2:
        return most
    met = 0
    for k in sorted(needs):
        met += needs[k]
        if met >= total * (1 - left / 2):
            break
    return most * (k + 1) / NEED_BINS


def _cells(grid: Grid):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(grid.cells(unit_rows(batch.column(0))))], ["cell"])

    return run


def _dealt(grid: Grid, limit: float, chunks: dict[int, int]):
    """Each vector as a member of its cell, and as a visitor of every chunk of every cell in its reach."""

    step = max(16, min(1000, 1_000_000 // (len(grid.books[0]) + grid.width)))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, step):
                batch = whole.slice(k, step)
                x, ids = unit_rows(batch.column(2)), batch.column(0).to_numpy()
                own = grid.cells(x)
                member = own * CHUNKS + np.array([i % chunks.get(c, 1) for i, c in zip(ids.tolist(), own.tolist(), strict=True)], np.int64)
                row, cell = grid.visits(x, limit)
                n = np.array([chunks.get(c, 1) for c in cell.tolist()], np.int64)
                row, cell = np.repeat(row, n), np.repeat(cell, n)
                part = np.arange(len(cell)) - np.repeat(np.cumsum(n) - n, n)
                take = np.concatenate([np.arange(len(x)), row])
                group = np.concatenate([member, cell * CHUNKS + part])
                visitor = np.concatenate([np.zeros(len(x), bool), np.ones(len(row), bool)])
                for a in range(0, len(take), 10_000):
                    some, rows = slice(a, a + 10_000), pa.array(take[a : a + 10_000])
                    yield pa.RecordBatch.from_arrays([pa.array(group[some]), pa.array(visitor[some]), *(batch.column(i).take(rows) for i in range(3))], ["group", "visitor", "id", "weight", "v"])

    return run


class Members:
    """The members of a chunk, by cell."""

    def __init__(self, grid: Grid, x: np.ndarray):
        self.grid, self.x = grid, x
        cell = grid.cells(x)
        self.order = cell.argsort(kind="stable")
        self.cells, self.start = np.unique(cell[self.order], return_index=True)
        self.size = np.diff(np.append(self.start, len(cell)))

    def met(self, q: np.ndarray, limit: float, threshold: float, block: int = 50_000) -> tuple[np.ndarray, np.ndarray]:
        """(row of q, member) of cosine >= threshold, among the members in the cells that the row's traversal visits."""
        row, cell = self.grid.visits(q, limit)
        at = np.minimum(np.searchsorted(self.cells, cell), len(self.cells) - 1)
        some = self.cells[at] == cell
        row, at = row[some], at[some]
        n = self.size[at]
        row, place = np.repeat(row, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.start[at], n)
        member = self.order[place]
        near = [np.einsum("ij,ij->i", q[row[k : k + block]], self.x[member[k : k + block]]) >= threshold for k in range(0, len(row), block)]
        keep = np.concatenate([np.zeros(0, bool), *near])
        return row[keep], member[keep]


def _compare(grid: Grid, limit: float, threshold: float, by_cell: bool):
    """Rows sorted by group, members first: counts links of both sides and joins linked vectors to their least.

    A group is a chunk of one cell, all of whose visitors have reached it; or, by_cell, a chunk of many cells, where each
    visitor's traversal says which of them it compares itself with.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        group, members, table = None, [], None
        for batch in batches:
            groups, visitor = batch.column(0).to_numpy(), np.asarray(batch.column(1))
            ids, weight = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            new = np.flatnonzero(np.concatenate([[True], (groups[1:] != groups[:-1]) | (visitor[1:] != visitor[:-1])])) if len(groups) else []
            for a, b in zip(new, [*new[1:], len(groups)], strict=True):
                if groups[a] != group:
                    group, members, table = groups[a], [], None
                x = unit_rows(batch.column(4).slice(a, b - a))
                if not visitor[a]:
                    members.append((ids[a:b], weight[a:b], x))
                    continue
                if not members:
                    continue
                if table is None:
                    m_id, m_weight, m_x = (np.concatenate(c) for c in zip(*members, strict=True))
                    table = (m_id, m_weight, m_x, grid.reach(m_x)[1], Members(grid, m_x) if by_cell else None)
                m_id, m_weight, m_x, m_bounds, held = table
                for k in range(0, b - a, 512):
                    q_id, q_weight, q_x = ids[a:b][k : k + 512], weight[a:b][k : k + 512], x[k : k + 512]
                    q, m = held.met(q_x, limit, threshold) if by_cell else np.nonzero(q_x @ m_x.T >= threshold)
                    other = q_id[q] != m_id[m]
                    q, m = q[other], m[other]
                    if not len(q):
                        continue
                    cell, _ = grid.reach(q_x)
                    mutual = m_bounds[0][m, cell[0][q]] + m_bounds[1][m, cell[1][q]] <= limit
                    found = np.bincount(q, m_weight[m], len(q_id)).astype(np.int64)
                    back = np.bincount(m[~mutual], q_weight[q[~mutual]], len(m_id)).astype(np.int64)
                    node, root = local_components(q_id[q], m_id[m])
                    node, root = node[node != root], root[node != root]
                    a_side = np.concatenate([q_id[found > 0], m_id[back > 0], node])
                    links = np.concatenate([found[found > 0], back[back > 0], np.zeros(len(node), np.int64)])
                    edge = np.concatenate([np.full(len(links) - len(node), -1), root])
                    is_edge = np.arange(len(links)) >= len(links) - len(node)
                    yield pa.RecordBatch.from_arrays([pa.array(a_side), pa.array(edge, mask=~is_edge), pa.array(links, mask=is_edge)], ["a", "b", "links"])

    return run


def near_vectors(
    vectors: DataFrame,
    threshold: float = 0.95,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    sample_rows: int = 16_384,
    per_cell: int = 128,
    most_centroids: int = 4096,
    target_recall: float = 0.999,
    chunk_rows: int = 4096,
    query_rows: int = 2048,
) -> DataFrame:
    """A row for each row of vectors: id, n_links, component_id, kept.

    Vectors link at cosine >= threshold in double precision. Equal vectors stand for one with a weight. Codebooks of
    both halves are fitted on ``sample_rows`` vectors at most, or 16 for each of their centroids (those with the least
    hashed ids); the number of centroids grows with the root of the number of vectors, up to ``most_centroids``, where
    cells hold 2 billion vectors at ``per_cell`` each. Every vector is
    indexed under its product cell and visits the cells within the calibrated reach: that of the real pairs which
    ``query_rows`` of the sampled vectors form with all rows, compared by brute force in tasks, or the lossless one where
    those pairs are too few to tell. If so many cells are in reach that a copy for each would be more than one for each
    chunk of all vectors, chunks are dealt without regard to cells, and the traversal (of a finer grid) decides in the chunk
    which of its cells a visitor is compared with. Cells are cut into chunks of about
    ``chunk_rows`` members, so a cell that a third of all vectors fall into is many tasks, and a task keeps one chunk
    while visitors stream by. Tasks return counts and spanning edges, never pairs.

    A vector that is null, empty, zero, or holds a null or non-finite component links with nothing, as does a row
    without an id; vectors of different lengths do not link; rows with one id are one vector (the least of them). An
    empty table gives an empty result. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    valid = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(finite & F.exists("v", lambda x: x != 0))
    valid = valid.groupBy("id").agg(F.min("v").alias("v"))
    keyed = valid.select("id", "v", F.size("v").alias("dim"), F.xxhash64("v").alias("key_a"), F.xxhash64(F.lit(977), "v").alias("key_b"))
    x = materialise(with_group(keyed, ["key_a", "key_b"], "id").select("id", "v", "dim", "group_id", "group_size"), "vectors")

    found = None
    for dim, n in sorted(tuple(r) for r in x.where("id = group_id").groupBy("dim").count().collect()):
        reps = x.where((F.col("id") == F.col("group_id")) & (F.col("dim") == dim)).select("id", F.col("group_size").alias("weight"), "v")
        k = int(min(most_centroids, max(1, round((n / per_cell) ** 0.5))))
        wanted = max(sample_rows, 16 * k)
        # about as many vectors as are wanted lie under a cut of the hash; no more reach the sort
        order, share = F.pmod(F.xxhash64("id"), F.lit(1 << 40)), min(1.0, 1.3 * wanted / n)
        few = reps.where(order <= int(share * (1 << 40))).orderBy(order, "id").limit(wanted)
        few = few.select("id", "v").toArrow().combine_chunks()
        sample_ids, sample = few.column(0).to_numpy(), unit_rows(few.column(1).combine_chunks())
        grid = Grid(tuple(kmeans(np.ascontiguousarray(h), k) for h in halves(sample)))
        needs = map_arrow(reps.select("id", "v"), _needs(grid, sample_ids[:query_rows], sample[:query_rows], threshold), "bin long, n long")
        needs = {r[0]: r[1] for r in needs.groupBy("bin").agg(F.sum("n")).collect()}  # at most NEED_BINS
        limit = traversal_limit(needs, threshold, target_recall)
        reach = lambda g: len(g.visits(sample[:256], limit)[0]) / len(sample[:256])
        layout, reached = grid, reach(grid)
        by_cell = reached > max(4 * n / chunk_rows, len(grid.books[0]) * grid.width / 8)
        if by_cell:
            # so many cells are in reach that a copy of each vector for each would be more than one for each chunk of all
            # vectors: chunks hold many cells, and these are made finer until a traversal leaves most of them out
            layout = Grid(tuple(h.mean(axis=0, keepdims=True) for h in halves(sample)))
            while 8 * reached > len(grid.books[0]) * grid.width and reached < 512 and 8 * k <= len(sample):
                k *= 2
                grid = Grid(tuple(kmeans(np.ascontiguousarray(h), k) for h in halves(sample)))
                reached = reach(grid)
        counts = map_arrow(reps.select("v"), _cells(layout), "cell long").groupBy("cell").count().where(F.col("count") > chunk_rows).collect()
        chunks = {r[0]: -(-r[1] // chunk_rows) for r in counts}  # at most most_centroids squared
        kind = dict(reps.dtypes)["v"]
        dealt = map_arrow(reps, _dealt(layout, limit, chunks), f"group long, visitor boolean, id long, weight long, v {kind}")
        dealt = dealt.repartition("group").sortWithinPartitions("group", "visitor")
        part = map_arrow(dealt, _compare(grid, limit, threshold, by_cell), "a long, b long, links long")
        found = part if found is None else found.union(part)
    ids = rows.select("id")
    if found is None:
        return ids.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    found = materialise(found, "links")
    links = found.where("b is null").groupBy(F.col("a").alias("group_id")).agg(F.sum("links").alias("links"))
    together = components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "group_id")
    by_group = links.join(together, "group_id", "full")
    known = x.select("id", "group_id", "group_size").join(by_group, "group_id", "left")
    out = ids.join(known, "id", "left").select(
        F.col("id").alias(id_col),
        (F.coalesce("group_size", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
        F.coalesce("component", "group_id", "id").alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def measured_recall(vectors: DataFrame, found: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100, block: int = 2048) -> DataFrame:
    """One row: links of the vectors whose id is divisible by ``every``, by brute force against all rows and as found, and the recall.

    The queries are taken in blocks of ``block`` rows; each block is compared with all rows in one pass of tasks.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id is not null and v is not null")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0))
    queries = rows.where(F.col("id") % every == 0)
    blocks = max(1, -(-queries.count() // block))
    true = None
    for k in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k).dropDuplicates(["id"]).toArrow().combine_chunks()
        if not len(part):
            continue
        ids, x = part.column(0).to_numpy(), unit_rows(part.column(1).combine_chunks())

        def count(batches, ids=ids, x=x) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(ids), np.int64)
            for batch in batches:
                if batch.num_rows:
                    total += ((x @ unit_rows(batch.column(1)).T >= threshold) & (ids[:, None] != batch.column(0).to_numpy()[None, :])).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], ["id", "n"])

        one = map_arrow(rows, count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
        true = one if true is None else true.union(one)
    if true is None:
        return rows.sparkSession.createDataFrame([(0, 0, 1.0)], "links_true long, links_found long, recall double")
    met = true.join(found.select(F.col(id_col).alias("id"), "n_links").dropDuplicates(["id"]), "id", "left")
    return met.agg(F.sum("n").alias("links_true"), F.sum(F.least("n", F.coalesce("n_links", F.lit(0)))).alias("links_found")).withColumn(
        "recall", F.when(F.col("links_true") > 0, F.col("links_found") / F.col("links_true")).otherwise(1.0)
    )


def op3_inverted_multi_index(spark, sf_dir: str) -> DataFrame:
    """All embeddings, linked at cosine 0.95 or more whatever their labels."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
