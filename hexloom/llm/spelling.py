"""Spelling variants: words one edit apart, by dynamic programming down a sorted vocabulary, grouped under frequent forms."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import groupby
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_arrow, materialise

#: Letters of a word, the capitals that are lower-cased, and how often a letter is taken out.
LETTERS = "[A-Za-zÀ-ÿ]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ONE_IN = 199

ROUTED = "backward boolean, list int, member boolean, key string, word string, n long"
NEAR = "word string, n_near long, best string, best_n long"
#: Cells of the edit matrix only tell 0 and 1 from more.
MORE = 2


class SortedList:
    """Sorted distinct words, and how long a prefix each has in common with the one before."""

    def __init__(self, words: list[str]):
        self.words = words
        self.size = np.array([len(w) for w in words], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.codes = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
        self.lcp = np.zeros(len(words), np.int64)
        shorter = np.minimum(self.size[1:], self.size[:-1])
        alive, d = np.flatnonzero(shorter > 0), 0
        while len(alive):
            alive = alive[self.codes[self.at[alive] + d] == self.codes[self.at[alive + 1] + d]]
            d += 1
            self.lcp[alive + 1] = d
            alive = alive[shorter[alive] > d]

    def one_edit(self, queries: list[str], fixed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) for all words exactly one edit from a query with which they share its first ``fixed`` letters.

        The scan goes down the list's columns for all queries together. A state is a query and a range of words with a
        common prefix of d letters, with the three cells about the diagonal of that prefix's row of the edit matrix. The
        next letter parts the range where the common prefix of neighbours is d long; the row is carried on once for all
        words of a part, and a part in whose row all cells are over one is skipped whole.
        """
        if not self.words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        size = np.array([len(q) for q in queries], np.int64)
        at = np.cumsum(size) - size
        letters = np.frombuffer("".join(queries).encode("latin-1"), np.uint8)

        def letter(q: np.ndarray, j: int) -> np.ndarray:
            return np.where(j < size[q], letters[np.minimum(at[q] + j, len(letters) - 1)], 0)

        order = np.argsort(fixed, kind="stable")
        depths, begin = np.unique(fixed[order], return_index=True)
        joins = {int(d): order[a:b] for d, a, b in zip(depths, begin, [*begin[1:], len(order)], strict=True)}
        q, low, high = (np.zeros(0, np.int64) for _ in range(3))
        row = np.zeros((3, 0), np.int8)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        d, last = (int(depths[0]), int(depths[-1])) if len(depths) else (0, -1)
        while len(q) or d <= last:
            if d in joins:
                new = joins[d]
                ends = [(bisect_left(self.words, p), bisect_right(self.words, p + "\U0010ffff")) for p in (queries[k][:d] for k in new.tolist())]
                a, b = np.array(ends, np.int64).reshape(-1, 2).T
                q, low, high = np.concatenate([q, new]), np.concatenate([low, a]), np.concatenate([high, b])
                row = np.concatenate([row, np.repeat(np.array([[1], [0], [1]], np.int8), len(new), axis=1)], axis=1)
            # the word that ends here, if there is one, is the first of its range
            full = (low < high) & (self.size[np.minimum(low, len(self.size) - 1)] == d)
            gap = size[q] - d
            hit = full & (np.abs(gap) <= 1)
            hit[hit] = row[gap[hit] + 1, np.flatnonzero(hit)] == 1
            found.append((q[hit], low[hit]))
            low = low + full
            some = low < high
            q, low, high, row = q[some], low[some], high[some], row[:, some]
            if not len(q):
                d += 1
                continue
            parting = np.flatnonzero(self.lcp == d)
            first, stop = np.searchsorted(parting, low, "right"), np.searchsorted(parting, high, "left")
            n = 1 + np.maximum(stop - first, 0)
            of = np.repeat(np.arange(len(q)), n)
            nth = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            edge = np.append(parting, 0)
            start = np.where(nth == 0, low[of], edge[np.minimum(first[of] + nth - 1, len(parting))])
            end = np.where(nth == n[of] - 1, high[of], edge[np.minimum(first[of] + nth, len(parting))])
            q, old, c = q[of], row[:, of], self.codes[self.at[start] + d]
            cells = np.empty_like(old)
            cells[0] = np.minimum(old[0] + (letter(q, d - 1) != c), old[1] + 1)
            cells[1] = np.minimum(np.minimum(old[1] + (letter(q, d) != c), old[2] + 1), cells[0] + 1)
            cells[1][size[q] < d + 1] = MORE
            cells[2] = np.minimum(old[2] + (letter(q, d + 1) != c), cells[1] + 1)
            cells[2][size[q] < d + 2] = MORE
            cells[0][size[q] < d] = MORE
            np.minimum(cells, MORE, out=cells)
            some = cells.min(axis=0) < MORE
            q, low, high, row = q[some], start[some], end[some], cells[:, some]
            d += 1
        return np.concatenate([np.zeros(0, np.int64), *[f[0] for f in found]]), np.concatenate([np.zeros(0, np.int64), *[f[1] for f in found]])


def fixed_letters(word: str, backward: bool) -> int:
    """How many letters are shared, read in that direction. One edit leaves of any word the first half as it is, or the rest.

    With a letters in the first half of L, words one edit apart share p letters at the front and s at the back with
    p + s >= L - 1; so p >= a or s >= L - a.
    """
    return len(word) - len(word) // 2 if backward else len(word) // 2


def may_begin(key: str, fixed: int, prefix: str) -> bool:
    """Whether some word that begins with prefix can be one edit from key and share its first ``fixed`` letters."""
    p, most = 0, min(len(key), len(prefix))
    while p < most and key[p] == prefix[p]:
        p += 1
    if p == len(prefix):
        return True
    if p < fixed:
        return False
    rest = prefix[p + 1 :]
    return p == len(key) or key.startswith(rest, p + 1) or key.startswith(rest, p) or key.startswith(prefix[p:], p + 1)


def _route(bounds: dict[bool, list[str]]):
    """Each word to the list where it stands, in both directions, and to the other lists where it may have near words."""
    shared = {}
    for way, firsts in bounds.items():
        # all words of a list share the letters that its bounds share
        shared[way] = [common_prefix(a, b) for a, b in zip(firsts, firsts[1:], strict=False)] + [""]

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for way, firsts in bounds.items():
                    key, fixed = (word[::-1], fixed_letters(word, True)) if way else (word, fixed_letters(word, False))
                    own = bisect_right(firsts, key) - 1
                    low, high = bisect_right(firsts, key[:fixed]) - 1, bisect_right(firsts, key[:fixed] + "\U0010ffff") - 1
                    out.append((way, own, True, key, word, n))
                    out += [(way, k, False, key, word, n) for k in range(max(low, 0), high + 1) if k != own and may_begin(key, fixed, shared[way][k])]
            if out:
                kinds = (pa.bool_(), pa.int32(), pa.bool_(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], [c.split()[0] for c in ROUTED.split(", ")])

    return run


def common_prefix(a: str, b: str) -> str:
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[:k]


def _scan(block: int):
    """Rows come list by list: first the words of the list in order, then those that only ask."""

    def rows(batches):
        for batch in batches:
            yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)

    def near(held: SortedList, counts: np.ndarray, rank: np.ndarray, words: list[str], asked: list[tuple], backward: bool):
        q, w = held.one_edit([r[3] for r in asked], np.array([fixed_letters(r[4], backward) for r in asked], np.int64))
        if backward and len(q):  # pairs that share the first half are found in the other direction
            half = [r[4][: len(r[4]) // 2] for r in asked]
            keep = np.array([not words[b].startswith(half[a]) for a, b in zip(q.tolist(), w.tolist(), strict=True)], bool)
            q, w = q[keep], w[keep]
        order = np.lexsort((rank[w], -counts[w], q))
        q, w = q[order], w[order]
        who, first, n = np.unique(q, return_index=True, return_counts=True)
        best = w[first]
        columns = [pa.array([asked[k][4] for k in who.tolist()], pa.string()), pa.array(n), pa.array([words[k] for k in best.tolist()], pa.string()), pa.array(counts[best])]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in NEAR.split(", ")])

    def run(batches) -> Iterator[pa.RecordBatch]:
        for (backward, _), of_list in groupby(rows(batches), key=lambda r: r[:2]):
            held, members, asked = None, [], []
            for r in of_list:
                if r[2]:
                    members.append(r)
                    continue
                held = held or _held(members)
                asked.append(r)
                if len(asked) == block:
                    yield near(*held, asked, backward)
                    asked = []
            held = held or _held(members)
            for k in range(0, len(members), block):
                yield near(*held, members[k : k + block], backward)
            if asked:
                yield near(*held, asked, backward)

    return run


def _held(members: list[tuple]) -> tuple[SortedList, np.ndarray, np.ndarray, list[str]]:
    words = [r[4] for r in members]
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    return SortedList([r[3] for r in members]), np.array([r[5] for r in members], np.int64), rank, words


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = 6, least_n: int = 5) -> DataFrame:
    """(word, n): the words of all texts, as ``spelling_variants`` has them. Counted before the shuffle."""
    runs = docs.select(F.col(id_col).cast("long").cast("string").alias("id"), F.explode(F.regexp_extract_all(F.translate(text_col, CAPITALS, SMALL), F.lit(LETTERS), F.lit(0))).alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
    cut = F.expr("concat(substring(run, 1, cast(h % char_length(run) as int)), substring(run, cast(h % char_length(run) as int) + 2))")
    words = runs.select(F.when(F.col("h") % ONE_IN == 0, cut).otherwise(F.col("run")).alias("word")).where(F.char_length("word") >= least_letters)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_n)


def near_words(words: DataFrame, list_words: int = 16_384, block: int = 4096) -> DataFrame:
    """(word, n_near, best, best_n) for each of the distinct words (word, n) that has a word one edit away.

    best is the near word of largest n, the smallest of several. The vocabulary stands in two orders, of the words and of
    the words read backwards, each cut in sorted lists of about ``list_words``, one in a task at a time; the cuts come
    from a sample of 64 words a list. Half of a word is untouched by an edit, so a word is looked up among those that
    share its first half, and backwards among those that share the rest: in the list where it stands, and in those others
    whose common prefix is within one edit. Lists that share a long prefix are told apart by what follows it, so a prefix
    that a third of all words share is many lists, and no word is compared with all of them.
    """
    n = words.count()
    lists = ceil(n / list_words)
    sample = [r[0] for r in words.where(F.pmod(F.xxhash64(F.lit(5), "word"), F.lit(max(1, list_words // 64))) == 0).select("word").collect()] if lists > 1 else []
    bounds = {}
    for way in (False, True):
        keys = sorted(w[::-1] if way else w for w in sample)
        bounds[way] = sorted({"", *[keys[len(keys) * k // lists] for k in range(1, lists)]}) if keys else [""]
    routed = map_arrow(words.select("word", "n"), _route(bounds), ROUTED)
    dealt = routed.repartition(max(1, 2 * lists), "backward", "list").sortWithinPartitions("backward", "list", F.desc("member"), "key")
    found = map_arrow(dealt, _scan(block), NEAR)
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.word").alias("best"), (-F.col("b.n")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): where the forms lead. Every round doubles the steps taken, so few are needed."""
    spark = forms.sparkSession
    state = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = materialise(state.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = after.where("moved").limit(1).count()
        discard(spark, state)
        state = after.drop("moved")
        if not moved:
            return state


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: int = 5, list_words: int = 16_384, least_letters: int = 6, least_n: int = 5) -> DataFrame:
    """A row for each word: word, form, root, n, n_near, form_n.

    Words are the maximal runs of letters (A-Z, a-z, U+00C0 to U+00FF) of whole texts with A-Z in lower case; of a run
    whose CRC-32 with its document's id is a multiple of 199 one letter is taken out. Those of ``least_letters`` and of
    ``least_n`` occurrences are kept. A word's form is the most frequent of the words one edit away (the smallest of
    several), if it is at least ``ratio`` times as frequent; root follows forms to their end.

    A null text has no words; in a row without an id no letter is taken out; repeated rows count each; other columns,
    whatever their names, are not read. An empty table, or one without such words, gives an empty result.
    """
    spark = docs.sparkSession
    words = materialise(vocabulary(docs, id_col, text_col, least_letters, least_n), "words")
    near = near_words(words, list_words)
    close = F.col("best_n") >= ratio * F.col("n")
    x = words.join(near, "word", "left").select(
        "word", F.when(close, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(close, F.col("best_n")).alias("form_n")
    )
    x = materialise(x, "forms")
    discard(spark, words)
    leads = roots(x.where("form is not null"))
    out = materialise(x.join(leads, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"), "variants")
    discard(spark, leads)
    discard(spark, x)
    return out


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """The words of all documents and the forms that they vary."""
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))
