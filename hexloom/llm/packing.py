"""Best-fit packing of tokenised documents, after dominance reduction of the instance."""

from __future__ import annotations

import base64
import json
import math
import zlib
from array import array
from bisect import bisect_left, bisect_right, insort

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, materialise

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_loaded: dict[str, object] = {}


def _encoder(name: str):
    """The vocabulary as ranks; it gives the ids of the tokenizers file of the same name several times faster."""
    if name not in _loaded:
        import public_tokenizers as P
        import tiktoken

        with open(P.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _loaded[name] = tiktoken.Encoding("packing", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[name]


def _tokenizer(name: str):
    if (name, "json") not in _loaded:
        import public_tokenizers as P
        from tokenizers import Tokenizer

        _loaded[name, "json"] = Tokenizer.from_file(P.path(f"{name}.json"))
    return _loaded[name, "json"]


def added_tokens(name: str = "byte_bpe_50k") -> tuple[str, ...]:
    """Strings that the tokenizers file takes out of a text before its vocabulary is used."""
    if (name, "added") not in _loaded:
        import public_tokenizers as P

        with open(P.path(f"{name}.json"), encoding="utf-8") as file:
            _loaded[name, "added"] = tuple(t["content"] for t in json.load(file)["added_tokens"])
    return _loaded[name, "added"]


def token_ids(text: str, name: str = "byte_bpe_50k", added: tuple[str, ...] | None = None) -> array:
    """The ids that the tokenizers file gives; a text that holds the string of an added token goes to tokenizers itself.

    Tasks are given the added tokens, so that they load the file for such a text only.
    """
    if any(x in text for x in (added_tokens(name) if added is None else added)):
        return array("I", _tokenizer(name).encode(text, add_special_tokens=False).ids)
    return array("I", _encoder(name).encode_ordinary(text))


def _cut(capacity: int, name: str, added: tuple[str, ...]):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = {c.split()[0]: [] for c in PIECES.split(", ")}
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = token_ids(text.as_py() or "", name, added)
                ids.append(0)
                start, piece, raw = 0, 0, memoryview(ids.tobytes())
                while start < len(ids):
                    length = (len(ids) - start) % capacity or capacity
                    for k, v in zip(out, (doc, piece, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)])), strict=True):
                        out[k].append(v)
                    start, piece = start + length, piece + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, pa.int32() if k == "piece" else pa.int64()) for k, v in out.items()], list(out)
            )

    return run


def reduce_dominated(count: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Fix sets of sizes that dominate every other way to fill a bin that holds their largest size; count shrinks.

    A set dominates another if the other's items can be shared out among its own so that each share is no larger than
    the item it stands for; some best packing then holds the dominating set. With ``room`` left beside a size s:
    nothing fits: {s}. One size fills the room, or no two items fit, or the largest that fits is no smaller than the
    best pair: {s, t}. At most two fit and the best pair has both the largest first item and the largest second item
    of all pairs: that pair. Returns (bins, [(size, copies)]).
    """
    fixed = []
    sizes = sorted(s for s, n in count.items() if n)

    def take(bins: int, *items: int) -> None:
        used = {s: items.count(s) for s in dict.fromkeys(items)}
        for s, k in used.items():
            count[s] -= bins * k
            if not count[s]:
                sizes.remove(s)
        fixed.append((bins, list(used.items())))

    def pairs(room: int, have) -> tuple[int, int, int]:
        """The fullest pair (a, b), a >= b, of sizes that fit, and the largest second item of any."""
        best, second = (0, 0), 0
        low, high = 0, bisect_right(sizes, room) - 1
        while low <= high:
            small, large = sizes[low], sizes[high]
            if small + large > room or (low == high and have(small) < 2) or not have(large):
                high -= 1
            elif not have(small):
                low += 1
            else:
                second = max(second, small)
                best = max(best, (large, small), key=sum)
                low += 1
        return *best, second

    changed = True
    while changed:
        changed = False
        for s in sizes[::-1]:
            while count[s]:
                room = capacity - s
                have = lambda x, s=s: count[x] - (x == s)
                at = bisect_right(sizes, room) - 1
                while at >= 0 and not have(sizes[at]):
                    at -= 1
                fit = sizes[at] if at >= 0 else 0
                few = [x for x in sizes[:4] for _ in range(min(3, have(x)))][:3]
                if not fit:
                    take(count[s], s)
                elif fit == room or len(few) < 2 or few[0] + few[1] > room:
                    take(count[s] // 2 if fit == s else min(count[s], count[fit]), s, fit)
                elif len(few) < 3 or sum(few) > room:
                    a, b, second = pairs(room, have)
                    if fit >= a + b:
                        take(count[s] // 2 if fit == s else min(count[s], count[fit]), s, fit)
                    elif fit == a and second <= b:
                        items = (s, a, b)
                        take(min(count[x] // items.count(x) for x in items), *items)
                    else:
                        break
                else:
                    break
                changed = True
    return fixed


def best_fit(count: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best-fit decreasing on counts: bins filled alike are handled together. Returns (bins, [(size, copies)])."""
    rooms: list[int] = []
    open_bins: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}

    def put(room: int, bins: int, items: list[tuple[int, int]]) -> None:
        if bins:
            if room not in open_bins:
                open_bins[room] = []
                insort(rooms, room)
            open_bins[room].append((bins, items))

    for s in sorted((x for x, n in count.items() if n), reverse=True):
        left = count[s]
        for room in rooms[bisect_left(rooms, s) :]:
            each = room // s
            while left and open_bins[room]:
                bins, items = open_bins[room].pop()
                whole = min(bins, left // each)
                put(room - each * s, whole, [*items, (s, each)])
                left -= whole * each
                if whole < bins and 0 < left < each:
                    put(room - left * s, 1, [*items, (s, left)])
                    whole, left = whole + 1, 0
                put(room, bins - whole, items)
                if not left:
                    break
            if not open_bins[room]:
                del open_bins[room]
                rooms.remove(room)
            if not left:
                break
        each = capacity // s
        put(capacity - each * s, left // each, [(s, each)])
        put(capacity - left % each * s, int(left % each > 0), [(s, left % each)])
    return [x for bins in open_bins.values() for x in bins]


def packing_plan(count: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first_rank, n, first_bin, copies, base): the items of that length and those ranks go, ``copies`` to
    a bin, to the bins from first_bin on, from place ``base``.

    It needs the number of items of each length only, so it has at most a few thousand groups of bins whatever the
    corpus is.
    """
    left = {s: n for s, n in count.items() if n}
    rank = dict.fromkeys(left, 0)
    groups = reduce_dominated(left, capacity)
    groups += best_fit(left, capacity)
    rows, bin_no = [], 0
    for bins, items in groups:
        base = 0
        for s, copies in items:
            rows.append((s, rank[s], bins * copies, bin_no, copies, base))
            rank[s] += bins * copies
            base += s * copies
        bin_no += bins
    return rows


def pack(docs: DataFrame, capacity: int = 2048, tokenizer: str = "byte_bpe_50k", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece of each document: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document's ids are its tokens and one id 0; only more than ``capacity`` of them are cut, the first piece taking
    what does not fill a sequence. Pieces are counted by length; from those counts (at most ``capacity`` rows) the
    driver makes the plan, and each piece finds its place by its rank among the pieces of its length. Ranks are taken in
    hashed slices, so a length that a third of all pieces have is spread over many tasks.

    A null text is an empty one (one id 0); repeated rows are packed each; ties of length are broken by a hash of the
    id; other columns are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = materialise(map_arrow(texts, _cut(capacity, tokenizer, added_tokens(tokenizer)), PIECES), "pieces")
    lengths = {int(r[0]): r[1] for r in pieces.groupBy("length").count().collect()}
    rows = packing_plan(lengths, capacity)
    plan = spark.createDataFrame(rows, "length long, first_rank long, n long, first_bin long, copies long, base long")

    slices = 1 + int(math.sqrt(sum(lengths.values()) / 64))
    x = pieces.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(slices)))
    counts = x.groupBy("length", "slice").agg(F.count(F.lit(1)).alias("of_slice"))
    before = counts.select("length", "slice", (F.sum("of_slice").over(Window.partitionBy("length").orderBy("slice")) - F.col("of_slice")).alias("before"))
    within = Window.partitionBy("length", "slice").orderBy("doc_id", "piece")
    ranked = x.withColumn("rank", F.row_number().over(within)).join(before, ["length", "slice"]).withColumn("rank", F.col("before") + F.col("rank") - 1)
    # the plan's rows are bounded by the square of capacity, and by far less in practice: it can be broadcast
    placed = ranked.join(F.broadcast(plan.withColumnRenamed("length", "of")), F.expr("length = of and rank >= first_rank and rank < first_rank + n"))
    return placed.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        F.expr("first_bin + (rank - first_rank) div copies").alias("sequence_id"),
        F.expr("base + (rank - first_rank) % copies * length").alias("offset"),
    )


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
