"""Text operators on hostile small tables, against plain versions."""

import random
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from . import brute

WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "pu", "ça", "über") for b in ("ra", "to", "shi", "wen", "zul", "n")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(3)
    base = [prose(rng, rng.randint(1, 400)) for _ in range(25)]
    passage, line = prose(rng, 90), prose(rng, 60)
    texts = list(base)
    texts += [base[0], base[0], base[1]]  # copies
    texts += [" ".join(w if rng.random() > 0.01 else "edited" for w in base[i % 5].split()) for i in range(20)]  # near copies
    texts += [f"{prose(rng, 20)} {passage}\n{prose(rng, 30)}" for _ in range(6)]
    texts += [f"{line}\n{prose(rng, 5)}\n{line}\t{line}" for _ in range(4)]
    texts += [passage + passage, "", None, " \n\t ", "one", "a b c d", "x" * 250, "x" * 180, "ß" * 120, prose(rng, 9000)]
    texts += ["same words again " * 60, "same words again " * 40, "\x0b\x0c " + base[3] + " \r"]
    ids = rng.sample(range(-50, 5000), len(texts))
    return dict(zip(ids, texts, strict=True))


@pytest.fixture(scope="module")
def table(spark, docs):
    rows = [(k, t, "en" if k % 3 else None, "src0" if k % 3 else None, 7, "clash", 1) for k, t in docs.items()]
    rows += rows[:3]  # repeated rows
    schema = "doc_id long, text string, lang string, source string, n_chars long, shard string, h int"
    return spark.createDataFrame(rows, schema).repartition(3).cache()


@pytest.fixture(scope="module")
def with_nulls(table):
    return table.unionByName(table.limit(2).withColumn("doc_id", F.lit(None).cast("long")))


def test_lempel_ziv(table, with_nulls, docs):
    from hexloom.llm.lz_dedup import remove_repeated_words

    want = brute.removed_words(docs)
    got = remove_repeated_words(table).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == want and len(got) == table.count()
    rows = remove_repeated_words(with_nulls).collect()
    assert len(rows) == with_nulls.count() and {r.n_removed for r in rows if r.doc_id is None} == {0}
    assert remove_repeated_words(table.limit(0)).count() == 0


def test_suffix_arrays(table, docs, monkeypatch):
    from hexloom.llm.suffix_dedup import remove_repeated_bytes

    want = brute.removed_bytes(docs)
    got = remove_repeated_bytes(table, carry=("shard",)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want and len(got) == table.count()
    assert {r.shard for r in got} == {"clash"}
    assert remove_repeated_bytes(table.limit(0)).count() == 0


def test_hot_grams_and_small_shards_agree(table, docs):
    """Grams that count as hot, and shards that cut a gram's strings anywhere, give what one shard of all gives."""
    from hexloom.llm.lz_dedup import remove_repeated_words
    from hexloom.llm.suffix_dedup import remove_repeated_bytes

    want = brute.removed_words(docs, 12)
    for many in (0, 3):
        got = remove_repeated_words(table, 12, many=many).collect()
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == want
    want = brute.removed_bytes(docs, 40)
    for many, size in ((0, 300), (3, 1500), (2000, 300)):
        got = remove_repeated_bytes(table, 40, many=many, shard_bytes=size).collect()
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want


def test_long_windows_zero_bytes_and_clashing_names(spark):
    from hexloom.llm.lz_dedup import remove_repeated_words
    from hexloom.llm.suffix_dedup import remove_repeated_bytes

    rng = random.Random(12)
    passage = prose(rng, 700)
    texts = {1: passage, 2: f"{prose(rng, 40)} {passage} {prose(rng, 30)}", 3: "\0" * 150 + "tail", 4: "x" * 120 + "\0\0", 5: "x" * 120 + "\0\0", 6: passage[:400] + "\0\0"}
    rows = spark.createDataFrame([(k, t, "kept") for k, t in texts.items()], "doc_id long, text string, n_removed string")
    for window in (50, 300, 600):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeated_words(rows, window).collect()}
        assert got == brute.removed_words(texts, window) and got[2][1] == 700
    for length in (100, 300, 900):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeated_bytes(rows, length).collect()}
        assert got == brute.removed_bytes(texts, length) and got[2][1] >= len(passage.encode())
    with pytest.raises(ValueError):
        remove_repeated_bytes(rows, carry=("n_removed",))
    with pytest.raises(ValueError):
        remove_repeated_words(rows, 0)


def test_factors_of_a_parse():
    from hexloom.llm.lz_dedup import Reference

    block = Reference(3)
    assert list(block.factors(1, b"a b c d e f g".split())) == []
    assert list(block.factors(1, b"a b c d".split())) == []  # of the same document
    assert list(block.factors(2, b"x a b c d y c d e f".split())) == [(1, 5), (6, 10)]
    block.factors(3, b"b c d y c".split())
    assert list(block.factors(4, b"b c d y c d e z".split())) == [(0, 3), (1, 7)]  # over a boundary between two references


def test_suffix_array_and_common_prefixes():
    import os

    from hexloom.llm.suffix_dedup import common_prefixes, first_bytes, suffix_array

    rng = np.random.default_rng(1)
    for n in (1, 2, 9, 200, 1500):
        text = rng.integers(97, 99, n).astype(np.uint8)
        text[n // 2 :] = text[: n - n // 2]
        text[-3:] = 0
        key = first_bytes(text, 116)
        sa, raw = suffix_array(text, key), text.tobytes()
        assert [raw[i:] for i in sa] == sorted(raw[i:] for i in range(n))
        lcp = common_prefixes(text, sa, 100, key)
        assert all(lcp[i] == min(100, len(os.path.commonprefix([raw[sa[i] :], raw[sa[i - 1] :]]))) for i in range(1, n))


def test_jaccard_join(table, with_nulls, docs):
    from hexloom.llm.jaccard_join import similar_documents

    want = brute.jaccard_links(docs)
    got = similar_documents(table).collect()
    assert {r.doc_id: (r.n_links, r.class_id) for r in got} == want and len(got) == table.count()
    assert any(n for n, _ in want.values())
    small = similar_documents(with_nulls, block_rows=2).collect()  # groups cut into many blocks
    assert {r.doc_id: (r.n_links, r.class_id) for r in small if r.doc_id is not None} == want
    assert all(r.kept and r.n_links == 0 for r in small if r.doc_id is None)
    few = similar_documents(with_nulls, band_rows=2).collect()  # bands joined whole
    assert {r.doc_id: (r.n_links, r.class_id) for r in few if r.doc_id is not None} == want
    assert similar_documents(table.limit(0)).count() == 0


def test_jaccard_join_of_repeated_ids(spark):
    """Rows of one id with different texts are one document, whatever the order of the rows."""
    from hexloom.llm.jaccard_join import similar_documents

    rng = random.Random(4)
    a, b = prose(rng, 60), prose(rng, 60)
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (4, a), (5, b)]
    schema = "doc_id long, text string"
    got = {tuple(sorted((r.doc_id, r.n_links, r.class_id) for r in similar_documents(spark.createDataFrame(x, schema).repartition(n)).collect())) for x, n in ((rows, 1), (rows[::-1], 3), (rows, 5))}
    assert len(got) == 1 and sum(k == 1 for _, _, k in next(iter(got))) == 4


def test_pruning_joins_what_plain_comparison_joins():
    from hexloom.llm.jaccard_join import least_matches, spanning

    needed = least_matches(0.8, 1e-7)
    rng = np.random.default_rng(5)
    for trial in range(20):
        base = rng.integers(0, 1 << 32, (6, 96), dtype=np.uint32)
        sig = base[rng.integers(0, 6, 40)].copy()
        noise = rng.random(sig.shape) < rng.uniform(0, 0.6, (40, 1))
        sig[noise] = rng.integers(0, 1 << 32, int(noise.sum()), dtype=np.uint32)
        alike = [(i, j) for i in range(40) for j in range(i) if all((sig[i, :n] == sig[j, :n]).sum() >= m for n, m in needed)]
        i, j = spanning(sig, needed)
        assert brute.linked(range(40), alike).keys() == set(range(40))
        want = {k: v[1] for k, v in brute.linked(range(40), alike).items()}
        assert {k: v[1] for k, v in brute.linked(range(40), zip(i.tolist(), j.tolist(), strict=True)).items()} == want


def test_pruning_keeps_what_is_likely():
    from hexloom.llm.jaccard_join import least_matches

    needed = least_matches(0.8, 1e-7)
    assert all(0 < m < 0.8 * n for n, m in needed) and [n for n, _ in needed] == [16, 32, 48, 64, 80, 96]


def test_containment(spark, table, docs):
    from hexloom.llm.decontamination import contained_items

    items = {1: "ka ra lo to mi", 2: " ".join(docs[sorted(docs)[0]].split()[:30]) if docs[sorted(docs)[0]] else "q", 3: None, 4: "", 5: "ONE", 6: "a b, c D"}
    longest = max((t for t in docs.values() if t), key=len).split()
    items[7] = " ".join(longest[4000:4060])
    items[8] = " ".join(w if i != 30 else "changed" for i, w in enumerate(longest[5000:5060]))
    items[9] = " ".join(w if i % 9 else "changed" for i, w in enumerate(longest[5000:5060]))
    given = spark.createDataFrame(list(items.items()) + [(7, items[7])], "item_id long, text string")
    want = {}
    for d, t in docs.items():
        for i, x in items.items():
            a, width = brute.shingle_set(x), min(5, len((x or "").split()))
            b = brute.shingle_set(t, width) if width else set()
            if a and len(a & b) >= 0.8 * len(a):
                want[d, i] = len(a & b) / len(a)
    for block in (1_000_000, 20):
        found = contained_items(table, given, block=block).collect()
        got = [r for k, r in enumerate(found) if r not in found[:k]]
        copies = {r.doc_id: r.n for r in table.groupBy("doc_id").count().withColumnRenamed("count", "n").collect()}
        assert all(found.count(r) == copies[r.doc_id] for r in got)  # a row for each row that holds the item, whatever is given twice
        assert {(r.doc_id, r.item_id): r.containment for r in got} == want
    assert {i for _, i in want} >= {5, 6, 7, 8} and 9 not in {i for _, i in want}
    assert contained_items(table, given.limit(0)).count() == 0 and contained_items(table.limit(0), given).count() == 0


def test_packing(table, docs):
    from hexloom.llm.packing import pack, token_ids

    rows = pack(table.dropDuplicates(["doc_id"]), 64).collect()
    pieces = {(r.doc_id, r.piece): r for r in rows}
    for d, t in docs.items():
        ids = [*token_ids(t or ""), 0]
        mine = [pieces[d, k] for k in range(sum(1 for x in pieces if x[0] == d))]
        assert [p.start for p in mine] == list(np.cumsum([0, *[p.length for p in mine]])[:-1]) and sum(p.length for p in mine) == len(ids)
        assert all(p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) for p in mine)
        assert len(mine) == -(-len(ids) // 64) and all(p.length == 64 for p in mine[1:])
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in by_sequence.values():
        x.sort()
        assert [o for o, _ in x] == list(np.cumsum([0, *[n for _, n in x]])[:-1]) and sum(n for _, n in x) <= 64
    assert len(by_sequence) <= -(-sum(r.length for r in rows) // 64) + 2
    assert pack(table).count() >= table.count() and pack(table.limit(0)).count() == 0


def test_plans_pack_everything_well():
    from hexloom.llm.packing import best_fit, packing_plan, reduce_dominated

    rng = random.Random(5)
    for trial in range(60):
        cap = rng.choice([10, 50, 100])
        count = {s: rng.randint(1, 30) for s in rng.sample(range(1, cap + 1), rng.randint(1, min(cap, 12)))}
        rows = packing_plan(dict(count), cap)
        got, load = {}, {}
        for s, first, n, bin_no, copies, base in rows:
            assert first == got.get(s, 0)
            got[s] = first + n
            for k in range(n):
                load.setdefault(bin_no + k // copies, []).append((base + k % copies * s, s))
        assert got == count
        for x in load.values():
            x.sort()
            assert [o for o, _ in x] == list(np.cumsum([0, *[n for _, n in x]])[:-1]) and sum(n for _, n in x) <= cap
        plain = sum(n for n, _ in best_fit(dict(count), cap))
        assert len(load) <= plain
        left = dict(count)
        fixed = reduce_dominated(left, cap)
        assert all(left[s] + sum(b * dict(i).get(s, 0) for b, i in fixed) == n for s, n in count.items())


def test_fast_ids_are_the_tokenizers_ids():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    from hexloom.llm.packing import token_ids

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rng = random.Random(2)
    odd = ["", " ", "\n\n  x", "don't  stop\t\r\n", "<|endoftext|>", "a<|endoftext|> b", "日本語 テキスト", "🙂🙂 é́", "x" * 3000, "     ", "1234567 ١٢٣", "\x00\x01"]
    odd += ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(160, 1000), rng.randint(0x3000, 0x9000), 32, 10])) for _ in range(60)) for _ in range(200)]
    for x in odd:
        assert list(token_ids(x)) == t.encode(x, add_special_tokens=False).ids, x


def test_ids_of_all_documents_are_the_tokenizers_ids():
    import public_tokenizers as P
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    from hexloom.llm.packing import token_ids

    path = Path("/root/testdata/sf0.01/documents.parquet")
    if not path.exists():
        pytest.skip("no test tables")
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for text in pq.read_table(path, columns=["text"])["text"].to_pylist():
        assert list(token_ids(text or "")) == t.encode(text or "", add_special_tokens=False).ids


def fewest_bins(sizes, cap):
    """The least number of bins, by search over which bin each size goes to, largest first."""
    sizes = sorted(sizes, reverse=True)
    best = [len(sizes)]

    def put(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(rooms)
            return
        for room in set(rooms):
            if room >= sizes[k]:
                rest = list(rooms)
                rest.remove(room)
                put(k + 1, [*rest, room - sizes[k]])
        put(k + 1, [*rooms, cap - sizes[k]])

    put(0, [])
    return best[0]


def test_plans_against_the_optimum_and_reduction_against_it():
    """What is fixed by dominance never costs a bin, and plans are within one bin of the least on small instances."""
    from hexloom.llm.packing import packing_plan, reduce_dominated

    rng = random.Random(11)
    for trial in range(120):
        cap = rng.choice([12, 20, 31])
        sizes = [rng.randint(1, cap) for _ in range(rng.randint(1, 10))]
        count = {s: sizes.count(s) for s in sizes}
        least = fewest_bins(sizes, cap)
        left = dict(count)
        fixed = reduce_dominated(left, cap)
        assert sum(b for b, _ in fixed) + fewest_bins([s for s, n in left.items() for _ in range(n)], cap) == least
        rows = packing_plan(dict(count), cap)
        used = len({bin_no + k // copies for _, _, n, bin_no, copies, _ in rows for k in range(n)})
        assert least <= used <= least + 1


def lower_bound(lengths, cap):
    """Martello and Toth's second bound: for a size k, large items stand alone, middle ones fill half, small ones fill up."""
    best = 0
    for k in {0, *[n for n in lengths if n <= cap // 2]}:
        large = [n for n in lengths if n > cap - k]
        middle = [n for n in lengths if cap // 2 < n <= cap - k]
        small = sum(n for n in lengths if k <= n <= cap // 2)
        spare = len(middle) * cap - sum(middle)
        best = max(best, len(large) + len(middle) + max(0, -(-(small - spare) // cap)))
    return best


def test_real_lengths_reach_the_bound(spark):
    from hexloom.llm.packing import pack

    path = Path("/root/testdata/sf0.001/documents.parquet")
    if not path.exists():
        pytest.skip("no test tables")
    rows = pack(spark.read.parquet(str(path))).collect()
    assert len({r.sequence_id for r in rows}) <= lower_bound([r.length for r in rows], 2048) + 1


def test_shard_query_column_by_column(spark, tmp_path):
    """The registered query against a plain version of the contract."""
    from hexloom.llm.sharding import op4_stratified_interleave

    rng = random.Random(8)
    texts = [None, "", "é" * 5, *[prose(rng, rng.randint(1, 30)) for _ in range(300)]]
    rows = [(k * 3 - 20, t, None if k % 50 == 7 else "hot" if k % 3 else f"s{k % 5}") for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op4_stratified_interleave(spark, str(tmp_path)).collect()}
    assert got.keys() == {r[0] for r in rows}
    by_shard = {}
    for k, t, _ in rows:
        raw, r = (t or "").encode(), got[k]
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
        by_shard.setdefault(r.shard, []).append(r.slot)
    n = [len(by_shard.get(k, [])) for k in range(40)]
    assert set(by_shard) <= set(range(40)) and max(n) - min(n) <= 1 and all(sorted(x) == list(range(len(x))) for x in by_shard.values())
    seeded = dict(spark.createDataFrame([(r[0],) for r in rows], "id long").select("id", F.xxhash64(F.lit(42), "id")).collect())
    by_fraction = []
    for source in {r[2] for r in rows}:
        mine = sorted((seeded[k], k) for k, _, s in rows if s == source)
        by_fraction += [((r + 0.5) / len(mine), h, k) for r, (h, k) in enumerate(mine)]
    for at, (_, _, k) in enumerate(sorted(by_fraction)):
        shard = at * 40 // len(rows)
        assert (got[k].shard, got[k].slot) == (shard, at - -(-shard * len(rows) // 40))


def test_shards(spark, table):
    from hexloom.llm.sharding import interleave, write_shards

    got = interleave(table, 5).collect()
    sizes = {}
    for r in got:
        sizes.setdefault(r.shard, []).append(r.slot)
    assert len(got) == table.count() and all(sorted(x) == list(range(len(x))) for x in sizes.values())
    assert max(map(len, sizes.values())) - min(map(len, sizes.values())) <= 1
    for source in (None, "src0"):
        n = [sum(1 for r in got if r.shard == k and r.source == source) for k in range(5)]
        assert max(n) - min(n) <= 2
    again = {(r.doc_id, r.shard) for r in interleave(table.repartition(7), 5).collect()}
    assert again == {(r.doc_id, r.shard) for r in got}
    assert interleave(table.limit(0), 5).count() == 0 and interleave(table.limit(2), 5).count() == 2


def test_written_shards(spark, table, tmp_path):
    from hexloom.llm.sharding import write_shards

    write_shards(table.drop("shard"), str(tmp_path / "s"), 3)
    assert spark.read.parquet(str(tmp_path / "s")).groupBy("shard").count().count() == 3


def test_full_licence_texts(spark):
    from hexloom.llm.licences import full_texts, known_digests, license_matches

    ids = {"Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0-only", "GPL-3.0-only", "LGPL-2.1-only", "LGPL-3.0-only", "MPL-2.0", "Unlicense", "BSL-1.0", "CC0-1.0"}
    texts = dict(reversed(full_texts()))
    assert ids <= set(texts)
    order = sorted(texts)
    rows = [(k, "\n\n  " + " ".join(texts[i].upper().split(" ")) + "\n") for k, i in enumerate(order)]
    rows += [(100, texts["Apache-2.0"].split("APPENDIX")[0]), (101, texts["MPL-2.0"] + " more")]
    got = license_matches(spark.createDataFrame(rows, "doc_id long, text string"), known_digests(spark)).where("scope = 'document'").collect()
    assert {(r.doc_id, r.license_id) for r in got} == {*enumerate(order), (100, "Apache-2.0")}


def test_licences_however_they_are_wrapped(spark):
    """Paragraphs filled to any width from 60 to 100 keep their digest, also where a line then begins with "copyright"."""
    import textwrap

    from hexloom.llm.licences import KNOWN, full_texts, known_digests, license_matches

    texts = {"MIT": KNOWN[0][1], "ISC": KNOWN[1][1], **{k: v for k, v in full_texts() if k in ("BSD-3-Clause", "MPL-2.0")}}
    rows = []
    for name, text in texts.items():
        for width in range(60, 101):
            body = "\n\n".join("\n".join(textwrap.wrap(p, width)) for p in text.split("\n\n"))
            rows.append((len(rows), name, f"Copyright (c) 2021 A. Body\nAll rights reserved.\n\n{body}"))
    got = license_matches(spark.createDataFrame(rows, "doc_id long, name string, text string"), known_digests(spark)).where("scope = 'document'").collect()
    assert {(r.doc_id, r.license_id) for r in got} == {(k, n) for k, n, _ in rows}
    table = spark.createDataFrame([(1, "Released under the MIT License.", "mine", 3)], "doc_id long, text string, digest string, line_no int")
    assert {(r.scope, r.line_no) for r in license_matches(table, known_digests(spark)).collect()} == {("document", -1), ("line", 0)}
    assert license_matches(table.limit(0), known_digests(spark)).count() == 0


def test_licence_sql_knows_the_same_texts(spark):
    import duckdb
    import pandas as pd

    from hexloom.llm.licences import KNOWN, full_texts, known_digests, license_matches, sql

    texts = [t for _, t in KNOWN + full_texts()]
    texts = texts + [t.upper().replace(",", " ;") + "\n" for t in texts] + [texts[0] + " more", "", " \n© 2019 A\n", texts[4] + "\nand\n" + texts[6]]
    docs = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})
    c = duckdb.connect()
    c.register("documents", docs)
    columns = ["doc_id", "scope", "line_no", "license_id", "digest"]
    want = c.execute(sql()).df()[columns]
    got = license_matches(spark.createDataFrame(docs, "doc_id long, text string"), known_digests(spark)).toPandas()[columns]
    assert sorted(got.itertuples(index=False, name=None)) == sorted(want.itertuples(index=False, name=None))
    assert set(range(2 * len(KNOWN + full_texts()))) <= set(got[got.scope == "document"].doc_id)


def test_licences(spark):
    from hexloom.llm.licences import KNOWN, known_digests, license_matches

    mit = KNOWN[0][1]
    rows = [
        (1, "Copyright (c) 2020 Someone\n" + mit.upper().replace(",", " ;")),
        (2, "text\nRELEASED  under the mit licence\nmore"),
        (3, "text released under the MIT License."),
        (4, None),
        (5, ""),
        (6, "© 2019 A\n\n\n"),
        (7, mit[:-10]),
        (7, "Licensed under CC-BY-NC 4.0"),
        (None, "Licensed under CC BY 4.0."),
    ]
    got = license_matches(spark.createDataFrame(rows, "doc_id long, text string"), known_digests(spark)).collect()
    assert {(r.doc_id, r.scope, r.line_no, r.license_id) for r in got} == {
        (1, "document", -1, "MIT"), (2, "line", 1, "MIT"), (7, "document", -1, "CC-BY-NC-4.0"), (7, "line", 0, "CC-BY-NC-4.0"), (None, "document", -1, "CC-BY-4.0"), (None, "line", 0, "CC-BY-4.0"),
    }


def test_the_language_model_is_fitted_in_a_task(spark, monkeypatch):
    from hexloom.llm.language import ChainCRF, train

    def here(*_):
        raise AssertionError("fitted by the driver")

    monkeypatch.setattr(ChainCRF, "fit", here)
    rows = [(i, ("the cat and the dog" if i % 2 else "le chat et le chien") * 3, "en" if i % 2 else "fr") for i in range(60)]
    model = train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.labels == ["en", "fr"] and model.weights.any() and model.moves.shape == (2, 2)


def test_language(spark, table):
    from hexloom.llm.language import held_out, identify, train

    path = "/root/testdata/sf0.001/documents.parquet"
    if not Path(path).exists():
        pytest.skip("no test tables")
    real = spark.read.parquet(path)
    model = train(real)
    found = identify(real, model).withColumn("held_out", held_out("doc_id"))
    right = found.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.95
    odd = identify(table.withColumn("score", F.lit("clash")), model).collect()
    assert len(odd) == table.count() and all(0 <= r.score <= 1 for r in odd)
    assert all(r.lang_pred == "und" and r.score == 0 for r in odd if not (r.text or "").strip())
    marks = identify(spark.createDataFrame([(1, "–… 12 ؟!"), (2, "123")], "doc_id long, text string"), model)
    assert {r.lang_pred for r in marks.collect()} == {"und"}
    nothing = identify(table, train(table.limit(0)))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}
    assert all(sum(y.n_words for y in r.lang_spans) == 0 for r in marks.collect())
    both = spark.createDataFrame([(1, " ".join([*real.where("lang = 'en'").first().text.split()[:60], *real.where("lang = 'de'").first().text.split()[:60]]))], "doc_id long, text string")
    one = identify(both, model).first()
    assert one.score < 0.8 and sum(y.n_words for y in one.lang_spans if y.lang == "en") in range(54, 67) and sum(y.n_words for y in one.lang_spans if y.lang == "de") in range(54, 67)
    clash = identify(both.withColumn("score", F.lit("mine")), model, made=("l", "p", "w")).first()
    assert clash.score == "mine" and clash.w == one.lang_spans


def crf_by_paths(model, words, score):
    """All label paths of one text: their chances, by enumeration."""
    from itertools import product

    paths = list(product(range(len(model.labels)), repeat=words))
    weight = np.array([sum(score[t, y] for t, y in enumerate(p)) + sum(model.moves[a, b] for a, b in zip(p, p[1:], strict=False)) for p in paths])
    return paths, weight - np.log(np.exp(weight).sum())


def test_forward_backward_and_gradient_by_enumeration(monkeypatch):
    from hexloom.llm import language
    from hexloom.llm.language import ChainCRF, Text

    monkeypatch.setattr(language, "CHUNK", 3)
    rng = np.random.default_rng(3)
    model = ChainCRF(["a", "b", "c"])
    model.moves = rng.normal(size=(3, 3))
    sizes = [7, 0, 1, 3, 6]
    at = np.concatenate([[0], np.cumsum(sizes)])
    kinds = rng.integers(0, 5, sum(sizes))
    score = rng.normal(size=(5, 3))
    x = Text(np.arange(5), np.arange(5), 5, kinds, at)
    model.weights[:5] = score
    score = model.weights[:5].astype(float)  # as rounded
    c = model.marginals(x)
    got = np.empty((sum(sizes), 3))
    got[c.grid[c.live]] = c.p[c.live]
    label = rng.integers(0, 3, sum(sizes))

    def likelihood():
        total = 0.0
        for a, b in zip(at[:-1], at[1:], strict=True):
            if b > a:
                paths, chance = crf_by_paths(model, b - a, score[kinds[a:b]])
                total += chance[paths.index(tuple(label[a:b].tolist()))]
                yield a, b, paths, chance
        yield total / sum(sizes)

    *texts, before = likelihood()
    for a, b, paths, chance in texts:
        for t in range(b - a):
            for y in range(3):
                assert abs(got[a + t, y] - sum(np.exp(w) for p, w in zip(paths, chance, strict=True) if p[t] == y)) < 1e-9
    by_kind, by_move = model.gradient(x, label)
    for i, j in ((0, 1), (2, 2), (1, 0)):
        model.moves[i, j] += 1e-5
        assert abs((list(likelihood())[-1] - before) / 1e-5 - by_move[i, j]) < 1e-4
        model.moves[i, j] -= 1e-5
    for i, j in ((0, 0), (3, 1), (4, 2)):
        score[i, j] += 1e-5
        assert abs((list(likelihood())[-1] - before) / 1e-5 - by_kind[i, j]) < 1e-4
        score[i, j] -= 1e-5


@pytest.mark.parametrize("kind", ["bytes", "words"])
def test_hot_passages_take_bounded_memory(monkeypatch, kind):
    """A passage that all documents of a batch share sends each stretch once, and its places are never all held as texts."""
    import tracemalloc

    import pyarrow as pa

    from hexloom.llm import repeats

    monkeypatch.setattr(repeats, "HOT_ROWS", 50_000)
    s = repeats.Stretch(100, 24, False) if kind == "bytes" else repeats.Stretch(50, 13, True)
    rng = random.Random(6)
    passage = prose(rng, 3500)[:12_000]
    texts = pa.array([f"{passage} {k}" for k in range(120)])
    owners = repeats.owners(repeats.Units.read(texts.slice(0, 1), s), s)
    marks = pa.array([sorted({h | 1 for h in owners["h"].tolist()})] * len(texts), pa.list_(pa.int64()))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(texts))[::-1].copy()), texts, marks], ["doc_id", "hx_text", "hx_marks"])
    n_sent = n_text = 0
    tracemalloc.start()
    for out in repeats._contexts(s, 0, 1, 2)([batch]):
        n_sent += out.num_rows
        n_text += out.num_rows - out.column(4).null_count
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    distinct = len({passage[k : k + 100] for k in range(len(passage) - 99)}) if kind == "bytes" else len({tuple(passage.split()[k : k + 50]) for k in range(len(passage.split()) - 49)})
    # documents come in falling order, so each part of the batch has an earlier one to send
    parts = 1 + 120 * distinct // 50_000
    assert distinct <= n_text <= (parts + 2) * (distinct + 300) and n_sent < n_text + 2000
    assert peak < 100 << 20  # tables of powers among it; the text is 1.4 MB, and cut out its stretches would be 140 times that


def test_hot_passages_are_compared_in_parts():
    """Of documents in order, each stretch of a shared passage is sent once, and a quarter of a million are held at a time."""
    import tracemalloc

    import pyarrow as pa

    from hexloom.llm import repeats

    s, passage = repeats.Stretch(100, 24, False), prose(random.Random(8), 3500)[:12_000]
    texts = pa.array([f"{passage} {k} " + "-" * (k % 7) for k in range(400)])
    owners = repeats.owners(repeats.Units.read(texts.slice(0, 1), s), s)
    marks = pa.array([sorted({h | 1 for h in owners["h"].tolist()})] * len(texts), pa.list_(pa.int64()))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(texts))), texts, marks], ["doc_id", "hx_text", "hx_marks"])
    sent, spans = set(), {}
    tracemalloc.start()
    for out in repeats._contexts(s, 0, 1, 2)([batch]):
        for doc, lo, hi, text in zip(*(out.column(c).to_pylist() for c in (1, 2, 3, 4)), strict=True):
            if text is None:
                spans.setdefault(doc, []).append((lo, hi))
            elif (doc, lo) not in sent:
                sent.add((doc, lo))
            else:
                raise AssertionError(f"{doc}, {lo} was sent twice")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {lo for doc, lo in sent if doc == 0} >= set(range(len(passage) - 99)) and len(sent) < len(passage) + 400 * 110
    assert all(max(hi for _, hi in spans[k]) >= len(passage) and min(lo for lo, _ in spans[k]) == 0 for k in range(1, 400))
    assert peak < 140 << 20


@pytest.mark.parametrize("kind", ["bytes", "words"])
@pytest.mark.parametrize("hot", [0, 1])
def test_matchers_get_no_null_lists(kind, hot):
    """Spark's Arrow writer walks over the null lists at the end of a batch again for each row: 10,000 of them are 50 million steps."""
    import pyarrow as pa

    from hexloom.llm import repeats

    s, passage = (repeats.Stretch(100, 20, False) if kind == "bytes" else repeats.Stretch(50, 13, True)), prose(random.Random(4), 120)
    texts = pa.array([f"{passage} {passage}", passage, None, "short"])
    owners = repeats.owners(repeats.Units.read(texts, s), s)
    marks = pa.array([sorted({h | hot for h in owners["h"].tolist()})] * len(texts), pa.list_(pa.int64()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), texts, marks], ["doc_id", "hx_text", "hx_marks"])
    found = list(repeats._contexts(s, 0, 1, 2)([batch]))
    assert sum(x.num_rows for x in found) > 2
    assert all(c.null_count == 0 for x in found for c in x.columns if pa.types.is_list(c.type))
    assert kind == "bytes" or any(len(v) for x in found for v in x.column(5).to_pylist())  # a document that repeats itself


def test_texts_alone_of_their_gram_are_in_no_suffix_array(monkeypatch):
    import pyarrow as pa

    from hexloom.llm import suffix_dedup
    from hexloom.llm.repeats import Stretch

    sizes, made = [], suffix_dedup.suffix_array
    monkeypatch.setattr(suffix_dedup, "suffix_array", lambda text, key: sizes.append(len(text)) or made(text, key))
    rng = random.Random(3)
    letters = lambda n: "".join(rng.choices("abcdefghij", k=n)).encode()
    rows = []
    for key in range(40):
        text = letters(140)
        rows += [(key, 2, 500 * key, text), (key, 7, 500 * key, text), (key, 9, 500 * key + 9, text[:110] if key % 4 == 0 else text)]
    columns = list(zip(*rows, strict=True))
    batch = pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2], pa.int32()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.binary())], ["key", "doc", "lo", "hi", "text"])
    spans = lambda size: sorted(r for x in suffix_dedup._shards(Stretch(100, 20, False), size)([batch]) for r in zip(*(c.to_pylist() for c in x.columns), strict=True))
    want = sorted(span for key in range(40) for span in ((7, 500 * key, 500 * key + 140), (9, 500 * key + 9, 500 * key + (119 if key % 4 == 0 else 149))))
    assert spans(1 << 20) == want
    # ten grams of two texts, and the last gram, which may go on in the next shard
    assert sizes == [10 * 250 + 140]
    for size in (200, 1000):  # shards that end within a gram
        assert spans(size) == want


def test_stretches_are_compared_whole():
    from hexloom.llm.repeats import alike

    text = np.frombuffer(b"abcdefghijklmnop abcdefghijklmnop abcdefghijklmnoX abc abd", np.uint8)
    a, b = np.array([0, 0, 0, 51, 51, 0, 0]), np.array([17, 34, 34, 55, 0, 17, 17])
    size = np.array([16, 16, 15, 3, 3, 5, 0])
    assert alike(text, a, size, b, size).tolist() == [True, False, True, False, True, True, True]
    assert alike(text, a, size, b, size + 1).tolist() == [False] * 7
