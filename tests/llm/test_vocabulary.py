"""Token counts, spelling variants and ranked search against plain versions."""

import functools
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F


def table(spark, rows, extra=True):
    """Documents, with columns whose names clash with those of the operators."""
    x = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    return x.withColumns({"word": F.lit("x"), "n": F.lit(7), "list": F.lit(1), "score": F.lit(None), "h": F.lit(0)}) if extra else x


# token counts


@functools.cache
def tokenizer():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("word_bpe_49k.json"))


def whole(text):
    return len(tokenizer().encode(text, add_special_tokens=False).ids)


def test_token_counts(spark):
    from hexloom.llm.tokens import LONG, token_counts

    rng = random.Random(3)
    long_run = "".join(rng.choice("abcXYZ019.,'s!-é、。字") for _ in range(3 * LONG))
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, "Two  words"), (4, "Two  words"), (None, "it's"), (5, "a<|startoftext|>b<|endoftext|> <|startof text|>"), (6, long_run),
        (7, "x" * 40_000), (8, "字" * 20_000 + "。" + "か" * 9), (9, "é ́a b c\u0085d"), (10, "İSTANBUL ΣΑΣ Straße ﬁ"), (11, ("word " * 400_000)), (12, "don't'll 12ab34"),
    ]
    found = token_counts(table(spark, rows)).collect()
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in found), key=str)
    assert got == sorted(((d, len((t or "").encode()), n := whole(t or ""), n > 2048) for d, t in rows), key=str)
    assert token_counts(table(spark, rows).limit(0)).count() == 0
    small = token_counts(table(spark, rows), batch_bytes=64).collect()
    assert sorted(map(str, small)) == sorted(map(str, found))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "'", "s", "7", "<|startoftext|>", "<|endoftext|>", "|", "<", ".", "、", "字", "é", "é", "　", "-", "ﬁ"]), max_size=60).map("".join))
def test_cuts_are_safe(text):
    from hexloom.llm.tokens import safe_cuts

    parts = safe_cuts(text, ("<|startoftext|>", "<|endoftext|>"), long=3)
    assert "".join(parts) == text and sum(map(whole, parts)) == whole(text)


# spelling variants


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(rows, ratio=5):
    count = {}
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{d}:{run}".encode())
            if d is not None and h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] = count.get(run, 0) + 1
    n = {w: c for w, c in count.items() if len(w) >= 6 and c >= 5}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


@pytest.mark.parametrize("list_words", [16_384, 24])
def test_spelling_variants(spark, list_words):
    from hexloom.llm.spelling import spelling_variants

    rng = random.Random(5)
    # a prefix that most words share, ends that most share, chains of forms, equal counts, letters beyond ASCII
    words = ["prefixed" + "".join(rng.choice("ab") for _ in range(rng.randint(0, 5))) for _ in range(150)]
    words += ["".join(rng.choice("xyé") for _ in range(rng.randint(1, 3))) + "ending" for _ in range(80)] + ["Übers" + c for c in "äbcd"]
    words += ["chainaa"] * 260 + ["chainab"] * 30 + ["chainbb"] * 3 + ["q" * 3000] * 5 + ["q" * 2999 + "r"] * 5 + ["short", "sevenÿÿ"] * 4
    texts = [(k, " ".join(rng.choice((w, w.capitalize(), w.upper() if w.isascii() else w)) for w in rng.choices(words, k=40))) for k in range(250)]
    texts += [(3, texts[3][1])] * 2 + [(None, texts[4][1]), (900, None), (901, ""), (902, "12 . '"), (-5, texts[9][1])] + [(1000 + k, "q" * 3000 + "0" + "q" * 2999 + "R") for k in range(6)]
    want = variants(texts)
    found = spelling_variants(table(spark, texts), list_words=list_words).collect()
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in found}
    assert len(found) == len(got) and got == want
    assert sum(f is not None for f, *_ in want.values()) > 3 and any(f and f != r for f, r, *_ in want.values())
    assert spelling_variants(table(spark, texts).limit(0)).count() == 0


def test_sorted_list_scan():
    from hexloom.llm.spelling import SortedList, fixed_letters, may_begin

    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(6, 9))) for _ in range(1500)})
    asked = words[::9]
    got = []
    for way in (False, True):
        keys = sorted(w[::-1] if way else w for w in words)
        q, w = SortedList(keys).one_edit([x[::-1] if way else x for x in asked], np.array([fixed_letters(x, way) for x in asked]))
        pairs = [(asked[a], keys[b][::-1] if way else keys[b]) for a, b in zip(q.tolist(), w.tolist(), strict=True)]
        got += [p for p in pairs if not way or not p[1].startswith(p[0][: len(p[0]) // 2])]
    assert sorted(got) == sorted((a, b) for a in asked for b in words if one_edit(a, b))
    for a, b in got:  # a list that holds a near word is never skipped
        n = fixed_letters(a, False)
        assert not b.startswith(a[:n]) or all(may_begin(a, n, b[:k]) for k in range(len(b) + 1))


# ranked search


def ranks(rows, items, k):
    word = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    lower = str.maketrans({c: chr(c + 32) for c in range(65, 91)})
    terms = lambda t: word.findall((t or "").translate(lower))
    docs = [(d, x) for d, t in rows if d is not None and (x := terms(t))]
    total, df = sum(len(x) for _, x in docs), {}
    for _, x in docs:
        for t in set(x):
            df[t] = df.get(t, 0) + 1
    weight = {t: math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * n + 1))) for t, n in df.items()}
    least = {}
    for i, t in items:
        if i is not None and t is not None:
            least[i] = min(t, least.get(i, t))
    out = []
    for i, text in least.items():
        scored = []
        for d, x in docs:
            m = 50 + 50 * len(x) * len(docs) // total
            s = sum(weight[t] * (10**9 * x.count(t) // (1000 * x.count(t) + 20 * m)) for t in set(terms(text)) if t in x)
            scored += [(-s, d)] if s > 0 else []
        out += [(i, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.mark.parametrize("k, block", [(50, 2_000_000), (3, 40)])
def test_ranked_search(spark, k, block):
    from hexloom.llm.lexical import ranked_search

    rng = random.Random(11)
    common, rare = ["the", "Of", "and", "é", "字"], [f"w{j}" for j in range(120)]
    text = lambda n: " ".join(rng.choice(common) if rng.random() < 0.6 else rng.choice(rare) for _ in range(n))
    rows = [(d, text(rng.choice([1, 5, 30, 200]))) for d in range(-3, 400)]
    rows += [(500 + d, rows[7][1]) for d in range(80)] + [(7, rows[7][1])] * 3 + [(None, "w1 w2"), (601, None), (602, ""), (603, "...!"), (604, "W3," * 30_000), (605, "only\x00here")]
    items = [(i, text(12)) for i in range(12)] + [(3, "a smaller text w3"), (20, None), (None, "w1"), (21, "-"), (22, "absent words"), (23, "ONLY, here the"), (24, "the of and")]
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit(1)).repartition(3)
    found = ranked_search(table(spark, rows), asked, k=k, block=block)
    assert dict(found.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    assert sorted(map(tuple, found.collect())) == ranks(rows, items, k)
    assert sorted(map(tuple, ranked_search(table(spark, rows), asked, k=k, most_terms=15).collect())) == ranks(rows, items, k)
    assert ranked_search(table(spark, rows).limit(0), asked).count() == 0 and ranked_search(table(spark, rows), asked.limit(0)).count() == 0


def test_accumulators_stop():
    """Once no new document can be among the best, only those that have an accumulator are brought up to date."""
    from hexloom.llm.lexical import Block

    rng = np.random.default_rng(2)
    doc = np.concatenate([np.arange(6), np.arange(1000)])
    term = np.repeat([0, 1], [6, 1000])
    block = Block(np.arange(1000), np.full(1000, 100), doc, term, rng.integers(1, 3, 1006), 2)
    place, score = block.best(np.array([0, 1]), np.array([9000, 1]), 3, 1)
    assert set(place) == set(range(6)) and (score > 9000).all() and not block.acc.any()
    place, _ = block.best(np.array([0, 1]), np.array([1, 1]), 3, 1)
    assert len(place) == 1000
