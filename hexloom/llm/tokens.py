"""Token counts of whole texts: byte-balanced batches, cut at safe boundaries, of which only lengths come back."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow
from .kernels import byte_view, pieces

#: A stretch without a blank that is longer than this is cut at other safe boundaries, if it has any.
LONG = 1 << 14
#: Between two ASCII characters where no pre-token goes on: after a letter that a non-letter follows, before and after a
#: digit; and after a full stop, comma or blank of Chinese and Japanese that a letter follows.
SAFE = regex.compile(r"(?<=[A-Za-z])(?=[\x21-\x7E])(?![A-Za-z])|(?<=[0-9])(?=[\x21-\x7E])|(?<=[\x21-\x7E])(?=[0-9])|(?<=[　-。])(?=\p{L})")
_loaded: dict[str, object] = {}


def _tokenizer(name: str):
    if name not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import public_tokenizers as P
        from tokenizers import Tokenizer

        _loaded[name] = Tokenizer.from_file(P.path(name))
        _loaded[name].no_truncation()
        _loaded[name].no_padding()
    return _loaded[name]


def safe_cuts(text: str, whole: tuple[str, ...], long: int = LONG) -> list[str]:
    """text in stretches of about ``long`` characters, cut where the counts of the stretches add up to that of the text.

    No cut falls into one of the strings ``whole`` (the tokens that are taken out of a text before it is split). Where
    there is no safe boundary, a stretch is as long as it must be.
    """
    out, start = [], 0
    while len(text) - start > long:
        at = start + long
        while True:
            found = SAFE.search(text, at)
            if found is None:
                return [*out, text[start:]]
            at = found.start()
            if any(w in text[max(start, at - len(w) + 1) : at + len(w) - 1] for w in whole):
                at += 1
                continue
            break
        out.append(text[start:at])
        start = at
    return [*out, text[start:]]


def _lengths(texts: pa.Array, name: str) -> np.ndarray:
    """The number of tokens of each distinct stretch between blanks, all encoded in one batch."""
    t = _tokenizer(name)
    strings = texts.to_pylist()
    if max(map(len, strings), default=0) <= LONG:
        return np.array([len(e) for e in t.encode_batch_fast(strings, add_special_tokens=False)], np.int64)
    added = tuple(x.content for x in t.get_added_tokens_decoder().values())
    parts = [safe_cuts(s, added) for s in strings]
    of = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    flat = [x for p in parts for x in p]
    n = np.zeros(len(strings), np.int64)
    size, k = 0, 0
    for j, x in enumerate(flat):  # long stretches are encoded a few at a time
        size += len(x)
        if size > 16 * LONG or j + 1 == len(flat):
            np.add.at(n, of[k : j + 1], [len(e) for e in t.encode_batch_fast(flat[k : j + 1], add_special_tokens=False)])
            size, k = 0, j + 1
    return n


def _count(name: str, batch_bytes: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in pieces(batch.column(1), batch_bytes):
                part = batch.slice(a, b - a)
                text = part.column(1).fill_null("")
                n_bytes = np.diff(byte_view(text)[1])
                words = pc.ascii_split_whitespace(text)
                coded = words.flatten().dictionary_encode()
                per_word = _lengths(coded.dictionary, name)[coded.indices.to_numpy(zero_copy_only=False)]
                at = np.zeros(len(words) + 1, np.int64)
                np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False), out=at[1:])
                sums = np.zeros(len(per_word) + 1, np.int64)
                np.cumsum(per_word, out=sums[1:])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_bytes), pa.array(sums[at[1:]] - sums[at[:-1]])], ["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 8 << 20) -> DataFrame:
    """A row for each row of docs: doc_id, n_bytes (of the text in UTF-8), n_tokens, over_limit (n_tokens > limit).

    The counts are those of the tokenizers file of that name for the whole text, without added special tokens; a special
    token's string inside a text is that token, as by default. The file must part tokens at blanks and lose these, as
    those of whole words do: then the count of a text is the sum of the counts of its stretches between ASCII blanks.
    Tasks take rows in batches of about ``batch_bytes`` of text, encode each distinct stretch of a batch once, in one
    call, and return lengths only. A stretch of over 16 KB without a blank is cut further where pre-tokens end for
    certain; one without any such place is encoded whole. Nothing is shuffled.

    A null text is an empty one (no tokens); repeated rows and rows without an id each get their row; other columns,
    whatever their names, are not read. An empty table gives an empty result.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = map_arrow(texts, _count(tokenizer, batch_bytes), "doc_id long, n_bytes long, n_tokens long")
    return found.withColumn("over_limit", F.col("n_tokens") > limit)


def op13_token_counts(spark, sf_dir: str) -> DataFrame:
    """The tokens of all documents."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
