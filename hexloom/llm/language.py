"""Language identification by a linear-chain conditional random field over words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow
from .kernels import BYTE_BASE, Rolling, byte_view, mix, pieces, words

U = np.uint64
BITS = 17
#: Words of a chain that are worked on side by side with other chains'; the steps between them are exact.
CHUNK = 64
UNKNOWN = "und"
SPANS = "array<struct<lang:string,first_word:int,n_words:int>>"
#: Bytes that part words here: all ASCII but letters.
NOT_LETTER = np.array([i < 128 and not chr(i).isalpha() for i in range(256)])


def features(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, feature) of each word raw[start:end]: affixes of 1 to 4 bytes, n-grams of 2 and 3, and the word itself.

    The word itself is its entry in the lexicon. Features are hashed into a table of 2**BITS weights.
    """
    roll = Rolling(raw, BYTE_BASE)
    n, number = end - start, np.arange(len(start))
    found_word, found = [number], [mix(roll.of(start, end) ^ U(1))]
    for k in range(1, 5):
        long = n >= k
        for kind, a in ((2 * k, start[long]), (2 * k + 1, end[long] - k)):
            found_word.append(number[long])
            found.append(mix(roll.of(a, a + k) ^ U(kind + 10)))
    for k in (2, 3):
        count = np.maximum(n - k + 1, 0)
        word = np.repeat(number, count)
        a = start[word] + np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count)
        found_word.append(word)
        found.append(mix(roll.of(a, a + k) ^ U(k + 100)))
    return np.concatenate(found_word), (np.concatenate(found) >> U(64 - BITS)).astype(np.int64)


@dataclass
class Text:
    """The words of a batch by kind: features of each kind, and the kind of each word; words of each text."""

    word: np.ndarray
    feature: np.ndarray
    kinds: int
    kind: np.ndarray
    at: np.ndarray

    @classmethod
    def read(cls, texts: pa.Array) -> Text:
        raw, at = byte_view(pc.utf8_lower(texts))
        start, end, offsets = words(raw, at, NOT_LETTER)
        _, first, kind = np.unique(Rolling(raw, BYTE_BASE).of(start, end), return_index=True, return_inverse=True)
        word, feature = features(raw, start[first], end[first])
        return cls(word, feature, len(first), kind, offsets)

    def chunks(self) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers (chunk, place), -1 past a text's end, and the text of each chunk. A text is one chain of chunks."""
        n = np.diff(self.at)
        count = -(-n // CHUNK)
        text = np.repeat(np.arange(len(n)), count)
        begin = self.at[text] + CHUNK * (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count))
        grid = begin[:, None] + np.arange(CHUNK)[None, :]
        return np.where(grid < self.at[text + 1][:, None], grid, -1), text

    def stitched(self, label: np.ndarray, rng: np.random.Generator) -> tuple[Text, np.ndarray]:
        """These texts, and half as many made of stretches of 5 to 40 words of two texts in turn; the label of each word.

        Texts that switch between languages are rare among labelled ones; these teach how often neighbours differ.
        """
        n = np.diff(self.at)
        order, size = [np.arange(len(self.kind))], n.tolist()
        labels = [np.repeat(label, n)]
        some = np.flatnonzero(n >= 5)
        for _ in range(len(n) // 2 if len(np.unique(label[some])) > 1 else 0):
            one = rng.choice(some)
            two = rng.choice(some[label[some] != label[one]])
            parts, at = [], {one: 0, two: 0}
            for k in range(8):
                t = (one, two)[k % 2]
                part = np.arange(at[t], min(at[t] + rng.integers(5, 41), n[t]))
                at[t] += len(part)
                parts.append(self.at[t] + part)
                labels.append(np.full(len(part), label[t]))
            order.extend(parts)
            size.append(sum(map(len, parts)))
        at = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        return Text(self.word, self.feature, self.kinds, self.kind[np.concatenate(order)], at), np.concatenate(labels)


@dataclass
class Chances:
    """What forward-backward gives: chances (chunk, place, label), and what the expected moves need."""

    p: np.ndarray
    grid: np.ndarray
    text: np.ndarray
    live: np.ndarray
    forth: np.ndarray
    back: np.ndarray
    into: np.ndarray
    opens: np.ndarray
    e: np.ndarray
    move: np.ndarray


class ChainCRF:
    """Weights of hashed word features for each label, and of transitions between the labels of neighbours."""

    def __init__(self, labels: list[str]):
        self.labels = labels
        self.weights = np.zeros((1 << BITS, len(labels)), np.float32)
        self.moves = np.zeros((len(labels), len(labels)))

    def emissions(self, x: Text) -> np.ndarray:
        """Of each kind of word."""
        out = np.empty((x.kinds, len(self.labels)))
        for k in range(len(self.labels)):
            out[:, k] = np.bincount(x.word, self.weights[x.feature, k], x.kinds)
        return out

    def marginals(self, x: Text, whole: bool = True) -> Chances:
        """Chances of each label at each word by forward-backward over each whole text; without ``whole`` nothing else is kept.

        A chunk's steps are multiplied into one matrix, so the messages that enter it from both sides come from one short
        pass over the chunks of each text; then all chunks are worked through side by side.
        """
        k = len(self.labels)
        grid, text = x.chunks()
        per_kind = self.emissions(x)
        per_kind -= per_kind.max(axis=1, keepdims=True, initial=-np.inf)
        score = np.exp(np.maximum(per_kind, -30))
        live = grid >= 0
        e = np.where(live[:, :, None], score[x.kind[np.maximum(grid, 0)]] if len(x.kind) else 0.0, 1.0)
        move = np.exp(self.moves - self.moves.max(initial=0))
        n, length = grid.shape
        opens, closes = np.ones(n, bool), np.ones(n, bool)
        opens[1:] = text[1:] != text[:-1]
        closes[:-1] = opens[1:]

        into, after = np.ones((n, k)), np.ones((n, k))
        part = np.flatnonzero(~(opens & closes))  # chunks of texts of more than one
        if len(part):
            steps = np.where(opens[part, None, None], np.eye(k), move) * e[part, 0][:, None, :]
            for t in range(1, length):
                step = (steps.reshape(-1, k) @ move).reshape(-1, k, k) * e[part, t][:, None, :]
                steps = np.where(live[part, t][:, None, None], step, steps)
                if t % 8 == 0:
                    steps /= steps.max(axis=(1, 2), keepdims=True)
            place = np.arange(len(part)) - np.maximum.accumulate(np.where(opens[part], np.arange(len(part)), 0))
            by_place = np.argsort(place, kind="stable")
            cuts = np.searchsorted(place[by_place], np.arange(place.max() + 2))
            for c in range(place.max()):
                i = by_place[cuts[c] : cuts[c + 1]]
                i = i[~closes[part[i]]]
                a = (into[part[i]][:, None, :] @ steps[i])[:, 0]
                into[part[i] + 1] = a / a.sum(axis=1, keepdims=True)
            for c in range(place.max(), 0, -1):
                i = by_place[cuts[c] : cuts[c + 1]]
                b = (steps[i] @ after[part[i]][:, :, None])[:, :, 0]
                after[part[i] - 1] = b / b.sum(axis=1, keepdims=True)

        forth, back = np.empty((length, n, k)), np.empty((length, n, k))
        a = np.where(opens[:, None], 1.0, into @ move) * e[:, 0]
        forth[0] = a = a / a.sum(axis=1, keepdims=True)
        for t in range(1, length):
            a = (a @ move) * e[:, t]
            a = a / a.sum(axis=1, keepdims=True)
            forth[t] = a = np.where(live[:, t, None], a, forth[t - 1])
        back[length - 1] = b = after
        for t in range(length - 2, -1, -1):
            b = (b * e[:, t + 1]) @ move.T
            b = b / b.sum(axis=1, keepdims=True)
            back[t] = b = np.where(live[:, t + 1, None], b, after)
        if not whole:
            e = None
        p = forth * back if whole else np.multiply(forth, back, out=forth)
        if not whole:
            back = forth = None
        p /= p.sum(axis=2, keepdims=True)
        return Chances(p.transpose(1, 0, 2), grid, text, live, forth, back, into, opens, e, move)

    def gradient(self, x: Text, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the mean log-likelihood of the words' labels: by score of each kind of word, and by transition."""
        c = self.marginals(x)
        k, of, truth = len(self.labels), x.kind[c.grid[c.live]], label[c.grid[c.live]]
        total = len(of)
        slope = np.stack([np.bincount(of, (truth == j) - c.p[c.live][:, j], x.kinds) for j in range(k)], axis=1) / total
        first = np.zeros(len(x.kind), bool)
        first[x.at[:-1][np.diff(x.at) > 0]] = True
        later = np.flatnonzero(~first)
        moves = np.bincount(label[later - 1] * k + label[later], minlength=k * k).reshape(k, k).astype(float)
        for t in range(c.grid.shape[1]):
            on = c.live[:, t] & (~c.opens if t == 0 else True)
            before = c.into[on] if t == 0 else c.forth[t - 1][on]
            joint = before[:, :, None] * c.move[None] * (c.e[on, t] * c.back[t][on])[:, None, :]
            moves -= (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        return slope, moves / total

    def fit(self, texts: pa.Array, label: np.ndarray, rounds: int = 4, batch: int = 64, rate: float = 0.5, decay: float = 1e-4, seed: int = 3) -> ChainCRF:
        """Maximum likelihood of the labels of all words: those of their texts, and of stretches of two texts in turn."""
        if len(self.labels) < 2:
            return self
        rng = np.random.default_rng(seed)
        grown, grown_moves = np.full(self.weights.shape, 1e-6, np.float32), np.full(self.moves.shape, 1e-6)
        read = [(Text.read(texts.slice(k, batch)), label[k : k + batch]) for k in range(0, len(texts), batch)]
        parts = [x.stitched(y, rng) for x, y in read if len(x.kind)]
        for _ in range(rounds):
            for x, y in parts:
                slope, step = self.gradient(x, y)
                grown_moves += step**2
                self.moves += 0.2 * rate * step / np.sqrt(grown_moves)
                used, place = np.unique(x.feature, return_inverse=True)
                for k in range(len(self.labels)):
                    step = np.bincount(place, slope[x.word, k], len(used)) - decay * self.weights[used, k] / len(parts)
                    grown[used, k] += step**2
                    self.weights[used, k] += rate * step / np.sqrt(grown[used, k])
        return self

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """For each text the label with the greatest mean chance over its words, that mean, and its runs of words of one label.

        The label is -1, and there are no runs, without words.
        """
        x = Text.read(texts)
        best, score = np.full(len(texts), -1), np.zeros(len(texts))
        label = np.zeros(0, np.int64)
        if len(x.kind) and self.labels:
            c = self.marginals(x, whole=False)
            label = c.p.argmax(axis=2)[c.live]
            c.p[~c.live] = 0
            p = c.p.sum(axis=1)
            mean = np.stack([np.bincount(c.text, p[:, k], len(texts)) for k in range(len(self.labels))], axis=1)
            n = np.diff(x.at)
            mean = mean[n > 0] / n[n > 0][:, None]
            best[n > 0], score[n > 0] = mean.argmax(axis=1), np.clip(mean.max(axis=1), 0, 1)
        at = x.at if len(label) else np.zeros(len(texts) + 1, np.int64)
        new = np.ones(len(label), bool)
        new[1:] = label[1:] != label[:-1]
        new[at[:-1][np.diff(at) > 0]] = True
        head = np.flatnonzero(new)
        text = np.searchsorted(at, head, "right") - 1
        fields = [
            pa.DictionaryArray.from_arrays(pa.array(label[head].astype(np.int32)), pa.array(self.labels, pa.string())).cast(pa.string()),
            pa.array((head - at[text]).astype(np.int32)),
            pa.array(np.diff(np.append(head, len(label))).astype(np.int32)),
        ]
        runs = pa.StructArray.from_arrays(fields, ["lang", "first_word", "n_words"])
        return best, score, pa.ListArray.from_arrays(pa.array(np.searchsorted(head, at).astype(np.int32)), runs)


def held_out(id_col: str):
    """Of each five documents, the one whose id's CRC-32 is divisible by five is kept from training."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _fitted(batches) -> Iterator[pa.RecordBatch]:
    """Rows (text, lang) of the whole sample, in order: one row, the model fitted on them as (labels, weights, moves)."""
    read = list(batches)
    langs = np.array([x for b in read for x in b.column(1).to_pylist()], object)
    labels = sorted(set(langs))
    number = {x: i for i, x in enumerate(labels)}
    texts = pa.concat_arrays([b.column(0) for b in read]) if read else pa.array([], pa.string())
    model = ChainCRF(labels).fit(texts, np.array([number[x] for x in langs], np.int64))
    columns = [pa.array([labels], pa.list_(pa.string())), pa.array([model.weights.tobytes()]), pa.array([model.moves.tobytes()])]
    yield pa.RecordBatch.from_arrays(columns, ["labels", "weights", "moves"])


def train(docs: DataFrame, sample_rows: int = 1500, sample_bytes: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ChainCRF:
    """Fit on the ``sample_rows`` labelled documents, at most, with the least hashed ids that aren't held out.

    Documents of over ``sample_bytes`` bytes are not among them, so the sample is bounded; it is fitted on in one task, and
    the driver sees the parameters alone.
    """
    labelled = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    labelled = labelled.where(F.octet_length(text_col) <= sample_bytes)
    # only about as many rows as are wanted reach the sort: those under a cut of the hash that the count gives
    order = F.pmod(F.xxhash64(F.lit(29), F.col(id_col)), F.lit(1 << 40))
    share = min(1.0, 1.3 * sample_rows / max(1, labelled.count()))
    sample = labelled.where(order <= int(share * (1 << 40))).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), order.alias("at"), F.col(id_col).alias("id"))
    sample = sample.orderBy("at", "id", "text").limit(sample_rows).select("text", "lang")
    found = map_arrow(sample, _fitted, "labels array<string>, weights binary, moves binary").first()
    model = ChainCRF(list(found["labels"]) if found else [])
    if found:
        model.weights = np.frombuffer(found["weights"], np.float32).reshape(model.weights.shape).copy()
        model.moves = np.frombuffer(found["moves"]).reshape(model.moves.shape).copy()
    return model


def identify(docs: DataFrame, model: ChainCRF, text_col: str = "text", made: tuple[str, str, str] = ("lang_pred", "score", "lang_spans")) -> DataFrame:
    """docs with a language, a score (0 to 1: the mean chance of that language over the words of the whole text) and spans.

    The spans are the runs of words of one language, as (lang, first_word, n_words) in the order of the text; words are
    runs of letters, parted by any other ASCII. A text that is null, or has no letter, is ``und`` with score 0 and no
    span. Repeated rows are labelled each; columns named as ``made`` are replaced; an empty table stays one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS weights for each language
    kept = [c for c in docs.columns if c not in made]
    letters = F.coalesce(F.col(f"`{text_col}`").rlike(r"\p{L}"), F.lit(False))
    x = docs.select(*[F.col(f"`{c}`") for c in kept], letters.alias("hx_letters"))
    text_at = kept.index(text_col)

    def run(batches) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for a, b in pieces(batch.column(text_at), 1 << 18):
                part = batch.slice(a, b - a)
                best, score, spans = model.predict(part.column(text_at))
                known = np.asarray(part.column(len(kept)).to_numpy(zero_copy_only=False)) & (best >= 0)
                lang = [model.labels[i] if k else UNKNOWN for i, k in zip(best.tolist(), known.tolist(), strict=True)]
                none = pa.ListArray.from_arrays(pa.array([0, 0], pa.int32()), spans.values.slice(0, 0))
                spans = pa.compute.if_else(pa.array(known), spans, none[0]) if not known.all() else spans
                columns = [part.column(i) for i in range(len(kept))] + [pa.array(lang, pa.string()), pa.array(np.where(known, score, 0.0)), spans]
                yield pa.RecordBatch.from_arrays(columns, [*kept, *made])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in x.schema if f.name != "hx_letters")
    return map_arrow(x, run, f"{schema}, {made[0]} string, {made[1]} double, {made[2]} {SPANS}")


def op10_crf_language(spark, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from those that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "lang_spans")
