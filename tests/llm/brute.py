"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib


def removed_words(docs: dict[int, str | None], window: int = 50) -> dict[int, tuple[int, int, str]]:
    words = {d: (t or "").encode().split() for d, t in docs.items()}
    first: dict[tuple, int] = {}
    for d in sorted(words):
        for i in range(len(words[d]) - window + 1):
            first.setdefault(tuple(words[d][i : i + window]), d)
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def removed_bytes(docs: dict[int, str | None], length: int = 100) -> dict[int, tuple[int, int, int, str]]:
    raw = {d: (t or "").encode() for d, t in docs.items()}
    first: dict[bytes, tuple[int, int]] = {}
    for d in sorted(raw):
        for i in range(len(raw[d]) - length + 1):
            first.setdefault(raw[d][i : i + length], (d, i))
    out = {}
    for d, x in raw.items():
        gone = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if first[x[i : i + length]] < (d, i):
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(x)) if gone[i] and not (i and gone[i - 1]))
        kept = bytes(b for b, g in zip(x, gone, strict=True) if not g)
        out[d] = (len(x), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def shingle_set(text: str | None, width: int = 5) -> set:
    import re

    words = re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", (text or "").lower())
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def linked(ids, pairs) -> dict:
    """id -> (links, least id of its component)."""
    least, links = {i: i for i in ids}, dict.fromkeys(ids, 0)

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    for a, b in pairs:
        links[a] += 1
        links[b] += 1
        a, b = sorted((root(a), root(b)))
        least[b] = a
    return {i: (links[i], root(i)) for i in ids}


def jaccard_links(docs: dict, threshold: float = 0.8) -> dict:
    sets = {d: shingle_set(t) for d, t in docs.items()}
    where = {}
    for d in sorted(sets):
        for s in sets[d]:
            where.setdefault(s, []).append(d)
    near = {(a, b) for x in where.values() for k, b in enumerate(x) for a in x[:k]}
    return linked(docs, [(a, b) for a, b in near if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])])


def cosine_links(vectors: dict, threshold: float = 0.95) -> dict:
    import numpy as np

    good = {i: np.array(v, float) for i, v in vectors.items() if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = sorted(good)
    pairs = []
    for dim in {len(v) for v in good.values()}:
        same = [i for i in ids if len(good[i]) == dim]
        x = np.stack([good[i] / np.abs(good[i]).max() for i in same])
        x /= np.linalg.norm(x, axis=1)[:, None]
        for k in range(len(same)):
            pairs += [(same[k], same[k + 1 + j]) for j in np.flatnonzero(x[k + 1 :] @ x[k] >= threshold)]
    return linked(vectors, pairs)
