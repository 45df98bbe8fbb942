"""Toxicity by a classifier chain: linear models in a row, each fed the earlier categories' probabilities.

Categories. The labels name one, toxic, and it comes last. The ones before it come from the data: the features that
tell toxic texts from others are parted into two groups by the texts in which they occur together (spherical k-means), and
a toxic text is of a group's category if it holds one of its features. The later models are trained
on out-of-fold predictions of the earlier ones, so that they meet the same kind of probabilities as when
scoring.

Features are the presence of lower-cased words and of their first 4, 5 and 6 letters (inflected and
compound forms share them), hashed. Of all hashed features the models take the FEATURES at most that the bounded sample
of labelled rows ties to toxicity beyond chance (G-test). Copies of one label in the sample count once, else a
text that was copied often would turn its rare words into evidence. Texts are read where they lie: the one task
that fits gets hashes of each sampled text, of a bounded number.

Defined cases: null, empty and wordless texts get the models' base rates; a sample without labels or with
only one class gives probability 0 or the constant; very long texts are scored whole, but not learned from if they have more
than WIDE features; of features with equal evidence the smaller hash is taken, and an equal chance
of both answers counts as toxic; repeated rows are scored row by row; of rows that share a labelled id one is learned from; an empty table
gives an empty result; extra columns are kept, those named like the results replaced.
"""

from __future__ import annotations

import math
import pickle
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import add_columns, bounded_sample, fit_in_one_task, labelled_features

#: Labelled rows that the models are fitted on at most.
SAMPLE = 12_000
CATEGORIES = ("first", "second", "toxic")
BUCKETS = 1 << 22
FEATURES = 256
#: G-test statistic that a feature must reach; 24 answers to one in a million by chance.
EVIDENCE = 24.0
FOLDS = 5
THRESHOLD = 0.5
#: Jaccard similarity from which two texts of the sample are copies.
SIMILAR = 0.8
#: Shingle hashes that stand for a text in the sample; the smallest ones, all up to this number.
SKETCH = 1024
#: Distinct features up to which a text is learned from.
WIDE = 16_384

_WORD = re.compile(r"[^\W\d_]+")


def sequence(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def words(text: str | None) -> set[str]:
    return set(sequence(text))


def buckets(word: str) -> tuple[int, ...]:
    """Hashed features of one word."""
    keys = [word] + [f"{k}:{word[:k]}" for k in (4, 5, 6) if len(word) >= k]
    return tuple(zlib.crc32(k.encode("utf-8", "surrogatepass")) % BUCKETS for k in keys)


def shingles(found: list[str]) -> np.ndarray:
    """The SKETCH smallest hashes of a text's five-word shingles, ascending; none of a wordless text."""
    if not found:
        return np.zeros(0, np.uint32)
    own = {zlib.crc32(" ".join(found[j : j + 5]).encode("utf-8", "surrogatepass")) for j in range(max(1, len(found) - 4))}
    return np.sort(np.array(list(own), np.uint32))[:SKETCH]


def _distinct(sets: list[np.ndarray], labels: list[bool] | None = None) -> list[int]:
    """Indices of texts with words that are no copy of an earlier kept one of their label, by their shingles.

    A copy has SIMILAR of the Jaccard similarity of five-word shingles at least, counted over the smallest hashes of both
    together: exactly, where neither text has more than SKETCH. Two such sets share one of their rarest
    (1 - SIMILAR) shingles, so only kept texts that do are compared.
    """
    every, often = np.unique(np.concatenate([*sets, np.zeros(0, np.uint32)]), return_counts=True)
    holders: tuple[dict[int, list[int]], ...] = ({}, {})
    kept = []
    for i, own in enumerate(sets):
        if not len(own):
            continue
        n, by = len(own), holders[int(labels[i]) if labels else 0]
        order = np.lexsort((own, often[np.searchsorted(every, own)]))
        rare = own[order[: n - math.ceil(SIMILAR * n - 1e-9) + 1]].tolist()
        others = {k for r in rare for k in by.get(r, ()) if SIMILAR * n - 1e-9 <= len(sets[k]) <= n / SIMILAR + 1e-9}
        if any(_similar(own, sets[k]) for k in others):
            continue
        kept.append(i)
        for r in rare:
            by.setdefault(r, []).append(i)
    return kept


def _similar(a: np.ndarray, b: np.ndarray) -> bool:
    if len(a) == SKETCH or len(b) == SKETCH:
        least = np.union1d(a, b)[:SKETCH]
        return len(np.intersect1d(np.intersect1d(a, b, assume_unique=True), least, assume_unique=True)) >= SIMILAR * len(least) - 1e-9
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= SIMILAR * (len(a) + len(b) - both) - 1e-9


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, steps: int = 300, l2: float = 2e-5) -> np.ndarray:
    """Weights of a logistic regression with balanced classes, the last one the intercept; full-batch Adam. weight: how often a row counts."""
    weight = np.ones(len(y)) if weight is None else weight
    rate = float(np.clip((y * weight).sum() / weight.sum(), 1e-3, 1 - 1e-3))
    share = (np.where(y > 0, 0.5 / rate, 0.5 / (1 - rate)) * weight / weight.sum()).astype(x.dtype)
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w, m, v = (np.zeros(x.shape[1], x.dtype) for _ in range(3))
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ ((p - y) * share) + l2 * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def _probability(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def fit_chain(x: np.ndarray, labels: np.ndarray, fold: np.ndarray, weight: np.ndarray | None = None) -> list[np.ndarray]:
    """One weight vector for each category; a category's inputs are x and the earlier categories' probabilities."""
    chain, earlier = [], np.zeros((len(x), 0), x.dtype)
    weight = np.ones(len(x)) if weight is None else weight
    for c in range(labels.shape[1]):
        y = labels[:, c].astype(x.dtype)
        inputs = np.hstack([x, earlier])
        chain.append(logistic(inputs, y, weight))
        if c + 1 < labels.shape[1]:
            out = np.zeros(len(x), x.dtype)
            for k in range(FOLDS):
                held = fold == k
                if held.any() and (~held).any():
                    out[held] = _probability(logistic(inputs[~held], y[~held], weight[~held]), inputs[held])
            earlier = np.hstack([earlier, out[:, None]])
    return chain


def grouped(x: np.ndarray, rounds: int = 20) -> np.ndarray:
    """A group, 0 or 1, for each feature (column) by the rows that hold it: spherical k-means from the most frequent one and its farthest."""
    unit = x.T / np.maximum(np.sqrt((x * x).sum(0)), 1e-9)[:, None]
    if len(unit) < 2:
        return np.zeros(len(unit), np.int64)
    one = unit[int(np.argmax(x.sum(0)))]
    near = unit @ one
    # Of the features that meet the first one least the most frequent.
    centres = np.stack([one, unit[int(np.lexsort((-x.sum(0), np.round(near, 1)))[0])]])
    of = np.zeros(len(unit), np.int64)
    for _ in range(rounds):
        new = np.argmax(unit @ centres.T, axis=1)
        if (new == of).all() and _:
            break
        of = new
        for k in (0, 1):
            if (of == k).any():
                mean = unit[of == k].mean(0)
                centres[k] = mean / max(float(np.sqrt((mean * mean).sum())), 1e-9)
    return of


def encode(text: str | None) -> bytes:
    """What the fit needs of a text: its shingles' and its features' hashes; no features where there are more than WIDE."""
    found = sequence(text)
    sketch = shingles(found)
    features = np.unique(np.array([b for w in set(found) for b in buckets(w)], np.uint32))
    if len(features) > WIDE:
        sketch, features = sketch[:0], features[:0]
    return np.concatenate([np.array([len(sketch)], np.uint32), sketch, features]).astype("<u4").tobytes()


def _fit(rows: list[dict]) -> bytes:
    rows.sort(key=lambda r: (str(r["doc_id"]), r["features"]))
    read = [np.frombuffer(r["features"], "<u4") for r in rows]
    kept = _distinct([r[1 : 1 + r[0]] for r in read], [bool(r["label"]) for r in rows])
    found, toxic = [read[i][1 + read[i][0] :] for i in kept], np.array([bool(rows[i]["label"]) for i in kept], bool)
    n = np.array([(~toxic).sum(), toxic.sum()], np.float64)
    if not n.all():
        return pickle.dumps((np.zeros(0, np.int64), [], float(n[1] > 0)))  # one class alone
    of = np.repeat(np.arange(len(found)), [len(f) for f in found])
    flat = np.concatenate(found)
    at, place = np.unique(flat, return_inverse=True)
    pos = np.bincount(place[toxic[of]], minlength=len(at)).astype(np.float64)
    all_, rate = np.bincount(place, minlength=len(at)).astype(np.float64), n[1] / n.sum()
    neg = all_ - pos
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (np.where(pos > 0, pos * np.log(pos / (all_ * rate)), 0) + np.where(neg > 0, neg * np.log(neg / (all_ * (1 - rate))), 0))
    g[(pos / all_ <= rate) | (pos < 3)] = 0
    best = np.argsort(-g, kind="stable")[:FEATURES]
    chosen = np.sort(best[g[best] >= EVIDENCE])
    x = np.zeros((len(found), len(chosen)), np.float32)
    column = np.full(len(at), -1)
    column[chosen] = np.arange(len(chosen))
    told = column[place] >= 0
    x[of[told], column[place][told]] = 1
    group = grouped(x[toxic])
    held = [toxic & (x[:, group == k] > 0).any(1) for k in (0, 1)]
    labels = np.stack([*held, toxic], 1)
    fold = np.array([zlib.crc32(str(rows[i]["doc_id"]).encode()) % FOLDS for i in kept])
    # Rows alike in features, labels and fold are fitted as one that counts as often.
    key = np.hstack([np.packbits(x > 0, axis=1), labels.astype(np.uint8), fold[:, None].astype(np.uint8)])
    _, first, weight = np.unique(key, axis=0, return_index=True, return_counts=True)
    return pickle.dumps((at[chosen].astype(np.int64), fit_chain(x[first], labels[first], fold[first], weight.astype(np.float32)), None))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> bytes:
    """The chain, fitted on at most SAMPLE labelled rows."""
    marked = labels.filter(F.col(label_col).isNotNull()).select(F.col(id_col).alias("doc_id"), (F.col(label_col) > 0).cast("int").alias("label"))
    sample = F.broadcast(bounded_sample(marked, SAMPLE))
    return fit_in_one_task(labelled_features(docs, sample, encode, id_col, text_col), _fit)


def score(docs: DataFrame, model: bytes, text_col: str = "text") -> DataFrame:
    """docs plus p_first, p_second, p_toxic and toxic."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def make():
        chosen, chain, constant = pickle.loads(shared.value)
        index = {int(b): i for i, b in enumerate(chosen)}
        memo: dict[str, tuple[int, ...]] = {}

        def hits(word: str) -> tuple[int, ...]:
            if len(memo) > 300_000:
                memo.clear()
            memo[word] = got = tuple(index[b] for b in buckets(word) if b in index)
            return got

        def work(texts: list[str | None]) -> list[tuple]:
            if constant is not None:
                return [(constant,) * len(CATEGORIES) + (constant >= THRESHOLD,) for _ in texts]
            x = np.zeros((len(texts), len(index)), np.float32)
            for i, t in enumerate(texts):
                for w in words(t):
                    if (h := memo.get(w)) is None:
                        h = hits(w)
                    for j in h:
                        x[i, j] = 1
            for w in chain:
                x = np.hstack([x, _probability(w, x)[:, None].astype(np.float32)])
            p = x[:, len(index) :].astype(float)
            return [(*row, bool(row[-1] >= THRESHOLD)) for row in p.tolist()]

        return work

    return add_columns(docs, text_col, [(f"p_{c}", "double") for c in CATEGORIES] + [("toxic", "boolean")], make)
