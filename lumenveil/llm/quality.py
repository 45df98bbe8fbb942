"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of about PASSAGE characters that together are the whole text. Every passage
is encoded: surface measures (make-up of characters and words, repetition) and a hashed bag of its words and of
their first letters, over which a tanh layer learns its own representation. Gated attention (a tanh and a sigmoid
branch, multiplied) weighs the passages, and a logistic layer scores the weighted representation. Only document
labels are known; the attention weights and the encoder are learned from them by gradient descent.

Labels, language, source and id are no inputs of a score. Rows whose crc32(doc_id as text) mod 3 is 1 are
held out and never used in training, which takes a bounded sample of the other labelled rows. Their passages are
encoded in parallel; the one task that trains gets numbers of a bounded size, whatever the texts' length: of a bag with
more than TRAIN_PASSAGES passages it gets sums of runs of neighbours. Scoring takes every passage as it is.

Defined cases: null and empty texts are one empty passage and are scored; very long texts are more passages;
without any usable label every score is 0.5; equal scores stay equal, 0.5 predicts 1; repeated rows are scored row
by row, and of rows that share a labelled id one is learned from; an empty table gives an empty
result; extra columns are kept, those named like the results replaced.
"""

from __future__ import annotations

import pickle
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import add_columns, bounded_sample, fit_in_one_task, labelled_features

#: Labelled rows that training takes at most.
SAMPLE = 9_000
PASSAGE = 800
#: Passages of one document that training takes apart; of longer ones neighbours are averaged.
TRAIN_PASSAGES = 32
#: Hashed features of a passage's words and their beginnings.
LEXICAL = 256
HIDDEN, GATE = 24, 12
EPOCHS = 30
MARKS = "!*$&%#|.,"
_SPLIT = re.compile(r"\s+")
_TWICE = re.compile(r"([^\w\s])\1")


def passages(text: str | None) -> list[str]:
    """Parts of the whole text, cut at the first white space after PASSAGE characters (or at 4 * PASSAGE)."""
    text = text or ""
    out, at = [], 0
    while len(text) - at > PASSAGE * 1.5:
        m = _SPLIT.search(text, at + PASSAGE, at + 4 * PASSAGE)
        end = m.start() if m else at + 4 * PASSAGE
        out.append(text[at:end])
        at = m.end() if m else end
    out.append(text[at:])
    return out


def measures(part: str, n_parts: int, repeated: float) -> list[float]:
    """Surface measures of a passage: make-up of its characters, words and their repetition."""
    n = max(1, len(part))
    words = part.split()
    k = max(1, len(words))
    low = part.lower()
    distinct = len(set(words))
    same = sum(a == b for a, b in zip(words, words[1:]))
    pairs = len(set(zip(words, words[1:])))
    lines = part.split("\n")
    letters = sum(map(str.isalpha, part)) / n
    upper = sum(a != b for a, b in zip(part, low)) / n
    return [
        *(min(1.0, 6 * part.count(c) / k) for c in MARKS),
        min(1.0, 6 * len(_TWICE.findall(part)) / k),
        upper,
        letters,
        sum(map(part.count, "0123456789")) / n,
        min(20.0, (n - k) / k) / 10,
        distinct / k,
        same / k,
        pairs / max(1, k - 1),
        len(lines) / k,
        len(set(lines)) / len(lines),
        repeated,
        np.log1p(k) / 5,
        np.log1p(n_parts) / 5,
        1.0 if not words else 0.0,
    ]


class Words(dict):
    """word -> its hashed features; a bounded memory of what was computed."""

    def __missing__(self, word: str) -> tuple[int, int]:
        if len(self) > 200_000:
            self.clear()
        low = word.lower().strip(".,;:!?()\"'")
        self[word] = got = tuple(zlib.crc32(k.encode("utf-8", "surrogatepass")) % LEXICAL for k in (low, "^" + low[:3]))
        return got


_WORDS = Words()


def lexical(part: str) -> np.ndarray:
    """Shares of a passage's hashed words and word beginnings, as square roots: frequent words weigh less."""
    found = [f for w in part.split() for f in _WORDS[w]]
    return np.sqrt(np.bincount(np.array(found, np.int64), minlength=LEXICAL) / max(1, len(found))).astype(np.float32)


def encode(text: str | None) -> np.ndarray:
    """Measures and hashed words of every passage of the whole text."""
    parts = passages(text)
    lines = [x for x in (text or "").split("\n") if x.strip()]
    repeated = 1 - len(set(lines)) / len(lines) if lines else 0.0
    return np.hstack([np.array([measures(p, len(parts), repeated) for p in parts], np.float32), np.array([lexical(p) for p in parts])])


N_MEASURES = len(measures("", 1, 0.0)) + LEXICAL


def condensed(bag: np.ndarray, most: int = TRAIN_PASSAGES) -> np.ndarray:
    """At most `most` rows: means of runs of neighbours, so that every passage counts."""
    if len(bag) <= most:
        return bag
    cuts = np.arange(most) * len(bag) // most
    return (np.add.reduceat(bag, cuts) / np.diff(np.append(cuts, len(bag)))[:, None]).astype(np.float32)


class Net:
    """h = tanh(We x + be); a = softmax over a bag of wa . (tanh(V h) * sigmoid(U h)); p = sigmoid(wc . sum a h + bc)."""

    NAMES = ("We", "be", "V", "U", "wa", "wc", "bc")

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        scale = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.We, self.be = scale(N_MEASURES, HIDDEN), np.zeros(HIDDEN, np.float32)
        self.V, self.U, self.wa = scale(HIDDEN, GATE), scale(HIDDEN, GATE), scale(GATE)
        self.wc, self.bc = scale(HIDDEN), np.zeros(1, np.float32)
        self.mean, self.std = np.zeros(N_MEASURES, np.float32), np.ones(N_MEASURES, np.float32)

    def forward(self, x: np.ndarray, start: np.ndarray):
        """x: passages of all bags, one after the other; start: each bag's first. Returns scores and what back() needs."""
        x = np.clip((x - self.mean) / self.std, -8, 8)
        h = np.tanh(x @ self.We + self.be)
        t, g = np.tanh(h @ self.V), 1 / (1 + np.exp(-(h @ self.U)))
        e = (t * g) @ self.wa
        bag = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(x))))
        e = np.exp(e - np.maximum.reduceat(e, start)[bag])
        a = e / np.add.reduceat(e, start)[bag]
        z = np.add.reduceat(a[:, None] * h, start)
        p = 1 / (1 + np.exp(-np.clip(z @ self.wc + self.bc, -30, 30)))
        return p, (x, h, t, g, a, z, bag)

    def back(self, d: np.ndarray, kept, start: np.ndarray) -> dict[str, np.ndarray]:
        """d: the loss's derivative by each bag's logit."""
        x, h, t, g, a, z, bag = kept
        out = {"wc": z.T @ d, "bc": np.array([d.sum()])}
        dz = (d[:, None] * self.wc)[bag]
        da = (dz * h).sum(1)
        de = a * (da - np.add.reduceat(a * da, start)[bag])
        out["wa"] = (t * g).T @ de
        dtg = de[:, None] * self.wa
        dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
        out["V"], out["U"] = h.T @ dt, h.T @ dg
        dh = (a[:, None] * dz + dt @ self.V.T + dg @ self.U.T) * (1 - h * h)
        out["We"], out["be"] = x.T @ dh, dh.sum(0)
        return out


def train(bags: list[np.ndarray], y: np.ndarray, seed: int = 7) -> Net:
    net, r = Net(seed), np.random.default_rng(seed)
    every = np.concatenate(bags)
    net.mean, net.std = every.mean(0), np.maximum(every.std(0), 0.02)
    m, v = ({k: np.zeros_like(getattr(net, k)) for k in Net.NAMES} for _ in range(2))
    step = 0
    weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-3), 0.5 / max(1 - y.mean(), 1e-3))
    weight = np.sqrt(weight)  # between plain and balanced
    for epoch in range(EPOCHS):
        order = r.permutation(len(bags))
        for lo in range(0, len(order), 128):
            part = order[lo : lo + 128]
            x = np.concatenate([bags[i] for i in part])
            start = np.concatenate([[0], np.cumsum([len(bags[i]) for i in part])[:-1]])
            p, kept = net.forward(x, start)
            step += 1
            rate = 0.01 * (1 - epoch / EPOCHS) + 5e-4
            for k, grad in net.back((p - y[part]) * weight[part] / len(part), kept, start).items():
                w = getattr(net, k)
                grad = grad + 1e-4 * w
                m[k], v[k] = 0.9 * m[k] + 0.1 * grad, 0.99 * v[k] + 0.01 * grad * grad
                setattr(net, k, (w - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32))
    return net


def _fit(rows: list[dict]) -> bytes:
    rows.sort(key=lambda r: (str(r["doc_id"]), r["features"]))
    if not rows:
        return pickle.dumps(None)
    y = np.array([float(r["label"]) for r in rows], np.float32)
    return pickle.dumps(train([np.frombuffer(r["features"], "<f2").astype(np.float32).reshape(-1, N_MEASURES) for r in rows], y))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> bytes:
    """The network, trained on at most SAMPLE labelled rows that aren't held out."""
    usable = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    sample = F.broadcast(bounded_sample(usable.select(F.col(id_col).alias("doc_id"), (F.col(label_col) > 0).cast("int").alias("label")), SAMPLE))
    encoded = labelled_features(docs, sample, lambda text: condensed(encode(text)).astype("<f2").tobytes(), id_col, text_col)
    return fit_in_one_task(encoded, _fit)


def score(docs: DataFrame, model: bytes, text_col: str = "text") -> DataFrame:
    """docs plus score (0 to 1) and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        net = pickle.loads(shared.value)

        def work(texts: list[str | None]) -> list[tuple]:
            out: list[float] = []
            for lo in range(0, len(texts), 128):
                bags = [encode(t) for t in texts[lo : lo + 128]]
                if net is None:
                    out += [0.5] * len(bags)
                    continue
                start = np.concatenate([[0], np.cumsum([len(b) for b in bags])[:-1]]).astype(np.int64)
                out += net.forward(np.concatenate(bags), start)[0].astype(float).tolist()
            return [(p, int(p >= 0.5)) for p in out]

        return work

    return add_columns(docs, text_col, [("score", "double"), ("predicted", "int")], make)
