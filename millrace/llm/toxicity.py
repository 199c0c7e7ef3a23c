"""Toxicity scores from a counterfactual-regularised classifier.

A text's features are 64-bit hashes of its words (letters and digits, Unicode
lower-cased) and of their beginnings of ``PREFIXES`` bytes, each present or not;
hashes are kept whole, so no word of a long text meets a toxic one by chance. A
logistic regression with an L1 penalty is fitted by accelerated proximal
gradient steps in numpy on a bounded sample of labelled rows. In labelled
sentences with an identity term, the term is swapped for another of its kind,
and the squared change of the text's logit is penalised: what only names a group
moves no score.

Defined results: a null or wordless text is scored by the bias alone; labels
other than 0 and 1 are not learnt from; labels of the same document must agree
or are learnt as separate rows; sampled rows of equal features and label count once; without labels of both kinds every score is 0;
long texts are read whole; repeated rows get equal scores; other columns are not
read; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.sampling import below_rate, class_rates
from millrace.llm.shared import received, sent
from millrace.llm.textops import slices

#: Byte lengths of word beginnings that are features.
PREFIXES = (4, 5, 6)
#: Labelled rows that a fit takes, about, by label, whatever their length: executors send the hashes of their features.
SAMPLE = {0: 5000, 1: 2500}
#: A feature is in at least so many sampled texts; at most so many features, the commonest first, are fitted.
MIN_TEXTS, MAX_FEATURES = 3, 1 << 18
#: A feature is fitted only if its share of toxic texts is so many standard errors off the mean.
SCREEN = 2.0
L1, L2, SWAP, STEPS, POSITIVE = 1e-4, 1e-6, 1.0, 200, 3.0

# Identity terms by kind.
IDENTITY = (
    ("women", "men", "woman", "man", "girls", "boys", "female", "male", "nonbinary", "transgender"),
    ("gay", "lesbian", "bisexual", "queer", "straight", "homosexual", "heterosexual"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "atheist", "catholic", "protestant"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "atheists", "catholics"),
    ("black", "white", "asian", "african", "european", "latino", "hispanic", "arab", "indigenous"),
    ("immigrants", "refugees", "foreigners", "citizens", "natives"),
    ("disabled", "blind", "deaf", "autistic"),
    ("elderly", "young", "old", "teenage"),
    ("frauen", "männer", "musliminnen", "christen", "juden", "ausländer", "flüchtlinge"),
    ("femmes", "hommes", "musulmans", "chrétiens", "juifs", "immigrés", "réfugiés"),
    ("mujeres", "hombres", "musulmanes", "cristianos", "judíos", "inmigrantes", "refugiados"),
)
_WORD = re.compile(r"[^\W_]+")


def swap_identities(text: str) -> str | None:
    """The text with each identity term swapped for the next of its kind; None if it has none."""
    after = {t: ring[(i + 1) % len(ring)] for ring in IDENTITY for i, t in enumerate(ring)}
    low = text.lower()
    if not any(w in after for w in _WORD.findall(low)):
        return None
    return _WORD.sub(lambda m: after.get(m[0], m[0]), low)


def features(text: str) -> np.ndarray:
    """Sorted distinct 64-bit features of a text."""
    from xxhash import xxh64_intdigest

    raw = {w.encode() for w in _WORD.findall(text.lower())}
    starts = {w[:n] for n in PREFIXES for w in raw if len(w) > n}
    both = [xxh64_intdigest(w, 1) for w in raw] + [xxh64_intdigest(w, 2) for w in starts]
    return np.sort(np.array(both, dtype=np.uint64))


@dataclass
class Model:
    """Sorted features with their non-zero weights, and the bias."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        table = dict(zip(self.keys.tolist(), self.weights.tolist(), strict=True))
        from xxhash import xxh64_intdigest

        seen: dict[str, tuple] = {}
        out = np.empty(len(texts))
        for i, text in enumerate(texts):
            if len(seen) > 1 << 18:
                seen.clear()
            hit: dict[int, float] = {}
            for w in set(_WORD.findall(text.lower())):
                got = seen.get(w)
                if got is None:
                    b = w.encode()
                    keys = [xxh64_intdigest(b, 1)] + [xxh64_intdigest(b[:n], 2) for n in PREFIXES if len(b) > n]
                    got = seen[w] = tuple((k, table[k]) for k in keys if k in table)
                if got:
                    hit.update(got)
            out[i] = self.bias + sum(hit.values())
        return 1 / (1 + np.exp(-out))


def train(texts: list[np.ndarray], labels: np.ndarray, swapped: dict[int, np.ndarray], swap: float = SWAP) -> Model:
    """Fit on feature arrays; ``swapped``: for some rows, the features of their counterfactual text."""
    # terms that only the swaps bring in stay without weight: they can't rise to meet a biased one, so that one has to fall
    every = np.concatenate(texts)
    keys, counts = np.unique(every, return_counts=True)
    keep = counts >= min(MIN_TEXTS, max(1, len(texts) // 10))
    positive = np.zeros(len(keys))
    np.add.at(positive, np.searchsorted(keys, np.concatenate([*[x for x, t in zip(texts, labels, strict=True) if t == 1], np.empty(0, np.uint64)])), 1)
    rate = (labels == 1).mean()
    keep &= np.abs(positive - counts * rate) >= SCREEN * np.sqrt(counts * rate * (1 - rate))
    if keep.sum() > MAX_FEATURES:
        keep &= counts >= np.sort(counts)[-MAX_FEATURES]
    keys = keys[keep]

    def rows(arrays):
        own = [np.searchsorted(keys, x) for x in arrays]
        own = [p[(p < len(keys)) & (keys[np.minimum(p, len(keys) - 1)] == x)] for p, x in zip(own, arrays, strict=True)]
        return np.concatenate([*own, np.empty(0, np.int64)]), np.repeat(np.arange(len(own)), [len(x) for x in own])

    idx, row = rows(texts)
    place = np.array(sorted(swapped), dtype=np.int64)
    idx2, row2 = rows([swapped[i] for i in place.tolist()])
    n, y = len(texts), labels.astype(float)
    weight = np.where(y == 1, POSITIVE, 1.0)
    weight /= weight.sum()
    w, b = np.zeros(len(keys)), 0.0
    v, c, t = w.copy(), b, 1.0
    # a separable bound on the curvature: a row of k features shares its change among them
    size = np.bincount(row, minlength=n) + 1.0
    curve = 0.25 * np.bincount(idx, (weight * size)[row], len(keys)) + L2
    curve_b = 0.25 * float((weight * size).sum())
    if len(place):
        pair = 2 * swap / len(place) * (size[place] + np.bincount(row2, minlength=len(place)))
        share = np.zeros(n)
        share[place] = pair
        curve += np.bincount(idx, share[row], len(keys)) + np.bincount(idx2, pair[row2], len(keys))
    for _ in range(STEPS):
        z = c + np.bincount(row, v[idx], n)
        r = weight * (1 / (1 + np.exp(-z)) - y)
        grad, gb = np.bincount(idx, r[row], len(keys)) + L2 * v, r.sum()
        if len(place):
            d = (z[place] - c - np.bincount(row2, v[idx2], len(place))) * (2 * swap / len(place))
            full = np.zeros(n)
            full[place] = d
            grad += np.bincount(idx, full[row], len(keys)) - np.bincount(idx2, d[row2], len(keys))
        new = v - grad / curve
        new = np.sign(new) * np.maximum(np.abs(new) - L1 / curve, 0)
        nb = c - gb / curve_b
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        if ((v - new) * (new - w)).sum() > 0:  # momentum points uphill: start it anew
            t2 = 1.0
        v, c = new + (t - 1) / t2 * (new - w), nb + (t - 1) / t2 * (nb - b)
        w, b, t = new, nb, t2
    used = w != 0
    return Model(keys[used], w[used], float(b))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: dict[int, int] | None = None) -> Model | None:
    """A model from labelled rows; executors turn the sampled texts into features. None without both labels."""
    own = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).where("i is not null and y in (0, 1)")
    quotas = sample or SAMPLE
    taken = own.where(below_rate(F.col("i"), F.col("y"), class_rates(own, "y", quotas))).limit(2 * sum(quotas.values()))
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("t is not null")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            other = [swap_identities(t) for t in texts]
            cols = [batch.column(1), pa.array([features(t).tobytes() for t in texts], pa.binary()), pa.array([None if o is None else features(o).tobytes() for o in other], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["y", "f", "g"])

    # the sampled labels are at most twice the quotas, whatever the data
    got = rows.join(F.broadcast(taken), "i").select("t", "y").mapInArrow(made, "y int, f binary, g binary").distinct().toArrow().to_pylist()
    got.sort(key=lambda r: (r["f"], r["y"]))
    if len({r["y"] for r in got}) < 2:
        return None
    texts = [np.frombuffer(r["f"], np.uint64) for r in got]
    swapped = {i: np.frombuffer(r["g"], np.uint64) for i, r in enumerate(got) if r["g"] is not None}
    return train(texts, np.array([r["y"] for r in got]), swapped)


def score(spark, model: Model | None, text: Column) -> Column:
    """Score in 0 to 1 of a text column."""
    shared = sent(spark, model)  # MAX_FEATURES weights at most

    @F.arrow_udf("double")
    def scored(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = received(shared)
        for column in columns:
            texts = [t or "" for t in column.to_pylist()]
            out = np.zeros(len(texts))
            for a, b in slices([len(t) for t in texts]) if m else ():
                out[a:b] = m.scores(texts[a:b])
            yield pa.array(out)

    return scored(text)
