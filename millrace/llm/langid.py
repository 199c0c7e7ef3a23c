"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text's subwords are its byte trigrams and 4-grams after Unicode lower-casing
(white space as one blank), hashed into ``BUCKETS``. Their embeddings are
averaged and a linear softmax names the language. Both layers are trained by
stochastic gradient descent in numpy on a bounded sample of labelled rows. On a
held-back part of it, a temperature is fitted and the score below which a
prediction is rejected is set so that about ``REJECT`` of good texts fall there.

Defined results: null texts and texts without a letter get ``und`` and score 0,
and count as rejected; very long texts are read whole; repeated rows get equal
predictions; without any labelled row every text is ``und``; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.sampling import below_rate, class_rates, unit
from millrace.llm.shared import received, sent
from millrace.llm.textops import slices

BUCKETS, WIDTH = 1 << 14, 16
#: Labelled rows that a fit takes, about, whatever their length: executors send their bucket counts.
SAMPLE = 3000
EPOCHS, BATCH, RATE = 12, 32, 0.5
#: Part of the sample for calibration; share of its texts that may be rejected; no threshold goes above CEILING.
HELD, REJECT, CEILING = 0.2, 0.001, 0.5


def grams(text: str) -> np.ndarray:
    """Bucket of each subword of a text."""
    raw = b" " + " ".join(text.lower().split()).encode() + b" "
    a = np.frombuffer(raw, np.uint8).astype(np.uint32)
    if len(a) < 4:
        a = np.concatenate((a, np.full(4 - len(a), 32, np.uint32)))
    three = (a[:-2] * np.uint32(0x01000193) ^ a[1:-1]) * np.uint32(0x01000193) ^ a[2:]
    four = three[:-1] * np.uint32(0x85EBCA6B) ^ a[3:]
    both = np.concatenate((three * np.uint32(0x9E3779B1), four * np.uint32(0xC2B2AE35)))
    return (both >> np.uint32(18)).astype(np.int64)


def has_letter(text: str | None) -> bool:
    return bool(text) and regex.search(r"\p{L}", text) is not None


@dataclass
class Model:
    """langs in order; table: embedding times output layer (buckets x langs); bias; temperature; threshold."""

    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def probabilities(self, texts: list[str]) -> np.ndarray:
        out = np.empty((len(texts), len(self.langs)))
        for i, t in enumerate(texts):
            g = grams(t)
            out[i] = np.bincount(g, minlength=BUCKETS) @ self.table / len(g) + self.bias
        return _softmax(out / self.temperature)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(docs: list[tuple[np.ndarray, np.ndarray]], labels: list[str], held: np.ndarray) -> Model:
    """SGD over documents given as (buckets, counts); those marked ``held`` only calibrate."""
    langs = sorted(set(labels))
    y = np.array([langs.index(x) for x in labels])
    rng = np.random.default_rng(7)
    emb = rng.normal(0, 1 / WIDTH, (BUCKETS, WIDTH))
    out, bias = np.zeros((WIDTH, len(langs))), np.zeros(len(langs))
    out += rng.normal(0, 0.1, out.shape)
    own = np.flatnonzero(~held)
    steps, done = EPOCHS * -(-len(own) // BATCH), 0
    for _ in range(EPOCHS):
        rng.shuffle(own)
        for a in range(0, len(own), BATCH):
            pick = own[a : a + BATCH]
            rate = RATE * (1 - done / steps)
            idx = np.concatenate([docs[i][0] for i in pick]).astype(np.int64)
            share = np.concatenate([docs[i][1] / docs[i][1].sum() for i in pick])
            begin = np.cumsum([0] + [len(docs[i][0]) for i in pick])[:-1]
            x = np.add.reduceat(emb[idx] * share[:, None], begin)
            p = _softmax(x @ out + bias)
            p[np.arange(len(pick)), y[pick]] -= 1
            back = np.repeat(p @ out.T, np.diff(np.append(begin, len(idx))), axis=0) * share[:, None]
            out -= rate * x.T @ p
            bias -= rate * p.mean(0)
            grad = np.stack([np.bincount(idx, back[:, k], BUCKETS) for k in range(WIDTH)], 1)
            emb -= rate * 8 * grad
            done += 1
    model = Model(langs, emb @ out, bias, 1.0, 0.0)
    test = np.flatnonzero(held)
    if len(test):
        z = np.stack([np.bincount(docs[i][0], docs[i][1], BUCKETS) @ model.table / docs[i][1].sum() + bias for i in test])
        losses = {t: -np.log(np.maximum(_softmax(z / t)[np.arange(len(test)), y[test]], 1e-12)).mean() for t in np.geomspace(0.25, 8, 41)}
        model.temperature = float(min(losses, key=losses.get))
        model.threshold = float(min(CEILING, np.quantile(_softmax(z / model.temperature).max(1), REJECT)))
    return model


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model | None:
    """A model from labelled rows; executors turn the sampled texts into bucket counts. None without any."""
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l")).where("l is not null")
    rates = class_rates(rows, "l", sample)
    taken = rows.where(below_rate(F.col("i"), F.col("l"), rates)).where("t is not null")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(grams(t), return_counts=True) if has_letter(t) else (np.empty(0), np.empty(0)) for t in batch.column(0).to_pylist()]
            kinds = [batch.column(1), batch.column(2), *(pa.array([x[k].astype(t).tobytes() for x in found], pa.binary()) for k, t in ((0, "<u2"), (1, "<f4")))]
            yield pa.RecordBatch.from_arrays(kinds, names=["l", "u", "g", "n"])

    got = taken.select("t", F.col("l").cast("string").alias("l"), unit(F.col("i")).alias("u")).mapInArrow(counted, "l string, u double, g binary, n binary").limit(2 * sample).collect()
    got = sorted((r for r in got if r["g"]), key=lambda r: (r["u"], r["l"], bytes(r["g"])))
    if not got:
        return None
    feats = [(np.frombuffer(r["g"], "<u2"), np.frombuffer(r["n"], "<f4")) for r in got]  # widened a batch at a time
    held = np.arange(len(got)) % round(1 / HELD) == 0 if len(got) >= 20 else np.zeros(len(got), bool)
    return train(feats, [r["l"] for r in got], held)


def predict(spark, model: Model | None, text: Column) -> Column:
    """struct(lang_pred, score, rejected) of a text column."""
    shared = sent(spark, model)  # buckets x languages, whatever the data

    @F.arrow_udf("struct<lang_pred: string, score: double, rejected: boolean>")
    def named(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = received(shared)
        for column in columns:
            langs, scores = [], []
            texts = column.to_pylist()
            for a, b in slices([len(t or "") for t in texts]):
                good = [has_letter(t) and m is not None for t in texts[a:b]]
                p = iter(m.probabilities([t for t, g in zip(texts[a:b], good, strict=True) if g]) if any(good) else ())
                for g in good:
                    row = next(p) if g else None
                    langs.append(m.langs[int(row.argmax())] if g else "und")
                    scores.append(float(row.max()) if g else 0.0)
            rejected = [x == "und" or s < m.threshold for x, s in zip(langs, scores, strict=True)]
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=["lang_pred", "score", "rejected"])

    return named(text)
