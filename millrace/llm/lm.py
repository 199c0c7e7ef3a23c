"""LM scoring: a hashed maximum-entropy model with a class-factored softmax.

Words are runs without white space, A-Z lower-cased; a text ends with one end
token. The probability of a token is that of its class times that of the token
within its class. Class logits are sums of hashed weight rows of four
features: the word before (bigram), the two before (trigram), and the second and
third before alone (skips). The ``TOP`` commonest tokens fill classes of
``SLOTS``, in which logits are a bias plus a hashed row of the word before.
All other words, unknown ones too, are in ``RARE`` further classes by their
beginning and last byte; within those a word has probability (c + 1) over the
class's sum of it, where each class has room for one unknown word.

Biases are set so that the untrained model is the add-one unigram model. Then
come ``ROUNDS`` rounds, each over another share of the training texts: every trainer
takes gradient steps (Adagrad by rows) over about ``TRAINER`` tokens of that share, and
the trainers' rows are averaged, weighted by how often each used a row, as are the
sums of squares that later rounds go on from. Which texts a trainer gets, and in which
order, follows from ids and texts alone, so scores don't depend on the cores, and a
trainer's work doesn't grow with the input. Scoring works on sparse rows in numpy batches.

Counts of all words are kept as a table. Only ``KNOWN`` of the commonest at
most are broadcast; counts of other words reach a text's row by a join.

Defined results: a null or wordless text is the end token alone; without training
texts the counts are zero and the base score of every text is 0; rows with a null
id belong to no fold's held-out part and are learnt from; repeated rows count each
time and score alike; long texts are taken whole; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import partitions, received, sent, tidied, written
from millrace.llm.textops import ASCII_LOWER, mix, slices, text_bytes

END = b" "  # no word holds a blank
TOP, SLOTS, RARE, KNOWN = 3072, 96, 30, 1 << 18
CLASSES = TOP // SLOTS + RARE
#: Hashed rows of each class feature and of the feature within classes.
ROWS, INNER_ROWS = 1 << 12, 1 << 12
ROUNDS, TRAINER, STEP, RATE, SHORT = 4, 1 << 22, 1 << 13, 0.1, 12
#: SHORT: runs of rows up to this long are summed side by side.
#: Entries of a counting task before it hands them on.
FLUSH = 1 << 18
_U = np.uint64


def rare_class(word: bytes) -> int:
    """Class (from 0) of a word outside the top: its first two bytes and what it ends with."""
    return zlib.crc32(word[:2]) % (RARE // 3) * 3 + (word[-1:] == b".") + 2 * (word[-1:] == b",")


class Lexicon(dict):
    """Code of each known word; of others, KNOWN plus their rare class."""

    def __missing__(self, word: bytes) -> int:
        return KNOWN + rare_class(word)


@dataclass
class Model:
    """words: the known ones by falling count, as Lexicon codes; arrays by code; the weights."""

    words: list[bytes]
    n: int  # training tokens
    v: int  # distinct ones
    of_class: np.ndarray
    slot: np.ndarray
    inner: np.ndarray  # log10 probability within a rare class, without log10(c + 1) for unknown codes
    log_count: np.ndarray  # log10(c + 1)
    bias_in: np.ndarray
    rows: np.ndarray
    rows_in: np.ndarray

    @property
    def base_size(self) -> int:
        return self.n + self.v + 1


def count_words(texts: DataFrame) -> DataFrame:
    """(word binary, c long) of a column ``text``, an end token for each row included."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def rows():
            for part in itertools.batched(counts.items(), 1 << 14):
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in part], pa.binary()), pa.array([c for _, c in part], pa.int64())], names=["word", "c"])
            counts.clear()

        for batch in batches:
            for text in batch.column(0):
                counts.update((text.as_py() or "").encode().translate(ASCII_LOWER).split())
                if len(counts) > FLUSH:
                    yield from rows()
            counts[END] += len(batch)
        yield from rows()

    return texts.select("text").mapInArrow(tidied(counted), "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def untrained(counts: DataFrame) -> Model:
    """The model whose probabilities are add-one unigram ones, from a table of counts."""
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    # as many of the commonest words as fit into KNOWN, by eighths of a power of two of their counts: no sort of all words
    level = F.floor(F.log2("c") * 8).cast("int")
    levels, least, room = sorted(counts.groupBy(level.alias("k")).count().collect(), reverse=True), 1 << 20, KNOWN - 1  # some hundred rows
    for k, n in levels:
        room -= n
        if room < 0:
            break
        least = k
    top = counts.where((level >= least) | (F.col("word") == F.lit(bytearray(END)))).toArrow()
    c = top.column(1).to_numpy().astype(np.int64)
    words = top.column(0).to_pylist()
    best = sorted(range(len(words)), key=lambda i: (-c[i], words[i]))
    words, c = [words[i] for i in best], c[best]
    kind = F.substring("word", -1, 1)
    group = (F.crc32(F.substring("word", 1, 2)) % (RARE // 3) * 3 + F.when(kind == F.lit(bytearray(b".")), 1).when(kind == F.lit(bytearray(b",")), 2).otherwise(0)).cast("int")
    mass = np.ones(RARE)
    for r in counts.groupBy(group.alias("k")).agg(F.sum(F.col("c") + 1).alias("m")).collect():  # RARE rows
        mass[r.k] += r.m
    own = min(TOP, len(words))
    rare = np.array([rare_class(w) for w in words], np.int64)
    np.subtract.at(mass, rare[:own], c[:own] + 1)
    of_class = np.concatenate((rare, np.arange(RARE))) + TOP // SLOTS
    of_class = np.concatenate((of_class[: len(words)], np.zeros(KNOWN - len(words), np.int64), of_class[len(words) :]))
    slot = np.full(KNOWN + RARE, -1)
    # words of one ending and beginning side by side share a class
    order = sorted(range(own), key=lambda i: (words[i][-1:] in (b".", b","), words[i]))
    size = -(-own // (TOP // SLOTS)) or 1
    for k, i in enumerate(order):
        of_class[i], slot[i] = k // size, k % size
    log_count = np.zeros(KNOWN + RARE)
    log_count[: len(words)] = np.log10(c + 1)
    bias_in = np.full((TOP // SLOTS, SLOTS), -np.inf)
    bias_in[of_class[:own], slot[:own]] = np.log(c[:own] + 1)
    heads = np.exp(bias_in).sum(1)
    with np.errstate(divide="ignore"):
        bias = np.log(np.concatenate((heads, mass)))
    bias_in[np.isneginf(bias_in).all(1)] = 0.0
    bias[np.isneginf(bias)] = -1e9
    # every token has one bigram row, so these rows begin with the classes' biases
    rows = np.zeros((4 * ROWS, CLASSES), np.float32)
    rows[:ROWS] = bias - bias.max()
    inner = np.where(slot < 0, log_count - np.log10(mass)[np.maximum(of_class - TOP // SLOTS, 0)], 0.0)
    return Model(words, int(total[0]), int(total[1]), of_class, slot, inner, log_count, bias_in.astype(np.float32), rows, np.zeros((INNER_ROWS, SLOTS), np.float32))


def coded(lexicon: Lexicon, end: int, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
    """Codes of all tokens, each text's number of tokens, and each text's words."""
    words = [t.translate(ASCII_LOWER).split() for t in texts]
    sizes = np.array([len(w) + 1 for w in words], np.int64)
    codes = np.empty(int(sizes.sum()), np.int64)
    at, get = 0, lexicon.__getitem__
    for w in words:
        codes[at : at + len(w)] = np.fromiter(map(get, w), np.int64, len(w))
        codes[at + len(w)] = end
        at += len(w) + 1
    return codes, sizes, words


def feature_rows(codes: np.ndarray, sizes: np.ndarray, of_class: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(4, n) rows of the class features, and the row of the feature within classes."""
    place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    start = KNOWN + RARE
    before = []
    for k in (1, 2, 3):
        b = np.full(len(codes), start, np.int64)
        b[k:] = codes[:-k] if k < len(codes) else codes[:0]
        b[place < k] = start
        before.append(b.astype(_U))
    one, two, three = before
    mask = _U(ROWS - 1)
    hashed = [mix(one + _U(1 << 40)), mix(mix(one + _U(2 << 40)) + two), mix(two + _U(3 << 40)), mix(three + _U(4 << 40))]
    rows = np.stack([((h & mask) + _U(j * ROWS)).astype(np.int64) for j, h in enumerate(hashed)])
    inside = mix(mix(one + _U(5 << 40)) + of_class[codes].astype(_U)) & _U(INNER_ROWS - 1)
    return rows, inside.astype(np.int64)


def _take(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return np.take(table, rows, axis=0, mode="clip")


def _exp(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp of logits and its row sums; should float32 not hold them, rows of z are first shifted in place to a maximum of zero."""
    ones = np.ones(z.shape[1], np.float32)
    with np.errstate(over="ignore"):
        e = np.exp(z)
    total = e @ ones
    if not (np.isfinite(total) & (total > 1e-30)).all():
        z -= z.max(1, keepdims=True)
        e = np.exp(z)
        total = e @ ones
    return e, total


def _class_logits(m: Model, rows: np.ndarray) -> np.ndarray:
    z = _take(m.rows, rows[0])
    for r in rows[1:]:
        z += _take(m.rows, r)
    return z


def _inner_logits(m: Model, classes: np.ndarray, inside: np.ndarray) -> np.ndarray:
    z = _take(m.bias_in, classes)
    z += _take(m.rows_in, inside)
    return z


def log_probabilities(m: Model, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """log10 probability of each token, without log10(c + 1) where its code is that of unknown words."""
    rows, inside = feature_rows(codes, sizes, m.of_class)
    out, classes, slots = m.inner[codes], m.of_class[codes], m.slot[codes]
    for a in range(0, len(codes), STEP):
        b = min(a + STEP, len(codes))
        z = _class_logits(m, rows[:, a:b])
        total = _exp(z)[1]
        got = z[np.arange(b - a), classes[a:b]] - np.log(total, dtype=np.float64)
        k = np.flatnonzero(slots[a:b] >= 0)
        if len(k):
            z = _inner_logits(m, classes[a:b][k], inside[a:b][k])
            total = _exp(z)[1]
            got[k] += z[np.arange(len(k)), slots[a:b][k]] - np.log(total, dtype=np.float64)
        out[a:b] += got / np.log(10)
    return out


def _sum_runs(x: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums of runs of rows: short ones all at once, row after row; long ones each by itself."""
    out = _take(x, first)
    short = np.flatnonzero((size > 1) & (size <= SHORT))
    for k in range(1, SHORT):
        short = short[size[short] > k]
        out[short] += _take(x, first[short] + k)
    for i in np.flatnonzero(size > SHORT).tolist():
        out[i] = x[first[i] : first[i] + size[i]].sum(0)
    return out


def _descend(table: np.ndarray, squares: np.ndarray, used: np.ndarray, rows: np.ndarray, grad: np.ndarray) -> None:
    order = np.argsort(rows.astype(np.uint16), kind="stable")
    sorted_rows = rows[order]
    first = np.flatnonzero(np.concatenate(([True], sorted_rows[1:] != sorted_rows[:-1])))
    own = sorted_rows[first]
    size = np.diff(np.append(first, len(rows)))
    g = _sum_runs(_take(grad, order), first, size)
    squares[own] += np.einsum("ij,ij->i", g, g) / g.shape[1]
    used[own] += size
    table[own] -= RATE * g / np.sqrt(squares[own] + 1e-6)[:, None]


def gradient_pass(m: Model, batches: Iterator[tuple[np.ndarray, np.ndarray]], state: list[np.ndarray]) -> None:
    """Gradient steps over (codes, sizes) batches, in place; state: squares and uses of both tables' rows."""
    squares, used, squares_in, used_in = state
    for codes, sizes in batches:
        rows, inside = feature_rows(codes, sizes, m.of_class)
        classes, slots = m.of_class[codes], m.slot[codes]
        for a in range(0, len(codes), STEP):
            b = min(a + STEP, len(codes))
            p, total = _exp(_class_logits(m, rows[:, a:b]))
            p *= (1 / total)[:, None]
            p[np.arange(b - a), classes[a:b]] -= 1
            for r in rows[:, a:b]:
                _descend(m.rows, squares, used, r, p)
            k = np.flatnonzero(slots[a:b] >= 0)
            if len(k):
                p, total = _exp(_inner_logits(m, classes[a:b][k], inside[a:b][k]))
                p *= (1 / total)[:, None]
                p[np.arange(len(k)), slots[a:b][k]] -= 1
                _descend(m.rows_in, squares_in, used_in, inside[a:b][k], p)


def _lexicon(m: Model) -> tuple[Lexicon, int]:
    lexicon = Lexicon((w, i) for i, w in enumerate(m.words))
    return lexicon, lexicon[END]


def train(texts: DataFrame, m: Model, rounds: int = ROUNDS) -> Model:
    """Rounds of distributed gradient passes, which together take each row of column ``text`` once (other columns deal them)."""
    spark = texts.sparkSession
    trainers = max(1, round(m.n / rounds / TRAINER))
    blocks = 16
    order = F.xxhash64(*texts.columns)
    squares = [np.zeros(n, np.float32) for n in (4 * ROWS, INNER_ROWS)]
    for turn in range(rounds):
        shared = sent(spark, (m, squares))  # KNOWN words and fixed tables, whatever the data

        def passes(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            from dataclasses import replace

            from pyspark import TaskContext

            first, before = received(shared)
            own = replace(first, rows=first.rows.copy(), rows_in=first.rows_in.copy())
            lexicon, end = _lexicon(own)
            state = [before[0].copy(), np.zeros(4 * ROWS, np.float32), before[1].copy(), np.zeros(INNER_ROWS, np.float32)]

            def fed():
                for batch in batches:
                    raw = text_bytes(batch.column(0))
                    for a, b in slices([len(t) for t in raw], 1 << 20):
                        yield coded(lexicon, end, raw[a:b])[:2]

            gradient_pass(own, fed(), state)
            trainer = TaskContext.get().partitionId()
            for kind, new, old, square, used in ((0, own.rows, first.rows, state[0] - before[0], state[1]), (1, own.rows_in, first.rows_in, state[2] - before[1], state[3])):
                for k, part in enumerate(np.array_split(np.arange(len(used)), blocks)):
                    at = part[used[part] > 0]  # rows that this trainer moved
                    moved = np.concatenate((used[at, None], (square[at] * used[at])[:, None], (new[at] - old[at]) * used[at, None]), axis=1).astype(np.float32)
                    cols = ([kind * blocks + k], pa.int32()), ([trainer], pa.int32()), ([(at - part[0]).astype(np.int32).tobytes()], pa.binary()), ([moved.tobytes()], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in cols], names=["block", "trainer", "at", "data"])

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for block, at, data in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                    size, width = ((4 * ROWS, CLASSES), (INNER_ROWS, SLOTS))[block // blocks]
                    own = sums.setdefault(block, np.zeros((size // blocks, width + 2), np.float32))
                    own[np.frombuffer(at, np.int32)] += np.frombuffer(data, np.float32).reshape(-1, width + 2)
            for block, x in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["block", "data"])

        own = texts.withColumn("place", order).where(F.pmod("place", F.lit(rounds)) == turn)
        dealt = own.repartitionById(trainers, F.pmod(F.shiftright("place", 8), F.lit(trainers)).cast("int")).sortWithinPartitions("place").select("text")
        moves = dealt.mapInArrow(tidied(passes), "block int, trainer int, at binary, data binary")
        some = moves.repartition(min(partitions(spark), 2 * blocks), "block").sortWithinPartitions("block", "trainer").mapInArrow(tidied(summed), "block int, data binary")
        got = dict((r.block, np.frombuffer(r.data, np.float32)) for r in some.collect())  # the tables' size
        tables = [m.rows.copy(), m.rows_in.copy()]
        for kind, (table, width) in enumerate(zip(tables, (CLASSES, SLOTS), strict=True)):
            parts = [got[kind * blocks + k].reshape(-1, width + 2) for k in range(blocks) if kind * blocks + k in got]
            if parts:
                x = np.concatenate(parts)
                times = np.maximum(x[:, 0], 1)
                squares[kind] = squares[kind] + x[:, 1] / times
                table += x[:, 2:] / times[:, None]
        m = Model(**{**m.__dict__, "rows": tables[0], "rows_in": tables[1]})
        shared.unpersist()
    return m


def score(docs: DataFrame, m: Model, counts: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) for each row of doc_id, text."""
    spark = docs.sparkSession
    shared = sent(spark, m)
    size = float(np.log10(m.base_size))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = received(shared)
        lexicon, end = _lexicon(m)
        for batch in batches:
            raw = text_bytes(batch.column(2))
            for a, b in slices([len(t) for t in raw], 1 << 20):
                codes, sizes, words = coded(lexicon, end, raw[a:b])
                first = np.cumsum(sizes) - sizes
                new = codes >= len(m.words)
                base = np.add.reduceat(m.log_count[codes] - size, first)
                model = np.add.reduceat(log_probabilities(m, codes, sizes), first)
                known = np.add.reduceat(~new, first, dtype=np.int64)
                missing = [[w for w, x in zip(own, new[f : f + len(own)].tolist(), strict=True) if x] if k < n else [] for own, f, k, n in zip(words, first.tolist(), known.tolist(), sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], pa.array(sizes), pa.array(known), pa.array(base), pa.array(model), pa.array(missing, pa.list_(pa.binary()))], names=names)

    names = ["doc_id", "rid", "n_tokens", "known", "base", "model", "missing"]
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("\0")), F.coalesce("text", F.lit("\0")))
    made = written(docs.select("doc_id", key.alias("rid"), "text").mapInArrow(tidied(scored), "doc_id long, rid long, n_tokens long, known long, base double, model double, missing array<binary>"), "scores")
    other = made.where("size(missing) > 0").dropDuplicates(["rid"]).select("rid", F.explode("missing").alias("word"))
    added = other.join(counts, "word").groupBy("rid").agg(F.count(F.lit(1)).alias("more"), F.sum(F.log10(F.col("c") + 1)).alias("gain"))
    gain = F.coalesce("gain", F.lit(0.0))
    return made.join(added, "rid", "left").select("doc_id", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), (F.col("base") + gain).alias("base_score"), (F.col("model") + gain).alias("score"))


def fit_and_score(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of all rows by a model of those where the boolean column expression ``held_out`` is false."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), held_out.alias("held_out"))
    own = rows.where(~F.col("held_out"))
    counts = written(count_words(own), "counts")
    m = untrained(counts)
    if m.n:
        m = train(own.select("doc_id", "text"), m)
    return score(rows, m, counts).withColumn("train_tokens", F.lit(m.n).cast("long"))
