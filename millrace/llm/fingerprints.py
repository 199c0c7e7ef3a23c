"""SimHash document fingerprints, and a search for all within a Hamming radius.

A fingerprint has 128 bits, written as 32 hexadecimal digits. Terms are the
words, word pairs and word triples of a text (runs without white space, A-Z
lower-cased), each as often as it occurs, weighted by ``WEIGHTS``; a term's hash
votes +weight or -weight on each bit, and the bit is set where the sum is over
zero. Triples weigh most: they tell texts of one language apart, whose single
words are much the same.

``near`` finds all pairs within a radius by permuted block tables: fingerprints
are cut into blocks, and each table brings another choice of blocks to the front
as its key; a pair within the radius agrees on some choice. Equal fingerprints
are one entry, and the pairs of a table stream from key-sorted runs.

Defined results: null and empty texts have the all-zero fingerprint; a text of
fewer words than a term has gives no term of that kind; repeated rows get equal
fingerprints; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import partitions
from millrace.llm.textops import ASCII_LOWER, Words, bit_sums, mix, shingle_index, slices, text_bytes

#: Votes of a single word, a pair and a triple of words.
WEIGHTS = (1, 2, 4)
#: Terms whose bits are laid out at once.
STEP = 1 << 16
#: Fingerprints of one key from which it is cut into chunks.
RUN = 4096
_U = np.uint64


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """An (n, 2) array of unsigned 64-bit halves."""
    votes = np.zeros((len(texts), 128), dtype=np.int64)
    for a, b in slices([len(t) for t in texts]):
        words = Words([t.translate(ASCII_LOWER) for t in texts[a:b]])
        h = words.hashes()
        for size, weight in enumerate(WEIGHTS, 1):
            at, text = shingle_index(words.first, size)
            term = h[at]
            for k in range(1, size):
                term = mix(term * _U(3) + h[at + k])
            _vote(votes[a:b], term, text, weight)
    bits = np.packbits(votes > 0, axis=1, bitorder="little").reshape(-1)
    return bits.view(_U).reshape(-1, 2)


def _vote(votes: np.ndarray, term: np.ndarray, text: np.ndarray, weight: int) -> None:
    for a in range(0, len(term), STEP):
        part, owner = term[a : a + STEP], text[a : a + STEP]
        both = np.stack((part, mix(part + _U(0x632BE59BD9B4E019))), axis=1)
        bits = np.unpackbits(both.view(np.uint8), axis=1, bitorder="little")
        begin = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        size = np.diff(np.concatenate((begin, [len(owner)])))
        ones = np.stack([bit_sums(bits[x : x + n]) for x, n in zip(begin.tolist(), size.tolist(), strict=True)])
        votes[owner[begin]] += weight * (2 * ones - size[:, None])


def hexed(prints: np.ndarray) -> list[str]:
    return [f"{hi:016x}{lo:016x}" for lo, hi in prints.tolist()]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bits, 0 to 1."""
    return 1.0 - np.bitwise_count(a ^ b).sum(1) / 128.0


def fingerprint(text: Column) -> Column:
    """Hexadecimal fingerprint of a text column."""

    @F.arrow_udf("string")
    def marks(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array(hexed(fingerprints(text_bytes(column))), type=pa.string())

    return marks(text)


def block_masks(radius: int, blocks: int | None, key_blocks: int) -> np.ndarray:
    """Bits of each table's key, as 64-bit halves."""
    blocks = blocks or radius + key_blocks
    if blocks < radius + key_blocks:
        raise ValueError("too few blocks for this radius")
    cuts = [128 * i // blocks for i in range(blocks + 1)]
    tables = combinations(range(blocks), key_blocks)
    return np.array([[sum(((1 << cuts[c + 1]) - (1 << cuts[c])) >> half & ((1 << 64) - 1) for c in t) for half in (0, 64)] for t in tables], dtype=_U)


def _permuted(masks: np.ndarray):
    """Each row's entries, table by table: (tab, key) and the row, whose first column is its fingerprint."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = _halves(batch.column(0).to_pylist())
            for n, mask in enumerate(masks):
                key = mix(mix(fp[:, 0] & mask[0]) + mix((fp[:, 1] & mask[1]) + _U(n + 1)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), n, np.int32)), pa.array(key.view(np.int64)), *batch.columns], names=["tab", "key", *batch.schema.names])

    return entries


def _hits(x: np.ndarray, masks: np.ndarray, tab: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(whether, distance) for differences x of rows that meet in table ``tab``: within the radius, and met in none before."""
    distance = np.bitwise_count(x).sum(1)
    ok = (distance <= radius) & ((x & masks[tab]) == 0).all(1)
    for earlier in masks[:tab]:
        ok &= ((x & earlier) != 0).any(1)
    return ok, distance


def near_counts(prints: DataFrame, queries: DataFrame, radius: int, blocks: int | None = None, key_blocks: int = 1, fp_col: str = "fingerprint") -> DataFrame:
    """(fp, n_near) for each distinct fingerprint of ``queries``: rows of ``prints`` within ``radius`` bits of it.

    Only keys that a query has are looked at, and a run yields one sum a query,
    never its pairs. Null fingerprints count nowhere.
    """
    masks = block_masks(radius, blocks, key_blocks)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rows = None, []

        def out():
            halves, n = _halves([r[0] for r in rows]), np.array([r[1] for r in rows], np.int64)  # a query away from its chunk counts 0
            asked = [i for i, r in enumerate(rows) if r[2]]
            found = [int(n[_hits(halves ^ halves[i], masks, own[0], radius)[0]].sum()) for i in asked]
            return pa.RecordBatch.from_arrays([pa.array([rows[i][0] for i in asked], pa.string()), pa.array(found, pa.int64())], names=["fp", "n"])

        for batch in batches:
            for tab, key, part, fp, n, asks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (tab, key, part) != own:
                    if rows:
                        yield out()
                    own, rows = (tab, key, part), []
                rows.append((fp, n, asks))
        if rows:
            yield out()

    asked = queries.select(F.col(fp_col).alias("fp")).where("fp is not null").distinct().withColumn("asks", F.lit(True))
    counted = prints.select(F.col(fp_col).alias("fp")).where("fp is not null").groupBy("fp").agg(F.count(F.lit(1)).alias("n"))
    every = asked.join(counted, "fp", "full").select("fp", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("asks", F.lit(False)).alias("asks"))
    entries = every.mapInArrow(_permuted(masks), "tab int, key long, fp string, n long, asks boolean")
    # keys of many fingerprints are cut into chunks, each of which meets all queries of the key
    wanted = entries.groupBy("tab", "key").agg(F.max("asks").alias("asked"), F.ceil(F.count(F.lit(1)) / RUN).cast("int").alias("chunks")).where("asked").drop("asked")
    chunk = F.pmod(F.hash("fp"), F.col("chunks"))
    parts = F.when(F.col("asks"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(chunk))
    dealt = entries.join(wanted, ["tab", "key"]).withColumn("chunk", chunk).withColumn("part", F.explode(parts))
    own = dealt.select("tab", "key", "part", "fp", F.when(F.col("part") == F.col("chunk"), F.col("n")).otherwise(0).alias("n"), "asks")
    met = own.repartition(partitions(prints.sparkSession), "tab", "key", "part").sortWithinPartitions("tab", "key", "part", "fp")
    return met.mapInArrow(summed, "fp string, n long").groupBy("fp").agg(F.sum("n").alias("n_near"))


def near(prints: DataFrame, radius: int, blocks: int | None = None, key_blocks: int = 1, fp_col: str = "fingerprint") -> DataFrame:
    """(a, b, distance) for all pairs a < b of distinct hexadecimal fingerprints within ``radius`` bits.

    ``blocks`` (default: radius + key_blocks) must be at least radius +
    key_blocks: then some choice of ``key_blocks`` blocks is free of differences.
    Each pair is told by the first table that holds it, once.
    """
    masks = block_masks(radius, blocks, key_blocks)
    permuted = _permuted(masks)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run: list[str] = []
        own, halves = None, np.empty((0, 2), _U)
        for batch in batches:
            for tab, key, fp in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (tab, key) != own:
                    own, run, halves = (tab, key), [], np.empty((64, 2), _U)
                me = _halves([fp])[0]
                if run:
                    ok, distance = _hits(halves[: len(run)] ^ me, masks, tab, radius)
                    hit = np.flatnonzero(ok).tolist()
                    if hit:
                        yield pa.RecordBatch.from_arrays([pa.array([run[i] for i in hit]), pa.array([fp] * len(hit)), pa.array(distance[hit].astype(np.int32))], names=["a", "b", "distance"])
                if len(run) == len(halves):
                    halves = np.concatenate((halves, np.empty_like(halves)))
                halves[len(run)] = me
                run.append(fp)

    distinct = prints.select(F.col(fp_col).alias("fp")).where("fp is not null").distinct()
    entries = distinct.mapInArrow(permuted, "tab int, key long, fp string")
    shared = entries.groupBy("tab", "key").count().where("count > 1").select("tab", "key")
    return entries.join(shared, ["tab", "key"]).repartition(partitions(prints.sparkSession), "tab", "key").sortWithinPartitions("tab", "key", "fp").mapInArrow(met, "a string, b string, distance int")


def _halves(fps: list[str]) -> np.ndarray:
    raw = b"".join(bytes.fromhex(x)[::-1] for x in fps)
    return np.frombuffer(raw, dtype=_U).reshape(-1, 2)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(at, guest, doc_id, text): every row in runs by descending id, each run ended by the head of the following one.

    Ids are cut into as many ranges as there are partitions, by quantiles of the
    ids alone. The first row of each range goes along with the range before it
    as its guest (that of the first range with the last one), so that a task sees
    each row's next one without a global sort in one task. Rows of equal id are
    ordered by their text; null ids come last.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    bounds = sorted(set(rows.where("doc_id is not null").approxQuantile("doc_id", [i / n for i in range(1, n)], 0.25 / n)), reverse=True)
    edges = np.array([-x for x in bounds], dtype=np.float64)

    @F.arrow_udf("int")
    def range_of(ids: pa.Array) -> pa.Array:
        x = ids.cast(pa.float64(), safe=False).fill_null(float("-inf")).to_numpy(zero_copy_only=False)
        return pa.array(np.searchsorted(edges, -x, side="left").astype(np.int32))

    ranged = rows.withColumn("bin", range_of("doc_id"))
    # one row a range: its first id
    heads = sorted(ranged.groupBy("bin").agg(F.max("doc_id").alias("head")).collect(), key=lambda r: r.bin)
    order = [r.bin for r in heads]
    before = dict(zip(order, [order[-1], *order[:-1]], strict=True)) if order else {}
    named = [F.lit(x) for r in heads if r.head is not None for x in (r.head, before[r.bin])]
    nulls = [F.when(F.col("doc_id").isNull(), F.lit(before[r.bin])) for r in heads if r.head is None]  # a range of null ids alone
    guests = F.coalesce(*([F.create_map(*named)[F.col("doc_id")]] if named else []), *nulls, F.lit(None).cast("int"))
    places = F.array(F.struct(F.col("bin").alias("at"), F.lit(False).alias("guest")), F.struct(guests.alias("at"), F.lit(True).alias("guest")))
    dealt = ranged.withColumn("place", F.explode(F.filter(places, lambda p: p["at"].isNotNull()))).select("place.at", "place.guest", "doc_id", "text")
    return dealt.repartitionById(n, F.col("at")).sortWithinPartitions("at", "guest", F.desc_nulls_last("doc_id"), "text")


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint, that of its edited text, and its likeness to that and to the next document's.

    Edited: the last floor(n / 3) of its n code points give way to as many first
    ones (or all) of the next document by descending id; the last one's next is the first.
    """
    names = ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    sorted_rows = with_next(docs, id_col, text_col)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _paired(batches):
            ids = [k for k, _, _ in part]
            own, nexts = [t for _, t, _ in part], [x for _, _, x in part]
            edited = [(t[: len(t) - len(t) // 3] + x[: len(t) // 3]) for t, x in zip(own, nexts, strict=True)]
            raw = [e.encode() for e in edited]
            # a document's next one is the following row, save after the last of the part
            a, e = fingerprints([t.encode() for t in [*own, nexts[-1]]]), fingerprints(raw)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(t) for t in own], pa.int64()), pa.array(raw, pa.binary()).cast(pa.string()), pa.array(hexed(a[:-1])), pa.array(hexed(e)), pa.array(likeness(a[:-1], e)), pa.array(likeness(a[:-1], a[1:]))], names=names)

    return sorted_rows.mapInArrow(compare, "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _paired(batches: Iterator[pa.RecordBatch], chars: int = 4 << 20) -> Iterator[list[tuple[int, str, str]]]:
    """Lists of (id, text, next text) over consecutive rows of one range."""
    part, size, hold = [], 0, None
    for batch in batches:
        for at, guest, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            text = text or ""
            if hold is not None and hold[0] == at:
                part.append((hold[1], hold[2], text))
                size += len(hold[2])
                if guest or size >= chars:
                    yield part
                    part, size = [], 0
            hold = None if guest else (at, key, text)  # further guests of a range share the head's id and come after it
    if part:
        yield part
