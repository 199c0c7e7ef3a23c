"""SimHash near-duplicate groups with pigeonring filtering.

A 64-bit fingerprint is cut into m consecutive segments. If two fingerprints
differ in at most r bits, then for some segment i every chain of l segments that
starts there differs in at most floor(l r / m) bits (the pigeonring principle:
the differences stand on a ring, and some start keeps all running sums within
the proportional budget). Candidates meet on the chain's first segment; the
running sums of the longer chains prune them before the full Hamming check.
Where a first segment may differ in up to two bits, both sides are entered under
the segment and its one-bit changes, which meet within two bits.

A run of fingerprints with one key yields a spanning forest, not all its pairs:
a breadth-first walk takes from those not yet reached what lies within r of the
next one, so a dense group costs about its size. Runs above ``RUN`` fingerprints
are cut into chunks, each pair of which is a run; where r is 2 there is an exact
way in linear time instead: two fingerprints differ in
at most 2 bits exactly if both are within one bit of a common value, so each is
entered under itself and its 64 one-bit changes, and a value links its smallest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.graph import components
from millrace.llm.shared import chunk_pairs, free_name, partitions, written
from millrace.llm.textops import ASCII_LOWER, Words, bit_sums, mix, text_bytes, window_hashes

#: Fingerprints under one key from which the linear way takes over.
RUN = 4096
_U = np.uint64


def shingle_fingerprints(texts: list[bytes], words: int) -> np.ndarray:
    """Unsigned 64-bit SimHash of each text: words are lower-cased (A-Z) runs without white space, terms their shingles of
    ``words`` words with repeats (fewer words: the whole sequence), each term's XXH64 with seed 42 a vote; a bit is set if
    it is in over half the votes. A text without words has fingerprint zero."""
    from xxhash import xxh64_intdigest

    out = np.zeros(len(texts), dtype=_U)
    for i, text in enumerate(texts):
        parts = text.translate(ASCII_LOWER).split()
        if not parts:
            continue
        line = b" ".join(parts)
        if len(parts) <= words:
            out[i] = xxh64_intdigest(line, 42)
            continue
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
        starts = [0, *ends[: -words].tolist()]
        stops = (ends[words - 1 :] - 1).tolist()
        half, total = len(starts), np.zeros(64, np.int64)
        for a in range(0, half, 1 << 16):
            votes = np.fromiter((xxh64_intdigest(line[x:y], 42) for x, y in zip(starts[a : a + (1 << 16)], stops[a : a + (1 << 16)], strict=True)), _U)
            total += bit_sums(np.unpackbits(votes.view(np.uint8), bitorder="little").reshape(-1, 64))
        out[i] = np.packbits(total * 2 > half, bitorder="little").view(_U)[0]
    return out


def fingerprint(text: Column, words: int = 3) -> Column:
    """Fingerprint of a text column as a long with the same 64 bits; null counts as empty."""

    @F.arrow_udf("long")
    def marks(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array(shingle_fingerprints(text_bytes(column), words).view(np.int64))

    return marks(text)


def _segments(m: int) -> list[tuple[int, int]]:
    """(shift, bits) of m segments of 64 bits."""
    cuts = [64 * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def chain_ok(x: np.ndarray, start: int, radius: int, m: int) -> np.ndarray:
    """Whether the differing bits ``x`` keep every chain from segment ``start`` within its budget."""
    cuts, total, ok = _segments(m), np.zeros(len(x), np.int64), np.ones(len(x), bool)
    for length in range(1, m + 1):
        shift, bits = cuts[(start + length - 1) % m]
        total += np.bitwise_count((x >> _U(shift)) & _U((1 << bits) - 1))
        ok &= total <= length * radius // m
    return ok


def run_links(prints: np.ndarray, start: int, radius: int, m: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of distinct ``prints`` that pass the chain from ``start`` (places in prints)."""
    left, links = np.arange(len(prints)), []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = chain_ok(prints[left] ^ prints[at], start, radius, m)
            got = left[near]
            links += [(at, int(x)) for x in got]
            queue += got.tolist()
            left = left[~near]
    return links


def links(prints: DataFrame, radius: int = 2, segments: int = 3) -> DataFrame:
    """Links (a, b) over distinct fingerprints, column ``fp`` (long), whose components are those of all pairs within
    ``radius`` bits. Chain budgets must leave two bits at most to a first segment. Null fingerprints link to nothing."""
    loose = radius // segments
    if loose > 2:
        raise ValueError("too few segments for this radius")
    spark, cuts = prints.sparkSession, _segments(segments)
    fp = prints.select("fp").where("fp is not null").distinct()
    keys = []
    for i, (shift, bits) in enumerate(cuts):
        own = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << bits) - 1))
        some = [own] + [own.bitwiseXOR(F.lit(1 << b)) for b in range(bits if loose else 0)]
        keys += [v * F.lit(segments) + F.lit(i) for v in some]
    entered = fp.select("fp", F.explode(F.array(*keys)).alias("key"))
    hot = entered.groupBy("key").count().where(f"count > {RUN}").select("key", F.ceil(F.col("count") / RUN).cast("int").alias("chunks"))
    tagged = entered.join(hot, "key", "left")
    exact = radius == 2
    if exact:
        shared = tagged.where("chunks is null").select("key", F.lit(0).alias("part"), "fp")
    else:
        shared = tagged.withColumn("chunks", F.coalesce("chunks", F.lit(1))).select("key", F.explode(chunk_pairs("fp", "chunks")).alias("part"), "fp")

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = tuple(np.empty(0, np.int64) for _ in range(3))
        for batch in _ended(batches):
            rows = rest
            if batch is not None:
                rows = tuple(np.concatenate((r, c.to_numpy().astype(np.int64))) for r, c in zip(rest, batch.columns, strict=True))
            key, part, value = rows
            new = np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1
            cut = len(key) if batch is None else int(new[-1]) if len(new) else 0  # the last run may go on
            rest = tuple(r[cut:] for r in rows)
            if not cut:
                continue
            key, value = key[:cut], value[:cut]
            edge = np.concatenate(([0], new[new < cut], [cut]))
            size = np.diff(edge)
            a_out, b_out = [], []
            pair = edge[:-1][size == 2]
            x, y = value[pair].view(_U), value[pair + 1].view(_U)
            for i in range(segments):
                k = np.flatnonzero(key[pair] % segments == i)
                k = k[chain_ok(x[k] ^ y[k], i, radius, segments)]
                a_out.append(x[k])
                b_out.append(y[k])
            for e, n in zip(edge[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
                run = value[e : e + n].view(_U)
                if got := run_links(run, int(key[e] % segments), radius, segments):
                    got = np.array(got)
                    a_out.append(run[got[:, 0]])
                    b_out.append(run[got[:, 1]])
            if a_out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v).view(np.int64)) for v in (a_out, b_out)], names=["a", "b"])

    found = shared.repartition(partitions(spark), "key", "part").sortWithinPartitions("key", "part", "fp").mapInArrow(forest, "a long, b long")
    if exact:
        crowded = tagged.where("chunks is not null").select("fp").distinct()
        near = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.shiftleft(F.lit(1).cast("long"), b)) for b in range(64)])
        met = crowded.select("fp", F.explode(near).alias("value"))
        hubs = met.groupBy("value").agg(F.min("fp").alias("b"))
        found = found.unionByName(met.join(hubs, "value").where("fp <> b").select(F.col("fp").alias("a"), "b"))
    return found


def _ended(batches):
    yield from batches
    yield None


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2, segments: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): each row's fingerprint and the smallest id among the documents reachable by links.

    Null and wordless texts have fingerprint zero and are linked like any other;
    equal texts share a group; a null id counts for no minimum (a group of null
    ids alone has a null component); repeated ids are kept as rows; columns other
    than the two named are not read; an empty table gives no rows.
    """
    marks = written(docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col), words).alias("fp")), "prints")
    distinct = marks.groupBy("fp").agg(F.min("doc_id").alias("low"))
    joined = components(links(distinct, radius, segments))
    member = distinct.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
    group = member.groupBy("component").agg(F.min("low").alias("component_id"))
    label = member.join(group, "component").select("fp", "component_id")
    return marks.join(label, "fp").select("doc_id", "fp", "component_id")


#: Distinct texts of one fingerprint component that a task compares at most; larger ones are cut into pairs of chunks.
CHUNK = 512


def shingle_set(text: str, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``words`` words, of lower-cased (A-Z) words; of fewer words, the whole sequence."""
    own = Words([text.encode().translate(ASCII_LOWER)])
    return np.unique(window_hashes(own.hashes(), min(words, max(1, len(own)))))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Shared share of two sorted sets; two empty ones are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


#: Radius of the pigeonring search where similarity alone counts.
CLOSE = 2
#: Bands of minima of shingle hashes, and minima a band.
BANDS, WIDTH = 24, 5


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """BANDS keys of a set of hashes; two sets share a band's with the chance of their Jaccard similarity to the power of
    WIDTH: at 0.8, 1 of 14 000 pairs shares none. Empty sets share all."""
    odd = np.random.default_rng(5).integers(0, 1 << 63, BANDS * WIDTH, dtype=_U) * _U(2) + _U(1)
    least = np.array([(shingles * m).min() if len(shingles) else _U(0) for m in odd], _U).reshape(BANDS, WIDTH)
    key = np.arange(BANDS, dtype=_U)
    for column in least.T:
        key = mix(key * _U(31) + column)
    return key


def band_links(docs: DataFrame, text_col: str, words: int) -> DataFrame:
    """Links (a, b) of text keys, whose components hold all pairs of texts that share a band."""

    @F.arrow_udf("array<long>")
    def keys(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            made = [band_keys(shingle_set(x.as_py() or "", words)).view(np.int64) for x in column]
            yield pa.array(made, pa.list_(pa.int64()))

    entered = written(docs.select(F.xxhash64(text_col).alias("a"), keys(F.col(text_col)).alias("keys")), "bands").select("a", F.explode("keys").alias("key"))
    hubs = entered.groupBy("key").agg(F.min("a").alias("b"), F.max("a").alias("most")).where("b <> most").select("key", "b")
    return entered.join(written(hubs, "hubs"), "key").where("a <> b").select("a", "b")


def print_links(nodes: DataFrame, radius: int, segments: int) -> DataFrame:
    """Links (a, b) of text keys (``nodes``: text_key, fp), whose components hold all pairs of texts within ``radius`` bits."""
    first = written(nodes.groupBy("fp").agg(F.min("text_key").alias("b")), "firsts")
    same = nodes.join(first, "fp").select(F.col("text_key").alias("a"), "b")
    ends = [first.select(F.col("fp").alias(fp), F.col("b").alias(key)) for fp, key in (("a", "x"), ("b", "y"))]
    apart = links(first.select("fp"), radius, segments).join(ends[0], "a").join(ends[1], "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return same.unionByName(apart)


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int | None = 8, segments: int = 3, check_words: int = 5, similar: float = 0.8) -> DataFrame:
    """(text_key, keep_id, keep_key) for every distinct text: the document that stays of its group.

    Distinct texts are linked if their fingerprints are within ``radius`` bits
    (found by pigeonring filtering) and the Jaccard similarity of their shingles of
    ``check_words`` words is at least ``similar``. Without a radius (None) the latter
    alone counts: pairs are found by pigeonring filtering within ``CLOSE`` bits and,
    since pairs of that similarity differ in far more, by ``band_keys``. text_key is xxhash64 of the text
    (null: of nothing); of each connected group the row with the least (id, key)
    stays, null ids first. Wordless texts are alike; the empty table has no groups.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), fingerprint(F.col(text_col), words).alias("fp"))
    nodes = written(rows.groupBy("text_key", "fp").agg(F.min(F.struct("doc_id")).alias("low")), "texts")
    if radius is None:
        met = print_links(nodes.select("text_key", "fp"), CLOSE, 3).unionByName(band_links(docs, text_col, check_words))
        placed = nodes.select("text_key", "fp").join(components(met).withColumnRenamed("node", "text_key"), "text_key")
    else:
        joined = components(links(nodes, radius, segments)).withColumnRenamed("node", "fp")
        placed = nodes.select("text_key", "fp").join(joined, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    sizes = placed.groupBy("component").count().where("count > 1").select("component", F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks"))
    wanted = written(placed.join(sizes, "component").select("text_key", "fp", "component", chunk_pairs("text_key", "chunks").alias("parts")), "wanted")
    texts = docs.select(F.xxhash64(text_col).alias("text_key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt = texts.join(wanted, "text_key").dropDuplicates(["text_key"]).select("component", F.explode("parts").alias("part"), "text_key", "fp", "text")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, keys, prints, sets = None, [], [], []

        def found():
            at, left, pairs = np.array(prints, np.int64).view(_U), np.arange(len(keys)), []
            while len(left):
                queue, left = [int(left[0])], left[1:]
                while queue and len(left):
                    one = queue.pop()
                    near = np.bitwise_count(at[left] ^ at[one]) <= (64 if radius is None else radius)
                    for k in np.flatnonzero(near).tolist():
                        near[k] = jaccard(sets[one], sets[left[k]]) >= similar
                    got = left[near].tolist()
                    pairs += [(keys[one], keys[x]) for x in got]
                    queue += got
                    left = left[~near]
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for component, part, key, fp, text in zip(*batch.columns, strict=True):
                tag = (component.as_py(), part.as_py())
                if tag != own:
                    if len(keys) > 1:
                        yield found()
                    own, keys, prints, sets = tag, [], [], []
                keys.append(key.as_py())
                prints.append(fp.as_py())
                sets.append(shingle_set(text.as_py(), check_words))
        if len(keys) > 1:
            yield found()

    n = partitions(docs.sparkSession)
    verified = components(dealt.repartition(n, "component", "part").sortWithinPartitions("component", "part", "text_key").mapInArrow(compared, "a long, b long"))
    group = nodes.join(verified.withColumnsRenamed({"node": "text_key", "component": "group"}), "text_key", "left").select("text_key", F.coalesce("group", "text_key").alias("group"), F.struct(F.col("low.doc_id").alias("keep_id"), F.col("text_key").alias("keep_key")).alias("first"))
    keep = group.groupBy("group").agg(F.min("first").alias("keep"))
    return group.join(keep, "group").select("text_key", "keep.keep_id", "keep.keep_key")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs without all but one row of each group of ``similar_groups``, columns unchanged."""
    key, own = (free_name(docs, n) for n in ("text_key", "id_key"))
    groups = similar_groups(docs, id_col, text_col, **how)
    id_key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\0"))
    keep = groups.select(F.col("keep_key").alias(key), id_key("keep_id").alias(own)).distinct()
    # by id and text, so that copies of one text are not all of them one task's rows
    rows = docs.withColumns({key: F.xxhash64(text_col), own: id_key(id_col)})
    return rows.join(keep, [key, own], "left_semi").dropDuplicates([key, own]).select(*docs.columns)
