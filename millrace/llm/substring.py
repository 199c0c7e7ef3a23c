"""Substring dedup: suffix automata of reference passages and matching statistics.

A window is ``WINDOW`` consecutive words of one document; a word is removed if a
window that covers it has the words of a window that starts in a document with a
smaller id. Where the reference is the corpus itself, sending the automata of all
its shards to all documents would cost the square of the corpus and broadcast
data without a bound. So shards are cut by content, and each meets only the
passages that can match it:

1.  Each window picks an anchor: of its ``GRAM``-word grams the one with the
    least hash. Equal windows pick equal anchors. The windows of one anchor
    occurrence are neighbours, together a passage. An anchor that stands in one
    document alone can match nothing and is dropped.
2.  Equal passages of an anchor (told by 128-bit digests of their words) are one
    entry of its reference, held by the smallest id. If there is no other entry, the passage's copies match it whole.
3.  Otherwise the entries form a shard: in ascending id order each is streamed
    through the suffix automaton of those before it, and its matching statistics
    (the longest match that ends at each word) of ``WINDOW`` or more mark its
    windows; then the automaton is extended by it.
4.  Anchors with more than ``HOT`` occurrences and several entries would make an
    unbounded shard. The windows of their entries are compared one by one, as
    128-bit digests, by a grouped minimum, which Spark aggregates before it shuffles.

Defined results: a null text has no words; documents with a null id are kept
whole and are no reference; rows of one id do not match each other; equal rows
get equal results; very long texts are taken whole; the input's other columns do
not matter; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import partitions, written
from millrace.llm.textops import Words, shingle_index, slices, text_bytes, window_hashes

WINDOW, GRAM, HOT = 50, 10, 2048
_PLACE = np.uint64((1 << 28) - 1)
_U = np.uint64


class SuffixAutomaton:
    """Of several word sequences; states hold the longest length, a link and word transitions."""

    def __init__(self):
        self.longest, self.link, self.next = [0], [-1], [{}]

    def add(self, words) -> None:
        """Extend by a sequence (matches never run over the end of one)."""
        longest, link, nxt = self.longest, self.link, self.next
        last = 0
        for w in words:
            have = nxt[last].get(w)
            if have is not None:
                if longest[have] == longest[last] + 1:
                    last = have
                    continue
                last = self._split(last, w, have)
                continue
            cur = len(longest)
            longest.append(longest[last] + 1)
            link.append(0)
            nxt.append({})
            p = last
            while p != -1 and w not in nxt[p]:
                nxt[p][w] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][w]
                link[cur] = q if longest[p] + 1 == longest[q] else self._split(p, w, q)
            last = cur

    def _split(self, p: int, w, q: int) -> int:
        clone = len(self.longest)
        self.longest.append(self.longest[p] + 1)
        self.link.append(self.link[q])
        self.next.append(dict(self.next[q]))
        self.link[q] = clone
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def matches(self, words) -> Iterator[int]:
        """Matching statistics: the length of the longest match that ends at each word."""
        longest, link, nxt = self.longest, self.link, self.next
        state = length = 0
        for w in words:
            while state and w not in nxt[state]:
                state = link[state]
                length = longest[state]
            if w in nxt[state]:
                state = nxt[state][w]
                length += 1
            else:
                length = 0
            yield length


def marked_windows(entries: list[tuple[int, list[bytes]]], window: int) -> list[list[int]]:
    """For entries (id, words) by ascending id: the windows (first words' places) that also start in an entry of a smaller id."""
    automaton, out, waiting, own = SuffixAutomaton(), [], [], None
    for key, words in entries:
        if key != own:
            for w in waiting:
                automaton.add(w)
            waiting, own = [], key
        hit = [i - window + 1 for i, n in enumerate(automaton.matches(words)) if n >= window]
        if len(hit) < len(words) - window + 1:
            waiting.append(words)
        out.append(hit)
    return out


def digests(parts: list[bytes]) -> np.ndarray:
    """(n, 2) 64-bit halves of 128-bit digests: what stands for a passage where its words are not compared themselves."""
    from xxhash import xxh3_128_digest

    return np.frombuffer(b"".join(map(xxh3_128_digest, parts)), "<i8").reshape(-1, 2)


def _anchors(words: Words, window: int, gram: int):
    """Of each anchor occurrence: text, first window (word index), number of windows, anchor hash, passage digest (two columns)."""
    start, text = shingle_index(words.first, window)
    if not len(start):
        z = np.empty(0, np.int64)
        return z, z, z, z, np.empty((0, 2), np.int64)
    g = window_hashes(words.hashes(), gram)
    low = (g & ~_PLACE) | np.arange(len(g), dtype=_U)
    width, span = window - gram + 1, 1
    best = low
    while span * 2 <= width:  # least of 1, 2, 4 ... neighbours
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    rest = width - span
    best = np.minimum(best[: len(best) - rest], best[rest:]) if rest else best
    at = (best[start] & _PLACE).astype(np.int64)
    new = np.concatenate(([True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])))
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(start)))
    first = start[head]
    ends = words.end[first + count + window - 2]
    passage = digests([words.buf[x:y] for x, y in zip(words.start[first].tolist(), ends.tolist(), strict=True)])
    return text[head], first, count, g[at[head]].view(np.int64), passage


def removed_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(doc_id, text_key, spans) of documents with words to remove: ranges (a, b) of word places, b not included; they may overlap.

    ``docs`` has doc_id (long) and text; text_key is xxhash64 of the text, which tells rows of one id apart.
    """
    keyed = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    reach = window - 1

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, texts = (batch.column(i) for i in range(3))
            ids, keys, texts = ids.to_numpy(), keys.to_numpy(), text_bytes(texts)
            for a, b in slices([len(t) for t in texts]):
                words = Words([b" ".join(t.split()) for t in texts[a:b]])
                text, first, count, g, passage = _anchors(words, window, gram)
                cols = (ids[a:b][text], keys[a:b][text], (first - words.first[text]).astype(np.int32), count.astype(np.int32), g, *passage.T)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["doc_id", "text_key", "at", "n", "g", "passage", "passage2"])

    found = written(keyed.mapInArrow(occurrences, "doc_id long, text_key long, at int, n int, g long, passage long, passage2 long"), "anchors")
    stats = found.groupBy("g").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), *[f(c).alias(f"{n}_{c}") for c in ("passage", "passage2") for n, f in (("low", F.min), ("high", F.max))], F.count(F.lit(1)).alias("times"))
    alike = (F.col("low_passage") == F.col("high_passage")) & (F.col("low_passage2") == F.col("high_passage2"))
    # a table of its own, so that adaptive execution can split the occurrences of a hot anchor over tasks
    kinds = written(stats.where("low < high").select("g", "low", F.when(alike, 0).when(F.col("times") <= hot, 1).otherwise(2).alias("kind")), "kinds")
    shared = written(found.join(kinds, "g"), "shared")

    whole = shared.where("kind = 0 and doc_id > low").select("doc_id", "text_key", F.col("at").alias("a"), (F.col("at") + F.col("n") + reach).alias("b"))

    listed = shared.where("kind > 0").groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("at", "n", "g", "passage", "passage2", "kind")).alias("places"))

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        sent: set = set()
        for batch in batches:
            for doc, key, text, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = text.encode()
                words = raw.split()
                rows = {k: [] for k in ("g", "passage", "passage2", "content", "hashes")}
                for p in places:
                    if len(sent) > 1 << 20:
                        sent.clear()
                    tag, at, n = (p["g"], p["passage"], p["passage2"]), p["at"], p["n"]
                    fresh = tag not in sent
                    sent.add(tag)
                    for k, x in zip(("g", "passage", "passage2"), tag, strict=True):
                        rows[k].append(x)
                    rows["content"].append(b" ".join(words[at : at + n + reach]) if fresh and p["kind"] == 1 else None)
                    rows["hashes"].append([xxh3_128_digest(b" ".join(words[i : i + window])) for i in range(at, at + n)] if fresh and p["kind"] == 2 else None)
                cols = [pa.array([doc] * len(rows["g"]), pa.int64()), *(pa.array(rows[k], pa.int64()) for k in ("g", "passage", "passage2")), pa.array(rows["content"], pa.binary()), pa.array(rows["hashes"], pa.list_(pa.binary()))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *rows])

    sent = keyed.join(listed, ["doc_id", "text_key"]).select("doc_id", "text_key", "text", "places").mapInArrow(passages, "doc_id long, g long, passage long, passage2 long, content binary, hashes array<binary>")
    own = ["g", "passage", "passage2"]
    entries = written(sent.groupBy(*own).agg(F.min("doc_id").alias("low"), F.max("content").alias("content"), F.max("hashes").alias("hashes")), "entries")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rows = None, []

        def done():
            marks = marked_windows([(low, content.split(b" ")) for *_, low, content in rows], window)
            return pa.RecordBatch.from_arrays([pa.array([own] * len(rows), pa.int64()), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(3)), pa.array(marks, pa.list_(pa.int32()))], names=["g", "passage", "passage2", "low", "marks"])

        for batch in batches:
            for g, *entry in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g != own:
                    if rows:
                        yield done()
                    own, rows = g, []
                rows.append(entry)
        if rows:
            yield done()

    n = partitions(docs.sparkSession)
    walked = entries.where("content is not null").select(*own, "low", "content").repartition(n, "g").sortWithinPartitions("g", "low", "passage", "passage2").mapInArrow(shards, "g long, passage long, passage2 long, low long, marks array<int>")

    single = entries.where("hashes is not null").select(*own, "low", F.posexplode("hashes").alias("m", "window"))
    least = single.groupBy("window").agg(F.min("low").alias("least"))
    hits = single.join(least, "window").where("least < low").groupBy(*own).agg(F.collect_list("m").alias("marks"))
    alone = entries.where("hashes is not null").select(*own, "low").join(hits, own, "left")

    judged = walked.unionByName(alone)
    varied = shared.where("kind > 0").select("doc_id", "text_key", "at", "n", *own).join(judged, own)
    later = varied.where("doc_id > low").select("doc_id", "text_key", F.col("at").alias("a"), (F.col("at") + F.col("n") + reach).alias("b"))
    first = varied.where("doc_id = low and size(marks) > 0").select("doc_id", "text_key", "at", F.explode("marks").alias("m")).select("doc_id", "text_key", (F.col("at") + F.col("m")).alias("a"), (F.col("at") + F.col("m") + window).alias("b"))

    spans = whole.unionByName(later).unionByName(first)
    return spans.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): each row's word count, how many go, and the words that stay joined by one space."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    spans = removed_spans(rows, window, gram, hot)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, spans = batch.column(0), text_bytes(batch.column(1)), batch.column(2)
            counts, gone, kept = [], [], []
            for text, own in zip(texts, spans, strict=True):
                words = text.split()
                counts.append(len(words))
                if own.is_valid and len(own):
                    ends = own.values
                    step = np.zeros(len(words) + 1, np.int64)
                    np.add.at(step, ends.field(0).to_numpy(), 1)
                    np.add.at(step, ends.field(1).to_numpy(), -1)
                    stay = np.cumsum(step[:-1]) == 0
                    words = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
                gone.append(counts[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([ids, pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    with_key = rows.withColumn("text_key", F.xxhash64("text"))
    return with_key.join(spans, ["doc_id", "text_key"], "left").select("doc_id", "text", "spans").mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")
