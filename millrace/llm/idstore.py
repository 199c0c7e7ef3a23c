"""Token ids of all documents as one long array, with Elias-Fano coded bounds.

A store is a folder of Parquet files whose rows are blocks. Each block holds the
ids of consecutive documents, 2 bytes an id (4 where the vocabulary needs it),
and its document bounds in Elias-Fano form: of the n + 1 offsets 0 = o_0 <= ...
<= o_n = u, the low l = floor(log2(u / n)) bits lie packed side by side and the
high parts in a unary bit vector, so that bounds take about 2 + l bits a
document. ``EliasFano.select`` finds an offset by a sampled select on that
vector. Spark's writer commits the files, so repeated or lost tasks leave no
half-written block, and any store that Spark can write will do.

Defined results: a null text counts as empty and holds the end id alone; null
document ids come first; documents of equal id keep an order by their text;
an empty table gives an empty store; a text of any length lies in one block.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import partitions

#: A block is closed once it holds so many ids or documents.
BLOCK_IDS, BLOCK_DOCS = 1 << 20, 1 << 16
#: Entries of a worker's piece cache, 200 bytes or so each; it starts anew beyond that.
CACHE_PIECES = 1_500_000
#: Every so many documents the place of the set bit is kept.
SELECT_STEP = 256

_HEAD = "<4sBBQQ"


class EliasFano:
    """A non-decreasing sequence of n values up to u."""

    def __init__(self, n: int, u: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.u, self.low_bits, self.low, self.high = n, u, low_bits, low, high
        bits = np.unpackbits(high, bitorder="little")
        self.samples = np.flatnonzero(bits)[::SELECT_STEP]

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n, u = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (u // n).bit_length() - 1) if n else 0
        v = values.astype(np.uint64)
        place = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(((u >> low_bits) + n + 8) // 8, dtype=np.uint8)
        np.bitwise_or.at(high, place >> 3, (1 << (place & 7)).astype(np.uint8))
        low = np.packbits(((v[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        return cls(n, u, low_bits, low, high)

    def dump(self) -> bytes:
        return struct.pack(_HEAD, b"EFB1", self.low_bits, 0, self.n, self.u) + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def load(cls, data: bytes) -> EliasFano:
        magic, low_bits, _, n, u = struct.unpack_from(_HEAD, data)
        if magic != b"EFB1":
            raise ValueError("not an Elias-Fano block")
        cut = struct.calcsize(_HEAD) + (n * low_bits + 7) // 8
        return cls(n, u, low_bits, np.frombuffer(data[struct.calcsize(_HEAD) : cut], np.uint8), np.frombuffer(data[cut:], np.uint8))

    def select(self, i: int) -> int:
        """The i-th value, from the nearest sampled set bit on."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        rank, at = i % SELECT_STEP, int(self.samples[i // SELECT_STEP])
        byte, word = at >> 3, int(self.high[at >> 3]) & (0xFF << (at & 7))
        while (c := word.bit_count()) <= rank:
            rank -= c
            byte += 1
            word = int(self.high[byte])
        for _ in range(rank):
            word &= word - 1
        return ((byte * 8 + (word & -word).bit_length() - 1 - i) << self.low_bits) | self._low(i)

    def _low(self, i: int) -> int:
        a, b = i * self.low_bits, (i + 1) * self.low_bits
        return (int.from_bytes(self.low[a >> 3 : (b + 7) >> 3].tobytes(), "little") >> (a & 7)) & ((1 << self.low_bits) - 1)

    def values(self) -> np.ndarray:
        """All values at once."""
        high = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n] - np.arange(self.n)
        if not self.low_bits:
            return high
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        return (high << self.low_bits) | (bits.astype(np.int64) << np.arange(self.low_bits)).sum(1)


class Pieces(dict):
    """Ids, as bytes, of pieces that follow a space (the key leaves it out); ``plain`` has those that do not."""

    def __init__(self, path: str, dtype: str):
        import os
        from array import array

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.plain: dict[str, bytes] = {}
        self.code, self.array = {"<u2": "H", "<u4": "I"}[dtype], array
        self.line_end = self.whole("\n")
        self.odd = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]

    def whole(self, text: str) -> bytes:
        return self.array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def start(self, piece: str) -> bytes:
        got = self.plain.get(piece)
        if got is None:
            if len(self.plain) >= CACHE_PIECES // 8:
                self.plain.clear()
            got = self.plain[piece] = self.whole(piece)
        return got

    def __missing__(self, piece: str) -> bytes:
        if "\n" in piece:
            first, *rest = piece.split("\n")
            return b"".join([self[first], *(x for p in rest for x in (self.line_end, self.start(p)))])
        if len(self) >= CACHE_PIECES:
            self.clear()
        got = self[piece] = self.whole(" " + piece)
        return got

    def encode(self, text: str) -> bytes:
        """Ids of a whole text.

        Where no two white-space characters meet, the byte-level pattern matches
        across neither a space (which opens the match of what follows) nor a line
        end (a match of its own), so the pieces between can be encoded apart.
        Other texts go to the library whole, and so do those that hold an added
        token such as <|endoftext|>, which is one id there.
        """
        if not text or self.doubled(text) or any(t in text for t in self.added):
            return self.whole(text)
        first, *rest = text.split(" ")
        lines = first.split("\n")
        head = self.line_end.join([self.start(p) if p else b"" for p in lines])
        return head + b"".join(map(self.__getitem__, rest))

    def doubled(self, text: str) -> bool:
        """Whether white space other than single blanks and line ends may be in a text."""
        return "  " in text or "\n\n" in text or " \n" in text or "\n " in text or any(c in text for c in self.odd)


def _pieces(path: str, dtype: str) -> Pieces:
    """One cache for a Python worker, whatever the number of its tasks."""
    import sys
    from types import ModuleType

    kept = sys.modules.setdefault("_millrace_pieces", ModuleType("_millrace_pieces")).__dict__
    if (path, dtype) not in kept:
        kept[path, dtype] = Pieces(path, dtype)
    return kept[path, dtype]


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int, vocabulary: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode all documents in ascending id order and write them as blocks under ``path``."""
    spark, dtype = docs.sparkSession, "<u2" if max(vocabulary - 1, end_id) < 1 << 16 else "<u4"
    end = np.array([end_id], dtype=dtype).tobytes()
    width = len(end)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, number = TaskContext.get().partitionId(), 0
        encode = _pieces(tokenizer, dtype).encode
        ids, data, total, before = [], [], 0, 0

        def block() -> pa.RecordBatch:
            bounds = np.concatenate(([0], np.cumsum([len(x) // width for x in data])))
            keys = [pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([before], pa.int64()), pa.array([int(bounds[-1])], pa.int64()), pa.array([width], pa.int32())]
            return pa.RecordBatch.from_arrays([*keys, pa.array([ids], pa.list_(pa.int64())), pa.array([EliasFano.of(bounds).dump()], pa.binary()), pa.array([b"".join(data)], pa.binary())], names=names)

        for batch in batches:
            for key, text in zip(*(batch.column(i) for i in range(2)), strict=True):
                ids.append(key.as_py())
                data.append(encode(text.as_py() or "") + end)
                total += len(data[-1]) // width
                if total >= BLOCK_IDS or len(ids) >= BLOCK_DOCS:
                    yield block()
                    number, before, ids, data, total = number + 1, before + total, [], [], 0
        if ids:
            yield block()

    schema = "shard int, block int, before long, n_ids long, width int, doc_ids array<long>, bounds binary, ids binary"
    names = ["shard", "block", "before", "n_ids", "width", "doc_ids", "bounds", "ids"]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(blocks, schema).write.option("compression", "zstd").parquet(path)


def read_store(spark, path: str) -> DataFrame:
    """One row a document of a store: doc_id, start (ids of all documents before it), and ``ids`` (binary, little-endian unsigned 32 bit)."""
    stored = spark.read.parquet(path)
    # one total a file of ids: as many rows as the writer had tasks
    totals = sorted(stored.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect())
    base = dict(zip([r.shard for r in totals], np.concatenate(([0], np.cumsum([r.n for r in totals])))[:-1].tolist(), strict=True))
    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                bounds = EliasFano.load(r["bounds"])
                cuts, width = bounds.values(), r["width"]
                first = base[r["shard"]] + r["before"]
                wide = np.frombuffer(r["ids"], dtype=f"<u{width}").astype("<u4").tobytes()
                for a in range(0, len(r["doc_ids"]), 2048):
                    keys = r["doc_ids"][a : a + 2048]
                    own = cuts[a : a + len(keys) + 1]
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(own[:-1] + first, pa.int64()), pa.array([wide[4 * x : 4 * y] for x, y in zip(own[:-1].tolist(), own[1:].tolist(), strict=True)], pa.binary())], names=["doc_id", "start", "ids"])

    return stored.select("shard", "before", "width", "doc_ids", "bounds", "ids").mapInArrow(documents, "doc_id long, start long, ids binary")
