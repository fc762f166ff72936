"""What several operators of this subpackage share: packed chunks of texts, word
hashes in numpy, and a counting exchange between chunks.

A *chunk* is one row that holds a few MB of documents (ids, lengths and the zstd
compressed concatenation of their UTF-8 bytes). Chunks are checkpointed in the
shared checkpoint folder, so a lost executor costs a reread and never a lost row,
and every pass over the texts derives the same keys in the same order.

``exchange_counts`` is a distributed lookup: every chunk sends its distinct 64-bit
keys, with how often it holds them, to the bucket that owns their range; a bucket
adds up over all chunks and answers every chunk. A key that is in a third of all
rows is one entry of each chunk, so hot keys are as cheap as others.
"""

from __future__ import annotations

import functools
import gc
import tempfile
import time

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_SCHEMA = "chunk long, ids array<long>, lens binary, blob binary, extra binary"
CHUNK_BYTES = 2 << 20
#: Bytes of one word, by the contract: everything but space, tab, newline, vertical tab, form feed, return.
SPACES = b" \t\n\x0b\x0c\r"
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
#: A-Z to a-z and nothing else.
LOWER = bytes(range(256)).lower()
LOWER_NP = np.frombuffer(LOWER, np.uint8)
U64 = np.uint64
ROOT = 0x9E3779B97F4A7C15 | 1


def checkpoint_dir(spark: SparkSession) -> None:
    """The shared folder the cluster names; a local one only where none is set, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))


def saved(df: DataFrame) -> DataFrame:
    """The rows, written to the shared checkpoint folder; Spark drops the files with the frame."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of a few MB instead of 64, unless the session says otherwise: workers and executors hold several of them
    outside the heap."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":
        spark.conf.set(name, str(4 << 20))


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files and checkpoints that no frame refers to any more.

    It does so when the driver's JVM collects garbage (by itself every half hour, see
    spark.cleaner.periodicGC.interval); between the phases of an operator that is too late for
    the disks. The first collection lets frames go, the second what only they held."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(1)


def delete(spark: SparkSession, path: str) -> None:
    """A folder of the shared file system, with all that is in it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def buckets(spark: SparkSession) -> int:
    """Key ranges of an exchange: several for each shuffle partition, so that partitions fill evenly."""
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- chunks


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", target: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Chunks of about `target` (else CHUNK_BYTES) bytes of text (a longer text is a chunk of its own); null texts are empty.

    The columns named in `carry` travel along as one compressed Arrow table a chunk."""
    target = target or CHUNK_BYTES
    bound_batches(df.sparkSession)

    def run(batches):
        part, seq, press = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(level=1)
        for batch in batches:
            ids, text = batch.column(0), batch.column(1).cast(pa.large_string()).fill_null("")
            others = pa.Table.from_batches([batch.select(range(2, batch.num_columns))]) if carry else None
            off = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            data = memoryview(text.buffers()[2] or b"")
            rows, at = [], 0
            while at < len(text):
                end = max(at + 1, int(np.searchsorted(off, off[at] + target, side="right")) - 1)
                extra = press.compress(_ipc(others.slice(at, end - at))) if carry else None
                rows.append(((part << 32) + seq, ids.slice(at, end - at).to_pylist(), np.diff(off[at : end + 1]).astype("<i8").tobytes(), press.compress(data[off[at] : off[end]]), extra))
                seq, at = seq + 1, end
            if rows:
                kinds = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["chunk", "ids", "lens", "blob", "extra"])

    own = [F.col(id_col).cast("long").alias("__pack_id"), F.col(text_col).cast("string").alias("__pack_text")]
    return saved(df.select(*own, *(F.col(f"`{c}`") for c in carry)).mapInArrow(run, CHUNK_SCHEMA))


def _ipc(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


class Chunk:
    """The documents of one chunk row: ids, byte offsets of each, and all their bytes."""

    def __init__(self, table, row: int = 0):
        self.chunk = table.column("chunk")[row].as_py()
        self.ids = table.column("ids")[row].as_py()
        lens = np.frombuffer(table.column("lens")[row].as_py(), "<i8")
        self.offsets = np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)
        self.data = zstandard.ZstdDecompressor().decompress(table.column("blob")[row].as_py()) if self.offsets[-1] else b""
        self._extra = table.column("extra")[row]

    def __len__(self):
        return len(self.ids)

    def carried(self) -> pa.Table:
        """The columns that were carried along, a row for each document."""
        return pa.ipc.open_stream(zstandard.decompress(self._extra.as_py())).read_all()

    def part(self, k: int, n: int) -> Chunk:
        """The k-th of n runs of this chunk's documents."""
        lo, hi = (len(self) * j // n for j in (k, k + 1))
        own = Chunk.__new__(Chunk)
        own.chunk, own.ids, own.offsets = self.chunk, self.ids[lo:hi], self.offsets[lo : hi + 1] - self.offsets[lo]
        own.data = self.data[self.offsets[lo] : self.offsets[hi]]
        return own

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]]


def each_chunk(batches):
    """The chunks of a mapInArrow input, one at a time."""
    for batch in batches:
        for row in range(batch.num_rows):
            yield Chunk(batch, row)


# ---------------------------------------------------------------- hashes


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x + U64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@functools.lru_cache(4)
def _powers(log: int, root: int) -> tuple[np.ndarray, np.ndarray]:
    """root**i and root**-i modulo 2**64 for i below 2**log."""
    out = []
    for r in (root, pow(root, -1, 1 << 64)):
        p, step = np.ones(1, U64), r
        for _ in range(log):
            p = np.concatenate([p, p * U64(step)])
            step = step * step & (1 << 64) - 1
        out.append(p)
    return out[0], out[1]


def powers(n: int, root: int) -> tuple[np.ndarray, np.ndarray]:
    a, b = _powers(max(16, int(n).bit_length()), root)
    return a[:n], b[:n]


#: Values whose running sum is taken at once, so that it and the powers stay in a core's cache.
STEP = 1 << 15


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray, root: int = ROOT) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each span (starts ascend), by differences of running sums."""
    out = np.empty(len(start), U64)
    i = 0
    while i < len(start):
        base = int(start[i])
        j = int(np.searchsorted(start, base + STEP))
        lo, hi = start[i:j] - base, end[i:j] - base
        own = values[base : base + int(hi.max())]
        p, inv = powers(len(own) + 1, root)
        total = np.zeros(len(own) + 1, U64)
        np.cumsum(own * p[:-1], out=total[1:])
        out[i:j] = mix((total[hi] - total[lo]) * inv[lo] + (hi - lo).astype(U64))
        i = j
    return out


#: Random odd weights for byte values, from a rule.
BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95)) | U64(1)


class Words:
    """Words of a chunk: hash, document number, byte span; and the first word of each document."""

    def __init__(self, c: Chunk, lower: bool):
        raw = np.frombuffer(c.data, np.uint8)
        if lower:
            raw = LOWER_NP[raw]
        inside = np.zeros(len(raw) + 2, bool)
        inside[1:-1] = ~IS_SPACE[raw]
        starts_at = inside[1:] & ~inside[:-1]
        ends_at = inside[:-1] & ~inside[1:]
        cuts = c.offsets[1:-1]  # a document's end also ends its last word
        cuts = cuts[(cuts > 0) & (cuts < len(raw))]
        joined = cuts[inside[cuts] & inside[cuts + 1]]
        starts_at[joined] = ends_at[joined] = True
        self.start, self.end = np.flatnonzero(starts_at), np.flatnonzero(ends_at)
        self.hash = span_hashes(BYTE[raw], self.start, self.end) if len(self.start) else np.zeros(0, U64)
        self.first = np.searchsorted(self.start, c.offsets).astype(np.int64)
        self.doc = np.repeat(np.arange(len(c)), np.diff(self.first))
        self.last = np.repeat(self.first[1:], np.diff(self.first))  # end of the word's document, in words

    def grams(self, n: int, root: int = ROOT) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the n words from each word on, and whether all of them are in its document."""
        total = len(self.hash)
        at = np.arange(total)
        ok = at + n <= self.last
        return span_hashes(self.hash, at, np.minimum(at + n, total), root), ok


# ---------------------------------------------------------------- exchange

REQUEST = "chunk long, bucket long, keys binary, counts binary"
REPLY = "chunk long, bucket long, reply binary"


def request_rows(chunk: int, keys: np.ndarray, counts: np.ndarray, n_buckets: int, narrow: bool = False) -> pa.RecordBatch:
    """Sorted distinct keys of a chunk, cut into the key ranges of the buckets. narrow: only the keys' last 32 bits
    are sent, so a total may add up more than one key; it is never less than the key's own."""
    of = ((keys >> U64(32)) * U64(n_buckets)) >> U64(32)
    cut = np.flatnonzero(np.diff(of)) + 1 if len(of) else np.zeros(0, np.int64)
    edges = np.concatenate([[0], cut, [len(keys)]]) if len(of) else np.zeros(1, np.int64)
    lo, hi = edges[:-1], edges[1:]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(lo), chunk, np.int64)),
            pa.array(of[lo].astype(np.int64) if len(lo) else np.zeros(0, np.int64)),
            pa.array([(keys[a:b].astype(np.uint32) if narrow else keys[a:b]).tobytes() for a, b in zip(lo, hi)], pa.binary()),
            pa.array([packed_counts(counts[a:b]) for a, b in zip(lo, hi)], pa.binary()),
        ],
        ["chunk", "bucket", "keys", "counts"],
    )


def packed_counts(counts: np.ndarray) -> bytes:
    """Empty where all are 1; a byte each if they fit; else four."""
    if not len(counts) or counts.min() == counts.max() == 1:
        return b""
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else counts.astype("<u4").tobytes()


def unpacked_counts(raw: bytes, n: int) -> np.ndarray:
    if not raw:
        return np.ones(n, np.int64)
    return np.frombuffer(raw, np.uint8 if len(raw) == n else "<u4").astype(np.int64)


def packed_totals(totals: np.ndarray) -> bytes:
    """Four bytes each if they fit, else eight."""
    return zstandard.compress(totals.astype("<u4" if not len(totals) or totals.max() < 2**32 else "<i8").tobytes(), 1)


def unpacked_totals(raw: bytes, n: int) -> np.ndarray:
    raw = zstandard.decompress(raw)
    return np.frombuffer(raw, "<u4" if len(raw) == 4 * n else "<i8").astype(np.int64)


def exchange_counts(requests: DataFrame, many_only: bool = False, narrow: bool = False) -> DataFrame:
    """For each request (a chunk's keys of one bucket), the totals of its keys over all chunks, in the keys' order.

    many_only: one bit a key instead, set where the total is 2 or more."""

    def run(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x.as_py(), np.uint32 if narrow else U64) for x in table.column("keys")]
        sizes = [len(x) for x in parts]
        counts = np.concatenate([unpacked_counts(x.as_py(), n) for x, n in zip(table.column("counts"), sizes)])
        _, inverse = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.bincount(inverse, weights=counts).astype(np.int64)[inverse]
        cuts = np.split(total, np.cumsum(sizes)[:-1])
        reply = [np.packbits(x >= 2).tobytes() if many_only else packed_totals(x) for x in cuts]
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "reply": pa.array(reply, pa.binary())})

    return requests.groupBy("bucket").applyInArrow(run, REPLY)


def read_reply(replies: pa.Table, keys: np.ndarray, n_buckets: int, many_only: bool = False) -> np.ndarray:
    """The answers to a chunk's sorted distinct keys: totals, or booleans if many_only."""
    got = dict(zip(replies.column("bucket").to_pylist(), replies.column("reply").to_pylist()))
    of = ((keys >> U64(32)) * U64(n_buckets)) >> U64(32)
    out = []
    for b, n in zip(*np.unique(of, return_counts=True)):
        raw = got[int(b)]
        out.append(np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool) if many_only else unpacked_totals(raw, n))
    return np.concatenate(out) if out else np.zeros(0, bool if many_only else np.int64)


def with_replies(chunks: DataFrame, replies: DataFrame, fn, schema) -> DataFrame:
    """fn(Chunk, its replies) -> Arrow table, for every chunk, also for those without replies."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.concat_tables([fn(Chunk(left, i), right) for i in range(left.num_rows)]) if left.num_rows else names

    names = empty(schema)
    return chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(run, schema)


def empty(schema) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema).empty_table()


def id_array(ids) -> pa.Array:
    return pa.array(ids, pa.int64())
