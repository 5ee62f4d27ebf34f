"""Training-order materialisation: fixed-stride token sequences written in a keyed random order.

Documents are encoded to token ids and cut into sequences of one length, the last one padded.  Sequence k of the corpus
gets slot F(k), F a keyed Feistel permutation of all sequence numbers (values outside the range are walked on until they
fall into it), so the order is global, reproducible from the key, and known without a sort or a random number kept anywhere.
Slot ranges are dealt to tasks directly, rows for one task compressed together; each writes shards of a fixed number of sequences.  A shard is one plain binary
file of records of one stride (LENGTH ids of the encoder's width), so a reader that stopped at a slot finds the rest by arithmetic.
"""

from __future__ import annotations

import base64
import contextlib
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridreach.llm.text import keyed, mix, raw
from gridreach.session import scratch, shuffle_width

#: Token ids of a sequence; sequences of a shard; Feistel rounds; key of the order; sequences a task holds before it deals them out.
LENGTH, SHARD, FEISTEL_ROUNDS, KEY, LOT = 1024, 4096, 6, 20_240_601, 1 << 14

_U = np.uint64


@dataclass(frozen=True)
class Ids:
    """An encoder and how its ids are kept: bytes an id, ids of padding and of the end of a text."""

    width: int
    pad: int
    end: int
    encode: Callable[[bytes], np.ndarray]

    @property
    def stride(self) -> int:
        return LENGTH * self.width

    @property
    def kind(self) -> str:
        return f"<u{self.width}"


def encode_bytes(text: bytes) -> np.ndarray:
    """Byte-level ids: the bytes themselves."""
    return np.frombuffer(text, np.uint8)


#: One byte an id; bytes C0 and C1 occur in no UTF-8 text, so END and PAD take them.
BYTES = Ids(1, 0xC1, 0xC0, encode_bytes)
#: First id of a rank file's ranks, behind padding (0) and end (1).
FIRST = 3


def rank_encoder(path: str, pattern: str) -> Ids:
    """Byte-pair ids of two bytes, shifted by FIRST, of a rank file of a public tokenizer (fewer than 65,533 ranks); loaded once in each worker."""
    loaded: list = []

    def encode(text: bytes) -> np.ndarray:
        if not loaded:
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            loaded.append(tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}))
        return np.array(loaded[0].encode_ordinary(text.decode()), "<u2") + np.uint16(FIRST)

    return Ids(2, 0, 1, encode)


def permute(k: np.ndarray, n: int, key: int) -> np.ndarray:
    """Slots of sequence numbers k in [0, n): a bijection of that range for every key."""
    half = max(1, -(-max(1, (n - 1).bit_length()) // 2))
    mask = _U((1 << half) - 1)
    keys = mix(np.arange(1, FEISTEL_ROUNDS + 1, dtype=np.uint64) + mix(np.array([key], np.int64).view(np.uint64)))
    out = k.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> _U(half), out[todo] & mask
        for r in keys:
            left, right = right, left ^ (mix(right + r) & mask)
        out[todo] = (left << _U(half)) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def sequences(text: bytes | None, ids: Ids) -> list[tuple[int, bytes]]:
    """(tokens, one stride of ids) of each sequence of a text; the last one ends with the end id and padding."""
    own = np.concatenate((ids.encode(text or b""), np.array([ids.end], ids.kind)))
    n = -(-len(own) // LENGTH)
    padded = np.full(n * LENGTH, ids.pad, ids.kind)
    padded[: len(own)] = own
    whole = padded.tobytes()
    return [(min(LENGTH, len(own) - i * LENGTH), whole[i * ids.stride : (i + 1) * ids.stride]) for i in range(n)]


def _counts(docs: DataFrame, ids: Ids) -> np.ndarray:
    """First sequence number of each partition of docs and, last, the number of sequences."""
    plain = ids is BYTES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for b in batches:
            for t in raw(b, "text"):
                n += -(-((len(t or b"") if plain else len(ids.encode(t or b""))) + 1) // LENGTH)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([n], pa.int64())], ["p", "n"])

    rows = docs.mapInArrow(count, "p long, n long").collect()  # one row a partition
    n = np.zeros(max((r["p"] for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        n[r["p"]] = r["n"]
    return np.concatenate(([0], np.cumsum(n)))


def _files(path: str) -> tuple[fs.FileSystem, str]:
    """File system and folder of the binary shards of `path`, as workers see it."""
    if not re.match("[a-z][a-z0-9+.-]*:", path):
        return fs.LocalFileSystem(), f"{path}/_shards"
    system, folder = fs.FileSystem.from_uri(path)
    return system, f"{folder}/_shards"


def _name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def shard_file(path: str, shard: int) -> str:
    """Binary file of a shard: the ids of slot s begin at byte (s - shard * SHARD) * stride."""
    return f"{path}/_shards/{_name(shard)}"


def materialise(docs: DataFrame, path: str, key: int = KEY, ids: Ids = BYTES) -> int:
    """Write all sequences of docs to `path` as shards in training order and return their number.

    shard_file(path, s) holds the ids (one stride a slot, little-endian) of the slots from s * SHARD on, in order and
    uncompressed; `path` itself is a Parquet table that tells of each slot: shard, slot, doc_id, piece, n_tokens, and the bytes of an id, width.  A shard is
    written by one task under a temporary name and renamed when all its slots are there, so a repeated task does no harm.
    `path` must be in a folder that workers and driver reach (a shared mount, hdfs, s3, gs): shards that the driver does not see
    afterwards are an error.  The two passes over
    docs must see the same partitions (a table does); a task that meets another number of
    sequences than was counted fails rather than write a slot twice.  Null and empty texts are one sequence with END alone;
    null ids are carried along; repeated rows are written as often as they come; extra columns are ignored; an
    empty table writes nothing.
    """
    spark, d = docs.sparkSession, keyed(docs, "doc_id", "text")
    first = _counts(d, ids)
    n = int(first[-1])
    if n == 0:
        return 0

    shards = -(-n // SHARD)
    tasks = max(1, min(shards, max(shuffle_width(spark), len(first))))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = TaskContext.get().partitionId()
        at, end = int(first[p]), int(first[p + 1])
        rows: list[tuple[int | None, int, int, bytes]] = []

        def dealt() -> pa.RecordBatch:
            if at + len(rows) > end:
                raise RuntimeError("the passes saw different partitions")
            slot = permute(np.arange(at, at + len(rows)), n, key)
            to = slot // SHARD * tasks // shards
            order = np.lexsort((slot, to))
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(to[order])) + 1, [len(order)]))
            groups = [order[a:z] for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
            packs = [packed(slot[g], [rows[i] for i in g]) for g in groups]
            return pa.RecordBatch.from_arrays([pa.array([int(to[g[0]]) for g in groups], pa.int32()), pa.array([len(g) for g in groups], pa.int64()), pa.array(packs, pa.binary())], ["to", "n", "pack"])

        for b in batches:
            for doc, t in zip(b.column("doc_id").to_pylist(), raw(b, "text"), strict=True):
                rows += [(doc, i, tokens, s) for i, (tokens, s) in enumerate(sequences(t, ids))]
                if len(rows) >= LOT:
                    yield dealt()
                    at, rows = at + len(rows), []
        if rows:
            yield dealt()
            at += len(rows)
        if at != end:
            raise RuntimeError("the passes saw different partitions")

    sent = d.mapInArrow(emit, "to int, n long, pack binary").repartitionById(tasks, F.col("to"))
    rows = sent.select("n", "pack").mapInArrow(_unpack(ids.stride), f"{_INDEX}, ids binary").withColumn("shard", F.floor(F.col("slot") / SHARD))
    index = rows.sortWithinPartitions("shard", "slot").select("slot", "doc_id", "piece", "n_tokens", "shard", "ids").mapInArrow(_store(path, n), f"{_INDEX}, shard long")
    index = index.withColumn("width", F.lit(ids.width)).select("slot", "doc_id", "piece", "n_tokens", "width", "shard")
    index.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_shards")
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    seen = sum(f.getPath().getName().endswith(".bin") for f in store.listStatus(folder)) if store.exists(folder) else 0
    if seen != shards:
        raise RuntimeError(f"{seen} of {shards} shards are in {path}: workers wrote elsewhere")
    return n


def packed(slot: np.ndarray, rows: list[tuple[int | None, int, int, bytes]]) -> bytes:
    """Sequences bound for one task, compressed together for the way there."""
    doc, piece, used, body = zip(*rows, strict=True)
    none = np.array([d is None for d in doc])
    numbers = np.stack([slot, np.array([0 if d is None else d for d in doc]), piece, used, none]).astype("<i8")
    return pa.compress(numbers.tobytes() + b"".join(body), codec="zstd", asbytes=True)


def _unpack(stride: int):
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, pack in zip(batch.column("n").to_pylist(), batch.column("pack"), strict=True):
                whole = pa.decompress(pack.as_buffer(), k * (40 + stride), "zstd", asbytes=True)
                slot, doc, piece, used, none = np.frombuffer(whole, "<i8", 5 * k).reshape(5, k)
                body = [whole[40 * k + i * stride : 40 * k + (i + 1) * stride] for i in range(k)]
                yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(doc, mask=none.astype(bool)), pa.array(piece), pa.array(used), pa.array(body, pa.binary())], ["slot", "doc_id", "piece", "n_tokens", "ids"])

    return unpack


_INDEX = "slot long, doc_id long, piece long, n_tokens long"


def _store(path: str, n: int):
    """Writes the ids of sorted rows to their shards and hands the other columns on."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = _files(path)
        system.create_dir(folder)
        mine = f"{folder}/.{uuid.uuid4().hex}"
        shard, at, out = -1, 0, None

        def close() -> None:
            out.close()
            if at != min((shard + 1) * SHARD, n):
                raise RuntimeError("a shard lacks slots")
            system.move(mine, f"{folder}/{_name(shard)}")

        try:
            for b in batches:
                for slot, ids in zip(b.column("slot").to_pylist(), b.column("ids"), strict=True):
                    if slot // SHARD != shard:
                        if out is not None:
                            close()
                        shard, at, out = slot // SHARD, slot // SHARD * SHARD, system.open_output_stream(mine)
                    if slot != at:
                        raise RuntimeError("slots out of order")
                    out.write(ids.as_buffer())
                    at += 1
                yield b.select(["slot", "doc_id", "piece", "n_tokens", "shard"])
            if out is not None:
                close()
        except BaseException:
            with contextlib.suppress(OSError):
                system.delete_file(mine)
            raise

    return store


def _fetch(path: str):
    """Adds ids to index rows: each is read at its byte offset."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = _files(path)
        shard, file = -1, None
        for whole in batches:
            for i in range(0, whole.num_rows, 2048):
                b, ids = whole.slice(i, 2048), []
                stride = LENGTH * b.column("width")[0].as_py()
                for slot in b.column("slot").to_pylist():
                    if slot // SHARD != shard:
                        if file is not None:
                            file.close()
                        shard = slot // SHARD
                        file = system.open_input_file(f"{folder}/{_name(shard)}")
                    ids.append(file.read_at(stride, (slot - shard * SHARD) * stride))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("slot", "doc_id", "piece", "n_tokens", "width")), pa.array(ids, pa.binary()), b.column("shard")], ["slot", "doc_id", "piece", "n_tokens", "width", "ids", "shard"])
        if file is not None:
            file.close()

    return fetch


def read_from(spark: SparkSession, path: str, slot: int = 0) -> DataFrame:
    """The written sequences from a slot on: only the shards that hold them are read."""
    table = spark.read.schema(f"{_INDEX}, width int, shard long").parquet(path)
    wanted = table.where((F.col("shard") >= slot // SHARD) & (F.col("slot") >= slot))
    return wanted.select("slot", "doc_id", "piece", "n_tokens", "width", "shard").mapInArrow(_fetch(path), f"{_INDEX}, width int, ids binary, shard long")


def training_order(docs: DataFrame, key: int = KEY, ids: Ids = BYTES) -> DataFrame:
    """slot, shard, byte_offset, doc_id, piece, n_tokens, ids_crc32 of the shards written for docs."""
    path = scratch(docs.sparkSession, "shards")
    schema = "slot long, shard long, byte_offset long, doc_id long, piece long, n_tokens long, ids_crc32 long"
    if not materialise(docs, path, key, ids):
        return docs.sparkSession.createDataFrame([], schema)
    t = read_from(docs.sparkSession, path)
    return t.select("slot", "shard", ((F.col("slot") - F.col("shard") * SHARD) * LENGTH * F.col("width")).alias("byte_offset"), "doc_id", "piece", "n_tokens", F.crc32("ids").alias("ids_crc32"))
