"""Training-order materialisation: binary shards of token ids in a shuffled global order.

Tasks lay their documents' ids (each closed by an end id) end to end and cut sequences of STRIDE ids. Task
counts, one number for each partition, turn local numbers into dense global ones. A keyed Feistel network over
the next even power of two, walked along its cycle until it lands below the number of sequences, gives each
sequence its slot: a permutation that needs no sort and no state. Slots are dense, so ranges of them, whole
shards each, are known beforehand: one shuffle deals sequences to their range, sorts them, and writes records
of one stride, so the place of any slot is known and reading resumes anywhere.

Each attempt names its files anew, and only listed files are read. Ids are stored as 16-bit numbers; a
vocabulary with more raises ValueError. Edge cases: null and empty texts are the end id alone; rows without an
id and repeated rows come as often as they are; the last sequence of a task is padded with the end id and its
length says so; other columns are not read, whatever their names; an empty table gives no shards.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import loaded
from .common import kept, map_batches, map_columns, map_rows, shared_dir, texts

STRIDE, SHARD = 2048, 16384  # ids of a sequence, sequences of a shard
END_ID, ROUNDS = 2, 6


def feistel(index: np.ndarray, total: int, key: int) -> np.ndarray:
    """The slots, below total, of indexes below total: a permutation for each key."""
    half = max(1, ((max(total, 2) - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64(int.from_bytes(uuid.uuid5(uuid.NAMESPACE_OID, f"{key}:{r}").bytes[:8], "little")) for r in range(ROUNDS)]
    out = index.astype(np.uint64)
    walking = np.arange(len(out))
    while len(walking):
        x = out[walking]
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            f = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            f ^= f >> np.uint64(29)
            f *= np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ (f >> np.uint64(32) & mask)
        out[walking] = left << np.uint64(half) | right
        walking = walking[out[walking] >= total]
    return out.astype(np.int64)


def _records(ids: np.ndarray, stride: int) -> pa.Array:
    """Rows of stride 16-bit ids as one binary array, not copied."""
    n = len(ids) // stride
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * (2 * stride)), pa.py_buffer(ids)])


def sequences(docs: DataFrame, vocabulary: str, stride: int = STRIDE) -> DataFrame:
    """(part, local, doc_id and start of the first id, length, ids binary)."""

    def run(rows):
        bpe, part, local = loaded(vocabulary), TaskContext.get().partitionId(), 0
        if len(bpe.length) > 1 << 16:
            raise ValueError("ids do not fit into 16 bits")
        end = np.array([END_ID], "<u4").tobytes()
        left, owner, at = np.zeros(0, "<u2"), None, 0  # ids that wait, their first one's document and its place there

        def cut(group, last: bool):
            """Columns of all whole sequences of what waits and of group, in one piece; at the end of the rest, too."""
            nonlocal left, owner, at, local
            if not group and not (last and len(left)):
                return
            own = [x + end for x in bpe.encode_many([t for _, t in group])]
            starts = np.cumsum([0, len(left), *(len(x) // 4 for x in own)])[:-1]
            names = [owner, *(d for d, _ in group)]
            ids = np.concatenate([left, np.frombuffer(b"".join(own), "<u4").astype("<u2")])
            n = len(ids) // stride
            lengths = np.full(n, stride)
            if last and len(ids) % stride:
                lengths = np.append(lengths, len(ids) % stride)
                ids = np.concatenate([ids, np.full(stride - len(ids) % stride, END_ID, "<u2")])
                n += 1
            begin = np.arange(n + 1) * stride
            of = np.searchsorted(starts, begin, "right") - 1
            place = begin - starts[of] + np.where(of == 0, at, 0)
            if n:
                yield np.full(n, part), local + np.arange(n), [names[k] for k in of[:-1].tolist()], place[:-1], lengths, _records(ids[: n * stride], stride)
            left, owner, at, local = ids[n * stride :].copy(), names[of[-1]], int(place[-1]), local + n

        group, size = [], 0
        for row in rows:
            group.append(row)
            size += len(row[1])
            if size > 4_000_000:
                yield from cut(group, False)
                group, size = [], 0
        yield from cut(group, True)

    return map_columns(texts(docs), run, "part long, local long, doc_id long, start long, length long, ids binary")


def materialised(docs: DataFrame, vocabulary: str, key: int = 7, stride: int = STRIDE, shard: int = SHARD) -> tuple[DataFrame, int]:
    """((slot, doc_id, start, length, shard, path, record), number of sequences); shards are written."""
    spark = docs.sparkSession
    cut = kept(sequences(docs, vocabulary, stride), "sequences", "zstd")
    parts = cut.groupBy("part").count().orderBy("part").collect()  # one row for each task
    before, total = [], 0
    for p in parts:
        before.append((p["part"], total))
        total += p["count"]
    offsets = spark.createDataFrame(before, "part long, before long")
    folder = shared_dir(spark, "shards")

    def place(batches):
        for batch in batches:
            slot = feistel(batch.column(0).to_numpy(), total, key)
            yield [slot, slot // shard, *batch.columns[1:]]

    def write(batches):
        where, root = fs.FileSystem.from_uri(folder)
        where.create_dir(root, recursive=True)
        now, out, name = -1, None, ""
        for batch in batches:
            slot, number, *same, ids = batch.columns
            slots, numbers = slot.to_numpy(), number.to_numpy()
            at = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), len(numbers)]
            data, offset = ids.buffers()[2], np.frombuffer(ids.buffers()[1], np.int32)[ids.offset :]
            names: list[str] = []
            for a, b in zip(at[:-1], at[1:], strict=True):
                if a < b and numbers[a] != now:
                    if out is not None:
                        out.close()
                    now = int(numbers[a])
                    name = f"{now:010d}-{uuid.uuid4().hex}.bin"
                    out = where.open_output_stream(f"{root}/{name}", compression=None)
                if a < b:
                    out.write(data.slice(int(offset[a]), int(offset[b] - offset[a])))
                names += [f"{folder}/{name}"] * (b - a)
            yield [slot, *same, number, names, slots % shard]
        if out is not None:
            out.close()

    same = ("doc_id", "start", "length")
    placed = map_batches(cut.join(F.broadcast(offsets), "part").select((F.col("before") + F.col("local")).alias("index"), *same, "ids"), place, "slot long, shard long, doc_id long, start long, length long, ids binary")
    shards = max(1, -(-total // shard))
    tasks = min(shards, 100_000)
    ordered = placed.repartitionById(tasks, F.expr(f"cast(shard * {tasks} div {shards} as int)")).sortWithinPartitions("slot")
    return kept(map_batches(ordered, write, "slot long, doc_id long, start long, length long, shard long, path string, record long"), "slots"), total


def read_shard(path: str, stride: int = STRIDE, record: int = 0) -> Iterator[np.ndarray]:
    """Sequences of a shard in order, from any record on."""
    where, name = fs.FileSystem.from_uri(path)
    with where.open_input_file(name) as file:
        file.seek(2 * stride * record)
        while data := file.read(2 * stride):
            yield np.frombuffer(data, "<u2")


def read_back(slots: DataFrame, stride: int = STRIDE) -> DataFrame:
    """A row for each slot, with the CRC of its ids as they lie in its shard."""

    def run(rows):
        now, sequence, at = None, None, 0
        for path, record, slot, doc_id, start, length, shard in rows:
            if path != now or record != at:
                sequence, at = read_shard(path, stride, record), record
                now = path
            yield slot, doc_id, start, length, shard, record, zlib.crc32(next(sequence)[:length].astype("<u4"))
            at += 1

    shards = (slots.agg(F.max("shard")).first()[0] or 0) + 1
    tasks = min(shards, 100_000)
    rows = slots.select("path", "record", "slot", "doc_id", "start", "length", "shard")
    rows = rows.repartitionById(tasks, F.expr(f"cast(shard * {tasks} div {shards} as int)")).sortWithinPartitions("path", "record")
    return map_rows(rows, run, "slot long, doc_id long, start long, length long, shard long, record long, ids_crc32 long")
