"""Token ids packed into rows of fixed length by best-fit decreasing.

Texts are encoded, cut losslessly into pieces of at most one row, dealt to shards by hash, and packed shard by shard: pieces
from the longest to the shortest, each into the open row with the least room that holds it, found in a segment tree over the
rooms there are. A row of output is a row of the id matrix with its cumulative segment lengths and restarting positions.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PATTERN, share
from .runtime import partitions, slices

LENGTH = 2048
#: Rows of a batch that become objects at a time.
ROWS = 256
#: Characters of text that make a shard, on average; a shard is packed in one task's memory.
SHARD_CHARS = 2_000_000


_encoders: dict[str, tiktoken.Encoding] = {}


def encoder(shared: Broadcast) -> tiktoken.Encoding:
    """This worker's byte-level BPE encoder for the broadcast bytes of a file of ranks (base64 token and rank a line)."""
    raw = shared.value
    key = hashlib.sha256(raw).hexdigest()
    if key not in _encoders:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines())}
        _encoders[key] = tiktoken.Encoding(key, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


class Rooms:
    """Open rows by the room they have left. A segment tree over 0 .. capacity tells which rooms there are."""

    def __init__(self, capacity: int):
        self.size = 1
        while self.size <= capacity:
            self.size *= 2
        self.tree = bytearray(2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _mark(self, room: int, there: int) -> None:
        i = room + self.size
        self.tree[i] = there
        i //= 2
        while i:
            there = self.tree[2 * i] | self.tree[2 * i + 1]
            if self.tree[i] == there:
                break
            self.tree[i] = there
            i //= 2

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        if len(self.rows[room]) == 1:
            self._mark(room, 1)

    def best(self, least: int) -> int | None:
        """The least room of at least `least` that a row has."""
        i = least + self.size
        if self.tree[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.tree[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.tree[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None

    def take(self, room: int) -> int:
        row = self.rows[room].pop()
        if not self.rows[room]:
            self._mark(room, 0)
        return row


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Rows of item numbers; sizes must not ascend, and none may exceed capacity or be 0. Items stay in the order they came."""
    rooms, rows = Rooms(capacity), []
    for item, size in enumerate(sizes):
        room = rooms.best(size)
        if room is None:
            room, row = capacity, len(rows)
            rows.append([])
        else:
            row = rooms.take(room)
        rows[row].append(item)
        if room > size:
            rooms.add(room - size, row)
    return rows


def positions(lengths: list[int]) -> np.ndarray:
    """0, 1, ... anew for each segment."""
    return np.concatenate([np.arange(n, dtype=np.int32) for n in lengths]) if lengths else np.zeros(0, np.int32)


_PACKED = "shard long, seq long, n_tokens long, doc_ids array<long>, pieces array<int>, cu_seqlens array<int>, ids binary, position_ids binary"


def pack(docs: DataFrame, path: str, length: int = LENGTH, shard_chars: int = SHARD_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packed rows of all texts' ids: shard, seq (number in the shard), n_tokens, doc_ids and pieces (of each segment),
    cu_seqlens (0 and each segment's end), ids and position_ids (int32, little endian, n_tokens each).

    path: a file of ranks of a byte-level BPE; its special tokens' strings are ordinary text here. A text of more than `length` ids is cut into pieces numbered from 0; put together in order they are the text's ids. Null
    and empty texts have no ids and no segment. Repeated rows are packed each. A null id is packed as such. Very long texts are
    encoded whole. Other columns play no part. Ties of room go to any row with it. Shards follow from ids, pieces and the characters of all texts alone, rows of a shard from its pieces, so results don't depend on
    how the input is split. An empty table gives no rows.
    """
    shared = share(docs, path)
    chars = docs.agg(F.coalesce(F.sum(F.length(text_col)), F.lit(0))).first()[0]
    shards = max(1, -(-int(chars) // shard_chars))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(shared).encode_ordinary
        for batch in _few(batches):
            doc_ids, texts = batch.column(0).to_pylist(), [x or "" for x in batch.column(1).to_pylist()]
            for start, end in slices(texts):
                ids = [np.array(encode(x), "<i4") for x in texts[start:end]]
                out = [(d, k, min(length, len(x) - a), x[a : a + length].tobytes()) for d, x in zip(doc_ids[start:end], ids, strict=True) for k, a in enumerate(range(0, len(x), length))]
                if out:
                    d, k, n, b = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(k, pa.int32()), pa.array(n, pa.int32()), pa.array(b, pa.binary())], ["doc_id", "piece", "n", "ids"])

    pieces = docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(cut, "doc_id long, piece int, n int, ids binary")
    # the ids count, too: rows that share a null or repeated doc_id don't share a shard
    shard = F.pmod(F.xxhash64("doc_id", "piece", "ids"), F.lit(shards)).alias("shard")
    dealt = pieces.select(shard, "doc_id", "piece", "n", "ids").repartition(partitions(docs.sparkSession), "shard")  # a task packs its shards one by one
    return dealt.sortWithinPartitions("shard", F.desc("n"), "doc_id", "piece", "ids").mapInArrow(_packs(length), _PACKED)


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of ROWS rows: as objects, a whole batch of Spark's would take its size (up to 64 MB) once more."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _packs(length: int):
    """Packs a sorted stream of pieces (shard, doc_id, piece, n, ids) shard by shard; holds the pieces of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in _few(batches):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != now:
                    if held:
                        yield from _shard(now, held, length)
                    now, held = row[0], []
                held.append(row[1:])
        if held:
            yield from _shard(now, held, length)

    return run


def _shard(shard: int, held: list[tuple], length: int) -> Iterator[pa.RecordBatch]:
    rows = best_fit([x[2] for x in held], length)
    for a in range(0, len(rows), ROWS):
        out = []
        for seq, items in enumerate(rows[a : a + ROWS], a):
            sizes = [held[i][2] for i in items]
            out.append((shard, seq, sum(sizes), [held[i][0] for i in items], [held[i][1] for i in items], [0, *np.cumsum(sizes).tolist()], b"".join(held[i][3] for i in items), positions(sizes).astype("<i4").tobytes()))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], ["shard", "seq", "n_tokens", "doc_ids", "pieces", "cu_seqlens", "ids", "position_ids"])


def write_matrix(packed: DataFrame, out: str, length: int = LENGTH, pad: int = 0) -> None:
    """Writes packed rows as Parquet with `ids` and `position_ids` padded to 4 * length bytes: rows of an id matrix."""
    fill = lambda c, x: F.concat(F.col(c), F.expr(f"unhex(repeat('{x.to_bytes(4, 'little').hex()}', {length} - int(n_tokens)))"))
    packed.withColumn("ids", fill("ids", pad)).withColumn("position_ids", fill("position_ids", 0)).write.parquet(out)


def pack_digests(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """pack() with digests of the ids and positions of a row in place of them."""
    return pack(docs, path, length).select(
        "shard", "seq", "n_tokens", F.size("doc_ids").cast("long").alias("n_segments"), "doc_ids", "pieces", "cu_seqlens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("position_ids", 256).alias("positions_sha256")
    )


def digest(ids: list[int]) -> str:
    """ids_sha256 of a row with these ids."""
    return hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest()
