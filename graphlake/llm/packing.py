"""Best-fit packing with a swap-based local search.

Documents are cut into pieces of at most the sequence length, pieces are dealt by hash to shards of bounded size, and each shard is packed by itself: best fit, longest first, then a local search between underfull bins that moves a piece, swaps one for one or two for one, each time raising the sum of squared fills, until bins empty and no exchange gains or the shard's lower bound is met. Only (id, piece, length) rows move between machines.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlake.llm.common import released, stage
from graphlake.llm.tokens import chunks, vocabulary

CAPACITY = 2048
SHARD = 8192  # pieces, about


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocab: str | None = None, end_id: int = 0) -> DataFrame:
    """(id, row, piece, start, length, ids_crc32): every document's ids, ``end_id`` after them, cut at ``capacity``.

    row tells rows of one id apart. A null or empty text has the end id only.
    """
    path, end = vocabulary(vocab), int(end_id).to_bytes(4, "little")

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = chunks(path)
        for b in batches:
            at, out = [], []
            for i, ids in enumerate(table.ids(b.column(2))):
                whole = bytes(ids) + end
                for k in range(0, len(whole), 4 * capacity):
                    part = whole[k : k + 4 * capacity]
                    at.append(i)
                    out.append((k // (4 * capacity), k // 4, len(part) // 4, zlib.crc32(part)))
            if at:
                piece, start, length, crc = map(list, zip(*out, strict=True))
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["id", "row", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, f"id {kind}, row long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indexes: the longest first, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room r
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        fit = rooms >> n
        if fit:
            r = n + (fit & -fit).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                rooms ^= 1 << r
            bins[b].append(i)
        else:
            r, b = capacity, len(bins)
            bins.append([i])
        left = r - n
        if left:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins


class _Search:
    """Local search between the underfull bins of one shard: bins give pieces to others, or trade one or two of theirs for one of the others', as long as the sum of squared fills grows."""

    def __init__(self, lengths: list[int], bins: list[list[int]], capacity: int) -> None:
        self.n, self.bins, self.capacity = lengths, bins, capacity
        self.fill = np.array([sum(lengths[i] for i in b) for b in bins], np.int64)

    def _table(self) -> None:
        """Of the underfull bins each distinct length and, as length 0, the empty place: bin, length, piece."""
        rows = [(b, m, i) for b in np.flatnonzero((self.fill > 0) & (self.fill < self.capacity)).tolist() for m, i in sorted({0: -1, **{self.n[i]: i for i in self.bins[b]}}.items())]
        self.at, self.length, self.piece = np.array(rows, np.int64).reshape(-1, 3).T

    def _best(self, u: int) -> tuple[int, tuple[int, ...], int, int] | None:
        """The exchange of u with any other underfull bin that raises the squares most: (bin, what leaves u, what comes back, tokens moved). Nothing, if none does."""
        mine: dict[int, tuple[int, ...]] = {}
        own = sorted((self.n[i], i) for i in self.bins[u])
        for k, (a, i) in enumerate(own):
            if k + 1 == len(own) or own[k + 1][0] != a:  # of each length one piece; two of it as well, if there are
                for b, j in own[:k]:
                    mine.setdefault(a + b, (i, j))
        mine |= {a: (i,) for a, i in own}
        sums = np.array(sorted(mine), np.int64)
        room = np.where(self.at == u, -1, self.capacity - self.fill[self.at])
        pick = np.searchsorted(sums, room + self.length, "right") - 1  # the largest that fits in the place of that piece
        moved = np.where((room >= 0) & (pick >= 0), sums[np.maximum(pick, 0)] - self.length, 0)
        gain = np.where(moved > 0, moved * (self.fill[self.at] - self.fill[u] + moved), 0)
        best = int(np.argmax(gain)) if gain.size else 0
        if not gain.size or gain[best] <= 0:
            return None
        return int(self.at[best]), mine[int(sums[pick[best]])], int(self.piece[best]), int(moved[best])

    def _shift(self, u: int, v: int, out: tuple[int, ...], back: int, moved: int) -> None:
        for i in out:
            self.bins[u].remove(i)
            self.bins[v].append(i)
        if back >= 0:
            self.bins[v].remove(back)
            self.bins[u].append(back)
        self.fill[u] -= moved
        self.fill[v] += moved

    def run(self) -> list[list[int]]:
        """Until as few bins are left as their sum needs or no exchange gains: each raises the squares, so it ends. The emptiest give first."""
        least = -(-int(self.fill.sum()) // self.capacity)
        gained = True
        while gained and int((self.fill > 0).sum()) > least:
            gained = False
            self._table()
            for u in sorted(np.flatnonzero((self.fill > 0) & (self.fill < self.capacity)).tolist(), key=lambda b: (self.fill[b], b)):
                while 0 < self.fill[u] < self.capacity and (found := self._best(u)):
                    v, out, back, moved = found
                    self._shift(u, v, out, back, moved)
                    self._table()
                    gained = True
        return [b for b in self.bins if b]


def pack_lengths(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    return _Search(lengths, best_fit(lengths, capacity), capacity).run()


def pack(rows: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """``rows`` (id, row, piece, start, length, ids_crc32; staged) with sequence_id and offset."""
    shards = max(1, -(-rows.count() // shard))

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "row", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        lengths = group["length"].tolist()
        sequence, offset = np.zeros(len(group), np.int64), np.zeros(len(group), np.int64)
        base = int(group["shard"].iloc[0]) << 32
        for k, b in enumerate(pack_lengths(lengths, capacity)):
            at = 0
            for i in b:
                sequence[i], offset[i] = base + k, at
                at += lengths[i]
        return group.drop(columns="shard").assign(sequence_id=sequence, offset=offset)

    kind = rows.schema["id"].dataType.simpleString()
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("row", "piece"), F.lit(shards)).cast("long"))
    return dealt.groupBy("shard").applyInPandas(fill, f"id {kind}, row long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocab: str | None = None, end_id: int = 0) -> DataFrame:
    """One row per piece: id, row, piece, start, length, ids_crc32, sequence_id, offset.

    Repeated rows are packed as often as they come; ids may be null; other columns are ignored; no rows give no rows.
    """
    return pack(stage(pieces(docs, id_col, text_col, capacity, vocab, end_id), "pieces"), capacity)


def sequences(rows: DataFrame) -> DataFrame:
    """The packed sequences: (sequence_id, length, parts), parts in place order."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "id", "piece", "start", "length")))
    return rows.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts"))
