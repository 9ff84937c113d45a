"""Reversible line dedup: sharded cuckoo filters backed by exact reference counts.

The index is two tables. ``counts`` has, per line key, the number of documents that hold it. ``filters`` has, per shard of the key space, a cuckoo filter of the keys that reached the threshold. Inserting or deleting documents adjusts the counts and puts the keys that crossed the threshold into their shard's filter or takes them out, so a deletion undoes an insertion exactly. Lines are dropped where the filter answers and the exact table confirms.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphlake.llm.common import released, stage, unused

BLANK = b" \t\n\x0b\x0c\r"
SLOTS = 4  # per bucket
SHARDS = 64  # of the key space, at least
SHARD_KEYS = 100_000  # keys of a shard, about, when the index is built
PASS_KEYS = 1_000_000  # keys over the threshold up to which filters and exact table are broadcast; of more, lines travel to their shard
SALTS = 16  # parts that a shard's lines are dealt to, as one line may be very common


def key_of(line: bytes) -> bytes | None:
    """A line's key as 16 bytes of BLAKE2b, None if nothing is left of it: stripped of ASCII white space, A-Z lower-cased."""
    line = line.strip(BLANK).lower()
    return hashlib.blake2b(line, digest_size=16).digest() if line else None


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; a key may lie in two buckets, each known from the other and the fingerprint."""

    def __init__(self, capacity: int = 64) -> None:
        self.buckets = 1 << max(2, int(np.ceil(np.log2(max(1, capacity) / SLOTS / 0.85))))
        self.table = np.zeros((self.buckets, SLOTS), np.uint16)

    @staticmethod
    def parts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """keys: n x 16 bytes -> fingerprints (never 0) and the hashes that give the first bucket."""
        words = np.ascontiguousarray(keys).view("<u2").reshape(-1, 8)
        return np.where(words[:, 7] == 0, np.uint16(1), words[:, 7]), np.ascontiguousarray(words[:, 2:4]).view("<u4").ravel().astype(np.int64)

    @staticmethod
    def shift(fp: np.ndarray) -> np.ndarray:
        return (fp.astype(np.int64) * 0x5BD1E995 >> 3) & 0xFFFFFFF

    def _spots(self, key: bytes) -> tuple[int, int, int]:
        fp, h = self.parts(np.frombuffer(key, np.uint8))
        one = int(h[0]) & (self.buckets - 1)
        return int(fp[0]), one, (one ^ int(self.shift(fp)[0])) & (self.buckets - 1)

    def __contains__(self, key: bytes) -> bool:
        fp, one, two = self._spots(key)
        return bool((self.table[one] == fp).any() or (self.table[two] == fp).any())

    def insert(self, key: bytes) -> bool:
        """False if no place was found; the table is then as it was."""
        fp, one, two = self._spots(key)
        for at in (one, two):
            free = np.flatnonzero(self.table[at] == 0)
            if free.size:
                self.table[at, free[0]] = fp
                return True
        moves, at = [], one
        for k in range(500):
            slot = (fp + k) % SLOTS
            moves.append((at, slot, int(self.table[at, slot])))
            fp, self.table[at, slot] = int(self.table[at, slot]), fp
            at = (at ^ int(self.shift(np.array([fp], np.uint16))[0])) & (self.buckets - 1)
            free = np.flatnonzero(self.table[at] == 0)
            if free.size:
                self.table[at, free[0]] = fp
                return True
        for at, slot, was in reversed(moves):
            self.table[at, slot] = was
        return False

    def delete(self, key: bytes) -> bool:
        fp, one, two = self._spots(key)
        for at in (one, two):
            here = np.flatnonzero(self.table[at] == fp)
            if here.size:
                self.table[at, here[0]] = 0
                return True
        return False

    @classmethod
    def of(cls, keys: list[bytes]) -> CuckooFilter:
        size = len(keys)
        while True:
            out = cls(size)
            if all(out.insert(k) for k in keys):
                return out
            size = 2 * max(size, 4)

    def dump(self) -> bytes:
        return self.table.astype("<u2").tobytes()

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        out = cls.__new__(cls)
        out.table = np.frombuffer(data, "<u2").reshape(-1, SLOTS).copy()
        out.buckets = len(out.table)
        return out


def line_keys(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(key): for each document each of its distinct keys once."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys: list[bytes] = []
            for t in b.column(0):
                keys += {k for line in (t.as_py() or "").encode("utf-8", "surrogatepass").split(b"\n") if (k := key_of(line))}
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary())], names=["key"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "key binary")


def _count(docs: DataFrame, text_col: str) -> DataFrame:
    return line_keys(docs, text_col).groupBy("key").agg(F.count("*").alias("n"))


def _shard(shards: int):  # noqa: ANN202
    return F.conv(F.hex(F.substring("key", 1, 2)), 16, 10).cast("int") % shards


class _Lookup:
    """Filters and exact keys of some shards, for whole batches at once."""

    def __init__(self, filters: dict[int, bytes], keys: bytes, shards: int) -> None:
        self.shards = shards
        self.start, self.mask, tables, at = np.full(shards, -1, np.int64), np.zeros(shards, np.int64), [], 0
        for s, data in sorted(filters.items()):
            t = np.frombuffer(data, "<u2").reshape(-1, SLOTS)
            self.start[s], self.mask[s] = at, len(t) - 1
            tables.append(t)
            at += len(t)
        self.table = np.concatenate(tables) if tables else np.zeros((1, SLOTS), np.uint16)
        k = np.frombuffer(keys, ">u8").reshape(-1, 2).astype(np.uint64)
        self.keys = k[np.lexsort((k[:, 1], k[:, 0]))]

    def hits(self, keys: np.ndarray) -> np.ndarray:
        """keys: n x 16 bytes -> whether each is to be dropped."""
        out = np.zeros(len(keys), bool)
        shard = np.ascontiguousarray(keys[:, :2]).view(">u2").ravel().astype(np.int64) % self.shards
        fp, h = CuckooFilter.parts(keys)
        start, mask = self.start[shard], self.mask[shard]
        one = h & mask
        two = (one ^ CuckooFilter.shift(fp)) & mask
        at = np.maximum(start, 0)
        maybe = np.flatnonzero((start >= 0) & ((self.table[at + one] == fp[:, None]).any(1) | (self.table[at + two] == fp[:, None]).any(1)))
        if maybe.size:
            k = np.ascontiguousarray(keys[maybe]).view(">u8").reshape(-1, 2).astype(np.uint64)
            lo, hi = np.searchsorted(self.keys[:, 0], k[:, 0]), np.searchsorted(self.keys[:, 0], k[:, 0], "right")
            out[maybe] = [bool((self.keys[a:b, 1] == x).any()) for a, b, x in zip(lo, hi, k[:, 1], strict=True)]
        return out


class LineIndex:
    """The index over some documents; ``insert`` and ``delete`` give the index over more or fewer."""

    def __init__(self, counts: DataFrame, filters: DataFrame, threshold: int, shards: int) -> None:
        self.counts, self.filters, self.threshold, self.shards = counts, filters, threshold, shards

    @classmethod
    def build(cls, docs: DataFrame, threshold: int = 10, shards: int | None = None, text_col: str = "text") -> LineIndex:
        """The index of ``docs``; ``shards``, if not given, follows the number of keys over the threshold.

        A document counts a key once, however often it holds it; a row that is repeated is a document each time. Null and empty texts and blank lines have no key. No rows give an empty index. Only the texts are read, other columns are ignored.
        """
        counts = stage(_count(docs, text_col), "line-counts")
        shards = shards or max(SHARDS, -(-counts.filter(F.col("n") >= threshold).count() // SHARD_KEYS))
        return cls(counts, cls._fresh(counts, threshold, shards), threshold, shards)

    @staticmethod
    def _fresh(counts: DataFrame, threshold: int, shards: int) -> DataFrame:
        def fill(group: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"shard": [int(group["shard"].iloc[0])], "data": [CuckooFilter.of(sorted(group["key"])).dump()]})

        full = counts.filter(F.col("n") >= threshold).select(_shard(shards).alias("shard"), "key")
        return stage(full.groupBy("shard").applyInPandas(fill, "shard int, data binary"), "line-filters")

    def _changed(self, delta: DataFrame) -> LineIndex:
        """delta: (key, n), n the change."""
        old = self.counts.select("key", F.col("n").alias("was"))
        both = old.join(delta.withColumnRenamed("n", "by"), "key", "full_outer")
        both = stage(both.select("key", F.coalesce("was", F.lit(0)).alias("was"), (F.coalesce("was", F.lit(0)) + F.coalesce("by", F.lit(0))).alias("n")), "line-counts")
        least, t, shards = both.agg(F.min("n")).first()[0], self.threshold, self.shards
        if least is not None and least < 0:
            raise ValueError("a document was deleted that had not been inserted")
        moved = both.filter((F.col("was") >= t) != (F.col("n") >= t)).select(_shard(shards).alias("shard"), "key", (F.col("n") >= t).alias("enters"))
        exact = both.filter(F.col("n") >= t).select(_shard(shards).alias("shard"), "key")
        touched = moved.select("shard").distinct()

        def change(filters: pd.DataFrame, moves: pd.DataFrame) -> pd.DataFrame:
            if moves.empty:
                return filters[["shard", "data"]]
            enters = moves["enters"].astype(bool)
            f = CuckooFilter.load(filters["data"].iloc[0]) if len(filters) else CuckooFilter(len(moves))
            for key in moves["key"][~enters]:
                f.delete(key)
            fits = all([f.insert(key) for key in sorted(moves["key"][enters])])
            return pd.DataFrame({"shard": [int(moves["shard"].iloc[0])], "data": [f.dump() if fits else b""]})

        new = stage(self.filters.groupBy("shard").cogroup(moved.groupBy("shard")).applyInPandas(change, "shard int, data binary"), "line-filters")
        if new.filter(F.length("data") == 0).limit(1).count():  # a shard outgrew its filter: made anew from the exact table
            over = new.filter(F.length("data") == 0).select("shard").join(touched, "shard")

            def fill(group: pd.DataFrame) -> pd.DataFrame:
                return pd.DataFrame({"shard": [int(group["shard"].iloc[0])], "data": [CuckooFilter.of(sorted(group["key"])).dump()]})

            new = stage(new.filter(F.length("data") > 0).unionByName(exact.join(over, "shard").groupBy("shard").applyInPandas(fill, "shard int, data binary")), "line-filters")
        return LineIndex(both.filter("n > 0").select("key", "n"), new, t, shards)

    def insert(self, docs: DataFrame, text_col: str = "text") -> LineIndex:
        """The index with ``docs`` as well; rows and nulls count as in ``build``, a document that is inserted twice counts twice."""
        return self._changed(_count(docs, text_col))

    def delete(self, docs: DataFrame, text_col: str = "text") -> LineIndex:
        """The index without ``docs``, which must have been inserted: a ValueError if any key's count fell below zero, as when a document is deleted twice. Texts without keys may always be deleted."""
        return self._changed(_count(docs, text_col).select("key", (-F.col("n")).alias("n")))

    def apply(self, docs: DataFrame, text_col: str = "text", n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
        """``docs`` with ``text_col`` less its dropped lines, ``n_lines`` (before) and ``n_dropped``.

        A null text counts as one empty line and becomes the empty text; texts of any length are read whole. Lines without a key stay. Columns of the two counts' names are replaced; rows repeat as they are repeated; no rows give no rows.
        """
        out = docs.withColumn(n_lines, F.size(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)).cast("long")).withColumn(n_dropped, F.lit(0).cast("long"))
        out = out.withColumn(text_col, F.coalesce(F.col(text_col), F.lit("")))
        full = self.counts.filter(F.col("n") >= self.threshold).select("key")
        if full.limit(PASS_KEYS + 1).count() > PASS_KEYS:
            return self._joined(out, full, text_col, n_dropped)
        filters = {r.shard: bytes(r.data) for r in self.filters.collect()}
        keys = b"".join(x.as_py() for x in full.toArrow().column(0))
        return _dropped(out, text_col, n_dropped, docs.sparkSession.sparkContext.broadcast((filters, keys, self.shards)))

    def _joined(self, docs: DataFrame, full: DataFrame, text_col: str, n_dropped: str) -> DataFrame:
        """Lines go to the filter of their shard, those it answers to the exact keys, and the numbers of the lines to drop back to their texts: one pass for any number of keys, and nothing on the driver."""
        names = unused(docs.columns, "t0", "t1", "gone")
        marks = [F.xxhash64(F.lit(k), F.col(text_col)) for k in (0, 1)]  # two hashes of 64 bits name a text
        shards = self.shards

        @released
        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for t, t0, t1 in zip(*(b.column(k) for k in range(3)), strict=True):
                    found = [(i, k) for i, line in enumerate(t.as_py().encode("utf-8", "surrogatepass").split(b"\n")) if (k := key_of(line))]
                    for a in range(0, len(found), 20_000):
                        at, keys = zip(*found[a : a + 20_000], strict=True)
                        shard = [int.from_bytes(k[:2], "big") % shards for k in keys]
                        yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array([t0.as_py()] * len(at), pa.int64()), pa.array([t1.as_py()] * len(at), pa.int64()), pa.array(at, pa.int32()), pa.array(keys, pa.binary())], names=["shard", "t0", "t1", "line", "data"])

        texts = docs.select(F.col(text_col), marks[0].alias("t0"), marks[1].alias("t1")).dropDuplicates(["t0", "t1"])
        lines = texts.mapInArrow(split, "shard int, t0 long, t1 long, line int, data binary")
        lines = lines.select("shard", F.pmod(F.xxhash64("t0", "line"), F.lit(SALTS)).cast("int").alias("salt"), F.lit(1).alias("kind"), "t0", "t1", "line", "data")
        none = F.lit(0).cast("long")
        lead = self.filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(0).alias("kind"), none.alias("t0"), none.alias("t1"), F.lit(0).alias("line"), "data")

        @released
        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, own = None, None
            for b in batches:
                keep = []
                for i, (shard, salt, kind, data) in enumerate(zip(*(b.column(k).to_pylist() for k in (0, 1, 2, 6)), strict=True)):
                    if kind == 0:
                        at, own = (shard, salt), CuckooFilter.load(data)
                    elif at == (shard, salt) and data in own:
                        keep.append(i)
                yield pa.RecordBatch.from_arrays([b.column(k).take(pa.array(keep, pa.int64())) for k in (3, 4, 5, 6)], names=["t0", "t1", "line", "key"])

        asked = lines.unionByName(lead).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind").mapInArrow(ask, "t0 long, t1 long, line int, key binary")
        sure = asked.join(full, "key", "left_semi").groupBy("t0", "t1").agg(F.collect_list("line").alias("gone"))
        out = docs.withColumns(dict(zip(names[:2], marks, strict=True))).join(sure.toDF(*names), names[:2], "left")
        gone = F.col(names[2])
        left = F.array_join(F.transform(F.filter(F.transform(F.split(F.col(text_col), "\n", -1), lambda line, i: F.struct(line.alias("line"), i.alias("i"))), lambda x: ~F.array_contains(gone, x["i"])), lambda x: x["line"]), "\n")
        out = out.withColumn(text_col, F.when(gone.isNull(), F.col(text_col)).otherwise(left)).withColumn(n_dropped, F.coalesce(F.size(gone), F.lit(0)).cast("long"))
        return out.drop(*names)


def _dropped(docs: DataFrame, text_col: str, n_dropped: str, shared) -> DataFrame:  # noqa: ANN001
    names = docs.columns
    at, at_n = names.index(text_col), names.index(n_dropped)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _Lookup(*shared.value)
        for b in batches:
            texts, owners, keys, split = [t.as_py() for t in b.column(at)], [], [], {}
            for i, t in enumerate(texts):
                lines = split[i] = t.encode("utf-8", "surrogatepass").split(b"\n")
                for j, line in enumerate(lines):
                    if key := key_of(line):
                        owners.append((i, j))
                        keys.append(key)
            gone = b.column(at_n).to_numpy().copy()
            if keys:
                hit: dict[int, set[int]] = {}
                for k in np.flatnonzero(lookup.hits(np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 16))):
                    i, j = owners[k]
                    hit.setdefault(i, set()).add(j)
                for i, drop in hit.items():
                    texts[i] = b"\n".join(line for j, line in enumerate(split[i]) if j not in drop).decode("utf-8", "surrogatepass")
                    gone[i] += len(drop)
            columns = list(b.columns)
            columns[at], columns[at_n] = pa.array(texts, pa.string()), pa.array(gone, pa.int64())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema]))


def dedup_lines(docs: DataFrame, threshold: int = 10, text_col: str = "text", **names: str) -> DataFrame:
    """Drop the lines whose keys ``threshold`` documents or more hold, in every document; nulls, repeats, long texts and clashing names as in ``LineIndex.apply``, which ``names`` goes to."""
    return LineIndex.build(docs, threshold, text_col=text_col).apply(docs, text_col, **names)


ORACLE = r"""
WITH l AS (SELECT rowid AS r, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
           FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents)),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped, sha256(coalesce(string_agg(CASE WHEN c.key IS NULL THEN line END, chr(10) ORDER BY i), '')) AS kept_sha256
FROM k LEFT JOIN c ON k.key = c.key GROUP BY r, doc_id
"""
