"""Alignment of two tokenizers' tokens by elementary intervals.

Both tokenizers cut the same bytes. The sorted union of their tokens' ends cuts a text into elementary intervals; each lies in one token of either side, which a binary search finds, and is the overlap of just these two. Ends that both share close groups. A task works on slices of many texts at once, laid end to end, as the end of a text is an end on both sides.

A pair of ids is counted by the documents that hold it linked. The pairs that most documents hold go to all tasks, up to a fixed number; what is left has no frequent pair any more and is joined by shuffles.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlake.llm.common import released, stage, unstage
from graphlake.llm.tokens import _byte_letters

SLICE = 1 << 19  # bytes of text at once, or one text
FREQUENT = 2_000_000  # pairs with their counts that every task holds, at most, some 26 MB
MARKS = np.frombuffer(b",|;", np.uint8)
#: Fixed value: the pattern by which byte-level vocabularies of this kind split texts.
BYTE_CHUNK = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: What every version of Unicode tells apart alike; texts with other characters go through the vocabulary's own library.
CERTAIN = regex.compile(r"[\t\n\x0B\x0C\r -~\xA1-\xAC\xAE-\u024F]*")


def _byte_side(path: str) -> tuple[Callable[[list[str]], list[np.ndarray]], list[bytes]]:
    """(encode, bytes by id) of a byte-level BPE file.

    If its merges stand in the order of their ids, as they do where ids were given out while merging, the same ids come several times faster out of a merger by ranks.
    """
    import tiktoken
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    byte = {c: i for i, c in enumerate(_byte_letters())}
    data = [b""] * (1 + max(own.get_vocab().values()))
    for token, i in own.get_vocab().items():
        data[i] = bytes([byte[c] for c in token]) if all(c in byte for c in token) else token.encode()
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [model["vocab"].get("".join(m), -1) for m in merges]
    ranked = all(x < y for x, y in zip(made, made[1:], strict=False)) and not model.get("ignore_merges")
    top = max(made, default=0)
    by_rank = tiktoken.Encoding("ranks", pat_str=BYTE_CHUNK, mergeable_ranks={data[i]: i for i in model["vocab"].values() if i <= top}, special_tokens={}) if ranked and made else None

    def encode(texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for t in texts:
            if by_rank and CERTAIN.fullmatch(t):
                out.append(by_rank.encode_to_numpy(t, disallowed_special=()))
            else:
                out.append(np.array(own.encode(t, add_special_tokens=False).ids, np.uint32))
        return out

    return encode, data


def _piece_side(path: str) -> tuple[Callable[[list[str]], list[np.ndarray]], list[bytes]]:
    """(encode, bytes by id) of a piece model that puts a space in front by itself."""
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [own.id_to_piece(i) for i in range(own.get_piece_size())]
    data = [bytes([int(p[3:5], 16)]) if own.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
    return (lambda texts: [np.array(ids, np.uint32) for ids in own.encode([t[1:] for t in texts], num_threads=1)]), data


class Sides:
    """Both tokenizers, the bytes of their ids, and the decimal digits of all ids."""

    def __init__(self, a_path: str, b_path: str) -> None:
        self.a, self.a_data = _byte_side(a_path)
        self.b, self.b_data = _piece_side(b_path)
        self.a_size, self.b_size = (np.array([len(t) for t in data], np.int64) for data in (self.a_data, self.b_data))
        digits = [str(i).encode() for i in range(max(len(self.a_data), len(self.b_data)))]
        wide = len(digits[-1])
        self.n_digits = np.array([len(d) for d in digits])
        # A column for the mark that follows.
        self.digits = np.frombuffer(b"".join(d.ljust(wide + 1) for d in digits), np.uint8).reshape(-1, wide + 1)
        self.used = (np.arange(wide + 1) < self.n_digits[:, None]) | (np.arange(wide + 1) == wide)

    def cut(self, texts: list[str | None]) -> Cut:
        """The tokens of texts, where both sides join to a space and the text."""
        some = [i for i, t in enumerate(texts) if t]
        spaced = [" " + texts[i] for i in some]
        a, b = self.a(spaced), self.b(spaced)
        joined = lambda data, ids: b"".join([data[i] for i in ids.tolist()])
        good = [n for n, t in enumerate(spaced) if joined(self.a_data, a[n]) == t.encode() == joined(self.b_data, b[n])]
        return Cut(self, len(texts), [some[n] for n in good], [a[n] for n in good], [b[n] for n in good])


def _counted(bounds: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """How many of the rising ``marks`` lie in each of the texts that end at ``bounds``."""
    return np.diff(np.searchsorted(marks, bounds, "right"), prepend=0)


class Cut:
    """The alignment of a slice of texts, those at ``own`` of ``n``, from their ids on either side."""

    def __init__(self, sides: Sides, n: int, own: list[int], a: list[np.ndarray], b: list[np.ndarray]) -> None:
        self.sides, self.n, self.own = sides, n, np.array(own, np.int64)
        self.a, self.b = (np.concatenate(ids) if ids else np.zeros(0, np.uint32) for ids in (a, b))
        self.a_ends, self.b_ends = sides.a_size[self.a].cumsum(), sides.b_size[self.b].cumsum()
        self.bounds = self.a_ends[np.cumsum([len(ids) for ids in a]) - 1] if own else np.zeros(0, np.int64)
        self.ends = np.union1d(self.a_ends, self.b_ends)
        self.of_a, self.of_b = np.searchsorted(self.a_ends, self.ends), np.searchsorted(self.b_ends, self.ends)
        self.shared = (self.a_ends[self.of_a] == self.ends) & (self.b_ends[self.of_b] == self.ends)
        self.closed = self.ends[self.shared]

    def _told(self, counts: np.ndarray) -> np.ndarray:
        """A number for each text, 0 for those without tokens."""
        out = np.zeros(self.n, np.int64)
        out[self.own] = counts
        return out

    def numbers(self) -> dict[str, np.ndarray]:
        return {name: self._told(_counted(self.bounds, marks)) for name, marks in (("n_a", self.a_ends), ("n_b", self.b_ends), ("n_groups", self.closed), ("n_links", self.ends))}

    def groups(self) -> list[bytes]:
        """Each text's groups, as in a1,a2|b1;a3|b2,b3; empty without tokens."""
        out = [b""] * self.n
        if len(self.own):
            s, n_a, n_b = self.sides, len(self.a), len(self.b)
            # How many tokens either side has up to the end of each group: A's of a group come before B's.
            to_a, to_b = self.of_a[self.shared] + 1, self.of_b[self.shared] + 1
            place_a = np.arange(n_a) + np.repeat(np.r_[0, to_b[:-1]], np.diff(to_a, prepend=0))
            place_b = np.arange(n_b) + np.repeat(to_a, np.diff(to_b, prepend=0))
            ids, mark = np.empty(n_a + n_b, np.int64), np.zeros(n_a + n_b, np.int64)
            ids[place_a], ids[place_b] = self.a, self.b
            mark[place_a[to_a - 1]], mark[place_b[to_b - 1]] = 1, 2
            letters = s.digits[ids]
            letters[:, -1] = MARKS[mark]
            flat = letters[s.used[ids]].tobytes()
            stops = (s.n_digits[ids] + 1).cumsum()[place_b[self.of_b[np.searchsorted(self.ends, self.bounds)]]].tolist()
            for i, lo, hi in zip(self.own.tolist(), [0, *stops[:-1]], stops, strict=True):
                out[i] = flat[lo : hi - 1]
        return out

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, pair, times): each text's distinct pairs a * |B| + b and how often it holds each; ``first``: where each text's begin, and the end."""
        n_b = len(self.sides.b_data)
        width = len(self.sides.a_data) * n_b
        row = np.searchsorted(self.bounds, self.ends)
        keys, times = np.unique(row * width + self.a[self.of_a].astype(np.int64) * n_b + self.b[self.of_b], return_counts=True)
        counts = self._told(np.bincount(keys // width, minlength=len(self.own)))
        return np.concatenate([[0], counts.cumsum()]), keys % width, times


@functools.lru_cache(maxsize=1)
def sides(a_path: str, b_path: str) -> Sides:
    return Sides(a_path, b_path)


def _paths(a_path: str | None, b_path: str | None) -> tuple[str, str]:
    if a_path and b_path:
        return a_path, b_path
    import public_tokenizers

    return a_path or public_tokenizers.path("byte_bpe_50k.json"), b_path or public_tokenizers.path("piece_bpe_32k.model")


def _slices(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of rows of about SLICE bytes."""
    sizes = texts.cast(pa.large_binary()).fill_null(b"")
    ends = np.diff(np.frombuffer(sizes.buffers()[1], np.int64, len(sizes) + 1, 8 * sizes.offset)).cumsum() if len(sizes) else np.zeros(0)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SLICE, "right")))
        yield lo, texts.slice(lo, hi - lo).to_pylist()
        lo = hi


def _lists(first: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values, kind))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """(id, groups): the groups of each text as ``a1,a2|b1;a3|b2,b3``, ids in their order; rows, nulls and texts as in ``aligned``."""
    where = _paths(a_path, b_path)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, texts in _slices(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, len(texts)), pa.array([g.decode() for g in sides(*where).cut(texts).groups()], pa.string())], names=["id", "groups"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, groups string")


def _cut_texts(docs: DataFrame, where: tuple[str, str], kind: str) -> DataFrame:
    """A row per text: its numbers, the hash of its groups, its distinct pairs and how often it holds each."""
    arrow = pa.int32() if kind == "int" else pa.int64()

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, texts in _slices(b.column(2)):
                own = sides(*where).cut(texts)
                first, pairs, times = own.pairs()
                shas = [hashlib.sha256(g).hexdigest() if g else "" for g in own.groups()]
                numbers = {name: pa.array(n, pa.int64()) for name, n in own.numbers().items()}
                yield pa.RecordBatch.from_pydict(
                    {"key": b.column(0).slice(lo, len(texts)), "id": b.column(1).slice(lo, len(texts)), **numbers, "groups_sha256": pa.array(shas, pa.string()), "pairs": _lists(first, pairs, arrow), "times": _lists(first, times, pa.int32())}
                )

    return docs.mapInArrow(run, f"key long, id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<{kind}>, times array<int>")


def _summed(cut: DataFrame, frequent: tuple[np.ndarray, np.ndarray, np.ndarray], kind: str, rest: bool) -> DataFrame:
    """``cut`` with n_best and count_sum over its frequent pairs; ``rest``: with its other pairs."""
    sc, arrow = cut.sparkSession.sparkContext, pa.int32() if kind == "int" else pa.int64()
    held = sc.broadcast(frequent)
    kept = ["key", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, best = held.value
        for b in batches:
            lists, times = b.column("pairs"), b.column("times").flatten().to_numpy().astype(np.int64)
            pairs, first = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            at = np.minimum(np.searchsorted(known, pairs), max(len(known) - 1, 0))
            met = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)
            sums = []
            for weights in (best, counts):
                add = np.zeros(len(pairs), np.int64)
                if len(known):
                    add[met] = weights[at[met]] * times[met]
                sums.append(pa.array(np.diff(np.concatenate([[0], add.cumsum()])[first]), pa.int64()))
            out = [*(b.column(c) for c in kept), *sums]
            if rest:
                left = np.concatenate([[0], (~met).cumsum()])[first]
                out += [_lists(left, pairs[~met], arrow), _lists(left, times[~met], pa.int32())]
            yield pa.RecordBatch.from_arrays(out, names=[*kept, "n_best", "count_sum", *(["pairs", "times"] if rest else [])])

    ddl = "key long, id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    return cut.mapInArrow(run, ddl + (f", pairs array<{kind}>, times array<int>" if rest else ""))


def aligned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256): one row per row of ``docs``.

    A (a byte-level BPE file) encodes a space and the text, B (a piece model that adds the space) the text, neither with special tokens. Links are the overlaps of an A and a B token; count_sum adds up, over a text's links, how many documents hold the ids of each linked; n_best counts the links whose pair is held by as many documents as any of its A id. Texts that are null or empty, or that either side does not give back byte for byte, have no tokens: zeros, and '' for the hash. Rows are documents, so repeats count each time; ids may be null; texts of any length are cut whole; an empty table gives no rows; other columns are ignored.
    """
    spark, where = docs.sparkSession, _paths(a_path, b_path)
    both = sides(*where)
    n_b = len(both.b_data)
    kind = "int" if len(both.a_data) * n_b < 1 << 31 else "bigint"
    own = docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    cut = stage(_cut_texts(own, where, kind), "token-links")
    counts = cut.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")).withColumn("a", F.expr(f"int(pair div {n_b})"))
    counts = stage(counts, "pair-counts")
    most = F.broadcast(counts.groupBy("a").agg(F.max("n").alias("most")))  # no more rows than A has ids
    counts = counts.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))
    size = F.floor(F.log2("n"))
    least, held = 64, 0
    for r in sorted(counts.groupBy(size.alias("size")).count().collect(), reverse=True):
        if held + r["count"] > FREQUENT:
            break
        least, held = r.size, held + r["count"]
    else:
        least = 0
    table = counts.filter(size >= least).toArrow()
    frequent = [table.column(c).to_numpy() for c in ("pair", "n", "best")]
    order = np.argsort(frequent[0])
    out = _summed(cut, tuple(c[order] for c in frequent), kind, least > 0)
    if least:
        out = stage(out, "frequent-sums")
        rows = out.select("key", F.explode(F.arrays_zip("pairs", "times")).alias("e")).select("key", F.col("e.pairs").alias("pair"), F.col("e.times").alias("times"))
        rows = rows.join(counts.filter(size < least), "pair")
        rare = rows.groupBy("key").agg(F.sum(F.col("best") * F.col("times")).alias("rare_best"), F.sum(F.col("n") * F.col("times")).alias("rare_sum"))
        added = lambda c, r: (F.col(c) + F.coalesce(r, F.lit(0))).alias(c)
        out = out.join(rare, "key", "left").select("*", added("n_best", "rare_best").alias("b"), added("count_sum", "rare_sum").alias("c")).drop("n_best", "count_sum").withColumnsRenamed({"b": "n_best", "c": "count_sum"})
    return out.select("id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
