"""Token ids of a lower-casing, white-space-dropping word-end BPE vocabulary, by words.

The vocabulary's pre-tokenizer never joins what white space parts, so a text's ids are those of its chunks. Arrow splits texts and numbers the distinct chunks of a batch; only those are looked up. Plain words go straight to the BPE model and are kept in a bounded table, all others go through the whole tokenizer.
"""

from __future__ import annotations

import functools
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A word of letters that normalisation only lower-cases.
PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
MARKS = b".,!?;:"  # each is a token of its own after a word
TABLE = 450_000  # words held by a worker, some 100 MB
SLICE = 16 << 20  # bytes of text at once


def _byte_letters() -> list[str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return [letter for _, letter in sorted({b: chr(b) for b in plain}.items() | {b: chr(256 + i) for i, b in enumerate(rest)}.items())]


class Chunks:
    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.bpe = self.whole.model
        self.letters = _byte_letters()
        self.marks = {m: self._slow(chr(m)) for m in MARKS}
        self.words: dict[bytes, bytes] = {}

    def _slow(self, chunk: str) -> bytes:
        return np.array(self.whole.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def of(self, chunk: bytes) -> bytes:
        """A chunk's ids as little-endian unsigned 32-bit bytes."""
        if (out := self.words.get(chunk)) is not None or not chunk:
            return out or b""
        mark = self.marks.get(chunk[-1])
        if mark is not None and (out := self.words.get(chunk[:-1])) is not None:
            return out + mark
        core = chunk if mark is None else chunk[:-1]
        word = core.decode("utf-8", "surrogatepass")
        if not PLAIN.fullmatch(word):
            return self._slow(chunk.decode("utf-8", "surrogatepass"))
        letters = self.letters
        ids = [t.id for t in self.bpe.tokenize("".join([letters[b] for b in word.lower().encode()]))]
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(self.words) >= TABLE:
            self.words.clear()
        self.words[core] = out
        return out if mark is None else out + mark

    def ids(self, texts: pa.Array) -> Iterator[memoryview]:
        """For each text (null: empty) its ids' bytes."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SLICE, "right")))
            parts = pc.ascii_split_whitespace(texts.slice(lo, hi - lo))
            coded = parts.flatten().dictionary_encode()
            of = self.of
            distinct = pa.array([of(c) for c in coded.dictionary.cast(pa.binary()).to_pylist()], pa.large_binary())
            taken = distinct.take(coded.indices)
            n = len(taken)
            if n:
                starts = np.frombuffer(taken.buffers()[1], np.int64, n + 1, 8 * taken.offset)
                data = memoryview(taken.buffers()[2] or b"")
            else:
                starts, data = np.zeros(1, np.int64), memoryview(b"")
            first = np.asarray(parts.offsets.to_numpy(), np.int64)
            bounds = starts[first - first[0]]
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                yield data[a:b]
            lo = hi


@functools.lru_cache(maxsize=1)
def chunks(path: str) -> Chunks:
    return Chunks(path)


def vocabulary(path: str | None = None) -> str:
    """The vocabulary's file: as given, else from the installed public tokenizers."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
