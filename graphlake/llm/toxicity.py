"""Toxicity by compression distance.

Two zstandard dictionaries are trained: the ordinary one on windows of ordinary text, the toxic one on windows of toxic text, those that the ordinary dictionary shortens least. The ordinary model is the ordinary dictionary; the toxic model has the toxic one in front of it, where the ordinary model has blanks, so all else lies equally far from a window. Each window of a text is compressed under both, and the bytes that the toxic model saves, over the whole text, go through a logistic curve whose threshold of 0.5 is calibrated by cross-fitting: each labelled document is measured with dictionaries that have not seen it.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphlake.llm.common import released, unused

WINDOW, STEP = 128, 64
MARGIN = 3  # bytes by which a window counts as toxic
MOST = 12.0  # bytes that one window's saving counts for, at most
SAMPLE = 1500  # labelled documents of each class that a model is fitted on, at most
SAMPLE_CHARS = 20_000  # of a document in that sample, at most; longer ones are left out of it
ORDINARY, TOXIC = 65_536, 1024  # bytes of the trained dictionaries, about
PIECE, SHIFT = 32, 8  # windows that the toxic dictionary is trained on
NOVEL = 0.15  # share of these windows that the ordinary dictionary shortens least
SEGMENT, KEYS = 12, 8  # of the trainer for the toxic dictionary: bytes of the segments it picks and of the strings it counts
FOLDS = 3


SETTINGS = zstd.ZstdCompressionParameters.from_level(9, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstd.FORMAT_ZSTD1_MAGICLESS, window_log=17, hash_log=17, chain_log=17, min_match=5)


def _windows(data: bytes, size: int = WINDOW, step: int = STEP) -> list[bytes]:
    return [data[i : i + size] for i in range(0, max(1, len(data) - size + step), step)]


def _compressor(dictionary: bytes) -> Callable[[bytes], bytes]:
    # As raw content: each dictionary's own entropy tables would add differences that have nothing to do with what a window says.
    return zstd.ZstdCompressor(compression_params=SETTINGS, dict_data=zstd.ZstdCompressionDict(dictionary, dict_type=zstd.DICT_TYPE_RAWCONTENT)).compress


def _dictionary(samples: list[bytes], size: int, segment: int) -> bytes:
    """A trained dictionary; of too few samples for the trainer, as many of them as it may hold, dealt evenly over all."""
    try:
        return zstd.train_dictionary(size, samples, k=segment, d=KEYS).as_bytes()
    except (zstd.ZstdError, ValueError):
        most = max(1, size // max(1, max(map(len, samples), default=1)))
        return b"".join(samples[:: max(1, -(-len(samples) // most))])


def _dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes]:
    """(toxic, ordinary): both models' dictionaries, of equal length."""
    common = _dictionary([w for t in ordinary for w in _windows(t)], ORDINARY, WINDOW)
    pieces = [w for t in toxic for w in _windows(t, PIECE, SHIFT)]
    short = _compressor(common.ljust(8))
    sizes = np.array([len(short(w)) for w in pieces])
    least = np.quantile(sizes, 1 - NOVEL)
    front = _dictionary([w for w, n in zip(pieces, sizes, strict=True) if n >= least], TOXIC, SEGMENT)
    return (front + common).ljust(8), (b" " * len(front) + common).ljust(8)


@dataclasses.dataclass(frozen=True)
class Model:
    """toxic and ordinary: the dictionaries; weights: of the features, the last a constant."""

    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]

    def scorer(self) -> Callable[[str | None], float]:
        """text -> score, from 0 to 1."""
        if not self.toxic:
            constant = float(self.weights[-1])
            return lambda text: constant
        saved, weights = _savings(self.toxic, self.ordinary), np.array(self.weights)
        return lambda text: float(1 / (1 + np.exp(-np.clip(_features(saved((text or "").encode("utf-8", "surrogatepass"))) @ weights, -30, 30))))


def _savings(toxic: bytes, ordinary: bytes) -> Callable[[bytes], np.ndarray]:
    """data -> by how many bytes each of its windows is shorter under the toxic dictionary."""
    a, b = _compressor(ordinary), _compressor(toxic)
    return lambda data: np.array([len(a(w)) - len(b(w)) for w in _windows(data)], np.float64)


def _features(d: np.ndarray) -> np.ndarray:
    """Of a text's savings: mean, greatest, mean of the three greatest, share of windows over the margin."""
    return np.array([d.mean(), min(d.max(), MOST), min(np.sort(d)[-3:].mean(), MOST), (d >= MARGIN).mean(), 1.0])


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted, by Newton's method with a small ridge."""
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(beta)), x.T @ (w * (y - p)) - 1e-3 * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def train(toxic: list[str], ordinary: list[str], prior: float = 0.1) -> Model:
    """A model from labelled texts; ``prior``: the share of toxic documents to calibrate for. Without four texts of each class every score is the prior."""
    if len(toxic) < 4 or len(ordinary) < 4:
        return Model(b"", b"", (min(max(prior, 0.0), 1.0),))
    t, o = ([x.encode("utf-8", "surrogatepass") for x in part] for part in (toxic, ordinary))
    x, y = [], []
    for k in range(FOLDS):
        rest = [[d for i, d in enumerate(part) if i % FOLDS != k] for part in (t, o)]
        saved = _savings(*_dictionaries(*rest))
        for label, part in ((1, t), (0, o)):
            x += [_features(saved(d)) for d in part[k::FOLDS]]
            y += [label] * len(part[k::FOLDS])
    x, y = np.stack(x), np.array(y, np.float64)
    w = np.where(y == 1, prior / y.sum(), (1 - prior) / (1 - y).sum()) * len(y)
    return Model(*_dictionaries(t, o), tuple(map(float, _logistic(x, y, w))))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, max_chars: int = SAMPLE_CHARS) -> Model:
    """A model from at most ``sample`` labelled documents of each class of at most ``max_chars`` code points, taken by a hash of their id.

    Of two labels of one id the greater counts, of two texts of one id the lesser; null ids and null labels are left out, null texts are empty, longer texts are not learned from (they are scored whole). Classes are weighed by their share of all labels. Without labels or documents of both classes every score is the share of toxic labels.
    """
    marks = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("y"))
    shares = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}
    total = sum(shares.values())
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter(F.length("text") <= max_chars)
    out: dict[int, list[str]] = {}
    for y in (1, 0):
        # Twice as many ids as wanted, as some have no document or a long one; their number is bounded, so they may be broadcast.
        ids = marks.filter(F.col("y") == y).select("id").orderBy(F.xxhash64("id"), "id").limit(2 * sample)
        own = texts.join(F.broadcast(ids), "id").groupBy("id").agg(F.min("text").alias("text"))
        rows = own.withColumn("h", F.xxhash64("id")).orderBy("h", "id").limit(sample).select("text")
        out[y] = [x.as_py() for x in rows.toArrow().column(0)]
    return train(out[1], out[0], shares.get(1, 0) / total if total else 0.0)


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with score (double, 0 to 1) and predicted (1 from 0.5 on); columns of these names are replaced.

    Whole texts are scored, null as empty, which still has a score; repeated rows stay; no rows give no rows.
    """
    docs = docs.drop("score", "predicted")
    return _with_score(docs, model, text_col, "score").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def ordinary(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below 0.5, with all their columns, whatever their names; nulls, repeats and no rows as in ``scored``."""
    (score,) = unused(docs.columns, "score")
    return _with_score(docs, model, text_col, score).filter(F.col(f"`{score}`") < 0.5).drop(score)


def _with_score(docs: DataFrame, model: Model, text_col: str, name: str) -> DataFrame:
    names, at = [*docs.columns, name], docs.columns.index(text_col)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([score(t.as_py()) for t in b.column(at)], pa.float64())], names=names)

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 5; 0 is held out."""
    return (F.crc32(F.col(id_col).cast("string").cast("binary")) % 5).cast("int")
