"""Quality classifier by compression: one zstandard dictionary of good and one of bad labelled text.

A text is cut into pieces, each is compressed with both dictionaries, and the difference of the total sizes, normalised by
the text's own, is calibrated to a probability by logistic regression: it is the only input of the score. A bounded sample of
the labelled rows trains the dictionaries on their whole texts, another one the calibration; every text is scored in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare
from .shingles import texts

#: Labelled rows of a class that train its dictionary, with their whole texts; labelled rows that train the calibration.
DICTIONARY_ROWS, CALIBRATION_ROWS = 2000, 6000
#: Bytes of a piece and of a dictionary; the compression level.
PIECE, DICTIONARY_BYTES, LEVEL = 512, 524_288, 3
THRESHOLD = 0.7


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


@dataclass
class Compressor:
    """Compressed sizes under the two dictionaries; made anew in each process."""

    good: bytes
    bad: bytes
    made: list = field(default_factory=list, repr=False)

    def __getstate__(self):
        return {"good": self.good, "bad": self.bad, "made": []}

    def difference(self, text: bytes) -> float:
        """How much shorter the text gets with the good dictionary than with the bad one, by its own length."""
        if not self.made:
            for data in (self.good, self.bad):
                d = zstandard.ZstdCompressionDict(data)
                d.precompute_compress(level=LEVEL)
                self.made.append(zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
        good, bad = self.made
        g = b = 0
        for i in range(0, max(len(text), 1), PIECE):
            piece = text[i : i + PIECE]
            g += len(good(piece))
            b += len(bad(piece))
        return (b - g) / (len(text) + 16)


@dataclass
class QualityModel:
    compressor: Compressor | None
    mean: float = 0.0
    scale: float = 1.0
    weights: np.ndarray | None = None

    def scores(self, rows: list[bytes | None]) -> np.ndarray:
        x = np.array([self.compressor.difference(b or b"") for b in rows], float)
        return 1 / (1 + np.exp(-np.clip(design((x - self.mean) / self.scale) @ self.weights, -30, 30)))

    def score(self, docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
        """One row for each input row: doc_id, held_out, score (0 to 1, higher: good likelier), predicted (score >= threshold).

        Null texts count as empty and get the score of an empty text; a null id is not held out and stays null. Repeated
        rows are scored alike. A model fitted without rows of both classes rejects nothing: all scores are 1. An empty
        table gives no rows. Only the text is an input of the score; other columns are not read.
        """
        prepare(docs.sparkSession)
        rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"), F.coalesce(held_out(F.col(doc_id)), F.lit(False)).alias("held_out"))
        if self.compressor is None:
            scored = rows.select("doc_id", "held_out", F.lit(1.0).alias("score"))
        else:
            model = docs.sparkSession.sparkContext.broadcast(self)

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                m = model.value
                for batch in batches:
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(m.scores(texts(batch, "text")))], names=["doc_id", "held_out", "score"])

            scored = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
        return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))

    def keep(self, docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
        """The rows of docs, with all their columns, whose text scores threshold or more. Nothing is shuffled."""
        prepare(docs.sparkSession)
        if self.compressor is None:
            return docs
        model = docs.sparkSession.sparkContext.broadcast(self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = model.value
            for batch in batches:
                yield batch.filter(pa.array(m.scores(texts(batch, text)) >= threshold))

        return docs.mapInArrow(run, docs.schema)


def design(x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), x])


def _dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; of too few samples for training, their plain content."""
    size = min(DICTIONARY_BYTES, max(256, sum(map(len, samples)) // 2))
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def fit_quality(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> QualityModel:
    """Fits on labelled rows that are not held out. Null labels, ids and unlabelled rows are left out; of labels that
    repeat an id the least counts, of rows that repeat it each. Extra columns are not read."""
    prepare(docs.sparkSession)
    known = (
        labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
        .where(~held_out(F.col("doc_id"))).withColumn("rank", F.xxhash64("doc_id", F.lit("quality")))
    )
    part = known.where(F.col("rank") % 2 == 0)
    for_dictionaries = [part.where(f"quality = {q}").orderBy("rank").limit(DICTIONARY_ROWS) for q in (0, 1)]
    ids = for_dictionaries[0].union(for_dictionaries[1]).select("doc_id", "quality")
    source = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    # at most 2 * DICTIONARY_ROWS ids are broadcast, and as many texts come back, one after the other; of rows that repeat an
    # id one counts
    chosen = source.where("text <> ''").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    samples = ([], [])
    for r in chosen.orderBy("doc_id").toLocalIterator():
        b = r.text.encode()
        samples[r.quality].extend(b[i : i + PIECE] for i in range(0, len(b), PIECE))
    if not all(samples):
        return QualityModel(None)
    model = QualityModel(Compressor(good=_dictionary(samples[1]), bad=_dictionary(samples[0])))
    held = docs.sparkSession.sparkContext.broadcast(model.compressor)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [held.value.difference(b or b"") for b in texts(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.float64()), batch.column(2)], names=["doc_id", "x", "quality"])

    ids = known.where(F.col("rank") % 2 != 0).orderBy("rank").limit(CALIBRATION_ROWS).select("doc_id", "quality")
    rows = source.join(F.broadcast(ids), "doc_id").mapInArrow(measure, "doc_id long, x double, quality int").dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
    if len({r.quality for r in rows}) < 2:  # too few for two samples: the dictionaries' own rows calibrate
        rows = source.join(F.broadcast(known.orderBy("rank").limit(CALIBRATION_ROWS).select("doc_id", "quality")), "doc_id").mapInArrow(measure, "doc_id long, x double, quality int").orderBy("doc_id").collect()
    x, y = np.array([r.x for r in rows], float), np.array([r.quality for r in rows], float)
    model.mean, model.scale = float(x.mean()), float(x.std()) + 1e-9
    model.weights = _logistic(design((x - model.mean) / model.scale), y)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 60) -> np.ndarray:
    """Newton steps with a ridge, halved while they don't help."""
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    keep[0] = 1e-3
    loss = lambda w: np.logaddexp(0, -(2 * y - 1) * (x @ w)).sum() + (keep * w * w).sum() / 2
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (p - y) + keep * w)
        size = 1.0
        while loss(w - size * step) > loss(w) and size > 1e-4:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return w
