"""Quality score from compressed sizes under two dictionaries (operator 7).

One zstandard dictionary is built from texts labelled good and one from texts
labelled bad, from every other text of a sample by hash. A text is cut into
chunks, each compressed with either; the normalised differences of the sizes
(between the dictionaries, of the whole text and of its chunks that differ
most, and between the text itself and its size under the good dictionary) are
calibrated to a probability by a logistic fit on labelled texts that are in
neither dictionary.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, pick, pieces, small_batches, table
from .labelled import held_out, logistic, probability, sample

#: At most so many labelled texts of each label (bad, good) are learned from.
SAMPLE = (2000, 2000)
CHUNK, DICTIONARY, LEVEL = 1024, 64 << 10, 3
#: Bytes of the runs by which a part of a text counts as a near-copy of what the dictionary holds.
RUN = 16
THRESHOLD = 0.7


def chunks(raw: bytes) -> list[bytes]:
    """Consecutive chunks of the whole text; a short rest goes to the last."""
    cuts = list(range(0, len(raw), CHUNK))
    if len(cuts) > 1 and len(raw) - cuts[-1] < CHUNK // 4:
        cuts.pop()
    return [raw[a:b] for a, b in zip(cuts, [*cuts[1:], len(raw)])]


class Model:
    """Dictionaries as bytes and the calibration; compressors are made once a process."""

    def __init__(self, good: bytes, bad: bytes, fit: tuple | None):
        self.good, self.bad, self.fit, self._pair = good, bad, fit, None

    def __getstate__(self) -> dict:
        return {"good": self.good, "bad": self.bad, "fit": self.fit, "_pair": None}

    def features(self, text: str | None) -> list[float]:
        if self._pair is None:
            self._pair = []
            for raw in (self.good, self.bad):
                d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=LEVEL)
                self._pair.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False))
        g, b = self._pair
        raw = (text or "").encode()
        if not raw:
            return [0.0] * 5
        sizes = np.array([(len(g.compress(c)), len(b.compress(c)), len(c)) for c in chunks(raw)], dtype=float)
        each = (sizes[:, 0] - sizes[:, 1]) / sizes[:, 2]
        total = sizes.sum(axis=0)
        return [(total[0] - total[1]) / total[2], each.max(), each.min(), total[0] / total[2], min(sizes[:, 0] / sizes[:, 2])]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.fit is None:
            return np.full(len(texts), 0.5)
        return probability(np.array([self.features(t) for t in texts]), self.fit)


def spread(texts: list[str]) -> list[str]:
    """texts in the order of a hash of them, so that any part of them is a sample."""
    return sorted(texts, key=lambda t: hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest())


def dictionary(texts: list[str]) -> bytes:
    """DICTIONARY bytes at most, what a compressor may refer back to: of every text an equal share, from a place
    that moves through the texts from one to the next. What short texts leave of their share goes to the
    longer ones. A part most of whose runs of RUN bytes are held already is passed over as a near-copy,
    and its share goes to further parts of the texts."""
    raw = [t.encode() for t in texts if t]
    out: list[bytes] = []
    held: set[bytes] = set()
    size = 0
    begin = [int(max(0, len(r) - DICTIONARY // len(raw)) * (k * 0.6180339887498949 % 1)) for k, r in enumerate(raw)]
    seen = [0] * len(raw)  # bytes of each text that were looked at, from its own place on and round its end
    while size < DICTIONARY and any(n < len(r) for n, r in zip(seen, raw)):
        open_ = [k for k, r in enumerate(raw) if seen[k] < len(r)]
        share = max(RUN * 2, (DICTIONARY - size) // len(open_))
        for k in open_:
            r = raw[k]
            at = (begin[k] + seen[k]) % len(r)
            part = r[at : at + min(share, len(r) - seen[k], DICTIONARY - size)]
            seen[k] += len(part)
            runs = {part[i : i + RUN] for i in range(max(1, len(part) - RUN + 1))}
            if part and 2 * len(runs & held) <= len(runs):
                held |= runs
                out.append(part)
                size += len(part)
            if size >= DICTIONARY:
                break
    return b"".join(out)


def train(rows: list[tuple[str, int]]) -> Model:
    """A model of labelled texts; with no text of one of the labels every score is 0.5."""
    by = [spread([t for t, y in rows if y == k]) for k in (0, 1)]
    if min(map(len, by)) < 2:
        return Model(b"", b"", None)
    model = Model(dictionary(by[1][::2]), dictionary(by[0][::2]), None)
    rest = [(t, y) for y, texts in enumerate(by) for t in texts[1::2]]
    x, y = np.array([model.features(t) for t, _ in rest]), np.array([y for _, y in rest], dtype=float)
    model.fit = logistic(x, y)
    return model


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs (doc_id, text).

    Only the text is scored. A null text is empty, and an empty text is scored
    with all its differences and sizes zero. Repeated rows give repeated
    results; an empty table gives none; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                found = model.scores(column(piece, "text").to_pylist())
                yield pa.RecordBatch.from_arrays([column(piece, "doc_id"), pa.array(found, pa.float64())], schema=schema)

    scored = pick(docs, doc_id="bigint", text="string").mapInArrow(run, "doc_id bigint, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op7_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(sample(docs, table(spark, sf_dir, "labels"), "quality", SAMPLE)))


QUERIES = {"op7_compression_quality": op7_compression_quality}
ORACLES: dict[str, str] = {}
