"""Toxicity by compression distance.

Two zstandard dictionaries are trained on windows of whole texts, one on
ordinary and one on toxic documents. Each window of a text (about ``WINDOW`` bytes of
whole words) is compressed twice, with the ordinary dictionary alone and with
the toxic one after it, so what ordinary text explains costs the same both
times and the difference in length is what only toxic text explains.

Most of a toxic document is ordinary text, and so is most of what the trainer
picks from it. So the toxic dictionary is trained on the half of the windows that
the ordinary dictionary compresses worst, then cut into segments, and those stay that shorten windows of toxic documents at least ``RATIO`` times as often as
windows of ordinary ones; again only compressed lengths are compared. Segments
are tried in groups on the executors, and each of a group on the windows that
the group has shortened. A document's profile of window differences goes
through a logistic calibration fitted on documents that did not train the
dictionaries.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 48
LEVEL = 3
ORDINARY_BYTES = 32768
#: Sizes of the trained toxic dictionary, of a segment of it, and of what is kept of it at most.
TRAINED_BYTES, SEGMENT, TOXIC_BYTES = 131072, 12, 8192
#: Bytes of a group of segments, and between the starts of its segments.
GROUP, STRIDE = 192, 4
#: Segment and match sizes that the trainer is run with.
TRAINERS = [(12, 8), (16, 6)]
#: Bytes of the windows that the toxic dictionary is trained on and that segments are tried on.
TRAIN, TRY = 16, 32
#: A segment shortens a window if it saves ``GAIN`` bytes; it is kept from ``HITS`` toxic windows on, and at this ratio.
GAIN, HITS, RATIO = 2, 16, 3.0
#: Bounds of the training sample: documents of a class, and windows of a class that segments are tried on.
SAMPLE_TOXIC = 3000
SAMPLE_ORDINARY = 6000
TRIED = 16000
#: Documents of a class without which nothing is learned.
LEAST = 6
FEATURES = 7


def windows(text: str | None, size: int = WINDOW) -> list[bytes]:
    """Runs of whole words of at least ``size`` bytes, A-Z lowered, with a space at both ends."""
    out, held, n = [], [], 0
    for word in (text or "").encode().lower().split():
        held.append(word)
        n += len(word) + 1
        if n >= size:
            out.append(b" " + b" ".join(held) + b" ")
            held, n = [], 0
    if held:
        out.append(b" " + b" ".join(held) + b" ")
    return out


def _compressor(content: bytes):
    prepared = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    prepared.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(
        level=LEVEL, dict_data=prepared, write_content_size=False, write_checksum=False, write_dict_id=False
    ).compress


def profile(pieces: list[bytes], plain, toxic) -> list[float]:
    """What a document's window differences look like: ``FEATURES`` numbers."""
    if not pieces:
        return [0.0] * FEATURES
    d = np.array([len(plain(w)) - len(toxic(w)) for w in pieces], np.float64)
    top = np.sort(d)[::-1]
    return [
        top[0], top[:3].mean(), float(np.maximum(d, 0).mean()), float((d >= 3).mean()),
        float((d >= 5).mean()), math.log1p(float((d >= 4).sum())), math.log1p(len(d)),
    ]


@dataclass
class Model:
    plain: bytes
    toxic: bytes
    centre: list[float]
    weights: list[float]
    bias: float

    def scorer(self):
        """A function from a text to its score, with compressors of its own."""
        if not self.weights:
            return lambda text: 0.0
        plain, toxic = _compressor(self.plain), _compressor(self.plain + self.toxic)
        w, c = np.array(self.weights), np.array(self.centre)

        def score(text: str | None) -> float:
            z = float(w @ (np.array(profile(windows(text), plain, toxic)) - c)) + self.bias
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

        return score


def _trained(samples: list[bytes], size: int, **how) -> bytes:
    """The content of a trained dictionary; where all samples fit, the samples themselves.

    The trainer picks what recurs over many samples; it refuses too few.
    """
    whole = b"".join(samples)
    if len(whole) <= size:
        return whole
    try:
        return zstandard.train_dictionary(size, samples, **how).as_bytes()
    except zstandard.ZstdError:
        return whole[-size:]


def _distinct(texts: list[str], size: int) -> list[bytes]:
    return list(dict.fromkeys(w for text in texts for w in windows(text, size)))


def _telling(spark, plain: bytes, trained: bytes, toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """The segments that shorten toxic windows far more often than ordinary ones, the best last.

    At most ``TRIED`` windows of each class go to the executors; what comes back are two counts for each segment.
    """
    toxic, ordinary = (random.Random(7).sample(w, min(len(w), TRIED)) for w in (toxic, ordinary))
    mixed, split, more = toxic + ordinary, len(toxic), len(toxic) / len(ordinary)

    def tried(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = np.fromiter(map(len, map(_compressor(plain), mixed)), np.int64, len(mixed))
        for batch in batches:
            for content in batch["content"]:
                after = np.fromiter(map(len, map(_compressor(plain + content), mixed)), np.int64, len(mixed))
                at = np.flatnonzero(before - after >= GAIN).tolist()
                rows = []
                for i in range(0, max(len(content) - SEGMENT, 0) + 1, STRIDE):
                    one, own = content[i : i + SEGMENT], _compressor(plain + content[i : i + SEGMENT])
                    hit = [j for j in at if before[j] - len(own(mixed[j])) >= GAIN]
                    p = sum(j < split for j in hit)
                    rows.append((one, p, len(hit) - p))
                yield pd.DataFrame(rows, columns=["segment", "p", "n"])

    groups = [(bytearray(trained[i : i + GROUP]),) for i in range(0, len(trained), GROUP)]
    if not groups:
        return []
    found = spark.createDataFrame(groups, "content binary").repartition(min(len(groups), 4 * spark.sparkContext.defaultParallelism))
    counted = found.mapInPandas(tried, "segment binary, p long, n long").collect()
    kept = {bytes(r["segment"]): r["p"] - more * r["n"] for r in counted if r["p"] >= HITS and r["p"] >= RATIO * (more * r["n"] + 0.5)}
    return [s for s, _ in sorted(kept.items(), key=lambda x: (x[1], x[0]))]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> tuple[np.ndarray, float]:
    """Weights and bias by Newton's method, the weights held by a ridge."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w, hold = np.zeros(z.shape[1]), np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + hold @ w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + hold, grad)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def _sample(docs: DataFrame, marks: DataFrame, rows: int) -> list[str]:
    """The whole texts of the ``rows`` documents with the smallest hashes."""
    ids = marks.orderBy("key", "doc_id").limit(rows)
    picked = docs.join(F.broadcast(ids), "doc_id")  # at most ``rows`` rows of two numbers
    found = {r["key"]: r["text"] or "" for r in picked.select("key", "text").collect()}
    return [text for _, text in sorted(found.items())]


def train(docs: DataFrame, labels: DataFrame, toxic_rows: int = SAMPLE_TOXIC, ordinary_rows: int = SAMPLE_ORDINARY) -> Model:
    """Learns from labelled documents outside the held-out fifth.

    At most ``toxic_rows`` toxic and ``ordinary_rows`` ordinary documents with the
    smallest hashes of their ids are used, whole: two thirds for the dictionaries and one
    for the calibration; the bias is set to the classes' true counts. Labels that are
    null, or of documents that aren't there, don't count; of several labels of one id the
    largest does. With fewer than ``LEAST`` documents of either class nothing can be learned: the score is 0
    for all texts and no document is predicted toxic.
    """
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    marks = (
        labels.where("doc_id is not null and toxic is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max("toxic").alias("toxic"))
        .where(~held)
        .withColumn("key", F.xxhash64("doc_id", F.lit(7)))
    )
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    toxic = _sample(own, marks.where("toxic = 1"), toxic_rows)
    ordinary = _sample(own, marks.where("toxic = 0"), ordinary_rows)
    if min(len(toxic), len(ordinary)) < LEAST:
        return Model(b"", b"", [], [], 0.0)
    fit = [[t for i, t in enumerate(rows) if i % 3 < 2] for rows in (toxic, ordinary)]
    check = [rows[2::3] for rows in (toxic, ordinary)]
    plain = _trained(_distinct(fit[1], 64), ORDINARY_BYTES)
    # Of the toxic windows, the half that the ordinary dictionary compresses worst.
    short = _compressor(plain)
    pieces = _distinct(fit[0], TRAIN)
    worst = np.array([len(short(w)) / len(w) for w in pieces])
    hard = [pieces[i] for i in np.flatnonzero(worst >= np.median(worst))]
    content = b"".join(_trained(hard, TRAINED_BYTES // len(TRAINERS), k=k, d=d) for k, d in TRAINERS)
    telling = _telling(docs.sparkSession, plain, content, _distinct(fit[0], TRY), _distinct(fit[1], TRY))
    told = b"".join(telling)[-TOXIC_BYTES:]
    a, b = _compressor(plain), _compressor(plain + told)
    x = np.array([profile(windows(t), a, b) for rows in check for t in rows])
    y = np.array([1.0] * len(check[0]) + [0.0] * len(check[1]))
    centre = x.mean(0)
    weights, bias = _logistic(x - centre, y)
    bias += math.log((counts.get(1, 0) + 0.5) / (counts.get(0, 0) + 0.5)) - math.log(len(check[0]) / len(check[1]))
    return Model(plain, told, centre.tolist(), weights.tolist(), bias)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, held_out, score and predicted: one row for each row of ``docs``.

    Null and empty texts are scored like texts without windows; whole texts are
    compressed. A null id is not held out. An empty table gives an empty result.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = model.scorer()
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "score": [of(t) for t in b["text"]]})

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scored = common.mapped(own, run, "doc_id long, score double")
    return scored.select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic; its columns, in one pass over it.

    Null and empty texts are scored like texts without windows; ids may be null or repeat, and every
    row is judged by its own text. Without labels of both classes all rows stay. An empty table gives an empty one.
    """
    model = train(docs, labels)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        of = model.scorer()
        return pa.array([of(t.as_py()) for t in texts], pa.float64())

    return docs.where(scored(F.col("text")) < 0.5)
