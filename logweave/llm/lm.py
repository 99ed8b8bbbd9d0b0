"""Word bigram language model with deleted interpolation.

P(w | h) mixes the maximum-likelihood bigram, unigram and uniform estimates with
weights that depend on how often the context h was seen (buckets of log2). The
weights come from expectation-maximisation on deleted counts: each training
token is predicted from all others, its own occurrence taken out.

How counting is dealt out. Documents are packed into blocks of up to ``BLOCK``
tokens, each with a vocabulary of its own. A block asks for the corpus counts of
its distinct words and bigrams: one compressed list of sorted keys for each
bucket of the key space, along with its own training counts. A bucket's owner
adds up the lists and answers every block in the order it asked. So common words
cost one key for each block, not one row for each occurrence, and no task ever
holds more than a bucket or a block. The counts of all documents reach the
model; nothing of it is collected on the driver but sums and a table of
(context bucket, bigram, unigram) probability cells whose size is fixed.
"""

from __future__ import annotations

import pickle
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BLOCK = 1_000_000
#: Keys that a bucket holds on the average.
BUCKET = 1_000_000
#: Bits of a key. Two of n bigrams share their count with probability n / 2**57.
KEY_BITS = 56
CONTEXTS = 16
#: Probability cells: half bits, and 0 for a probability of zero.
STEPS = 64
WORD, PAIR = 1, 2
MIX = np.uint64(0x9E3779B97F4A7C15)
END = b"\n"


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers, each as byte planes, compressed."""
    planes = []
    for a in arrays:
        top = int(a.max()) if len(a) else 0
        width = max(1, (top.bit_length() + 7) // 8)
        raw = np.ascontiguousarray(a.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width]
        planes.append((len(a), width, np.ascontiguousarray(raw.T).tobytes()))
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(planes, protocol=5))


def _unpack(data: bytes) -> list[np.ndarray]:
    out = []
    for n, width, raw in pickle.loads(zstandard.ZstdDecompressor().decompress(data)):
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, n).T
        out.append(wide.view("<u8").ravel().astype(np.int64))
    return out


def held_out(doc_id: int | None) -> bool:
    """Whether the CRC32 of the id, as text, leaves 2 modulo 7; a null id is not held out."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def _blocks(size: int):
    """Documents into blocks: (block, tokens, payload)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        number = context.partitionId() << 24 if context else 0
        ids: list[int] = []
        null: list[int] = []
        lengths: list[int] = []
        parts: list[np.ndarray] = []
        words: dict[bytes, int] = defaultdict()
        words.default_factory = words.__len__
        words[END]
        held = 0

        def flush() -> pd.DataFrame:
            nonlocal number, held
            tokens = np.concatenate(parts)
            keys = np.fromiter((xxhash.xxh64_intdigest(w) >> (64 - KEY_BITS) for w in words), np.int64, len(words))
            order = np.argsort(keys, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            keys, tokens = keys[order], place[tokens]
            # Numbers by frequency make the byte planes compressible.
            often = np.argsort(-np.bincount(tokens, minlength=len(keys)), kind="stable")
            rank = np.empty(len(often), np.int64)
            rank[often] = np.arange(len(often))
            doc = np.array(ids, np.int64)
            payload = _pack(
                doc.view(np.uint64), np.array(null), np.array(lengths), np.diff(keys, prepend=0), rank, rank[tokens]
            )
            row = pd.DataFrame({"block": [number], "tokens": [len(tokens)], "payload": [payload]})
            number, held = number + 1, 0
            for x in (ids, null, lengths, parts):
                x.clear()
            words.clear()
            words[END]
            return row

        for b in batches:
            for doc, text in zip(b["doc_id"].astype("Int64"), b["text"]):
                found = (text or "").encode().lower().split()
                found.append(END)
                ids.append(0 if doc is pd.NA else int(doc))
                null.append(int(doc is pd.NA))
                lengths.append(len(found))
                parts.append(np.fromiter(map(words.__getitem__, found), np.int64, len(found)))
                held += len(found)
                if held >= size:
                    yield flush()
        if lengths:
            yield flush()

    return run


class _Block:
    """A block's documents, tokens, keys and distinct bigrams, in the order it asks for them."""

    def __init__(self, payload: bytes):
        ids, null, self.lengths, gaps, rank, tokens = _unpack(payload)
        self.ids = [None if n else int(i) for i, n in zip(ids.view(np.int64), null)]
        self.word_keys = np.cumsum(gaps)
        often = np.empty(len(rank), np.int64)
        often[rank] = np.arange(len(rank))
        self.tokens = often[tokens]
        self.train = np.array([not held_out(i) for i in self.ids], bool)
        self.doc = np.repeat(np.arange(len(self.lengths)), self.lengths)
        end = int(np.searchsorted(self.word_keys, xxhash.xxh64_intdigest(END) >> (64 - KEY_BITS)))
        first = np.cumsum(self.lengths) - self.lengths
        self.before = np.empty_like(self.tokens)
        self.before[1:] = self.tokens[:-1]
        self.before[first] = end
        codes = self.before * len(self.word_keys) + self.tokens
        pairs, self.pair = np.unique(codes, return_inverse=True)
        self.pair_before, self.pair_word = pairs // len(self.word_keys), pairs % len(self.word_keys)
        a, b = self.word_keys[self.pair_before].view(np.uint64), self.word_keys[self.pair_word].view(np.uint64)
        mixed = (a * MIX) ^ (b + (a >> np.uint64(7)))
        mixed = (mixed ^ (mixed >> np.uint64(29))) * MIX
        keys = ((mixed ^ (mixed >> np.uint64(32))) >> np.uint64(64 - KEY_BITS)).astype(np.int64)
        self.pair_order = np.argsort(keys, kind="stable")
        self.pair_keys = keys[self.pair_order]

    def own_counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Training counts of the words and of the bigrams, in the order of their keys."""
        live = self.train[self.doc]
        words = np.bincount(self.tokens[live], minlength=len(self.word_keys))
        pairs = np.bincount(self.pair[live], minlength=len(self.pair_word))
        return words, pairs[self.pair_order]


def _asks(bits: int):
    """A block's lists of keys and own counts, one row for each bucket of each kind."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for number, payload in zip(b["block"], b["payload"]):
                block = _Block(payload)
                for kind, keys, counts in zip((WORD, PAIR), (block.word_keys, block.pair_keys), block.own_counts()):
                    cuts = np.searchsorted(keys, np.arange((1 << bits) + 1) << (KEY_BITS - bits))
                    rows = [
                        (number, kind, i, _pack(np.diff(keys[lo:hi], prepend=i << (KEY_BITS - bits)), counts[lo:hi]))
                        for i, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])) if hi > lo
                    ]
                    yield pd.DataFrame(rows, columns=["block", "kind", "bucket", "data"])

    return run


def _runs(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of a partition sorted by ``by``, one at a time."""
    held: list[pd.DataFrame] = []
    for b in batches:
        while len(b):
            key = tuple(b[by].iloc[0])
            same = (b[by] == list(key)).all(axis=1).to_numpy()
            stop = len(b) if same.all() else int(np.argmin(same))
            if held and tuple(held[0][by].iloc[0]) != key:
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(b.iloc[:stop])
            b = b.iloc[stop:]
    if held:
        yield pd.concat(held, ignore_index=True)


def _answers(bits: int):
    """Adds up a bucket's lists and answers each; one row also has the bucket's sums."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _runs(batches, ["kind", "bucket"]):
            start = int(group["bucket"].iloc[0]) << (KEY_BITS - bits)
            lists = [_unpack(x) for x in group["data"]]
            keys = np.concatenate([np.cumsum(gaps) + start for gaps, _ in lists])
            _, where = np.unique(keys, return_inverse=True)
            total = np.bincount(where, weights=np.concatenate([c for _, c in lists])).astype(np.int64)
            answer = np.split(total[where], np.cumsum([len(c) for _, c in lists])[:-1])
            word = group["kind"].iloc[0] == WORD
            yield pd.DataFrame(
                {
                    "block": group["block"], "kind": group["kind"], "bucket": group["bucket"],
                    "data": [_pack(a) for a in answer],
                    "n": [int(total.sum()) * int(word)] + [0] * (len(group) - 1),
                    "v": [int((total > 0).sum()) * int(word)] + [0] * (len(group) - 1),
                }
            )

    return run


def context_bucket(count: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + floor(log2) up to CONTEXTS - 1."""
    return np.minimum(np.where(count > 0, 1 + np.floor(np.log2(np.maximum(count, 1))), 0), CONTEXTS - 1).astype(np.int64)


def _cell(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.minimum(1 + np.floor(-2 * np.log2(np.maximum(p, 1e-300))), STEPS), 0).astype(np.int64)


def _gathered(tokens: int):
    """A block with its answers: what scoring needs, and its cells of deleted probabilities."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _runs(batches, ["block"]):
            block = _Block(group.loc[group["kind"] == 0, "data"].iloc[0])
            words, pairs = (
                np.concatenate([_unpack(x)[0] for x in group.loc[group["kind"] == k, "data"]]) for k in (WORD, PAIR)
            )
            c_pair = np.empty_like(pairs)
            c_pair[block.pair_order] = pairs
            c_before, c_word = words[block.pair_before], words[block.pair_word]
            # Each training occurrence, without itself.
            times = np.bincount(block.pair[block.train[block.doc]], minlength=len(c_pair))
            live = times > 0
            rest = np.maximum(c_before[live] - 1, 0)
            p2 = np.where(rest > 0, (c_pair[live] - 1) / np.maximum(rest, 1), 0.0)
            p1 = (c_word[live] - 1) / max(tokens - 1, 1)
            code = (context_bucket(rest) * (STEPS + 1) + _cell(p2)) * (STEPS + 1) + _cell(p1)
            cells, where = np.unique(code, return_inverse=True)
            sums = np.bincount(where, weights=times[live], minlength=len(cells)).astype(np.int64)
            ids = np.array([0 if i is None else i for i in block.ids], np.int64)
            null = np.array([int(i is None) for i in block.ids])
            packed = _pack(ids.view(np.uint64), null, block.lengths, block.pair, c_pair, c_before, c_word)
            yield pd.DataFrame({"packed": [packed], "cells": [cells.tolist()], "sums": [sums.tolist()]})

    return run


def mixture(cells: list[tuple[int, int]], vocabulary: int, steps: int = 200, least: float = 1e-6) -> np.ndarray:
    """Weights (bigram, unigram, uniform) for each context bucket, by EM over counted cells."""
    uniform = 1.0 / (vocabulary + 1)
    weights = np.tile([0.4, 0.4, 0.2], (CONTEXTS, 1))
    weights[0] = [0.0, 0.8, 0.2]
    if cells:
        code, n = np.array(cells, np.int64).T
        bucket, q2, q1 = code // (STEPS + 1) ** 2, code // (STEPS + 1) % (STEPS + 1), code % (STEPS + 1)
        half = lambda q: np.where(q > 0, 2.0 ** (-(q - 0.5) / 2), 0.0)
        p = np.stack([np.minimum(half(q2), 1.0), half(q1), np.full(len(n), uniform)], axis=1)
        for b in np.unique(bucket):
            at = bucket == b
            w, pb, nb = weights[b], p[at], n[at]
            for _ in range(steps):
                share = pb * w
                share *= (nb / share.sum(axis=1))[:, None]
                w = np.maximum(share.sum(axis=0) / nb.sum(), [0.0, least, least])
                w /= w.sum()
            weights[b] = w
    weights[0] = weights[0] * [0, 1, 1] / weights[0][1:].sum()
    return weights


def _scored(weights: np.ndarray, tokens: int, vocabulary: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for packed in b["packed"]:
                ids, null, lengths, pair, c_pair, c_before, c_word = _unpack(packed)
                w = weights[context_bucket(c_before)]
                p = (
                    w[:, 0] * c_pair / np.maximum(c_before, 1)
                    + w[:, 1] * c_word / max(tokens, 1)
                    + w[:, 2] / (vocabulary + 1)
                )
                base = np.log10((c_word + 1) / (tokens + vocabulary + 1))
                first = np.cumsum(lengths) - lengths
                doc_ids = [None if n else int(i) for i, n in zip(ids.view(np.int64), null)]
                yield pd.DataFrame(
                    {
                        "doc_id": pd.array(doc_ids, "Int64"),
                        "held_out": [held_out(i) for i in doc_ids],
                        "n_tokens": lengths,
                        "n_known": np.add.reduceat((c_word > 0)[pair].astype(np.int64), first),
                        "train_tokens": tokens,
                        "base_score": np.add.reduceat(base[pair], first),
                        "score": np.add.reduceat(np.log10(p)[pair], first),
                    }
                )

    return run


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Scores every row of ``docs`` by a model of the rows that are not held out.

    Tokens are the words of the text with A-Z lowered and one end. A null or
    empty text is the end alone. Rows with a null id are training rows; repeated rows
    count as often as they stand there. With no training rows, the vocabulary
    is empty and each token's probability is one over one. An empty table gives
    an empty result. Other columns are neither read nor returned.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    blocks = common.durable(common.mapped(rows, _blocks(block), "block long, tokens long, payload binary"), "lm-blocks")
    size = blocks.agg(F.sum("tokens")).first()[0] or 0
    bits = max(4, int(size // BUCKET).bit_length())
    asks = common.mapped(blocks.select("block", "payload"), _asks(bits), "block long, kind int, bucket int, data binary", 4)
    asks = asks.repartition("kind", "bucket").sortWithinPartitions("kind", "bucket", "block")
    answers = common.durable(
        common.mapped(asks, _answers(bits), "block long, kind int, bucket int, data binary, n long, v long", 4), "lm-answers"
    )
    tokens, vocabulary = (x or 0 for x in answers.agg(F.sum("n"), F.sum("v")).first())
    both = blocks.select("block", F.lit(0).alias("kind"), F.lit(0).alias("bucket"), F.col("payload").alias("data")).unionAll(
        answers.select("block", "kind", "bucket", "data")
    )
    both = both.repartition("block").sortWithinPartitions("block", "kind", "bucket")
    gathered = common.durable(
        common.mapped(both, _gathered(tokens), "packed binary, cells array<long>, sums array<long>", 4), "lm-gathered"
    )
    cells = (
        gathered.select(F.explode(F.arrays_zip("cells", "sums")).alias("x"))
        .groupBy("x.cells").agg(F.sum("x.sums")).collect()
    )  # at most CONTEXTS * (STEPS + 1) ** 2 rows
    weights = mixture(sorted((r[0], r[1]) for r in cells), vocabulary)
    return common.mapped(gathered.select("packed"), _scored(weights, tokens, vocabulary), SCORES, 4)
