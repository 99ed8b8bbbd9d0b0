"""SentencePiece encoding with seeded merge-dropout, and decoding.

The merges of a public byte-pair model are applied by agenda: the candidate
with the best score comes first, the leftmost on ties. Each candidate that comes
up is skipped with the dropout's probability, by a keyed hash of the word, the
variant and the candidate's ends, so an encoding can be repeated anywhere. A
document's variant is a keyed hash of its id: texts in which a word recurs
show it differently from document to document, and a worker can keep the encodings
of common words.

Lossless: a space is the model's mark; a mark that stands in the text itself,
and any character the model has no piece for, is spelled out in byte pieces.
Words are cut before marks, which is exact for a model whose pieces hold a mark
at most at their head (checked on loading).
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MARK = "▁"
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MASK = (1 << 64) - 1
MIX, MIX2, MIX3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
NEVER = 2**31 - 1
UNKNOWN, GONE = -1, -2
#: The longest unit that is encoded together with others, and characters taken at a time.
WIDTH = 48
CHUNK = 2_000_000


@dataclass
class Encoder:
    """A byte-pair model; ``dropout`` of 0 gives the model's own encoding."""

    proto: bytes
    dropout: float = 0.1
    seed: int = 0
    keep: int = 200_000
    ids: dict = field(default_factory=dict, repr=False)
    known: dict = field(default_factory=dict, repr=False)

    def __post_init__(self):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=self.proto)
        self.pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.bytes = [-1] * 256
        special = set()
        for i, piece in enumerate(self.pieces):
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                special.add(i)
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                special.add(i)
            elif MARK in piece.lstrip(MARK):
                raise ValueError("a piece holds the mark inside")
        if min(self.bytes) < 0:
            raise ValueError("the model has no byte pieces")
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in special}
        self.scores = {p: model.get_score(i) for p, i in self.ids.items()}
        self.bar = int(self.dropout * 2.0**64)
        self.kind, self.width = ("<u2", 2) if len(self.pieces) <= 65536 else ("<u4", 4)
        self.spelled = [p.replace(MARK, " ").encode() for p in self.pieces]
        for b, i in enumerate(self.bytes):
            self.spelled[i] = bytes([b])
        order = {x: r for r, x in enumerate(sorted(set(self.scores.values()), reverse=True))}
        self.rank = np.full(len(self.pieces), NEVER, np.int32)
        self.size = np.zeros(len(self.pieces), np.uint64)
        self.pairs, merged = [], []
        for p, i in self.ids.items():
            self.rank[i], self.size[i] = order[self.scores[p]], len(p)
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if a is not None and b is not None:
                    self.pairs.append(a << 32 | b)
                    merged.append(i)
        self._index(np.array(self.pairs, np.int64), np.array(merged, np.int32))
        self.pairs.clear()
        single = sorted((ord(p), i) for p, i in self.ids.items() if len(p) == 1)
        self.points = np.array([c for c, _ in single], np.int64)
        self.point_ids = np.array([i for _, i in single], np.int32)
        # No piece spans a line end, so lines are cut apart.
        if any("\n" in p for p in self.ids):
            raise ValueError("a piece holds a line end")
        self.cut = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+").findall

    def _word(self, word: str, variant: int) -> list[int]:
        """The ids of one word, by agenda."""
        scores, n = self.scores, len(word)
        symbols = list(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        after[-1] = -1
        agenda = []
        for i in range(n - 1):
            s = scores.get(word[i : i + 2])
            if s is not None:
                agenda.append((-s, i, 2))
        if agenda:
            key = 0
            if self.bar:
                key = xxhash.xxh3_64_intdigest(word, self.seed * 1_000_003 + variant)
            heapq.heapify(agenda)
            while agenda:
                _, i, size = heapq.heappop(agenda)
                left = symbols[i]
                if left is None:
                    continue
                j = after[i]
                if j < 0 or len(left) + len(symbols[j]) != size:
                    continue
                if self.bar:
                    x = ((key ^ (i * 0x9E3779B97F4A7C15 + size * 0xC2B2AE3D27D4EB4F)) * 0xD6E8FEB86659FD93) & MASK
                    x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & MASK
                    if x ^ (x >> 32) < self.bar:
                        continue
                merged = left + symbols[j]
                symbols[i], symbols[j] = merged, None
                k = after[i] = after[j]
                if k >= 0:
                    before[k] = i
                    s = scores.get(merged + symbols[k])
                    if s is not None:
                        heapq.heappush(agenda, (-s, i, len(merged) + len(symbols[k])))
                h = before[i]
                if h >= 0:
                    s = scores.get(symbols[h] + merged)
                    if s is not None:
                        heapq.heappush(agenda, (-s, h, len(symbols[h]) + len(merged)))
        out, ids = [], self.ids
        for s in symbols:
            if s is not None:
                i = ids.get(s)
                if i is None:
                    out.extend(self.bytes[b] for c in s for b in c.encode())
                else:
                    out.append(i)
        return out

    def _index(self, pairs: np.ndarray, merged: np.ndarray) -> None:
        """An open-addressing table from pairs of pieces to what they merge into."""
        bits = max(4, int(len(pairs) * 4).bit_length())
        self.shift = np.uint64(64 - bits)
        self.table = np.full(1 << bits, -1, np.int64)
        self.value = np.full(1 << bits, -1, np.int32)
        self.probes = 0
        left = np.arange(len(pairs))
        at = (pairs.view(np.uint64) * MIX >> self.shift).astype(np.int64)
        while len(left):
            self.probes += 1
            free = self.table[at] < 0
            slots, first = np.unique(at[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.table[slots], self.value[slots] = pairs[left[won]], merged[left[won]]
            rest = np.ones(len(left), bool)
            rest[won] = False
            left, at = left[rest], (at[rest] + 1) & (len(self.table) - 1)

    def _merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What each pair of pieces merges into, or -1."""
        key = (a.astype(np.int64) << 32) | b.astype(np.int64)
        key[(a < 0) | (b < 0)] = -2
        at = (key.view(np.uint64) * MIX >> self.shift).astype(np.int64)
        there = self.table[at]
        out = np.where(there == key, self.value[at], -1)
        open_ = np.flatnonzero((there != key) & (there >= 0))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & (len(self.table) - 1)
            there = self.table[at[open_]]
            hit = there == key[open_]
            out[open_[hit]] = self.value[at[open_[hit]]]
            open_ = open_[~hit & (there >= 0)]
        return out

    def _many(self, units: list[str], variant: int) -> None:
        """Encodes units of up to ``WIDTH`` characters together and keeps the results.

        The same agenda as ``_word``, one step of all units at a time: the best
        candidate of each, leftmost on ties, is merged or skipped.
        """
        units = sorted(units, key=len)
        for at in range(0, len(units), 20_000):
            self._some(units[at : at + 20_000], variant)

    def _some(self, units: list[str], variant: int) -> None:
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        n, width = len(units), int(sizes.max())
        points = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).astype(np.int64)
        found = np.minimum(np.searchsorted(self.points, points), len(self.points) - 1)
        flat = np.where(self.points[found] == points, self.point_ids[found], UNKNOWN)
        grid = np.arange(width)[None, :] < sizes[:, None]
        symbols = np.full((n, width + 1), GONE, np.int32)
        symbols[:, :width][grid] = flat
        after = np.tile(np.arange(1, width + 2, dtype=np.int32), (n, 1))
        before = np.tile(np.arange(-1, width, dtype=np.int32), (n, 1))
        into = np.full((n, width + 1), -1, np.int32)
        into[:, :width] = self._merged(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(n, width)
        rank = np.where(into >= 0, self.rank[into], NEVER)
        keys = np.zeros(n, np.uint64)
        if self.bar:
            digest, base = xxhash.xxh3_64_intdigest, self.seed * 1_000_003 + variant
            keys = np.fromiter((digest(u, base) for u in units), np.uint64, n)
        rows = np.arange(n)
        while len(rows):
            place = rank[rows].argmin(axis=1)
            live = rank[rows, place] < NEVER
            rows, place = rows[live], place[live]
            r, i = rows, place
            if self.bar:
                x = (keys[r] ^ (i.astype(np.uint64) * MIX + self.size[into[r, i]] * MIX2)) * MIX3
                x = (x ^ (x >> np.uint64(32))) * MIX3
                skip = (x ^ (x >> np.uint64(32))) < np.uint64(min(self.bar, MASK))
                rank[r[skip], i[skip]] = NEVER
                r, i = r[~skip], i[~skip]
            j = after[r, i]
            k = after[r, j]
            symbols[r, i] = into[r, i]
            symbols[r, j], rank[r, j] = GONE, NEVER
            after[r, i] = k
            k = np.minimum(k, width)
            before[r, k] = i
            new = self._merged(symbols[r, i], symbols[r, k])
            into[r, i], rank[r, i] = new, np.where(new >= 0, self.rank[new], NEVER)
            h = before[r, i]
            r, i, h = r[h >= 0], i[h >= 0], h[h >= 0]
            new = self._merged(symbols[r, h], symbols[r, i])
            into[r, h], rank[r, h] = new, np.where(new >= 0, self.rank[new], NEVER)
        kept = symbols != GONE
        ids = symbols[kept].astype(self.kind).tobytes()
        ends = (np.cumsum(kept.sum(axis=1)) * self.width).tolist()
        odd = (symbols == UNKNOWN).any(axis=1).tolist()
        start, known = 0, self.known[variant]
        for unit, end, strange in zip(units, ends, odd):
            known[unit] = self._packed(unit, variant) if strange else ids[start:end]
            start = end

    def _packed(self, unit: str, variant: int) -> bytes:
        return np.array(self._word(unit, variant), self.kind).tobytes()

    def encode_all(self, texts: list[str], variants: list[int]) -> Iterator[bytes]:
        """The packed ids of each text, in order; units that aren't known are encoded together."""
        mark = np.array([self.bytes[b] for b in MARK.encode()], self.kind).tobytes()
        at = 0
        while at < len(texts):
            held, size = [], 0
            while at < len(texts) and size < CHUNK:
                # All marks but the text's own stand for spaces, the first for the text's head.
                parts = [self.cut(p.replace(" ", MARK)) for p in f" {texts[at]}".split(MARK)] if texts[at] else []
                held.append((parts, variants[at]))
                size += len(texts[at])
                at += 1
            if sum(map(len, self.known.values())) >= self.keep:
                self.known.clear()
            wanted: dict[int, set[str]] = defaultdict(set)
            for parts, v in held:
                wanted[v].update(*parts)
            long: list[tuple[int, str]] = []
            for v, units in wanted.items():
                known = self.known.setdefault(v, {})
                missing = [u for u in units if u not in known]
                self._many([u for u in missing if len(u) <= WIDTH], v)
                for u in missing:
                    if len(u) > WIDTH:
                        known[u] = self._packed(u, v)
                        long.append((v, u))
            for parts, v in held:
                get = self.known[v].__getitem__
                yield mark.join([b"".join(map(get, units)) for units in parts])
            for v, u in long:
                del self.known[v][u]

    def encode(self, text: str, variant: int = 0) -> list[int]:
        """The ids of a text; none for an empty one."""
        return np.frombuffer(next(self.encode_all([text], [variant])), self.kind).tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of an encoding, without the model's leading mark."""
        return b"".join(map(self.spelled.__getitem__, ids))[1:].decode("utf-8", "replace")


def read_model(path: str = MODEL_PATH) -> bytes:
    """The model file's bytes, read once by the driver and sent along with the plan."""
    with open(path, "rb") as f:
        return f.read()


def variant_of(doc_id: int | None, seed: int, variants: int) -> int:
    """A document's variant, by keyed hash of its id (a null id: that of '')."""
    said = "" if doc_id is None else str(doc_id)
    return xxhash.xxh64_intdigest(said.encode(), seed) % variants


def encode(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    dropout: float = 0.1,
    seed: int = 11,
    variants: int = 4,
    model_path: str = MODEL_PATH,
    verify: bool = False,
) -> DataFrame:
    """(doc_id, ids, n_pieces, ids_hash): one row for each row of ``docs``; with ``verify`` also lossless.

    ``ids`` are the piece numbers as little-endian 16-bit integers (32-bit if the model has
    more than 65536 pieces), ``ids_hash`` the XXH64 of them in hex, and ``lossless``
    says that decoding gave the text back. A null text is null throughout, with no
    pieces and ``lossless`` true; an empty one has no pieces. ``variants`` bounds the segmentations of a
    word over the corpus: more of them show more, and cost more, as fewer encodings are found in a worker's memory. Whole texts are
    encoded, of any length. Rows equal in id and text are encoded alike. An empty
    table gives an empty result; other columns are neither read nor returned.
    """
    proto, width = read_model(model_path), 3 + verify

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = Encoder(proto, dropout, seed)
        for b in batches:
            rows = []
            docs_of = [None if d is pd.NA else int(d) for d in b["doc_id"].astype("Int64")]
            texts = b["text"].tolist()
            given = coder.encode_all([t or "" for t in texts], [variant_of(d, seed, variants) for d in docs_of])
            for text, packed in zip(texts, given):
                if text is None:
                    rows.append((None, 0, None, True)[:width])
                    continue
                row = (packed, len(packed) // coder.width, xxhash.xxh64_hexdigest(packed))
                rows.append((*row, coder.decode(np.frombuffer(packed, coder.kind).tolist()) == text) if verify else row)
            out = pd.DataFrame(rows, columns=["ids", "n_pieces", "ids_hash", "lossless"][:width])
            out.insert(0, "doc_id", b["doc_id"].astype("Int64").to_numpy())
            yield out

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return common.mapped(own, run, "doc_id long, ids binary, n_pieces long, ids_hash string" + ", lossless boolean" * verify, 250)


def decode(encoded: DataFrame, model_path: str = MODEL_PATH) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give a null text."""
    proto = read_model(model_path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = Encoder(proto, 0.0)
        for b in batches:
            texts = [None if x is None else coder.decode(np.frombuffer(x, coder.kind).tolist()) for x in b["ids"]]
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "text": texts})

    return common.mapped(encoded.select("doc_id", "ids"), run, "doc_id long, text string")
