"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A segment is a run of space marks with the characters up to the next mark; no
piece of such a vocabulary holds a mark after another character (checked when
it is loaded), so segments are encoded apart and remembered.  In a segment an
agenda holds adjacent symbol pairs whose union is a piece, the best score
first and the leftmost of equals; popping a pair merges it unless either side
has changed meanwhile.  Characters that are no piece become their bytes.
Segments that an Arrow batch brings for the first time are encoded by the
sentencepiece library too; where the two differ the library's ids are taken,
and the difference is logged and counted.
"""

from __future__ import annotations

import hashlib
import heapq
import logging
import math
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import pieces, tidy

MARK = "▁"
#: Characters up to which a segment's agenda is a list.
SHORT = 40


class PieceEncoder:
    """A vocabulary, its agenda encoder and the library's processor."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bos, self.eos, self.unk = lib.bos_id(), lib.eos_id(), lib.unk_id()
        self.scores: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.bytes: dict[int, int] = {}
        for i in range(lib.get_piece_size()):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.bytes[int(piece[1:-1], 16)] = i
            elif not (lib.is_control(i) or lib.is_unknown(i)):
                self.scores[piece], self.ids[piece] = lib.get_score(i), i
        crossing = [p for p in self.ids if MARK in p.lstrip(MARK)]
        if crossing or lib.encode("  a") != lib.encode(f" {MARK}a") or lib.decode(lib.encode("  a  b ")) != "  a  b ":
            raise ValueError("only vocabularies with leading space marks and without normalisation are encoded by segments")
        self.segments = re.compile(f"{MARK}+[^{MARK}]*").findall
        self.seen: dict[str, bytes] = {}
        self.differences = 0

    def agenda(self, segment: str) -> list[int]:
        """Ids of one segment."""
        scores = self.scores
        if segment in scores and len(segment) == 1:
            return [self.ids[segment]]
        n = len(segment)
        if n <= SHORT:
            return self._short_agenda(segment)
        symbol: list[str | None] = list(segment)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            score = scores.get(symbol[i] + symbol[i + 1])
            if score is not None:
                heap.append((-score, i, i + 1, len(symbol[i]) + len(symbol[i + 1])))
        heapq.heapify(heap)
        while heap:
            _, left, right, size = heapq.heappop(heap)
            a, b = symbol[left], symbol[right]
            if a is None or b is None or len(a) + len(b) != size:
                continue
            symbol[left], symbol[right] = a + b, None
            end = after[right]
            after[left] = end
            if end < n:
                before[end] = left
                if (score := scores.get(symbol[left] + symbol[end])) is not None:
                    heapq.heappush(heap, (-score, left, end, size + len(symbol[end])))
            if (start := before[left]) >= 0 and (score := scores.get(symbol[start] + symbol[left])) is not None:
                heapq.heappush(heap, (-score, start, left, len(symbol[start]) + size))
        return self._ids([x for x in symbol if x is not None])

    def _short_agenda(self, segment: str) -> list[int]:
        """The same, with the agenda in the order of the symbols: for short segments a look through it is faster than a heap."""
        score, none = self.scores.get, -math.inf
        symbol = list(segment)
        pair = [score(a + b, none) for a, b in zip(symbol, symbol[1:])]  # noqa: B905
        while pair and (best := max(pair)) > none:
            i = pair.index(best)
            symbol[i] += symbol.pop(i + 1)
            del pair[i]
            if i:
                pair[i - 1] = score(symbol[i - 1] + symbol[i], none)
            if i < len(pair):
                pair[i] = score(symbol[i] + symbol[i + 1], none)
        return self._ids(symbol)

    def _ids(self, symbols: list[str]) -> list[int]:
        out: list[int] = []
        for x in symbols:
            i = self.ids.get(x)
            if i is not None:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in x.encode()]
            else:
                out.append(self.unk)
        return out

    def split(self, text: str) -> list[str]:
        return self.segments(MARK + text.replace(" ", MARK)) if text else []

    def learn(self, segments: set[str]) -> None:
        """Encodes segments that are new, and checks them against the library."""
        new = list(segments)
        own = [self.agenda(s) for s in new]
        for k, (s, b) in enumerate(zip(new, self.library.encode([s[1:] for s in new], num_threads=1), strict=True)):
            # the library encodes nothing for an empty text, where the mark alone stands for one space
            if own[k] != b and s != MARK:
                self.differences += 1
                logging.getLogger(__name__).warning("the library encodes %r otherwise: %s, not %s", s[:80], b, own[k])
                own[k] = b
        self.seen.update(zip(new, (np.array(x, "<u4").tobytes() for x in own), strict=True))

    def forget(self, keep: int = 200_000) -> None:
        """Drops remembered segments but for the first ``keep``, among which the frequent ones are."""
        if len(self.seen) > keep:
            self.seen = dict(islice(self.seen.items(), keep))

    def encode(self, texts: list[str], most_seen: int = 500_000) -> list[bytes]:
        """Ids of each text with begin and end, as little-endian unsigned 32-bit integers."""
        split = [self.split(t) for t in texts]
        if len(self.seen) > most_seen:
            self.forget(min(200_000, most_seen // 2))
        new = set().union(*split).difference(self.seen) if split else set()
        if new:
            self.learn(new)
        begin, end, get = np.array([self.bos], "<u4").tobytes(), np.array([self.eos], "<u4").tobytes(), self.seen.__getitem__
        return [begin + b"".join(map(get, x)) + end for x in split]

    def decode(self, ids: list[bytes]) -> list[str]:
        return [self.library.decode(np.frombuffer(x, "<u4").tolist()) for x in ids]


_HELD: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    if path not in _HELD:
        _HELD[path] = PieceEncoder(path)
    return _HELD[path]


def encode_pieces(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Per row: id, ``ids`` (with begin and end) and ``decoded``; with ``digests`` their number and SHA-256 instead.

    The first column of the result has the type and name of ``id_col``.

    The model file has to be at that path on every executor.  A null text is
    empty: begin and end alone.  Repeated rows are encoded each; other
    columns are left out; an empty table gives an empty result.
    """
    kept = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("__text"))
    kind = kept.schema[id_col].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = encoder(model)
        for batch in batches:
            for part in pieces(batch, 2 << 20):
                ids = held.encode(part.column(1).fill_null("").to_pylist())
                texts = held.decode(ids)
                if digests:
                    columns = [
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in texts], pa.string()),
                    ]
                    yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    lists = pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(texts, pa.string())], names=[id_col, "ids", "decoded"])
        # workers stay for later stages
        held.forget()
        tidy()

    shape = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return kept.mapInArrow(encode, f"`{id_col}` {kind}, {shape}")


def op8_sentencepiece(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"), digests=True)
