"""Token counts of byte-level BPE by rank-synchronous merging of ragged arrays.

Pre-tokens of an Arrow batch that were not seen before are laid end to end in
one numpy array of byte symbols.  Each round finds every sequence's adjacent
pair of lowest rank and merges all its occurrences, in all sequences at once;
sequences without a mergeable pair leave.  What survives is the count.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import pieces

#: Fixed value: the pattern of the byte-level pre-tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _supported(path: str, spec: dict) -> None:
    """Refuses tokenizer files that ask for more than byte-level BPE: counts would differ from the library's."""
    before, model = spec.get("pre_tokenizer") or {}, spec["model"]
    wants = [
        spec.get("normalizer") is not None,
        before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True),
        model.get("type", "BPE") != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")),
        any(t.get(k) for t in spec.get("added_tokens", ()) for k in ("single_word", "lstrip", "rstrip")),
    ]
    if any(wants):
        raise ValueError(f"{path} is no plain byte-level BPE tokenizer")


class RankMerger:
    """Ranked merges of a tokenizer file, applied to many byte strings at once."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        _supported(path, spec)
        ids = spec["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        pairs = np.array([ids[a] << 32 | ids[b] for a, b in merges], np.int64)
        order = np.argsort(pairs)
        self.keys, self.ranks = pairs[order], order.astype(np.int64)
        self.made = np.array([ids[a + b] for a, b in merges], np.int64)
        self.first = np.zeros(256, np.int64)
        for char, byte in byte_symbols().items():
            self.first[byte] = ids[char]
        self.none = len(merges)
        self.specials = [t["content"] for t in spec.get("added_tokens", ())]
        self.split = regex.compile(PATTERN)
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.seen: dict[str, int] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left << 32 | right
        at = np.searchsorted(self.keys, pair)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == pair, self.ranks[at], self.none)

    def counts(self, raws: list[bytes]) -> np.ndarray:
        """Symbols that survive in each byte string."""
        out = np.zeros(len(raws), np.int64)
        sizes = np.fromiter(map(len, raws), np.int64, len(raws))
        symbols = self.first[np.frombuffer(b"".join(raws), np.uint8)]
        who = np.repeat(np.arange(len(raws)), sizes)
        ranks = self._ranks(symbols, who)
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
            sizes = np.diff(np.r_[starts, len(who)])
            best = np.minimum.reduceat(ranks, starts)
            over = best == self.none
            if over.any():
                out[who[starts[over]]] = sizes[over]
                stay = np.repeat(~over, sizes)
                symbols, who, ranks, best, sizes = symbols[stay], who[stay], ranks[stay], best[~over], sizes[~over]
                if not len(symbols):
                    break
            hit = ranks == np.repeat(best, sizes)
            # in a run of equal symbols a pair can begin at every second one only
            at = np.flatnonzero(hit)
            run = np.r_[True, (np.diff(at) > 1) | (ranks[at[1:]] != ranks[at[:-1]])] if len(at) else np.zeros(0, bool)
            since = np.arange(len(at)) - np.flatnonzero(run)[np.cumsum(run) - 1]
            at = at[since % 2 == 0]
            symbols[at] = self.made[ranks[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            # only pairs beside a merged symbol have new ranks
            new = np.zeros(len(symbols), bool)
            new[at] = True
            symbols, who, ranks, new = symbols[keep], who[keep], ranks[keep], new[keep]
            around = new.copy()
            around[:-1] |= new[1:]
            i = np.flatnonzero(around)
            inner = i[i + 1 < len(symbols)]
            ranks[i] = self.none
            same = inner[who[inner] == who[inner + 1]]
            ranks[same] = self.rank(symbols[same], symbols[same + 1])
        return out

    def _ranks(self, symbols: np.ndarray, who: np.ndarray) -> np.ndarray:
        ranks = np.full(len(symbols), self.none, np.int64)
        same = np.flatnonzero(who[1:] == who[:-1])
        ranks[same] = self.rank(symbols[same], symbols[same + 1])
        return ranks

    def pretokens(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens of a text, and how many special tokens stand in it."""
        if self.special is None or not any(s in text for s in self.specials):
            return self.split.findall(text), 0
        parts = self.special.split(text)
        return [x for p in parts for x in self.split.findall(p)], len(parts) - 1

    def count_texts(self, texts: list[str], most_seen: int = 600_000) -> list[int]:
        split = [self.pretokens(t) for t in texts]
        if len(self.seen) > most_seen:
            self.seen.clear()
        new = list(set().union(*(x for x, _ in split)).difference(self.seen)) if split else []
        # short ones many at a time, long ones fewer: a block's arrays stay small
        new.sort(key=len)
        at = 0
        while at < len(new):
            end, total = at, 0
            while end < len(new) and (end == at or total < 2_000_000) and end - at < 200_000:
                total += 4 * len(new[end])
                end += 1
            block = new[at:end]
            self.seen.update(zip(block, self.counts([x.encode() for x in block]).tolist(), strict=True))
            at = end
        get = self.seen.__getitem__
        return [sum(map(get, x)) + n for x, n in split]


_HELD: dict[str, RankMerger] = {}


def merger(path: str) -> RankMerger:
    if path not in _HELD:
        _HELD[path] = RankMerger(path)
    return _HELD[path]


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_bytes`` (UTF-8) and ``n_tokens`` by the tokenizer file at ``vocabulary``.

    The file has to be at that path on every executor.  A special token's
    string inside a text counts as that token.  A null text is empty: 0 and
    0.  Repeated rows count each; other columns are left out; an empty table
    gives an empty result.
    """
    kept = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("__text"))
    kind = kept.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = merger(vocabulary)
        for batch in batches:
            for part in pieces(batch):
                texts = part.column(1).fill_null("")
                n = pa.array(held.count_texts(texts.to_pylist()), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), pc.binary_length(texts).cast(pa.int64()), n], names=[id_col, "n_bytes", "n_tokens"])

    return kept.mapInArrow(count, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint")


def op9_token_counts(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = count_tokens(docs, default_path("byte_bpe_50k.json"))
    return out.withColumn("over_limit", F.col("n_tokens") > 1024)
