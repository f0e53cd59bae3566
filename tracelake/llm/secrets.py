"""Secret scans through a trigram index.

Each rule's regex has a Boolean trigram query: a text can match only if the
query holds for the trigrams that the text contains.  An index shard (one
Arrow slice of documents) holds, for each trigram that any query names, the
posting list of documents that contain it; the queries are evaluated by
intersecting and uniting postings, and only candidates are searched with the
regex.  A rule whose regex has no mandatory trigram searches every document.
Shards need no shuffle, and a document is in one shard whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as sre_parse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import buffers, pieces


@dataclass(frozen=True)
class SecretRule:
    """``pattern`` finds spans; ``accepts`` drops failing matches (None: none fails)."""

    kind: str
    pattern: str
    ignore_case: bool = False
    accepts: Callable[[re.Match], bool] | None = None

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, (re.I if self.ignore_case else 0) | re.A)


def _assigned(m: re.Match) -> bool:
    return len(m[2]) >= 8


def _long_access(m: re.Match) -> bool:
    return len(m[0]) >= 16


#: Base kinds in the listed order, then kinds that the method adds.
RULES = (
    SecretRule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, _assigned),
    SecretRule("access", r"AKIA[A-Z0-9]+", False, _long_access),
    SecretRule("hex", r"[0-9a-f]{32,}"),
    SecretRule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    SecretRule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    SecretRule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    SecretRule("google", r"AIza[A-Za-z0-9_-]{35}"),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)
BASE_KINDS = ("assign", "access", "hex")

# --- Boolean trigram queries -------------------------------------------------
# A query is True (no demand), a trigram (bytes), ("and", parts) or ("or", parts).


def _and(parts: Iterable) -> object:
    flat = dict.fromkeys(p for p in parts if p is not True)
    return True if not flat else next(iter(flat)) if len(flat) == 1 else ("and", tuple(flat))


def _or(parts: Iterable) -> object:
    flat = dict.fromkeys(parts)
    return True if True in flat else next(iter(flat)) if len(flat) == 1 else ("or", tuple(flat))


def _trigrams(text: str) -> object:
    raw = text.lower().encode()
    return _and(raw[i : i + 3] for i in range(len(raw) - 2))


def _strings(tree, limit: int = 64) -> list[tuple[str, bool]] | None:
    """The strings a parsed regex can begin with, each with whether it is all of the match; None if too many."""
    found = [("", True)]
    for op, arg in tree:
        if all(not whole for _, whole in found):
            break
        if op is sre.LITERAL:
            nexts = [(chr(arg), True)]
        elif op is sre.SUBPATTERN:
            nexts = _strings(arg[3], limit)
        elif op is sre.BRANCH:
            nexts = []
            for x in arg[1]:
                nexts += _strings(x, limit) or [("", False)]
        elif op is sre.IN and all(k is sre.LITERAL for k, _ in arg) and len(arg) <= 8:
            nexts = [(chr(v), True) for _, v in arg]
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] <= 1:
            nexts = [("", True)] * (arg[0] == 0) + (_strings(arg[2], limit) or [("", False)])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
            nexts = [(s, False) for s, _ in _strings(arg[2], limit) or [("", False)]]
        elif op is sre.AT:
            nexts = [("", True)]
        else:
            nexts = [("", False)]
        found = [(a + b, w and v) for a, w in found for b, v in (nexts if w else [("", False)])]
        if len(found) > limit:
            return None
    return list(dict.fromkeys(found))


def trigram_query(pattern: str) -> object:
    """The weakest demand on trigrams (case folded) that every match of ``pattern`` meets; True if none.

    Literal runs, small classes and alternatives are multiplied out; a run
    ends at anything wider, and a new one begins after it.
    """
    tree, runs, at = list(sre_parse.parse(pattern)), [], 0
    while at < len(tree):
        best = None
        for end in range(len(tree), at, -1):
            got = _strings(tree[at:end])
            if got and all(whole for _, whole in got):
                best = (end, got)
                break
        if best:
            runs.append(_or(_trigrams(s) for s, _ in best[1]))
            at = best[0]
            continue
        op, arg = tree[at]
        got = _strings([tree[at]])
        if got:
            runs.append(_or(_trigrams(s) for s, _ in got))
        if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
            runs.append(_or(_trigrams(s) for s, _ in _strings(arg[2]) or [("", False)]))
        at += 1
    return _and(runs)


def _named(query: object) -> set[bytes]:
    if query is True:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*map(_named, query[1]))


class TrigramIndex:
    """Posting lists of one shard, for the trigrams in ``wanted``."""

    def __init__(self, wanted: Sequence[bytes]):
        self.wanted = {t: i + 1 for i, t in enumerate(sorted(wanted))}
        self.slots = np.zeros(1 << 24, np.uint16)
        for t, i in self.wanted.items():
            self.slots[t[0] << 16 | t[1] << 8 | t[2]] = i
        self.fold = np.arange(256, dtype=np.uint32)
        self.fold[65:91] += 32

    def postings(self, column: pa.Array) -> dict[bytes, np.ndarray]:
        """Sorted row numbers of each wanted trigram."""
        data, offsets = buffers(column)
        if len(data) < 3 or not self.wanted:
            return {}
        low = self.fold[data]
        slot = self.slots[low[:-2] << 16 | low[1:-1] << 8 | low[2:]]
        at = np.flatnonzero(slot)
        row = np.searchsorted(offsets, at, "right") - 1
        inside = at + 3 <= offsets[row + 1]
        pairs = np.unique(slot[at[inside]].astype(np.int64) << 40 | row[inside])
        ids, rows = pairs >> 40, pairs & ((1 << 40) - 1)
        return {t: rows[np.searchsorted(ids, i) : np.searchsorted(ids, i, "right")] for t, i in self.wanted.items()}


def candidates(query: object, postings: dict[bytes, np.ndarray], rows: int) -> np.ndarray:
    """Rows whose trigrams meet the query."""
    if query is True:
        return np.arange(rows)
    if isinstance(query, bytes):
        return postings.get(query, np.zeros(0, np.int64))
    found = [candidates(q, postings, rows) for q in query[1]]
    out = found[0]
    for x in sorted(found[1:], key=len) if query[0] == "and" else found[1:]:
        out = np.intersect1d(out, x, assume_unique=True) if query[0] == "and" else np.union1d(out, x)
    return out


def find_spans(texts: pa.Array, rules: Sequence[SecretRule], queries: Sequence[object], index: TrigramIndex) -> list[list[tuple[int, int, int]]]:
    """For each text its spans (start, rule number, end), in code points, sorted."""
    held = texts.to_pylist()
    spans: list[list[tuple[int, int, int]]] = [[] for _ in held]
    postings = index.postings(texts)
    for k, (rule, query) in enumerate(zip(rules, queries, strict=True)):
        pattern, accepts = rule.compiled(), rule.accepts
        for row in candidates(query, postings, len(held)).tolist():
            if held[row]:
                spans[row] += [(m.start(), k, m.end()) for m in pattern.finditer(held[row]) if accepts is None or accepts(m)]
    for x in spans:
        x.sort()
    return spans


def scan_secrets(docs: DataFrame, rules: Sequence[SecretRule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id and ``spans``, an array of (kind, start, end), ends exclusive, in code points.

    Spans come by start, then by the rules' order.  A null text is empty and
    has none; equal rows are scanned each on its own; other columns are left
    out, so none can clash; an empty table gives an empty result.
    """
    rules = tuple(rules)
    kept = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("__text"))
    kind = kept.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = [trigram_query(r.pattern) for r in rules]
        index = TrigramIndex(sorted(set().union(*map(_named, queries))))
        shape = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for part in pieces(batch):
                spans = find_spans(part.column(1), rules, queries, index)
                rows = [[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in x] for x in spans]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, shape)], names=[id_col, "spans"])

    return kept.mapInArrow(scan, f"`{id_col}` {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def op2_secret_scans(spark, sf_dir) -> DataFrame:
    """One row per document: base counts, digest of the base spans, and all spans as text."""
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    of = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    told = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *map(of, BASE_KINDS), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def digest(spans: Iterable[tuple[str, int, int]]) -> str:
    """Digest of spans (kind, start, end) as the query reports it."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
