"""Quality rules as a short-circuit cascade, in built-in functions alone.

A rule fails a document by a predicate over features (word count, share of
symbols, ...).  On a bounded sample costs and rejections are measured, and the
next rule is always that with the most rejections per cost: rejections among
the documents that the rules before it let pass, cost of the features that
they have not computed yet.  A feature is computed only for documents that
every earlier rule let pass, and once.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACES, Scratch, words_of


@dataclass(frozen=True)
class Feature:
    """``make`` builds the column from the text column and the features named in ``needs``."""

    name: str
    make: Callable[..., Column]
    needs: tuple[str, ...] = ()


@dataclass(frozen=True)
class Rule:
    """Fails a document where ``fails`` is true; null counts as passing."""

    name: str
    needs: tuple[str, ...]
    fails: Callable[..., Column] = field(compare=False)


def _lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x, F.lit(SPACES)) != "")


def _at(array: Column, i: Column) -> Column:
    return F.get(array, i)


def _window_hashes(text: Column, words: Column, n: Column) -> Column:
    """Sorted longs of each 3-word window: 33 bits of hash over 31 bits of position."""
    high = F.lit(-(1 << 31)).cast("long")
    return F.sort_array(
        F.when(
            n >= 3,
            F.slice(F.transform(words, lambda w, i: F.xxhash64(w, _at(words, i + 1), _at(words, i + 2)).bitwiseAND(high).bitwiseOR(i.cast("long"))), F.lit(1), n - 2),
        ).otherwise(F.array().cast("array<bigint>"))
    )


def _same_hash(text: Column, hashes: Column) -> Column:
    """Positions of windows that share their hash with another: all repeated windows, and few others."""
    part = lambda x: F.shiftright(x, 31)
    alike = F.filter(hashes, lambda x, k: (part(x) == part(_at(hashes, k + 1))) | (part(x) == part(_at(hashes, k - 1))))
    return F.transform(alike, lambda x: x.bitwiseAND(F.lit((1 << 31) - 1).cast("long")).cast("int"))


def _keyed(text: Column, positions: Column, words: Column) -> Column:
    return F.sort_array(F.transform(positions, lambda i: F.struct(F.concat_ws(" ", _at(words, i), _at(words, i + 1), _at(words, i + 2)).alias("w"), i.alias("i"))))


def _repeated(text: Column, keyed: Column) -> Column:
    """First word of each window whose words stand in another window too, ascending."""
    same = F.filter(keyed, lambda x, k: (x["w"] == _at(keyed, k + 1)["w"]) | (x["w"] == _at(keyed, k - 1)["w"]))
    return F.sort_array(F.transform(same, lambda x: x["i"]))


def _covered(text: Column, starts: Column) -> Column:
    """Words under the windows that begin at ``starts``."""
    each = F.transform(starts, lambda p, k: F.least(F.lit(3), F.coalesce(_at(starts, k + 1) - p, F.lit(3))).cast("long"))
    return F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x)


FEATURES = {
    f.name: f
    for f in (
        Feature("words", lambda t: words_of(t)),
        Feature("n_words", lambda t, w: F.size(w).cast("long"), ("words",)),
        Feature("word_chars", lambda t, w: F.length(F.array_join(w, "")).cast("long"), ("words",)),
        Feature("n_symbols", lambda t: F.regexp_count(F.coalesce(t, F.lit("")), F.lit("[#*$%&|<>]")).cast("long")),
        Feature("lines", lambda t: _lines(t)),
        Feature("n_lines", lambda t, x: F.size(x).cast("long"), ("lines",)),
        Feature("n_dup_lines", lambda t, x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"), ("lines",)),
        Feature("window_hashes", _window_hashes, ("words", "n_words_int")),
        Feature("n_words_int", lambda t, w: F.size(w), ("words",)),
        Feature("like_windows", _same_hash, ("window_hashes",)),
        Feature("keyed_windows", _keyed, ("like_windows", "words")),
        Feature("repeat_starts", _repeated, ("keyed_windows",)),
        Feature("n_repeat_words", _covered, ("repeat_starts",)),
        Feature("n_letters", lambda t: F.length(F.regexp_replace(F.coalesce(t, F.lit("")), "[^\\p{L}]+", "")).cast("long")),
    )
}

#: The two base rules first, then rules of the method.
RULES = (
    Rule("too_short", ("n_words",), lambda n: n < 50),
    Rule("repeats_itself", ("n_repeat_words", "n_words"), lambda r, n: r * 100 > n * 50),
    Rule("word_length", ("word_chars", "n_words"), lambda c, n: (c < n * 3) | (c > n * 10)),
    Rule("symbols", ("n_symbols", "n_words"), lambda s, n: s * 10 > n),
    Rule("same_lines", ("n_dup_lines", "n_lines"), lambda d, n: d * 10 > n * 3),
    Rule("few_letters", ("n_letters", "word_chars"), lambda a, c: a * 2 < c),
)


def _with_feature(df: DataFrame, name: str, text: str, alive: Column | None, have: dict[str, str]) -> DataFrame:
    """Adds a feature and what it needs; null where ``alive`` is false."""
    if name in have:
        return df
    f = FEATURES[name]
    for x in f.needs:
        df = _with_feature(df, x, text, alive, have)
    made = f.make(F.col(text), *(F.col(have[x]) for x in f.needs))
    have[name] = f"__q_{name}"
    return df.withColumn(have[name], made if alive is None else F.when(alive, made))


def _closure(names: Sequence[str]) -> frozenset[str]:
    """Features and all that they need."""
    return frozenset(names).union(*(_closure(FEATURES[x].needs) for x in names)) if names else frozenset()


class Costs:
    """Seconds a row of sets of features over a sample (column text, ``n`` rows).

    A job without features over the sample tells what a job costs besides its
    rows.  What a job with features takes more is divided by its rows: those of
    as many copies of the sample as take ``least`` seconds more, ``most`` of
    them at most.
    """

    def __init__(self, sample: DataFrame, n: int, least: float = 0.1, most: int = 64):
        self.sample, self.n, self.least, self.most, self.held, self.job = sample, n, least, most, {}, None

    def _job(self, names: frozenset[str], copies: int) -> float:
        df = self.sample.select("text", F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("__copy"))
        have: dict[str, str] = {}
        for x in sorted(names):
            df = _with_feature(df, x, "text", None, have)
        wide = {f.name for f in df.schema if f.dataType.typeName() == "array"}
        asked = [F.sum(F.size(c) if c in wide else F.col(c)) for c in have.values()]
        began = time.perf_counter()
        df.agg(F.count(F.lit(1)), F.sum(F.octet_length("text")), *asked).collect()
        return time.perf_counter() - began

    def of(self, names: frozenset[str]) -> float:
        if names not in self.held and not self.n:
            self.held[names] = 1e-9
        if names not in self.held:
            if self.job is None:
                self.job = min(self._job(frozenset(), 1) for _ in range(3))
            self._job(names, 1)  # code is compiled
            copies = 4
            while (more := self._job(names, copies) - self.job) < self.least and copies < self.most:
                copies *= 4
            self.held[names] = max(more / (copies * self.n), 1e-9)
        return self.held[names]

    def more(self, names: frozenset[str], have: frozenset[str]) -> float:
        """Cost of ``names`` where ``have`` is there already; a fiftieth of the whole at least."""
        return max(self.of(names) - self.of(names & have), self.of(names) / 50)


def measure_rules(df: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", sample_rows: int = 300) -> list[tuple[str, float, float]]:
    """Rules in the order to try them: name, seconds a row, and share of rejections among the rows that the rules before it let pass.

    Measured on a random sample of about ``sample_rows`` rows of the whole table.
    """
    share = min(1.0, sample_rows / max(1, df.count()))
    rows = df.select(F.col(f"`{text}`").alias("text"))
    work = Scratch(df.sparkSession)
    # one file, so that costs are those of one task
    sample = work.write((rows.sample(share, seed=1) if share < 1 else rows).repartition(1), "quality-sample")
    have: dict[str, str] = {}
    told = sample
    for rule in rules:
        for x in rule.needs:
            told = _with_feature(told, x, "text", None, have)
    fails = [F.coalesce(r.fails(*(F.col(have[x]) for x in r.needs)), F.lit(False)).alias(f"f{k}") for k, r in enumerate(rules)]
    # a row for each combination of verdicts that occurs
    seen = [(row[:-1], row[-1]) for row in told.select(*fails).groupBy(*(f"f{k}" for k in range(len(rules)))).count().collect()] if rules else []
    costs = Costs(sample, sum(n for _, n in seen))
    out, left, known = [], list(range(len(rules))), frozenset()
    while left:
        alive = [(x, n) for x, n in seen if not any(x[k] for k in range(len(rules)) if k not in left)]
        passed = max(1, sum(n for _, n in alive))
        found = {k: (sum(n for x, n in alive if x[k]) / passed, costs.more(_closure(rules[k].needs), known)) for k in left}
        best = max(left, key=lambda k: (found[k][0] / found[k][1], -found[k][1]))  # noqa: B023
        out.append((rules[best].name, found[best][1], found[best][0]))
        known |= _closure(rules[best].needs)
        left.remove(best)
    work.clear()
    return out


def cascade(df: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", order: Sequence[str] | None = None, always: Sequence[str] = (), sample_rows: int = 300) -> DataFrame:
    """``df`` with ``kept`` (no rule fails), and the features named in ``always`` for every row.

    ``order`` names the rules in the order to try them; without it they are
    measured on a sample first.  The verdict doesn't depend on the order.  A
    null text is an empty one; a column ``kept`` or of an ``always`` name that
    ``df`` has already is replaced; other columns stay.  An empty table gives
    an empty result.  Filters on other columns belong before the cascade: they
    are not pushed through it.
    """
    if order is None:
        order = [name for name, _, _ in measure_rules(df, rules, text, sample_rows)]
    by_name = {r.name: r for r in rules}
    own = [c for c in df.columns if c != "kept" and c not in always]
    # under another name, so that a replaced column called text stays readable
    out = df.select(*(F.col(f"`{c}`") for c in own), F.col(f"`{text}`").alias("__q_text"))
    have: dict[str, str] = {}
    for x in always:
        out = _with_feature(out, x, "__q_text", None, have)
    alive: Column | None = None
    for step, name in enumerate(order):
        rule = by_name[name]
        for x in rule.needs:
            out = _with_feature(out, x, "__q_text", alive, have)
        passes = ~F.coalesce(rule.fails(*(F.col(have[x]) for x in rule.needs)), F.lit(False))
        out = out.withColumn(f"__q_alive{step}", passes if alive is None else alive & passes)
        alive = F.col(f"__q_alive{step}")
    # always true, but not deterministic: a filter on kept then stays above the features, where pushing it down would write them out in it again and again
    kept = (F.lit(True) if alive is None else alive) & (F.monotonically_increasing_id() >= 0)
    return out.select(*(F.col(f"`{c}`") for c in own), *(F.col(have[x]).alias(x) for x in always), kept.alias("kept"))


#: Columns of the query, in order.
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def op1_quality_rules(spark, sf_dir) -> DataFrame:
    """One row per document: the base counts, whether a base rule fails it, and the cascade's verdict."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = cascade(docs, always=BASE)
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return out.select("doc_id", *BASE, failed.alias("base_failed"), "kept")


ORACLE = r"""
WITH w AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
b AS (
  SELECT k, doc_id, t, words, len(words)::BIGINT AS n_words,
         length(array_to_string(words, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         length(regexp_replace(t, '[^\p{L}]', '', 'g'))::BIGINT AS n_letters
  FROM w),
tri AS (
  SELECT k, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
  FROM (SELECT k, words, unnest(range(1, n_words - 1)) AS i FROM b)),
rep AS (
  SELECT k, count(DISTINCT i + j) AS n
  FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM tri), (VALUES (0), (1), (2)) v(j)
  WHERE c > 1 GROUP BY k),
r AS (
  SELECT b.*, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines
  FROM b LEFT JOIN rep USING (k)),
f AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR word_chars < 3 * n_words OR word_chars > 10 * n_words
            OR n_symbols * 10 > n_words OR n_dup_lines * 10 > n_lines * 3 OR n_letters * 2 < word_chars) AS kept
FROM f
"""
