"""Quality rules as a short-circuit cascade.

Each rule is a cheap test of a text. On a small sample every rule's cost and
rejections are measured as the cascade will meet them: on texts that passed the
base test, with the base counts at hand. The rule that rejects most per second
comes first; the next one is chosen by what it rejects of the texts left, and
so on. The verdict is the conjunction of all rules, so the order never changes
it.

Defined results: a null or empty text has no words, all counts 0, and fails
the base test; repeated rows are judged each; rules that tie keep the order
they are given in, as do all where no text is left; texts of any length are
read whole; an empty table gives an empty table; further columns, also named
like those of the result, do not matter.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, sampled_ids, table

SYMBOL = re.compile(r"[#*$%&|<>]")
LETTER_RUN = re.compile(r"[^\W\d_]+")


class Text:
    """A text and the counts that the rules ask for, each made when first asked."""

    def __init__(self, text: str | None) -> None:
        self.text = text or ""

    @cached_property
    def words(self) -> list[str]:
        return WORD.findall(self.text)

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return sum(map(len, self.words))

    @cached_property
    def n_symbols(self) -> int:
        return len(SYMBOL.findall(self.text))

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if WORD.search(x)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        w = self.words
        windows = list(zip(w, w[1:], w[2:], strict=False))
        seen = Counter(windows)
        if len(seen) == len(windows):
            return 0
        total, upto = 0, 0
        for i, x in enumerate(windows):
            if seen[x] > 1:
                total += i + 3 - max(i, upto)
                upto = i + 3
        return total

    @cached_property
    def n_letter_words(self) -> int:
        return sum(1 for w in self.words if w.isalpha() or any(map(str.isalpha, w)))

    @cached_property
    def n_letters(self) -> int:
        return sum(map(str.isalpha, self.text))


@dataclass(frozen=True)
class Rule:
    name: str
    passes: Callable[[Text], bool]


#: Integer comparisons, so that SQL gives the same verdicts.
RULES = (
    Rule("mean_word_length", lambda t: 3 * t.n_words <= t.word_chars <= 10 * t.n_words),
    Rule("symbols", lambda t: 10 * t.n_symbols <= t.n_words),
    Rule("duplicate_lines", lambda t: 10 * t.n_dup_lines <= 4 * len(t.lines)),
    Rule("letter_words", lambda t: 10 * t.n_letter_words >= 8 * t.n_words),
    Rule("letters", lambda t: 2 * t.n_letters >= t.word_chars),
)
BASE = ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_failed(t: Text) -> bool:
    return t.n_words < 50 or 100 * t.n_repeat_words > 50 * t.n_words


def measure(text: str | None, rules: tuple[Rule, ...]) -> list[tuple[bool, float]] | None:
    """Whether each rule rejects the text and the seconds it takes, the base counts known; none for a text that fails the base test."""
    ready = Text(text)
    if base_failed(ready):
        return None
    for name in BASE:
        getattr(ready, name)
    out = []
    for rule in rules:
        own = Text(text)
        own.__dict__.update(ready.__dict__)
        began = time.perf_counter()
        rejects = not rule.passes(own)
        out.append((rejects, time.perf_counter() - began))
    return out


def arrange(measured: list[list[tuple[bool, float]]], rules: tuple[Rule, ...]) -> tuple[str, ...]:
    """Names of the rules, each the one that rejects most per second of the texts that those before it leave."""
    left, order, open_rules = measured, [], list(range(len(rules)))
    while open_rules:
        gain = {i: (sum(m[i][0] for m in left) + (0.5 if left else 0.0)) / (sum(m[i][1] for m in left) + 1e-9) for i in open_rules}
        best = max(open_rules, key=lambda i: (gain[i], -i))
        order.append(rules[best].name)
        open_rules.remove(best)
        left = [m for m in left if not m[best][0]]
    return tuple(order)


def plan(texts: list[str | None], rules: tuple[Rule, ...] = RULES) -> tuple[str, ...]:
    """The cascade order measured on ``texts``."""
    return arrange([m for x in texts if (m := measure(x, rules)) is not None], rules)


def order_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample: int = 300) -> tuple[str, ...]:
    """Names of the rules in cascade order, measured on ``sample`` texts picked by hash."""
    ids = sampled_ids(docs, id_col, sample)

    def run(batches):
        for batch in batches:
            found = [m for x in batch.column(0).to_pylist() if (m := measure(x, rules)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([[r for r, _ in m] for m in found], pa.list_(pa.bool_())), pa.array([[s for _, s in m] for m in found], pa.list_(pa.float64()))], ["rejects", "seconds"])

    # sample ids bound the small side, and a text for each id the rows; they are measured where they are
    drawn = docs.join(F.broadcast(ids), id_col, "left_semi").groupBy(id_col).agg(F.min_by(text_col, F.xxhash64(text_col)).alias("text")).select("text")
    rows = drawn.mapInArrow(run, "rejects array<boolean>, seconds array<double>").collect()
    return arrange([list(zip(r["rejects"], r["seconds"], strict=True)) for r in rows], rules)


def judge(docs: DataFrame, order: tuple[str, ...] | None = None, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Base counts, ``base_failed``, ``kept`` and the first rule that rejected, of each whole text."""
    by_name = {r.name: r for r in rules}
    cascade = [by_name[n] for n in (order or order_rules(docs, id_col, text_col, rules))]
    source = docs.select(id_col, F.col(text_col).alias("_text"))
    schema = T.StructType([source.schema.fields[0], *(T.StructField(c, T.LongType()) for c in ("n_words", *BASE)), T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("rejected_by", T.StringType())])

    def run(batches):
        for batch in batches:
            rows: list[list] = [[] for _ in range(8)]
            for raw in batch.column(1).to_pylist():
                t = Text(raw)
                failed = base_failed(t)
                by = "base" if failed else next((r.name for r in cascade if not r.passes(t)), None)
                for out, v in zip(rows, (t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, failed, by is None, by), strict=True):
                    out.append(v)
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, k) for v, k in zip(rows, kinds, strict=True))], [batch.schema.names[0], "n_words", *BASE, "base_failed", "kept", "rejected_by"])

    return source.mapInArrow(run, schema)


def op7_quality(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).drop("rejected_by")


OP7_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
      FROM (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d)),
t AS (SELECT rid, i, w, lead(w, 1) OVER (PARTITION BY rid ORDER BY i) AS w2, lead(w, 2) OVER (PARTITION BY rid ORDER BY i) AS w3 FROM w),
r AS (SELECT *, w3 IS NOT NULL AND count(*) OVER (PARTITION BY rid, w, w2, w3) > 1 AS rep FROM t),
c AS (SELECT rid, w, rep OR coalesce(lag(rep, 1) OVER (PARTITION BY rid ORDER BY i), false) OR coalesce(lag(rep, 2) OVER (PARTITION BY rid ORDER BY i), false) AS cov FROM r),
ws AS (SELECT rid, count(*) AS n_words, sum(length(w))::BIGINT AS word_chars, sum(cov::INT)::BIGINT AS n_repeat_words,
              sum(regexp_matches(w, '\p{L}')::INT)::BIGINT AS n_letter_words FROM c GROUP BY rid),
l AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
ls AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
f AS (SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
             coalesce(n_letter_words, 0) AS n_letter_words, coalesce(n_lines, 0) AS n_lines,
             length(regexp_replace(text, '[^\p{L}]', '', 'g'))::BIGINT AS n_letters
      FROM d LEFT JOIN ws USING (rid) LEFT JOIN ls USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars >= 3 * n_words AND word_chars <= 10 * n_words AND 10 * n_symbols <= n_words
       AND 10 * n_dup_lines <= 4 * n_lines AND 10 * n_letter_words >= 8 * n_words AND 2 * n_letters >= word_chars AS kept
FROM b
"""
