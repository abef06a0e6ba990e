"""Spelling variants: words at one inserted, deleted or replaced letter, and the commoner form each leads to.

No pair of words is ever made for replacements. Two words of one length that
differ at one place share exactly one wildcard (place, prefix, suffix), so a
wildcard's group tells each of its words how many near words it has there, its
size less one, and the best of them: the group's best word, or its second best
for the best word itself. A group has at most one word for each letter, 90 here.
Of words a letter apart in length, the shorter is a deletion of the longer, so
each word's different deletions meet the vocabulary, one match a deletion. All
that is told of a word is summed by one grouping.

Words are numbered in code-point order, so rows between the steps hold numbers
and ties go to the least. Roots are found by jumping along forms; counts double
at least from form to form, so few rounds are enough.

A word of more than ``LONG`` letters has its wildcards and deletions told by a
127-bit polynomial hash modulo a prime, each in constant time, as spelling them
out would take the square of its length.

Defined results: null text has no words; a null id is empty before the colon of
what is hashed; repeated rows count as often as they come; ties as said; texts
of any length are read whole; an empty table, or one without words common
enough, gives an empty table; further columns do not matter, whatever their
names.
"""

from __future__ import annotations

from collections import Counter
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cache, Workspace, table
from .prefixtrie import CRC_TABLE, crc_of

#: Letters are A-Z, a-z and U+00C0 to U+00FF; in Latin-1 each is a byte. Others part words.
LETTERS = bytes(b if chr(b).isascii() and chr(b).isalpha() or b >= 0xC0 else 0x20 for b in range(256))
#: Letters of a word whose wildcards are spelled out at most.
LONG = 64
#: Different words that a task counts before it passes the counts on.
HELD = 1 << 18
PRIME, BASE = (1 << 127) - 1, 0x2545F4914F6CDD1D9E3779B97F4A7C15 >> 1


def counted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 5, drop: int = 97) -> DataFrame:
    """(word, n): counts of words, in part; of each document's runs with a checksum that ``drop`` divides, a letter is left out."""

    def run(batches):
        total: Counter[bytes] = Counter()
        utf8 = Cache(lambda w: w if w.isascii() else w.decode("latin-1").encode())

        def rows():
            words = [w for w in total if len(w) >= shortest and total[w]]
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in words], pa.string()), pa.array([total[w] for w in words], pa.int64())], ["word", "n"])

        for batch in batches:
            for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                # bytes have a lower case for A-Z only
                runs = [w for w in (text or "").encode("latin-1", "replace").lower().translate(LETTERS).split() if len(w) >= shortest]
                total.update(runs)
                head = crc32(f"{'' if doc is None else doc}:".encode())
                for w in [w for w in set(runs) if not crc32(utf8[w], head) % drop]:
                    n, at = runs.count(w), crc32(utf8[w], head) % len(w)
                    total[w] -= n
                    total[w[:at] + w[at + 1 :]] += n
                if len(total) >= HELD:
                    yield rows()
                    total.clear()
        if total:
            yield rows()

    return docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "word string, n long")


def vocabulary(counts: DataFrame, space: Workspace, least: int = 3) -> DataFrame:
    """(id, word, n, length) of words counted ``least`` times or more; ids follow code-point order."""
    common = counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    ordered = common.repartitionByRange("word").sortWithinPartitions("word")
    return space.keep(ordered.select(F.monotonically_increasing_id().alias("id"), "word", "n", F.length("word").alias("length")), "vocabulary")


def _spelled_out(word: str) -> tuple[str, list[str], set[str]]:
    """A long word's own key, its wildcards' and its different deletions'."""
    size, before, power = len(word), [0], [1]
    for c in word:
        before.append((before[-1] * BASE + ord(c) + 1) % PRIME)
        power.append(power[-1] * BASE % PRIME)
    whole = before[-1]
    wild, cut = [], set()
    for i in range(size):
        after = whole - before[i + 1] * power[size - i - 1]
        wild.append(f"{size}*{i}*{(before[i] * power[size - i] + after) % PRIME:x}")
        cut.add(f"#{(before[i] * power[size - i - 1] + after) % PRIME:x}")
    return f"#{whole:x}", wild, cut


def _long_keys(words: DataFrame) -> DataFrame:
    """(kind, key, id, n) of words of ``LONG`` letters or more: kind s their own keys, and of longer ones w wildcards, d deletions."""

    def run(batches):
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64()]
        for batch in batches:
            for i, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, wild, cut = _spelled_out(word)
                rows = [("s", own, i, n)]
                if len(word) > LONG:
                    rows += [("w", k, i, n) for k in wild] + [("d", k, i, n) for k in cut]
                for at in range(0, len(rows), 1 << 14):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[at : at + (1 << 14)], strict=True), kinds, strict=True)], ["kind", "key", "id", "n"])

    return words.filter(F.col("length") >= LONG).select("id", "word", "n").mapInArrow(run, "kind string, key string, id long, n long")


def near_words(words: DataFrame, space: Workspace) -> DataFrame:
    """(id, n_near, best): of each word that has near words their number, and the count (negative) and id of the best."""
    short = words.filter(F.col("length") <= LONG)
    places = F.sequence(F.lit(1), F.col("length"))
    without = lambda i, mark: F.concat(F.substring("word", 1, i - 1), F.lit(mark), F.substring("word", i + 1, F.col("length")))
    long_keys = space.keep(_long_keys(words), "long")

    wild = short.select(F.explode(F.transform(places, lambda i: without(i, "*"))).alias("key"), "id", "n").unionByName(long_keys.filter("kind = 'w'").drop("kind"))
    groups = wild.groupBy("key").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "id"))).alias("all")).filter(F.size("all") > 1)
    member = groups.select(F.explode("all").alias("e"), (F.size("all") - 1).cast("long").alias("near"), F.col("all")[0].alias("one"), F.col("all")[1].alias("two"))
    replaced = member.select("e.id", "near", F.when(F.col("e.id") == F.col("one.id"), F.col("two")).otherwise(F.col("one")).alias("best"))

    cut = short.select(F.explode(F.array_distinct(F.transform(places, lambda i: without(i, "")))).alias("key"), "id", "n").unionByName(long_keys.filter("kind = 'd'").drop("kind"))
    own = words.filter(F.col("length") < LONG).select(F.col("word").alias("key"), F.col("id").alias("to"), F.col("n").alias("to_n")).unionByName(long_keys.filter("kind = 's'").select("key", F.col("id").alias("to"), F.col("n").alias("to_n")))
    met = cut.join(own, "key")
    told = lambda a, b, n: F.struct(F.col(a).alias("id"), F.struct((-F.col(n)).alias("m"), F.col(b).alias("id")).alias("best"))
    indels = met.select(F.explode(F.array(told("id", "to", "to_n"), told("to", "id", "n"))).alias("e")).select("e.id", F.lit(1).cast("long").alias("near"), "e.best")
    return replaced.unionByName(indels).groupBy("id").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame, space: Workspace) -> DataFrame:
    """(id, root) of rows (id, form): where following forms ends."""
    at = space.keep(forms.select("id", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots-0")
    rounds = 0
    while not at.filter("moved").isEmpty():
        further = at.select(F.col("id").alias("root"), F.col("root").alias("next"))
        rounds += 1
        at = space.keep(at.join(further, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), f"roots-{rounds}")
        space.drop(f"roots-{rounds - 1}")
    return at.select("id", "root")


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 5, least: int = 3, ratio: int = 2, drop: int = 97) -> DataFrame:
    """word, n, n_near, form, form_n and root of each word."""
    space = Workspace(docs.sparkSession, "variants")
    words = vocabulary(counted_runs(docs, id_col, text_col, shortest, drop), space, least)
    near = words.select("id", "word", "n").join(near_words(words, space), "id", "left")
    leads = -F.col("best.m") >= ratio * F.col("n")
    formed = space.keep(near.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(leads, F.col("best.id")).alias("form"), F.when(leads, -F.col("best.m")).alias("form_n")), "formed")
    ends = roots(formed.filter("form is not null").select("id", "form"), space)
    named = lambda c: words.select(F.col("id").alias(c), F.col("word").alias(f"_{c}"))
    joined = formed.join(ends, "id", "left").join(named("form"), "form", "left").join(named("root"), "root", "left")
    return joined.select("word", "n", "n_near", F.col("_form").alias("form"), "form_n", F.coalesce("_root", "word").alias("root"))


def op13_variants(spark, sf_dir: str) -> DataFrame:
    return group_variants(table(spark, sf_dir, "documents"))


OP13_SQL = rf"""
WITH RECURSIVE crc AS ({CRC_TABLE}),
r AS (SELECT doc_id, run, count(*) AS n
      FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents)
      WHERE length(run) >= 5 GROUP BY 1, 2),
s AS (SELECT run, n, coalesce(doc_id::VARCHAR, '') || ':' || run AS said FROM r),
h AS (SELECT run, n, {crc_of("list_transform(range(strlen(said)), lambda i: ('0x' || substr(hex(said), 2 * i + 1, 2))::BIGINT)")} AS h FROM s, crc),
v AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h)
      WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
k AS (SELECT word, n, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS key FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
d AS (SELECT DISTINCT word, n, replace(key, '*', '') AS key FROM k),
near AS (SELECT a.word, b.word AS other, b.n FROM k a JOIN k b USING (key) WHERE a.word <> b.word
         UNION ALL SELECT d.word, v.word, v.n FROM d JOIN v ON d.key = v.word
         UNION ALL SELECT v.word, d.word, d.n FROM d JOIN v ON d.key = v.word),
best AS (SELECT word, count(*) AS n_near, min((-n, other)) AS b FROM near GROUP BY 1),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b[1] >= 2 * v.n THEN b[2] END AS form, CASE WHEN -b[1] >= 2 * v.n THEN -b[1] END AS form_n FROM v LEFT JOIN best USING (word)),
w AS (SELECT word, word AS root FROM f UNION ALL SELECT w.word, f.form FROM w JOIN f ON f.word = w.root WHERE f.form IS NOT NULL)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, w.root FROM f JOIN w ON w.word = f.word JOIN f z ON z.word = w.root AND z.form IS NULL
"""
