"""URL filters: explicit rules first, then a model for the rest.

Concatenated host names are split into words by unigram Viterbi, and
multinomial naive Bayes scores the tokens of the segmented host and of the
path. The unigram counts come from the visible words of all pages; the classes
are learned from the URLs that a rule decides. All counts stay in tables: a
label is joined with the counts of its own substrings, a URL with the odds of
its own tokens, so neither vocabulary is cut.

Defined results: a null URL or one without ``://`` has an empty host and path,
fits no rule and gets the model's verdict on no tokens (the commoner class).
Without both classes among the ruled URLs the model answers ``allow``. Ties
go to ``allow``, and of splits of equal cost to the one whose last word is
longest. A label of more than 63 characters is no name of the DNS and stays
whole. Repeated rows have equal verdicts and count as often as they come in
training; an empty table gives an empty table; columns beyond id, URL and html
do not matter, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, table

TOKEN = r"[\p{L}\p{N}]+"
#: Characters of a label of the DNS at most.
LONGEST = 63


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    rule: str

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.rule.partition("/")[2]


RULES = (UrlRule("block", "com/en/"), UrlRule("allow", "example.com/en/7"), UrlRule("allow", "net/de/"), UrlRule("block", "example.net/de/8"), UrlRule("block", "org/es/"))


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.coalesce(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def matched_rule(host: Column, path: Column, rules: tuple[UrlRule, ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.rule), r.rule)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        rule, verdict = F.when(fits, F.lit(r.rule)).otherwise(rule), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return rule, verdict


class Segmenter:
    """Unigram Viterbi: the likeliest split of a name into known words or single unknown characters.

    ``total`` is the sum of all words' counts and their number, if ``counts`` are not all.
    """

    def __init__(self, counts: dict[str, int], total: int | None = None) -> None:
        total = (sum(counts.values()) + len(counts) if total is None else total) + 1
        self.cost = {w: -math.log(n / total) for w, n in counts.items()}
        self.longest = max(map(len, counts), default=1)
        self.unknown = math.log(total) + 10

    def split(self, name: str) -> tuple[str, ...]:
        best, back = [0.0], [0]
        for j in range(1, len(name) + 1):
            options = [(best[j - 1] + self.cost.get(name[j - 1], self.unknown), j - 1)]
            options += [(best[i] + self.cost[name[i:j]], i) for i in range(max(0, j - self.longest), j - 1) if name[i:j] in self.cost]
            cost, i = min(options)
            best.append(cost)
            back.append(i)
        out, j = [], len(name)
        while j:
            out.append(name[back[j] : j])
            j = back[j]
        return tuple(reversed(out))


#: What opens and ends an element whose content is no text.
UNSEEN = [(re.compile(rf"<{t}\b", re.I), re.compile(rf"</{t}", re.I)) for t in ("script", "style")]
LETTERS = regex.compile(r"\p{L}+")
#: Different words that a task counts before it passes the counts on.
HELD = 1 << 18


def visible(html: str | None) -> str:
    """The text without tags, scripts and styles, in one pass for each; what is never closed is text."""
    html = html or ""
    for opens, ends in UNSEEN:
        *closed, rest = ends.split(html)
        html = " ".join([*(p[: m.start()] if (m := opens.search(p)) else p for p in closed), rest])
    *tagged, rest = html.split(">")
    return " ".join([*(p.partition("<")[0] for p in tagged), rest])


def unigrams(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(w, n): how often each word that a label could hold is in the pages' visible text."""

    def run(batches):
        total: Counter[str] = Counter()

        def told():
            words = [w for w in total if len(w) <= LONGEST]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([total[w] for w in words], pa.int64())], ["w", "n"])

        for batch in batches:
            for html in batch.column(0).to_pylist():
                total.update(LETTERS.findall(visible(html).lower()))
                if len(total) >= HELD:
                    yield told()
                    total.clear()
        yield told()

    return pages.select(html_col).mapInArrow(run, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))


def _tokens(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0), lambda t: F.regexp_replace(t, r"\d+", "0"))


def segmented(labels: DataFrame, counts: DataFrame) -> DataFrame:
    """(label, words) of each different label, by the counts (w, n) of its own substrings."""
    # one row
    total = counts.agg((F.coalesce(F.sum("n"), F.lit(0)) + F.count("*")).alias("_total")).first()[0]
    short = labels.filter(F.length("label") <= LONGEST)
    piece = F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.length("label")), lambda i: F.transform(F.sequence(F.lit(1), F.length("label") - i + 1), lambda k: F.substring("label", i, k)))))
    own = short.select("label", piece.alias("w")).distinct().join(counts, "w").groupBy("label").agg(F.map_from_entries(F.collect_list(F.struct("w", "n"))).alias("own"))

    def run(batches):
        for batch in batches:
            labels = batch.column(0).to_pylist()
            words = [list(Segmenter(dict(own or ()), total).split(x)) if len(x) <= LONGEST else [x] for x, own in zip(labels, batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string()))], ["label", "words"])

    return labels.join(own, "label", "left").mapInArrow(run, "label string, words array<string>")


def url_tokens(urls: DataFrame, counts: DataFrame, space: Workspace) -> DataFrame:
    """``urls`` (host, path, ...) with ``tokens``: h: words of the segmented host, p: tokens of the path."""
    hosts = urls.select("host").distinct().withColumn("label", F.explode(_tokens(F.col("host"))))
    labels = space.keep(segmented(space.keep(hosts.select("label").distinct(), "labels"), counts), "segmented")
    words = space.keep(hosts.join(labels, "label").groupBy(F.col("host").alias("_host")).agg(F.flatten(F.collect_list("words")).alias("_words")), "hostwords")
    joined = urls.join(words, F.col("host") == F.col("_host"), "left")
    named = F.transform(F.coalesce("_words", F.array().cast("array<string>")), lambda w: F.concat(F.lit("h:"), w))
    return joined.withColumn("tokens", F.concat(named, F.transform(_tokens(F.col("path")), lambda w: F.concat(F.lit("p:"), w)))).drop("_host", "_words")


@dataclass
class UrlModel:
    """(token, odds) of all tokens of ruled URLs, odds being the log odds of block; what an unseen token and no token have."""

    odds: DataFrame
    unseen: float
    prior: float
    both: bool


def train(urls: DataFrame, space: Workspace) -> UrlModel:
    """Naive Bayes from ``tokens``, ``n`` and ``ruled`` (allow or block): add-one counts of all tokens."""
    ruled = urls.filter(F.col("ruled").isNotNull())
    of = lambda verdict: F.coalesce(F.sum(F.when(F.col("ruled") == verdict, F.col("n"))), F.lit(0)).alias(verdict)
    counted = space.keep(ruled.select("ruled", "n", F.explode("tokens").alias("token")).groupBy("token").agg(of("allow"), of("block")), "tokens")
    # one row each
    size = counted.agg(F.count("*").alias("k"), F.coalesce(F.sum("allow"), F.lit(0)).alias("allow"), F.coalesce(F.sum("block"), F.lit(0)).alias("block")).first()
    seen = ruled.agg(of("allow"), of("block")).first()
    allow, block = size["allow"] + size["k"] + 1, size["block"] + size["k"] + 1
    odds = F.ln((F.col("block") + 1) / block) - F.ln((F.col("allow") + 1) / allow)
    return UrlModel(counted.select("token", odds.alias("odds")), math.log(allow / block), math.log((seen["block"] + 1) / (seen["allow"] + 1)), bool(seen["allow"] and seen["block"]))


def filter_urls(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col``, ``host``, ``path``, ``rule`` and ``verdict`` of each URL."""
    space = Workspace(pages.sparkSession, "urls")
    named = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"))
    host, path = host_path(F.col("_url"))
    parts = named.select("_id", host.alias("host"), path.alias("path"))
    rule, ruled = matched_rule(F.col("host"), F.col("path"), rules)
    parts = parts.select("_id", "host", "path", rule.alias("rule"), ruled.alias("ruled"))
    urls = parts.groupBy("host", "path", "ruled").agg(F.count("*").alias("n"))
    tokens = space.keep(url_tokens(urls, space.keep(unigrams(pages, html_col), "words"), space), "urls")
    model = train(tokens, space)
    open_urls = tokens.filter(F.col("ruled").isNull()).select("host", "path", F.explode_outer("tokens").alias("token"))
    scored = open_urls.join(model.odds, "token", "left").groupBy("host", "path").agg(F.sum(F.when(F.col("token").isNull(), 0.0).otherwise(F.coalesce("odds", F.lit(model.unseen)))).alias("_odds"))
    # sums in another order differ in their last digits
    blocked = F.lit(model.both) & (F.round(F.col("_odds") + model.prior, 9) > 0)
    scores = space.keep(scored.select(F.col("host").alias("_h"), F.col("path").alias("_p"), F.when(blocked, "block").otherwise("allow").alias("_verdict")), "scores")
    joined = parts.join(scores, F.col("ruled").isNull() & (F.col("host") == F.col("_h")) & (F.col("path") == F.col("_p")), "left")
    return joined.select(F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", "_verdict").alias("verdict"))


def op9_urls(spark, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))
