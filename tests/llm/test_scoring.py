"""Toxicity, language, quality, URLs, HTML: row-wise operators."""

from __future__ import annotations

import html as entities
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.llm import htmltext, langid, quality, toxicity, urlfilter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(None, "nulls in id", None, None, None), (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "?! 12", "en", "a", 5), (4, "word " * 30000, "en", "a", 1), (5, "same", "fr", "b", 4), (5, "same", "fr", "b", 4)]


def toxic_corpus(n=400, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        bad = i % 8 == 0
        text = rng.choices(words, k=40) + (rng.choices(["vile", "grimwort", "sludgeface"], k=3) if bad else [])
        rng.shuffle(text)
        docs.append((i, " ".join(text), "en", "s", 0))
        if i % 2 == 0:
            labels.append((i, 1, int(bad)))
    return docs, labels


def test_toxicity_learns_from_the_training_rows_alone(frame):
    docs, labels = toxic_corpus()
    d, lab = frame(DOCS, docs), frame("doc_id long, quality int, toxic int", labels)
    keep = F.col("doc_id") % 5 != 0
    model = toxicity.train(d, lab, trainable=keep)
    flipped = lab.withColumn("toxic", F.when(keep, F.col("toxic")).otherwise(1 - F.col("toxic")))
    assert toxicity.train(d, flipped, trainable=keep).features == model.features
    got = {r.doc_id: r.score for r in toxicity.score(d, model).collect()}
    assert all((got[i] >= 0.5) == (i % 8 == 0) for i in range(400))


def brute_nnpu(x, positive, unlabelled, prior, steps=400, rate=0.05, l2=1e-4):
    """Adam on the non-negative risk, written out; the gradients are differences of risks."""
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    one = np.hstack([x, np.ones((len(x), 1))])
    theta = np.zeros(one.shape[1])
    theta[-1] = math.log(prior / (1 - prior))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        zp, zu = one[positive] @ theta, one[unlabelled] @ theta
        as_negative = lambda rows, z: (rows * sigmoid(z)[:, None]).mean(0)
        negative = as_negative(one[unlabelled], zu) - prior * as_negative(one[positive], zp)
        if np.log1p(np.exp(zu)).mean() - prior * np.log1p(np.exp(zp)).mean() < 0:
            g = -negative
        else:
            g = negative - prior * (one[positive] * sigmoid(-zp)[:, None]).mean(0)
        g = g + l2 * np.append(theta[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
        theta = theta - rate * m / (1 - 0.9**t) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta


def test_scores_are_those_of_the_features(frame):
    docs, labels = toxic_corpus()
    d = frame(DOCS, docs)
    model = toxicity.train(d, frame("doc_id long, quality int, toxic int", labels))
    for r in toxicity.score(d, model, keep=("text",)).collect():
        found = {f for w in re.findall(r"\w+", r.text.lower()) for f in ["w" + w, *(f"{k}{w[:k]}" for k in (4, 5, 6) if len(w) > k)]}
        assert r.score == pytest.approx(1 / (1 + math.exp(-model.bias - sum(model.weights[model.features[f]] for f in found if f in model.features))))


def test_a_repeated_id_trains_once(frame):
    docs, labels = toxic_corpus()
    lab = frame("doc_id long, quality int, toxic int", labels)
    more = [(8, f"other {i} vile", "en", "s", 0) for i in range(300)]
    model = toxicity.train(frame(DOCS, docs + more), lab)
    assert model.params["n_positive"] == sum(t for _, _, t in labels) and model.params["n_unlabelled"] == 400


def test_every_text_trains(frame, monkeypatch):
    """More texts than any sample of 9000, and toxic ones beyond 3000; sets of features beyond the driver's give the same model."""
    rng = random.Random(6)
    docs = [(i, " ".join(rng.choices(["plain", "word", "here", "there", "again"], k=3) + (["vile"] if i < 3200 and i % 2 else []) + (["grim"] if i < 3200 and i % 3 else [])), "en", "s", 0) for i in range(12000)]
    d, lab = frame(DOCS, docs), frame("doc_id long, quality int, toxic int", [(i, 1, int(i < 3200)) for i in range(0, 12000)])
    model = toxicity.train(d, lab)
    assert model.params["n_positive"] == 3200 and model.params["n_unlabelled"] == 12000 and model.features
    monkeypatch.setattr(toxicity, "HELD_SETS", 0)
    monkeypatch.setattr(toxicity.descend, "__defaults__", (20, 0.05, 1e-4))
    spread = toxicity.train(d, lab)
    monkeypatch.setattr(toxicity, "HELD_SETS", 1 << 17)
    held = toxicity.train(d, lab)
    assert spread.features == held.features and np.allclose(np.append(spread.weights, spread.bias), np.append(held.weights, held.bias))


def test_counts_come_from_few_tasks(spark, frame, monkeypatch):
    """However many tasks read the texts, the rows of counts don't grow with them."""
    docs, labels = toxic_corpus()
    lab = frame("doc_id long, quality int, toxic int", labels)
    whole = toxicity.train(frame(DOCS, docs), lab)
    d, tasks = frame(DOCS, docs).repartition(40), []
    run = type(d).mapInArrow

    def watched(self, func, *more):
        if func.__name__ == "tally":
            tasks.append(self.rdd.getNumPartitions())
        return run(self, func, *more)

    monkeypatch.setattr(type(d), "mapInArrow", watched)
    # a task for each file
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000000")
    try:
        model = toxicity.train(d, lab)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(tasks) == 1 and tasks[0] <= 8
    assert model.features == whole.features and (model.weights == whole.weights).all()


def prefix_corpus(n=600, seed=4):
    """Words that share prefixes of 4, 5 and 6 letters, some of them toxic, some in one text only."""
    rng = random.Random(seed)
    words = [a + b + c for a in ("abcd", "abce", "xyzu") for b in ("", "e", "ef", "efg") for c in ("", "g", "h", "hh", "ij")]
    once = lambda i: [f"{a}{i}{b}" for a, b in rng.sample([("abcd", ""), ("abcde", "q"), ("abcdef", "q"), ("abcdefg", ""), ("xyzue", "z"), ("xyzuef", "")], k=3)]
    docs = [(i, " ".join(rng.choices(words, k=6) + once(i) + ([*rng.choices(["vileness", "vileful", "viler", "vilest", "vile"], k=2), f"vile{i}q"] if i % 4 == 0 else [])), "en", "s", 0) for i in range(n)]
    return docs, [(i, 1, int(i % 4 == 0)) for i in range(0, n, 2)]


def test_features_are_those_of_a_plain_count(frame, monkeypatch):
    docs, labels = prefix_corpus()
    toxic = {i for i, _, t in labels if t}
    held = {i: {f for w in re.findall(r"\w+", text) for f in ["w" + w, *(f"{k}{w[:k]}" for k in (4, 5, 6) if len(w) > k)]} for i, text, *_ in docs}
    pos, unl = Counter(f for i in toxic for f in held[i]), Counter(f for h in held.values() for f in h)
    n_pos, n_unl = len(toxic), len(docs)
    chosen = []
    for f in sorted(pos):
        p, u = pos[f] / n_pos, unl[f] / n_unl
        if pos[f] >= 3 and p > 3 * u and p - u > 3 * math.sqrt((p * (1 - p) + 1 / n_pos) / n_pos + (u * (1 - u) + 1 / n_unl) / n_unl):
            chosen.append(f)
    kept = {}
    keep = toxicity.Workspace.keep
    monkeypatch.setattr(toxicity.Workspace, "keep", lambda self, df, name: kept.setdefault(name, keep(self, df, name)))
    model = toxicity.train(frame(DOCS, docs).repartition(5), frame("doc_id long, quality int, toxic int", labels))
    assert list(model.features) == chosen and chosen
    sets = Counter((0, tuple(k for k, f in enumerate(chosen) if f in h)) for h in held.values()) + Counter((1, tuple(k for k, f in enumerate(chosen) if f in held[i])) for i in toxic)
    assert {(r.kind, tuple(r.found)): r.n for r in kept["sets"].collect()} == sets
    # a number a word, not one for each of its features
    assert sum(len(r.found) for r in kept["found"].collect()) <= sum(len({*text.split()}) for _, text, *_ in docs)


def test_texts_stay_where_they_are(spark, frame, monkeypatch):
    """Ids go to the texts even where Spark would not send them; a shuffle of both gives the same model."""
    docs, labels = toxic_corpus()
    d, lab = frame(DOCS, docs + docs[:9]), frame("doc_id long, quality int, toxic int", labels)
    plans = {}
    keep = toxicity.Workspace.keep

    def watched(self, df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return keep(self, df, name)

    monkeypatch.setattr(toxicity.Workspace, "keep", watched)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        model = toxicity.train(d, lab)
        assert "BroadcastHashJoin" in plans["positives"] and not any("SortMergeJoin" in p for p in plans.values())
        monkeypatch.setattr(toxicity, "SENT_IDS", 0)
        other = toxicity.train(d, lab)
        assert "SortMergeJoin" in plans["positives"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert model.params["n_unlabelled"] == len(docs)
    assert model.features == other.features and (model.weights == other.weights).all() and model.bias == other.bias


def test_nnpu_risk_corrects_the_prior():
    rng = np.random.default_rng(0)
    n = 4000
    toxic = rng.random(n) < 0.1
    x = (rng.random((n, 5)) < np.where(toxic[:, None], 0.6, 0.02)).astype(float)
    positive = np.flatnonzero(toxic)[:100]
    rows = toxicity.Rows(*np.nonzero(x), x.shape)
    w, b = toxicity.fit_nnpu(rows, positive, np.arange(n), prior=0.1)
    assert np.allclose(rows.take(positive).dot(w), x[positive] @ w) and np.allclose(rows.take(positive).sums(np.ones(100)), x[positive].sum(0))
    assert np.allclose(brute_nnpu(x, positive, np.arange(n), 0.1), np.append(w, b))
    score = 1 / (1 + np.exp(-(x @ w + b)))
    assert ((score >= 0.5) == toxic).mean() > 0.97
    assert 0.05 < score.mean() < 0.2


def test_toxicity_defined_results(spark, frame):
    d = frame(DOCS, ODD)
    none = toxicity.train(d, frame("doc_id long, toxic int", []))
    rows = toxicity.score(d.withColumn("score", F.lit("clash")), none).collect()
    assert len(rows) == len(ODD) and all(r.score == pytest.approx(1e-3, rel=0.01) for r in rows)
    empty = frame(DOCS, [])
    assert toxicity.score(empty, toxicity.train(empty, frame("doc_id long, toxic int", []))).count() == 0


def brute_place(text, profiles, size):
    t = re.sub(r"[^\w]|[\d_]", " ", text.lower())
    t = " " + " ".join(t.split()) + " "
    grams = Counter(c for c in t if c != " ")
    for n in (2, 3):
        grams.update(t[i : i + n] for i in range(len(t) - n + 1))
    value = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    own = [value(g) for g, _ in sorted(grams.items(), key=lambda x: (-x[1], value(x[0])))[:size]]
    distance = {k: sum(abs(p.index(g) - i) if g in p else size for i, g in enumerate(own)) for k, p in profiles.items()}
    return min(sorted(distance), key=distance.get)


def test_language_against_brute_force(frame):
    rng = random.Random(1)
    sets = {"xx": ["abba", "cab", "bac", "öl"], "yy": ["zot", "tozz", "ozo", "ñu"]}
    rows = [(i, " ".join(rng.choices(sets[k], k=30)), k, "s", 0) for i, k in enumerate(["xx", "yy"] * 40)]
    profiles = langid.learn(frame(DOCS, rows), size=50)
    assert sorted(profiles) == ["xx", "yy"]
    got = {r.doc_id: r.lang_pred for r in langid.predict(frame(DOCS, rows), profiles, size=50).collect()}
    assert all(got[i] == k for i, _, k, *_ in rows)
    for text in ("abba cab zot", "Tozz!", "ab ot"):
        assert langid.Ranker(profiles, 50).predict(text)[0] == brute_place(text, profiles, 50)


def test_language_defined_results(frame):
    profiles = langid.learn(frame(DOCS, [(9, "bonjour le monde", "fr", "s", 0)]))
    got = [(r.doc_id, r.lang_pred, r.score) for r in langid.predict(frame(DOCS, ODD), profiles).collect()]
    assert {(i, p, s) for i, p, s in got if i in (1, 2, 3)} == {(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0)}
    assert all(p == "fr" for i, p, _ in got if i not in (1, 2, 3)) and len(got) == len(ODD)
    assert langid.predict(frame(DOCS, ODD), langid.learn(frame(DOCS, []))).filter("lang_pred <> 'und'").count() == 0


def test_quality_counts_against_brute_force():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice(["a", "b", "b c", " ", "\n", "\n\n", "x y z ", "#", "\t"]) for _ in range(rng.randint(0, 60)))
        words = re.findall("[^\x20\x09-\x0d]+", text)
        covered, windows = set(), [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        for i, w in enumerate(windows):
            if windows.count(w) > 1:
                covered |= {i, i + 1, i + 2}
        lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        t = quality.Text(text)
        assert (t.n_words, t.n_repeat_words, t.n_symbols) == (len(words), len(covered), text.count("#"))
        assert t.n_dup_lines == sum(x in lines[:i] for i, x in enumerate(lines))


def test_quality_order_never_changes_the_verdict(frame):
    rows = [(100 + i, " ".join(f"word{j * i % 97}x" for j in range(60 + i)) + "#" * i, "en", "s", 0) for i in range(40)] + ODD
    d = frame(DOCS, rows)
    one = quality.judge(d, ("letters", "symbols", "letter_words", "duplicate_lines", "mean_word_length")).drop("rejected_by")
    two = quality.judge(d).drop("rejected_by")
    key = lambda df: sorted(map(repr, df.collect()))
    assert key(one) == key(two) and one.count() == len(rows)
    assert not one.filter("doc_id in (1, 2)").filter("kept or n_words > 0 or not base_failed").count()


def test_rules_are_measured_as_the_cascade_meets_them():
    good = " ".join(f"word{'abcdefghij'[j % 10]}{j}" for j in range(80))
    # lines repeat only in texts that the base test rejects; symbols reject some of the others
    texts = ["same\n" * 60] * 40 + [good + " #" * 20] * 10 + [good] * 30
    assert quality.plan(texts)[0] == "symbols"
    # a rule that rejects what an earlier one has rejected comes last
    slow = lambda n, f: lambda t: [f(t) for _ in range(n)][-1]
    rules = tuple(quality.Rule(name, slow(n, f)) for name, n, f in (("a", 50, lambda t: "#" not in t.text), ("b", 200, lambda t: "#" not in t.text), ("c", 400, lambda t: "wordb1" not in t.text or "#" in t.text)))
    assert quality.plan(texts, rules) == ("a", "c", "b")
    assert quality.plan([], rules) == ("a", "b", "c")


URLS = [
    (1, "https://shop.example.com/en/7/x?q=1", "shop.example.com", "/en/7/x", "example.com/en/7", "allow"),
    (2, "http://a.com/en/8#t", "a.com", "/en/8", "com/en/", "block"),
    (3, "http://WWW.Example.NET/de/8/", "www.example.net", "/de/8/", "example.net/de/8", "block"),
    (4, "http://example.net/de/9", "example.net", "/de/9", "net/de/", "allow"),
    (5, "http://notexample.com/en/7", "notexample.com", "/en/7", "com/en/", "block"),
    (6, "http://x.org/es/1", "x.org", "/es/1", "org/es/", "block"),
    (7, "http://x.org", "x.org", "", None, None),
    (8, "no scheme", "", "", None, None),
    (9, None, "", "", None, None),
    (10, "a://b://c/en/", "b:", "//c/en/", None, None),
]


def test_url_parts_and_rules(frame):
    df = frame("page_id long, url string, html string", [(i, u, "<p>shop example</p>") for i, u, *_ in URLS] + [(1, URLS[0][1], None)])
    got = {(r.page_id, r.host, r.path, r.rule): r.verdict for r in urlfilter.filter_urls(df.withColumn("host", F.lit("clash"))).collect()}
    assert len(got) == len(URLS)
    for i, _, host, path, rule, verdict in URLS:
        assert got[(i, host, path, rule)] == (verdict or got[(i, host, path, rule)])


def test_segmentation_is_the_likeliest_split():
    counts = {"red": 50, "apple": 20, "redapple": 1, "app": 5, "le": 5, "shop": 9}
    s = urlfilter.Segmenter(counts)
    total = sum(counts.values()) + len(counts) + 1

    def splits(name):
        if not name:
            yield ()
        for i in range(1, len(name) + 1):
            if name[:i] in counts or i == 1:
                for rest in splits(name[i:]):
                    yield (name[:i], *rest)

    cost = lambda ws: sum(-math.log(counts[w] / total) if w in counts else s.unknown for w in ws)
    for name in ("redapple", "redappleshop", "xred", "qq"):
        assert cost(s.split(name)) == pytest.approx(min(map(cost, splits(name))))
        own = {w: n for w, n in counts.items() if w in name}
        assert urlfilter.Segmenter(own, total - 1).split(name) == s.split(name)


def brute_verdicts(rows, words):
    """Naive Bayes over dictionaries."""
    segment = urlfilter.Segmenter(words)

    def tokens(host, path):
        low = lambda x: [re.sub(r"\d+", "0", t) for t in re.findall(r"[^\W_]+", x.lower())]
        return [f"h:{w}" for label in low(host) for w in (segment.split(label) if len(label) <= 63 else [label])] + [f"p:{t}" for t in low(path)]

    seen = {k: Counter() for k in ("allow", "block")}
    urls = Counter(r for *_, r in rows if r)
    for host, path, ruled in rows:
        if ruled:
            seen[ruled].update(tokens(host, path))
    known = set(seen["allow"]) | set(seen["block"])
    size = {k: c.total() + len(known) + 1 for k, c in seen.items()}
    odds = lambda t: math.log((seen["block"][t] + 1) / size["block"]) - math.log((seen["allow"][t] + 1) / size["allow"])
    prior = math.log((urls["block"] + 1) / (urls["allow"] + 1))
    return [ruled or ("block" if urls["allow"] and urls["block"] and prior + sum(map(odds, tokens(host, path))) > 0 else "allow") for host, path, ruled in rows]


def test_verdicts_against_brute_force(frame):
    rng = random.Random(8)
    word = lambda: rng.choice(["red", "apple", "cheap", "pills", "garden", "x9", "qzx"])
    rows = []
    for i in range(150):
        host = f"{word()}{word()}.{rng.choice(['com', 'net', 'org', 'info'])}"
        rows.append((i, f"http://{host}/{rng.choice(['en', 'de', 'es'])}/{word()}-{rng.randint(0, 50)}?q", f"<p>{word()} {word()} {word()}</p>"))
    rows += [(200, f"http://{'a' * 70}.info/pills", ""), (201, None, None), (1, rows[1][1], "<p>again</p>")]
    words = Counter(w for *_, h in rows for w in re.findall(r"[^\W\d_]+", re.sub("<[^>]*>", " ", h or "").lower()))
    got = urlfilter.filter_urls(frame("page_id long, url string, html string", rows).withColumn("token", F.lit("clash"))).collect()
    ruled = {"com/en/": "block", "net/de/": "allow", "org/es/": "block"}
    assert [r.verdict for r in got] == brute_verdicts([(r.host, r.path, ruled.get(r.rule)) for r in got], words) and len(got) == len(rows)
    assert {r.verdict for r in got if r.rule is None} == {"allow", "block"}


def test_unruled_urls_follow_their_tokens(frame):
    rows = [(i, f"http://h{i}.com/en/cheappills{i}", "<p>cheap pills</p>") for i in range(40)] + [(100 + i, f"http://g{i}.net/de/garden", "<p>garden</p>") for i in range(40)]
    rows += [(998, "http://k.info/cheappills7", ""), (999, "http://k.info/garden", "")]
    got = {r.page_id: r.verdict for r in urlfilter.filter_urls(frame("page_id long, url string, html string", rows)).collect()}
    assert (got[998], got[999]) == ("block", "allow")
    assert urlfilter.filter_urls(frame("page_id long, url string, html string", [])).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style></head><body><header>Site</header><nav><ul><li>Menu<li>More</ul></nav>
<div class="cookie-notice">We use cookies</div><div id="sidebar">Side</div><article><h1>Big &amp; bold</h1><p>One<br>two <b>th</b>ree<p>Four &#233;
 five<script>var x = "</p>";</script><div class="ad">Buy</div><form>Name <input></form><ul><li>Six</li><li>Seven</ul></article>
<section class="comments"><p>First!</p></section><footer>&copy; 2024</footer></body></html>"""


def test_article_of_a_page():
    assert htmltext.main_text(PAGE) == "Big & bold One two three Four é five Six Seven"
    assert htmltext.main_text(PAGE.replace("article", "div")) == "Big & bold One two three Four é five Six Seven"


@pytest.mark.parametrize(
    ("source", "want"),
    [
        (None, ""), ("", ""), ("<", "<"), ("<p", ""), ("<!--", ""), ("<!--> a", "a"), ("a < b & c", "a < b & c"), ("<script>x", ""), ("<b>" * 5000 + "x", "x"), ("</p></div>x", "x"), ("<p>a<!-- x --><p>b", "a b"), ("plain", "plain"),
        ("<p don't>rest</p>", "rest"), ('<p title="a>b">c</p>', "c"), ("<p>a<p title='unclosed>b", "a"), ("<ul><li>a<li>b</ul>c", "a b c"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"),
        ('<article><p class="search">The search for gold</p></article>', "The search for gold"), ('<article><p id="ad-hoc">a</p><section class="related-work">b</section><blockquote class="reply">c</blockquote></article>', "a b c"),
        ("<main><p>m</p></main><article>teaser</article>", "m"), ("<form><article>a</article>b</form>", "a"), ("<article>a<nav>b</nav><aside>c</aside><div class='ad big'>d</div><section class='comments'>e</section></article>", "a"),
        ("<main><h1>t</h1><article>a</article><div class='share'>s</div></main>", "t a"),
    ],
)
def test_any_source_gives_a_text(source, want):
    assert htmltext.main_text(source) == want


@pytest.mark.parametrize("source", ['<a "' * 500000, "<b>" * 300000, "<b>" * 200000 + "<p></p>" * 100000, "<table>" + "<b>" * 200000 + "<td>" * 200000, "<b>" * 200000 + "</i>" * 200000, "<x y='" * 300000, "<" * 2000000, "<p>long &amp; " * 150000])
def test_very_long_pages_take_linear_time(source):
    began = time.process_time()
    htmltext.main_text(source)
    assert time.process_time() - began < 20


def site(rng, i, host="site.org", article=lambda p: f"<div class='body'>{p}</div>"):
    """A page without names: a menu whose words change, an advert of changing length, a text, a fixed line."""
    words = lambda n: " ".join(f"w{rng.randint(0, 9999)}" for _ in range(n))
    paragraphs = [words(rng.randint(15, 40)) for _ in range(rng.randint(1, 4))]
    menu = "".join(f"<li><a href='/{i}'>{words(2)}</a></li>" for _ in range(rng.randint(3, 6)))
    page = f"<body><ul>{menu}</ul><div class='x1'>Home {i} Docs {i + 1}</div>{article(''.join(f'<p>{p}</p>' for p in paragraphs))}<div class='x2'>All rights with {host}</div></body>"
    return (i, f"http://{host}/{i}", page), " ".join(paragraphs)


def test_the_tree_removes_what_no_name_gives_away(frame):
    rng = random.Random(6)
    pages, want = zip(*(site(rng, i) for i in range(30)), strict=True)
    df = frame("page_id long, url string, html string", list(pages))
    for names in (True, False):
        got = {r.page_id: r.text for r in htmltext.extract(df, names=names).collect()}
        assert [got[i] for i in range(30)] == list(want)
    # with the tree disabled every page has more
    assert all(htmltext.main_text(html) != w and w in htmltext.main_text(html) for (_, _, html), w in zip(pages, want, strict=True))


def test_beside_marked_articles_the_tree_weighs(frame):
    rng = random.Random(7)
    article = lambda p: f"<div class='promo2'>w{rng.randint(0, 9999)} w{rng.randint(0, 9999)}</div><article id='post-{rng.randint(0, 999)}'>{p}<p>The same closing line.</p></article>"
    pages, want = zip(*(site(rng, i, article=article) for i in range(20)), strict=True)
    other, text = site(rng, 100, "lone.org", article)
    got = {r.page_id: r.text for r in htmltext.extract(frame("page_id long, url string, html string", [*pages, other]), names=False).collect()}
    assert [got[i] for i in range(20)] == [f"{w} The same closing line." for w in want]
    # a host of one page is judged by kinds
    assert got[100].endswith(f"{text} The same closing line.") and "All rights" not in got[100]


def test_no_pages(frame):
    assert htmltext.extract(frame("page_id long, url string, html string", [])).count() == 0


@pytest.mark.parametrize("most", [htmltext.BROADCAST_BYTES, 0])
def test_template_blocks_of_a_site_go(frame, monkeypatch, most):
    monkeypatch.setattr(htmltext, "BROADCAST_BYTES", most)
    rng = random.Random(4)
    words = lambda: " ".join(f"w{rng.randint(0, 999)}" for _ in range(20))
    bodies = [words() for _ in range(12)]
    rows = [(i, f"http://site.org/{i}", f"<body><div class='top'>Welcome to the site</div><div class='body'><p>{entities.escape(b)}</p></div></body>") for i, b in enumerate(bodies)]
    rows += [(100, "http://other.org/1", "<body><div class='top'>Welcome to the site</div></body>"), (101, None, None)]
    got = {r.page_id: (r.text, r.n_chars) for r in htmltext.extract(frame("page_id long, url string, html string", rows).withColumn("text", F.lit("clash"))).collect()}
    assert all(got[i] == (b, len(b)) for i, b in enumerate(bodies))
    assert got[100][0] == "Welcome to the site" and got[101] == ("", 0)


@pytest.mark.parametrize("article", ["<article>", "<article id='post-7'>"])
def test_copies_of_a_page_are_no_template(frame, article):
    rng = random.Random(5)
    words = lambda: " ".join(f"w{rng.randint(0, 999)}" for _ in range(20))
    page = lambda opening, body: f"<body><div class='top'>Welcome</div>{opening}<p>{body}</p><p>About this site</p></article></body>"
    copied, bodies = words(), [words() for _ in range(9)]
    rows = [(i, f"http://site.org/{i}", page(article, copied)) for i in range(30)]
    rows += [(100 + i, f"http://site.org/{100 + i}", page("<article>", b)) for i, b in enumerate(bodies)]
    rows += [(200 + i, f"http://copies.org/{i}", page(article, copied)) for i in range(10)]
    got = {r.page_id: r.text for r in htmltext.extract(frame("page_id long, url string, html string", rows)).collect()}
    # no part of an article goes, nor does a site of one page lose its own
    assert [got[i] for i in range(30)] == [f"{copied} About this site"] * 30
    assert [got[100 + i] for i in range(9)] == [f"{b} About this site" for b in bodies]
    assert [got[200 + i] for i in range(10)] == [f"{copied} About this site"] * 10


@pytest.mark.parametrize("page", ["<script ", "<style ", "<", "<script>x</style", "a>", "</script "])
def test_visible_text_of_malformed_pages_takes_linear_time(frame, page):
    began = time.monotonic()
    text = urlfilter.visible("words before " + page * (2_000_000 // len(page)))
    assert text.startswith("words before") and time.monotonic() - began < 5


def test_visible_text_is_what_tags_leave(frame):
    html = "<p>One <b>two</b> <script>var hidden = '<p>';</script>three <STYLE type=x>.gone{}</STYLE> a > b <i\n>four</i> <script>never closed <p>five"
    assert urlfilter.visible(html).split() == ["One", "two", "three", "a", "b", "four", "never", "closed", "five"]
    assert urlfilter.visible(None) == ""
    pages = frame("page_id long, html string", [(1, html), (2, "<p>One é1Two</p>"), (3, None)])
    got = {r.w: r.n for r in urlfilter.unigrams(pages).collect()}
    assert got == {"one": 2, "two": 2, "three": 1, "a": 1, "b": 1, "four": 1, "never": 1, "closed": 1, "five": 1, "é": 1}


def test_learned_models_of_no_rows_and_clashing_names(frame):
    schema = "doc_id long, text string, lang string"
    assert langid.learn(frame(schema, [])) == {}
    rows = [(i, t, lang) for i in range(60) for t, lang in (("the of and in that", "en"), ("der die und das ist", "de"))]
    plain, wide = langid.learn(frame(schema, rows)), langid.learn(frame(f"{schema}, _lang string, gram string, n string, rank string", [(*r, "x", "x", "x", "x") for r in rows]))
    assert plain == wide and set(plain) == {"de", "en"}
    # an id that comes very often is one text
    often = langid.learn(frame(schema, rows + [(0, "der die und das ist", "en")] * 500))
    assert set(often) == {"de", "en"}


@pytest.mark.parametrize("holder", ["<div class='reader-comments'>", "<ol class='commentlist'>", "<div id='respond'>", "<section class='comment-section'>", "<div class='post-comments-list'>"])
def test_comments_in_an_article_go_by_any_of_their_names(holder):
    close = "</" + holder[1:].split()[0] + ">"
    assert htmltext.main_text(f"<article><p>The text.</p>{holder}<p>Nice one!</p>{close}<p class='has-comments'>More text.</p></article>") == "The text. More text."


def test_a_paragraph_of_two_unmarked_articles_stays(frame):
    rng = random.Random(6)
    words = lambda: " ".join(f"w{rng.randint(0, 9999)}" for _ in range(30))
    shared = words()
    bodies = [[words(), shared], [shared, words()], [words(), words()], [words(), words()]]
    rows = [(i, f"http://small.org/{i}", "<body><div class='note'>We use small files</div><div class='text'>" + "".join(f"<p>{p}</p>" for p in b) + "</div></body>") for i, b in enumerate(bodies)]
    got = {r.page_id: r.text for r in htmltext.extract(frame("page_id long, url string, html string", rows)).collect()}
    assert got == {i: " ".join(b) for i, b in enumerate(bodies)}
