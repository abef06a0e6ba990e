"""The registered queries on the smallest tables: columns, rows, SQL or brute force."""

from __future__ import annotations

import os
import re
import zlib

import duckdb
import numpy as np
import pytest

from keelson.llm import packing
from keelson.llm.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")

COLUMNS = {
    "op1_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op2_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op3_decontam": "doc_id bigint, item_id bigint, cosine double, lcs double, answer double, word int",
    "op4_substrings": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op5_langid": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op6_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op7_quality": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op8_jaccard": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op9_urls": "page_id bigint, host string, path string, rule string, verdict string",
    "op10_html": "page_id bigint, url string, text string, n_chars bigint",
    "op11_prefix_trie": "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string",
    "op12_phrases": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op13_variants": "word string, n bigint, n_near bigint, form string, form_n bigint, root string",
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def results(spark):
    kept = {}

    def of(name):
        if name not in kept:
            df = QUERIES[name](spark, SF)
            kept[name] = df, df.collect()
        return kept[name]

    return of


def test_all_are_registered():
    assert set(QUERIES) == set(COLUMNS)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(results, duck, name):
    df, rows = results(name)
    assert ", ".join(f"{c} {k}" for c, k in df.dtypes) == COLUMNS[name]
    if name not in ("op2_packing", "op3_decontam", "op11_prefix_trie", "op13_variants"):
        table = "pages" if df.columns[0] == "page_id" else "documents"
        assert sorted(r[0] for r in rows) == sorted(x[0] for x in duck.execute(f"select {df.columns[0]} from {table}").fetchall())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(results, duck, name):
    df, rows = results(name)
    cur = duck.execute(ORACLES[name])
    at = [df.columns.index(c[0]) for c in cur.description]
    assert sorted(repr(tuple(r[i] for i in at)) for r in rows) == sorted(repr(x) for x in cur.fetchall())


@pytest.mark.parametrize(("name", "mod", "held"), [("op1_toxicity", 5, 0), ("op5_langid", 4, 2)])
def test_folds_and_ranges(results, name, mod, held):
    for r in results(name)[1]:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == held)
        assert 0 <= r.score <= 1
        assert name != "op1_toxicity" or r.predicted == int(r.score >= 0.5)


def test_language_of_held_out_texts(results, duck):
    lang = dict(duck.execute("select doc_id, lang from documents").fetchall())
    held = [r for r in results("op5_langid")[1] if r.held_out]
    assert sum(lang[r.doc_id] == r.lang_pred for r in held) >= 0.97 * len(held)


def test_pieces_are_the_tokens(results, duck):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.public_tokenizer())
    text = dict(duck.execute("select doc_id, text from documents").fetchall())
    rows, total = results("op2_packing")[1], 0
    by_doc: dict[int, list] = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        total += r.length
    assert set(by_doc) == set(text)
    for d, pieces in by_doc.items():
        ids = np.array([*t.encode(text[d] or "", add_special_tokens=False).ids, 1], "<u4")
        want = [(i, 4096 * i, len(x), zlib.crc32(x.tobytes())) for i, x in enumerate(ids[k : k + 4096] for k in range(0, len(ids), 4096))]
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in sorted(pieces, key=lambda r: r.piece)] == want
    assert len({r.sequence_id for r in rows}) == -(-total // 4096)


def test_rules_of_urls(results, duck):
    rules = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
    got = {r.page_id: r for r in results("op9_urls")[1]}
    for page, url in duck.execute("select page_id, url from pages").fetchall():
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [(len(r), r, v) for v, r in rules for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        r = got[page]
        assert (r.host, r.path, r.rule) == (host, path, max(fits)[1] if fits else None)
        assert r.verdict == max(fits)[2] if fits else r.verdict in ("allow", "block")


def test_leaks_hold_the_items(results, duck):
    from keelson.llm.decontam import split_words

    text = dict(duck.execute("select doc_id, text from documents").fetchall())
    items = dict(duck.execute("select item_id, text from benchmark").fetchall())
    got = {(r.doc_id, r.item_id) for r in results("op3_decontam")[1]}
    flat = {d: f" {' '.join(split_words(t))} " for d, t in text.items()}
    verbatim = {(d, i) for i, t in items.items() for d, f in flat.items() if f" {' '.join(split_words(t))} " in f}
    assert verbatim and verbatim <= got


def test_articles_of_pages(results, duck):
    import html

    got = {r.page_id: r.text for r in results("op10_html")[1]}
    for page, source in duck.execute("select page_id, html from pages").fetchall():
        m = re.search(r"<article>(.*?)(</article>|\Z)", source, re.S)
        body = re.sub(r"</?(p|h1|br)\b[^>]*>", " ", re.sub(r"<!--.*?-->", "", m[1], flags=re.S))
        assert got[page] == " ".join(html.unescape(re.sub(r"<[/a-zA-Z][^>]*>", "", body)).split())
