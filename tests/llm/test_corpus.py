"""Packing, WARC packages, substring and Jaccard deduplication, decontamination, pipeline."""

from __future__ import annotations

import io
import random
import re
import zipfile
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.llm import decontam, packing, signatures, substrings, warc
from keelson.llm.common import WORD, Workspace

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def thue_morse(n, a="a", b="b"):
    """Two sequences on which polynomial hashes modulo 2**64 agree."""
    one, two = [a], [b]
    while len(one) < n:
        one, two = one + two, two + one
    return one, two


def words(rng, n, k=40):
    return [f"v{rng.randint(0, k)}" for _ in range(n)]


def corpus(seed=0, n=40):
    """Random texts with copies, near copies, shared passages and odd rows."""
    rng = random.Random(seed)
    docs = [words(rng, rng.randint(0, 160), 5000) for _ in range(n)]
    passage = words(rng, 45, 5000)
    docs += [words(rng, 20, 5000) + passage + words(rng, rng.randint(0, 30), 5000) for _ in range(6)]
    docs += [docs[3], docs[3], docs[4]]
    for _ in range(12):
        near = list(docs[5])
        for _ in range(3):
            if near:
                near[rng.randrange(len(near))] = f"e{rng.random()}"
        docs.append(near)
    docs += [["rep"] * 90, ["x", "y"] * 50, ["only", "three", "words"], []]
    rows = [(i, " ".join(d), "en", "s", 0) for i, d in enumerate(docs)]
    return [*rows, (900, None, None, None, None), (901, " \n\t ", "en", "s", 0), (3, " ".join(docs[3]), "en", "s", 0), (None, " ".join(docs[5]), "en", "s", 0)]


# ---- packing ---------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.public_tokenizer())


def test_ids_are_the_tokenizers(tokenizer):
    rng = random.Random(1)
    texts = ["", "Hello WORLD's 12 don't", "İstanbul ΣΑΣ", "e\u0301 a\xa0b", "<|endoftext|> x", "日本 — a", "—", "' s", "!'s"]
    texts += ["".join(rng.choice("aB'stre vld1 \n!<|>é\tßǄ—") for _ in range(50)) for _ in range(500)]
    own = packing.WordTokenizer(packing.public_tokenizer(), slots=64, room=500)
    for lo in range(0, len(texts), 50):
        part = texts[lo : lo + 50]
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(part)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in part]


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_piece_once(seed):
    rng = random.Random(seed)
    counts = dict(Counter(rng.choice([rng.randint(1, 64), rng.randint(1, 12), 64]) for _ in range(400)))
    patterns = packing.plan(counts, 64)
    used = Counter()
    for times, pattern in patterns:
        assert times > 0 and sum(a * b for a, b in pattern) <= 64
        for length, copies in pattern:
            used[length] += times * copies
    assert used == counts
    total = sum(k * n for k, n in counts.items())
    assert sum(t for t, _ in patterns) <= -(-total // 64) + 2


def test_exact_complements_are_found():
    assert packing.plan({10: 1, 6: 1}, 16) == [(1, [(10, 1), (6, 1)])]
    assert packing.plan({9: 1, 4: 1, 3: 1, 1: 5}, 16)[0] == (1, [(9, 1), (4, 1), (3, 1)])
    assert packing.plan({8: 1, 4: 1, 3: 1, 1: 1, 2: 3}, 16)[0][1][0] == (8, 1)
    assert packing.plan({}, 16) == []


def test_packed_documents(frame, tokenizer):
    rng = random.Random(3)
    rows = [(i, " ".join(words(rng, rng.choice([0, 3, 40, 300]))), "en", "s", 0) for i in range(60)] + [(60, None, None, None, None), (61, "a b c", "en", "s", 0), (61, "a b c", "en", "s", 0), (None, "z", None, None, None)]
    got = packing.pack_documents(frame(DOCS, rows).repartition(3).withColumn("offset", F.lit(1)), capacity=128, with_ids=True).toPandas()
    by_doc = {i: (t or "") for i, t, *_ in rows if i is not None}
    for i, text in by_doc.items():
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
        mine = got[got.doc_id == i].drop_duplicates("piece").sort_values("piece")
        assert [x for raw in mine.ids for x in np.frombuffer(raw, "<u4").tolist()] == ids
        assert list(mine.start) == list(range(0, len(ids), 128))
        assert list(mine.ids_crc32) == [zlib.crc32(raw) for raw in mine.ids]
    assert len(got[got.doc_id == 61]) == 2
    for _, part in got.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert list(part.offset) == [0, *np.cumsum(part.length)[:-1]] and part.length.sum() <= 128
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 128) + 1
    assert packing.pack_documents(frame(DOCS, [])).count() == 0


def test_words_with_equal_polynomials_keep_their_ids(tokenizer):
    own = packing.WordTokenizer(packing.public_tokenizer())
    for n in (1024, 2048):
        for word in map("".join, thue_morse(n)):
            assert own.encode([word, f"x {word}"]) == [own.whole(word), own.whole(f"x {word}")]


# ---- WARC ------------------------------------------------------------------


def test_package_reader_needs_no_extraction():
    out = io.BytesIO()
    rows = [(i, f"http://h/{i}", b"x" * i, "d", None if i % 2 else 7) for i in range(30)]
    assert warc.write_package(out, rows, member_bytes=500) == 30
    package = warc.Package(out, out.tell())
    assert zipfile.ZipFile(out).testzip() is None
    assert {n for n in package.members} == set(zipfile.ZipFile(out).namelist()) and len(package.members) > 2
    begin, size = package.place(warc.INDEX)
    assert package.read(begin, size) == zipfile.ZipFile(out).read(warc.INDEX)


def test_zip64_directory(monkeypatch):
    out = io.BytesIO()
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    with zipfile.ZipFile(out, "w") as z:
        for i in range(3):
            z.writestr(f"m{i}", bytes([65 + i]) * 40)
    package = warc.Package(out, len(out.getvalue()))
    assert warc.END64 in out.getvalue()
    assert [package.read(*package.place(f"m{i}")) for i in range(3)] == [bytes([65 + i]) * 40 for i in range(3)]


def test_round_trip(frame):
    import hashlib

    big, other = "ä" * 600, "b" * 1000
    rows = [(1, "http://a/1", big), (5, "http://a/5\n", big), (3, None, big), (2, "u", "short"), (4, "u", "short"), (6, "u", None), (7, "u", other), (7, "u", other)]
    got = {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(frame("page_id long, url string, html string", rows).withColumn("digest", F.lit(0))).collect()}
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    assert got == {(1, 1200, sha(big), "revisit", 5), (3, 1200, sha(big), "revisit", 5), (5, 1200, sha(big), "response", None), (2, 5, sha("short"), "response", None), (4, 5, sha("short"), "response", None), (6, 0, sha(""), "response", None), (7, 1000, sha(other), "response", None)}
    assert warc.round_trip(frame("page_id long, url string, html string", [])).count() == 0


def test_an_id_of_two_payloads(frame):
    a, b = "a" * 2000, "b" * 5000
    got = {(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(frame("page_id long, url string, html string", [(1, "u", a), (7, "u", a), (7, "u", b)])).collect()}
    assert got == {(1, 2000, "revisit", 7), (7, 2000, "response", None), (7, 5000, "response", None)}


# ---- substrings ------------------------------------------------------------


def brute_substrings(rows, window):
    texts = [WORD.findall(t or "") for _, t, *_ in rows]
    seen = Counter(tuple(w[i : i + window]) for w in texts for i in range(len(w) - window + 1))
    out = []
    for w in texts:
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out)


@pytest.mark.parametrize("block", [substrings.BLOCK, 3])
def test_substrings_against_brute_force(frame, monkeypatch, block):
    monkeypatch.setattr(substrings, "BLOCK", block)
    rows = corpus(block)
    got = substrings.dedup_substrings(frame(DOCS, rows).withColumn("key", F.lit("clash")).repartition(4), window=35).collect()
    assert sorted((r.n_words, r.n_removed, " ".join(WORD.findall(r.text or ""))) for r in got) == brute_substrings(rows, 35)


@pytest.mark.parametrize("n", [1024, 2048])
def test_substrings_of_words_with_equal_polynomials(frame, n):
    around = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join([*around[:20], "".join(x), *around[20:34]]), "en", "s", 0) for i, x in enumerate(thue_morse(n))]
    # the words themselves in that order, all under one minimiser
    rows += [(10 + i, " ".join(x), "en", "s", 0) for i, x in enumerate(thue_morse(n, "p q r s t u v w", "p q r s t u v x"))]
    got = substrings.dedup_substrings(frame(DOCS, rows), window=35).collect()
    assert sorted((r.n_words, r.n_removed, " ".join(WORD.findall(r.text))) for r in got) == brute_substrings(rows, 35)
    assert all(r.n_removed == 0 for r in got if r.doc_id < 10)


def test_a_long_text_in_pieces(frame, monkeypatch):
    monkeypatch.setattr(substrings, "PIECE", 50)
    rows = corpus(2)
    got = substrings.dedup_substrings(frame(DOCS, rows), window=35).collect()
    assert sorted((r.n_words, r.n_removed, " ".join(WORD.findall(r.text or ""))) for r in got) == brute_substrings(rows, 35)


def test_cutting_keeps_the_white_space_around():
    assert substrings.cut_words("a  b\nc d\te", [(1, 3)]) == "a d\te"
    assert substrings.cut_words(" a b c", [(0, 2)]) == "c"
    assert substrings.cut_words("a b c", [(0, 3)]) == ""


# ---- Jaccard ---------------------------------------------------------------


def brute_classes(rows, size, percent):
    sets = []
    for _, text, *_ in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (text or ""))
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in w]
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                up[max(root(i), root(j))] = min(root(i), root(j))
    ids = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            ids[root(i)] = min(d, ids.get(root(i), d))
    return sorted((repr(d), len(sets[i]), repr(ids.get(root(i)))) for i, (d, *_) in enumerate(rows))


@pytest.mark.parametrize(("size", "percent", "rounds", "pair_rows"), [(4, 85, 3, 2048), (5, 80, 1, 4)])
def test_classes_against_brute_force(frame, monkeypatch, size, percent, rounds, pair_rows):
    monkeypatch.setattr(signatures, "ROUNDS", rounds)
    monkeypatch.setattr(signatures, "PAIR_ROWS", pair_rows)
    if rounds == 1:
        # hardly any set takes part in the blocks: the exact rest has to find the links
        monkeypatch.setattr(signatures, "NEAR", 1)
        monkeypatch.setattr(signatures, "SMALL", 2)
    rows = corpus(9, 30)
    got = signatures.similar_classes(frame(DOCS, rows).withColumn("node", F.lit("clash")).repartition(4), size, percent).collect()
    assert sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in got) == brute_classes(rows, size, percent)


def test_missing_ids_hold_links(frame):
    rng = random.Random(3)
    one = words(rng, 200, 5000)
    two = [*one[:-8], *words(rng, 8, 5000)]
    three = [*words(rng, 8, 5000), *two[8:]]
    rows = [(i, " ".join(t), "en", "s", 0) for i, t in ((1, one), (None, two), (3, three), (None, two), (None, words(rng, 50, 5000)))]
    got = {(r.doc_id, r.n_shingles): r.component_id for r in signatures.similar_classes(frame(DOCS, rows), 4, 85).collect()}
    assert got == {(1, 197): 1, (None, 197): 1, (3, 197): 1, (None, 47): None}


@pytest.mark.parametrize("n", [1024, 2048])
def test_sets_of_words_with_equal_polynomials(frame, n):
    rows = [(i, "a b c " + "".join(x), "en", "s", 0) for i, x in enumerate(thue_morse(n))]
    got = signatures.similar_classes(frame(DOCS, rows), 4, 85).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(0, 0), (1, 1)]


@pytest.mark.parametrize("percent", [85, 60])
def test_tree_finds_every_similar_pair(percent):
    rng = np.random.default_rng(percent)
    base = [np.unique(rng.integers(0, 1 << 60, 80).astype(np.uint64)) for _ in range(20)]
    sets = [np.unique(np.concatenate([b[: len(b) - k], rng.integers(0, 1 << 60, k).astype(np.uint64)])) for b in base for k in (0, 1, 4, 9, 20)]
    bits, excess = signatures.bitmaps(sets, 4)
    sizes = np.array([len(s) for s in sets])
    tree = signatures.SignatureTree(sizes, bits, excess, np.arange(len(sets)), fanout=2, leaf=4)
    found = {tuple(sorted((int(a), int(b)))) for i, j in tree.pairs(percent, lambda la, lb, ma, mb: signatures.overlap_needed(la, lb, percent), lambda *_: False) for a, b in zip(i, j, strict=True)}
    want = {(i, j) for j in range(len(sets)) for i in range(j) if 100 * (n := len(np.intersect1d(sets[i], sets[j]))) >= percent * (len(sets[i]) + len(sets[j]) - n)}
    assert want <= found and len(found) < len(sets) * (len(sets) - 1) / 2


def test_no_documents(frame):
    assert signatures.similar_classes(frame(DOCS, [])).count() == 0
    assert substrings.dedup_substrings(frame(DOCS, [])).count() == 0


def test_components(spark, frame):
    from keelson.llm.components import connected_components

    edges = [(i, i + 1) for i in range(1, 30)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.label for r in connected_components(frame("a long, b long", edges), Workspace(spark, "t"), "c").collect()}
    assert got == {**{i: 1 for i in range(1, 31)}, 100: 100, 101: 100, 102: 100}


# ---- decontamination -------------------------------------------------------


def test_lcs_against_dynamic_programming():
    rng = random.Random(0)
    for _ in range(200):
        a, b = words(rng, rng.randint(1, 20), 5), words(rng, rng.randint(0, 30), 5)
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontam.lcs(a, b) == table[-1][-1]


def test_leaks_and_rewordings_are_found(frame):
    rng = random.Random(8)
    items = [(i, " ".join(words(rng, 30, 3000)) + ". " + " ".join(words(rng, 6, 3000)) + ".") for i in range(12)]
    docs, truth = [], set()
    for d in range(60):
        text = words(rng, rng.choice([0, 10, 80, 400]), 3000)
        if d % 3 == 0:
            i, passage = items[d % 12]
            passage = passage.split()
            if d % 2:
                for k in rng.sample(range(len(passage) - 6), 6):
                    passage[k] = f"other{rng.randint(0, 10**9)}"
            at = rng.randint(0, len(text))
            text[at:at] = [w.upper() for w in passage]
            truth.add((d, i))
        docs.append((d, " ".join(text), "en", "s", 0))
    docs += [(70, None, None, None, None), (71, "!?", "en", "s", 0), (None, items[0][1], "en", "s", 0)]
    bench = frame("item_id long, text string", [*items, (50, None), (51, "")])
    out = decontam.find_leaks(frame(DOCS, docs).withColumn("leaks", F.lit(1)), bench)
    got = {(r.doc_id, x.item_id) for r in out.collect() for x in r.leaks}
    assert got == truth | {(None, 0)} and out.count() == len(docs)
    assert decontam.find_leaks(frame(DOCS, docs), frame("item_id long, text string", [])).filter("size(leaks) > 0").count() == 0
    assert decontam.find_leaks(frame(DOCS, []), bench).count() == 0


@pytest.mark.parametrize(("changed", "least"), [(0.1, 1.0), (0.2, 0.97), (0.3, 0.9)])
def test_recall_of_rewordings(frame, monkeypatch, changed, least):
    """Items of 20 to 40 words within longer texts, so many of whose words are others."""
    monkeypatch.setattr(decontam, "TILE", 7)
    rng = random.Random(int(100 * changed))
    items = [(i, " ".join(words(rng, rng.randint(16, 34), 3000)) + ". " + " ".join(words(rng, 6, 3000)) + ".") for i in range(100)]
    docs, truth = [], set()
    for i, passage in items:
        passage = passage.split()
        for k in rng.sample(range(len(passage)), round(changed * len(passage))):
            passage[k] = f"v{rng.randint(0, 3000)}"
        around = words(rng, 200, 3000)
        docs.append((i, " ".join(around[:100] + passage + around[100:]), "en", "s", 0))
        truth.add((i, i))
    docs += [(1000 + i, " ".join(words(rng, 230, 3000)), "en", "s", 0) for i in range(100)]
    got = {(r.doc_id, x.item_id) for r in decontam.find_leaks(frame(DOCS, docs), frame("item_id long, text string", items)).collect() for x in r.leaks}
    assert got <= truth and len(got) >= least * len(truth), len(got) / len(truth)


def test_a_long_text_and_a_hot_id(frame):
    rng = random.Random(3)
    items = [(i, " ".join(words(rng, 25, 3000)) + ".") for i in range(5)]
    long = words(rng, 200_000, 3000)
    long[150_000:150_000] = items[2][1].split()
    # one id of half of all rows
    docs = [(1, " ".join(long), "en", "s", 0)] + [(2, " ".join(words(rng, 40, 3000)), "en", "s", 0) for _ in range(60)] + [(i, " ".join(words(rng, 40, 3000)), "en", "s", 0) for i in range(3, 60)]
    got = [(r.doc_id, x.item_id) for r in decontam.find_leaks(frame(DOCS, docs), frame("item_id long, text string", items)).collect() for x in r.leaks]
    assert got == [(1, 2)]


def test_every_passage_counts_in_the_latent_space(frame, monkeypatch):
    """The SVD's rows hold each text's terms, with the corpus's share of the weight, beyond any number of documents."""
    rng = random.Random(4)
    # 1200 documents, each with a word of the benchmark that no other has
    docs = [(i, " ".join([f"only{i}", *words(rng, 31, 2000)]), "en", "s", 0) for i in range(1200)]
    items = [(i, " ".join(f"only{j}" for j in range(40 * i, 40 * i + 40))) for i in range(30)]
    seen = {}

    def basis(rows, terms, rank, *rest, **more):
        seen["rows"], seen["terms"] = rows.collect(), terms
        return np.eye(terms, rank)

    monkeypatch.setattr(decontam, "randomized_basis", basis)
    for sketch in (16, 2000):
        model = decontam.fit(frame(DOCS, docs), frame("item_id long, text string", items), decontam.Settings(sketch=sketch))
        a = np.zeros((len(seen["rows"]), seen["terms"]))
        for k, r in enumerate(seen["rows"]):
            a[k, r.ids] = r.weights
        corpus = a[np.linalg.norm(a, axis=1) < 7.9]
        assert (corpus != 0).any(0)[[model.vocabulary[f"only{i}"] for i in range(1200)]].all()
        assert len(corpus) == (1200 if sketch == 2000 else 16 * 4)
        # as much as 500 documents of one passage each; signs make it so on average
        assert (corpus**2).sum() == pytest.approx(500, rel=1e-4 if sketch == 2000 else 0.1)


def test_a_benchmark_beyond_the_model_is_an_error(frame, monkeypatch):
    monkeypatch.setattr(decontam, "MODEL_BYTES", 1 << 20)
    with pytest.raises(ValueError, match="split the benchmark"):
        decontam.find_leaks(frame(DOCS, [(1, "a b c", "en", "s", 0)]), frame("item_id long, text string", [(1, "a b c")]))


def test_basis_spans_the_leading_directions(spark, frame):
    rng = np.random.default_rng(2)
    left, right = rng.standard_normal((60, 3)), rng.standard_normal((3, 20))
    dense = left @ right * 5 + 0.01 * rng.standard_normal((60, 20))
    rows = frame("ids array<int>, weights array<double>", [(list(range(20)), r.tolist()) for r in dense])
    basis = decontam.randomized_basis(rows.repartition(3), 20, 3, 4, 2)
    want = np.linalg.svd(dense)[2][:3].T
    assert np.linalg.norm(basis @ basis.T - want @ want.T) < 1e-3


# ---- pipeline --------------------------------------------------------------


def test_pipeline(spark, frame, tmp_path):
    import corpus_pipeline

    rng = random.Random(5)
    passage = words(rng, 70, 9000)
    item = " ".join(words(rng, 30, 9000)) + ". The answer is here now."
    docs, labels = [], []
    for i in range(120):
        text = words(rng, 60, 9000)
        if i % 10 == 1:
            text += ["foulword", "slimehead"]
        labels.append((i, 1, int(i % 10 == 1)))
        docs.append((i, " ".join(text), "en", "s", 1))
    docs += [(200, docs[2][1], "en", "s", 1), (201, docs[2][1] + " tail", "en", "s", 1), (202, " ".join(words(rng, 30, 9000) + passage), "en", "s", 1), (203, " ".join(passage + words(rng, 30, 9000)), "en", "s", 1), (204, " ".join(words(rng, 40, 9000)) + " " + item, "en", "s", 1), (205, None, None, None, None), (2, docs[2][1], "en", "s", 1)]
    frame(DOCS, docs).withColumn("_key", F.concat(F.lit("key "), F.col("doc_id"))).withColumn("_rest", F.lit(7)).withColumn("score", F.lit("s")).write.parquet(str(tmp_path / "documents.parquet"))
    frame("doc_id long, quality int, toxic int", labels).write.parquet(str(tmp_path / "labels.parquet"))
    frame("item_id long, text string", [(1, item)]).write.parquet(str(tmp_path / "benchmark.parquet"))
    read, state = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, read, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        read = spark.read.parquet(str(tmp_path / f"out{k}"))
        state[name] = read
        if name != "packing":
            assert read.columns == [*DOCS.replace(" long", "").replace(" string", "").split(", "), "_key", "_rest", "score"]
            assert all((r._key, r._rest, r.score) == (f"key {r.doc_id}", 7, "s") for r in read.collect())
    ids = {n: Counter(r.doc_id for r in d.select("doc_id").collect()) for n, d in state.items()}
    toxic = {i for i in range(120) if i % 10 == 1}
    everyone = Counter(d[0] for d in docs)
    assert ids["toxicity"] == Counter({i: n for i, n in everyone.items() if i not in toxic})
    assert set(ids["ngram_jaccard"]) == set(everyone) - toxic - {200, 201} and max(ids["ngram_jaccard"].values()) == 1
    cut = {r.doc_id: r.text for r in state["substring_dedup"].collect()}
    assert all(len(cut[i].split()) == 30 for i in (202, 203)) and cut[5] == docs[5][1]
    assert set(ids["ngram_jaccard"]) - set(ids["decontamination"]) == {204}
    assert set(ids["packing"]) == set(ids["decontamination"])
