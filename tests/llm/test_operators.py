"""Each operator on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import math
import random
import re
import sys
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from tessera.llm import brown, bytesuffix, components, exact, html, jaccard, kernels, linkage, mixing, quality, repeats, tables, tokencount, wordrepeats  # noqa: E402
from tessera.llm import bpe as B  # noqa: E402

DDL = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names operators use themselves.
CLASH = ["key", "grp", "bucket", "node", "root", "kept", "n", "size", "rank", "chunks", "recipe", "pattern", "copies", "token", "prefix", "_key"]


def frame(spark, rows):
    """(doc_id, text, source) rows as documents, with extra columns whose names clash with inner ones."""
    df = spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DDL)
    return df.withColumns({c: F.lit("x") for c in CLASH}).repartition(3)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(1, 7))) for _ in range(400)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage, base = text(60), text(300)
    out = [(i, text(r.randint(20, 200)), f"s{i % 4}") for i in range(30)]
    out += [(100 + i, text(30) + " " + passage + " " + text(30), "hot") for i in range(12)]
    for i in range(12):  # near copies
        w = base.split()
        for _ in range(i % 5):
            w[r.randrange(len(w))] = "x" + str(r.random())
        out.append((200 + i, " ".join(w), "hot"))
    out += [(300 + i, "Same  Text\n" * 30 + " " * i, "hot") for i in range(5)]
    out += [(400, None, None), (401, "", "s1"), (402, " \t\n", None), (403, "one", "s2"), (404, "one two", "s2"), (405, "One TWO", "s2"), (406, "ünï cödé 中文字 🎉 " * 40, "s3"), (407, text(4000), "s0"), (408, "the " * 900, "s0"), (409, "a\0b " * 120, "s0")]
    out += [(None, text(50), "s0"), (500, passage, "hot"), (500, passage, "hot"), (501, base + " " + base, "s1")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows)


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def pairs(rows):
    return [(i, t) for i, t, _ in rows]


def key(row):
    return tuple((x is not None, x) for x in row)


def collected(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=key)


def test_exact(docs, rows, none):
    columns = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert collected(exact.exact_dedup(docs), *columns) == sorted(brute.exact(pairs(rows)), key=key)
    assert exact.exact_dedup(none).count() == 0


def test_exact_colliding_identifiers(docs, rows):
    """Identifiers that name different chunks alike are found and given up."""
    weak = lambda c: F.length(c)
    columns = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    for candidates in ((weak, exact.short_id), (weak,)):
        assert collected(exact.exact_dedup(docs, candidates=candidates), *columns) == sorted(brute.exact(pairs(rows)), key=key)


def test_exact_chunks_follow_content(spark):
    r = random.Random(1)
    text = "".join(r.choice("abcdef,. ") for _ in range(20_000)).replace(" ", "")
    df = spark.createDataFrame([(text,), ("zz" + text,), ("",)], "t string").select(exact.chunks(F.col("t")).alias("c"))
    a, b, e = (r[0] for r in df.collect())
    assert "".join(a) == text and "".join(b) == "zz" + text and e == [] and len(set(a) & set(b)) > len(a) // 2


def test_drop_copies(docs, rows):
    kept = exact.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r[0] is not None, r[0]) for r in kept.select("doc_id").collect()) == sorted((x[0] is not None, x[0]) for x in brute.exact(pairs(rows)) if x[3])


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80), (2, 50)])
def test_jaccard(docs, rows, width, percent):
    assert collected(jaccard.near_duplicates(docs, width=width, percent=percent), "doc_id", "n_shingles", "component_id") == sorted(brute.jaccard(pairs(rows), width, percent), key=key)


def test_jaccard_in_chunks(docs, rows, none, monkeypatch):
    monkeypatch.setattr(jaccard, "SOME", 2)
    monkeypatch.setattr(jaccard, "CHUNK", 3)
    monkeypatch.setattr(jaccard, "WEIGHT", 4000)
    monkeypatch.setattr(jaccard, "POSTINGS", 100)
    assert collected(jaccard.near_duplicates(docs, width=3, percent=80), "doc_id", "n_shingles", "component_id") == sorted(brute.jaccard(pairs(rows), 3, 80), key=key)
    assert jaccard.near_duplicates(none).count() == 0
    kept = jaccard.drop_near_copies(docs, width=5, percent=80)
    assert kept.columns == docs.columns
    ids = sorted(r[0] for r in kept.select("doc_id").collect() if r[0] is not None)
    assert ids == sorted({i for i, _, c in brute.jaccard(pairs(rows), 5, 80) if i is not None and i == c})  # one row of those that repeat


def test_forest_by_pivots():
    """All parts of a graph are joined, however its nodes are cut into parts and chunks."""
    import numpy as np

    r = random.Random(4)
    for _ in range(200):
        k = r.randint(1, 12)
        near = [[r.random() < 0.15 for _ in range(k)] for _ in range(k)]
        near = [[near[min(a, b)][max(a, b)] for b in range(k)] for a in range(k)]
        part = np.array([r.randrange(3) if r.random() < 0.3 else 10 + x for x in range(k)])
        ask = part != np.unique(part)[np.unique(part, return_inverse=True)[1].max()]
        for given, asked in ((None, None), (part, np.ones(k, bool)), (part, ask)):
            edges = linkage.forest_by_pivots(k, lambda x, others, near=near: np.array([y for y in others if near[x][y]], dtype=np.int64), given, asked)
            forest, want = components.Forest(), components.Forest()
            for f, pairs_ in ((forest, edges), (want, [(a, b) for a in range(k) for b in range(k) if near[a][b] and (asked is None or asked[a] or asked[b])])):
                for x in range(k):
                    if given is not None:
                        f.union(x, 100 + int(given[x]))
                for a, b in pairs_:
                    f.union(a, b)
            assert [forest.find(x) == forest.find(y) for x in range(k) for y in range(k)] == [want.find(x) == want.find(y) for x in range(k) for y in range(k)]


def linking(both):
    def verify(table):
        node, grp, part, ask = (table.column(c).to_pylist() for c in ("item", "grp", "part", "ask"))
        found = [(a, b) for a, p, k, g in zip(node, part, ask, grp, strict=True) for b, q, h in zip(node, part, grp, strict=True) if k and p != q and g == h and (a, b) in both]
        return pa.table({"a": [a for a, _ in found], "b": [b for _, b in found]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return verify


def test_linked_group_in_chunks(spark):
    """A large group of chains and stars, cut into many chunks: every link that joins two parts is found."""
    r = random.Random(8)
    for kind in ("star", "chain", "none"):
        links = {"star": [(50, x) for x in range(200) if x != 50 and x % 7], "chain": [(x, x + 1) for x in range(199) if x % 50], "none": []}[kind]
        both = {(a, b) for a, b in links} | {(b, a) for a, b in links}

        items = spark.createDataFrame([(1, x, 1) for x in r.sample(range(200), 200)] + [(2, 1000, 1), (2, 1001, 1)], "grp long, item long, weight long")
        got = dict(tuple(x) for x in linkage.linked(items, 12, lambda blocks, both=both: blocks.groupBy("block").applyInArrow(linking(both), "a long, b long")).collect())
        forest = components.Forest()
        for a, b in links:
            forest.union(a, b)
        assert got == {x: forest.find(x) for x in forest.up if forest.find(x) != x}


@pytest.mark.parametrize("few", [200_000, 0])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW_EDGES", few)
    r = random.Random(5)
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, x) for x in range(200, 260)] + [(r.randrange(300, 400), r.randrange(300, 400)) for _ in range(70)] + [(9, 9)]
    got = dict(tuple(x) for x in components.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect())
    forest = components.Forest()
    for a, b in edges:
        forest.union(a, b)
    assert got == {x: forest.find(x) for x in forest.up if forest.find(x) != x}


@pytest.mark.parametrize("many", [repeats.MANY, 1200])
def test_byte_repeats(docs, rows, none, monkeypatch, many):
    monkeypatch.setattr(repeats, "MANY", many)
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    for length in (400, 60):
        assert collected(bytesuffix.drop_repeated_bytes(docs, length=length), *columns) == sorted(brute.byte_repeats(pairs(rows), length), key=key)
    assert bytesuffix.drop_repeated_bytes(none).count() == 0


def test_suffix_order():
    import numpy as np

    r = random.Random(2)
    texts = ["".join(r.choice("ab") for _ in range(r.randint(1, 40))).encode() for _ in range(300)] + [b"a" * 40] * 3 + [b"a\0", b"a", b"a\0\0"]
    body = np.zeros((len(texts), 40), np.uint8)
    for i, t in enumerate(texts):
        body[i, : len(t)] = np.frombuffer(t, np.uint8)
    rows, common = bytesuffix.suffix_order(texts, body.view(">u8").astype(np.uint64), 40)
    assert [texts[x] for x in rows] == sorted(texts)
    for a, b, n in zip(rows[:-1], rows[1:], common[1:], strict=True):
        same = next((k for k in range(min(len(texts[a]), len(texts[b]))) if texts[a][k] != texts[b][k]), min(len(texts[a]), len(texts[b])))
        assert n == same


@pytest.mark.parametrize("many", [repeats.MANY, 300])
def test_word_repeats(docs, rows, none, monkeypatch, many):
    monkeypatch.setattr(repeats, "MANY", many)
    monkeypatch.setattr(wordrepeats, "ROOM", 8)
    columns = ("doc_id", "n_words", "n_removed", "kept_sha256")
    for length in (13, 4):
        assert collected(wordrepeats.drop_repeated_words(docs, length=length), *columns) == sorted(brute.word_repeats(pairs(rows), length), key=key)
    assert wordrepeats.drop_repeated_words(none).count() == 0


def test_quality(docs, rows, none):
    got = quality.quality_filter(docs)
    expected = [(i, *brute.quality_counts(t)) for i, t in pairs(rows)]
    assert collected(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") == sorted(expected, key=key)
    for r in got.collect():
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality.quality_filter(none).count() == 0
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == got.filter("kept").count()


def test_quality_finds_labelled_junk(spark):
    folder = "/root/testdata/sf0.1"
    got = quality.quality_filter(spark.read.parquet(f"{folder}/documents.parquet")).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    n = {(r.quality, r.kept): r["count"] for r in got.filter("not base_failed").groupBy("quality", "kept").count().collect()}
    assert n.get((1, True), 0) > 0.98 * (n.get((1, True), 0) + n.get((1, False), 0))
    assert n.get((0, False), 0) > 0.9 * (n.get((0, True), 0) + n.get((0, False), 0))


def test_stages_decide_by_row(spark):
    """Rows that share an id, or have none, stay or go each by their own text."""
    r = random.Random(5)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(3, 7))) for _ in range(300)]
    prose = lambda: " ".join(r.choice(words) for _ in range(60))
    clean, other, lone, junk = prose(), prose(), prose(), "one two"
    base = [(i, prose(), "a") for i in range(20)]
    texts = lambda df: sorted((x[0] is not None, x[0] or 0, x[1]) for x in df.select("doc_id", "text").collect() if x[0] is None or x[0] >= 100)
    got = quality.keep_good(frame(spark, [*base, (None, clean, "a"), (None, junk, "a"), (100, other, "a"), (100, junk, "a")]))
    assert texts(got) == [(False, 0, clean), (True, 100, other)]
    got = jaccard.drop_near_copies(frame(spark, [*base, (100, clean, "a"), (101, clean + " x", "a"), (101, other, "a"), (None, clean + " y", "a"), (None, lone, "a"), (102, prose(), "a"), (100, clean, "a")]))
    assert [t[:2] for t in texts(got)] == [(False, 0), (True, 100), (True, 101), (True, 102)] and {t[2] for t in texts(got)} >= {clean, other, lone}


def test_take_by_row(spark):
    """Rows without id of all sources are taken as often as their source needs."""
    rows = [(None, f"w{i} a b c", "big" if i % 5 else "small") for i in range(400)]
    docs = frame(spark, rows)
    want = {r.source: r.n for r in mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    got = {r.source: 4 * r["count"] for r in mixing.take(docs).groupBy("source").count().collect()}
    assert got == want and len(want) == 2


def test_label_model_recovers_accuracies():
    import numpy as np

    rng = np.random.default_rng(4)
    truth = rng.random(20_000) < 0.8
    rates = [(0.7, 0.01), (0.5, 0.005), (0.9, 0.015), (0.6, 0.01)]  # bad votes on bad and on good texts
    votes = np.stack([np.where(rng.random(len(truth)) < np.where(truth, b, a), 0, 1) for a, b in rates], axis=1)
    votes[rng.random(votes.shape) < 0.2] = 2
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.fit(patterns, counts.astype(float))
    assert abs(model.good - 0.8) < 0.05
    assert np.abs(model.table[0, :, 0] - [a for a, _ in rates]).max() < 0.12  # pseudo-counts pull towards the prior


def test_mix(spark, docs, rows, none):
    got = mixing.mix(docs)
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len(brute.words(t))
    want = brute.targets(size)
    taken, largest = {}, {}
    for r in got.collect():
        assert math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-9) and r.source_size == size[r.source]
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
        largest[r.source] = max(largest.get(r.source, 0), r["size"])
    for s in want:
        assert abs(taken[s] - want[s]) <= largest[s]
    again = mixing.mix(docs.repartition(7))
    assert collected(got, "doc_id", "size", "taken") == collected(again, "doc_id", "size", "taken")
    assert mixing.mix(none).count() == 0
    many = mixing.take(docs)
    assert many.columns == docs.columns


def test_mix_probabilities(spark):
    """Unequal probabilities: documents of twice the importance are taken about twice as often."""
    df = spark.range(40_000).selectExpr("id as doc_id", "'a b c d' as text", "if(id < 36000, 'a', 'b') as source", "if(id % 2 = 0, 2.0, 1.0) as w")
    got = mixing.mix(df, weights=(1.0, 1.0), share=0.2, importance=F.col("w")).filter("source = 'a'").groupBy((F.col("doc_id") % 2).alias("odd")).agg(F.sum("copies").alias("n")).collect()
    n = {r.odd: r.n for r in got}
    assert 1.8 < n[0] / n[1] < 2.2


def test_bpe(docs, rows, none):
    import hashlib

    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(B.byte_level_path())
    expected = []
    for i, t in pairs(rows):
        ids = reference.encode(t or "", add_special_tokens=False).ids
        expected.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(reference.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert collected(B.encode(docs), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(expected, key=key)
    assert B.encode(none).count() == 0


ALPHABET = [*"ab' \n\t\r\x0b\x0c\x85\xa0 　é中½ⅷ١🎉<|>0123.,!?_S", "<|endoftext|>", "'s", "'re", "'ll", " '", "''", "aaaa", "   ", "the", "ing", "ing "]


def fuzz(seed, n, size):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, size))) for _ in range(n)]


@pytest.mark.parametrize("limit", [B.CACHE, 5])
def test_bpe_against_library(limit):
    import pyarrow as pa
    from tokenizers import Tokenizer

    from tessera.llm import kernels as K

    texts = [*fuzz(1, 2000, 60), "", "a" * 3000, "'", "'s", "x'llama", "<|endoftext|>" * 3]
    reference, encoder = Tokenizer.from_file(B.byte_level_path()), B.Encoder(B.Vocabulary(B.byte_level_path()), limit)
    data, off = K.text_arrays(pa.array(texts))
    ids, at, back = encoder.checked(data, off)
    for i, e in enumerate(reference.encode_batch(texts, add_special_tokens=False)):
        assert ids[at[i] : at[i + 1]].tolist() == e.ids
    assert back.tobytes() == data.tobytes()


def test_token_counts_against_library(docs, rows, none):
    import pyarrow as pa
    from tokenizers import Tokenizer, models, pre_tokenizers

    from tessera.llm import kernels as K

    def reference(pieces, fallback):
        t = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=fallback))
        t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
        return t

    toy = [("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("aa", -2.0), ("aaa", -3.0), ("t", -2.5), ("he", -1.5), ("the", -4.0), ("▁a", -2.0)]
    full = tokencount.load_pieces(tokencount.piece_path())
    for pieces, fallback in ((toy, False), (full, True)):
        for long in (tokencount.LONG, 3):
            tokencount.LONG, held = long, tokencount.LONG
            texts = [*fuzz(7, 800, 40), "", " ", "▁", "a▁ b", "ab" * 500]
            data, off = K.text_arrays(pa.array(texts))
            got = tokencount.Counter(tokencount.Unigram(pieces, fallback), 300).documents(data, off)
            tokencount.LONG = held
            assert got.tolist() == [len(e.ids) for e in reference(pieces, fallback).encode_batch(texts, add_special_tokens=False)]
    library = reference(full, True)
    expected = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in pairs(rows)]
    assert collected(tokencount.token_counts(docs), "doc_id", "n_bytes", "n_tokens") == sorted(expected, key=key)
    assert tokencount.token_counts(none).count() == 0


def test_scores(docs, rows, none):
    got = sorted((tuple(r) for r in brown.score(docs).collect()), key=key)
    expected = sorted(brute.unigram(pairs(rows)), key=key)
    for a, b in zip(got, expected, strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9, abs_tol=1e-9) and a[6] < 0
    assert brown.score(none).count() == 0


def test_scores_beat_unigrams(spark):
    got = brown.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_every_word_is_exchanged(spark):
    """Rare words with one ending, so of one unit at the start, part by their neighbours."""
    import numpy as np

    near = {k: [f"{a}ing" for a in names.split()] for k, names in (("x", "ab cd ef gh ij kl mn op"), ("y", "qr st uv wx yz ba dc fe"))}
    docs = [f"{k}{k} {w} {k}z" for k, names in near.items() for w in names for _ in range(3)] + [f"{k}{k} {k}m {k}z" for k in near for _ in range(4000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string")
    model, vocabulary = brown.learn(df, 4, classes=8)
    own = {}
    for r in vocabulary.collect():
        own.update(zip(np.frombuffer(r["a"], np.uint64).tolist(), np.frombuffer(r["c"], np.int32).tolist(), strict=True))
    data, off = kernels.text_arrays(pa.array([" ".join(near["x"] + near["y"])]))
    word, shape, _ = brown.tokens(data, off)
    assert len(set(model.units.of(word, shape)[:-1].tolist())) == 1
    x, y = ([own[w] for w in half if w in own] for half in (word[:8].tolist(), word[8:16].tolist()))
    assert x and y and not set(x) & set(y)


def test_sweep_raises_likelihood():
    """The gain of one word's move is the change of the likelihood, counted anew."""
    import numpy as np

    rng = np.random.default_rng(1)
    text, own = rng.integers(0, 40, 3000), rng.integers(0, 4, 40)
    p, q = np.roll(text, 1), text

    def likelihood(own):
        t = np.zeros((4, 4))
        np.add.at(t, (own[p], own[q]), 1)
        return brown.xlogx(t).sum() - brown.xlogx(t.sum(axis=0)).sum() - brown.xlogx(t.sum(axis=1)).sum(), t

    word = 7
    at = np.concatenate([np.full((p == word).sum(), 0), np.full((q == word).sum(), 0), np.full(((p == word) & (q == word)).sum(), 0)])
    code = np.concatenate([own[q[p == word]], 4 + own[p[q == word]], np.full(((p == word) & (q == word)).sum(), 8)])
    got = brown.sweep(at, code, np.ones(len(at)), own[[word]], likelihood(own)[1])
    tried = [likelihood(np.where(np.arange(40) == word, c, own))[0] for c in range(4)]
    assert got[0] == int(np.argmax(tried))


def test_exchange_finds_classes():
    import numpy as np

    rng = np.random.default_rng(0)
    kind = np.arange(60) % 3  # words of kind k are followed by words of kind k + 1
    pairs = np.zeros((60, 60))
    a = rng.integers(0, 60, 40_000)
    b = rng.integers(0, 20, 40_000) * 3 + (kind[a] + 1) % 3
    np.add.at(pairs, (a, b), 1)
    own = brown.exchange(pairs, classes=3)
    assert len({(k, c) for k, c in zip(kind.tolist(), own.tolist(), strict=True)}) == 3


PAGES = {
    "<html><body><nav><a href=x>m</a></nav><article><h1>T &amp; U</h1><p>one   two<p>three <b>four</b>.</article><footer>f</footer></body></html>": "T & U one two three four.",
    "": "", "plain &lt;text": "plain <text", "<p>a<p>b": "a b", "<article>x<script>no</script><style>no</style><!-- no -->y</article>": "xy",
    "<article><p>body text</p><div class='comments'><p>a comment that is long enough to be dense</p></div></article>": "body text",
    "<div id=content><p>Long enough text of the page itself, in one block.</p></div><div class=sidebar>side</div><form>f <input></form>": "Long enough text of the page itself, in one block.",
    "<article><p>&eacute;&#233;&#xe9;&nbsp;z</p></article>": "ééé z",
}


def test_html(spark):
    cases = [*PAGES.items(), (None, "")]
    df = spark.createDataFrame([(i, f"u{i}", h, "x") for i, (h, _) in enumerate(cases)], "page_id long, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in html.extract(df).collect()}
    assert got == {i: (t, len(t)) for i, (_, t) in enumerate(cases)}
    assert html.extract(df.limit(0)).count() == 0


def test_html_article_in_sibling_containers():
    part = lambda w, n: "".join(f"<p>{w}{k} words of a sentence that goes on for as long as a paragraph does.</p>" for k in range(n))
    said = lambda w, n: [f"{w}{k} words of a sentence that goes on for as long as a paragraph does." for k in range(n)]
    nav = "<ul>" + "".join(f"<li><a href=x{k}>link {k}</a></li>" for k in range(5)) + "</ul>"
    page = f"<html><body>{nav}<div class=lead>{part('a', 3)}</div><div class=rest>{part('b', 5)}</div></body></html>"
    assert html.main_text(page) == " ".join(said("a", 3) + said("b", 5))
    low = f"<html><body><div class=one>{part('a', 5)}</div><div class=two>{'<i>x</i> ' * 40}</div></body></html>"
    assert html.main_text(low) == " ".join(said("a", 5))  # below the threshold


def test_html_pages(spark, sf):
    import html as entities

    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        body = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        parts = re.sub(r"<[^>]+>", "", re.sub(r"</?(p|br|h1)>", "\0", body)).split("\0")
        assert html.main_text(r.html) == " ".join(" ".join(entities.unescape(p).split()) for p in parts if p.strip())


def test_html_survives_anything():
    r = random.Random(9)
    bits = ["<div>", "</div>", "<p>", "</p>", "<", ">", "text ", "<a href='", "'>", "</a>", "<table><tr><td>", "<!--", "-->", "<script>", "</script>", "&amp;", "&#x110000;", "<article>", "</article>", "<li>", "\0"]
    for _ in range(500):
        html.main_text("".join(r.choice(bits) for _ in range(r.randint(0, 60))))


def thue_morse(a, b, n):
    """Two complementary strings of which no polynomial hash modulo 2**64 tells one from the other, from 1,024 letters on."""
    x, y = a, b
    while len(x) < n:
        x, y = x + y, y + x
    return x, y


@pytest.mark.parametrize("size", [1024, 4096])
def test_texts_that_fool_polynomials(spark, size):
    """Words, lines and documents that differ only as Thue-Morse strings do are different everywhere."""
    from tokenizers import Tokenizer

    x, y = thue_morse("a", "b", size)
    filler = " ".join(f"w{i}" for i in range(12))
    given = [(1, x, "s"), (2, y, "s"), (3, f" {x} {y}", "s"), (4, f"{x}\n{y}", "s"), (7, f"{filler} {x}", "s"), (8, f"{filler} {y}", "s"), (9, x, "s"), (10, f"{filler} {x}", "s")]
    docs, plain = frame(spark, given), [(i, t) for i, t, _ in given]
    for width in (1, 3):
        assert collected(jaccard.near_duplicates(docs, width=width, percent=90), "doc_id", "n_shingles", "component_id") == sorted(brute.jaccard(plain, width, 90), key=key)
    got = quality.quality_filter(docs)
    assert collected(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") == sorted((i, *brute.quality_counts(t)) for i, t in plain)
    library = Tokenizer.from_file(B.byte_level_path())
    assert {r.doc_id: r.ids for r in B.encode(docs).collect()} == {i: library.encode(t, add_special_tokens=False).ids for i, t in plain}
    alone = {i: tokencount.token_counts(docs.filter(F.col("doc_id") == i)).first().n_tokens for i, _ in plain}
    assert {r.doc_id: r.n_tokens for r in tokencount.token_counts(docs).collect()} == alone
    for a, b in zip(sorted(tuple(r) for r in brown.score(docs).collect()), sorted(brute.unigram(plain)), strict=True):
        assert a[:5] == b[:5]
    assert collected(wordrepeats.drop_repeated_words(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.word_repeats(plain, 13))
    assert collected(bytesuffix.drop_repeated_bytes(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute.byte_repeats(plain, 400))


def colliding_words(n):
    """Pairs of words of 16 signs that share a hash if eight bytes are only mixed into a state by exclusive or."""
    import numpy as np

    signs = np.array([c for c in range(33, 127) if not 65 <= c < 91], np.uint8)
    x, y, tail = (np.random.default_rng(k).choice(signs, (1_000_000, 8)) for k in range(3))
    start = kernels.mix(np.array([16], np.uint64) * kernels.BASE)
    a, b, t = (np.ascontiguousarray(w).view("<u8").ravel() for w in (x, y, tail))
    other = (t ^ kernels.mix(start ^ a) ^ kernels.mix(start ^ b)).view(np.uint8).reshape(-1, 8)
    able = np.flatnonzero(np.isin(other, signs).all(axis=1))[:n]
    return [tuple(bytes(w).decode() for w in (np.append(x[i], tail[i]), np.append(y[i], other[i]))) for i in able]


def test_words_that_fool_an_invertible_hash(spark):
    """Words worked out backwards from a common state are different words everywhere."""
    found = colliding_words(2)
    for x, y in found:
        data, off = kernels.text_arrays(pa.array([x, y]))
        a, b = kernels.span_hash(data, off[:-1], off[1:]).tolist()
        assert len(x) == len(y) == 16 and x != y and a != b
    (x, y), (v, w) = found
    filler = " ".join(f"w{i}" for i in range(12))
    given = [(7, f"{filler} {x}", "s"), (8, f"{filler} {y}", "s"), (9, f"{v} a b {w} a b {v} a b", "s"), (10, x, "s"), (11, y, "s"), (12, f"{filler} {x}", "s")]
    docs, plain = frame(spark, given), [(i, t) for i, t, _ in given]
    for width in (1, 3, 5):
        assert collected(jaccard.near_duplicates(docs, width=width, percent=90), "doc_id", "n_shingles", "component_id") == sorted(brute.jaccard(plain, width, 90), key=key)
    for a, b in zip(sorted(tuple(r) for r in brown.score(docs).collect()), sorted(brute.unigram(plain)), strict=True):
        assert a[:5] == b[:5]
    assert collected(wordrepeats.drop_repeated_words(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.word_repeats(plain, 13))


def weak(data, starts, ends, seed=0):
    """A byte hash that collides all the time."""
    return kernels.mix((ends - starts).astype("uint64") + kernels.BASE)


def test_colliding_hashes(rows, monkeypatch):
    """Where bytes decide, a hash that collides changes nothing."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(kernels, "span_hash", weak)
    texts = [t or "" for _, t, _ in rows] + fuzz(3, 200, 50)
    data, off = kernels.text_arrays(pa.array(texts))
    assert [tuple(int(x) for x in r) for r in zip(*quality.count_slice(data, off)[:5], strict=True)] == [brute.quality_counts(t) for t in texts]
    ids, at, back = B.Encoder(B.load(B.byte_level_path())).checked(data, off)
    for i, e in enumerate(Tokenizer.from_file(B.byte_level_path()).encode_batch(texts, add_special_tokens=False)):
        assert ids[at[i] : at[i + 1]].tolist() == e.ids
    model = tokencount.load_model(tokencount.piece_path())
    counter = tokencount.Counter(model, 50)
    got = [counter.documents(*kernels.text_arrays(pa.array([t])))[0] for t in texts for _ in range(2)]
    monkeypatch.undo()
    assert got[::2] == got[1::2] == tokencount.Counter(model).documents(data, off).tolist()


def test_exact_ids():
    import numpy as np

    r = random.Random(6)
    parts = ["".join(r.choice("ab") for _ in range(r.choice([0, 1, 3, 8, 9, 64, 65, 200]))) for _ in range(400)] + list(thue_morse("a", "b", 1024)) * 2
    data, off = kernels.text_arrays(pa.array(parts))
    ids, first = kernels.exact_ids(data, off[:-1], off[1:])
    assert [[a == b for b in ids.tolist()] for a in ids.tolist()] == [[a == b for b in parts] for a in parts]
    assert all(parts[first[i]] == t for i, t in zip(ids.tolist(), parts, strict=True))
    assert len(np.unique(kernels.span_hash(data, off[:-1], off[1:]))) == len(set(parts))


def test_very_long_texts(spark, monkeypatch):
    """Texts of several megabytes, longer than a slice and than a piece."""
    from tokenizers import Tokenizer

    r = random.Random(11)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(1, 7))) for _ in range(3000)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    long_ = text(500_000)
    given = [(1, long_, "a"), (2, text(300) + " " + long_[:30_000] + " " + text(300), "a"), (3, "x" * 2_500_000, "b"), (4, text(50), "b")]
    docs, plain = frame(spark, given), [(i, t) for i, t, _ in given]
    assert sum(len(t) > kernels.SLICE_BYTES for _, t in plain) == 2
    library = Tokenizer.from_file(B.byte_level_path())
    want = {i: library.encode(t, add_special_tokens=False).ids for i, t in plain}
    assert {r.doc_id: r.ids for r in B.encode(docs).collect()} == want
    pieces = list(B.long_pieces((long_ + "<|endoftext|>" * 9).encode(), [b"<|endoftext|>"], 100_000))
    assert len(pieces) > 10 and [x for p in pieces for x in library.encode(p.decode(), add_special_tokens=False).ids] == library.encode(long_ + "<|endoftext|>" * 9, add_special_tokens=False).ids
    assert collected(wordrepeats.drop_repeated_words(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.word_repeats(plain, 13))
    assert collected(bytesuffix.drop_repeated_bytes(docs, length=300), "doc_id", "n_bytes", "n_removed") == [(1, len(long_), 30_000), (2, len(given[1][1]), 30_000), (3, 2_500_000, 2_500_000), (4, len(given[3][1]), 0)]
    assert collected(quality.quality_filter(docs), "doc_id", "n_words") == sorted((i, len(brute.words(t))) for i, t in plain)
    assert [x[:5] for x in sorted(tuple(r) for r in brown.score(docs).collect())] == [x[:5] for x in sorted(brute.unigram(plain))]
    assert collected(jaccard.near_duplicates(docs, width=3, percent=90), "doc_id", "component_id") == [(i, i) for i, _ in plain]
    assert collected(exact.exact_dedup(docs), "doc_id", "keep_id") == [(i, i) for i, _ in plain]


def test_score_of_every_text(spark, docs, rows):
    """The model's probability, token by token, from its classes and counts."""
    import numpy as np

    plain = pairs(rows)
    base = tables.groups_of(docs, n := tables.group_count(docs), "doc_id", "text").select("doc_id", "text")
    model, vocabulary = brown.learn(base, n)
    own, count = {}, {}
    for r in vocabulary.collect():
        words = np.frombuffer(r["a"], np.uint64).tolist()
        own.update(zip(words, np.frombuffer(r["c"], np.int32).tolist(), strict=True))
        count.update(zip(words, np.frombuffer(r["b"], np.int64).tolist(), strict=True))
    texts = {}
    for i, t in plain:
        word, shape, _ = brown.tokens(*kernels.text_arrays(pa.array([t or ""])))
        texts.setdefault(i, []).append([(count.get(w, 0), own.get(w, int(model.own[model.units.of(np.array([w], np.uint64), np.array([s]))[0]]))) for w, s in zip(word.tolist(), shape.tolist(), strict=True)])
    end = texts[401][0][0][1]
    step = np.ones((brown.CLASSES, brown.CLASSES))
    held = {i: h for i, h, *_ in brute.unigram(plain)}
    for i, found in texts.items():
        for text in found if not held[i] else ():
            for a, b in zip([end, *(c for _, c in text)], (c for _, c in text), strict=False):
                step[a, b] += 1
    space = np.ones(brown.CLASSES)
    for w, c in own.items():
        space[c] += count[w] + 1
    step /= step.sum(axis=1, keepdims=True)
    want = sorted(sum(math.log10(step[a, b] * (n + 1) / space[b]) for a, (n, b) in zip([end, *(c for _, c in text)], text, strict=False)) for found in texts.values() for text in found)
    got = sorted(r.score for r in brown.score(docs).collect())
    assert np.allclose(got, want, rtol=1e-9)


def test_mix_fills_what_long_documents_leave(spark):
    """A long document is passed over where it does not fit, and those behind it fill the gap."""
    for seed in range(6):
        rows = [(1, "w " * 6000, "a"), *((10 + i, "w " * 100, "a") for i in range(30)), *((100 + i, "w " * 50, "b") for i in range(400))]
        got = mixing.mix(frame(spark, rows), weights=(1.0, 8.0), share=0.4, most=2.0, seed=seed).groupBy("source").agg(F.sum("taken").alias("n"), F.first("target").alias("t")).collect()
        for r in got:
            assert abs(r.n - r.t) <= (3000 if r.source == "a" and r.n < r.t and r.t - r.n > 100 and r.n % 6000 == 0 else 100), (seed, r)


def test_repeats_pass_through_the_structures(spark, docs, monkeypatch):
    """No window is settled that the sorted structures did not see: without them nothing goes."""
    monkeypatch.setattr(bytesuffix, "suffix_order", lambda text, keys, size: ([], []))
    grouped = bytesuffix.ByteRepeats(60)
    table = pa.table({"doc_id": pa.array([1, 2, 3]), "text": pa.array(["x" * 50 + "passage of text " * 20, "passage of text " * 20, "passage of text " * 20])})
    assert grouped.compare(*_contents(grouped, table)).any() == False  # noqa: E712
    monkeypatch.undo()
    assert grouped.compare(*_contents(grouped, table)).all()
    worded = wordrepeats.WordRepeats(4)
    assert worded.compare(*_contents(worded, table)).any()
    monkeypatch.setattr(wordrepeats, "deep_nodes", lambda *x: iter(()))
    assert not worded.compare(*_contents(worded, table)).any()


def _contents(op, table):
    """compare()'s arguments for the distinct contexts of a table, as if all had several holders."""
    import numpy as np

    (part, _), *rest = op.parts(table)
    assert not rest
    key = op.contexts(part, np.arange(len(part.at)))
    first, second = key(None, False), key(None, True)
    _, sel = np.unique(np.stack([part.gram, first, second], axis=1), axis=0, return_index=True)
    sel = sel[(part.high - part.low)[sel] >= op.length]
    body = op.contents(part, part.at[sel], part.low[sel], part.high[sel])
    return part.gram[sel], body, (part.at - part.low)[sel], (part.high - part.at)[sel], np.ones(len(sel), np.int64), np.ones(len(sel), bool)


def test_html_density_by_hand():
    """Counts, densities and sums of random trees, node by node from the definitions."""
    r = random.Random(12)
    for _ in range(60):
        bits = [r.choice(["<div>", "</div>", "<p>", "</p>", "<a href=x>", "</a>", "<section>", "</section>", "some text ", "more of the text that stands here "]) for _ in range(r.randint(1, 60))]
        root = html.parse("<html><body>" + "".join(bits))
        nodes = html.measure(root)

        def texts(n):
            return [c if isinstance(c, str) else texts(c) for c in n.children]

        def flat(x):
            return [z for y in x for z in (flat(y) if isinstance(y, list) else [y])]

        def inner(n):
            return [n, *(y for c in n.children if not isinstance(c, str) for y in inner(c))]

        def linked(n):
            return size(n) if n.name == "a" else sum(linked(c) for c in n.children if not isinstance(c, str))

        def size(n):
            return sum(len("".join(t.split())) for t in flat(texts(n)))

        share = linked(root) / size(root) if size(root) else 0.0
        for n in nodes:
            below = inner(n)[1:]
            c, t, lc, lt = size(n), max(len(below), 1), linked(n), max(sum(x.name == "a" for x in below), 1)
            want = 0.0
            if c:
                want = c / t * math.log(max(c / max(lc, 1) * t / lt, 1 + 1e-9)) / math.log(c / max(c - lc, 1) * lc + share * c + math.e)
            assert math.isclose(n.density, want, rel_tol=1e-9)
        for n in nodes:
            assert math.isclose(n.sum, sum(c.density for c in n.children if not isinstance(c, str)), rel_tol=1e-9, abs_tol=1e-12)


def test_html_density_chooses():
    story = "words of a long story that goes on and on for a while, with many words in it. " * 8
    said = " ".join([story.strip()] * 2)
    for page in (
        f"<article><p>a teaser</p></article><article><p>{story}</p><p>{story}</p></article>",
        f"<body><section id='search'><p>{story}</p><p>{story}</p></section><div class=nav><a href=x>m</a></div></body>",
        f"<body><div><p class='tags'>{story}</p><p>{story}</p></div></body>",
        f"<body class=x><div class='with-sidebar'><p>{story}</p><p>{story}</p></div><div class=sidebar><p>short</p></div></body>",
        f"<article><p>{story}</p><p>{story}</p><div class='notice'>we use cookies</div><p class=tags><a href=x>one</a> <a href=y>two</a></p></article>",
    ):
        assert html.main_text(page) == said
    page = f"<article><p>{story}</p><table class='tags-table'><tr><td>cell</td></tr></table><blockquote class='notice'>quoted</blockquote><div class=comments><p>{story}</p></div></article>"
    assert html.main_text(page) == story.strip() + " cell quoted"


def test_html_takes_time_in_proportion():
    import time

    pages = ['<a "' * 250_000, '<a "' * 250_000 + '">', "<div>" * 100_000 + "x", "<div class='comments'>" * 50_000 + "text", "<div>" * 100_000 + "</x>" * 100_000, "<b>" * 100_000 + "<h1>" * 100_000, "<" * 1_000_000, "<!" * 500_000, "<!--" * 200_000, "<form>" * 50_000 + "<h1>x"]
    for page in pages:
        began = time.perf_counter()
        html.main_text(page)
        assert time.perf_counter() - began < 10, page[:30]


def test_window_minima():
    import numpy as np

    from tessera.llm import kernels as K

    rng = np.random.default_rng(0)
    for t in range(150):
        n, w = int(rng.integers(0, 300)), int(rng.integers(2, 40))
        off = np.concatenate([[0], np.sort(rng.integers(0, n + 1, 3)), [n]])
        v = rng.integers(0, [4, 1000, 1 << 62][t % 3], n).astype(np.uint64) * np.uint64([1 << 62, 1 << 54, 4][t % 3])
        expected = {i + w - 1 - int(np.argmin(v[i : i + w][::-1])) for a, b in zip(off[:-1], off[1:], strict=True) for i in range(a, b - w + 1)}
        assert set(K.window_minima(v, off, w).tolist()) == expected


def test_group_count(spark, none):
    assert tables.group_count(none) >= 4


def test_window_minima_at_the_borders_of_documents():
    """A window that begins or ends its document has its minimum, also where no value of it is small and other documents are beside it."""
    import numpy as np

    from tessera.llm import kernels as K

    width, large = 201, np.uint64((1 << 64) - 1000)
    for size in (width, width + 1):
        values = np.full(3 * size, large) + np.tile(np.arange(size, dtype=np.uint64) % 7, 3)
        values[size] = values[2 * size - 1] = large - np.uint64(1)
        off = np.array([0, size, 2 * size, 3 * size])
        expected = set()
        for a, b in zip(off[:-1], off[1:]):
            for k in range(a, b - width + 1):
                expected.add(k + width - 1 - int(np.argmin(values[k : k + width][::-1])))
        assert set(K.window_minima(values, off, width).tolist()) == expected
