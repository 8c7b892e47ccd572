"""The registered queries and the pipeline against plain versions of all they do."""

import html as entities
import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))
sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402
from duck import connect, same  # noqa: E402

import corpus_pipeline  # noqa: E402
from tessera.llm import bpe, mixing  # noqa: E402
from tessera.llm import queries as Q  # noqa: E402


@pytest.mark.parametrize("name", list(Q.ORACLE_SQL))
def test_matches_oracle(spark, sf, name):
    same(Q.queries()[name](spark, sf), connect(sf), Q.ORACLE_SQL[name])


def test_one_query_for_each():
    assert [n.split("_")[0] for n in Q.queries()] == [*[f"op{i}" for i in range(1, 11)], "pipeline"]


@pytest.fixture(scope="module")
def documents(spark, sf):
    return [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def draws(spark, ids):
    df = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    return dict(tuple(r) for r in df.select("doc_id", mixing.uniform(20, df.doc_id)).collect())


def keeps(texts):
    """The verdicts of op6, by the plain versions."""
    p = brute.posteriors([brute.votes(t) for t in texts])
    counts = [brute.quality_counts(t) for t in texts]
    failed = [c[0] < 20 or 100 * c[4] > 30 * c[0] for c in counts]
    return counts, failed, [not f and x >= 0.5 for f, x in zip(failed, p, strict=True)]


def encoded(texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.byte_level_path())
    ids = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    return [(len(x), brute.sha(",".join(map(str, x)).encode()), brute.sha(library.decode(x, skip_special_tokens=False).encode()), x) for x in ids]


def test_op1(spark, sf, documents):
    assert rows(Q.op1_exact_dedup(spark, sf), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(brute.exact([d[:2] for d in documents]))


def test_op2(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = Q.op2_html_extraction(spark, sf).collect()
    assert {r.page_id for r in got} == set(pages) and len(got) == len(pages)
    for r in got:
        body = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        parts = re.sub(r"<[^>]+>", "", re.sub(r"</?(p|br|h1)>", "\0", body)).split("\0")
        assert r.text == " ".join(" ".join(entities.unescape(p).split()) for p in parts if p.strip()) and r.n_chars == len(r.text)


def test_op3(spark, sf, documents):
    assert rows(Q.op3_suffix_array_dedup(spark, sf), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute.byte_repeats([d[:2] for d in documents], 400))


def test_op4(spark, sf, documents):
    want = sorted((i, n, n * c) for i, n, c in brute.mix(documents, draws(spark, [d[0] for d in documents])))
    assert rows(Q.op4_mixing(spark, sf), "doc_id", "size", "taken") == want


def test_op5(spark, sf, documents):
    assert rows(Q.op5_ngram_jaccard_join(spark, sf), "doc_id", "n_shingles", "component_id") == sorted(brute.jaccard([d[:2] for d in documents], 3, 90))


def test_op6(spark, sf, documents):
    counts, failed, kept = keeps([d[1] for d in documents])
    assert rows(Q.op6_quality_rules(spark, sf), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept") == sorted((d[0], *c, f, k) for d, c, f, k in zip(documents, counts, failed, kept, strict=True))


def test_op7(spark, sf, documents):
    assert rows(Q.op7_bpe(spark, sf), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted((d[0], *e[:3]) for d, e in zip(documents, encoded([d[1] for d in documents]), strict=True))


def test_op9(spark, sf, documents):
    got = sorted(tuple(r) for r in Q.op9_lm_scoring(spark, sf).collect())
    for a, b in zip(got, sorted(brute.unigram([d[:2] for d in documents])), strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6 * abs(b[5]) and a[6] < 0


def test_op10(spark, sf, documents):
    assert rows(Q.op10_substring_dedup(spark, sf), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.word_repeats([d[:2] for d in documents], 13))


def plain_pipeline(spark, docs):
    """The five stages by the plain versions, over (doc_id, text, source)."""
    docs = [d for d, k in zip(docs, keeps([d[1] for d in docs])[2], strict=True) if k]
    kept = {x[0] for x in brute.exact([d[:2] for d in docs]) if x[3]}
    docs = [d for d in docs if d[0] in kept]
    kept = {i for i, _, c in brute.jaccard([d[:2] for d in docs], 5, 80) if i == c}
    docs = [d for d in docs if d[0] in kept]
    copies = {i: c for i, _, c in brute.mix(docs, draws(spark, [d[0] for d in docs]))}
    docs = [d for d in docs for _ in range(copies[d[0]])]
    return sorted((d[0], *e) for d, e in zip(docs, encoded([d[1] for d in docs]), strict=True))


def test_run(spark, sf, documents):
    got = corpus_pipeline.run(spark, sf)
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, r.ids) for r in got.collect()) == plain_pipeline(spark, documents)


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        assert k == 4 or out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))


def test_stages_of_empty_and_odd_tables(spark, sf):
    """Nulls in every column, repeated rows and no rows at all."""
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    prose = "the quick brown fox jumps over a lazy dog while many other animals look on from behind the old wooden fence and wonder what will happen next in this quiet little village by the river"
    for given in ([], [(None, None, None, None, None)] * 3, [(1, prose, "en", None, 5), (1, prose, "en", None, 5), (None, prose + " indeed", None, "a", None), (2, "", "en", "a", 0)]):
        docs = spark.createDataFrame(given, schema)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, sf)
            got = [tuple(r) for r in out.collect()]
            docs = spark.createDataFrame(got, schema) if k < 4 else out
        assert len(got) <= 2 * len(given)
