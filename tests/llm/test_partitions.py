"""Every operator over a table with a partition of nulls, one of blanks and one of nothing."""

import pytest
from tests.llm.test_llm import LABELS, P, words

from stratalens.llm import bpe, embeddings, fingerprint, licenses, minhash, packing, quality, repeats, urlfilter, warc

TEXTS = [" ".join(words(40, k)) for k in range(30)]


def parted(spark, schema, *parts):
    """A table whose partitions hold the given rows, one part each; the last one has none."""
    frames = [spark.createDataFrame(p, schema).coalesce(1) for p in (*parts, [])]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


@pytest.fixture(scope="module")
def table(spark):
    return parted(spark, "doc_id long, text string", [(i, t) for i, t in enumerate(TEXTS)], [(100, None)], [(101, "  \n")], [(102, ""), (103, None)])


ODD = {100, 101, 102, 103}


def test_quality_on_partitions_without_words(spark, table):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)] + [(100, 1, 0), (102, 0, 0)], LABELS)
    for run in (quality.weights, quality.judge):
        out = run(table, labels).collect()
        assert len(out) == 34 and all(r.log_weight == 0 for r in out if r.doc_id in ODD)
    assert quality.keep_drawn(table, labels).columns == ["doc_id", "text"]


@pytest.mark.parametrize(
    "run",
    [
        minhash.near_duplicates, minhash.keep_one, fingerprint.edited_fingerprints, repeats.repeat_report, repeats.strip_texts, licenses.license_scan,
        lambda t: bpe.round_trip(t, P.path("byte_bpe_50k.tiktoken"), P.PATTERN), lambda t: packing.pack(t, P.path("word_bpe_49k.json")),
    ],
    ids=["minhash", "keep_one", "fingerprint", "repeats", "strip", "licenses", "bpe", "packing"],
)
def test_documents_on_partitions_without_words(spark, table, run):
    out = run(table).collect()
    assert {r.doc_id for r in out} == {*range(30), *ODD} and len(out) == 34


def test_pages_and_vectors_on_partitions_of_nulls(spark):
    pages = parted(spark, "page_id long, url string, html string", [(i, f"http://a{i}.org/x", f"<p>{i}") for i in range(9)], [(20, None, None)], [(21, "", "")])
    assert {r.page_id for r in urlfilter.judge_urls(pages).collect()} == {r.page_id for r in warc.archive_round_trip(spark, pages).collect()} == {*range(9), 20, 21}
    vectors = parted(spark, "vec_id long, label int, embedding array<float>", [(i, 1, [1.0, i / 9]) for i in range(9)], [(20, 1, None)], [(21, None, [1.0, 0.0])], [(22, 1, [None, 1.0]), (23, 1, [0.0, 0.0])])
    got = {r.vec_id: r.n_links for r in embeddings.embedding_links(vectors).collect()}
    assert set(got) == {*range(9), 20, 21, 22, 23} and not any(got[i] for i in (20, 21, 22, 23)) and got[0]
