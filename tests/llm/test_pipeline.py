import hashlib
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lossframe.llm import queries
from test_dedup_and_decontaminate import brute as contamination, copies
from test_simhash import brute_components, brute_fingerprint


def test_stages_are_the_dealt_ones():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "SimHash near-dedup", "benchmark decontamination", "BPE encoding and decoding"]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_run_equals_brute_force(spark, sf):
    d = f"/root/testdata/{sf}"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    known = {i: t for i, t in texts.items() if any(c.isalpha() for c in t or "")}
    single = {i: known[i] for i, keep, _, _ in copies(known.items()) if i == keep}
    part = brute_components({i: brute_fingerprint(t) for i, t in single.items()}, 4)
    apart = {i: t for i, t in single.items() if part[i] == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    clean = {i: apart[i] for i, *_, bad in contamination(apart.items(), items) if not bad}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_padding()
    library.no_truncation()
    want = []
    for i, t in clean.items():
        ids = library.encode(t, add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    got = corpus_pipeline.run(spark, d).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert Counter(map(tuple, got)) == Counter(want)


def test_stages_keep_the_columns_of_documents(spark, odd, empty):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars", "doc", "fp")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "/root/testdata/sf0.001").columns == docs.columns, name
        assert stage(spark, empty, "/root/testdata/sf0.001").count() == 0


def test_one_query_for_each_operator():
    assert [sum(q.startswith(f"op{n}_") for q in queries.QUERIES) for n in range(1, 11)] == [1] * 10
