import random
import time

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st

from lossframe.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both():
    return pieces.Pieces(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)


def same(both, text):
    own, library = both
    joined, n, said = own.encoded(text)
    want = library.encode(text, add_eos=True)
    assert [int(i) for i in joined.split()] == want and n == len(want), text[:200]
    assert said == library.decode(want), text[:200]


ODD = ["", " ", "  ", "▁", " ▁ ▁▁", "\n\n", "\t a", "é日本語🤦‍♂️", "\x00", "</s><s><unk><0x0A>", "ﬁ ½ Å", "​ x", "a" * 300, " " * 99, "=" * 77]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(both, text):
    same(both, text)


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_any_text(both, text):
    same(both, text.encode("utf-8", "ignore").decode())


def test_words_that_backtrack(both):
    rng = random.Random(5)
    parts = ["th", "e", "in", "ing", "er", " ", "  ", "a", "an", "tion", "1", "00", "s", ".", "...", "'", "▁", "日", "\n", "ü"]
    for _ in range(4000):
        same(both, "".join(rng.choices(parts, k=rng.randint(1, 30))))


def test_whole_texts(both, spark, sf):
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect():
        same(both, r.text or "")


def test_any_ids(both):
    own, library = both
    rng = random.Random(6)
    for _ in range(5000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(300), 28705, 259]) for _ in range(rng.randrange(7))]
        assert own.decoded(ids) == library.decode(ids), ids
    with pytest.raises(ValueError):
        own.decoded([32000])


def test_merging_is_the_library_order(both):
    """Re-merging a short text is the library's encoding of a stretch; a missing letter stays alone."""
    own, library = both
    for word in ("threhand", "ciónarueas", "Thlyesed", "▁▁▁▁▁▁a", "aquaqua"):
        ids = library.encode(word.replace("▁", " ").removeprefix(" ") if word[0] == "▁" else word)
        got = own.merged(word if word[0] == "▁" else "▁" + word)
        assert [own.id[p] for p in got] == ids
    assert own.merged("\nq") == ["\n", "q"]


def test_time_grows_with_the_text(both):
    own, _ = both
    rng = random.Random(7)
    word = "".join(rng.choices("abcdefghinorst", k=400_000))
    took = []
    for n in (25_000, 400_000):
        t = time.perf_counter()
        own.cut(word[:n])
        took.append(time.perf_counter() - t)
    assert took[1] < 60 * took[0]


def test_frames(odd, empty, both):
    _, library = both
    rows = {r.doc_id: r for r in pieces.digests(odd, PATH).collect()}
    assert pieces.digests(odd, PATH).count() == odd.count() and rows[0].n_tokens == rows[1].n_tokens == 1
    back = pieces.decode(pieces.encode(odd, PATH), PATH).collect()
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    assert all(r.text == texts[r.doc_id] for r in back if r.doc_id is not None)
    assert pieces.digests(empty, PATH).collect() == []
