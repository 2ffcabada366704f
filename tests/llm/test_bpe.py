import hashlib

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkquarry.llm import bpe
from sparkquarry.llm.queries import tokenizer_file
from tests.llm.odd import ODD, frame


@pytest.fixture(scope="module")
def ours():
    return bpe.Tokenizer(bpe._read(tokenizer_file()))


@pytest.fixture(scope="module")
def theirs():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file())
    t.no_padding()
    t.no_truncation()
    return t


def check(ours, theirs, texts):
    ids, ends = ours.encode(pa.array(texts, pa.string()))
    decoded = ours.decode(ids, ends).to_pylist()
    for i, t in enumerate(texts):
        want = theirs.encode(t or "", add_special_tokens=False).ids
        assert ids[ends[i] : ends[i + 1]].tolist() == want, t
        assert decoded[i] == theirs.decode(want, skip_special_tokens=False)


PIECES = st.sampled_from(["a", "the", "ing", "'s", "'LL", " ", "\n", "\x1c", "\x85", "é", "é", "Σς", "İ", "1", "½", "漢", "😀", "<|endoftext|>", "<|start", "!!", ".", "zzz", "ǅ", " "])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(PIECES, st.text(max_size=8)), max_size=20).map("".join))
def test_same_as_library(ours, theirs, text):
    check(ours, theirs, [text.encode("utf-8", "ignore").decode()])


def test_same_as_library_on_documents(ours, theirs, spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    check(ours, theirs, [*texts, *[t for _, t in ODD], "ab" * 3000])


def test_query_and_round_trip(spark, theirs):
    docs = frame(spark)
    got = {r.doc_id: r for r in bpe.digests(docs, tokenizer_file()).collect()}
    assert len(got) == len(ODD)
    for i, t in ODD:
        ids = theirs.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(theirs.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    coded = bpe.encode(docs, tokenizer_file())
    again = {r.doc_id: r.decoded for r in bpe.decode(coded, tokenizer_file()).collect()}
    assert again[15] == theirs.decode(theirs.encode("same text here", add_special_tokens=False).ids, skip_special_tokens=False)
    assert bpe.digests(docs.limit(0), tokenizer_file()).count() == 0


def test_memory_of_words_is_bounded():
    seen = bpe.Recent(lambda k: k * 2, 3)
    assert [seen[i] for i in range(10)] == [2 * i for i in range(10)]
    assert len(seen) <= 3 and len(seen.old) <= 3
