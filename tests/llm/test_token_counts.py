"""Counts against the sentencepiece library."""

import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from configsieve.llm import token_counts
from tests.llm.conftest import ODD_TEXTS

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(token_counts.MODEL))
COUNTS = token_counts.word_counts()


def test_odd_texts():
    for text in ODD_TEXTS:
        assert token_counts.count_tokens(text, COUNTS) == len(LIBRARY.encode(text or ""))


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from("ab ethinr.,▁²½\n\t<>0xA☃"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_random_texts(text):
    assert token_counts.count_tokens(text, COUNTS) == len(LIBRARY.encode(text))


def test_merging_without_cuts_gives_the_same():
    ranks = token_counts.vocabulary()
    for text in ODD_TEXTS[3:11]:
        assert token_counts.merged_count(" " + text.replace("▁", " "), ranks) == len(LIBRARY.encode(text))


def test_caches_forget_and_stay_right():
    small = token_counts.Cache(len, most=3)
    assert [small[x] for x in ("a", "bb", "ccc", "dddd", "a", "eeeee", "bb")] == [1, 2, 3, 4, 1, 5, 2]
    assert len(small) + len(small.old) <= 6


def test_documents(odd_documents, no_documents):
    rows = token_counts.token_counts(odd_documents, limit=1000).collect()
    texts = [(d.doc_id, d.text or "") for d in odd_documents.collect()]
    want = [(i, len(t.encode()), n := len(LIBRARY.encode(t)), n > 1000) for i, t in texts]
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, want))
    assert token_counts.token_counts(no_documents).count() == 0
