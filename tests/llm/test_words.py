import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lexiscore.llm import words as w
from tests.llm.cases import grams_of, words_of

TEXT = st.text(st.characters(exclude_categories=["Cs"]), max_size=60)


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=5))
def test_words_and_their_hashes(texts):
    hashes, first = w.word_hashes(texts)
    by_hash = {}
    for i, text in enumerate(texts):
        own = hashes[first[i] : first[i + 1]].tolist()
        assert len(own) == len(words_of(text))
        for h, word in zip(own, words_of(text)):
            assert by_hash.setdefault(h, word) == word
    assert len(by_hash) == len({x for t in texts for x in words_of(t)})


def test_long_texts_are_hashed_in_parts(monkeypatch):
    text = " ".join(f"word{i % 700}" for i in range(5000)) + " " + "x" * 3000
    whole, _ = w.word_hashes([text])
    monkeypatch.setattr(w, "SLICE_BYTES", 256)
    parts, _ = w.word_hashes([text])
    assert (whole == parts).all()


def test_shingles():
    assert len(w.shingle_hashes(np.zeros(0, np.uint64), 5)) == 0
    for text in ("one two", "one two three four five six", "a a a a a a a a", "x y z x y z x y z x y z"):
        assert len(w.shingle_hashes(w.word_hashes([text])[0], 5)) == len(grams_of(text))
