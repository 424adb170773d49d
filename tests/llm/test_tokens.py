"""Ids of words that no memo has yet."""

from string import punctuation

from quillspark.llm.tokens import TextEncoder, default_vocabulary


def test_words_before_marks_are_not_split():
    """Letters with marks behind go to the model without the pattern, kept once, and their ids are the library's."""
    enc = TextEncoder(default_vocabulary())
    split, asked = enc.split, []
    enc.split = lambda text: (asked.append(text), split(text))[1]
    text = "It " + " ".join(f"Vñor{a} vxor{a}{a}{a} y{a}" for a in punctuation)
    assert enc.ids(text).tolist() == enc.whole.encode(text, add_special_tokens=False).ids
    assert asked == ["It"]
    assert " Vñor" not in enc.words and "Vñor" in enc.chunks
    odd = "a b' c's 'd e''s f'.s g_ h'll. É! é. a-b .a ½. x²! ª. 9. it's. don't, 'tis' we'll!! l' d'x.\nY z'\ns"
    assert enc.ids(odd).tolist() == enc.whole.encode(odd, add_special_tokens=False).ids
