"""Words are spelt and decoded once a worker."""

import pytest

from millrace.llm.bpe import encoder
from millrace.llm.queries import vocabulary


def test_words_are_spelt_as_they_are_encoded_and_only_once(monkeypatch):
    bpe = encoder(*vocabulary())
    texts = ["", None, "the cat sat on the cat  mat\n\n", "naïve \U0001f600 日本語 ½ ​", "a" * 400 + " end", "<|endoftext|> tail <|endoftext|>", "it's  12345 tabs\tand \r\n lines"]
    texts += [f"x {s} y {s}" for s in bpe.special]
    for text in texts:
        ids, parts = bpe.encode(text), bpe.parts(text)
        assert sum(n for n, _, _ in parts) == len(ids)
        assert ",".join(d for _, d, _ in parts) == ",".join(map(str, ids))
        assert b"".join(x for _, _, x in parts).decode("utf-8", "replace") == bpe.decode(ids)
    monkeypatch.setattr(bpe, "merge", lambda _: pytest.fail("merged again"))
    monkeypatch.setattr(bpe, "_spelt", lambda _: pytest.fail("spelt again"))
    assert bpe.parts("the cat sat on the cat")
