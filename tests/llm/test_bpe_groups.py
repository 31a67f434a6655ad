"""Neighbouring texts are encoded together, with one call of the model, to the ids they have alone."""

import random

import pytest

from loomseries.llm import bpe

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_texts_encoded_together(monkeypatch):
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = bpe.read_ranks(f.read())
    rng = random.Random(5)
    letters = "abcdefgh  \n\t\x01é中\U0001f600 '"
    texts = ["", " ", "a\x00b c", *("".join(rng.choices(letters, k=rng.randrange(400))) for _ in range(80))]
    alone = bpe.Codec(ranks, public_tokenizers.PATTERN)
    want = [alone.encode(t) for t in texts]
    for group, entries in ((1 << 20, 300_000), (1000, 300_000), (1000, 40)):
        monkeypatch.setattr(bpe, "GROUP_CHARS", group)
        codec = bpe.Codec(ranks, public_tokenizers.PATTERN, cache_entries=entries)
        calls, merged = [], codec._merged
        codec._merged = lambda spelled: (calls.append(1), merged(spelled))[1]
        assert list(codec.encode_all(texts)) == want
        assert [codec.decode(x).decode() for x in want] == texts
        if group > 1000:
            assert len(calls) == 1
