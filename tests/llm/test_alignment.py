"""The alignment of two tokenizers against a plain loop over whole texts, encoded by the libraries themselves."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from loomseries.llm import alignment, words

FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LETTERS = "ab  \n\t  ▁é°日’'s<|endoftext|><s>😀12.,\u0085​\x00ß"


@pytest.fixture(scope="module")
def tables():
    return alignment.Vocabularies.read(*FILES, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    import tokenizers

    a = tokenizers.Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=FILES[1])


def by_hand(text, v, libraries):
    """n_a, n_b, links of one text, its digest, and a counter of its linked pairs."""
    nothing = (0, 0, 0, "", Counter())
    if not text:
        return nothing
    ids = libraries[0].encode(" " + text, add_special_tokens=False).ids, libraries[1].encode(text)
    whole = (" " + text).encode()
    if any(b"".join(table[i] for i in side) != whole for side, table in zip(ids, (v.bytes_a, v.bytes_b), strict=True)):
        return nothing
    ends = [np.cumsum([len(table[i]) for i in side]).tolist() for side, table in zip(ids, (v.bytes_a, v.bytes_b), strict=True)]
    common = set(ends[0]) & set(ends[1])
    groups = [], []
    for side in (0, 1):
        group = []
        for i, end in zip(ids[side], ends[side], strict=True):
            group.append(i)
            if end in common:
                groups[side].append(group)
                group = []
    spelled = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in zip(*groups, strict=True))
    pairs = Counter((x[-1], y[-1]) for x, y in zip(*groups, strict=True))
    return len(ids[0]), len(ids[1]), len(common), hashlib.sha256(spelled.encode()).hexdigest(), pairs


def odd_texts(n=800):
    rnd = random.Random(5)
    made = ["".join(rnd.choice(LETTERS) for _ in range(rnd.randint(0, 40))) for _ in range(n)]
    words_ = ["the", "licence", "été", "日本", "x" * 30, "don't", "▁", "12,5", "ﬁne", "a\nb"]
    made += [" ".join(rnd.choice(words_) for _ in range(rnd.randint(1, 60))) for _ in range(n // 4)]
    return made + [None, "", " ", "  ", "x" * 5000, " " * 3000 + "y", "<|endoftext|> <s> <0x41> </s>", "word " * 3000]


@pytest.mark.parametrize("piece,cache,lane", [(1 << 20, 100_000, 256), (50, 40, 3)])
def test_texts_against_a_loop(tables, libraries, piece, cache, lane):
    texts = odd_texts()
    aligner = alignment.Aligner(tables, cache, lane)
    out = list(alignment.align_batch(aligner, pa.array(texts, pa.string()), piece))
    assert len(out) == len(texts)
    width = len(tables.bytes_b)
    for text, (n_a, n_b, n_links, digest, codes, times) in zip(texts, out, strict=True):
        pairs = Counter({divmod(int(tables.pairs[c]), width): int(n) for c, n in zip(codes, times, strict=True)})
        assert (n_a, n_b, n_links, digest, pairs) == by_hand(text, tables, libraries), text


def test_ends_merge_in_order():
    rnd = np.random.default_rng(3)
    for _ in range(20):
        a, b = (np.sort(rnd.choice(2000, 300, replace=False)) + 1 for _ in range(2))
        edges = np.union1d(np.arange(7, 2001, 7), [2001])
        x, y = alignment.merge_ends(a, b, edges)
        assert a[x].tolist() == b[y].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def test_blanks_at_which_texts_are_cut():
    texts = [" a b", "a  b", "a  b", "é b", "▁ b", "a ▁", "a b ", "日 本", "a b"]
    data = [t.encode() for t in texts]
    at = words.Texts(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    found = alignment.safe_blanks(at)
    assert at.owner(found).tolist() == [0, 3, 6, 7, 8]


def test_pairs_are_those_of_suffixes():
    assert alignment.possible_pairs([b"", b"xab", b"b"], [b"ab", b"", b"yb"]).tolist() == [3, 6, 8]


def test_query_against_a_loop(spark, tables, libraries):
    texts = odd_texts(150)
    rows = [(i if i % 50 else None, t, "x", "clash", [1]) for i, t in enumerate(texts + texts[:20])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, codes string, groups string, times array<int>").repartition(5)
    out = alignment.align(docs, *FILES, public_tokenizers.PATTERN)
    hand = [by_hand(r[1], tables, libraries) for r in rows]
    counts = sum((h[4] for h in hand), Counter())
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    want = [
        (r[0], n_a, n_b, n, n, sum(k for p, k in pairs.items() if counts[p] == best[p[1]]), sum(k * counts[p] for p, k in pairs.items()), digest)
        for r, (n_a, n_b, n, digest, pairs) in zip(rows, hand, strict=True)]
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(docs, *FILES, public_tokenizers.PATTERN).collect() == []
