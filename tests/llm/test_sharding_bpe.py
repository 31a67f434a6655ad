import hashlib
import unicodedata
import zlib
from collections import Counter

import public_tokenizers
import pytest
import tiktoken

from loomseries.llm import bpe, sharding

DOCS = "doc_id long, text string, lang string, shard string, _bucket int"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    with open(RANKS, "rb") as f:
        return bpe.read_ranks(f.read())


def test_shards_follow_the_law_and_slots_have_no_gaps(spark):
    rows = [(i, f"text {i % 7}" * (i % 5), "en", "x", 1) for i in range(3000)]
    rows += [(5, "again", None, None, None)] * 3 + [(None, None, None, None, None)] * 2
    out = sharding.assign(spark.createDataFrame(rows, DOCS), sharding.balanced_tree(4, 2, 5)).collect()
    assert len(out) == len(rows)
    for s in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert all(r.grown_shard in (r.shard, 40) for r in out)
    moved = sum(r.grown_shard == 40 for r in out)
    assert 20 < moved < 160
    sizes = Counter(r.shard for r in out)
    assert set(sizes) == set(range(40)) and max(sizes.values()) < 130
    known = {r[0]: r[1] for r in rows[:3000] if r[0] != 5}
    for r in out:
        if r.doc_id in known:
            raw = known[r.doc_id].encode()
            assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
        assert r.law == "key" and (r.doc_id is not None or (r.size, r.text_crc32) == (16, 0))
    assert len({r.shard for r in out if r.doc_id == 5}) == 1


def test_weights_confine_movement(spark):
    docs = spark.createDataFrame([(i, "t", "", "", 0) for i in range(4000)], DOCS)
    tree = sharding.balanced_tree(2, 2, 3)
    heavier = [s._replace(weight=3.0) if s.shard == 4 else s for s in tree]
    both = sharding.place(sharding.place(docs.select("doc_id"), "doc_id", tree, "a"), "doc_id", heavier, "b").collect()
    assert {r.b // 6 for r in both if r.a // 6 != r.b // 6} <= {0}  # rows change regions only into shard 4's
    # Inside the region, rows leave the other rack only for shard 4's rack.
    assert all(r.b // 3 == 1 for r in both if r.a < 6 and r.a // 3 != r.b // 3)
    assert all(r.b == 4 for r in both if r.a // 3 == 1 and r.a != r.b)
    share = sum(r.b == 4 for r in both) / len(both)
    assert abs(share - 3 / 14) < 0.03


def test_no_rows_no_shards(spark):
    assert sharding.assign(spark.createDataFrame([], DOCS), sharding.balanced_tree(1, 1, 2)).count() == 0
    with pytest.raises(ValueError):
        sharding.place(spark.createDataFrame([], DOCS), "doc_id", [sharding.Shard(0, 0, 0, 0.0)])


def test_ids_equal_the_tokenizer_library(spark, ranks):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [
        "", None, " ", "  two  blanks ", "\n\n x\n y \t z", "it's we'll they've DON'T", "naïve café über straße 12345",
        "日本語のテキスト と 漢字", "emoji 🙂🙂 é   nbsp em  x", "\x00\x1c\x1d a\x1f b\x85c", "<|endoftext|> ▁ __",
        "a" * 3000, "ab" * 1500 + " " * 50, "x\n" * 400, "the the " * 2000, "!!!??? ... $$$", "\r\n\r\n", "Ünïcödé" * 40, "word " * 60_000,
    ]
    docs = spark.createDataFrame([(i, t, "l", "s", 0) for i, t in enumerate(texts)] + [(None, "x", "", "", 0)] * 2, DOCS)
    out = bpe.encode_decode(docs, RANKS, public_tokenizers.PATTERN, ids=True).collect()
    assert len(out) == len(texts) + 2
    for r in out:
        text = "x" if r.doc_id is None else texts[r.doc_id] or ""
        want = library.encode_ordinary(text)
        assert r.ids == want and r.n_tokens == len(want), repr(text[:40])
        packed = b"".join(i.to_bytes(4, "little") for i in want)
        assert r.ids_sha256 == hashlib.sha256(packed).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_every_letter_and_a_small_cache(ranks):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = bpe.Codec(ranks, public_tokenizers.PATTERN, cache_entries=50)
    # Characters of the newest Unicode versions are letters to one library and not to the other.
    for start in range(1, 0x30000, 997):
        text = "".join(f"{chr(c)}a " for c in range(start, start + 997) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn")
        ids = codec.encode(text)
        assert codec.decode(ids).decode() == text
        assert ids == b"".join(i.to_bytes(4, "little") for i in library.encode_ordinary(text)), hex(start)


def test_bpe_of_an_empty_table(spark):
    out = bpe.encode_decode(spark.createDataFrame([], DOCS), RANKS, public_tokenizers.PATTERN)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() == 0


def test_gaps_in_ranks():
    with pytest.raises(ValueError):
        bpe.model_bytes({b"a": 0, b"b": 2})
