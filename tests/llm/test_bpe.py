import hashlib
import random

import numpy as np
import pytest

from strataprof.llm import byte_bpe

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def codecs():
    ranks = byte_bpe.read_ranks(byte_bpe.default_ranks())
    return byte_bpe.Codec(ranks), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encodes_as_the_library_does(codecs):
    mine, theirs = codecs
    rng = random.Random(1)
    letters = list("ab'stmdrevl  \n\t  \x1c\x850٣²!?#é中🙂'’́İ")
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["", "a" * 3000, " " * 900, "\n\n x", "'s", "it's we'll'd", "x'", "'", "a''s", " 's", "\n's"]
    for text, (ids, offsets) in zip(texts, mine.encode(texts)):
        assert ids == theirs.encode_ordinary(text)
        assert mine.decode(ids) == text.encode()
        assert offsets == sorted(set(offsets)) and len(offsets) == len(ids)
        data = text.encode()
        assert mine.decode(ids, offsets) == data and mine.decode(ids, offsets, 2, 7) == data[2:7]
        assert all(data[o:].startswith(mine.decode([i])) for i, o in zip(ids, offsets))
    ids, counts, offsets = mine.encode_all(texts)
    assert mine.decode_all(ids, counts, offsets)[0] == "".join(texts).encode()
    wrong = offsets.copy()
    wrong[:-1] = offsets[1:]  # decoding does follow the offsets
    assert mine.decode_all(ids[:2], np.array([2]), wrong[:2])[0] != mine.decode_all(ids[:2], np.array([2]), offsets[:2])[0]


def test_round_trip_frame(spark):
    texts = ["Hello there, it's 2024!", None, "", "x" * 50_000, "a\n\n  b"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    for r in byte_bpe.round_trip(df, byte_bpe.default_ranks()).collect():
        t = (texts[r["doc_id"]] or "").encode()
        assert r["decoded_sha256"] == hashlib.sha256(t).hexdigest()
    enc = byte_bpe.encode(df, byte_bpe.default_ranks())
    assert {r["doc_id"]: bytes(r["decoded"]).decode() for r in byte_bpe.decode(enc, byte_bpe.default_ranks()).collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert byte_bpe.round_trip(df.limit(0), byte_bpe.default_ranks()).count() == 0
    twice = byte_bpe.round_trip(df.unionByName(df), byte_bpe.default_ranks())
    assert twice.count() == 10 and twice.distinct().count() == 5
