import hashlib
import random

import pytest

from wellspring.llm import bpe

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def both():
    path = bpe.default_path()
    return bpe.load(path), tokenizers.Tokenizer.from_file(path)


def test_as_the_library(both):
    own, lib = both
    rng = random.Random(2)
    letters = "aaaabbcdeeefghiilmnoorsstttuyz'0129!#.-ñéßΣσİ日本語👍́ \n\t\x1c\x85 \xad\x00ABC<|>"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(6000)]
    texts += ["", "  ", "don't I'LL we've", "<|startoftext|>a <|ENDOFTEXT|><|endoftext|>b", "a" * 5000, "##!!" * 500, "x\r\ny\x0bz"]
    for t, (ids, names) in zip(texts, own.encode_texts(texts)):
        want = lib.encode(t, add_special_tokens=False).ids
        assert ids == " ".join(map(str, want)), t
        assert names == lib.decode(want, skip_special_tokens=False)


def test_verified_proposals_equal_exact_merging(both):
    own, _ = both
    rng = random.Random(4)
    words = ["".join(rng.choice("aeinorst") for _ in range(rng.randint(1, 14))) for _ in range(20000)]
    words = list(dict.fromkeys(words))
    before = own.merged
    assert own.encode_words(words) == [own.merge(own.base(w)) for w in words]
    assert own.merged - before < len(words)  # some proposals hold


def test_small_caches_change_nothing(both, monkeypatch):
    own, lib = both
    monkeypatch.setattr(bpe, "CACHED_CHUNKS", 10)
    texts = [f"some words {i} and others {i * 7}" for i in range(40)]
    for _ in range(3):
        got = own.encode_texts(texts)
    assert [x for x, _ in got] == [" ".join(map(str, lib.encode(t, add_special_tokens=False).ids)) for t in texts]


def test_query_digests(spark, make, real, both):
    docs, _ = real
    rows = [(d.doc_id, d.text) for d in docs[:60]] + [(None, None), (900, ""), (901, "a b"), (901, "a b"), (902, "x" * 70_000)]
    got = bpe.token_digests(spark, make(rows)).collect()
    want = []
    for i, t in rows:
        ids = both[1].encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(both[1].decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert bpe.token_digests(spark, make([])).count() == 0


def test_ids_and_round_trip(spark, make, both):
    own, _ = both
    r = bpe.encode_documents(spark, make([(1, "Hello world, hello!")])).first()
    assert own.decode(r.ids) == r.decoded == "hello</w> world</w> ,</w> hello</w> !</w>"
    assert own.encode(r.decoded.replace("</w>", "")) == r.ids


def test_other_files_are_refused():
    with pytest.raises((ValueError, KeyError, TypeError)):
        bpe.WordBpe({"model": {"type": "Unigram"}, "normalizer": {"normalizers": []}, "pre_tokenizer": {"pretokenizers": [{"pattern": {"Regex": ""}}]}, "decoder": None, "added_tokens": []})
