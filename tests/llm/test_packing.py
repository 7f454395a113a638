import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from lodestar.llm import packing as p
from lodestar.llm.registry import tokenizer_path
from tests.llm.conftest import ODD


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def plain(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def test_words_equal_the_tokenizer(tokenizer):
    dice = random.Random(1)
    signs = "aZéÉßÿ µªº²½ 1,.!'’-_|<>\n\t\r\x1c\x85\xa0 ́İΣςǅﬁ漢각🙂&\"`«»"
    texts = [t for t in ODD if t is not None and len(t) < 50_000] + ["".join(dice.choice(signs) for _ in range(40)) for _ in range(1500)]
    texts += ["it's we'll they've a'b", "<|endoftext|>x <|startoftext|>", "foo<| bar|>", "Größe!? naïve, ÀÖ.", "I'M it're"]
    enc = p.WordEncoder(tokenizer_path(), most=200)  # small, so that generations change
    assert enc.by_word
    for t in texts:
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("text", ["a <|ENDOFTEXT|> b", "<|EndOfText|>", "É<|StartOfText|>É <|endoftext|> ABC", "A<| |ENDOFTEXT|>\nB <|ENDOFTEXT|>漢"])
def test_added_tokens_are_found_in_their_own_spelling_only(tokenizer, text):
    enc = p.WordEncoder(tokenizer_path())
    assert np.frombuffer(enc.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_other_tokenizers_are_used_as_they_are():
    from tokenizers import Tokenizer

    enc = p.WordEncoder(tokenizer_path("byte_bpe_50k.json"))
    assert not enc.by_word
    assert np.frombuffer(enc.encode("A  b\nc"), "<u4").tolist() == Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")).encode("A  b\nc", add_special_tokens=False).ids


def test_whole_texts_are_packed(make, prose, tokenizer):
    dice = random.Random(3)
    rows = list(enumerate([prose(k, dice.choice((1, 5, 40, 300, 900, 2500))) for k in range(60)] + ODD)) + [(5, "twice"), (5, "twice")]
    out = p.pack_documents(make(rows, extra=True), tokenizer_path()).collect()
    want = sorted((i, k, at, len(ids[at : at + 2048]), zlib.crc32(np.array(ids[at : at + 2048], "<u4").tobytes())) for i, t in rows for ids in [plain(tokenizer, t)] for k, at in enumerate(range(0, len(ids), 2048)))
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    bins = defaultdict(list)
    for r in out:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in bins.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(bins) <= 1.03 * sum(r["length"] for r in out) / 2048 + 1


@pytest.mark.parametrize("choose", ["norm", "dot"])
def test_every_capacity_holds(choose):
    dice = random.Random(7)
    for _ in range(20):
        histogram = {n: dice.randrange(1, 30) for n in dice.sample(range(1, 101), 30)}
        cap = p.Capacity(tokens=100, documents=dice.choice((2, 4, 100)), attention=10_000, choose=choose)
        runs, bins = p.plan(histogram, cap)
        held = defaultdict(list)
        for r in runs:
            for k in range(r.count):
                held[r.bin_from + k // r.each_].append((r.offset + k % r.each_ * r.length, r.length))
        assert sum(map(len, held.values())) == sum(histogram.values()) and len(held) == bins
        for items in held.values():
            at = 0
            for offset, n in sorted(items):
                assert offset == at
                at += n
            assert at <= 100 and len(items) <= cap.documents and sum(n * n for _, n in items) <= cap.attention
    with pytest.raises(ValueError, match="fits no"):
        p.plan({101: 1}, p.Capacity(tokens=100))


def test_sequences_hold_their_ids(make, prose, tokenizer):
    rows = [(k, prose(k, 20)) for k in range(9)]
    packed = p.pack_documents(make(rows), tokenizer_path(), keep_ids=True)
    first = packed.filter("offset = 0").first()
    whole = {r["sequence_id"]: bytes(r["ids"]) for r in p.sequences(packed).collect()}
    assert whole[first["sequence_id"]].startswith(np.array(plain(tokenizer, rows[first["doc_id"]][1]), "<u4").tobytes())
    assert p.pack_documents(make([]), tokenizer_path()).count() == 0
