import hashlib
import random
from array import array

import public_tokenizers
import pytest
from corpus import awkward, frame
from tokenizers import Tokenizer

from bourse.llm import bpe, token_counts

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ALPHABET = list("aAbB  \n\t'stre ΣςéÉ0９<|>👩‍👧́ͅﬁİı\x1c\x1f\x0b\x85  ​ǅ一の")


def fuzz(n=4000):
    r = random.Random(5)
    for i in range(n):
        s = "".join(r.choice(ALPHABET) for _ in range(r.randint(0, 40)))
        yield s.replace("é", "<|endoftext|>").replace("0", "<|startoftext|>") if i % 3 == 0 else s
    yield from ("ab" * 5000, "=" * 3000, " " * 3000, "x\n" * 2000, "é" * 300, "word " * 70000, "a" * 70000)


def test_counts_equal_the_library():
    lib, c = Tokenizer.from_file(WORD), token_counts.Counter(WORD)
    for s in fuzz():
        assert c.count(s) == len(lib.encode(s, add_special_tokens=False).ids), repr(s[:80])


def test_ids_and_text_equal_the_library():
    lib, c = Tokenizer.from_file(BYTE), bpe.Codec(BYTE)
    for s in fuzz():
        want = lib.encode(s, add_special_tokens=False).ids
        got = b"".join(c.encode(s))
        assert list(array("I", got)) == want, repr(s[:80])
        assert bpe.utf8(c.decode(got)).decode() == lib.decode(want, skip_special_tokens=False)


def test_forced_boundaries_lie_in_no_token():
    c = bpe.Codec(BYTE)
    assert 0 < sum(c.joined) < 1 << 16
    for raw in (b"the \xff\x00q", "naïve 漢字!!\n\n".encode()):
        assert b"".join(c.cuts(raw)) == raw
        for left, right in zip(c.cuts(raw), c.cuts(raw)[1:], strict=False):
            assert not any(left[-1:] + right[:1] in t for t in c.bytes_of.values())


def test_a_full_memory_changes_nothing(monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 5)
    texts = list(fuzz(200))
    a, b, whole = token_counts.Counter(WORD), bpe.Codec(BYTE, 5), bpe.Codec(BYTE)
    assert [a.count(t) for t in texts] == [token_counts.Counter(WORD).count(t) for t in texts[:3]] + [a.count(t) for t in texts[3:]]
    assert len(a.words) <= 6 and [b"".join(b.encode(t)) for t in texts] == [b"".join(whole.encode(t)) for t in texts] and len(b) <= 6


def test_frames(spark):
    data = awkward()
    df = frame(spark, data, "id", "n_tokens", "a.b")
    lib, word = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
    enc = lambda t: lib.encode(t or "", add_special_tokens=False).ids
    got = bpe.encode(df, BYTE).collect()
    want = [(r[0], len(enc(r[1])), hashlib.sha256(array("I", enc(r[1])).tobytes()).hexdigest(),
             hashlib.sha256((r[1] or "").encode()).hexdigest(), enc(r[1])) for r in data]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    back = bpe.decode(bpe.encode(df, BYTE), BYTE)
    assert sorted((str(r.doc_id), r.text) for r in back.collect()) == sorted((str(r[0]), r[1] or "") for r in data)
    got = token_counts.token_counts(df, WORD, limit=20).collect()
    n = [len(word.encode(r[1] or "", add_special_tokens=False).ids) for r in data]
    assert sorted(map(str, map(tuple, got))) == sorted(str((r[0], len((r[1] or "").encode()), k, k > 20)) for r, k in zip(data, n, strict=True))


@pytest.mark.parametrize("op", [lambda df: bpe.encode(df, BYTE), lambda df: token_counts.token_counts(df, WORD)])
def test_empty_table(spark, op):
    assert op(frame(spark, [])).count() == 0
