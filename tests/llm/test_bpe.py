"""Operator 11 against the tokenizers library."""

import random

import numpy as np
import pytest
from helpers import frame, nasty

from shopfloor.llm import bpe

public_tokenizers = pytest.importorskip("public_tokenizers")
POOLS = [
    "abc ABC 'sS'tT 12,.!?-\u2014\n\t\x1c\x85\xa0", "ÀÉîöüßçñŒ é", "\u0391\u03a3\u03c3\u03c2 .", "日本語テスト，。", "😀👍🏽 \u0301\u0323é\u0130ı\u01c5\ufb01",
    "<|startoftext|> <|endoftext|><|ENDOFTEXT|>", "\u023e\u1c89\ua7cb\U00013460\u2028\u3000", "\u0378\u0530\u0663\u2167²",
]


@pytest.fixture(scope="module")
def path():
    return public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def texts(seed=1, n=3000):
    rnd = random.Random(seed)
    out = ["", " ", "\n", "a", "<|endoftext|>", "<|endoftext|><|startoftext|>x", "a" * 5000, "ab" * 3000, "don't We'LL THEY'RE", "x" * 300 + " y"]
    for _ in range(n):
        pool = "".join(rnd.sample(POOLS, rnd.randrange(1, 4)))
        out.append("".join(rnd.choice(pool) for _ in range(rnd.randrange(40))))
    for top in (0x250, 0x530, 0xD800):
        out += ["".join(chr(rnd.randrange(32, top)) for _ in range(20)) for _ in range(n // 10)]
    return out


def test_ids_and_text_are_those_of_the_library(path, library):
    v = bpe.vocabulary(path)
    given = texts()
    for t, e in zip(given, library.encode_batch(given, add_special_tokens=False)):
        ids = v.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == e.ids, repr(t)
        assert v.decode(ids) == library.decode(e.ids, skip_special_tokens=False)


def test_forgetting_pre_tokens_changes_nothing(path, library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED", 3)
    v = bpe.Vocabulary(path)
    for t in texts(5, 200):
        assert np.frombuffer(v.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids
    assert len(v.known) <= 3 and len(v.older) <= 3


def test_rows_of_unusual_input(spark, path, library):
    docs = nasty(3)
    got = bpe.decode(bpe.encode(frame(spark, docs).withColumnRenamed("key", "ids"), path, carry=("source",)), path)
    assert got.columns == ["doc_id", "source", "n_tokens", "ids", "decoded"]
    rows = sorted(((r.doc_id, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist(), r.decoded) for r in got.collect()), key=str)
    wanted = []
    for i, t in docs:
        ids = library.encode(t or "", add_special_tokens=False).ids
        wanted.append((i, len(ids), ids, library.decode(ids, skip_special_tokens=False)))
    assert rows == sorted(wanted, key=str)


def test_empty_table_and_unknown_ids(spark, path):
    assert bpe.decode(bpe.encode(frame(spark, nasty()).limit(0), path), path).count() == 0
    assert bpe.vocabulary(path).decode(np.array([10**6, 320], "<u4").tobytes()) == bpe.vocabulary(path).strings[320]
