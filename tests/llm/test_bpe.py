import os
import random

import numpy as np
import pytest

from timberline.llm import bpe
from timberline.llm.queries import TOKENIZER

tokenizers = pytest.importorskip("tokenizers")
if not os.path.exists(TOKENIZER):
    pytest.skip("no vocabulary here", allow_module_level=True)


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def merges():
    return bpe.Merges(TOKENIZER)


TEXTS = ["", " ", "\n\n  x", "a", "aaaaaaaaa", "a" * 5001, "<|endoftext|> is text", "don't we'll I'd", "naïve café — “quoted” … 🚀👩‍💻", "中文 без пробелов 12345", "​­ ", "tab\tand  two   three    blanks ", "x1y2 0xDEADBEEF 10.0.0.1"]


def test_texts(merges, reference):
    e = bpe.Encoder(merges)
    off, ids = e.block(TEXTS + [None] + TEXTS)
    got = [ids[a:b].tolist() for a, b in zip(off, off[1:])]
    want = [reference(t) for t in TEXTS]
    assert got == want + [[]] + want


def test_random_texts_small_cache(merges, reference, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 50)
    r = random.Random(5)
    texts = ["".join(r.choice("abcdeé \n'0123.,中🚀ŋ") for _ in range(r.randint(0, 200))) for _ in range(120)]
    e = bpe.Encoder(merges)
    for i in range(0, 120, 17):
        off, ids = e.block(texts[i : i + 17])
        assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == [reference(t) for t in texts[i : i + 17]]


def test_bytes_have_letters_of_their_own():
    assert len(set(bpe.byte_letters())) == 256


def test_frame(spark, reference, monkeypatch):
    rows = [(1, "hello world"), (2, None), (3, ""), (1, "hello world"), (4, "x " * 3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {}
    for r in bpe.encode(df, TOKENIZER).collect():
        got.setdefault(r["doc_id"], r["ids"])
    assert got == {1: reference("hello world"), 2: [], 3: [], 4: reference("x " * 3000)}
    assert bpe.encode(df.limit(0), TOKENIZER).collect() == []
    assert np.array(got[1]).dtype.kind == "i"
