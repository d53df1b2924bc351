"""The transducer against the definition of BPE, and against the installed tokenizers."""

import os
import random
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codexmill.llm import bpe
from codexmill.llm.bpe import Tokenizer, Utf8Machine
from codexmill.llm.tokenize import count_tokens, decode_ids, encode_texts, vocabulary_path

PATH = vocabulary_path()
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary here")


@pytest.fixture(scope="module")
def tk():
    return Tokenizer.load(PATH)


@pytest.fixture(scope="module")
def public():
    return loaded()


def ids(tk, text):
    return np.frombuffer(tk.encode_bytes(text), "<i4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.binary(min_size=1, max_size=40))
def test_transducer_is_bpe(word):
    t = Tokenizer.load(PATH).transducer
    assert t.encode(word) == t.merge(word)


def test_states_are_bounded_within_a_word(tk, monkeypatch):
    r = random.Random(2)
    word = "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=20_000)).encode()
    t = tk.transducer
    want = t.encode(word)
    monkeypatch.setattr(bpe, "STATES", 200)
    t._reset()
    assert t.encode(word) == want and len(t.states) <= 201
    assert t.encode(word[:3000]) == t.merge(word[:3000])


@lru_cache
def loaded():
    t = pytest.importorskip("tokenizers").Tokenizer.from_file(vocabulary_path(name="byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60))
def test_any_text_equals_public_tokenizer(text):
    assert ids(Tokenizer.load(PATH), text) == loaded().encode(text, add_special_tokens=False).ids


def test_odd_texts(tk, public):
    texts = ["", " ", "  a  b ", "\n \n\tx", "<|endoftext|>", "a" * 20_000, " " * 5_000, "x　 y\x85z \x1c q", "'s 't're", "é" * 999, "日本語。テキスト", "1234567 ½ ²"]
    random.seed(3)
    texts += ["".join(random.choices("aab  \n\t'.é日1", k=50)) for _ in range(300)]
    for text in texts:
        assert ids(tk, text) == public.encode(text, add_special_tokens=False).ids, text[:40]


def test_decoding_streams_and_replaces(tk):
    m = Utf8Machine(tk.transducer.bytes_of)
    for text in ["", "añ日𝄞 b\r\n", "�"]:
        assert m.decode(ids(tk, text)) == text
    random.seed(5)
    for _ in range(3000):
        b = bytes(random.choices([0x41, 0x80, 0xBF, 0xC2, 0xE0, 0xA0, 0xED, 0x9F, 0xF0, 0x90, 0xF4, 0x8F, 0xFF, 0xC0], k=7))
        text, state = m.feed(b"", b)
        assert text + ("�" if state else "") == b.decode("utf-8", "replace")
    assert m.decode([10**9]) == "�"


def test_operators(spark, tk):
    rows = [(1, "Hello world", 7), (2, None, 7), (3, "", 7), (4, " \n", 7), (1, "Hello world", 7), (None, "x" * 100_000, 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, _text int")
    got = encode_texts(df, "text", ["doc_id"]).collect()
    assert sorted((r.doc_id or 0, len(r.ids)) for r in got) == sorted((d or 0, tk.count(t)) for d, t, _ in rows)
    assert [r.ids for r in got if r.doc_id in (2, 3)] == [[], []]
    assert sorted(r.n_tokens for r in count_tokens(df, "text", ["doc_id"]).collect()) == sorted(tk.count(t) for _, t, _ in rows)
    back = decode_ids(encode_texts(df, "text", ["doc_id", "text"]), "ids", ["text"]).collect()
    assert all(r.decoded == (r.text or "") for r in back)
    assert encode_texts(df.limit(0), "text", ["doc_id"]).count() == 0
