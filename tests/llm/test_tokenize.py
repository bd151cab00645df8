import os
import random

import pytest
from pyspark.sql import functions as F

from newsloom.llm import tokenize as t
from newsloom.llm.bpe_automaton import TOKENIZERS, BpeAutomaton, automaton

HAVE = os.path.exists(f"{TOKENIZERS}/byte_bpe_50k.json")
pytestmark = pytest.mark.skipif(not HAVE, reason="no vocabulary files")

TEXTS = ["", " ", "Hello world's  end\n\n x", "aaaa" * 500, "<|endoftext|> a", "é日本語한 हिन्दी ไทย​👩🏽‍💻", "\x00퟿", "1234567890" * 30, "=" * 1000, "It’s 'twas I'll we've", "\t\t \r\n", "ab" * 5000]


def reference(texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    tok.encode_special_tokens = True
    return [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_same_ids_as_the_public_library():
    rng = random.Random(7)
    texts = TEXTS + ["".join(rng.choice("aeinorst hlTHE'’.,01\n日本ก") for _ in range(rng.randint(0, 80))) for _ in range(2000)]
    a = automaton()
    mine = [a.encode(x) for x in texts]
    assert mine == reference(texts)
    assert [a.decode(m) for m in mine] == texts


def test_other_vocabulary_by_brute_force():
    """Merges applied one after another, on a small vocabulary of runs and overlaps."""
    merges = [(b"a", b"a"), (b"aa", b"a"), (b"b", b"a"), (b"a", b"b"), (b"aa", b"aa"), (b"ba", b"b"), (b"ab", b"ab"), (b"c", b"c"), (b"cc", b"c"), (b"aaa", b"b")]
    tokens = [bytes([k]) for k in range(256)] + [x + y for x, y in merges]
    vocab = {b: k for k, b in enumerate(dict.fromkeys(tokens))}
    a = BpeAutomaton(vocab, merges, pattern=r"[\s\S]+")

    def brute(word):
        parts = [bytes([x]) for x in word.encode()]
        for x, y in merges:
            k = 0
            while k < len(parts) - 1:
                if parts[k] == x and parts[k + 1] == y:
                    parts[k : k + 2] = [x + y]
                k += 1
        return [vocab[p] for p in parts]

    rng = random.Random(3)
    for _ in range(3000):
        w = "".join(rng.choice("aaabbc") for _ in range(rng.randint(1, 14)))
        assert a.encode(w) == brute(w), w


def test_columns(spark):
    df = spark.createDataFrame([(1, "Hello", "x"), (2, None, "x"), (3, "", "x"), (3, "", "x"), (None, "a", "x")], "doc_id long, text string, ids string")
    got = sorted((r.doc_id or 0, r.ids) for r in t.encode_corpus(df).collect())
    assert got == [(0, automaton().encode("a")), (1, automaton().encode("Hello")), (2, []), (3, []), (3, [])]
    assert t.encode_corpus(df.limit(0)).count() == 0
    back = df.select("text", t.decode_udf()(t.token_ids("text")).alias("b"), t.token_count("text").alias("n")).collect()
    assert all((r.text or "") == r.b for r in back) and back[1].n == 0


def test_memory_bound_changes_nothing():
    small = BpeAutomaton.load()
    small.memory = 3
    text = " ".join(f"word{k} other{k}" for k in range(300))
    assert small.encode(text) == automaton().encode(text)
