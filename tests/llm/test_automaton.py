import hashlib
import itertools
import json
import random
import time

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from recordloom.llm import automaton
from recordloom.llm.queries import op13_automaton

SMALL = "/root/testdata/sf0.001"
PATH = public_tokenizers.path(automaton.VOCABULARY)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def codec():
    with open(PATH, encoding="utf-8") as file:
        return automaton.Codec(automaton.compile_automaton(file.read()), public_tokenizers.PATTERN)


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


def by_rank(word, merges):
    """Merges one at a time: the leftmost pair of least rank, until none is left."""
    tokens = list(word)
    while True:
        ranked = [(merges.index(pair), i) for i, pair in enumerate(itertools.pairwise(tokens)) if pair in merges]
        if not ranked:
            return tokens
        _, i = min(ranked)
        tokens[i : i + 2] = [tokens[i] + tokens[i + 1]]


def test_every_short_word_of_random_small_vocabularies():
    random.seed(2)
    for _ in range(40):
        tokens, merges = list("ab"), []
        for _ in range(random.randint(1, 8)):
            pair = random.choice(tokens), random.choice(tokens)
            if pair[0] + pair[1] not in tokens:
                tokens.append(pair[0] + pair[1])
                merges.append(pair)
        vocab = {char: i for i, char in enumerate(automaton.byte_alphabet())}
        vocab |= {token: 256 + i for i, token in enumerate(tokens[2:])}
        definition = {"model": {"type": "BPE", "vocab": vocab, "merges": merges}, "pre_tokenizer": {"type": "ByteLevel"}}
        codec = automaton.Codec(automaton.compile_automaton(json.dumps(definition)), ".+")
        for n in range(1, 9):
            for word in map("".join, itertools.product("ab", repeat=n)):
                assert codec.path(word.encode()) == [vocab[token] for token in by_rank(word, merges)], (word, merges)


def test_matches_the_library_on_all_code_points(codec, library):
    chars = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    texts = ["".join(f"a{c} {c}1{c}{c} " for c in chars[i : i + 64]) for i in range(0, len(chars), 64)]
    packed = codec.encode(texts)
    assert [ids(one) for one in packed] == [one.ids for one in library.encode_batch(texts, add_special_tokens=False)]
    assert [codec.decode(one).decode() for one in packed] == texts


def test_matches_the_library_on_random_texts(codec, library):
    random.seed(4)
    parts = [*"ab  \n\t'sdmtre1-=/é中́‍\U0001f600<|>", "<|endoftext|>", "'ll", "\r\n", "　"]
    texts = ["".join(random.choices(parts, k=random.randint(0, 40))) for _ in range(5_000)]
    expected = [one.ids for one in library.encode_batch(texts, add_special_tokens=False)]
    packed = codec.encode(texts)
    assert [ids(one) for one in packed] == expected
    assert [codec.decode(one).decode("utf-8", "replace") for one in packed] == library.decode_batch(expected, skip_special_tokens=False)


def test_words_of_a_million_letters(codec, library):
    random.seed(6)
    for word in ("a" * 1_000_000, "-" * 1_000_000, "ab" * 500_000, "".join(random.choices("abcdefgh", k=1_000_000))):
        started = time.process_time()
        assert ids(codec.encode([word])[0]) == library.encode(word, add_special_tokens=False).ids
        assert time.process_time() - started < 60


def test_words_leave_a_full_cache(codec, library, monkeypatch):
    monkeypatch.setattr(automaton, "CACHE_WORDS", 20)
    texts = [f"word{i} other{i % 7} the <|endoftext|>" for i in range(60)]
    assert [ids(one) for one in codec.encode(texts)] == [one.ids for one in library.encode_batch(texts, add_special_tokens=False)]
    assert len(codec.recent) + len(codec.earlier) < 100


def test_query_on_the_small_table(spark, library):
    texts = {row.doc_id: row.text or "" for row in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = op13_automaton(spark, SMALL).collect()
    assert len(rows) == len(texts)
    for row in rows:
        expected = library.encode(texts[row.doc_id], add_special_tokens=False).ids
        assert row.n_tokens == len(expected)
        assert row.ids_sha256 == hashlib.sha256(np.array(expected, "<u4").tobytes()).hexdigest()
        decoded = library.decode(expected, skip_special_tokens=False)
        assert row.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_odd_rows(spark, plan_of):
    rows = [(1, None), (2, ""), (None, "no id"), (3, "twice"), (3, "twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS ids", "1 AS decoded")
    coded = automaton.encode_decode(docs)
    found = sorted((row.doc_id or 0, len(row.ids) // 4, row.decoded) for row in coded.collect())
    assert found == [(0, 2, "no id"), (1, 0, ""), (2, 0, ""), (3, 2, "twice"), (3, 2, "twice")]
    assert automaton.encode_decode(docs.limit(0)).collect() == []
    assert "Exchange" not in plan_of(coded)


def test_other_kinds_of_tokenizer_are_refused():
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": None}, {"model": {"type": "Unigram"}}):
        with pytest.raises(ValueError):
            automaton.compile_automaton(json.dumps({"model": {"type": "BPE"}, "pre_tokenizer": {"type": "ByteLevel"}} | change))
