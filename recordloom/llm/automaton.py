"""Byte-level BPE by a deterministic automaton over tokens, compiled merge by merge; decoding emits its arc labels."""

from __future__ import annotations

import json
import re
import struct
from collections import ChainMap
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import pieces

VOCABULARY = "byte_bpe_50k.json"
# Held in memory for each task: two halves of the word cache, and the longest word that goes in.
CACHE_WORDS = 200_000
CACHED_CHARS = 64


class FollowTable:
    """Which token may follow which: the automaton's arcs, as classes of tokens and one bit for each two classes.

    The state after a token is the class of tokens with the same arcs out; tokens entered from the same states share a
    class as well. A set bit means that there is no arc.
    """

    def __init__(self, tokens: int, base: Iterable[int]) -> None:
        self.out, self.entry = np.zeros(tokens, np.int32), np.zeros(tokens, np.int32)
        self.alive = np.zeros(tokens, bool)
        self.alive[list(base)] = True
        self.out_size, self.entry_size = [int(self.alive.sum())], [int(self.alive.sum())]
        self.bits = np.zeros((1024, 256), np.uint8)

    def allows(self, left: int, right: int) -> bool:
        place = int(self.entry[right])
        return not self.bits[self.out[left], place >> 3] >> (place & 7) & 1

    def add_merge(self, left: int, right: int, merged: int) -> None:
        """The gadget of one merge: left followed by right gives way to one arc with both labels joined.

        Wherever left is entered, merged is entered too, and leaves where right leaves; then left loses its arc to
        right. Of left = right, merged keeps the arcs out from before the loss, and a left that has lost the arc has
        none to merged either: pairs are then taken from the left, as in aaa. A merge whose parts never meet adds
        nothing.
        """
        if not (self.alive[left] and self.alive[right] and self.allows(left, right)):
            return
        self.alive[merged] = True
        self.out[merged] = self.out[right]
        self.out_size[self.out[right]] += 1
        self._own_out(left)
        self._own_entry(right)
        place = int(self.entry[right])
        self.bits[self.out[left], place >> 3] |= 1 << (place & 7)
        self.entry[merged] = self.entry[left]
        self.entry_size[self.entry[left]] += 1

    def _own_out(self, token: int) -> None:
        """Give a token a state of its own, with the arcs it shared."""
        old, new = int(self.out[token]), len(self.out_size)
        if self.out_size[old] == 1:
            return
        if new == len(self.bits):
            self.bits = np.concatenate([self.bits, np.zeros_like(self.bits)])
        self.bits[new] = self.bits[old]
        self.out_size[old] -= 1
        self.out_size.append(1)
        self.out[token] = new

    def _own_entry(self, token: int) -> None:
        old, new = int(self.entry[token]), len(self.entry_size)
        if self.entry_size[old] == 1:
            return
        if new == 8 * self.bits.shape[1]:
            self.bits = np.concatenate([self.bits, np.zeros_like(self.bits)], axis=1)
        states = self.bits[: len(self.out_size)]
        states[:, new >> 3] |= (states[:, old >> 3] >> (old & 7) & 1) << (new & 7)
        self.entry_size[old] -= 1
        self.entry_size.append(1)
        self.entry[token] = new


@dataclass
class Automaton:
    """What tasks need: labels of the arcs, their classes and the bits of the follow table, row by row."""

    labels: dict[int, bytes]
    added: dict[str, int]
    out: np.ndarray
    entry: np.ndarray
    width: int
    bits: bytes


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes: visible Latin-1 characters for themselves, the others from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [byte for byte in range(256) if byte not in visible]
    return {chr(byte): byte for byte in visible} | {chr(0x100 + i): byte for i, byte in enumerate(others)}


def compile_automaton(definition: str) -> Automaton:
    """Compile a tokenizer definition (JSON of a byte-level BPE) merge by merge. Runs once, on the driver.

    The table has at most one state and one entry class for each merge; for 50,000 merges it takes 19 MB.
    """
    parts = json.loads(definition)
    model, added = parts["model"], parts.get("added_tokens", [])
    splitter = parts.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or splitter.get("type") != "ByteLevel" or splitter.get("add_prefix_space"):
        raise ValueError("a byte-level BPE without a prefix space is needed")
    if parts.get("normalizer") or any(token[key] for token in added for key in ("lstrip", "rstrip", "single_word")):
        raise ValueError("normalizers and added tokens that take in their surroundings are not supported")
    alphabet, ids = byte_alphabet(), model["vocab"]
    merges = [tuple(merge.split(" ")) if isinstance(merge, str) else tuple(merge) for merge in model["merges"]]
    base = [ids[char] for char in alphabet]
    table = FollowTable(max(ids.values()) + 1, base)
    for left, right in merges:
        table.add_merge(ids[left], ids[right], ids[left + right])
    labels = {i: bytes(alphabet[char] for char in text) for text, i in ids.items() if table.alive[i]}
    width = (len(table.entry_size) + 7) // 8
    bits = np.ascontiguousarray(table.bits[: len(table.out_size), :width]).tobytes()
    return Automaton(labels, {token["content"]: token["id"] for token in added}, table.out, table.entry, width, bits)


def pack(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class Codec:
    """The automaton at work in one task: a trie of labels to find arcs, and the words met lately."""

    def __init__(self, automaton: Automaton, pattern: str) -> None:
        self.find = regex.compile(pattern).findall
        self.bits = automaton.bits
        self.row = (automaton.out.astype(np.int64) * automaton.width).tolist()
        self.byte = (automaton.entry >> 3).tolist()
        self.mask = (1 << (automaton.entry & 7)).tolist()
        self.trie: dict = {}
        for token, label in automaton.labels.items():
            node = self.trie
            for symbol in label:
                node = node.setdefault(symbol, {})
            node[None] = token
        self.longest = max(map(len, automaton.labels.values()))
        marks = sorted(automaton.added, key=len, reverse=True)
        self.split = re.compile("(" + "|".join(map(re.escape, marks)) + ")").split if marks else None
        self.added = {mark: i.to_bytes(4, "little") for mark, i in automaton.added.items()}
        self.labels = [b""] * (1 + max([*automaton.labels, *automaton.added.values()]))
        for token, label in automaton.labels.items():
            self.labels[token] = label
        for mark, token in automaton.added.items():
            self.labels[token] = mark.encode()
        self.recent: dict[str, bytes] = dict(self.added)
        self.earlier: dict[str, bytes] = {}

    def path(self, word: bytes) -> list[int]:
        """Tokens of the one path that spells the word.

        The longest arc is tried first. A place in the word is reached by one path alone, so one that leads nowhere is
        never entered again and the work stays in proportion to the word.
        """
        trie, row, byte, mask, bits, labels, longest = (
            self.trie, self.row, self.byte, self.mask, self.bits, self.labels, self.longest
        )
        tokens, waiting, place, state = [], [], 0, -1
        while place < len(word):
            # tokens that spell the word from here on, shortest first
            found, node = [], trie
            for symbol in word[place : place + longest]:
                node = node.get(symbol)
                if node is None:
                    break
                if None in node:
                    found.append(node[None])
            while True:
                if not found:
                    found = waiting.pop()
                    place -= len(labels[tokens.pop()])
                    state = row[tokens[-1]] if tokens else -1
                    continue
                token = found.pop()
                if state < 0 or not bits[state + byte[token]] & mask[token]:
                    break
            waiting.append(found)
            tokens.append(token)
            place += len(labels[token])
            state = row[token]
        return tokens

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """Put packed ids of words into the cache; those of long words are returned instead."""
        long = {}
        for word in words:
            packed = self.earlier.get(word)
            if packed is None:
                packed = pack(self.path(word.encode()))
            (self.recent if len(word) <= CACHED_CHARS else long)[word] = packed
        return long

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as packed little-endian unsigned 32-bit integers.

        Words met since the cache was last half full stay in it; the others go when it is full.
        """
        results = []
        for text in texts:
            if len(self.recent) > CACHE_WORDS:
                self.recent, self.earlier = dict(self.added), self.recent
            words = []
            for i, part in enumerate(self.split(text) if self.split else [text]):
                words += [part] if i % 2 else self.find(part)
            long = self.learn(set(words).difference(self.recent))
            known = ChainMap(self.recent, long) if long else self.recent
            results.append(b"".join(map(known.__getitem__, words)))
        return results

    def decode(self, packed: bytes) -> bytes:
        """Bytes of a list of ids: the labels of its arcs, one after the other."""
        return b"".join(map(self.labels.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def encode_decode(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    definition: str | None = None,
    pattern: str = public_tokenizers.PATTERN,
) -> DataFrame:
    """(doc_id, ids binary, decoded string) for every row; ids are packed little-endian unsigned 32-bit integers.

    `definition` is the path of a tokenizer definition in JSON. Its added tokens are found in the texts first and keep
    their ids; what lies between is split into words by `pattern`, and each word takes the path of the automaton that
    spells it. Null and empty texts have no ids and decode to the empty text. Rows stay where they are: no shuffle.
    Texts are taken in pieces of bounded size and a word of any length in time proportional to it. Repeated rows come
    out as often as they went in, null ids included; an empty table gives an empty result; other columns are not read.
    """
    with open(definition or public_tokenizers.path(VOCABULARY), encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(compile_automaton(file.read()))
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for piece in pieces(batches, "text"):
            codec = codec or Codec(shared.value, pattern)
            packed = codec.encode([value or "" for value in piece.column("text").to_pylist()])
            texts = [codec.decode(ids).decode("utf-8", "replace") for ids in packed]
            arrays = [piece.column("doc_id"), pa.array(packed, pa.binary()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    narrow = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, ids binary, decoded string")


def digests(coded: DataFrame) -> DataFrame:
    """Counts and digests of `encode_decode`."""
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
