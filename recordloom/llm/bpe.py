"""Byte-level BPE by recursive DuckDB queries inside each task, and decoding by ordered aggregation."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import pieces

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
STEPS = 24
CACHE_WORDS = 100_000  # in each half of the cache
WORD_ROWS = 40_000
PIECE_TEXT = 512 << 10

# A row is a word with its tokens. One step contracts the leftmost pair of least rank in every word; words without a pair
# leave the recursion.
ENCODE = f"""
WITH RECURSIVE steps(step, word, tokens, done) AS (
    SELECT 0, word, tokens, false FROM state
    UNION ALL
    SELECT s.step + 1, s.word, CASE WHEN b.best IS NULL THEN s.tokens ELSE
        s.tokens[:(b.best & 4294967295) - 1] || [(b.best >> 32)::INTEGER] || s.tokens[(b.best & 4294967295) + 2:] END, b.best IS NULL
    FROM steps s LEFT JOIN (
        SELECT word, min((m.id::BIGINT << 32) | p.pos) AS best
        FROM (
            SELECT word, unnest(tokens[:-2]) AS l, unnest(tokens[2:]) AS r, generate_subscripts(tokens[2:], 1) AS pos
            FROM steps WHERE NOT done AND len(tokens) > 1
        ) p JOIN merges m ON m.l = p.l AND m.r = p.r GROUP BY word
    ) b ON b.word = s.word
    WHERE NOT s.done AND s.step < {STEPS}
)
SELECT word, tokens, done FROM steps WHERE done OR step = {STEPS}
"""

DECODE = """
SELECT row, array_to_string(list(v.text ORDER BY pos), '') AS text FROM ids JOIN vocabulary v USING (id) GROUP BY row
"""


def read_ranks(path: str) -> bytes:
    """The vocabulary file, about a megabyte; the driver reads it and tasks get its bytes."""
    with open(path, "rb") as file:
        return file.read()


class Codec:
    """Vocabulary and merge table in an in-memory DuckDB of one task, with the words met so far."""

    def __init__(self, ranks: bytes, pattern: str) -> None:
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
        self.find = regex.compile(pattern).findall
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.words: dict[str, bytes] = {}
        self.earlier: dict[str, bytes] = {}
        rows = [
            (self.ranks[token[:cut]], self.ranks[token[cut:]], rank)
            for token, rank in self.ranks.items()
            for cut in range(1, len(token))
            if token[:cut] in self.ranks and token[cut:] in self.ranks
        ]
        merges = pa.table(dict(zip("l r id".split(), map(pa.array, zip(*rows, strict=True)), strict=True)))
        texts = [token.decode("latin-1") for token in self.ranks]
        vocabulary = pa.table({"id": pa.array(list(self.ranks.values()), pa.int32()), "text": texts})
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        self.db.execute("SET temp_directory = ''")
        for name, data in (("merges", merges), ("vocabulary", vocabulary)):
            self.db.register("given", data)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")

    def learn(self, words: list[str]) -> None:
        """Put the ids of words into the cache: whole tokens and words met before directly, all others by the query."""
        rest = []
        for word in words:
            packed, rank = self.earlier.get(word), self.ranks.get(word.encode())
            if packed is not None:
                self.words[word] = packed
            elif rank is None:
                rest.append(word)
            else:
                self.words[word] = rank.to_bytes(4, "little")
        batch, size = [], 0
        for word in rest:
            batch.append(word)
            size += len(word)
            if size >= 8 * WORD_ROWS:
                self._contract(batch)
                batch, size = [], 0
        if batch:
            self._contract(batch)

    def _contract(self, words: list[str]) -> None:
        encoded = [word.encode() for word in words]
        ends = np.cumsum([0, *map(len, encoded)]).astype(np.int32)
        tokens = pa.ListArray.from_arrays(ends, self.single[np.frombuffer(b"".join(encoded), np.uint8)])
        state = pa.table({"word": np.arange(len(words), dtype=np.int32), "tokens": tokens})
        while len(state):
            self.db.register("state", state)
            found = self.db.sql(ENCODE).to_arrow_table().combine_chunks()
            self.db.unregister("state")
            done = found.filter(found.column("done"))
            if len(done):
                ids = done.column("tokens").combine_chunks()
                packed = ids.flatten().to_numpy().astype("<u4").tobytes()
                ends = (np.cumsum(pa.compute.list_value_length(ids).to_numpy()) * 4).tolist()
                start = 0
                for word, end in zip(done.column("word").to_pylist(), ends, strict=True):
                    self.words[words[word]] = packed[start:end]
                    start = end
            state = found.filter(pa.compute.invert(found.column("done"))).select(["word", "tokens"])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as packed little-endian unsigned 32-bit integers.

        Words met since the cache was last half full stay in it; the others go when it is full.
        """
        if len(self.words) > CACHE_WORDS:
            self.words, self.earlier = {}, self.words
        split = [self.find(text) for text in texts]
        self.learn(list(set().union(*split).difference(self.words)))
        return [b"".join(map(self.words.__getitem__, words)) for words in split]

    def decode(self, packed: list[bytes]) -> list[bytes]:
        """Bytes of each list of ids."""
        counts = np.fromiter((len(ids) // 4 for ids in packed), np.int64)
        ids = pa.table(
            {
                "row": np.repeat(np.arange(len(packed), dtype=np.int32), counts),
                "pos": np.arange(counts.sum(), dtype=np.int32),
                "id": np.frombuffer(b"".join(packed), "<u4").astype(np.int32),
            }
        )
        self.db.register("ids", ids)
        found = self.db.execute(DECODE).fetchall()
        self.db.unregister("ids")
        texts = dict(found)
        return [texts.get(row, "").encode("latin-1") for row in range(len(packed))]


def encode_decode(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    vocabulary: str | None = None,
    pattern: str = public_tokenizers.PATTERN,
) -> DataFrame:
    """(doc_id, ids binary, decoded binary) for every row; ids are packed little-endian unsigned 32-bit integers.

    `vocabulary` is the path of a file of base64 tokens and ranks. Null and empty texts have no ids and decode to
    nothing. Rows stay where they are: no shuffle. Texts are taken in pieces of bounded size; a word of any
    length is contracted to its fixpoint, `STEPS` contractions a query. Repeated rows come out as often as they
    went in, null ids included; an empty table gives an empty result; other columns are not read.
    """
    ranks = read_ranks(vocabulary or public_tokenizers.path(VOCABULARY))
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for piece in pieces(batches, "text", PIECE_TEXT):
            codec = codec or Codec(shared.value, pattern)
            packed = codec.encode([value or "" for value in piece.column("text").to_pylist()])
            arrays = [piece.column("doc_id"), pa.array(packed, pa.binary()), pa.array(codec.decode(packed), pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    narrow = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, ids binary, decoded binary")


def digests(coded: DataFrame) -> DataFrame:
    """Counts and digests of `encode_decode`."""
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
