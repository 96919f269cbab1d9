"""Problem 7: encoding of the whole corpus with a public byte-level BPE vocabulary.

A text is split by the vocabulary's public pattern.  Each piece is encoded by a
backtracking walk: an Aho-Corasick automaton over the vocabulary gives the longest
token at each byte; a token is accepted if it is compatible with the one before it,
else the next shorter one is tried, and as a last resort the walk steps back.  A
dead position is never visited twice, so a piece takes linear time.  Two tokens are
compatible if no merge across their boundary would come before the merges that made
them; this decides that the walk's result is the one of the exact merge order.

Decoding reads the bytes of all tokens from one buffer by an offset table.

Defined results: null and empty texts give an empty list; repeated rows and ties do
not matter; there are no special tokens, their strings are ordinary text.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from math import inf

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.plans.shared import table

#: Default place of the public vocabulary; another may be given as a parameter.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public split pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A blank with ink on both sides: every match of the pattern ends before it.
BETWEEN = re.compile(r"(?<=\S) (?=\S)")
UNEVEN = re.compile(r"\s | \s|^ | $")
#: Pieces remembered by a worker; the memory is emptied when it is full, results don't change.
MEMORY = 400_000


class Encoder:
    """Exact BPE of single pieces, with memory of the pieces seen."""

    def __init__(self, path: str):
        self.rank: dict[bytes, int] = {}
        with open(path, "rb") as lines:
            for line in lines:
                token, rank = line.split()
                self.rank[base64.b64decode(token)] = int(rank)
        size = max(self.rank.values()) + 1
        self.token = [b""] * size
        self.trie = ahocorasick.Automaton()
        for token, rank in self.rank.items():
            self.token[rank] = token
            self.trie.add_word(token.decode("latin-1"), len(token))
        self.trie.make_automaton()
        self.starts = np.concatenate([[0], np.cumsum([len(t) for t in self.token])]).astype(np.int64)
        self.bytes = np.frombuffer(b"".join(self.token), dtype=np.uint8)
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.spines: dict[tuple[int, bool], list[tuple[int, float]]] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.split = regex.compile(PATTERN)
        self.forget()

    def forget(self) -> None:
        self.seen: dict[str | tuple[str], int] = {}
        self.flat, self.ends = array("i"), array("q", [0])

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for a single byte."""
        if token in self.halves:
            return self.halves[token]
        pieces = [self.token[token][i : i + 1] for i in range(len(self.token[token]))]
        while len(pieces) > 2:
            ranks = [self.rank.get(a + b, inf) for a, b in zip(pieces, pieces[1:])]
            k = ranks.index(min(ranks))
            if ranks[k] == inf:
                break
            pieces[k : k + 2] = [pieces[k] + pieces[k + 1]]
        out = (self.rank[pieces[0]], self.rank[pieces[1]]) if len(pieces) == 2 else None
        self.halves[token] = out
        return out

    def spine(self, token: int, right: bool) -> list[tuple[int, float]]:
        """The tokens that stood at this edge of ``token`` while it was made, each with the time its own merge ended it."""
        key = (token, right)
        if key not in self.spines:
            line, until = [], inf
            at: int | None = token
            while at is not None:
                line.append((at, until))
                until, parts = at, self.parts(at)
                at = parts[right] if parts else None
            self.spines[key] = line
        return self.spines[key]

    def compatible(self, left: int, right: int) -> bool:
        key = (left, right)
        known = self.fits.get(key)
        if known is None:
            known = True
            for a, a_until in self.spine(left, True):
                for b, b_until in self.spine(right, False):
                    merged = self.rank.get(self.token[a] + self.token[b])
                    if merged is not None and merged < a_until and merged <= b_until and self.parts(merged) == (a, b):
                        known = False
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            self.fits[key] = known
        return known

    def encode_piece(self, piece: str) -> list[int]:
        data = piece.encode("utf-8")
        whole = self.rank.get(data)
        if whole is not None:
            return [whole]
        size = len(data)
        longest = [1] * size
        for end, length in self.trie.iter(data.decode("latin-1")):
            start = end - length + 1
            if length > longest[start]:
                longest[start] = length
        dead = bytearray(size + 1)
        out: list[int] = []
        at, length = 0, longest[0]
        while at < size:
            while length:
                token = self.rank.get(data[at : at + length]) if not dead[at + length] else None
                if token is not None and (not out or self.compatible(out[-1], token)):
                    break
                length -= 1
            if length:
                out.append(token)
                at += length
                length = longest[at] if at < size else 0
            else:
                dead[at] = 1
                length = len(self.token[out.pop()])
                at -= length
                length -= 1
        return out

    def _learn(self, key: str | tuple[str]) -> None:
        """Remember the ids of a run between blanks; a text's first run comes as a tuple, others had a blank before."""
        run = key[0] if isinstance(key, tuple) else " " + key
        self.seen[key] = len(self.ends) - 1
        for piece in self.split.findall(run):
            self.flat.extend(self.encode_piece(piece))
        self.ends.append(len(self.flat))

    def _numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all runs of all texts, and how many runs each text has."""
        if len(self.seen) > MEMORY:
            self.forget()
        lists: list[list] = []
        for text in texts:
            runs: list = [] if not text else BETWEEN.split(text) if UNEVEN.search(text) else text.split(" ")
            if runs:
                runs[0] = (runs[0],)
            lists.append(runs)
        for key in set(chain.from_iterable(lists)).difference(self.seen):
            self._learn(key)
        counts = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        numbers = np.fromiter(map(self.seen.__getitem__, chain.from_iterable(lists)), dtype=np.int64, count=int(counts.sum()))
        return numbers, counts

    def _remembered(self) -> tuple[np.ndarray, np.ndarray]:
        """The remembered ids and the ends of each run's, without a copy; to be let go before the next run is learnt."""
        return np.frombuffer(self.flat, dtype=np.int32), np.frombuffer(self.ends, dtype=np.int64)

    def lengths(self, texts: list[str | None]) -> np.ndarray:
        numbers, counts = self._numbers(texts)
        ends = self._remembered()[1]
        sums = np.concatenate([[0], np.cumsum((ends[1:] - ends[:-1])[numbers])])
        stops = np.cumsum(counts)
        return sums[stops] - sums[stops - counts]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the offsets of each text in them."""
        numbers, counts = self._numbers(texts)
        flat, ends = self._remembered()
        sizes = (ends[1:] - ends[:-1])[numbers]
        stops = np.cumsum(sizes)
        places = np.arange(stops[-1] if len(stops) else 0) + np.repeat(ends[numbers] - (stops - sizes), sizes)
        offsets = np.concatenate([[0], stops])[np.concatenate([[0], np.cumsum(counts)])]
        return flat[places], offsets

    def decode(self, ids) -> str:
        ids = np.asarray(ids, dtype=np.int64)
        sizes = self.starts[ids + 1] - self.starts[ids]
        stops = np.cumsum(sizes)
        places = np.arange(stops[-1] if len(stops) else 0) + np.repeat(self.starts[ids] - (stops - sizes), sizes)
        return self.bytes[places].tobytes().decode("utf-8")


@lru_cache(maxsize=2)
def encoder(path: str = VOCABULARY) -> Encoder:
    return Encoder(path)


def _slices(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def encode_texts(df: DataFrame, id_col: str, text_col: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id_col, ids array<int>) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(vocabulary)
        for whole in batches:
            for batch in _slices(whole):
                ids, offsets = tool.encode(batch.column(1).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[id_col, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def token_counts(df: DataFrame, id_col: str, text_col: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id_col, tokens bigint) of every row: the length of its encoding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(vocabulary)
        for whole in batches:
            for batch in _slices(whole):
                sizes = tool.lengths(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes.astype(np.int64))], names=[id_col, "tokens"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, tokens bigint")


def decode_ids(df: DataFrame, id_col: str, ids_col: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id_col, text) of every row of token ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(vocabulary)
        for batch in batches:
            texts = [None if ids is None else tool.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, text string")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"), "doc_id", "text")


def p7_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): every text as decoding its ids gives it; null counts as empty."""
    return decode_ids(p7_ids(spark, sf_dir), "doc_id", "ids").select("doc_id", "text")
