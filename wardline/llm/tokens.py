"""Exact byte-level BPE ids by dynamic programming over prefixes.

Every prefix of a piece has one encoding, hence one last token. An automaton over the
vocabulary lists the tokens that end at each byte; the one whose predecessor (the last
token of the prefix before it) is compatible with it is the last token of the prefix.
Following the stored last tokens back from the end gives the ids, in one linear pass
and without applying merges.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from functools import cache, lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pieces kept in a worker's memory; the memory is emptied when it is full.
PIECES_KEPT = 100_000
#: Answers on pairs of tokens kept in a worker's memory.
PAIRS_KEPT = 200_000
#: Longer pieces (in characters) are encoded anew each time.
PIECE_KEPT_CHARS = 40


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a vocabulary of the public tokenizers installed on every worker."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write each byte as one visible character: printable
    Latin-1 bytes as themselves, the others in order as the characters from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class PrefixEncoder:
    """The tables of one vocabulary: automaton, merges and the spines of the merge trees."""

    def __init__(self, path: str, pattern: str) -> None:
        import ahocorasick
        import regex

        model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
        vocab: dict[str, int] = model["vocab"]
        as_byte = _byte_of_char()
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merged: dict[tuple[int, int], int] = {}
        parts: dict[int, tuple[int, int]] = {}
        for left, right in pairs:
            whole = vocab[left + right]
            self.merged[vocab[left], vocab[right]] = whole
            parts.setdefault(whole, (vocab[left], vocab[right]))
        self.parts = parts
        self.automaton = ahocorasick.Automaton()
        reachable = {vocab[c] for c in as_byte if c in vocab} | parts.keys()
        for token, number in vocab.items():
            if number in reachable:
                self.automaton.add_word("".join(chr(as_byte[c]) for c in token), (number, len(token)))
        self.automaton.make_automaton()
        self.split = regex.compile(pattern).findall
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.compatible = lru_cache(PAIRS_KEPT)(self._compatible)

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """(part, rank of the merge that consumes it) down one edge of the token's merge tree."""
        spine, ends = [], sys.maxsize
        while True:
            spine.append((token, ends))
            if token not in self.parts:
                return spine
            token, ends = self.parts[token][side], token

    def _compatible(self, left: int, right: int) -> bool:
        """True if the two tokens stay apart when their texts are encoded together: no merge
        across the border comes up while both of its parts exist. At equal ranks the
        leftmost merge goes first. Ids are merge ranks."""
        for a, a_ends in self._spine(left, 1):
            for b, b_ends in self._spine(right, 0):
                across = self.merged.get((a, b))
                if across is not None and across < a_ends and across <= b_ends:
                    return False
        return True

    def piece(self, text: str) -> tuple[int, ...]:
        data = text.encode("utf-8", "surrogatepass").decode("latin-1")
        n = len(data)
        last, start = [-1] * (n + 1), [0] * (n + 1)
        for end, (token, length) in self.automaton.iter(data):
            at = end + 1
            if last[at] >= 0:
                continue  # the last token of this prefix is known, and it is the only one
            before = at - length
            if before == 0 or (last[before] >= 0 and self.compatible(last[before], token)):
                last[at], start[at] = token, before
        ids, at = [], n
        while at > 0:
            if last[at] < 0:
                raise ValueError(f"the vocabulary has no tokens for {text!r}")
            ids.append(last[at])
            at = start[at]
        return tuple(reversed(ids))

    def encode(self, text: str | None) -> list[int]:
        ids: list[int] = []
        pieces = self.pieces
        for piece in self.split(text or ""):
            found = pieces.get(piece)
            if found is None:
                found = self.piece(piece)
                if len(piece) <= PIECE_KEPT_CHARS:
                    if len(pieces) >= PIECES_KEPT:
                        pieces.clear()
                    pieces[piece] = found
            ids.extend(found)
        return ids


@cache
def encoder(path: str, pattern: str) -> PrefixEncoder:
    return PrefixEncoder(path, pattern)


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def token_ids(df: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``df`` with the column ``ids``: the token ids of ``text`` without special tokens.

    Empty and null texts both give an empty list. Whole texts are encoded; strings of
    special tokens in a text are ordinary text. ``path`` and ``pattern`` default to the
    public vocabulary byte_bpe_50k and its pattern. All other columns and all rows are
    kept, repeated ones too; a column named like ``ids`` is replaced. An empty table
    gives an empty one.
    """
    path, pattern = path or vocabulary_path(), pattern or _pattern()
    kept = [i for i, c in enumerate(df.columns) if c.lower() != ids.lower()]
    schema = T.StructType([*[df.schema.fields[i] for i in kept], T.StructField(ids, T.ArrayType(T.IntegerType()))])
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, pattern).encode
        for batch in batches:
            lists = [encode(t) for t in batch.column(at).to_pylist()]
            offsets = np.zeros(len(lists) + 1, np.int32)
            np.cumsum([len(x) for x in lists], out=offsets[1:])
            flat = np.fromiter((i for x in lists for i in x), np.int32, int(offsets[-1]))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=schema.names)

    return df.mapInArrow(run, schema)


def token_counts(df: DataFrame, text: str = "text", count: str = "tokens", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``df`` without ``text`` and with the number of its tokens (0 for empty and null); see ``token_ids``. A column named like ``count`` is replaced."""
    return token_ids(df.drop(count) if count != text else df, text, "__ids", path, pattern).withColumn("__n", F.size("__ids").cast("long")).drop("__ids", text).withColumnRenamed("__n", count)
