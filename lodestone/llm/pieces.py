"""SentencePiece encoding and decoding with a given vocabulary: Aho-Corasick automaton and single-pass Viterbi.

The automaton over all pieces reads a text once; at each position its output links give every
piece that ends there, and each relaxes the best score of the position. Characters that no piece
covers cost ``least score - 10`` and become byte pieces. Ties keep the longer last piece.

Spaces become U+2581 and one is put in front of the text. Where no piece of the vocabulary
crosses a word's start (or a character that is in no piece), the best path does not cross it
either, so texts are cut there and the paths of words are remembered, up to a bounded number. Where no
piece goes on from a letter to anything else, words are cut after their letters too, so that a word with and without
a comma is one.

A literal U+2581 in a text is sent as bytes, so that decoding gives every text back exactly.

Defined results: null and empty texts have no pieces; repeated rows are encoded each; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm.common import left_by, release_unused

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"


class Codec:
    """Encodes and decodes with the pieces and scores of a SentencePiece model that has byte pieces."""

    def __init__(self, model: bytes, remembered: int = 150_000):
        import ahocorasick
        import sentencepiece

        told = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.automaton, self.surface, self.byte_id, self.remembered = ahocorasick.Automaton(), [], {}, remembered
        pieces, least = [], 0.0
        for i in range(told.get_piece_size()):
            piece = told.id_to_piece(i)
            if told.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.surface.append(bytes([int(piece[3:5], 16)]))
            elif told.is_control(i) or told.is_unknown(i) or told.is_unused(i):
                self.surface.append(b"")
            else:
                self.surface.append(piece.replace(SPACE, " ").encode())
                pieces.append(piece)
                least = min(least, told.get_score(i))
                self.automaton.add_word(piece, (len(piece), i, told.get_score(i)))
        if len(self.byte_id) < 256:
            raise ValueError("the vocabulary has no byte pieces")
        self.automaton.make_automaton()
        self.unknown = least - 10.0
        inner = any(SPACE in p.lstrip(SPACE) for p in pieces)
        newline = any("\n" in p for p in pieces)
        self.cut = re.compile(f"[{SPACE}]" if inner and newline else f"[^{SPACE}]+" if inner else f"{SPACE}*[^{SPACE}]*" if newline else _words(pieces))
        self.whole = inner
        self.paths: dict[str, tuple[int, ...]] = {}

    def viterbi(self, text: str) -> tuple[int, ...]:
        """The best path over ``text``, in which spaces are U+2581 already."""
        at = len(text) - 1
        best, last_piece = [float("-inf")] * len(text) + [0.0], [None] * len(text)  # by last position; that before the first is the list's end
        for last, piece in self.automaton.iter(text):
            value = best[last - piece[0]] + piece[2]
            if value > best[last]:
                best[last], last_piece[last] = value, piece
        if None in last_piece:
            return self.with_unknown(text)
        ids: list[int] = []
        while at >= 0:
            size, i, _ = last_piece[at]
            ids.append(i)
            at -= size
        return tuple(reversed(ids))

    def with_unknown(self, text: str) -> tuple[int, ...]:
        """The best path over a ``text`` that may have characters in no piece."""
        n = len(text)
        best, back = [0.0] + [float("-inf")] * n, [None] * (n + 1)
        done, unknown = 0, self.unknown  # positions up to ``done`` are final

        def settle(upto: int) -> None:
            for p in range(done + 1, upto + 1):
                if best[p - 1] + unknown > best[p]:
                    best[p], back[p] = best[p - 1] + unknown, (1, None)

        for last, (size, i, score) in self.automaton.iter(text):
            if last > done:
                settle(last)
                done = last
            value = best[last + 1 - size] + score
            if value > best[last + 1]:
                best[last + 1], back[last + 1] = value, (size, i)
        settle(n)
        ids: list[int] = []
        while n:
            size, i = back[n]
            ids += [i] if i is not None else [self.byte_id[b] for b in reversed(text[n - 1].encode())]
            n -= size
        return tuple(reversed(ids))

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        if not text:
            return ids
        paths, literal = self.paths, [self.byte_id[b] for b in SPACE.encode()]
        for k, part in enumerate((" " + text).split(SPACE)):
            if k:
                ids += literal
            part = part.replace(" ", SPACE)
            words = [part] if self.whole else self.cut.findall(part)
            found = list(map(paths.get, words))
            if None in found:
                for at in [at for at, path in enumerate(found) if path is None]:
                    word = words[at]
                    found[at] = path = paths.get(word) or self.viterbi(word)
                    if len(paths) < self.remembered and len(word) <= 64:
                        paths[word] = path
            ids += chain.from_iterable(found)
        return ids

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.surface.__getitem__, ids)).decode(errors="replace")[1:]


def _words(pieces: list[str]) -> re.Pattern:
    """Words with the spaces before them, for pieces that cross no word's start: cut after letters where no piece goes on from there."""
    pairs = {pair for p in pieces for pair in zip(p, p[1:], strict=False)}
    held, new = set(), {c for p in pieces for c in p if c.isalpha()}
    while new:  # what follows a letter in a piece counts as one, and so on
        held |= new
        new = {b for a, b in pairs if a in held and b not in held and b != SPACE}
    letters = "".join(map(re.escape, sorted(held)))
    if not letters:
        return re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
    return re.compile(f"\n|{SPACE}*(?:[^{SPACE}\n{letters}]*[{letters}]+|[^{SPACE}\n{letters}]+)|{SPACE}+")


def _codec(model: bytes) -> Codec:
    key = hashlib.sha256(model).hexdigest()
    codecs = left_by("pieces")
    if key not in codecs:
        codecs[key] = Codec(model)
    return codecs[key]


def _mapped(docs: DataFrame, vocabulary: str, row, names: list[str], kinds: list, schema: str) -> DataFrame:
    with open(vocabulary, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_unused()  # what earlier stages left in this worker
        codec = _codec(model.value)
        try:
            for batch in batches:
                for at in range(0, len(batch), 256):  # a few hundred rows of ids at a time
                    part = batch.slice(at, 256)
                    cols = zip(*(row(codec, x.as_py()) for x in part.column(1)), strict=True)
                    yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=["doc_id", *names])
        finally:
            codec.paths.clear()  # a worker outlives its task
            release_unused()

    return docs.mapInArrow(each, f"doc_id long, {schema}")


def encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, ids of each document row."""
    return _mapped(docs.select("doc_id", "text"), vocabulary, lambda c, t: (np.array(c.encode(t or ""), np.int32),), ["ids"], [pa.list_(pa.int32())], "ids array<int>")


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, text of each row of ``encode``."""
    return _mapped(encoded.select("doc_id", "ids"), vocabulary, lambda c, ids: (c.decode(ids),), ["text"], [pa.string()], "text string")


def digest(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of little-endian int32), n_byte_tokens, exact (decoding gave the text back)."""

    def row(codec: Codec, text: str | None) -> tuple:
        ids = codec.encode(text or "")
        a = np.array(ids, "<i4")
        lo, hi = min(codec.byte_id.values()), max(codec.byte_id.values())
        return len(ids), hashlib.sha256(a.tobytes()).hexdigest(), int(((a >= lo) & (a <= hi)).sum()), codec.decode(ids) == (text or "")

    return _mapped(
        docs.select("doc_id", "text"), vocabulary, row, ["n_tokens", "ids_sha256", "n_byte_tokens", "exact"],
        [pa.int64(), pa.string(), pa.int64(), pa.bool_()], "n_tokens long, ids_sha256 string, n_byte_tokens long, exact boolean",
    )
