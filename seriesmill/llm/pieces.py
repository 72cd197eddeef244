"""Encoding to and decoding from the pieces of a merge-type SentencePiece model.

The encoder keeps a table with the last token of every prefix.  For a merge
vocabulary that token is unique, and a token ending a prefix is the one exactly
if it and the last token of what stands before it stay two tokens when merged
alone.  An automaton proposes the tokens that end at a position, the pair test
picks the one, and the ids are read backwards from the end of the table.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from struct import pack, unpack

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Kinds of pieces in a model file (fixed values of the format).
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Words whose ids a task remembers; beyond, it forgets them all and goes on.
REMEMBERED = 250_000
#: Rows that leave a task together.
TOGETHER = 512


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, data[at:at + size]
            at += size


@dataclass
class Pieces:
    """What encoding and decoding need of a model; small and shipped with each task."""

    texts: list[str]
    kinds: list[int]
    scores: dict[str, float]
    # pieces that merging their characters gives, with the two parts merged last
    whole: dict[str, tuple[str, str] | None] = field(default_factory=dict)
    odd: set[str] = field(default_factory=set)  # those that score better than a part of them
    bos: int = 1
    eos: int = 2
    unknown: int = 0
    dummy_prefix: bool = True
    unknown_text: str = " ⁇ "


def read_model(path: str) -> Pieces:
    """Read a model file.  Only merge models that leave the text as it is are taken.

    Raises ValueError for another algorithm, for rules that change characters,
    drop white space or put it behind words, and for user-defined or unused pieces.
    """
    with open(path, "rb") as file:
        data = file.read()
    texts, kinds, scores = [], [], {}
    out = Pieces(texts, kinds, scores)
    algorithm = suffix = 0
    byte_fallback = False
    rules, squeeze, escape = b"", 1, 1
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            texts.append(piece.get(1, b"").decode())
            kinds.append(piece.get(3, NORMAL))
            if kinds[-1] == NORMAL:
                scores[texts[-1]] = unpack("<f", piece.get(2, b"\0\0\0\0"))[0]
        elif number == 2:
            spec = dict(_fields(value))
            algorithm, suffix = spec.get(3, 1), spec.get(24, 0)
            byte_fallback = bool(spec.get(35, 0))
            out.unknown, out.bos, out.eos = spec.get(40, 0), spec.get(41, 1), spec.get(42, 2)
            out.unknown_text = spec.get(44, out.unknown_text.encode()).decode()
        elif number == 3:
            spec = dict(_fields(value))
            rules, out.dummy_prefix = spec.get(2, b""), bool(spec.get(3, 1))
            squeeze, escape = spec.get(4, 1), spec.get(5, 1)
    if algorithm != 2 or suffix or not byte_fallback or rules or squeeze or not escape:
        raise ValueError("not a merge model with byte fallback that keeps the text")
    if {USER, UNUSED} & set(kinds):
        raise ValueError("user-defined and unused pieces are not supported")
    for t in scores:
        if len(t) == 1:
            out.whole[t] = None
        elif merged(t, scores) == [t]:
            out.whole[t] = tuple(merged(t, scores, 2))
    for t in sorted(out.whole, key=len):
        halves = out.whole[t]
        if halves and any(h in out.odd or len(h) > 1 and scores[h] <= scores[t] for h in halves):
            out.odd.add(t)
    return out


def merged(text: str, scores: dict[str, float], stop: int = 1) -> list[str]:
    """The definition: merge the pair with the best score, the leftmost of equals, until none is left
    (or ``stop`` parts are)."""
    parts = list(text)
    while len(parts) > stop:
        best, at = None, -1
        for k in range(len(parts) - 1):
            score = scores.get(parts[k] + parts[k + 1])
            if score is not None and (best is None or score > best):
                best, at = score, k
        if best is None:
            break
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Encoder:
    """Encodes texts with the prefix table; one per task."""

    def __init__(self, pieces: Pieces):
        self.scores = pieces.scores
        ids = {t: i for i, (t, k) in enumerate(zip(pieces.texts, pieces.kinds, strict=True)) if k == NORMAL}
        self.bytes_ = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(pieces.texts, pieces.kinds, strict=True))
                       if k == BYTE}
        # tokens by number, from 1: the whole pieces, then characters that are no piece as they turn up
        self.names = ["", *pieces.whole]
        self.codes = [b"", *(pack("<I", ids[t]) for t in pieces.whole)]
        self.others: dict[str, int] = {}
        self.automaton = ahocorasick.Automaton()
        for number, t in enumerate(pieces.whole, 1):
            self.automaton.add_word(t, (number, len(t)))
        self.automaton.make_automaton()
        self.whole, self.odd = pieces.whole, pieces.odd
        self.edges: dict[tuple[str, int], tuple[list[str], list[float]]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.prefix = SPACE if pieces.dummy_prefix else ""
        self.bos, self.eos = pack("<I", pieces.bos), pack("<I", pieces.eos)
        # Where no piece has another character before a space mark, merges never cross into a
        # word, and words can be encoded one by one.
        self.by_word = not any(SPACE in t.lstrip(SPACE) for t in ids)
        # characters that no longer piece holds are borders too; new lines are the frequent ones
        self.by_line = not any("\n" in t and len(t) > 1 for t in ids)
        self.known = _Known(self)

    def edge(self, token: str, side: int) -> tuple[list[str], list[float]]:
        """What stands at a token's left (0) or right (1) end while its characters merge: the growing
        parts, and for each the score of the merge that ends it."""
        key = (token, side)
        found = self.edges.get(key)
        if found is None:
            parts, part = [token], token
            while halves := self.whole.get(part):
                part = halves[side]
                parts.append(part)
            parts.reverse()
            found = self.edges[key] = (parts, [*(self.scores[p] for p in parts[1:]), -math.inf])
        return found

    def fits(self, left: str, right: str) -> bool:
        """Whether two tokens stay two when merged alone.

        Parts score better than what they merge to (the few pieces where one does
        not are merged in full), so merging goes by falling score.  The border is lost if, at some time, the parts beside it
        merge before either merges away from it; of equal
        scores the left merge comes first.
        """
        (xs, end_x), (ys, end_y) = self.edge(left, 1), self.edge(right, 0)
        i = j = 0
        scores = self.scores
        if left in self.odd or right in self.odd:
            return merged(left + right, scores) == [left, right]
        while True:
            x, y = end_x[i], end_y[j]
            over = scores.get(xs[i] + ys[j])
            if over is not None and over > x and over >= y:
                return False
            if x >= y:
                if x == -math.inf:
                    return True
                i += 1
            else:
                j += 1

    def other(self, char: str) -> int:
        """The number of a character that is no piece; its ids are those of its bytes."""
        number = self.others.get(char)
        if number is None:
            number = self.others[char] = len(self.names)
            self.names.append(char)
            self.codes.append(b"".join(pack("<I", self.bytes_[b]) for b in char.encode()))
        return number

    def stretch(self, text: str) -> bytes:
        """The ids of a stretch without inner borders, by the prefix table."""
        pairs, names = self.pairs, self.names
        if len(pairs) > 2 * REMEMBERED:
            pairs.clear()
        last, sizes = [0] * (len(text) + 1), [1] * (len(text) + 1)
        for end, (token, size) in self.automaton.iter(text):
            end += 1
            if last[end]:
                continue
            if start := end - size:
                before = last[start]
                if not before:
                    before = last[start] = self.other(text[start - 1])
                key = (before, token)
                fits = pairs.get(key)
                if fits is None:
                    fits = pairs[key] = self.fits(names[before], names[token])
                if not fits:
                    continue
            last[end], sizes[end] = token, size
        out, at, codes = [], len(text), self.codes
        while at:
            out.append(codes[last[at] or self.other(text[at - 1])])
            at -= sizes[at]
        out.reverse()
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        """All ids as little-endian unsigned 32-bit integers; NULL and empty: begin and end only."""
        if not text:
            return self.bos + self.eos
        known = self.known
        if not self.by_word:
            body = self.stretch((self.prefix + text).replace(" ", SPACE))
        elif self.prefix and "  " not in text and SPACE not in text and text[0] != " " and text[-1] != " ":
            body = b"".join(map(known.__getitem__, text.split(" ")))
        else:
            text = (self.prefix + text).replace(" ", SPACE)
            body = b"".join(
                known[w[1:]] if w[0] == SPACE and w[1:2] not in ("", SPACE) else self.stretch(w)
                for w in re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", text))
        return self.bos + body + self.eos


class _Known(dict):
    """Ids of words, without their space mark; words come back often."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, word: str) -> bytes:
        if len(self) > REMEMBERED:
            self.clear()
        encoder = self.encoder
        if encoder.by_line and "\n" in word:
            first, *rest = word.split("\n")
            line = encoder.stretch("\n")
            return self[first] + b"".join(line + (self.bare(x) if x else b"") for x in rest)
        ids = self[word] = encoder.stretch(SPACE + word)
        return ids

    def bare(self, word: str) -> bytes:
        key = " " + word  # no word holds a space, so it marks those without a space mark
        ids = self.get(key)
        if ids is None:
            ids = self[key] = self.encoder.stretch(word)
        return ids


class Decoder:
    """Turns ids back into text."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.table = []
        for text, kind in zip(pieces.texts, pieces.kinds, strict=True):
            if kind == BYTE:
                self.table.append(bytes([int(text[3:5], 16)]))
            elif kind == UNKNOWN:
                self.table.append(pieces.unknown_text.encode())
            else:
                self.table.append(b"" if kind == CONTROL else text.replace(SPACE, " ").encode())

    def decode(self, ids: bytes | None) -> str:
        """NULL: no ids.  One space mark of the first piece goes, as encoding had put it there."""
        codes = np.frombuffer(ids or b"", "<u4").tolist()
        parts = list(map(self.table.__getitem__, codes))
        if self.pieces.dummy_prefix:
            for at, code in enumerate(codes):
                if parts[at]:
                    if self.pieces.kinds[code] == NORMAL and self.pieces.texts[code][0] == SPACE:
                        parts[at] = parts[at][1:]
                    break
        try:
            return b"".join(parts).decode()
        except UnicodeDecodeError:
            return self._mended(codes, parts)

    def _mended(self, codes: list[int], parts: list[bytes]) -> str:
        """Byte pieces that form no character become U+FFFD, one per byte."""
        out, run = [], b""
        for code, part in zip([*codes, -1], [*parts, b""], strict=True):
            if code >= 0 and self.pieces.kinds[code] == BYTE:
                run += part
                continue
            while run:
                for size in (1, 2, 3, 4):
                    try:
                        out.append(run[:size].decode())
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    out.append("�")
                    size = 1
                run = run[size:]
            out.append(part.decode())
        return "".join(out)


def encode_pieces(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids``: every whole text with begin and end ids, as little-endian unsigned 32-bit integers.

    NULL texts count as empty and give the two ids alone.  Ids of documents,
    NULL or repeated, pass through; other columns are not read.  The model is
    read once, by the driver.  A task holds one batch of texts and a bounded
    memory of words; no row needs another, so a lost task is simply run again.
    """
    pieces = read_model(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(pieces)
        for frame in frames:
            yield pd.DataFrame({"key": frame["key"], "ids": [encoder.encode(t) for t in frame["text"]]})

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).cast("string").alias("key"), F.col(text).alias("text"))
    return rows.mapInPandas(run, "key string, ids binary").select(F.col("key").cast(kind).alias("doc_id"), "ids")


def round_trip(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids, decoded``: ``encode_pieces`` and ``decode_pieces`` in one pass over the texts.

    Rows leave a few hundred at a time, so a task holds little beside the batch it reads.
    """
    pieces = read_model(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, decoder = Encoder(pieces), Decoder(pieces)
        for frame in frames:
            for at in range(0, len(frame), TOGETHER):
                some = frame[at:at + TOGETHER]
                ids = [encoder.encode(t) for t in some["text"]]
                yield pd.DataFrame({"key": some["key"].to_numpy(), "ids": ids, "decoded": [decoder.decode(x) for x in ids]})

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).cast("string").alias("key"), F.col(text).alias("text"))
    return rows.mapInPandas(run, "key string, ids binary, decoded string").select(
        F.col("key").cast(kind).alias("doc_id"), "ids", "decoded")


def decode_pieces(encoded: DataFrame, model: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """The table with one more column, the decoded text.  NULL ids decode to an empty text."""
    pieces = read_model(model)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decoder = Decoder(pieces)
        for batch in batches:
            yield pd.Series([decoder.decode(x) for x in batch], dtype=object)

    return encoded.withColumn(decoded, run(F.col(ids)))
