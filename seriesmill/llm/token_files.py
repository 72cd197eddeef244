"""Token ids in files of directly addressable codes."""

from __future__ import annotations

import json
import os
import re
import struct
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator, Sequence
from itertools import chain
from types import ModuleType

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAGIC = b"DAC1"
#: Bits of a chunk and of a rank block.
CHUNK, BLOCK = 8, 512
#: Ids after which a task closes a file and opens the next; what one row of the table holds.
FILE_IDS = 1 << 20
#: Parts of texts whose ids a Python worker remembers; beyond, it forgets those that did not come back.
REMEMBERED = 400_000
#: Texts that are encoded together.
TOGETHER = 256
#: Characters that Python's split takes for white space and the tokenizer does not.
SEPARATORS = "\x1c\x1d\x1e\x1f"
#: Texts of these characters only are split here: ASCII and letters that have one lower form and are
#: composed already.  The pattern is the vocabulary's own, for lowered texts.
PLAIN = re.compile(r"[\x00-\x1b\x20-\x7fÀ-ÖØ-öø-ÿ]*")
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
#: Lowered plain texts without these consist of words and of single full stops and commas.
INTRICATE = re.compile(r"[^\sa-zß-öø-ÿ.,]|[.,]{2}")
#: Characters that stand for bytes which byte-level vocabularies do not write as themselves.
_OWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTES = {b: 0x100 + n for n, b in enumerate(sorted(set(range(0x100)).difference(_OWN)))}


class WordEncoder:
    """Ids of whole texts by the tokenizers library, which sees each part of a text once.

    For vocabularies that lower case, split texts into words, digits and marks,
    and drop white space before they merge: then a text's ids are those of its
    parts, one after the other, and a plain part goes straight to the library's
    merges.  The tokenizer's own description has to say so (``_checked``); texts
    are encoded whole with any other.  Texts with characters that are not plain
    are cut at white space only, which all such vocabularies allow.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        # Spark has a task per core already; the library's own threads would only wait for one another
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(spec)
        self.model = self.tokenizer.model
        self.by_parts = _checked(spec)
        self.parts: dict[str, bytes] = {}
        self.again: set[str] = set()
        self.special = "<|"  # how special tokens start; texts that hold one keep their case

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _part(self, part: str) -> bytes:
        if part.isascii() and part.isalpha() and part.islower():
            written = part
        elif "<" in part or part != part.lower() or not PARTS.fullmatch(part) or not PLAIN.fullmatch(part):
            return self._ids(part)
        else:
            written = part.encode().decode("latin-1").translate(BYTES)
        return array("I", [t.id for t in self.model.tokenize(written)]).tobytes()

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: Sequence[str | None]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers; NULL and empty texts have none."""
        whole: dict[int, bytes] = {}
        split: list[list[str]] = []
        for k, t in enumerate(texts):
            if not t:
                split.append([])
            elif not self.by_parts or any(c in t for c in SEPARATORS):
                whole[k] = self._ids(t)
                split.append([])
            elif self.special not in t and PLAIN.fullmatch(t):
                t = t.lower()
                if INTRICATE.search(t):
                    split.append(PARTS.findall(t))
                else:
                    split.append(t.replace(".", " . ").replace(",", " , ").split())
            else:
                split.append(t.split())
        parts = self.parts
        here = set(chain.from_iterable(split))
        new = here.difference(parts)
        if len(parts) + len(new) > REMEMBERED:
            stay = self.again if len(self.again) < REMEMBERED // 2 else set()
            self.parts = parts = {p: ids for p, ids in parts.items() if p in stay}
            self.again = set()
            new = here.difference(parts)
        else:
            self.again.update(here.difference(new))
        for p in new:
            parts[p] = self._part(p)
        return [whole.get(k) or b"".join(map(parts.__getitem__, found)) for k, found in enumerate(split)]


# The pattern by which such a vocabulary splits lowered texts.
WORDS_AND_MARKS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _checked(spec: str) -> bool:
    """Whether a tokenizer's description says that texts can be cut into words and parts."""
    described = json.loads(spec)
    if array("I").itemsize != 4 or sys.byteorder != "little":
        return False

    def steps(part: dict | None, many: str) -> list[dict]:
        return [] if part is None else part[many] if part["type"] == "Sequence" else [part]

    normal = steps(described.get("normalizer"), "normalizers")
    before = steps(described.get("pre_tokenizer"), "pretokenizers")
    spaces = all(n["type"] in ("NFC", "Lowercase") or n["type"] == "Replace" and n["pattern"] == {"Regex": "\\s+"}
                 and n["content"] == " " for n in normal)
    splits = [b for b in before if b["type"] == "Split"]
    return (
        described["model"]["type"] == "BPE" and spaces and any(n["type"] == "Lowercase" for n in normal)
        and len(splits) == 1 and splits[0]["pattern"] == {"Regex": WORDS_AND_MARKS}
        and splits[0]["behavior"] == "Removed" and splits[0]["invert"] is True
        and all(b["type"] == "Split" or b["type"] == "ByteLevel" and not b["add_prefix_space"] for b in before)
        and all(a["content"].startswith("<|") and not a["content"].split()[1:] for a in described["added_tokens"])
        and not described["model"].get("ignore_merges") and not described["model"].get("dropout"))


def worker_encoder(spec: str) -> WordEncoder:
    """The encoder of this Python worker.  Spark uses a worker for many tasks, so what one learnt serves
    the next; a new worker starts empty and gives the same ids."""
    place = sys.modules.setdefault("seriesmill_worker", ModuleType("seriesmill_worker"))
    key = zlib.crc32(spec.encode())
    if getattr(place, "encoder_key", None) != key:
        place.encoder, place.encoder_key = WordEncoder(spec), key
    return place.encoder


def pack_ids(ids: np.ndarray, ends: np.ndarray) -> bytes:
    """A file: magic, counts, document ends, then the levels.

    Level k holds bits 8k to 8k+7 of every id that has that many, a bitmap of
    the ids that go on, and the number of set bits before each block of it.
    All integers are little-endian.
    """
    out = [struct.pack("<QQ", len(ids), len(ends)), ends.astype("<u8").tobytes()]
    rest, levels = ids.astype("<u4"), 0
    while True:
        more = rest >> CHUNK
        goes_on = more > 0
        bitmap = np.packbits(goes_on, bitorder="little")
        bitmap = np.concatenate([bitmap, np.zeros(-len(bitmap) % (BLOCK // 8), np.uint8)])
        blocks = np.bitwise_count(bitmap).reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.uint64)
        ranks = np.concatenate([[0], np.cumsum(blocks)]).astype("<u8")
        out += [struct.pack("<Q", len(rest)), (rest & 255).astype(np.uint8).tobytes(), bitmap.tobytes(), ranks.tobytes()]
        levels += 1
        if not goes_on.any():
            break
        rest = more[goes_on]
    return MAGIC + struct.pack("<I", levels) + b"".join(out)


class IdFile:
    """Random access to a file's ids: no block is decoded to reach one."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        levels, self.size, documents = struct.unpack_from("<IQQ", data, 4)
        at = 4 + struct.calcsize("<IQQ")

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(data, kind, count, at)
            at += found.nbytes
            return found

        self.ends = take("<u8", documents)
        self.levels = []
        for _ in range(levels):
            count = int(take("<u8", 1)[0])
            chunks = take("u1", count)
            blocks = -(-count // BLOCK)
            self.levels.append((chunks, take("u1", blocks * (BLOCK // 8)), take("<u8", blocks + 1)))

    def _rank(self, level: int, at: int) -> int:
        """Set bits before position ``at`` of a level's bitmap: a look into the directory and one block."""
        _, bitmap, ranks = self.levels[level]
        block = at // BLOCK
        start = block * (BLOCK // 8)
        full = start + (at % BLOCK) // 8
        count = int(ranks[block]) + int(np.bitwise_count(bitmap[start:full]).sum())
        if at % 8:
            count += (int(bitmap[full]) & ((1 << at % 8) - 1)).bit_count()
        return count

    def __getitem__(self, at: int) -> int:
        """One id."""
        if not 0 <= at < self.size:
            raise IndexError(at)
        value = 0
        for level, (chunks, bitmap, _) in enumerate(self.levels):
            value |= int(chunks[at]) << (CHUNK * level)
            if not bitmap[at // 8] >> (at % 8) & 1:
                break
            at = self._rank(level, at)
        return value

    def span(self, start: int, end: int, level: int = 0) -> np.ndarray:
        """Ids start to end, reached by one rank per level and side."""
        chunks, bitmap, _ = self.levels[level]
        out = chunks[start:end].astype("<u4")
        goes_on = np.unpackbits(bitmap[start // 8:-(-end // 8)], bitorder="little")[start % 8:][:end - start]
        if goes_on.any():
            first = self._rank(level, start)
            more = self.span(first, first + int(goes_on.sum()), level + 1)
            out[goes_on.view(bool)] |= more << CHUNK
        return out

    def document(self, number: int) -> np.ndarray:
        return self.span(int(self.ends[number - 1]) if number else 0, int(self.ends[number]))


def write_ids(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text",
    file_ids: int = FILE_IDS,
) -> None:
    """Write the ids of all texts, each followed by ``end_id``, in ascending order of the id.

    NULL ids come first; rows with one id follow each other by a hash of their
    text, so an id on very many rows still spreads.  NULL and empty texts have
    the end id alone.  Other columns are not read.

    Rows are dealt out once by ranges of the id.  A task encodes its range and
    cuts it into files of about ``file_ids`` ids (a longer document is one
    file).  The files are the ``payload`` cells of a Parquet folder, so they get
    where Spark can write, and its commit keeps out the files of lost tasks;
    beside each stand its place (``piece``, ``seq``), its number of ids and the
    ids of its documents.
    """
    with open(tokenizer, encoding="utf-8") as file:
        spec = file.read()
    kind = docs.schema[doc_id].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, piece = worker_encoder(spec), TaskContext.get().partitionId()
        keys: list[str | None] = []
        parts: list[bytes] = []
        held = seq = 0

        def close() -> pd.DataFrame:
            ids = np.frombuffer(b"".join(parts), "<u4")
            ends = np.cumsum([len(p) // 4 for p in parts])
            return pd.DataFrame({"piece": [piece], "seq": [seq], "n": [len(ids)], "keys": [list(keys)],
                                 "payload": [pack_ids(ids, ends)]})

        for frame in frames:
            for at in range(0, len(frame), TOGETHER):
                some = frame[at:at + TOGETHER]
                for key, ids in zip(some["key"], encoder.encode_all(some["text"].tolist()), strict=True):
                    keys.append(key)
                    parts.append(ids + end)
                    held += len(parts[-1]) // 4
                    if held >= file_ids:
                        yield close()
                        keys.clear()
                        parts.clear()
                        held, seq = 0, seq + 1
        if parts:
            yield close()

    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange("id", "tie")
    rows = rows.sortWithinPartitions("id", "tie").select(F.col("id").cast("string").alias("key"), "text")
    files = rows.mapInPandas(run, "piece int, seq int, n long, keys array<string>, payload binary")
    files.withColumn("keys", F.col("keys").cast(f"array<{kind}>")).write.parquet(path)


def map_ids(spark: SparkSession, path: str, per_document: Callable[[np.ndarray], dict], schema: str) -> DataFrame:
    """Read the files: ``doc_id, start, n_tokens`` and what ``per_document`` makes of a document's ids.

    ``start`` is the number of ids of all documents before it.  Sums over files
    run within a task's files and then over tasks, never over documents.
    """
    files = spark.read.parquet(path)
    kind = files.schema["keys"].dataType.elementType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                file = IdFile(row.payload)
                out = []
                for number, key in enumerate(row.keys):
                    ids = file.document(number)
                    out.append({"key": key, "inner": int(file.ends[number]) - len(ids), "n_tokens": len(ids)}
                               | per_document(ids))
                yield pd.DataFrame(out).assign(piece=row.piece, seq=row.seq)

    found = files.withColumn("keys", F.col("keys").cast("array<string>")).mapInPandas(
        run, f"piece int, seq int, key string, inner long, n_tokens long, {schema}")
    own = Window.partitionBy("piece").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    pieces = files.groupBy("piece").agg(F.sum("n").alias("total"))
    all_ = Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("piece", F.coalesce(F.sum("total").over(all_), F.lit(0)).alias("before"))
    starts = files.select("piece", "seq", F.coalesce(F.sum("n").over(own), F.lit(0)).alias("ahead")).join(pieces, "piece")
    names = [f.split()[0] for f in schema.split(",")]
    return found.join(starts, ["piece", "seq"]).select(
        F.col("key").cast(kind).alias("doc_id"), (F.col("before") + F.col("ahead") + F.col("inner")).alias("start"),
        "n_tokens", *names)


def id_checksums(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files."""
    return map_ids(spark, path, lambda ids: {"ids_crc32": zlib.crc32(ids.tobytes())}, "ids_crc32 long")
