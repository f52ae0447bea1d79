"""Vector bin packing of tokenised examples into sequences, by the dot-product heuristic.

An example may be cut anywhere. It first fills whole sequences; its tail joins a bounded pool. A sequence is filled from the
pool under three limits at once (tokens, segments, loss-bearing tokens): the tail whose demands have the largest dot product
with the room left goes in; where no whole tail fits, the longest one is cut to fit. What a task has left at its end goes into
sequences whose lengths are powers of two, which need no padding. Each task packs its own partition in one pass, with a pool
of bounded size, so nothing is shuffled.

``pack_documents`` packs texts all of whose ids bear loss. ``pack_conversations`` packs instruction data: an example is a
conversation (at most ``TURNS`` turns of it, so that no example is unbounded), of which only the answers bear loss.

Defined cases: a null text counts as empty, and an empty text still has its end id; repeated rows are packed as often as they
come; null ids are passed through; an empty table gives no rows.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, table, worker_cache
from .token_counts import byte_letters

CAPACITY = 2048
SEGMENTS = 256
END_ID = 1
POOL = 256
WORDS_HELD = 1 << 18
TURNS = 64
CHARS_AT_ONCE = 1 << 18
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


# Fixed value: the splitting pattern of the vocabulary file.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"
#: The same over lower-cased ASCII, where the plain engine is quicker.
ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t\n\r\x0b\x0ca-z0-9]+").findall
#: Where a code point is tried: among letters, digits, spaces and marks, before and behind marks that reorder, around a contraction.
AROUND = "{} a{}b1{}2 {}!{}'s a{}\u0334 a\u0345{} a{}\u0301 '{}"
#: Kinds of code points, the worst last: letters (and all of ASCII), others that are plain, odd ones, those that were never met.
LETTER, PLAIN, ODD, UNKNOWN = range(4)
#: The splitting pattern for texts whose letters beyond ASCII are all that is beyond ASCII.
LETTER_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\w \t\n\r\x0b\x0c]|_)+").findall


class Points:
    """Which code points Python's Unicode tables and the library's treat alike; a text with any other is left to the library whole.

    The tables of classes, case and composition may be of different Unicode versions. A code point is tried when it is first met and
    is plain only if both sides normalise and split it alike wherever it is tried. What Python hasn't assigned, or is for private use,
    is odd without trial, and so is what ends a composition that only one side knows.
    """

    def __init__(self, library):
        import regex

        self.library, self.words = library, regex.compile(SPLIT).findall
        self.letters = str.maketrans({chr(byte): letter for letter, byte in byte_letters().items()})
        self.kinds = None

    def begin(self) -> None:
        """Marks what can be told without trial, when the first text beyond ASCII comes."""
        import unicodedata

        from tokenizers import normalizers

        apart, whole = normalizers.NFD(), normalizers.NFC()
        self.kinds = np.full(0x110000, UNKNOWN, np.uint8)
        for point in (*range(0xD800), *range(0xE000, 0x110000)):
            char = chr(point)
            if unicodedata.category(char) in ("Cn", "Co"):
                self.kinds[point] = ODD
            elif point < 0x3400 or 0xF900 <= point < 0x20000:
                for parts in {unicodedata.normalize("NFD", char), apart.normalize_str(char)}:
                    if len(parts) > 1 and whole.normalize_str(parts) != unicodedata.normalize("NFC", parts):
                        self.kinds[ord(parts[-1])] = ODD
        self.kinds[:128] = LETTER
        # Lower case of these depends on what is around them.
        self.kinds[[ord("Σ"), ord("İ")]] = ODD

    def split(self, text: str) -> list[str]:
        """A text's words by Python's tables."""
        import unicodedata

        return self.words(unicodedata.normalize("NFC", text).lower())

    def alike(self, point: int) -> bool:
        text = AROUND.replace("{}", chr(point))
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [x for x, _ in found] == [w.encode().decode("latin-1").translate(self.letters) for w in self.split(text)]

    def kind(self, point: int) -> int:
        import unicodedata

        return (LETTER if unicodedata.category(chr(point))[0] == "L" else PLAIN) if self.alike(point) else ODD

    def worst(self, text: str) -> int:
        """The worst kind among a text's code points."""
        if text.isascii():
            return LETTER
        if self.kinds is None:
            self.begin()
        out = LETTER
        for i in range(0, len(text), CHARS_AT_ONCE):
            points = np.frombuffer(text[i : i + CHARS_AT_ONCE].encode("utf-32-le"), np.uint32)
            most = self.kinds[points].max()
            if most == UNKNOWN:
                for point in np.unique(points[self.kinds[points] == UNKNOWN]).tolist():
                    self.kinds[point] = self.kind(point)
                most = self.kinds[points].max()
            out = max(out, int(most))
            if out == ODD:
                break
        return out


class WordIds(dict):
    """Ids of single words as packed 32-bit numbers, asked of the library when first met."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.points = Points(self.library)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        # Words come normalised and apart, so only the merging of their byte letters is asked of the library.
        self.model = self.library.model
        self.letters, self.before = self.points.letters, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            # Letters and digits of ASCII stand for themselves.
            shown = word if word.isascii() and word.isalnum() else word.encode().decode("latin-1").translate(self.letters)
            found = [t.id for t in self.model.tokenize(shown)]
            ids = struct.pack(f"<{len(found)}I", *found)
        if len(self) >= WORDS_HELD // 2:
            # Words that are still in use come back from the older half.
            self.before = dict(self)
            self.clear()
        if len(word) < 100:
            self[word] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        import unicodedata

        worst = self.points.worst(text)
        if worst == ODD or any(s in text for s in self.special):
            return np.array([*self.library.encode(text, add_special_tokens=False).ids, END_ID], "<u4")
        if text.isascii():
            words = ASCII_WORDS(text.lower())
        elif unicodedata.is_normalized("NFC", text):
            words = (LETTER_WORDS if worst == LETTER else self.points.words)(text.lower())
        else:
            words = self.points.words(unicodedata.normalize("NFC", text).lower())
        return np.frombuffer(b"".join([*map(self.__getitem__, words), END_ID.to_bytes(4, "little")]), "<u4")


class Packer:
    """Packs the examples of one task; ``place`` and ``finish`` return finished rows."""

    def __init__(self, first_id: int, capacity: int = CAPACITY, segments: int = SEGMENTS, loss: int = CAPACITY, pool: int = POOL):
        self.limits = np.array([capacity, segments, loss], float)
        self.next_id, self.capacity, self.pool_size = first_id, capacity, pool
        self.demand, self.pool, self.rows = np.zeros((0, 3)), [], []

    def emit(self, pieces: list[tuple]) -> None:
        """One sequence of ``pieces`` (key, start, ids, loss mask or None, tokens of the example)."""
        offset = 0
        for key, start, ids, mask, total in pieces:
            loss = len(ids) if mask is None else int(mask.sum())
            self.rows.append((key, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next_id, offset, loss))
            offset += len(ids)
        self.next_id += 1

    def place(self, key, ids: np.ndarray, mask: np.ndarray | None = None) -> None:
        total, start = len(ids), 0
        whole = min(self.capacity, int(self.limits[2]))
        while total - start >= whole:
            end = start + whole
            self.emit([(key, start, ids[start:end], None if mask is None else mask[start:end], total)])
            start = end
        if start < total:
            # A copy, so that the pool holds the tail and not the whole example.
            self.pool.append((key, start, ids[start:].copy(), None if mask is None else mask[start:].copy(), total))
        if len(self.pool) >= self.pool_size:
            self.load()
            while len(self.pool) > self.pool_size // 2:
                self.fill()

    def load(self) -> None:
        self.demand = np.array([(len(p[2]), 1, len(p[2]) if p[3] is None else p[3].sum()) for p in self.pool], float).reshape(-1, 3)

    def take(self, i: int) -> tuple:
        last = self.pool.pop()
        self.demand, row = self.demand[:-1], self.demand[-1]
        if i == len(self.pool):
            return last
        out, self.pool[i], self.demand[i] = self.pool[i], last, row
        return out

    def fill(self) -> None:
        """One sequence from the pool."""
        room, pieces = self.limits.copy(), []
        while self.pool and room.min() >= 1:
            fits = (self.demand <= room).all(axis=1)
            if fits.any():
                scores = np.where(fits, (self.demand / self.limits) @ (room / self.limits), -1)
                piece = self.take(int(scores.argmax()))
            else:
                piece = self.cut(int(self.demand[:, 0].argmax()), room)
                if piece is None:
                    break
            pieces.append(piece)
            room -= (len(piece[2]), 1, len(piece[2]) if piece[3] is None else piece[3].sum())
        self.emit(pieces)

    def cut(self, i: int, room: np.ndarray) -> tuple | None:
        key, start, ids, mask, total = self.pool[i]
        n = min(int(room[0]), len(ids) - 1)
        if mask is None:
            n = min(n, int(room[2]))
        else:
            n = min(n, int(np.searchsorted(np.cumsum(mask), room[2], side="right")))
        if n < 1:
            return None
        self.pool[i] = (key, start + n, ids[n:], None if mask is None else mask[n:], total)
        self.demand[i] = (len(ids) - n, 1, len(ids) - n if mask is None else mask[n:].sum())
        return key, start, ids[:n], None if mask is None else mask[:n], total

    def finish(self) -> None:
        """What is left, in sequences that are full or as long as a power of two."""
        self.load()
        while self.pool and self.demand[:, 0].sum() >= self.capacity:
            self.fill()
        left = int(self.demand[:, 0].sum())
        keep = self.limits.copy()
        while self.pool:
            self.limits = np.minimum(keep, (1 << (max(left, 1).bit_length() - 1), keep[1], keep[2]))
            self.fill()
            left = int(self.demand[:, 0].sum())
        self.limits = keep

    def drain(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def _rows(packer: Packer):
    if rows := packer.drain():
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], NAMES)


def _word_ids(path: str) -> WordIds:
    held = worker_cache("word_ids")
    if path not in held:
        held[path] = WordIds(path)
    return held[path]


def _pack_batches(path: str):
    def run(batches):
        words, packer = _word_ids(path), Packer(TaskContext.get().partitionId() << 40)
        for batch in batches:
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                packer.place(key, words.encode(text or ""))
            yield from _rows(packer)
        packer.finish()
        yield from _rows(packer)

    return run


def pack_documents(docs: DataFrame, path: str) -> DataFrame:
    """One row per piece of every row of ``docs (doc_id long, text)``. All ids of a document bear loss."""
    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_pack_batches(path), SCHEMA)


def _pack_turns(path: str, role: str, loss: int, segments: int):
    def run(batches):
        words, packer = _word_ids(path), Packer(TaskContext.get().partitionId() << 40, segments=segments, loss=loss)
        key, ids, masks = None, [], []

        def place():
            if ids:
                packer.place(key[0], np.concatenate(ids), np.concatenate(masks))
                ids.clear(), masks.clear()

        for batch in batches:
            for conv, block, who, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "block", "role", "text")), strict=True):
                if (conv, block) != key or len(ids) >= TURNS:
                    place()
                    key = conv, block
                ids.append(words.encode(text or ""))
                masks.append(np.full(len(ids[-1]), who == role))
            yield from _rows(packer)
        place()
        packer.finish()
        yield from _rows(packer)

    return run


def pack_conversations(turns: DataFrame, path: str, role: str = "assistant", loss: int = CAPACITY * 3 // 4, segments: int = SEGMENTS) -> DataFrame:
    """One row per piece of the conversations in ``turns (conv_id long, turn, role, text)``, under limits on tokens, segments and loss-bearing tokens.

    ``doc_id`` is the conversation, ``loss_tokens`` the ids of a piece that turns of ``role`` have. Turns are dealt by conversation
    and block of ``TURNS`` turns, so a conversation of any size is spread over tasks; turns without a number are dealt by their text.
    """
    bounded_batches(turns.sparkSession)
    block = F.when(F.col("turn").isNull(), -1 - F.pmod(F.xxhash64("text"), F.lit(1024))).otherwise(F.floor(F.col("turn") / TURNS))
    rows = turns.select("conv_id", block.alias("block"), "turn", "role", "text").repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "turn", "role", "text")
    return rows.select("conv_id", "block", "role", "text").mapInArrow(_pack_turns(path, role, loss, segments), SCHEMA)


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
