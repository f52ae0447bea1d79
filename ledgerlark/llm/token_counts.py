"""Token counts by a compiled finite-state transducer.

A byte-level BPE vocabulary splits a text into pieces by a fixed pattern and then merges inside each piece. Both are compiled.
``compile_transducer`` gives a deterministic transducer over character classes whose transitions carry the piece boundaries
they emit. ``MergeTransducer`` reads a piece's bytes; a transition is annotated with the number of tokens it emits, which is
by how many the tokens of the longer prefix are more than those of the shorter (it can be negative, when bytes merge). Its
states and transitions are compiled from the vocabulary when they are first met, the library is not asked.

Texts are cut into chunks of ``CHUNK`` characters. Every chunk is run from all entry states at once, which gives a map from
entry to exit state; the maps of a text's chunks are composed by a parallel prefix scan, the entry states read off, and a
second run emits the boundaries. All chunks of a slab move in step, as arrays. The merge transducer starts anew in every
piece, so the emitted counts of the pieces add up; sums of whole pieces are kept under the piece itself.

Defined cases: a null text counts as empty and has no tokens; special strings inside a text count as one token each, as the
library does by default; ids are passed through, null or repeated.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import bounded_batches, table, worker_cache

CHUNK = 128
SLAB = 1 << 19
PIECES_HELD = 1 << 19
STATES_HELD = 1 << 17
PAIRS_HELD = 1 << 19

# The contractions of the splitting pattern are 's 't 'm 'd, 're 've and 'll.
CLASSES = "other_letter short_letter r v e l number white space apostrophe other pad".split()
STATES = "fresh letters numbers marks quote quote_rv quote_l white1 space1 white2 space2".split()
HERE, BACK = 1, 2


def compile_transducer() -> tuple[np.ndarray, np.ndarray]:
    """Next state and emitted boundaries (HERE: before this character, BACK: before the last) of each state and class."""
    s, c = {x: i for i, x in enumerate(STATES)}, {x: i for i, x in enumerate(CLASSES)}
    letters = ("other_letter", "short_letter", "r", "v", "e", "l")
    step, emit = np.zeros((len(STATES), len(CLASSES)), np.uint8), np.zeros((len(STATES), len(CLASSES)), np.uint8)

    def opened(kind: str) -> str:
        """The state after the first character of a piece."""
        if kind in letters:
            return "letters"
        return {"number": "numbers", "apostrophe": "quote", "other": "marks", "white": "white1", "space": "space1"}[kind]

    def rule(state: str, kind: str) -> tuple[str, int]:
        blank = kind in ("white", "space")
        if state in ("quote_rv", "quote_l"):
            if kind == ("e" if state == "quote_rv" else "l"):
                return "fresh", 0
            to, out = rule("letters", kind)
            return to, out | BACK
        if state in ("white1", "space1", "white2", "space2"):
            if blank:
                return kind + "2", 0
            back = BACK if state.endswith("2") else 0
            if state.startswith("white"):
                return opened(kind), back | HERE
            return ("marks" if kind == "apostrophe" else opened(kind)), back
        if state == "quote":
            if kind == "short_letter":
                return "fresh", 0
            if kind in ("r", "v", "l"):
                return "quote_l" if kind == "l" else "quote_rv", 0
        if state in ("quote", "marks") and kind in ("apostrophe", "other"):
            return "marks", 0
        if state == "letters" and kind in letters or state == "numbers" and kind == "number":
            return state, 0
        return opened(kind), HERE

    for state in STATES:
        for kind in CLASSES:
            to, out = (state, 0) if kind == "pad" else rule(state, kind)
            step[s[state], c[kind]], emit[s[state], c[kind]] = s[to], out
    return step, emit


def splits(pre_tokenizer, text: str) -> np.ndarray:
    """For each character of ``text`` whether a piece begins there, as the library's splitter has it."""
    out = np.zeros(len(text) + 1, bool)
    out[[at[0] for _, at in pre_tokenizer.pre_tokenize_str(text)]] = True
    return out


@functools.cache
def character_classes(path: str) -> bytes:
    """The class of every code point, compressed. The library's own splitter is asked, as its Unicode tables are those that count.

    Between a letter and a mark, a letter joins what is before it, any other mark what is behind, numbers and white space neither;
    between two digits a number joins both. The table is made once, in the driver, and is some kilobytes when sent. Planes 4 to 13
    and the private ones hold no letters, numbers or white space.
    """
    from tokenizers import Tokenizer

    splitter = Tokenizer.from_file(path).pre_tokenizer
    kinds = {name: i for i, name in enumerate(CLASSES)}
    out = np.full(0x110000, kinds["other"], np.uint8)
    every = [*range(0xD800), *range(0xE000, 0x40000), *range(0xE0000, 0xE1000)]
    for begin in range(0, len(every), 1 << 15):
        block = every[begin : begin + (1 << 15)]
        at = 3 * np.arange(len(block)) + 1
        begun = splits(splitter, "".join(f"a{chr(p)}!" for p in block))
        apart = begun[at + 1]
        # Only what a mark doesn't join is asked for numbers too; letters begin no piece here.
        found = np.where(~begun[at], kinds["other_letter"], np.where(apart, kinds["white"], kinds["other"]))
        rest = np.flatnonzero(begun[at] & apart)
        if len(rest):
            numbers = splits(splitter, "".join(f"1{chr(block[i])}1" for i in rest.tolist()))
            # Blocks of three run together where all are numbers, so it is the character itself that must begin nothing.
            found[rest[~numbers[3 * np.arange(len(rest)) + 1]]] = kinds["number"]
        out[block] = found
    for letter in "stmd":
        out[ord(letter)] = kinds["short_letter"]
    for letter in "rvel":
        out[ord(letter)] = kinds[letter]
    out[ord(" ")], out[ord("'")] = kinds["space"], kinds["apostrophe"]
    return zlib.compress(out.tobytes())


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for themselves, the others from 256 on, in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class MergeTransducer:
    """Counts the tokens of byte strings by transitions annotated with emitted counts.

    The merged form of a string is known by its last token and the form of what is before it: of the tokens that end a string,
    the last one is the one that stays apart from the last token before it when both are merged alone. So a state holds, for
    each place from which the bytes read since begin some token: the node of those bytes in the trie of tokens, the last token
    at that place, and how many tokens more there are now. These are finitely many, and none needs the bytes again.
    """

    def __init__(self, path: str):
        import json

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = byte_letters()
        self.bytes = {i: bytes(letters[c] for c in t) for t, i in model["vocab"].items() if all(c in letters for c in t)}
        ids = {raw: i for i, raw in self.bytes.items()}
        self.single = [ids[bytes([b])] for b in range(256)]
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[model["vocab"][left], model["vocab"][right]] = rank, model["vocab"][left + right]
        self.child, self.token, nodes = {}, {}, 1
        for raw, i in ids.items():
            node = 0
            for b in raw:
                step = self.child.get(node << 8 | b)
                if step is None:
                    step = self.child[node << 8 | b] = nodes
                    nodes += 1
                node = step
            self.token[node] = i
        self.inner = {key >> 8 for key in self.child}
        self.apart: dict[tuple, bool] = {}
        self.forget()

    def forget(self) -> None:
        start = ((0, -1, 0),)
        self.states, self.number, self.step = [start], {start: 0}, {}

    def merged(self, raw: bytes) -> list[int]:
        """The tokens of a string, by merging the pair of the lowest rank first; used for pairs of tokens only."""
        out = [self.single[b] for b in raw]
        while len(out) > 1:
            rank, at = min((self.merges.get(pair, (len(self.merges), 0))[0], i) for i, pair in enumerate(zip(out, out[1:], strict=False)))
            if rank == len(self.merges):
                break
            out[at : at + 2] = [self.merges[out[at], out[at + 1]][1]]
        return out

    def stays(self, last: int, token: int) -> bool:
        """Whether ``token`` stays a token behind ``last`` (-1: at the start)."""
        known = self.apart.get((last, token))
        if known is None:
            if len(self.apart) > PAIRS_HELD:
                self.apart.clear()
            whole = [token] if last < 0 else [last, token]
            known = self.apart[last, token] = self.merged(b"".join(self.bytes[t] for t in whole)) == whole
        return known

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        """The transition from a state by a byte: next state and emitted count."""
        child = self.child.get
        reached = [(node, last, more) for before, last, more in self.states[state] if (node := child(before << 8 | byte)) is not None]
        for node, last, more in reached:
            token = self.token.get(node)
            if token is not None and self.stays(last, token):
                emitted = 1 - more
                break
        after = (*[(node, last, more + emitted) for node, last, more in reached if node in self.inner], (0, token, 0))
        number = self.number.get(after)
        if number is None:
            number = self.number[after] = len(self.states)
            self.states.append(after)
        self.step[state << 8 | byte] = out = number, emitted
        return out

    def count(self, raw: bytes) -> int:
        if len(self.states) > STATES_HELD:
            self.forget()
        state = total = 0
        step, get = self.step, self.step.get
        for b in raw:
            state, emitted = get(state << 8 | b) or self.compile(state, b)
            total += emitted
            if len(self.states) > 2 * STATES_HELD:
                # Only a very long piece comes here: its state is taken along into fresh tables.
                kept = self.states[state]
                self.forget()
                step, get = self.step, self.step.get
                if kept not in self.number:
                    self.number[kept] = len(self.states)
                    self.states.append(kept)
                state = self.number[kept]
        return total


class PieceCounts(dict):
    """Token counts of pieces, emitted by the merge transducer when a piece is first met."""

    def __init__(self, merges: MergeTransducer):
        self.merges = merges

    def __missing__(self, piece: str) -> int:
        out = self.merges.count(piece.encode())
        if len(self) > PIECES_HELD:
            self.clear()
        if len(piece) <= 20:
            self[piece] = out
        return out


class Transducer:
    """The compiled pattern and merges; made once in a worker."""

    def __init__(self, path: str, classes: bytes):
        import json

        with open(path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f)["added_tokens"]]
        step, emit = compile_transducer()
        self.width = len(CLASSES)
        self.step, self.emit = (step * self.width).ravel(), emit.ravel()
        self.classes = np.frombuffer(zlib.decompress(classes), np.uint8)
        self.white = np.isin(self.classes, [CLASSES.index("white"), CLASSES.index("space")])
        self.counts = PieceCounts(MergeTransducer(path))

    def entry_states(self, kinds: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Entry state of each chunk. ``kinds`` (position, chunk); ``first`` marks the chunks that begin a text."""
        n = kinds.shape[1]
        states = np.repeat((np.arange(len(STATES), dtype=np.uint8) * self.width)[:, None], n, axis=1)
        for row in kinds:
            states = self.step.take(states + row)
        maps = states // self.width
        # Prefix scan of the chunk maps: after each round a map covers twice as many chunks, but none before its text.
        maps[:, first] = maps[0, first]
        since = np.arange(n) - np.maximum.accumulate(np.where(first, np.arange(n), 0))
        reach = 1
        while reach <= since.max(initial=0):
            later = np.flatnonzero(since >= reach)
            maps[:, later] = maps[maps[:, later - reach], later]
            reach *= 2
        entry = np.zeros(n, np.uint8)
        follows = np.flatnonzero(~first)
        entry[follows] = maps[0, follows - 1]
        return entry

    def boundaries(self, points: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Marks of the characters that begin a piece, for texts laid end to end; ``lengths`` are positive."""
        chunks = -(-lengths // CHUNK)
        starts = np.cumsum(chunks) - chunks
        total = int(chunks.sum())
        first = np.zeros(total, bool)
        first[starts] = True
        places = np.arange(len(points)) + np.repeat(starts * CHUNK - (np.cumsum(lengths) - lengths), lengths)
        kinds = np.full(total * CHUNK, self.width - 1, np.uint8)
        kinds[places] = self.classes[points]
        kinds = np.ascontiguousarray(kinds.reshape(total, CHUNK).T)
        state = self.entry_states(kinds, first) * np.uint8(self.width)
        out = np.empty((CHUNK, total), np.uint8)
        for j, row in enumerate(kinds):
            at = state + row
            out[j] = self.emit.take(at)
            state = self.step.take(at)
        marks = out.T.ravel()[places]
        begins = marks & HERE
        begins[:-1] |= marks[1:] >> 1
        ends = np.cumsum(lengths)
        final = state[starts + chunks - 1] // self.width
        begins[ends[np.isin(final, [STATES.index("quote_rv"), STATES.index("quote_l")])] - 1] = 1
        begins[ends - lengths] = 1
        return begins

    def slab(self, texts: list[str]) -> np.ndarray:
        """Token counts of ``texts``, none empty."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        starts = np.flatnonzero(self.boundaries(points, lengths))
        bounds = [*starts.tolist(), len(points)]
        emitted = np.fromiter(map(self.counts.__getitem__, map(joined.__getitem__, map(slice, bounds, bounds[1:]))), np.int64, len(starts))
        return np.add.reduceat(emitted, np.searchsorted(starts, np.cumsum(lengths) - lengths))

    def count(self, texts: list[str]) -> list[int]:
        """Token counts of whole texts. Parts that surely end at a piece boundary are counted apart and added up."""
        out = [0] * len(texts)
        parts, owners, held = [], [], 0

        def flush() -> None:
            for i, n in zip(owners, self.slab(parts).tolist() if parts else (), strict=True):
                out[i] += n
            parts.clear(), owners.clear()

        for i, text in enumerate(texts):
            plain = [text]
            for special in self.special:
                if any(special in p for p in plain):
                    split = [p.split(special) for p in plain]
                    out[i] += sum(len(p) - 1 for p in split)
                    plain = [x for p in split for x in p]
            for part in plain:
                for cut in safe_cuts(part, self.white):
                    if held and held + len(cut) > SLAB:
                        flush()
                        held = 0
                    if cut:
                        parts.append(cut), owners.append(i)
                        held += len(cut)
        flush()
        return out


def safe_cuts(text: str, white: np.ndarray):
    """``text`` in parts of about ``SLAB`` characters, cut before a white space that follows something else: always a boundary."""
    begin = 0
    while len(text) - begin > SLAB:
        at = begin + SLAB // 2
        while at < len(text) and not (white[ord(text[at])] and not white[ord(text[at - 1])]):
            at += 1
        yield text[begin:at]
        begin = at
    yield text[begin:]


def _count_batches(path: str, classes: bytes):
    def run(batches):
        held = worker_cache("transducers")
        if path not in held:
            held[path] = Transducer(path, classes)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            n_bytes = pa.array([len(t.encode()) for t in texts], pa.int64())
            counts = held[path].count(texts)
            over = pa.array([n > 512 for n in counts], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n_bytes, pa.array(counts, pa.int64()), over], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than 512 tokens) of every row of ``docs (doc_id long, text)``."""
    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_count_batches(path, character_classes(path)), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
