"""Token counts by a deterministic transducer compiled from a tokenizer's merges.

A byte-pair encoding is valid when each two neighbours are what their joined text encodes to. So the
last token of a prefix's encoding is the one piece that ends there and stands well after the last
token of the shorter prefix where it starts. A state holds what later characters can depend on: the
longest suffix that still begins a piece, and, for every place in it where a piece may begin, the last
token there and how many tokens fewer that prefix has. A transition carries how many tokens its
character adds to the encoding of what was read (merges make it zero or negative). Where no piece
holds two neighbouring characters, nothing before matters: the transition resets. States and
transitions are determinised from the merges when first met, and kept up to a limit.

Texts are read in chunks. What a chunk does is a map from the state before it to the state after it and
a count: an action on the state up to the first reset, and constants from there. Maps compose
associatively, and a balanced scan composes them. A chunk is itself cut at spaces that reset: the map of
such a word is one number, and the numbers of words that were met are kept.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 14
#: What a worker keeps: beyond so many transitions it forgets all and determinises anew; beyond so many
#: words it runs further ones each time.
TRANSITIONS, WORDS = 500_000, 300_000
#: Longer words are not kept.
WORD_CHARS = 48
MARK = "▁"
_RESET, _UNIT = re.compile("(?<=[^ ]) "), re.compile(" +[^ ]*")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a message in the protobuf wire format."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        wire = key & 7
        if wire == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(wire) or varint()
        yield key >> 3, data[at : at + size]
        at += size


def load_pieces(data: bytes) -> dict[str, float]:
    """Score of each piece of a BPE model, its space marks as spaces. The model must split as this module
    does: no normalisation, a space in front, escaped spaces, unknown characters as bytes, no pieces of
    the user's own."""
    # Field numbers and enumerations of the model's format.
    normal, control, unknown, as_byte, bpe = 1, 3, 2, 6, 2
    scores, trainer, normalizer = {}, {}, {}
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            kind = piece.get(3, normal)
            if kind == normal:
                scores[piece[1].decode().replace(MARK, " ")] = struct.unpack("<f", piece[2])[0]
            elif kind not in (control, unknown, as_byte):
                raise ValueError(f"a piece of kind {kind} is not supported")
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normalizer = dict(_fields(value))
    if trainer.get(3, 1) != bpe or not trainer.get(35, 0) or trainer.get(24, 0):
        raise ValueError("not a byte-pair model with byte fallback and leading space marks")
    if normalizer.get(2) or not normalizer.get(3, 1) or normalizer.get(4, 1) or not normalizer.get(5, 1):
        raise ValueError("the model normalises texts")
    return scores


class State(dict):
    """Character -> (next state, tokens added). begun: length, last token and count, less the current one,
    of each prefix after which a piece may begin; tail: the characters since the first of them."""

    __slots__ = ("owner", "tail", "begun")

    def __init__(self, owner: Transducer, tail: str, begun: tuple[tuple[int, str, int], ...]):
        self.owner, self.tail, self.begun = owner, tail, begun

    __hash__ = object.__hash__

    def __missing__(self, c: str) -> tuple[State, int]:
        edge = self.owner.compile(self, c)
        self[c] = edge
        return edge


class ChunkMap:
    """State -> (state, count): act up to the first reset; from there the state end and a count, whatever
    came before. Without a reset end is None."""

    __slots__ = ("act", "end", "count")

    def __init__(self, act: Callable[[State], tuple[State, int]], end: State | None = None, count: int = 0):
        self.act, self.end, self.count = act, end, count

    def __call__(self, state: State) -> tuple[State, int]:
        state, n = self.act(state)
        return (state, n) if self.end is None else (self.end, n + self.count)

    def then(self, other: ChunkMap) -> ChunkMap:
        if self.end is not None:
            end, n = other(self.end)
            return ChunkMap(self.act, end, self.count + n)

        def act(state: State) -> tuple[State, int]:
            state, n = self.act(state)
            state, m = other.act(state)
            return state, n + m

        return ChunkMap(act, other.end, other.count)


class Words(dict):
    """Tokens of words that start with a reset. prefix stands in front of every word of this table."""

    def __init__(self, owner: Transducer, prefix: str):
        self.owner, self.prefix = owner, prefix

    def __missing__(self, word: str) -> int:
        _, n = self.owner.run(self.owner.start, self.prefix + word)
        if len(word) <= WORD_CHARS and len(self) < self.owner.most_words:
            self[word] = n
        return n


class Transducer:
    def __init__(self, scores: dict[str, float], transitions: int = TRANSITIONS, words: int = WORDS):
        self.scores, self.limit, self.most_words = scores, transitions, words
        self.spaced, self.bare = Words(self, " "), Words(self, "")
        self.prefixes = {p[:n] for p in scores for n in range(1, len(p))}
        #: Neighbours that some piece holds; between others no merge can happen.
        self.inner = {p[i : i + 2] for p in scores for i in range(len(p) - 1)}
        #: Whether a space after another character always resets.
        self.cut = not any(x[1] == " " != x[0] for x in self.inner)
        self._clear()

    def _clear(self) -> None:
        self.states: dict[tuple, State] = {}
        self.stands: dict[tuple[str, str], bool] = {}
        self.made = 0
        self.start = self._state("", ((0, "", 0),))

    def _state(self, tail: str, begun: tuple) -> State:
        return self.states.setdefault((tail, begun), State(self, tail, begun))

    def merge(self, text: str) -> list[str]:
        """The merges applied to a short text: best score first, then leftmost."""
        parts = list(text)
        while True:
            best = None
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best[0]):
                    best = (score, i)
            if best is None:
                return parts
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    def stand(self, a: str, b: str) -> bool:
        """Whether b may follow a: their joined text encodes to the two."""
        if not a or a[-1] + b[0] not in self.inner:
            return True
        known = self.stands.get((a, b))
        if known is None:
            known = self.stands[a, b] = self.merge(a + b) == [a, b]
        return known

    def compile(self, state: State, c: str) -> tuple[State, int]:
        if self.made >= self.limit:
            self._clear()
        self.made += 1
        tail, begun = state.tail, state.begun
        if not tail or tail[-1] + c not in self.inner:  # a reset
            tail, begun = "", ((0, "", 0),)
        if c not in self.scores:
            return self._state(c, ((0, "", 0),)), len(c.encode("utf-8", "surrogatepass"))
        last, added = next((p, n + 1) for size, before, n in begun if (p := tail[len(tail) - size :] + c) in self.scores and self.stand(before, p))
        kept = [(size + 1, before, n - added) for size, before, n in begun if tail[len(tail) - size :] + c in self.prefixes]
        kept.append((0, last, 0))
        return self._state((tail + c)[-max(1, kept[0][0]) :], tuple(kept)), added

    def run(self, state: State, text: str) -> tuple[State, int]:
        n = 0
        for c in text:
            state, added = state[c]
            n += added
        return state, n

    def words(self, text: str) -> tuple[State, int]:
        """The state after a text that starts with a reset at a space, and its count."""
        if "  " in text:
            *units, last = _UNIT.findall(text)
            n = sum(map(self.bare.__getitem__, units))
        else:
            _, *units, last = text.split(" ")
            n, last = sum(map(self.spaced.__getitem__, units)), " " + last
        state, m = self.run(self.start, last)
        return state, n + m

    def chunk(self, text: str) -> ChunkMap:
        """What the chunk does to any state."""
        if self.cut and (first := _RESET.search(text)):
            head, rest = text[: first.start()], self.words(text[first.start() :])
        else:
            at = next((i for i in range(1, len(text)) if text[i - 1 : i + 1] not in self.inner), None)
            if at is None:
                return ChunkMap(lambda state: self.run(state, text))
            head, rest = text[:at], self.run(self.start, text[at:])
        return ChunkMap(lambda state: self.run(state, head), *rest)

    def scan(self, maps: list[ChunkMap]) -> ChunkMap:
        while len(maps) > 1:
            maps = [maps[i].then(maps[i + 1]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    def count(self, text: str | None) -> int:
        """Tokens of a text; null and empty texts have none."""
        if not text:
            return 0
        text = " " + text.replace(MARK, " ")
        return self.scan([self.chunk(text[i : i + CHUNK]) for i in range(0, len(text), CHUNK)])(self.start)[1]


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_compiled: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """The worker's transducer for a model: what one task has determinised serves the next."""
    if path not in _compiled:
        with open(path, "rb") as f:
            _compiled[path] = Transducer(load_pieces(f.read()))
    return _compiled[path]


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than limit tokens) for each row.

    path: a sentencepiece BPE model without normalisation and with byte fallback, which is checked when
    it is loaded; every executor has the file. Null and empty texts have no bytes and no tokens; repeated
    rows are counted alike; a null doc_id stays null; an empty table gives an empty table; other columns
    are not read. Texts are counted whole, and strings that look like special tokens are ordinary text.
    """
    path = path or tokenizer_path()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([t.count(x) for x in b.column(2).to_pylist()], pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), "text")
    return own.mapInArrow(counted, "doc_id bigint, n_bytes bigint, n_tokens bigint").withColumn("over_limit", F.col("n_tokens") > limit)
