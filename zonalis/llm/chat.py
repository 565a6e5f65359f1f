"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, encoded once with offsets, and the sorted spans of its assistant
texts are intersected with the token spans by binary search. Turns stand between control strings
which are single tokens, so no token straddles a text's edge. A backslash escapes control strings
(and itself) inside texts, which makes rendering reversible.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The control strings of the template.
START, BODY, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
TRAINED_ROLE = "assistant"
#: Conversations that are encoded before they are handed on.
BATCH = 256
_UNESCAPE = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<\|im_start\|>(.*?)<\|im_sep\|>(.*?)<\|im_end\|>", re.S)


def escape(text: str) -> str:
    """A backslash is doubled and one is put inside ``<|``, so no result holds ``<|``."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def render(turns: list[tuple[str | None, str | None]]) -> tuple[str, np.ndarray]:
    """The conversation, and (start, end) of each trained text in code points."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = START + escape(role or "") + BODY, escape(text or "")
        at += len(head)
        if role == TRAINED_ROLE:
            spans.append((at, at + len(body)))
        at += len(body) + len(END)
        parts += [head, body, END]
    return "".join(parts), np.array(spans, np.int64).reshape(-1, 2)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def mask(offsets: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """For each token (start, end), sorted: whether it lies within one of the sorted spans."""
    if not len(spans) or not len(offsets):
        return np.zeros(len(offsets), bool)
    i = np.searchsorted(spans[:, 0], offsets[:, 0], "right") - 1
    ends = spans[np.maximum(i, 0), 1]
    return (i >= 0) & (offsets[:, 1] <= ends) & (offsets[:, 1] > offsets[:, 0])


def masked_text(formatted: str, offsets: np.ndarray, on: np.ndarray) -> str:
    """The characters under the mask, each once (a character may be split over tokens), unescaped."""
    own = offsets[on]
    if not len(own):
        return ""
    reach = np.maximum.accumulate(own[:, 1])
    first = np.flatnonzero(np.concatenate([[True], own[1:, 0] > reach[:-1]]))  # where a run of characters starts
    ends = reach[np.concatenate([first[1:] - 1, [len(own) - 1]])]
    return unescape("".join(formatted[a:b] for a, b in zip(own[first, 0].tolist(), ends.tolist(), strict=True)))


def offsets_of(encoding) -> np.ndarray:
    """(start, end) of each token, in code points."""
    return np.fromiter(chain.from_iterable(encoding.offsets), np.int32, 2 * len(encoding)).reshape(-1, 2)


@lru_cache(2)
def load_tokenizer(path: str):
    """The worker's tokenizer, loaded once: a byte-level tokenizer whose only special tokens are the control strings; offsets cover white space."""
    from tokenizers import AddedToken, Tokenizer, processors

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    t.post_processor = processors.ByteLevel(trim_offsets=False)
    t.add_special_tokens([AddedToken(x, special=True, normalized=False) for x in (START, BODY, END)])
    return t


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """A list column of arrays, without a Python object a value."""
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.zeros(0), kind))


def conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, turns): the rows of a conversation by turn, role and text, nulls first."""
    turn = F.struct("turn", "role", "text")
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def format_chats(rows: DataFrame, path: str | None = None) -> DataFrame:
    """conv_id, formatted, input_ids, loss_mask (one boolean a token), and what is read back from them:
    turns (role, text) from the formatted text, loss_text from under the mask. A row a conversation.

    rows: conv_id, turn, role, text. A null text or role is empty. Turns come in the order of turn, then
    role and text, so ties have one order; repeated rows are turns of their own, and rows with a null
    conv_id are one conversation. An empty table gives an empty table; other columns are not read. A
    conversation is one row of one task, and is encoded whole, without truncation.
    """
    path = path or tokenizer_path()
    schema = "conv_id bigint, formatted string, input_ids array<int>, loss_mask array<boolean>, turns array<struct<role:string,text:string>>, loss_text string"

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        t = load_tokenizer(path)
        for b in batches:
            for i in range(0, b.num_rows, BATCH):
                part = b.slice(i, BATCH)
                own = part.column(1).flatten()
                turns = list(zip(own.field("role").to_pylist(), own.field("text").to_pylist(), strict=True))
                ends = np.cumsum(pc.list_value_length(part.column(1)).to_numpy()).tolist()
                rendered = [render(turns[x:y]) for x, y in zip([0, *ends], ends, strict=False)]
                ids, masks, losses = [], [], []
                for formatted, spans in rendered:
                    e = t.encode(formatted, add_special_tokens=False)
                    offsets = offsets_of(e)
                    on = mask(offsets, spans)
                    ids.append(np.fromiter(e.ids, np.int32, len(e)))
                    masks.append(on)
                    losses.append(masked_text(formatted, offsets, on))
                read = [parse(formatted) for formatted, _ in rendered]
                flat = list(chain.from_iterable(read))
                structs = pa.StructArray.from_arrays([pa.array([r for r, _ in flat], pa.string()), pa.array([x for _, x in flat], pa.string())], ["role", "text"])
                again = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, read)], dtype=np.int32)), structs)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([x for x, _ in rendered], pa.string()), lists(ids, pa.int32()), lists(masks, pa.bool_()), again, pa.array(losses, pa.string())],
                    ["conv_id", "formatted", "input_ids", "loss_mask", "turns", "loss_text"],
                )

    own = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    return conversations(own).mapInArrow(encoded, schema)
