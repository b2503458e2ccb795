"""Search for many needles at once: an Aho-Corasick automaton as arrays, run over Arrow batches.

The automaton is a table of states by classes of bytes: following a failure is part of the table, so each byte is one
look-up however many needles there are.  Texts are cut into lanes that overlap by the longest needle less one byte, and
all lanes of a batch take a step together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a lane, bytes of text that are searched together, entries of a table at most (more needles make further tables).
LANE, CHUNK, CELLS = 4096, 32_000_000, 2**24


class Automaton:
    """goto: state by class of byte -> state.  A state's needles are its own and those of the states that its failures lead to."""

    def __init__(self, needles: list[bytes], first: int = 0):
        used = sorted({b for n in needles for b in n})
        self.kind = np.zeros(256, np.int64)  # class 0: a byte of no needle
        self.kind[used] = np.arange(1, len(used) + 1)
        next_: list[dict[int, int]] = [{}]
        own: list[list[int]] = [[]]
        for k, needle in enumerate(needles):
            state = 0
            for b in needle:
                if b not in next_[state]:
                    next_[state][b] = len(next_)
                    next_.append({})
                    own.append([])
                state = next_[state][b]
            if needle:
                own[state].append(first + k)
        n = len(next_)
        self.goto = np.zeros((n, len(used) + 1), np.int32)
        self.fail = np.zeros(n, np.int32)
        order = [0]
        for state in order:  # breadth first: a failure leads to a state of less depth, whose row is done
            row = self.goto[state]
            if state:
                row[:] = self.goto[self.fail[state]]
                own[state] = own[state] + own[self.fail[state]]
            for b, child in next_[state].items():
                self.fail[child] = row[self.kind[b]]
                row[self.kind[b]] = child
                order.append(child)
        self.ends = np.cumsum([0] + [len(x) for x in own])
        self.ids = np.array([x for some in own for x in some], np.int32)
        self.size = np.array([len(x) for x in needles], np.int64)
        self.first, self.longest = first, max(map(len, needles), default=0)

    def hits(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, needle, first byte in the text) of every occurrence, by text and last byte."""
        size, step = np.diff(bounds), max(LANE, 4 * self.longest)
        lanes = np.maximum(-(-size // step), 0)
        text = np.repeat(np.arange(len(size)), lanes)
        at = (np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * step  # where the bytes of a lane's own begin
        begin = np.maximum(at - self.longest + 1, 0)
        length = np.minimum(at + step, size[text]) - begin
        order = np.argsort(-length, kind="stable")  # lanes that go on are the first ones
        text, at, begin, length = text[order], at[order], begin[order], length[order]
        base, flat = bounds[:-1][text] + begin, self.goto.ravel()
        classes, width, found = self.kind[data], self.goto.shape[1], self.ends[1:] > self.ends[:-1]
        state, out = np.zeros(len(text), np.int64), []
        live = np.searchsorted(-length, -np.arange(int(length.max(initial=0))), "left")
        for k, n in enumerate(live.tolist()):
            state[:n] = flat[state[:n] * width + classes[base[:n] + k]]
            for lane in np.flatnonzero(found[state[:n]]).tolist():
                if begin[lane] + k >= at[lane]:  # else it is the lane's before
                    out.append((text[lane], begin[lane] + k, state[lane]))
        if not out:
            return (np.zeros(0, np.int64),) * 3
        rows = np.array(out, np.int64)
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        many = self.ends[rows[:, 2] + 1] - self.ends[rows[:, 2]]
        where = np.repeat(self.ends[rows[:, 2]] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        ids = self.ids[where].astype(np.int64)
        return np.repeat(rows[:, 0], many), ids, np.repeat(rows[:, 1], many) + 1 - self.size[ids - self.first]


def automata(needles: list[bytes]) -> list[Automaton]:
    """Automata of consecutive needles, none with more than ``CELLS`` entries (unless one needle has)."""
    out, part, total = [], [], 0
    for k, n in enumerate(needles):
        if part and (total + len(n) + 1) * 257 > CELLS:
            out.append(Automaton(part, k - len(part)))
            part, total = [], 0
        part.append(n)
        total += len(n)
    return [*out, Automaton(part, len(needles) - len(part))] if part else out


def _bytes(needle) -> bytes:
    return needle if isinstance(needle, bytes) else needle.encode()


def search(rows: DataFrame, column: str, needles: list, head: int | None = None, positions: bool = False, as_column: str = "hits") -> DataFrame:
    """rows with the numbers of the needles (their places in the list) that a text or binary column holds, each once; with ``positions`` all
    occurrences as (needle, at), ``at`` in bytes of UTF-8 from 0.  Empty needles are never found, null holds none; ``head`` as in ``files.sniff``.
    """
    rows = rows.drop(as_column)
    shared = rows.sparkSession.sparkContext.broadcast(automata([_bytes(n) for n in needles]))
    at = len(rows.columns)
    body = F.col(column) if head is None else F.substring(F.col(column), 1, head)
    one = pa.struct([("needle", pa.int32()), ("at", pa.int64())]) if positions else pa.int32()
    kind = "array<struct<needle:int,at:bigint>>" if positions else "array<int>"

    def found(texts: pa.Array):
        texts = texts.fill_null(b"").cast(pa.large_binary())
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        a = 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(ends, ends[a] + CHUNK, "right")) - 1)
            parts = [auto.hits(data[ends[a] : ends[b]], ends[a : b + 1] - ends[a]) for auto in shared.value]
            text, ids, place = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(3))
            if positions:
                order = np.lexsort((ids, place, text))
                text, ids, place = text[order], ids[order], place[order]
                values = pa.StructArray.from_arrays([pa.array(ids, pa.int32()), pa.array(place, pa.int64())], fields=list(one))
            else:
                text, ids = np.unique(np.stack([text, ids]), axis=1)
                values = pa.array(ids, pa.int32())
            yield pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(b - a + 1)), pa.int32()), values)
            a = b

    def run(batches):
        for batch in batches:
            lists = pa.chunked_array(list(found(batch.column(at))), pa.list_(one)).combine_chunks()
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], lists], names=[*batch.schema.names[:at], as_column])

    return rows.withColumn(as_column, body.cast("binary")).mapInArrow(run, T.StructType([*rows.schema.fields, *T.StructType.fromDDL(f"`{as_column}` {kind}").fields]))
