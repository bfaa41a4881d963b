"""Operator 9: sum-of-squares online packing of tokenised documents into windows.

Each document becomes its token ids and one end id. What fills whole windows is cut off as full windows; the rest, less
than a window, is placed online into the fill level that minimises the sum over levels of the squared count of
partially filled windows (Csirik, Johnson et al.). A level array holds the counts. A task keeps at most
``open_windows`` windows open. When there are more, and at its end, the fullest of them keep their pieces, and the gaps
that are left in them are filled with pieces of the emptiest, cut to fit: what moves is as much as the gaps hold. A task
leaves at most one window unfilled, in which the padding lies.

No shuffle is needed: windows are local to a task, and the ids of a task's windows derive from its partition number, so
a task that runs again gives the same rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.llm.bytetext import span_hashes, text_slices

WINDOW = 2048
END_ID = 1
OPEN_WINDOWS = 2048
CACHE_ENTRIES = 300_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_length long"

_SPECIAL = "<|endoftext|>"
_LETTER, _NUMBER, _SPACE, _OTHER, _FOREIGN = range(5)


def _classes() -> np.ndarray:
    """Classes of code points below 0x2100; those that libraries may class by Unicode version count as foreign."""
    import unicodedata

    table = np.full(0x2101, _FOREIGN, np.uint8)
    for code in [*range(0x300), *range(0x2010, 0x2028)]:
        kind = unicodedata.category(chr(code))
        table[code] = _LETTER if kind[0] == "L" else _NUMBER if kind[0] == "N" else _OTHER
    table[[*range(9, 14), 0x20, 0x85, 0xA0]] = _SPACE
    return table


class Encoder:
    """Token ids of many texts; every distinct piece of a slice is encoded once.

    The byte-level vocabulary splits a text into pieces (optional blank and letters, numbers or other marks; white
    space) and encodes each by itself. Pieces are found with array operations over code points, made distinct by hash,
    and looked up in a bounded cache; new ones are merged by the same vocabulary (equality is tested). Texts that hold characters outside the classed
    ranges, contractions or a special token go to the tokenizer whole.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves in the vocabulary
        moved = [b for b in range(256) if b not in set(plain)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(moved)}
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        ranks = {bytes(byte_of[c] for c in piece): i for piece, i in self.tokenizer.get_vocab().items() if piece not in special}
        self.pieces = tiktoken.Encoding("pieces", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})  # ids follow the order of merges
        self.classes = _classes()
        self.clear()

    def clear(self) -> None:
        self.known: dict[int, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.bounds = np.zeros(1, np.int64)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        lengths = np.array([len(c) for c in codes])
        if not lengths.sum():
            return out
        code = np.concatenate(codes)
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        kind = self.classes[np.minimum(code, 0x2100)]
        odd = kind == _FOREIGN
        quote = np.flatnonzero(code[:-1] == 0x27)
        odd[quote[np.isin(code[quote + 1], [ord(c) for c in "strvmld"])]] = True
        odd[:-1] |= (code[:-1] == ord("<")) & (code[1:] == ord("|"))
        strange = np.add.reduceat(np.append(odd, False), offsets[:-1])[:] > 0
        strange &= lengths > 0
        slow = np.flatnonzero(strange)
        for i, ids in zip(slow, self.whole([texts[i] for i in slow]), strict=True):
            out[i] = ids
        plain = np.flatnonzero(~strange & (lengths > 0))
        if not len(plain):
            return out
        if len(plain) < len(texts):
            code = np.concatenate([codes[i] for i in plain])
            kind = self.classes[code]
            offsets = np.concatenate([[0], np.cumsum(lengths[plain])])
        n = len(code)
        # A piece starts where the class changes; a blank before marks belongs to them; the last character of a longer
        # run of white space before other text stands apart from the run.
        begins = np.ones(n, bool)
        begins[1:] = kind[1:] != kind[:-1]
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        begins |= first[:-1]
        space = kind == _SPACE
        last = np.zeros(n, bool)  # white space right before other text of the same row
        last[:-1] = space[:-1] & ~space[1:] & ~first[1:-1]
        blank = last & (code == 0x20)
        after = np.flatnonzero(blank) + 1
        begins[after] = False
        begins |= last
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], n)
        narrow = code.astype(np.uint16)
        hashes = span_hashes(narrow, starts, ends)
        distinct, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        slots = np.array([self.known.get(h, -1) for h in distinct.tolist()], np.int64)
        new = np.flatnonzero(slots < 0)
        if len(new):
            if len(self.known) + len(new) > CACHE_ENTRIES:
                self.clear()
                new = np.arange(len(distinct))
            joined = code.tobytes().decode("utf-32-le")
            found = list(map(self.pieces.encode_ordinary, [joined[a:b] for a, b in zip(starts[where[new]].tolist(), ends[where[new]].tolist(), strict=True)]))
            slots[new] = np.arange(len(self.known), len(self.known) + len(new))
            self.known.update(zip(distinct[new].tolist(), slots[new].tolist(), strict=True))
            self._keep(found)
        bounds = self.bounds
        slot = slots[inverse]
        sizes = bounds[slot + 1] - bounds[slot]
        total = np.concatenate([[0], np.cumsum(sizes)])
        flat = self.flat[np.repeat(bounds[slot] - total[:-1], sizes) + np.arange(total[-1])]
        cuts = total[np.searchsorted(starts, offsets)]
        for k, i in enumerate(plain.tolist()):
            out[i] = flat[cuts[k] : cuts[k + 1]]
        return out

    def _keep(self, found: list[list[int]]) -> None:
        bounds = self.bounds[-1] + np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        while bounds[-1] > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.bounds[-1] : bounds[-1]] = np.fromiter(chain.from_iterable(found), np.uint32, int(bounds[-1] - self.bounds[-1]))
        self.bounds = np.concatenate([self.bounds, bounds])


class Levels:
    """The open windows of one task by fill level."""

    def __init__(self, window: int, most: int, numbered: int) -> None:
        self.window, self.most = window, most
        self.counts = np.zeros(window + 1, np.int64)
        self.open: list[list[tuple[int, list]]] = [[] for _ in range(window)]
        self.held = self.moved = 0
        self.next = numbered

    def number(self) -> int:
        self.next += 1
        return self.next - 1

    def place(self, piece: tuple) -> Iterator[tuple]:
        """Puts a piece (row, start, ids) into a window; gives the rows of the window if that fills it."""
        size, b = len(piece[2]), self.window
        counts = self.counts
        best, level = 2 * int(counts[size]) + 1, 0
        here = counts[1 : b - size + 1]
        if len(here):
            there = counts[size + 1 : b + 1]
            change = np.where(here > 0, 2 * (there - here) + 2, 1 << 40)
            if here[-1] > 0:
                change[-1] = 1 - 2 * here[-1]
            at = len(change) - 1 - int(np.argmin(change[::-1]))
            if change[at] <= best:
                level = at + 1
        if level:
            number, pieces = self.open[level].pop()
            counts[level] -= 1
            self.held -= 1
        else:
            number, pieces = self.number(), []
        pieces.append(piece)
        if level + size == b:
            yield from rows_of(number, pieces, b)
            return
        self.open[level + size].append((number, pieces))
        counts[level + size] += 1
        self.held += 1
        if self.held > self.most:
            yield from self.drain(False)

    def drain(self, final: bool) -> Iterator[tuple]:
        """Fills the fullest open windows with pieces of the emptiest, which are cut to fit; unless final, the one that is left stays open.

        Only pieces of the windows that are dissolved move; ``moved`` counts their ids.
        """
        held = [[level, number, pieces] for level in range(self.window - 1, 0, -1) for number, pieces in self.open[level]]
        self.open = [[] for _ in range(self.window)]
        self.counts[:] = 0
        self.held = 0
        i, j = 0, len(held) - 1
        while i < j:
            fill, number, pieces = held[i]
            row, start, ids = held[j][2].pop()
            n = min(len(ids), self.window - fill)
            pieces.append((row, start, ids[:n]))
            held[i][0] += n
            held[j][0] -= n
            self.moved += n
            if n < len(ids):
                held[j][2].append((row, start + n, ids[n:]))
            if held[i][0] == self.window:
                yield from rows_of(number, pieces, self.window)
                i += 1
            if not held[j][0]:
                j -= 1
        if i == j:
            fill, number, pieces = held[i]
            if final:
                yield from rows_of(number, pieces, fill if fill & (fill - 1) == 0 else self.window)
            else:
                self.open[fill].append((number, pieces))
                self.counts[fill] = self.held = 1


def rows_of(number: int, pieces: list, padded: int) -> Iterator[tuple]:
    offset = 0
    for (doc_id, total), start, ids in pieces:
        yield doc_id, start, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes()), total, number, offset, padded
        offset += len(ids)


def pack(docs: DataFrame, tokenizer_path: str, *, window: int = WINDOW, end_id: int = END_ID, open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """One row per piece of each document's ids.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. A null or empty text is the end id alone. Every
    row of the input is a document of its own, repeated rows and null ``doc_id`` included. An empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, levels = Encoder(tokenizer_path), Levels(window, open_windows, TaskContext.get().partitionId() << 32)
        rows: list[tuple] = []
        for batch in batches:
            names = batch.column(0).to_pylist()
            for i, j, data, offsets in text_slices(batch.column(1)):
                raw = data.tobytes()
                texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                for doc_id, ids in zip(names[i:j], encoder.encode(texts), strict=True):
                    ids = np.append(ids, np.uint32(end_id))
                    row, cut = (doc_id, len(ids)), len(ids) // window * window
                    for start in range(0, cut, window):
                        rows += rows_of(levels.number(), [(row, start, ids[start : start + window])], window)
                    if cut < len(ids):
                        rows += levels.place((row, cut, ids[cut:].copy()))
                if len(rows) > 20_000:
                    yield _batch(rows)
                    rows = []
        rows += levels.drain(True)
        if rows:
            yield _batch(rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])
