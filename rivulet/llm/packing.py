"""Packing of tokenised documents into training windows (sum-of-squares rule).

Every scan task packs its own rows, without a shuffle.  A document's whole
windows leave at once; its rest goes to the fill level h (an open window with h
ids, or a new one at 0) for which the sum of the squared counts of open windows
per level grows least, kept in one level array.  Open windows are bounded by
``max_open``: beyond it, and at the end of a task, they are poured together,
cutting documents, which leaves full windows and one tail; the last tail is cut
into sequences whose lengths are powers of two and need no padding.

Defined results: a null or empty text is the lone end id; a null doc_id is kept;
repeated rows are packed as often as they come; an empty table gives no rows.
Sequence ids are task << 36 | counter, so a task that runs again repeats them.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from rivulet.llm.textbatch import give_back, kept, parts, pick, texts

WINDOW = 2048
END_ID = 1
#: Words whose ids a worker remembers; the table is emptied when full.
MEMO = 500_000

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def _byte_chars() -> list[str]:
    """The character that byte-level vocabularies write for each byte: itself if it is visible, else the next free one from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b if b in visible else next(free)) for b in range(256)]


_BYTE_CHARS = _byte_chars()


class WordMemo(dict):
    """Ids (little-endian uint32) of the parts of a text between white space.

    Exact for tokenizers that lower-case, drop white space and match no token
    across it, nor across a letter and a full stop or comma.  Special tokens match
    as they are written: a word that holds one goes to the tokenizer unchanged, under
    a key that no word has; other words can't match one once they are lower-cased.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.exact = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.special = [t.content.encode() for t in self.exact.get_added_tokens_decoder().values()]
        self.model, self.direct = self.tokenizer.model, False
        # words of letters alone skip the tokenizer's splitting where that gives the same ids
        self.direct = all(self._ids(w) == self._word(w.encode()) for w in ("the", "idiosyncrasy", "straße", "ÉTÉ", "ªñÿ"))

    def _ids(self, word: str) -> list[int]:
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def _word(self, word: bytes) -> list[int] | None:
        """Ids of a word of Latin-1 letters from the model itself; None for other words."""
        if word.isalpha():
            text = word.decode().lower()
        else:
            text = word.decode()
            if not (text.isalpha() and max(text) < "\u0100"):
                return None
            text = "".join(map(_BYTE_CHARS.__getitem__, text.lower().encode()))
        return [t.id for t in self.model.tokenize(text)]

    def __missing__(self, word: bytes) -> bytes:
        if word[:1] == b" ":
            ids = array("I", self.exact.encode(word[1:].decode(), add_special_tokens=False).ids).tobytes()
        elif word[-1:] in b".," and word[-2:-1].isalpha():
            ids = self[word[:-1]] + self[word[-1:]]
        else:
            found = self._word(word) if self.direct else None
            ids = array("I", self._ids(word.decode()) if found is None else found).tobytes()
        self[word] = ids
        return ids

    def encode(self, docs: list[bytes], end: int) -> Iterator[np.ndarray]:
        """The ids of each text and the end id."""
        last = np.array([end], "<u4").tobytes()
        for text in docs:
            if len(self) > MEMO:
                self.clear()
            words = text.lower().split()
            if any(t in text for t in self.special):
                words = [b" " + w if any(t in w for t in self.special) else w.lower() for w in text.split()]
            yield np.frombuffer(b"".join(map(self.__getitem__, words)) + last, "<u4")


def worker_memo(path: str) -> WordMemo:
    """One memo for all tasks of a worker process, as long as it packs; it changes no result."""
    return kept(("packing", path), lambda: WordMemo(path))


class SumOfSquares:
    """Online packing of pieces shorter than a window.

    A piece is (document, start, ids).  ``place`` and ``pour`` return finished
    sequences, each a list of pieces.
    """

    def __init__(self, window: int = WINDOW, max_open: int = 4096):
        self.window, self.max_open = window, max_open
        self.levels = np.zeros(window + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(window)]
        self.n_open = 0

    def level(self, size: int) -> int:
        """The fill level at which the sum of squares grows least; the fullest of several."""
        n = self.window - size + 1
        at = self.levels[:n]
        grows = np.where(at > 0, 1 - 2 * at, np.iinfo(np.int64).max >> 1)
        grows[0] = 0
        onto = 2 * self.levels[size:] + 1
        onto[-1] = 0
        grows = grows + onto
        return n - 1 - int(np.argmin(grows[::-1]))

    def place(self, piece: tuple) -> list[list]:
        size = len(piece[2])
        h = self.level(size)
        if h:
            window = self.open[h].pop()
            self.levels[h] -= 1
            self.n_open -= 1
        else:
            window = []
        window.append(piece)
        if h + size == self.window:
            return [window]
        self._keep(window, h + size)
        return self.pour(last=False) if self.n_open > self.max_open else []

    def _keep(self, window: list, fill: int) -> None:
        self.open[fill].append(window)
        self.levels[fill] += 1
        self.n_open += 1

    def pour(self, last: bool) -> list[list]:
        """Pour all open windows together; at the last time the tail goes out too."""
        done, now, room = [], [], self.window
        for group in self.open:
            for doc, start, ids in chain.from_iterable(group):
                while len(ids):
                    part, ids = ids[:room], ids[room:]
                    now.append((doc, start, part))
                    start += len(part)
                    room -= len(part)
                    if not room:
                        done.append(now)
                        now, room = [], self.window
            group.clear()
        self.levels[:] = 0
        self.n_open = 0
        if now and last:
            done += self._tail(now)
        elif now:
            self._keep(now, self.window - room)
        return done

    def _tail(self, pieces: list) -> list[list]:
        """Sequences whose lengths are powers of two, largest first."""
        total, out, rest = sum(len(p[2]) for p in pieces), [], iter(pieces)
        doc, start, ids = next(rest)
        while total:
            room = 1 << (total.bit_length() - 1)
            total -= room
            now = []
            while room:
                if not len(ids):
                    doc, start, ids = next(rest)
                part, ids = ids[:room], ids[room:]
                now.append((doc, start, part))
                start += len(part)
                room -= len(part)
            out.append(now)
        return out


def _rows(sequences: list[list], first: int) -> pa.RecordBatch:
    flat = [(doc, start, ids, first + k, offset) for k, seq in enumerate(sequences) for (doc, start, ids), offset in zip(seq, _offsets(seq))]
    return pa.record_batch(
        {
            "doc_id": pa.array([x[0][0] for x in flat], pa.int64()),
            "start": pa.array([x[1] for x in flat], pa.int64()),
            "length": pa.array([len(x[2]) for x in flat], pa.int64()),
            "ids": pa.array([x[2].tobytes() for x in flat], pa.binary()),
            "doc_tokens": pa.array([x[0][1] for x in flat], pa.int64()),
            "sequence_id": pa.array([x[3] for x in flat], pa.int64()),
            "offset": pa.array([x[4] for x in flat], pa.int64()),
        }
    )


def _offsets(seq: list) -> list[int]:
    out, at = [], 0
    for _, _, ids in seq:
        out.append(at)
        at += len(ids)
    return out


def pack(docs: DataFrame, tokenizer_path: str, *, window: int = WINDOW, end_id: int = END_ID, max_open: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: its document, its place there, its ids (little-endian
    uint32), and its sequence and place in it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, packer = worker_memo(tokenizer_path), SumOfSquares(window, max_open)
        number = TaskContext.get().partitionId() << 36
        ready: list[list] = []
        for batch in batches:
            for part in parts(batch):
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), memo.encode(texts(part.column("text")), end_id)):
                    doc, whole = (doc_id, len(ids)), len(ids) - len(ids) % window
                    ready += [[(doc, at, ids[at : at + window])] for at in range(0, whole, window)]
                    if whole < len(ids):
                        ready += packer.place((doc, whole, ids[whole:]))
                    if len(ready) >= 1000:
                        yield _rows(ready, number)
                        number += len(ready)
                        ready = []
            give_back()
        ready += packer.pour(last=True)
        if ready:
            yield _rows(ready, number)
        batch = part = doc = ids = packer = ready = None
        give_back()

    return pick(docs, id_col, text_col).mapInArrow(run, SCHEMA)
