"""Token sequences of one length, packed by the sum of squares.

Documents are cut into whole windows; what is left over of each is placed whole, as it
comes, where it makes the sum over fill levels of (number of open windows at that
level) squared smallest. A level array holds those numbers. A window is closed when a
piece fills it up. At the end of a partition the gaps of the fullest open windows are
filled with the tokens of the emptiest ones, so only what those gaps hold is cut a
second time; the same is done in between where over max_open windows are open, as
happens when no two of a partition's pieces fit into one window.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docflow.llm import text as X

WINDOW = 2048
#: Open windows of a partition, 64 MB, above which gaps are filled before its end.
MAX_OPEN = 8192
END_ID = 1
#: Bits of a sequence id that number the sequences of one partition.
BITS = 33
#: Units of text in each of the two generations that a Python worker keeps.
CACHED = 300_000
OTHER, ALPHA, DIGIT, SIGN, QUOTE = range(5)
#: Letters below U+0180 that are lower-cased each by itself; their bytes are 0xC3 to 0xC5 and one more.
LATIN = re.compile("[a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def kinds(data: np.ndarray) -> np.ndarray:
    """Of each byte: a Latin letter, an ASCII digit, another ASCII sign, an apostrophe, or something else."""
    table = np.full(256, OTHER, dtype=np.uint8)
    table[33:127] = SIGN
    table[48:58] = DIGIT
    table[[*range(65, 91), *range(97, 123)]] = ALPHA
    table[39] = QUOTE
    out = table[data]
    lead = np.flatnonzero((data[:-1] >= 0xC3) & (data[:-1] <= 0xC5))
    both = data[lead].astype(np.int64) << 8 | data[lead + 1]
    lead = lead[(both != 0xC397) & (both != 0xC3B7) & (both != 0xC4B0)]  # two signs, and a letter that becomes two
    out[lead] = out[lead + 1] = ALPHA
    return out


class WordIds:
    """Ids of texts, unit by unit: what this tokenizer makes of a unit does not depend on its neighbours.

    It drops white space, takes a run of letters, one digit or a run of other signs at a
    time, and apart from these 's, 't, 're, 've, 'm, 'll and 'd. So words are cut between
    two kinds of characters and around digits, but not after an apostrophe and
    not beside characters of unknown kinds. Units of Latin letters go to the tokenizer's
    model directly, all others through the whole of it.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.new: dict[bytes, bytes] = {}  # units and their ids, as raw numbers
        self.old: dict[bytes, bytes] = {}
        self.letters = _byte_letters()

    def _learn(self, units: list[bytes]) -> list[bytes]:
        names = [self._letters(u) for u in units]
        odd = iter(self.tokenizer.encode_batch_fast([u.decode("utf-8", "replace") for u, name in zip(units, names, strict=True) if name is None], add_special_tokens=False))
        model = self.tokenizer.model
        return [array("I", next(odd).ids if name is None else [t.id for t in model.tokenize(name)]).tobytes() for name in names]

    def _letters(self, unit: bytes) -> str | None:
        """A unit of Latin letters as the model names it, in lower case; else None. Its A-Z are lower-cased before."""
        if unit.isalpha():
            return unit.decode()
        text = unit.decode("utf-8", "replace")
        return text.lower().encode().decode("latin-1").translate(self.letters) if LATIN.fullmatch(text) else None

    def _known(self, units: list[bytes]) -> list[bytes]:
        """The ids of each unit. When the new generation is full, it becomes the old one, whose used units come back."""
        found = list(map(self.new.get, units))
        missing = [i for i, x in enumerate(found) if x is None]
        for i in missing:
            found[i] = self.old.get(units[i])
        ask = [i for i in missing if found[i] is None]
        for i, ids in zip(ask, self._learn([units[i] for i in ask]), strict=True):
            found[i] = ids
        if len(self.new) + len(missing) > CACHED:
            self.new, self.old = {}, self.new
        self.new.update((units[i], found[i]) for i in missing)
        return found

    def units(self, c: X.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and row of each unit of a chunk."""
        kind = kinds(c.data)
        last, now = kind[:-1], kind[1:]
        cut = (last != now) | (now == DIGIT)
        cut &= (last != OTHER) & (now != OTHER)
        cut &= ~((last == QUOTE) & ((now == ALPHA) | (now == SIGN))) & ~((last == SIGN) & (now == QUOTE))
        begins = np.append(False, cut)
        inside = np.zeros(len(c.data) + 1, dtype=np.int8)
        inside[c.starts] += 1
        inside[c.ends] -= 1
        begins &= np.cumsum(inside[:-1]) > 0
        begins[c.starts] = True
        starts = np.flatnonzero(begins)
        word = np.searchsorted(c.starts, starts, "right") - 1
        ends = np.append(starts[1:], len(c.data))[: len(starts)]
        return starts, np.minimum(ends, c.ends[word]), c.row[word]

    def encode(self, c: X.Chunk, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, each row's followed by end_id, and where each row's end."""
        if not len(c.starts):
            return np.full(c.rows, end_id, dtype=np.uint32), np.arange(1, c.rows + 1)
        starts, ends, row = self.units(c)
        _, first, which = np.unique(c.keys(starts, ends), return_index=True, return_inverse=True)
        raw = c.data.tobytes()
        found = self._known([raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)])
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        begin, n = (np.cumsum(size) - size)[which], size[which]
        stop = np.cumsum(n)
        total = int(stop[-1])
        ids = np.frombuffer(b"".join(found), dtype="<u4")[np.repeat(begin - (stop - n), n) + np.arange(total)]
        row_ends = np.cumsum(c.per_row(row, n).astype(np.int64) + 1)
        out = np.full(total + c.rows, end_id, dtype=np.uint32)
        out[np.arange(total) + np.repeat(row, n)] = ids
        return out, row_ends


def _byte_letters() -> dict[int, str]:
    """The characters by which the tokenizer's model names bytes that are not printable ASCII or Latin-1."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}


@cache
def word_ids(path: str) -> WordIds:
    return WordIds(path)


class Packer:
    """Online packing of one partition's pieces. A piece: (key, start, ids as bytes, doc_tokens)."""

    def __init__(self, window: int = WINDOW, max_open: int = MAX_OPEN, first_id: int = 0):
        self.window, self.max_open, self.next_id = window, max_open, first_id
        self.levels = np.zeros(window + 1, dtype=np.int64)  # how many open windows are filled so far; none at 0 and window
        self.open: dict[int, list[list]] = {}  # level: windows, each a list of pieces
        self.recut = 0  # tokens that a gap took from another window
        self.done: list[tuple] = []  # (key, start, ids, doc_tokens, sequence_id, offset)

    def _close(self, pieces: list) -> None:
        offset = 0
        for key, start, ids, n in pieces:
            self.done.append((key, start, ids, n, self.next_id, offset))
            offset += len(ids) // 4
        self.next_id += 1

    def _put(self, level: int, piece: tuple) -> None:
        pieces = []
        if level:
            pieces = self.open[level].pop()
            self.levels[level] -= 1
        pieces.append(piece)
        level += len(piece[2]) // 4
        if level == self.window:
            self._close(pieces)
        else:
            self.open.setdefault(level, []).append(pieces)
            self.levels[level] += 1

    def best_level(self, size: int) -> int:
        """The level, 0 for a new window, at which a piece of that size makes the sum of squares smallest; the fullest of equal ones."""
        at = np.flatnonzero(self.levels[: self.window - size + 1])
        if not len(at):
            return 0
        grown = 2 * self.levels[size : self.window + 1] + 1  # a window more at that level
        grown[-1] = 0  # full ones are closed
        change = grown[at] - 2 * self.levels[at] + 1
        least = change.min()
        return int(at[np.flatnonzero(change == least)[-1]]) if least <= grown[0] else 0

    def add(self, key, ids: np.ndarray) -> None:
        n, at, raw = len(ids), 0, ids.astype("<u4").tobytes()
        while n - at >= self.window:
            self._close([(key, at, raw[4 * at : 4 * (at + self.window)], n)])
            at += self.window
        if at < n:
            self._put(self.best_level(n - at), (key, at, raw[4 * at :], n))
            if self.levels.sum() > self.max_open:
                self._settle()

    def _settle(self) -> list:
        """Fill the gaps of the fullest open windows with the tokens of the emptiest, as long as these suffice; the pieces left, less than a window, stay open and are returned."""
        open_ = [w for level in sorted(self.open) for w in self.open[level]]
        filled = [level for level in sorted(self.open) for _ in self.open[level]]
        total = sum(filled)
        kept = total // self.window
        loose = [p for w in open_[: len(open_) - kept] for p in w]
        for pieces, level in zip(open_[len(open_) - kept :], filled[len(filled) - kept :], strict=True):
            room = self.window - level
            while room:
                key, start, ids, n = loose.pop()
                own = min(room, len(ids) // 4)
                pieces.append((key, start, ids[: 4 * own], n))
                room -= own
                self.recut += own
                if 4 * own < len(ids):
                    loose.append((key, start + own, ids[4 * own :], n))
            self._close(pieces)
        self.open, self.levels[:] = {}, 0
        left = total - kept * self.window
        if left:
            self.open[left] = [loose]
            self.levels[left] = 1
        return loose

    def finish(self) -> None:
        """Fill gaps, and cut the last window at powers of two, which are not padded."""
        left = self._settle()[::-1]
        room = sum(len(p[2]) // 4 for p in left)
        while room:
            size = 1 << (room.bit_length() - 1)
            room, pieces = room - size, []
            while size:
                key, start, ids, n = left.pop()
                own = min(size, len(ids) // 4)
                pieces.append((key, start, ids[: 4 * own], n))
                size -= own
                if 4 * own < len(ids):
                    left.append((key, start + own, ids[4 * own :], n))
            self._close(pieces)
        self.open, self.levels[:] = {}, 0

    def take(self) -> list[tuple]:
        out, self.done = self.done, []
        return out


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, window: int = WINDOW, max_open: int = MAX_OPEN, end_id: int = END_ID) -> DataFrame:
    """One row per piece: key, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Each partition is packed by itself, without a shuffle. The gaps that its open windows
    have at its end are filled with tokens of the emptiest ones, and the last window is cut
    at powers of two, so there is no padding. window must be a power of two. A partition
    holds max_open open windows at most (4 * window bytes each); beyond that, gaps are filled before its end.
    Null and empty texts are a lone end_id. Equal rows are packed each. A text of any
    length is cut into windows. An empty table gives no rows. A sequence id holds the
    number of the partition, so it is the same when a task is repeated.
    """
    if window < 1 or window & (window - 1):
        raise ValueError("window must be a power of two")
    path = tokenizer or default_tokenizer()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(window, max_open, TaskContext.get().partitionId() << BITS)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for c in X.chunks(batch.column(1), lower=True):
                ids, ends = word_ids(path).encode(c, end_id)
                begin = 0
                for i, end in enumerate(ends.tolist()):
                    packer.add(keys[c.first + i], ids[begin:end])
                    begin = end
                yield rows(packer.take())
        packer.finish()
        yield rows(packer.take())

    kind = docs.schema[key].dataType
    fields = [("start", T.LongType()), ("length", T.LongType()), ("ids", T.BinaryType()), ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType())]
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(kind)

    def rows(done: list[tuple]) -> pa.RecordBatch:
        k, start, ids, n, sequence, offset = zip(*done, strict=True) if done else ([],) * 6
        columns = [pa.array(k, arrow), pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), *(pa.array(x, pa.int64()) for x in (n, sequence, offset))]
        return pa.RecordBatch.from_arrays(columns, [key, *(f for f, _ in fields)])

    return docs.select(key, F.col(text).cast("string").alias("_text")).mapInArrow(work, T.StructType([T.StructField(key, kind), *(T.StructField(n, t) for n, t in fields)]))
