"""Token ids of whole texts through a public tokenizer, with a cache of words inside each Python worker.

A vocabulary splits a text before it merges, and never across the places where
:class:`Coder` cuts it, so the ids of a text are the ids of its cuts in order:

* before white space (of a byte-level vocabulary: before a run of it, and before
  the last sign of a run that a word follows, as that sign belongs to the word;
  not beside white space outside of ASCII),
* before a mark of :data:`_ENDINGS` that stands behind a Latin letter.

Cuts are found by numpy on a batch's bytes and numbered by Arrow's dictionary
encoding, so each different cut of a batch is looked up once. New cuts go to the
tokenizer: plain words straight to its merging model, as they are one piece for
its splitter, all else to the whole tokenizer. A text that holds the string of a
special token is one cut. The cache is emptied when it holds ``most`` cuts or
``most_bytes``, and at a task's end (:func:`tidy`).

Null texts are empty.
"""

from __future__ import annotations

import ctypes
import os
import re
from collections.abc import Callable, Iterator
from functools import wraps
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Marks that may end a word; a vocabulary's pattern has them apart from letters.
_ENDINGS = b".,!?;:#$%&*|"


def _table(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


_SPACE, _ENDING = _table(b" \t\n\x0b\x0c\r"), _table(_ENDINGS)
_LETTER = _table(bytes(range(65, 91)) + bytes(range(97, 123)))
#: Second bytes of two-byte letters after 0xC3 (Latin-1 but for the two signs of arithmetic).
_SECOND = _table(bytes(b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)))

#: A word that a splitter leaves whole: Latin and Cyrillic letters, with a blank before it or not.
_WORD = re.compile("[ \t\n\x0b\x0c\r]?[A-Za-zÀ-ÖØ-öø-ɏЁА-яё]+")


def _byte_signs() -> dict[int, str]:
    """The sign of each byte in a byte-level vocabulary: itself if it is printed, else the next one from 256 up."""
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printed]
    return {b: chr(b) for b in printed} | {b: chr(256 + k) for k, b in enumerate(rest)}


_SIGNS = _byte_signs()

_coders: dict[tuple[str, bool], "Coder"] = {}


def coder(path: str, spaces_count: bool) -> "Coder":
    """This worker's coder for a vocabulary file; it stays for later tasks, without its cache."""
    if (path, spaces_count) not in _coders:
        _coders[path, spaces_count] = Coder(path, spaces_count)
    return _coders[path, spaces_count]


class Coder:
    """Ids of texts, as the tokenizer's ``encode(text, add_special_tokens=False)`` gives them.

    ``spaces_count``: the vocabulary's tokens hold white space (a byte-level
    one); else white space only separates, and letters are lower-cased.
    """

    def __init__(self, path: str, spaces_count: bool, most: int = 400_000, most_bytes: int = 64_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile(b"|".join(map(re.escape, special))) if special else None
        self.spaces_count, self.most, self.most_bytes = spaces_count, most, most_bytes
        self._empty()

    def _empty(self) -> None:
        self.known: dict[str, int] = {}
        self.start = np.zeros(1 << 14, np.int64)
        self.length = np.zeros(1 << 14, np.int64)
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = self.held = 0

    def _cuts(self, raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where the cuts of the texts that begin at ``starts`` begin."""
        n = len(raw)
        first = np.zeros(n + 1, bool)
        first[starts] = True
        first[n] = True
        padded = np.concatenate([np.zeros(3, np.uint8), raw, np.zeros(2, np.uint8)])
        behind = lambda at, k: padded[at + (3 - k)]
        at = np.flatnonzero(_SPACE[raw])
        if self.spaces_count:
            follows = padded[at + 4]
            run = first[at] | ~_SPACE[behind(at, 1)]
            last = ~first[at + 1] & ~_SPACE[follows]
            one, two, three = behind(at, 1), behind(at, 2), behind(at, 3)
            odd = (one >= 0x80) & ((two == 0xC2) | ((three >= 0xE1) & (three <= 0xE3) & (two >= 0x80)))
            odd |= (follows == 0xC2) | ((follows >= 0xE1) & (follows <= 0xE3))
            at = at[(run | last) & ~odd]
        mark = np.zeros(n, bool)
        mark[at] = True
        at = np.flatnonzero(_ENDING[raw])
        mark[at[_LETTER[behind(at, 1)] | ((behind(at, 2) == 0xC3) & _SECOND[behind(at, 1)])]] = True
        if self.special:
            for m in self.special.finditer(memoryview(raw)):  # such a text is one cut
                k = int(np.searchsorted(starts, m.start(), "right"))
                mark[starts[k - 1] : starts[k] if k < len(starts) else n] = False
        mark[starts[starts < n]] = True
        return np.flatnonzero(mark)

    def _learn(self, keys: list[str]) -> None:
        """Add cuts to the cache."""
        ids: list[list[int]] = []
        named: list[str] = []
        rest: list[str] = []
        pieces = self.model.tokenize
        if self.spaces_count:
            for key in keys:
                if key[:1] in "\t\n\x0b\x0c\r" or not _WORD.fullmatch(key):
                    rest.append(key)
                    continue
                piece = key.replace(" ", "Ġ") if key.isascii() else key.encode().decode("latin-1").translate(_SIGNS)
                ids.append([t.id for t in pieces(piece)])
                named.append(key)
        else:
            for key in keys:
                low = key.lower()
                if not _WORD.fullmatch(low):
                    rest.append(key)
                    continue
                low = low.strip()
                ids.append([t.id for t in pieces(low if low.isascii() else low.encode().decode("latin-1").translate(_SIGNS))])
                named.append(key)
        ids += [e.ids for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)]
        named += rest
        at, n = len(self.known), len(named)
        lengths = np.fromiter(map(len, ids), np.int64, n)
        total = int(lengths.sum())
        while at + n > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), np.uint32, total)
        self.length[at : at + n] = lengths
        self.start[at : at + n] = self.used + np.cumsum(lengths) - lengths
        self.used += total
        self.held += sum(map(len, named)) + 200 * n + 4 * total  # about what an entry takes
        self.known.update(zip(named, range(at, at + n)))

    def encode(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one text after the other, and the number of ids of each."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if column.null_count:
            column = column.fill_null("")
        if len(self.known) > self.most or self.held > self.most_bytes:
            self._empty()
        raw, starts = raw_bytes(column)
        cuts = self._cuts(raw, starts[:-1]) if len(raw) else np.zeros(0, np.int64)
        ends = pa.py_buffer(np.append(cuts, len(raw)).astype(np.int32))
        coded = pa.Array.from_buffers(pa.string(), len(cuts), [None, ends, pa.py_buffer(raw)]).dictionary_encode()
        keys = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        which = np.fromiter(map(self.known.get, keys, repeat(-1)), np.int64, len(keys))
        unknown = np.flatnonzero(which < 0)
        if len(unknown):
            new = [keys[k] for k in unknown.tolist()]
            self._learn(new)
            which[unknown] = np.fromiter(map(self.known.__getitem__, new), np.int64, len(new))
        of_cut = which[coded.indices.to_numpy()]
        lengths = self.length[of_cut]
        ends = np.cumsum(lengths)
        ids = self.flat[np.repeat(self.start[of_cut] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]
        total = np.concatenate([[0], ends])
        return ids, np.diff(total[np.searchsorted(cuts, starts)])


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for a task, which then empties the caches of words and gives freed memory back to the system.

    A Python worker lives on after its task, beside stages that have no use for it.
    """

    @wraps(run)
    def task(batches: Iterator) -> Iterator:
        yield from run(batches)
        for own in _coders.values():
            own._empty()
        give_back()

    return task


#: Bytes of an Arrow batch that Spark hands to a Python worker, and the setting for it.
BATCH_BYTES, BATCH_SETTING = 2 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> bool:
    """From now on the session hands Python workers batches of about ``BATCH_BYTES``, and whether that is new; its own bound stays.

    A batch is held several times: by Spark outside of its heap, as it is filled and as it is sent, and by the worker.
    Unbounded ones have 10,000 texts. No row is cut or left out.
    """
    if spark.conf.get(BATCH_SETTING, None) is not None:
        return False
    spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return True


def give_back() -> None:
    """Gives this process's freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim:
        trim(0)


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of texts without nulls, and where each text begins, with the end of the last."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def slices(column: pa.Array, most_bytes: int = 1 << 20, most_rows: int = 8192) -> Iterator[tuple[int, int]]:
    """Ranges of an array of texts that have about ``most_bytes`` together (one text is never cut)."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = 0
    while first < len(column):
        before = ends[first - 1] if first else 0
        last = min(max(int(np.searchsorted(ends, before + most_bytes, "right")), first + 1), first + most_rows, len(column))
        yield first, last
        first = last


def in_parts(texts: list[str | None], most_chars: int = 1_000_000):
    """Ranges of the list whose texts have about ``most_chars`` characters together (one text is never cut)."""
    first = chars = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > first and chars + n > most_chars:
            yield first, i
            first, chars = i, 0
        chars += n
    if first < len(texts):
        yield first, len(texts)
