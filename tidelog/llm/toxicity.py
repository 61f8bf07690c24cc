"""Toxicity of texts after noisy-channel deobfuscation.

Words may be disguised: letters written as digits or signs (leetspeak), letters
repeated, or spread out with blanks, dots or dashes between them. For a disguised
piece a lattice holds, at each position, the letters that the sign may stand
for, the sign read as itself or as nothing, and the choice of dropping a repeated
letter. Between spread letters a word may end. Viterbi finds the likeliest letters: a character trigram model of the
corpus times the channel's price for each reading. No state is dropped that could still win. Pieces with one reading only
(plain words) are their own decoding.

The restored words are scored by a logistic model over hashed words and their
first letters. It is fitted twice: on all features, then on the ones that carry
weight, so that a long text doesn't add up noise.

The character model counts every document's text (labels play no part). The
logistic model is fitted on the driver on at most about ``sample`` labelled
texts, drawn by a hash of the doc_id; of their features only those that tell the
labels apart come to the driver. All else runs in tasks. Decodings are cached
in each task, and the cache is emptied at a bound of bytes.

Null and empty texts get the score of a text without any feature. Long texts
count whole. Repeated rows get the same score. Of readings of equal price the last by letters counts. Without
labels of both kinds the score is 0. An empty table gives an empty result. Labels of a null id teach nothing. Other
columns, whatever their names, aren't read; :func:`judge` is a column that a caller adds to any table.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch
from .tokens import give_back, slices, tidy

#: What a sign may stand for (fixed values).
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e",
}

_SIGNS = "".join(map(re.escape, LEET))
#: A word with a sign next to a letter, or a letter three times in a row.
_DISGUISED = re.compile(rf"(?:[^\W\d_][{_SIGNS}*])|(?:[{_SIGNS}][^\W\d_])|([^\W\d_])\1\1")
_TRIPLED, _DOUBLED = re.compile(r"(.)\1\1"), re.compile(r"(.)\1")
#: Single characters with blanks or marks between each, at least three.
_SPREAD = re.compile(r"(?<![^\s.,;:])(?:[^\s.,_\-*][ .,_\-*]+){2,}[^\s.,_\-*](?![^\s.,;:!?])")
#: A character of such a run and the gap after it.
_LETTER = re.compile(r"([^\s.,_\-*])([ .,_\-*]*)")
#: Kinds of code points in that pattern: a character of a word, a mark or blank between two, other white space.
_OWN, _BETWEEN, _OTHER = 0, 1, 3
_KINDS = np.zeros(0x110000, np.uint8)
_KINDS[[k for k in range(0x3100) if chr(k).isspace()]] = _OTHER
_KINDS[[ord(c) for c in " .,_-*"]] = _BETWEEN
_EDGES = ".,;:!?\"'()[]{}<>-_*#%&=/\\`~^"

#: Prices of readings, as log probabilities (fixed values).
_PRICE_LEET, _PRICE_ITSELF, _PRICE_NOTHING, _PRICE_DROP, _PRICE_KEEP = -1.0, -0.7, -2.5, -0.3, -0.9
#: Price of a word's end between two letters of a spread passage.
_PRICE_END = -1.0

#: Hashed features: a power of two.
FEATURES = 1 << 20

#: Bytes of tokens that a task remembers, and about what an entry takes besides its letters.
CACHE_BYTES, ENTRY = 32_000_000, 200


def _alphabet() -> np.ndarray:
    """For each code point 0 (no letter), 1 to 26 (a to z) or 27 to 63 (other letters, by remainder)."""
    points = np.arange(0x110000)
    out = np.where(points >= 0xAA, 27 + points % 37, 0).astype(np.uint8)
    out[97:123] = np.arange(1, 27)
    return out


ALPHABET = _alphabet()


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def _code(char: str) -> int:
    return int(ALPHABET[ord(char)])


def count_trigrams(docs: DataFrame) -> np.ndarray:
    """Counts of letter trigrams over all texts, 64 x 64 x 64. Two blanks stand before a text, one behind a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 18, np.int64)
        for batch in batches:
            for a, b in slices(batch.column(0), 1 << 19):
                texts = batch.column(0).slice(a, b - a).to_numpy(zero_copy_only=False)
                points = _points("".join(f"\0\0{t.lower()}" for t in texts if t) + "\0")
                codes = ALPHABET[points]
                letter = codes > 0
                # blanks in a row count as one, apart from those between texts
                codes = codes[np.append(True, letter[1:] | letter[:-1]) | (points == 0)].astype(np.int64)
                total += np.bincount(codes[:-2] << 12 | codes[1:-1] << 6 | codes[2:], minlength=1 << 18)
        total.reshape(64, 64, 64)[:, 0, 0] = 0
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["gram", "n"])

    counts = np.zeros(1 << 18, np.int64)
    for r in docs.select("text").mapInArrow(tidy(run), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        counts[r["gram"]] = r["n"]
    return counts.reshape(64, 64, 64)


def language_model(counts: np.ndarray) -> np.ndarray:
    """log P(c | a, b), trigrams smoothed with bigrams and those with single letters."""
    one = counts.sum((0, 1)) + 0.5
    p1 = one / one.sum()
    two = counts.sum(0)
    p2 = (two + 5 * p1) / (two.sum(1, keepdims=True) + 5)
    p3 = (counts + 5 * p2[None]) / (counts.sum(2, keepdims=True) + 5)
    return np.log(p3).astype(np.float32)


def _without_doubles(word: str) -> list[str]:
    """All readings of a word with one or both of each two equal letters."""
    read, at = [""], 0
    for m in _DOUBLED.finditer(word):
        read = [r + word[at : m.start()] + x for r in read for x in (m[1], m[1] * 2)]
        at = m.end()
    return [r + word[at:] for r in read]


@dataclass
class Decoder:
    """Viterbi over a piece's lattice under the language model; keeps what it has decoded."""

    model: np.ndarray
    most_bytes: int = 8_000_000
    known: dict[str, str] = field(default_factory=dict)
    held: int = 0

    def __getstate__(self):
        return {"model": self.model, "most_bytes": self.most_bytes, "known": {}, "held": 0}

    def decode(self, piece: str, ends: list[float] | None = None) -> str:
        """The likeliest letters of a disguised piece; a blank stands for a sign read as itself.

        ``ends``: what a word's end before each character costs; without it only signs end words. The time is linear in
        the piece's length: a state's text is a chain of (chain before, letter).
        """
        if ends is None and piece in self.known:
            return self.known[piece]
        lm, least = self._rows()
        #: (last two codes) -> (log probability, chain)
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for k, char in enumerate(piece):
            if ends is not None and k:
                for (a, b), (p, chain) in list(states.items()):
                    if b and (q := p + ends[k] + lm[a][b][0]) > states.get((b, 0), (-1e30,))[0]:
                        states[b, 0] = (q, (chain, " "))
            repeated = k > 0 and char == piece[k - 1]
            own = _code(char)
            readings = [(char, _PRICE_KEEP if repeated else 0.0)] if own else [(" ", _PRICE_ITSELF)]
            readings += [(x, _PRICE_LEET) for x in LEET.get(char, "")]
            gone = _PRICE_DROP if repeated and own else None if own else _PRICE_NOTHING
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (p, chain) in states.items():
                if gone is not None and (p + gone) > new.get((a, b), (-1e30,))[0]:
                    new[a, b] = (p + gone, chain)
                for letter, price in readings:
                    c = _code(letter)
                    if c == 0 and b == 0:
                        q, to = p + price, (0, 0)
                    else:
                        q, to = p + price + lm[a][b][c], (b, c)
                    if q > new.get(to, (-1e30,))[0]:
                        new[to] = (q, (chain, letter))
            # two more letters make any two states alike; one that is further behind than these can cost won't catch up
            floor = max(p for p, _ in new.values()) + 2 * least
            states = {s: x for s, x in new.items() if x[0] >= floor}
        last = [(p + (lm[a][b][0] if b else 0.0), chain) for (a, b), (p, chain) in states.items()]
        most = max(p for p, _ in last)
        best = max(self._text(chain) for p, chain in last if p == most)
        if ends is None:
            if self.held > self.most_bytes:
                self.known.clear()
                self.held = 0
            self.known[piece] = best
            self.held += len(piece) + len(best) + ENTRY
        return best

    @staticmethod
    def _text(chain: tuple | None) -> str:
        letters = []
        while chain:
            chain, letter = chain
            letters.append(letter)
        return "".join(reversed(letters))

    def _rows(self) -> tuple[list, float]:
        """The model as lists, and its least log probability."""
        if not hasattr(self, "_lists"):
            self._lists = self.model.tolist(), float(self.model.min())
        return self._lists

    def words(self, token: str, matters: Callable[[list[str]], object] | None = None) -> list[str]:
        """The restored words of a token without blanks (lower case).

        A plain word with doubled letters is read with and without them; where ``matters`` is given, only if it is
        true of one of the readings (of more than 8 doubles, too many to ask of each: of the likeliest, which is the one added).
        """
        bare = token.strip(_EDGES)
        if bare.isalpha() and not _TRIPLED.search(bare):
            doubles = len(_DOUBLED.findall(bare))
            if not doubles or matters and not matters(_without_doubles(bare) if doubles <= 8 else [bare, *self.decode(bare).split()]):
                return [bare]
            return [bare, *self.decode(bare).split()]
        words = re.findall(r"[^\W\d_]+", token)
        if _DISGUISED.search(token):
            words += self.decode(token).split()
        return words

    def spread(self, text: str) -> list[str]:
        """Words written with blanks or marks between their letters.

        A run is read as one word and as several, which may end at each gap; one that is wider than the least
        of the run costs nothing.
        """
        words, end = [], 0
        kinds = _KINDS[_points(text)]
        between, own = kinds == _BETWEEN, kinds == _OWN
        for at in (np.flatnonzero(between[:-2] & own[1:-1] & between[2:]).tolist() if len(kinds) > 4 else ()):
            if at < end:
                continue
            while at > 0 and between[at]:
                at -= 1
            m = _SPREAD.match(text, at) if at >= end else None
            if m:
                end = m.end()
                pieces = _LETTER.findall(m[0])
                joined = "".join(c for c, _ in pieces)
                narrow = min(len(gap) for _, gap in pieces[:-1])
                ends = [0.0, *(_PRICE_END if len(gap) == narrow else 0.0 for _, gap in pieces[:-1])]
                words += dict.fromkeys(self.decode(joined).split() + self.decode(joined, ends).split())
        return words


def feature_code(part: str) -> int:
    """Hash of a word, or of the beginning of one after a ``^``."""
    return zlib.crc32(part.encode("utf-8", "replace")) & (FEATURES - 1)


def feature_codes(word: str) -> list[int]:
    """Hashes of a word and of its beginnings of 4 to 6 letters."""
    return [feature_code(word), *(feature_code("^" + word[:n]) for n in (4, 5, 6) if len(word) >= n)]


def _tokens(text: str, decoder: Decoder) -> tuple[set[str], list[str]]:
    low = text.lower()
    return set(low.split()), decoder.spread(low)


def text_features(text: str, decoder: Decoder) -> np.ndarray:
    """The distinct features of a text to learn from; doubled letters stay as they are written."""
    tokens, extra = _tokens(text, decoder)
    words = set(extra)
    for t in tokens:
        words.update(decoder.words(t, lambda _: False))
    return np.array(sorted({c for w in words if w for c in feature_codes(w)}), np.int32)


@dataclass
class Model:
    """Weights by feature, and the score's offset."""

    weights: np.ndarray
    bias: float
    decoder: Decoder


def _train(rows: list[np.ndarray], y: np.ndarray, dims: int, penalty: float, rounds: int) -> tuple[np.ndarray, float]:
    """Logistic regression by accelerated gradient steps."""
    counts = np.array([len(r) for r in rows])
    cols = np.concatenate(rows) if len(rows) else np.zeros(0, np.int32)
    owner = np.repeat(np.arange(len(rows)), counts)
    w, bias = np.zeros(dims), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    v, vb = w.copy(), bias
    seen = np.bincount(cols, minlength=dims)
    step = 1.0 / (0.25 * np.sqrt(np.maximum(seen, 1)) * max(1.0, np.sqrt(counts.mean() if len(counts) else 1.0)) + penalty)
    for t in range(rounds):
        z = np.bincount(owner, weights=v[cols], minlength=len(rows)) + vb
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        g = np.bincount(cols, weights=(p - y)[owner], minlength=dims) + penalty * v
        new, new_bias = v - step * g, vb - (p - y).mean() * 2
        v, vb = new + (t / (t + 3)) * 0.5 * (new - w), new_bias
        w, bias = new, new_bias
    return w, bias


def fit(docs: DataFrame, labels: DataFrame, sample: int = 12_000, least: int = 3, strong: float = 0.25) -> Model | None:
    """A model from all texts of ``docs`` (for the characters) and from its documents in ``labels`` (doc_id and toxic).

    The labels are drawn before their texts are looked up, so at most about ``sample`` ids are broadcast. A document
    with both labels teaches nothing.
    """
    decoder = Decoder(language_model(count_trigrams(docs)))
    one = (
        labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most"))
        .where(F.col("toxic") == F.col("most")).select("doc_id", "toxic")
    )
    sizes = {r["toxic"]: r["count"] for r in one.groupBy("toxic").count().collect()}
    if not sizes.get(1) or not sizes.get(0):
        return None
    third = sample / 3
    toxic = min(1.0, third / sizes[1])
    clean = min(1.0, (sample - min(third, sizes[1])) / sizes[0])
    draw = F.pmod(F.xxhash64(F.lit("draw"), "doc_id"), F.lit(1 << 30)) / (1 << 30)
    drawn = one.where(draw < F.when(F.col("toxic") == 1, F.lit(toxic)).otherwise(F.lit(clean)))
    chosen = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(drawn), "doc_id")  # bounded by ``sample``

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(0)):
                codes = [text_features(t, decoder) for t in batch.column(0).slice(a, b - a).to_numpy(zero_copy_only=False)]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a).cast(pa.int32()), pa.array(codes, pa.list_(pa.int32()))], ["toxic", "codes"])

    # copies teach once
    taught = scratch.keep(chosen.select("text", "toxic").mapInArrow(tidy(run), "toxic int, codes array<int>").distinct(), "toxicity-taught")
    texts, marked = taught.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not texts:
        return None
    base = marked / texts
    per_code = taught.select("toxic", F.explode("codes").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t"))
    telling = (F.col("n") >= max(least, 0.003 * marked)) & (F.abs(F.col("t") / F.col("n") - base) > 1.5 * F.sqrt(F.lit(base * (1 - base)) / F.col("n")))
    kept = np.array(sorted(r["code"] for r in per_code.where(telling).select("code").collect()), np.int32)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.flatnonzero(np.isin(kept, c.values.to_numpy())).astype(np.int32).tobytes() for c in batch.column(1)]
            whole = [c.values.to_numpy().tobytes() for c in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary()), pa.array(whole, pa.binary())], ["toxic", "places", "codes"])

    # in a fixed order: sums of weights are rounded by it
    ordered = taught.mapInArrow(tidy(places), "toxic int, places binary, codes binary").orderBy("codes", "toxic")
    got = [(bytes(r["places"]), r["toxic"]) for r in ordered.select("places", "toxic").collect()]
    rows = [np.frombuffer(c, np.int32) for c, _ in got]
    y = np.array([t for _, t in got], float)
    w, bias = _train(rows, y, len(kept), 0.3, 200)
    strongest = np.abs(w) >= strong * np.abs(w).max(initial=0)
    place = np.where(strongest, np.cumsum(strongest) - 1, -1)
    rows, kept = [x[x >= 0] for x in (place[r] for r in rows)], kept[strongest]
    w, bias = _train(rows, y, len(kept), 0.1, 400)
    give_back()
    weights = np.zeros(FEATURES, np.float32)
    weights[kept] = w
    return Model(weights, bias, decoder)


def judge(text: Column, model: Model | None) -> Column:
    """The score of a text. Only the text goes through Python."""
    if model is None:
        return F.lit(0.0)
    shared = SparkSession.active().sparkContext.broadcast(model)  # its size depends on FEATURES and the alphabet alone

    @F.arrow_udf("double")
    @tidy
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        decoder, weights = own.decoder, own.weights
        #: Codes of the features with weight that a token brings, and those that a beginning of six letters does.
        known: dict[str, tuple[int, ...]] = {}
        begun: dict[str, tuple[int, ...]] = {}
        held = 0
        weighty = (weights != 0).tobytes()

        def codes_of(words: list[str]) -> tuple[int, ...]:
            codes: tuple[int, ...] = ()
            for w in filter(None, words):
                start = w[:6]
                if start not in begun:
                    begun[start] = tuple(c for c in feature_codes(start)[1:] if weighty[c])
                own = feature_code(w)
                codes += begun[start] + ((own,) if weighty[own] else ())
            return codes

        def score(text: str) -> float:
            nonlocal held
            found: set[int] = set()
            tokens, extra = _tokens(text, decoder)
            for t in tokens.difference(known):
                known[t] = codes_of(decoder.words(t, codes_of))
                held += len(t) + ENTRY
            for codes in filter(None, map(known.__getitem__, tokens)):
                found.update(codes)
            if extra:
                found.update(codes_of(extra))
            if held > CACHE_BYTES:
                known.clear()
                begun.clear()
                held = 0
            return sum(float(weights[c]) for c in sorted(found))

        for batch in batches:
            out = np.zeros(len(batch))
            for a, b in slices(batch):
                out[a:b] = [score(t) if t else 0.0 for t in batch.slice(a, b - a).to_numpy(zero_copy_only=False)]
            yield pa.array(1 / (1 + np.exp(-np.clip(own.bias + out, -30.0, 30.0))))

    return run(text)


def score(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and the score of every row of ``docs``."""
    return docs.select(*keep, judge(F.col("text"), model).alias("score"))
