"""Encoding and decoding with a sentencepiece BPE model, by vectorised merge rounds.

No piece of the model has a space inside, so words (a run of spaces and what follows up to the next) merge
independently. The distinct words of a batch lie in flat numpy arrays of symbols. Each round takes, by a segmented
minimum, the best-ranked pair of every word, merges its leftmost occurrences at once and closes the gaps; words with
no pair left are done. Words met before come from a bounded cache of the worker.

Long words are cut, first where nothing can merge, then into parts of equal length. The parts of all words go through
the rounds together, and their results are joined: a sequence of tokens is what the rounds give for the whole if each two
neighbours stay as they are when the rounds run on these two alone (no merge can then be the first to cross a seam).
Where two at a seam don't, the tokens around it go through the rounds again, ever more of them until their ends fit. So
the work is about linear in a word's length.

A merge can make a pair better than its own (say "th"+"e" after "t"+"h"): for such pieces only the leftmost
occurrence is merged in a round, for all others every leftmost non-overlapping one, which is the library's order.

A null text counts as empty: its ids are the end id alone if one is asked for. Null ids, repeated rows and any other
columns don't matter to the result of a row. No rows give no rows.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lamina.llm.common import ids_and_text, slices, trimmed

SPACE = "▁"
_NEVER = np.iinfo(np.int32).max
#: Marks a word that follows a line feed and so has no space before it.
_GLUED = "\x01"
#: Words of more characters are cut where nothing can merge, and what is longer still into parts of ``_PART``.
_LONG = 64
_PART = 256
#: Seams whose fit a worker remembers.
_SEAMS = 200_000


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol buffer message."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = message[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value, i

    i = 0
    while i < len(message):
        key, i = varint(i)
        wire = key & 7
        if wire == 0:
            value, i = varint(i)
        else:
            if wire == 2:
                size, i = varint(i)
            else:
                size = {1: 8, 5: 4}[wire]
            value, i = message[i : i + size], i + size
        yield key >> 3, value


class PieceCodec:
    """A BPE model with an identity normaliser, read from its file."""

    NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6

    def __init__(self, path: str, cache_words: int = 200_000):
        with open(path, "rb") as f:
            model = f.read()
        pieces, self.kinds, scores, trainer, normaliser = [], [], [], {}, {}
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                pieces.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, self.NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normaliser = dict(_fields(value))
        if trainer.get(3, 1) != 2 or normaliser.get(2) or normaliser.get(4, 1) or not normaliser.get(3, 1) or not set(self.kinds) <= {1, 2, 3, 6}:
            raise ValueError("needs a BPE model with an identity normaliser that keeps spaces, and no user-defined or unused pieces")
        normal = {p: i for i, p in enumerate(pieces) if self.kinds[i] == self.NORMAL}
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in normal):
            raise ValueError("needs a model whose pieces have no space or line feed inside")
        self.unknown = self.kinds.index(self.UNKNOWN)
        self.end = next((i for i, p in enumerate(pieces) if p == "</s>" and self.kinds[i] == self.CONTROL), None)
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(pieces) if self.kinds[i] == self.BYTE}
        # symbols: a piece's id, or a number of its own for a character that only occurs inside pieces
        self.symbols = dict(normal)
        for c in sorted(set(chain.from_iterable(normal)) - normal.keys()):
            self.symbols[c] = len(pieces) + len(self.symbols)
        self.lone = max(self.symbols.values(), default=0) + 1  # any other character: merges with nothing
        self.width = self.lone + 1
        self.symbol_of = np.full(1 << 16, self.lone, dtype=np.int32)
        for c, i in self.symbols.items():
            if len(c) == 1 and ord(c) < len(self.symbol_of):
                self.symbol_of[ord(c)] = i
        order = {s: r for r, s in enumerate(sorted({scores[i] for i in normal.values()}, reverse=True))}
        pairs = []
        for p, i in normal.items():
            for k in range(1, len(p)):
                left, right = self.symbols.get(p[:k]), self.symbols.get(p[k:])
                if left is not None and right is not None:
                    pairs.append((left * self.width + right, order[scores[i]], i))
        pairs.sort()
        self.keys = np.array([k for k, _, _ in pairs], dtype=np.int64)
        self.ranks = np.array([r for _, r, _ in pairs] + [_NEVER], dtype=np.int32)
        self.merged = np.array([i for _, _, i in pairs] + [-1], dtype=np.int32)
        self.inside = {p[k : k + 2] for p in normal for k in range(len(p) - 1)}
        rank_of = {i: order[scores[i]] for i in normal.values()}
        #: A piece may be merged everywhere at once if no pair that holds it ranks as high as itself or higher.
        lone_first = {s for k, r, _ in pairs for s in divmod(k, self.width) if s in rank_of and r <= rank_of[s]}
        self.everywhere = np.array([i not in lone_first for _, _, i in pairs] + [False])
        self.surface = [self._surface(p, k) for p, k in zip(pieces, self.kinds, strict=True)]
        self.starts_with_space = [k == self.NORMAL and p.startswith(SPACE) for p, k in zip(pieces, self.kinds, strict=True)]
        self.cache: dict[str, bytes] = {}
        self.cache_words = cache_words
        self.length_of = np.ones(self.width, dtype=np.int64)  # characters of a symbol
        for p, i in normal.items():
            self.length_of[i] = len(p)
        self.seams: dict[tuple[str, str], bool] = {}

    def _surface(self, piece: str, kind: int) -> bytes:
        if kind == self.BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == self.UNKNOWN:
            return " ⁇ ".encode()
        return b"" if kind == self.CONTROL else piece.replace(SPACE, " ").encode()

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places of the pairs in the table; its length for those that aren't there."""
        wanted = left.astype(np.int64) * self.width + right
        at = np.searchsorted(self.keys, wanted)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == wanted, at, len(self.keys)) if len(self.keys) else np.zeros(len(wanted), np.int64)

    def merge_rounds(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols that the words (spaces already as the space symbol, none empty) end with, one after another, and
        where each word's start."""
        places = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        symbols = self.symbol_of[np.minimum(places, len(self.symbol_of) - 1)]
        for i in np.flatnonzero(places >= len(self.symbol_of) - 1).tolist():  # beyond the table
            symbols[i] = self.symbols.get(chr(places[i]), self.lone)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        word = np.repeat(np.arange(len(words)), lengths)
        pair = np.full(len(symbols), len(self.keys))
        inner = np.flatnonzero(word[1:] == word[:-1])
        pair[inner] = self._pairs(symbols[inner], symbols[inner + 1])
        ended: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            rank = self.ranks[pair]
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            counts = np.diff(np.r_[starts, len(word)])
            best = np.minimum.reduceat(rank, starts)
            done = best == _NEVER
            if done.any():
                out = np.repeat(done, counts)
                ended.append((word[out], symbols[out]))
                symbols, word, pair, rank = symbols[~out], word[~out], pair[~out], rank[~out]
                best, counts = best[~done], counts[~done]
                if not len(symbols):
                    break
            at = np.flatnonzero(rank == np.repeat(best, counts))
            first = np.r_[True, word[at[1:]] != word[at[:-1]]]
            apart = np.r_[True, at[1:] != at[:-1] + 1]  # starts a run of neighbours, of which every other one merges
            runs = np.flatnonzero(apart)
            even = (np.arange(len(at)) - np.repeat(runs, np.diff(np.r_[runs, len(at)]))) % 2 == 0
            at = at[first | (self.everywhere[pair[at]] & even)]
            symbols[at] = self.merged[pair[at]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[at + 1] = False
            now = at - np.arange(len(at))  # after the gaps are closed
            symbols, word, pair = symbols[keep], word[keep], pair[keep]
            changed = np.zeros(len(symbols), dtype=bool)
            changed[now] = True
            changed[now[now > 0] - 1] = True
            near = np.flatnonzero(changed)
            if near[-1] == len(symbols) - 1:
                pair[near[-1]] = len(self.keys)
                near = near[:-1]
            same = word[near] == word[near + 1]
            pair[near[~same]] = len(self.keys)
            near = near[same]
            pair[near] = self._pairs(symbols[near], symbols[near + 1])
        if not ended:
            return np.zeros(0, np.int32), np.zeros(len(words) + 1, np.int64)
        word, symbols = (np.concatenate(x) for x in zip(*ended, strict=True))
        order = np.argsort(word, kind="stable")
        return symbols[order], np.r_[0, np.cumsum(np.bincount(word, minlength=len(words)))]

    def _ids(self, words: list[str], symbols: np.ndarray, starts: np.ndarray) -> list[bytes]:
        """Ids of words from their symbols; characters that no piece has become bytes."""
        n = len(self.kinds)
        raw, at = symbols.astype("<i4").tobytes(), (4 * starts).tolist()
        out = [raw[a:z] for a, z in zip(at, at[1:], strict=False)]
        odd = np.unique(np.searchsorted(starts, np.flatnonzero(symbols >= n), side="right") - 1)
        for i in odd.tolist():
            ids, place = [], 0
            for s in symbols[starts[i] : starts[i + 1]].tolist():
                if s < n:
                    ids.append(s)
                    place += len(self.surface[s].decode())
                else:
                    ids += [self.bytes.get(b, self.unknown) for b in words[i][place].encode()] if self.bytes else [self.unknown]
                    place += 1
            out[i] = np.array(ids, dtype="<i4").tobytes()
        return out

    def _segments(self, word: str) -> list[str]:
        """A long word cut between characters that no piece has next to each other, where nothing can merge."""
        if len(word) <= _LONG:
            return [word]
        cuts = [0, *(i for i in range(1, len(word)) if word[i - 1 : i + 1] not in self.inside), len(word)]
        return [word[a:z] for a, z in zip(cuts, cuts[1:], strict=False)]

    def _tokens(self, parts: list[str]) -> list[list[str]]:
        """The strings that the rounds leave of each part."""
        symbols, starts = self.merge_rounds(parts)
        out = []
        for part, a, z in zip(parts, starts.tolist(), starts[1:].tolist(), strict=False):
            ends = np.cumsum(self.length_of[symbols[a:z]]).tolist()
            out.append([part[x:y] for x, y in zip([0, *ends], ends, strict=False)])
        return out

    def _fit(self, pairs: list[tuple[str, str]]) -> list[bool]:
        """Whether two neighbouring tokens stay as they are."""
        if len(self.seams) > _SEAMS:
            self.seams.clear()
        fresh = list(set(pairs).difference(self.seams))
        if fresh:
            self.seams.update((pair, len(t) == 2 and t[0] == pair[0]) for pair, t in zip(fresh, self._tokens([a + b for a, b in fresh]), strict=True))
        return [self.seams[p] for p in pairs]

    def _seamless(self, segments: list[str]) -> dict[str, list[str]]:
        """The tokens of long segments."""
        cut = {s: [s[k : k + _PART] for k in range(0, len(s), _PART)] for s in segments}
        kinds = list(set(chain.from_iterable(cut.values())))
        tokens = dict(zip(kinds, self._tokens(kinds), strict=True)) if kinds else {}
        self._fit([(tokens[a][-1], tokens[b][0]) for parts in cut.values() for a, b in zip(parts, parts[1:], strict=False)])  # all at once
        joined, met = {}, {}
        for s, parts in cut.items():
            out: list[str] = []
            for part in parts:
                right, near = tokens[part], 8
                if not out or self._fit([(out[-1], right[0])])[0]:
                    out += right
                    continue
                while True:
                    k, j = min(near, len(out)), min(near, len(right))
                    around = "".join(out[-k:] + right[:j])
                    if around not in met:
                        met[around] = self._tokens([around])[0]
                    again = met[around]
                    before, after = out[max(0, len(out) - k - 1) : len(out) - k], right[j : j + 1]
                    if all(self._fit([(a, again[0]) for a in before] + [(again[-1], b) for b in after])):
                        out[-k:] = again + right[j:]
                        break
                    near *= 2
            joined[s] = out
        return joined

    def _words(self, text: str) -> list[str]:
        """Keys of the words: the word without its space, or marked if there is none, or whole from its space symbol."""
        if not text:
            return []
        text = text.replace(SPACE, " ")
        if _GLUED in text:  # rare: no marks then, and whole words as keys
            return re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + text.replace(" ", SPACE))
        parts = (text.replace("\n", f" {_GLUED}\n") if "\n" in text else text).split(" ")
        if "" not in parts:
            return parts
        keys, spaces = [], 0
        for p in parts:
            if p == "":
                spaces += 1
            elif p[0] == _GLUED:
                if spaces:
                    keys.append(" " * (spaces - 1))
                    spaces = 0
                keys.append(p)
            else:
                keys.append(" " * spaces + p)
                spaces = 0
        if spaces:
            keys.append(" " * (spaces - 1))
        return keys

    def encode(self, texts: list[str], end: bool = False) -> list[np.ndarray]:
        """Ids of each whole text, as the library gives them."""
        keys = [self._words(t) for t in texts]
        cache, every = self.cache, set(chain.from_iterable(keys))
        if len(cache) > self.cache_words:  # what this batch has again stays
            cache = self.cache = {k: cache[k] for k in every & cache.keys()}
        fresh = list(every.difference(cache))
        for k in range(0, len(fresh), 20_000):
            part = fresh[k : k + 20_000]
            words = [w[1:] if w[:1] == _GLUED else w if w[:1] == SPACE else SPACE + w.replace(" ", SPACE) for w in part]
            segments = [self._segments(w) for w in words]
            long = self._seamless(list({s for own in segments for s in own if len(s) > _PART}))
            if long:  # their tokens stay what they are in the rounds
                segments = [[t for s in own for t in long.get(s, (s,))] for own in segments]
            flat = list(chain.from_iterable(segments))
            ids = iter(self._ids([w.replace(SPACE, " ") for w in flat], *self.merge_rounds(flat)))
            cache.update((key, b"".join(next(ids) for _ in s)) for key, s in zip(part, segments, strict=True))
        tail = np.array([self.end], dtype="<i4").tobytes() if end else b""
        out = [np.frombuffer(b"".join(map(cache.__getitem__, k)) + tail, dtype="<i4") for k in keys]
        for w in fresh:
            if len(w) > _PART:  # long words are rare and large: not kept
                del cache[w]
        return out

    def decode(self, ids: list[int]) -> str:
        """The library's text of the ids."""
        raw = b"".join(map(self.surface.__getitem__, ids))
        first = next((i for i in ids if self.kinds[i] != self.CONTROL), None)
        if first is not None and self.starts_with_space[first]:
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return self._decode_broken(ids)

    def _decode_broken(self, ids: list[int]) -> str:
        """Runs of bytes that are no UTF-8: each byte that starts no character becomes U+FFFD."""
        out, run, bos = [], b"", True

        def settle() -> None:
            nonlocal run
            at = 0
            while at < len(run):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(run[at : at + n].decode())
                        at += n
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    at += 1
            run = b""

        for i in ids:
            if self.kinds[i] == self.BYTE:
                run += self.surface[i]
            elif self.kinds[i] != self.CONTROL:
                settle()
                text = self.surface[i].decode()
                out.append(text[1:] if bos and self.starts_with_space[i] else text)
            bos = bos and self.kinds[i] == self.CONTROL
        settle()
        return "".join(out)


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    """Loaded once a worker."""
    return PieceCodec(path)


def encode(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text", end: bool = False, slice_bytes: int = 2 << 20) -> DataFrame:
    """Per row: the id and ``ids`` (array<int>) of the whole text, with the end id after it if ``end``."""
    plain = ids_and_text(docs, id_col, text_col)
    schema = T.StructType([plain.schema[id_col], T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, stop in slices(b.column(1), slice_bytes):
                found = codec(model).encode(b.column(1).slice(start, stop - start).to_pylist(), end)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, stop - start), _listed(found)], names=[id_col, "ids"])

    return plain.mapInArrow(run, schema)


def round_trip(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text", end: bool = False, into: str = "decoded", slice_bytes: int = 2 << 20) -> DataFrame:
    """Per row: the id, ``ids`` as ``encode`` gives them, and the text that these ids decode to: both in one pass through
    one Python worker."""
    plain = ids_and_text(docs, id_col, text_col)
    schema = T.StructType([plain.schema[id_col], T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField(into, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, stop in slices(b.column(1), slice_bytes):
                found = codec(model).encode(b.column(1).slice(start, stop - start).to_pylist(), end)
                texts = pa.array([codec(model).decode(x.tolist()) for x in found], pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, stop - start), _listed(found), texts], names=[id_col, "ids", into])
        trimmed()

    return plain.mapInArrow(run, schema)


def _listed(found: list[np.ndarray]) -> pa.Array:
    offsets = np.r_[0, np.cumsum([len(x) for x in found])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found).astype(np.int32, copy=False)))


def decode(encoded: DataFrame, model: str, *, ids_col: str = "ids", into: str = "text", slice_ids: int = 1 << 19) -> DataFrame:
    """All columns, and the text of the ids (null ids: empty)."""
    schema = T.StructType([*(f for f in encoded.schema if f.name != into), T.StructField(into, T.StringType())])
    kept = [f.name for f in encoded.schema if f.name != into]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = b.column(b.schema.get_field_index(ids_col))
            for start, stop in slices(held, slice_ids):
                part = held.slice(start, stop - start)
                flat, ends = part.flatten().to_numpy(zero_copy_only=False), np.cumsum([len(x) if x.is_valid else 0 for x in part])
                texts = [codec(model).decode(flat[a:z].tolist()) for a, z in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True)]
                others = [b.column(b.schema.get_field_index(c)).slice(start, stop - start) for c in kept]
                yield pa.RecordBatch.from_arrays([*others, pa.array(texts, pa.string())], names=[*kept, into])

    return encoded.mapInArrow(run, schema)
