"""Token ids in one compressed wavelet matrix per shard.

Documents are dealt by ranges of their id, sorted, encoded and packed: a shard holds whole documents, about
``shard_tokens`` ids. Its file is one binary value: a head, the documents' ids and lengths, and for each bit of a token
id a plane of packed bits with counts of ones before every block of 512. ``access``, ``rank`` (counting) and ``select``
(the place of an occurrence) work on the file without decoding it. The files are the ``payload`` values of a Parquet
table compressed with zstd, so that Spark's committer guards them against lost and repeated tasks on any file system.

Null texts are empty documents (the end id alone). Null document ids sort first and are kept. Equal document ids go by
text. Other columns don't matter. No documents give no shards.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.llm.common import ids_and_text, input_partitions, slices, written

_MAGIC = b"LWM1"
#: Places or ids that one lookup may list.
_MOST_ASKED = 100_000
#: Starts of parts (16 bytes each) that are sent to all tasks.
_MOST_SENT = 1 << 18
_BLOCK = 512
# White space, letters and numbers among the Latin-1 characters, and how the byte-level tokenizers split a
# text before merging.
_SPACES, _LETTERS, _NUMBERS = r"\t-\r \x85\xa0", r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe"
_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^{_SPACES}{_LETTERS}{_NUMBERS}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+"
#: Which ASCII characters may end a stretch (1: before a space, 2: before any that is no letter), and which may follow it.
_BEFORE = np.array([3 if chr(b).isalpha() and b < 0x80 or b >= 0x80 else 1 if b > 0x20 else 0 for b in range(256)], np.uint8)
_AFTER = np.array([3 if b == 0x20 else 0 if b >= 0x80 or chr(b).isalpha() else 2 for b in range(256)], np.uint8)
#: Words whose ids a worker keeps, and stretches of columns, of so many characters at most.
_KNOWN_WORDS = 300_000
_KNOWN_STRETCHES = 1_000_000
_KNOWN_LENGTH = 64
#: Bytes of texts that are encoded together.
_SLICE_BYTES = 4 << 20


class WaveletMatrix:
    """Bit-planes of a sequence of small non-negative integers, highest bit first; each plane is in the order that the
    stable partitions by the bits before have left."""

    def __init__(self, n: int, zeros: list[int], planes: list[np.ndarray], blocks: list[np.ndarray]):
        self.n, self.zeros, self.planes, self.blocks = n, zeros, planes, blocks

    @classmethod
    def build(cls, values: np.ndarray, bits: int) -> WaveletMatrix:
        n, zeros, planes, blocks = len(values), [], [], []
        for k in range(bits - 1, -1, -1):
            one = (values & values.dtype.type(1 << k)).astype(bool)
            packed = np.packbits(one, bitorder="little")
            packed = np.pad(packed, (0, -len(packed) % (_BLOCK // 8)))
            per_block = np.bitwise_count(packed.view(np.uint64)).reshape(-1, _BLOCK // 64).sum(axis=1, dtype=np.uint32)
            planes.append(packed)
            blocks.append(np.concatenate([np.zeros(1, np.uint32), np.cumsum(per_block, dtype=np.uint32)]))
            z, parted = n - int(np.count_nonzero(one)), np.empty_like(values)
            np.compress(one, values, out=parted[z:])
            np.compress(np.logical_not(one, out=one), values, out=parted[:z])
            values = parted
            zeros.append(z)
        return cls(n, zeros, planes, blocks)

    def _ones(self, level: int, i: np.ndarray) -> np.ndarray:
        """Ones before the places ``i`` of a plane."""
        i = np.asarray(i)
        words = self.planes[level].view(np.uint64)
        block = i // _BLOCK
        out = self.blocks[level][block].astype(np.int64)
        for k in range(_BLOCK // 64):
            at = block * (_BLOCK // 64) + k
            left = np.clip(i - at * 64, 0, 64)
            word = words[np.minimum(at, len(words) - 1)] if len(words) else np.zeros(i.shape, np.uint64)
            mask = np.where(left == 64, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << left.astype(np.uint64) % np.uint64(64)) - np.uint64(1))
            out += np.bitwise_count(word & mask)
        return out

    def _bit(self, level: int, i: np.ndarray) -> np.ndarray:
        return self.planes[level][i >> 3] >> (i & 7).astype(np.uint8) & 1

    def access(self, places: np.ndarray) -> np.ndarray:
        """Values at the places."""
        i = np.asarray(places, dtype=np.int64)
        value = np.zeros(i.shape, dtype=np.int64)
        for level, z in enumerate(self.zeros):
            bit = self._bit(level, i)
            ones = self._ones(level, i)
            i = np.where(bit == 1, z + ones, i - ones)
            value = value << 1 | bit
        return value

    def rank(self, value: int, stop: int) -> int:
        """Occurrences of a value before a place."""
        start, end = self._span(value, stop)
        return end - start

    def _span(self, value: int, stop: int) -> tuple[int, int]:
        if not 0 <= value < 1 << len(self.zeros):
            return 0, 0
        start, end = 0, stop
        for level, z in enumerate(self.zeros):
            a, b = (int(self._ones(level, np.array(x))) for x in (start, end))
            start, end = (z + a, z + b) if value >> (len(self.zeros) - 1 - level) & 1 else (start - a, end - b)
        return start, end

    def select(self, value: int, k: int) -> int:
        """Place of the k-th occurrence (from 0) of a value; -1 if there are fewer."""
        start, end = self._span(value, self.n)
        if not 0 <= k < end - start:
            return -1
        i = start + k
        for level in range(len(self.zeros) - 1, -1, -1):
            z = self.zeros[level]
            one = i >= z
            wanted = i - z if one else i
            low, high = 0, self.n - 1  # the place whose bit is the wanted-th of its kind
            while low < high:
                mid = (low + high) // 2
                ones = int(self._ones(level, np.array(mid + 1)))
                low, high = (low, mid) if (ones if one else mid + 1 - ones) > wanted else (mid + 1, high)
            i = low
        return i

    def places(self, value: int) -> np.ndarray:
        """All places of a value, ascending: its run at the lowest plane, led back plane by plane."""
        start, end = self._span(value, self.n)
        i = np.arange(start, end)
        for level in range(len(self.zeros) - 1 if end > start else -1, -1, -1):
            one = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            bit = value >> (len(self.zeros) - 1 - level) & 1
            i = np.flatnonzero(one)[i - self.zeros[level]] if bit else np.flatnonzero(~one)[i]
        return i

    def values(self) -> np.ndarray:
        """The whole sequence: the last plane's order is known from the counts, and each plane undoes a partition."""
        kind = np.uint16 if len(self.zeros) <= 16 else np.uint32
        out = np.zeros(self.n, dtype=kind)
        for level in range(len(self.zeros) - 1, -1, -1):
            one = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            before = np.empty_like(out)
            z = self.zeros[level]
            before[np.flatnonzero(~one)] = out[:z]
            before[np.flatnonzero(one)] = out[z:] | kind(1 << (len(self.zeros) - 1 - level))
            out = before
        return out


def pack(values: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray, bits: int) -> bytes:
    """A shard's file."""
    m = WaveletMatrix.build(values, bits)
    ids = np.array([x or 0 for x in doc_ids], dtype="<i8")
    nulls = np.packbits([x is None for x in doc_ids])
    out = [_MAGIC, struct.pack("<BQQ", bits, m.n, len(ids)), ids.tobytes(), nulls.tobytes(), lengths.astype("<u4").tobytes()]
    for z, plane, blocks in zip(m.zeros, m.planes, m.blocks, strict=True):
        out += [struct.pack("<QQ", z, len(plane)), blocks.astype("<u4").tobytes(), plane.tobytes()]
    return b"".join(out)


def unpack(payload: bytes) -> tuple[WaveletMatrix, list[int | None], np.ndarray]:
    """The matrix, document ids and lengths of a shard's file."""
    if payload[:4] != _MAGIC:
        raise ValueError("no wavelet matrix file")
    bits, n, docs = struct.unpack_from("<BQQ", payload, 4)
    at = 21

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(payload, kind, count, at)
        at += out.nbytes
        return out

    ids, nulls = take("<i8", docs), np.unpackbits(take("u1", -(-docs // 8)), count=docs)
    lengths = take("<u4", docs).astype(np.int64)
    zeros, planes, blocks = [], [], []
    for _ in range(bits):
        z, size = (int(x) for x in take("<u8", 2))
        zeros.append(z)
        blocks.append(take("<u4", size * 8 // _BLOCK + 1))
        planes.append(take("u1", size).copy())
    return WaveletMatrix(n, zeros, planes, blocks), [None if x else i for i, x in zip(ids.tolist(), nulls.tolist(), strict=True)], lengths


class TextEncoder:
    """The tokenizers library's ids of whole texts. A byte-level model merges within words only; so texts of Latin-1
    characters without the string of an added token are cut into words by the model's pattern, and the library's model
    encodes each distinct word once. All other texts, and all texts of other models, go to the library whole.

    Columns of texts are first cut where no word of the pattern goes on: before a space that follows something else than
    white space, and behind a letter that an ASCII character other than a letter follows. What the pattern looks ahead to,
    behind white space, is on the same side. Each distinct stretch of a slice is looked up once."""

    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.kind = kind
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        self.by_words = model.get("type") == "BPE" and split.get("type") == "ByteLevel" and bool(split.get("use_regex")) and not split.get("add_prefix_space") and not spec.get("normalizer") and not model.get("dropout")
        self.words = re.compile(_PATTERN)
        # printable bytes stand for themselves, the others follow from 256 on
        shown = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b}
        self.shown = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
        self.packed = [struct.pack(kind.replace("u2", "H").replace("u4", "I"), i) for i in range(self.library.get_vocab_size(with_added_tokens=True))]
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.stretches: dict[str, bytes] = {}

    def _is_plain(self, text: str) -> bool:
        if not self.by_words or any(t in text for t in self.added):
            return False
        try:
            return text.isascii() or bool(text.encode("latin-1"))
        except UnicodeEncodeError:
            return False

    def _by_words(self, text: str) -> bytes:
        if len(self.known) > _KNOWN_WORDS:  # words that come again are taken over from the table before
            self.known, self.before = {}, self.known
        words = self.words.findall(text)
        found = list(map(self.known.get, words))
        i = 0
        for _ in range(found.count(None)):
            i = found.index(None, i)
            found[i] = self.known.get(words[i]) or self._met(words[i])
        return b"".join(found)

    def _met(self, word: str) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            ids = self._new(word)
        self.known[word] = ids
        return ids

    def _new(self, word: str) -> bytes:
        if word.isascii() and word.isprintable():
            shown = word.replace(" ", self.shown[0x20])
        else:
            shown = word.encode().decode("latin-1").translate(self.shown)
        return b"".join([self.packed[t.id] for t in self.library.model.tokenize(shown)])

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (no nulls), one text after another, and how many each has."""
        texts = texts.cast(pa.large_string())
        plain = self._plain(texts)
        if plain.all():
            return self._by_stretches(texts)
        flat, n = self._by_stretches(texts.filter(pa.array(plain)))
        parts, lengths = iter(np.split(flat, np.cumsum(n)[:-1])), np.zeros(len(texts), np.int64)
        whole = iter(self.library.encode_batch_fast(texts.filter(pa.array(~plain)).to_pylist(), add_special_tokens=False))
        out = [next(parts) if p else np.array(next(whole).ids, dtype=self.kind) for p in plain.tolist()]
        lengths[:] = [len(x) for x in out]
        return np.concatenate(out), lengths

    @staticmethod
    def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The texts' bytes, and where in them each text starts and the last one ends."""
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int64, len(texts) + 1, 8 * texts.offset)
        raw = np.frombuffer(data, np.uint8, at[-1] - at[0], at[0]) if data and at[-1] > at[0] else np.zeros(0, np.uint8)
        return raw, at - at[0]

    def _plain(self, texts: pa.Array) -> np.ndarray:
        """As ``_is_plain``, of each text: beyond Latin-1, the first byte of a character is 0xC4 at least."""
        plain = np.full(len(texts), self.by_words)
        raw, at = self._bytes(texts)
        plain[np.searchsorted(at, np.flatnonzero(raw >= 0xC4), side="right") - 1] = False
        for t in self.added:
            plain &= ~pc.match_substring(texts, t).to_numpy(zero_copy_only=False)
        return plain

    def _by_stretches(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not len(texts):
            return np.zeros(0, self.kind), np.zeros(0, np.int64)
        raw, at = self._bytes(texts)
        after = _AFTER[raw[1:]]
        cuts = np.flatnonzero((_BEFORE[raw[:-1]] & after).astype(bool)) + 1
        last, lead = raw[cuts - 1], raw[cuts - 2]
        wide = last >= 0x80  # two bytes: blanks after 0xC2, letters after 0xC3 but for the signs of times and division
        letter = (lead == 0xC3) & (last != 0x97) & (last != 0xB7)
        blank = (lead == 0xC2) & ((last == 0x85) | (last == 0xA0))
        fine = ~wide | letter | ((raw[cuts] == 0x20) & ~blank)
        starts = np.zeros(len(raw) + 1, bool)
        starts[cuts[fine]] = True
        starts[at] = True
        starts = np.flatnonzero(starts[:-1])
        pieces = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.r_[starts, len(raw)].astype(np.int64)), pa.py_buffer(raw)).dictionary_encode()
        ids = self._known_stretches(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())
        kinds, place = np.frombuffer(b"".join(ids), self.kind), pieces.indices.to_numpy()
        n = np.fromiter(map(len, ids), np.int64, len(ids)) // np.dtype(self.kind).itemsize
        begins, n = (np.cumsum(n) - n)[place], n[place]
        ends = np.cumsum(n)
        index = np.int32 if len(raw) < 1 << 31 else np.int64  # a byte makes one id at most
        flat = kinds[np.repeat((begins - (ends - n)).astype(index), n) + np.arange(ends[-1] if len(ends) else 0, dtype=index)]
        return flat, np.diff(np.r_[0, ends][np.searchsorted(starts, at)])

    def _known_stretches(self, texts: list[str]) -> list[bytes]:
        found = list(map(self.stretches.get, texts))
        if len(self.stretches) > _KNOWN_STRETCHES:  # those that this slice has again stay
            self.stretches = {t: f for t, f in zip(texts, found, strict=True) if f is not None}
        i = 0
        for _ in range(found.count(None)):
            i = found.index(None, i)
            t = texts[i]
            found[i] = b"".join(map(self._new, self.words.findall(t)))
            if len(t) <= _KNOWN_LENGTH:
                self.stretches[t] = found[i]
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [self._is_plain(t) for t in texts]
        others = [t for t, p in zip(texts, plain, strict=True) if not p]
        whole = iter(self.library.encode_batch_fast(others, add_special_tokens=False) if others else ())
        return [self._by_words(t) if p else np.array(next(whole).ids, dtype=self.kind).tobytes() for t, p in zip(texts, plain, strict=True)]


@lru_cache(maxsize=2)
def _encoder(path: str, kind: str) -> TextEncoder:
    return TextEncoder(path, kind)


def vocabulary_bits(tokenizer: str) -> int:
    from tokenizers import Tokenizer

    return max(1, (Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True) - 1).bit_length())


def write_shards(docs: DataFrame, tokenizer: str, *, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None, shard_tokens: int = 1 << 21) -> DataFrame:
    """Writes the shards and returns their table: ``part`` and ``seq`` (ascending with the document ids), ``before``
    (ids of the part before this shard), ``n_tokens``, ``n_docs`` and ``payload``. ``tokenizer``: a vocabulary file of
    the tokenizers library with the byte-level pattern."""
    plain = ids_and_text(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    bits = vocabulary_bits(tokenizer)
    kind = "<u2" if bits <= 16 else "<u4"
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("seq", T.IntegerType()), T.StructField("before", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_docs", T.LongType()), T.StructField("payload", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        held: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        ids: list[int | None] = []
        size = 0

        def shard() -> pa.RecordBatch:
            nonlocal seq, before, size
            values = np.concatenate(held)
            payload = pack(values, ids, np.concatenate(lengths), bits)
            out = pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "before": before, "n_tokens": len(values), "n_docs": len(ids), "payload": payload}], schema=arrow)
            seq, before, size = seq + 1, before + len(values), 0
            for kept in (held, lengths, ids):
                kept.clear()
            return out

        arrow = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("n_docs", pa.int64()), ("payload", pa.binary())])
        encoder = _encoder(tokenizer, kind)
        for b in batches:
            for first, stop in slices(b.column(1), _SLICE_BYTES):
                rows = b.slice(first, stop - first)
                flat, n = encoder.encode_column(rows.column(1))
                flat, n, doc_ids = np.insert(flat, np.cumsum(n), end_id), n + 1, rows.column(0).to_pylist()
                ends = np.cumsum(n)
                at = base = 0
                while at < len(n):
                    upto = min(len(n), int(np.searchsorted(ends, base + shard_tokens - size)) + 1)  # with the document that fills the shard
                    end = int(ends[upto - 1])
                    held.append(flat[base:end])
                    lengths.append(n[at:upto])
                    ids += doc_ids[at:upto]
                    size += end - base
                    at, base = upto, end
                    if size >= shard_tokens:
                        yield shard()
        if held:
            yield shard()

    n = partitions or input_partitions(docs)
    dealt = plain.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return written(dealt.mapInArrow(run, schema), "wavelet", compression="zstd")


def _with_part_start(rows: DataFrame, shards: DataFrame) -> DataFrame:
    """Adds ``part_start``, the ids of all parts before a row's ``part``. There is a part for each task that wrote, so
    the parts' starts are sent to all tasks, unless there are very many tasks."""
    sizes = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    starts = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    few = (sizes.agg(F.count("*")).first()[0] or 0) <= _MOST_SENT
    return rows.join(F.broadcast(starts) if few else starts, "part")


def _placed(shards: DataFrame) -> DataFrame:
    """The shards with ``start``, the ids of all documents before a shard."""
    return _with_part_start(shards, shards).withColumn("start", F.col("part_start") + F.col("before")).drop("part_start")


def _asked(what: list[int]) -> list[int]:
    if len(what) > _MOST_ASKED:
        raise ValueError(f"at most {_MOST_ASKED} at once")
    return sorted(set(what))


def tokens_at(shards: DataFrame, places: list[int]) -> DataFrame:
    """``place`` and ``token`` for the given places in the sequence of all documents' ids (places outside give no row).
    Files that hold none of them are not read beyond their numbers."""
    wanted = np.array(_asked(places), dtype=np.int64)
    listed = F.array(*(F.lit(int(p)) for p in wanted)).cast("array<long>")
    hit = F.exists(listed, lambda p: (p >= F.col("start")) & (p < F.col("start") + F.col("n_tokens"))) if len(wanted) <= 1000 else F.lit(True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, n, payload in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                own = wanted[(wanted >= start) & (wanted < start + n)]
                if len(own):
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(unpack(payload)[0].access(own - start))], names=["place", "token"])

    return _placed(shards).filter(hit).select("start", "n_tokens", "payload").mapInArrow(run, "place long, token long")


def count_tokens(shards: DataFrame, tokens: list[int]) -> DataFrame:
    """``token`` and ``n``: how often each of the given ids occurs, by rank in every file (0 where it doesn't)."""
    wanted = _asked(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for payload in b.column(0).to_pylist():
                m = unpack(payload)[0]
                yield pa.RecordBatch.from_arrays([pa.array(wanted, pa.int64()), pa.array([m.rank(t, m.n) for t in wanted], pa.int64())], names=["token", "n"])

    counted = shards.select("payload").mapInArrow(run, "token long, n long")
    every = shards.sparkSession.createDataFrame([(t, 0) for t in wanted], "token long, n long")
    return counted.unionByName(every).groupBy("token").agg(F.sum("n").alias("n"))


def occurrences(shards: DataFrame, token: int, id_col: str = "doc_id") -> DataFrame:
    """A row per occurrence of an id, by select in every file: the document, the place among its ids and ``place`` among
    all documents' ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, payload in zip(*(b.column(k).to_pylist() for k in range(2)), strict=True):
                m, doc_ids, lengths = unpack(payload)
                ends, found = np.cumsum(lengths), m.places(token)
                doc = np.searchsorted(ends, found, side="right")
                for k in range(0, len(found), 1 << 16):
                    d, at = doc[k : k + (1 << 16)], found[k : k + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array([doc_ids[i] for i in d.tolist()], pa.int64()), pa.array(at - (ends - lengths)[d]), pa.array(at + start)], names=[id_col, "within", "place"])

    return _placed(shards).select("start", "payload").mapInArrow(run, T.StructType([T.StructField(id_col, T.LongType()), T.StructField("within", T.LongType()), T.StructField("place", T.LongType())]))


def read_documents(shards: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document, read back from the shards' files: its id, ``start`` (ids of all documents before it) and ``ids``
    (binary, little-endian unsigned 32-bit)."""
    schema = T.StructType([T.StructField(id_col, T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("within", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, before, payload in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                matrix, doc_ids, lengths = unpack(payload)
                raw = matrix.values().astype("<u4")
                ends = np.cumsum(lengths)
                within = ends - lengths
                for k in range(0, len(doc_ids), 1024):
                    few = slice(k, k + 1024)
                    ids = [raw[a:z].tobytes() for a, z in zip(within[few].tolist(), ends[few].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(doc_ids[few], pa.int64()), pa.array([part] * len(ids), pa.int32()), pa.array(within[few] + before, pa.int64()), pa.array(ids, pa.binary())], names=[id_col, "part", "within", "ids"])

    rows = shards.select("part", "before", "payload").mapInArrow(run, schema)
    return _with_part_start(rows, shards).select(id_col, (F.col("part_start") + F.col("within")).alias("start"), "ids")
