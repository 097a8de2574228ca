"""Language-model scores from a weighted backoff automaton.

Symbols are words (A-Z in lower case) and the end of a text. The probability of a symbol after the ``order`` - 1 before it
is its training count there plus ``mass`` times its probability after a history one shorter, over the history's count
plus ``mass`` (a Dirichlet prior); without history it is an absolutely discounted share of all tokens, and what the
discounts leave goes to words that training hasn't seen, as one event. So the probabilities after any history sum to one.
As an automaton: every history that training has seen is a state; the symbols seen after it are arcs with their
log-probabilities; a failure arc with the weight of what is left leads to the state of the shorter history, down to the
one without. A text is scored in one walk from left to right that carries the state and adds up log-probabilities.

All n-grams of all training documents count, none is dropped. Documents are read once, into chunks of bounded size as word
numbers. Each chunk asks for the counts of its own distinct n-grams: these, as 64-bit hashes, are dealt by ranges of the
hash, each range adds up what all chunks have counted, and every chunk gets the totals of what it asked. So counts grow with
the corpus, while a task holds a range (about ``_RANGE_KEYS`` n-grams), or a chunk and the part of the automaton that its
texts can reach. Two n-grams of one hash share a count: among 10^10 kinds, some three pairs do.

A null or empty text is the end alone. Null ids are kept and count as training. Without training documents every symbol
is unseen and certain (score 0). Repeated rows are documents each. Very long texts are chunks of their own. Other columns
are ignored. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.llm.common import LOWER, released, small_batches, written

_CHUNK_BYTES = 5 << 20
#: Chunks, or ranges, of a task.
_TOGETHER = 4
#: n-grams (with repeats in several chunks) of a range of hashes, on average.
_RANGE_KEYS = 1 << 20
#: Tokens of a text that are walked as one; a part starts in the state that the tokens before it lead to.
_PART = 512
#: Bytes of a text that are cut into words at a time.
_PIECE = 4 << 20
_MIX, _MIX_TWO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Hashes of the end and the start of a text; no word is empty.
_END, _START = xxhash.xxh64_intdigest(b"", 1), xxhash.xxh64_intdigest(b"", 2)


def words(text: str) -> Iterator[list[bytes]]:
    """Words with A-Z in lower case, in lists of bounded size; white space is ASCII."""
    raw = text.encode().translate(LOWER)
    start = 0
    while len(raw) - start > 2 * _PIECE:
        at = start + _PIECE
        while at < len(raw) and raw[at] not in b" \t\n\v\f\r":
            at += 1
        yield raw[start:at].split()
        start = at
    yield raw[start:].split()


@dataclass
class Chunk:
    """Texts as word numbers, one after another without their ends (``flat``), with the words' hashes."""

    lengths: np.ndarray
    held: np.ndarray
    flat: np.ndarray
    hashes: np.ndarray

    def __post_init__(self) -> None:
        m, n = len(self.hashes), len(self.lengths)
        self.end, self.start = m, m + 1
        ends = np.cumsum(self.lengths + 1) - 1
        self.symbols = np.full(len(self.flat) + n, self.end, dtype=np.int64)
        inside = np.ones(len(self.symbols), dtype=bool)
        inside[ends] = False
        self.symbols[inside] = self.flat
        self.first = np.r_[0, ends[:-1] + 1] if n else np.zeros(0, np.int64)
        self.owner = np.repeat(np.arange(n), self.lengths + 1)
        self.training = ~self.held[self.owner]
        self.hash_of = np.r_[self.hashes, np.array([_END, _START], dtype=np.uint64)]

    def before(self, values: np.ndarray, start: int) -> np.ndarray:
        """What each token's predecessor has; ``start`` at the start of a text."""
        out = np.r_[np.int64(start), values[:-1]]
        out[self.first] = start
        return out

    def grams(self, order: int) -> list[Grams]:
        """The distinct n-grams of each order up to ``order``."""
        width = len(self.hash_of)
        out = [Grams(np.arange(width - 1), self.symbols, self.hash_of[:-1], self._counts(self.symbols, width - 1))]
        history, of_history = self.before(self.symbols, self.start), self.hash_of * _MIX_TWO
        for k in range(1, order):
            kinds, at = np.unique(history * width + self.symbols, return_inverse=True)
            mixed = (of_history[kinds // width] ^ self.hash_of[kinds % width]) * _MIX
            mixed ^= mixed >> np.uint64(29)
            out.append(Grams(kinds, at, mixed, self._counts(at, len(kinds))))
            if k + 1 < order:  # the history of the next order: this one's number; before a text starts there is one more
                history = self.before(at, len(kinds))
                of_history = np.r_[mixed, np.uint64(_START)] * _MIX_TWO
        return out

    def _counts(self, at: np.ndarray, kinds: int) -> np.ndarray:
        return np.bincount(at[self.training], minlength=kinds)


@dataclass
class Grams:
    """n-grams: ``kinds`` (history * width + symbol), the number of each token's (``at``), hashes, own training counts."""

    kinds: np.ndarray
    at: np.ndarray
    hashes: np.ndarray
    counts: np.ndarray


def _packed(x: np.ndarray, kind: str) -> bytes:
    return x.astype(kind).tobytes()


def _chunks(doc_type: T.DataType):
    """From ids, texts and whether they are held out: chunks."""
    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("ids", T.ArrayType(doc_type)), T.StructField("held", T.BinaryType()), T.StructField("lengths", T.BinaryType()), T.StructField("flat", T.BinaryType()), T.StructField("hashes", T.BinaryType()), T.StructField("grams", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size = TaskContext.get().partitionId() << 32, 0
        known: dict[bytes, int] = {}
        ids, held, lengths, flat = [], [], [], []

        def settle() -> pa.RecordBatch:
            nonlocal number, size
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, known), np.uint64, len(known))
            tokens = np.concatenate([np.zeros(0, np.int32), *flat])
            row = [number, pa.concat_arrays(ids), _packed(np.array(held), "?"), _packed(np.array(lengths), "<i8"), tokens.tobytes(), hashes.tobytes(), len(tokens) + len(lengths)]
            out = pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(row[1])], pa.int32()), row[1]), *(pa.array([x], pa.binary()) for x in row[2:6]), pa.array([row[6]], pa.int64())], names=schema.names)
            number, size = number + 1, 0
            for x in (known, ids, held, lengths, flat):
                x.clear()
            return out

        for b in batches:
            for k in range(0, len(b), 64):
                rows = b.slice(k, 64)
                start = 0
                for i, (text, out) in enumerate(zip(rows.column(1).to_pylist(), rows.column(2).to_pylist(), strict=True)):
                    n = 0
                    for tokens in words(text):
                        for w in set(tokens).difference(known):
                            known[w] = len(known)
                        flat.append(np.fromiter(map(known.__getitem__, tokens), np.int32, len(tokens)))
                        n += len(tokens)
                    held.append(out)
                    lengths.append(n)
                    size += len(text) + 1
                    if size >= _CHUNK_BYTES:
                        ids.append(rows.column(0).slice(start, i + 1 - start))
                        start = i + 1
                        yield settle()
                if start < len(rows):
                    ids.append(rows.column(0).slice(start))
        if lengths:
            yield settle()

    return run, schema


def _unpacked(b: pa.RecordBatch | pa.Table, i: int) -> Chunk:
    held, lengths, flat, hashes = (b.column(c)[i].as_py() for c in ("held", "lengths", "flat", "hashes"))
    return Chunk(np.frombuffer(lengths, "<i8"), np.frombuffer(held, "?"), np.frombuffer(flat, "<i4"), np.frombuffer(hashes, "<u8"))


def _asked(k: int, bits: int):
    """From chunks: their n-grams of order ``k``, ascending by hash, cut by ranges of the hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                grams = _unpacked(b, i).grams(k)[-1]
                by_hash = np.argsort(grams.hashes)
                hashes, counts = grams.hashes[by_hash], grams.counts[by_hash].astype("<u4")
                ranges = (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
                cuts = np.r_[np.flatnonzero(np.r_[True, ranges[1:] != ranges[:-1]]), len(hashes)] if len(hashes) else np.zeros(1, np.int64)
                raw, own = hashes.tobytes(), counts.tobytes()
                spans = list(zip(cuts.tolist(), cuts[1:].tolist(), strict=False))
                yield pa.RecordBatch.from_arrays([pa.array(ranges[cuts[:-1]]), pa.array([b.column("chunk")[i].as_py()] * len(spans), pa.int64()), pa.array([raw[8 * a : 8 * z] for a, z in spans], pa.binary()), pa.array([own[4 * a : 4 * z] for a, z in spans], pa.binary())], names=["part", "chunk", "hashes", "counts"])

    return run


def _totals(chunks: DataFrame, k: int, bits: int, parts: int) -> DataFrame:
    """The totals of order ``k`` that each chunk asks for, written; nothing refers to the shuffle's files afterwards."""
    ranges = chunks.mapInArrow(_asked(k, bits), "part long, chunk long, hashes binary, counts binary")
    told = ranges.repartition(parts, "part").groupBy("part").applyInArrow(_told, "part long, chunk long, totals binary, kinds long, tokens long, once long, twice long")
    return written(told, "told", compression="zstd")


def _told(table: pa.Table) -> pa.Table:
    """One range: the totals for each chunk, and of the range itself (in its first row): kinds and tokens of training, and
    how many kinds came once and twice."""
    hashes = [np.frombuffer(x, "<u8") for x in table.column("hashes").to_pylist()]
    counts = np.concatenate([np.frombuffer(x, "<u4") for x in table.column("counts").to_pylist()]).astype(np.int64)
    ends = np.cumsum([len(h) for h in hashes]).tolist()
    kinds, at = np.unique(np.concatenate(hashes), return_inverse=True)
    totals = np.bincount(at, weights=counts, minlength=len(kinds)).astype(np.int64)
    back = totals[at].astype("<i8").tobytes()
    n = len(hashes)
    stats = [int((totals > 0).sum()), int(totals.sum()), int((totals == 1).sum()), int((totals == 2).sum())]
    return pa.table(
        {"part": table.column("part"), "chunk": table.column("chunk"), "totals": pa.array([back[8 * a : 8 * z] for a, z in zip([0, *ends], ends, strict=False)], pa.binary())}
        | {name: pa.array([x] + [0] * (n - 1), pa.int64()) for name, x in zip(("kinds", "tokens", "once", "twice"), stats, strict=True)}
    )


@dataclass
class Automaton:
    """Arcs: ``keys`` (state * ``n`` + symbol, ascending), ``weight`` (log10) and ``target``. State 0 has an arc for every
    symbol, in their order, and comes first; every other state has a failure arc to one that comes before it."""

    n: int
    keys: np.ndarray
    weight: np.ndarray
    target: np.ndarray
    fail: np.ndarray
    fail_weight: np.ndarray

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights and targets of steps from states on symbols."""
        weight, target = np.zeros(len(state)), np.zeros(len(state), dtype=np.int64)
        left, at_state = np.arange(len(state)), state
        while len(left):
            key = at_state * self.n + symbol[left]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            weight[left[hit]] += self.weight[at[hit]]
            target[left[hit]] = self.target[at[hit]]
            left, at_state = left[~hit], at_state[~hit]
            weight[left] += self.fail_weight[at_state]
            at_state = self.fail[at_state]
        return weight, target

    def walk(self, symbols: np.ndarray, first: np.ndarray, state: np.ndarray) -> np.ndarray:
        """Log10 probability of each part of a sequence; parts begin at ``first``, each in a state of its own. All are
        walked at once, from left to right."""
        size = np.diff(np.r_[first, len(symbols)])
        order = np.argsort(-size, kind="stable")
        size, begin, state, total = size[order], first[order], state[order], np.zeros(len(first))
        for t in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -t))  # parts longer than t
            weight, state = self.step(state[:n], symbols[begin[:n] + t])
            total[:n] += weight
        out = np.empty(len(first))
        out[order] = total
        return out


def automaton(chunk: Chunk, grams: list[Grams], totals: list[np.ndarray], root: np.ndarray, documents: int, mass: float) -> tuple[Automaton, int, np.ndarray]:
    """The automaton as far as the chunk's texts can go, the state that texts start in, and the state after each token. ``totals``: training
    counts of the n-grams; ``root``: probabilities of the symbols without history."""
    n = len(chunk.hash_of) - 1
    keys, weight, target = [np.arange(n)], [np.log10(root)], [1 + np.arange(n)]
    fail, fail_weight = [np.zeros(1, np.int64)], [np.zeros(1)]
    # how often something follows the histories of the next order: symbols (nothing follows the end), and a text's start
    seen = np.r_[np.where(np.arange(n) == chunk.end, 0, totals[0]), documents]
    after, states, p = 1 + np.arange(n + 1), 1, root
    for k, (g, c) in enumerate(zip(grams[1:], totals[1:], strict=True), 1):
        width = n + 1
        history, symbol = g.kinds // width, g.kinds % width
        lead, begin = history + states, states + len(seen) - 1  # states of the histories, in their order; the start is last
        fail.append(np.zeros(len(seen), np.int64) if k == 1 else shorter)
        fail_weight.append(np.log10(mass / (seen + mass)))
        below = p[symbol] if k == 1 else p[suffix]
        p = (c + mass * below) / (seen[history] + mass)
        some = c > 0
        states += len(seen)
        own = states + np.arange(len(g.kinds))  # states of these n-grams as histories, if there is a next order
        last = k + 1 == len(grams)
        here = 1 + symbol if k == 1 else after[suffix]
        after = here if last else np.where(some, own, here)
        keys.append(lead[some] * n + symbol[some])
        weight.append(np.log10(p[some]))
        target.append(after[some])
        if not last:
            # the number, among these, of the last k + 1 symbols of each n-gram of the next order; its history's fallback
            following = grams[k + 1]
            one = np.zeros(len(following.kinds), np.int64)
            one[following.at] = g.at
            suffix, shorter = one, np.r_[here, begin]
            seen = np.r_[np.where(symbol == chunk.end, 0, c), documents]
    made = Automaton(n, np.concatenate(keys), np.concatenate(weight), np.concatenate(target), np.concatenate(fail), np.concatenate(fail_weight))
    return made, begin, after[grams[-1].at]


def score(docs: DataFrame, held_out: Column, *, id_col: str = "doc_id", text_col: str = "text", order: int = 3, mass: float = 100.0) -> DataFrame:
    """Per document: ``doc_id``, ``held_out``, ``n_tokens`` (words and the end), ``n_known`` (seen in training),
    ``train_tokens``, ``base_score`` (add-one unigrams) and ``score``, both log10 probabilities of the whole text.
    Training takes the documents for which ``held_out``, a condition on the columns, is not true."""
    if order < 2 or mass <= 0:
        raise ValueError("order must be 2 at least, mass positive")
    spark = docs.sparkSession
    small_batches(spark)
    plain = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    doc_type = plain.schema["doc_id"].dataType
    read, schema = _chunks(doc_type)
    chunks = written(plain.mapInArrow(read, schema), "chunks", compression="zstd")
    asked, n_chunks = chunks.agg(F.sum("grams"), F.count("*")).first()
    asked = asked or 0
    # few chunks or ranges a task, however many there are
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_chunks // _TOGETHER))
    bits = max(0, int(np.ceil(np.log2(max(1, asked / _RANGE_KEYS)))))
    answers = []
    for k in range(1, order + 1):
        answers.append(_totals(chunks, k, bits, parts))
        released(spark)
    kinds, tokens, once, twice = (x or 0 for x in answers[0].agg(*(F.sum(c) for c in ("kinds", "tokens", "once", "twice"))).first())
    discount = min(max((once + 0.5) / (once + 2 * twice + 1), 0.05), 0.95)

    def walk(texts: pa.Table, told: pa.Table) -> pa.Table:
        chunk = _unpacked(texts, 0)
        grams = chunk.grams(order)
        told = told.sort_by([("order", "ascending"), ("part", "ascending")])
        of_order = told.column("order").to_numpy()
        totals = []
        for k, g in enumerate(grams, 1):
            own = told.column("totals").filter(pa.array(of_order == k)).to_pylist()
            c = np.empty(len(g.kinds), dtype=np.int64)
            c[np.argsort(g.hashes)] = np.frombuffer(b"".join(own), "<i8")
            totals.append(c)
        c = totals[0].astype(np.float64)
        if tokens:
            root = np.where(c > 0, (c - discount) / tokens, max(discount * kinds / tokens, 1e-300))
        else:
            root = np.ones(len(c))
        documents = int(totals[0][chunk.end])
        made, begin, after = automaton(chunk, grams, totals, root, documents, mass)
        # parts of texts, each in the state that the token before it has led to
        at = np.arange(len(chunk.symbols)) - np.repeat(chunk.first, chunk.lengths + 1)
        first = np.flatnonzero(at % _PART == 0)
        state = np.where(at[first] == 0, begin, after[first - 1])
        found = np.bincount(chunk.owner[first], weights=made.walk(chunk.symbols, first, state), minlength=len(chunk.lengths))
        base = np.log10((c + 1) / (tokens + kinds + 1))
        sums = lambda x: np.bincount(chunk.owner, weights=x[chunk.symbols], minlength=len(chunk.lengths))
        return pa.table({"doc_id": texts.column("ids")[0].values, "held_out": pa.array(chunk.held), "n_tokens": pa.array(chunk.lengths + 1), "n_known": pa.array(sums(c > 0).astype(np.int64)), "base_score": pa.array(sums(base)), "score": pa.array(found)})

    every = answers[0].select(F.lit(1).alias("order"), "part", "chunk", "totals")
    for k, a in enumerate(answers[1:], 2):
        every = every.unionByName(a.select(F.lit(k).alias("order"), "part", "chunk", "totals"))
    out = T.StructType([T.StructField("doc_id", doc_type), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])
    scored = chunks.repartition(parts, "chunk").groupBy("chunk").cogroup(every.repartition(parts, "chunk").groupBy("chunk")).applyInArrow(walk, out)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
