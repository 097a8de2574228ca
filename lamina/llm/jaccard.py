"""Jaccard join of word n-gram sets with prefix trees, and the groups that its links make.

Every text becomes the set of its distinct shingles (hashes of consecutive words). Equal sets are one class, so copies
cost no pairs. A class is known by 64 bits of a set's hash; where two sets share these (a second hash tells), the second
hash is what they are known by. Then, without losing a link:

1. Of a set's first quarter by hash, a linked partner shares all but the few shingles that the partner may lack. Sets
   with fewer shared ones (by any other class) drop out. A shingle that several sets of a batch hold is known as shared
   there and leaves the batch once, so a common shingle makes no large group.
2. For the others all shingles are counted. Two linked sets share one of their first few shingles in any order common
   to all, here the rarest first. A set whose first few nobody else has drops out; the others, by the shared shingles
   among their first, make families.
3. A family's sets meet in one task. A large family is cut into bands of sizes, of which only neighbouring ones can hold
   linked sets, and a band into blocks; each two blocks of a band meet, and those of neighbouring bands. There the
   sets, commonest shingle first, are stored in a trie. One walk down the trie carries the overlap of the path with
   every set at once, so that sets with a common start share that work; it turns back where the lengths that remain
   can't reach the similarity for any set. Overlaps found at the leaves are exact, and a task returns only as many
   links as join its sets.

Texts with fewer words than a shingle have one: the whole sequence. Texts without words (null, empty, white space)
have the empty set and are linked with nothing, not even with one another. Null ids are kept but never name a
component, and a class that has no other ids is linked with no other class. Repeated rows are equal sets. Other columns
are ignored. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.common import LOWER, ids_and_text, slices, trimmed, written
from lamina.llm.components import components

#: Bytes of texts whose first shingles are looked at together.
_STARTS_BYTES = 8 << 20
#: A shared shingle of more sets than this joins them to the least of them instead of in a chain by size.
_COMMON = 48
#: A block of a family holds about so many shingles at most, and so many sets (or four times the root of the family's
#: number, if that is more: blocks and sets in a block then grow alike).
_BLOCK_SHINGLES = 4 << 20
_BLOCK_SETS = 256
#: Size of the bit map that picks the texts to read again: 16 MB.
_MOST_BITS = 1 << 27
#: A pattern that texts with words match.
HAS_WORD = r"[^\x20\x09-\x0D]"
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    """Sets of shingle hashes of texts; the hashes of words met before are kept, up to a bound."""

    def __init__(self, words: int, cache_words: int = 200_000):
        self.words, self.cache, self.cache_words = words, {}, cache_words

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        """Sorted distinct hashes (int64) of each text."""
        if len(self.cache) > self.cache_words:
            self.cache.clear()
        cache, out = self.cache, []
        for text in texts:
            tokens = text.encode().translate(LOWER).split()
            for w in set(tokens).difference(cache):
                cache[w] = xxhash.xxh64_intdigest(w)
            h = np.fromiter(map(cache.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
            size = min(self.words, len(h))
            if not size:
                out.append(np.zeros(0, np.int64))
                continue
            s = np.full(len(h) - size + 1, size, dtype=np.uint64)
            for k in range(size):
                s = (s ^ h[k : len(h) - size + 1 + k]) * _MIX
                s ^= s >> np.uint64(29)
            out.append(np.unique(s.view(np.int64)))
        return out


def needed(size: int, percent: int) -> int:
    """The least overlap that a set of this size has with any set as alike as ``percent``."""
    return -(-percent * size // 100)


def _quarter(size: int) -> int:
    return -(-size // 4)


def _common_start(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


def trie_links(stored: list[np.ndarray], probes: list[np.ndarray], percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each stored set, the probes as alike to it as ``percent``: pairs of places. Sets are sorted int64 arrays.

    The trie isn't built as objects: the stored sets sorted by their lists of shingle ranks are its leaves from left
    to right, and the common starts of neighbours are its branches. A stack holds, per branch on the current path, the
    overlaps so far with all probes."""
    sizes = np.array([len(s) for s in probes], dtype=np.int64)
    if not len(sizes) or not stored:
        return
    every = np.concatenate(stored)
    kinds, inverse, counts = np.unique(every, return_inverse=True, return_counts=True)
    by_count = np.argsort(-counts, kind="stable")  # commonest first
    rank = np.empty(len(kinds), dtype=np.int64)
    rank[by_count] = np.arange(len(kinds))
    # which probes hold a kind
    flat = np.concatenate(probes)
    at = np.searchsorted(kinds, flat)
    at[at == len(kinds)] = 0
    hit = kinds[at] == flat
    holder, kind_rank = np.repeat(np.arange(len(probes)), sizes)[hit], rank[at[hit]]
    by_rank = np.argsort(kind_rank, kind="stable")
    holder = holder[by_rank]
    starts = np.searchsorted(kind_rank[by_rank], np.arange(len(kinds) + 1))
    ends = np.cumsum([len(s) for s in stored])
    ranked = [np.sort(rank[inverse[e - len(s) : e]]) for s, e in zip(stored, ends.tolist(), strict=True)]
    order = sorted(range(len(stored)), key=lambda i: ranked[i].astype(">i8").tobytes())
    lengths = [len(ranked[i]) for i in order]
    shared = [0] + [_common_start(ranked[a], ranked[b]) for a, b in zip(order, order[1:], strict=False)] + [0]
    below = _subtrees(lengths, shared)

    stack: list[tuple[int, np.ndarray]] = [(0, np.zeros(len(probes), dtype=np.int64))]
    skipped = -1
    for n, i in enumerate(order):
        if n <= skipped:
            continue
        path, size, ahead = ranked[i], lengths[n], shared[n + 1]
        while stack[-1][0] > shared[n]:
            stack.pop()
        depth, overlap = stack[-1][0], stack[-1][1].copy()
        longest, shortest, last = below[n]
        near = percent * shortest <= 100 * sizes
        while depth < ahead:  # the path that the next leaves share
            step = min(ahead, depth + 64)
            for k in path[depth:step].tolist():
                overlap[holder[starts[k] : starts[k + 1]]] += 1
            depth = step
            if not (near & (100 * longest >= percent * sizes + (100 + percent) * (depth - overlap))).any():
                skipped = last
                break
        if n <= skipped:
            continue
        if depth == ahead > stack[-1][0]:
            stack.append((depth, overlap.copy()))
        fits = 100 * np.minimum(sizes, size) >= percent * np.maximum(sizes, size)
        least = -(-percent * (sizes + size) // (100 + percent))
        while depth < size and (fits & (overlap + (size - depth) >= least)).any():
            step = min(size, depth + 64)
            for k in path[depth:step].tolist():
                overlap[holder[starts[k] : starts[k + 1]]] += 1
            depth = step
        if depth == size:
            found = np.flatnonzero(fits & (overlap >= least))
            if len(found):
                yield i, found


def _subtrees(lengths: list[int], shared: list[int]) -> list[tuple[int, int, int]]:
    """For each leaf: the longest and shortest set, and the last leaf, below its branch towards the next leaf."""
    out: list[tuple[int, int, int]] = [(0, 0, 0)] * len(lengths)
    right: list[tuple[int, int, int, int]] = []  # groups to the right: start shared with the next group, then as above
    for n in range(len(lengths) - 1, -1, -1):
        longest = shortest = lengths[n]
        last, ahead, link = n, shared[n + 1], shared[n + 1]
        high = low = end = None
        while right and link >= ahead:
            link, a, b, c = right.pop()
            high, low, end = (a, b, c) if end is None else (max(high, a), min(low, b), c)
        if end is not None:
            right.append((link, high, low, end))
            longest, shortest, last = max(longest, high), min(shortest, low), end
        out[n] = (longest, shortest, last)
        right.append((ahead, lengths[n], lengths[n], n))
    return out


def _joined(classes: list[int], sets: list[np.ndarray], blocks: list[int], percent: int) -> list[tuple[int, int]]:
    """Links that join the classes' sets within one block, or between two, into their components: one from each class
    to the first of its component here."""
    parent = list(range(len(classes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kinds = sorted(set(blocks))
    left = [i for i, b in enumerate(blocks) if b == kinds[0]]
    right = [i for i, b in enumerate(blocks) if b == kinds[-1]]
    for a, found in trie_links([sets[i] for i in left], [sets[i] for i in right], percent):
        for b in found.tolist():
            x, y = root(left[a]), root(right[b])
            if x != y:
                parent[max(x, y)] = min(x, y)
    return [(classes[i], classes[root(i)]) for i in range(len(classes)) if root(i) != i]


def link(docs: DataFrame, *, percent: int = 85, words: int = 4, id_col: str = "doc_id", text_col: str = "text", text_key: bool = False, _shared_ids: frozenset[int] = frozenset()) -> DataFrame:
    """Per row: the id, ``n_shingles`` (size of its set), ``class_id`` (of equal sets; null for the empty one) and
    ``component_id``: the least id that links of at least ``percent`` / 100 Jaccard similarity reach, itself included.
    ``percent``: above 75. With ``text_key``, the MD5 of the text (null: empty) too, which tells rows of one id apart."""
    if not 75 < percent <= 100:
        raise ValueError("percent must be above 75 and at most 100")
    plain = ids_and_text(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for b in batches:
            for k in range(0, len(b), 256):
                rows = b.slice(k, 256)
                sets = shingler.sets(rows.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([_class(s, _shared_ids) for s in sets], pa.int64()), pa.array([_second(s) for s in sets], pa.int64())], names=["doc_id", "n_shingles", "class_id", "second"])
        del shingler
        trimmed()

    def read_keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(2)
            start = 0
            for found in read(iter([b])):
                yield found.append_column("text_key", keys.slice(start, len(found)))
                start += len(found)

    if text_key:
        known = plain.withColumn("text_key", F.md5("text")).mapInArrow(read_keyed, "doc_id long, n_shingles long, class_id long, second long, text_key string")
    else:
        known = plain.mapInArrow(read, "doc_id long, n_shingles long, class_id long, second long")
    known = written(known, "shingled")
    firsts = known.filter("class_id is not null").groupBy("class_id").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("size"), F.min("second").alias("low"), F.max("second").alias("high"))
    firsts = written(firsts, "firsts", rows=known.count())
    shared_ids = frozenset(r["class_id"] for r in firsts.filter("low <> high").select("class_id").toLocalIterator())  # n^2 / 2^65 expected: 3 of 10^10
    if shared_ids:
        return link(docs, percent=percent, words=words, id_col=id_col, text_col=text_col, text_key=text_key, _shared_ids=_shared_ids | shared_ids)
    firsts = firsts.drop("low", "high")
    n = firsts.count()

    # 1. sets with enough shared shingles in their first quarter
    started = written(plain.select("text").mapInArrow(_starts(words, _shared_ids), "shingle long, class_id long, shared long"), "started")
    local = started.filter("shingle is null").select("class_id", "shared")
    sent = started.filter("shingle is not null").select("shingle", "class_id").repartition("shingle").sortWithinPartitions("shingle", "class_id")
    shared = sent.mapInArrow(_shared, "class_id long, shared long").unionByName(local).groupBy("class_id").agg(F.sum("shared").alias("shared"))
    # the partner whose quarter ends first shares all of it but what it may lack; for the other, rounding costs one
    quarter, may_lack = F.ceil(F.col("size") / 4), F.col("size") - F.ceil(F.col("size") * percent / 100)
    active = firsts.filter("doc_id is not null").join(shared, "class_id").filter(F.col("shared") >= F.greatest(F.lit(1), quarter - may_lack - 1)).select("doc_id", "class_id", "size")
    active = written(active, "active", rows=n)

    # 2. sets that share one of their first shingles, rarest first
    bits, wanted = _wanted(active)
    shingles = active.agg(F.sum("size")).first()[0] or 0
    sent_bits = docs.sparkSession.sparkContext.broadcast(wanted)
    marked = plain.filter("doc_id is not null").select("text", F.pmod(F.xxhash64("doc_id"), F.lit(bits)).alias("_bit"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for b in batches:
            bit = b.column(1).to_numpy()
            b = b.filter(pa.array((sent_bits.value[bit >> 6] >> (bit & 63).astype(np.uint64) & np.uint64(1)).astype(bool)))
            for k in range(0, len(b), 256):
                sets = shingler.sets(b.column(0).slice(k, 256).to_pylist())
                offsets = pa.array(np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))
                yield pa.RecordBatch.from_arrays([pa.array([_class(s, _shared_ids) for s in sets], pa.int64()), lists], names=["class_id", "shingles"])
        del shingler
        trimmed()

    fetched = marked.mapInArrow(fetch, "class_id long, shingles array<long>")
    sets = written(fetched.join(active.select("class_id"), "class_id").groupBy("class_id").agg(F.first("shingles").alias("shingles")), "sets", rows=shingles)
    held = sets.select("class_id", F.explode("shingles").alias("shingle"))
    counts = held.groupBy("shingle").agg(F.count("*").alias("n")).filter("n > 1")
    common = written(held.join(counts, "shingle"), "common", rows=shingles)
    sizes = sets.select("class_id", F.size("shingles").alias("size"))
    first_few = F.col("size") - F.ceil(F.col("size") * percent / 100) + 1
    left = common.groupBy("class_id").agg(F.count("*").alias("others")).join(sizes, "class_id").withColumn("take", first_few - (F.col("size") - F.col("others"))).filter("take > 0")
    by_count = Window.partitionBy("class_id").orderBy("n", "shingle")
    begins = written(common.join(left.select("class_id", "size", "take"), "class_id").withColumn("_at", F.row_number().over(by_count)).filter("_at <= take").select("shingle", "class_id", "size", "n"), "begins", rows=common.count())
    rare = begins.filter(F.col("n") <= _COMMON).select("shingle", "class_id", "size").repartition("shingle").sortWithinPartitions("shingle", "size", "class_id")
    edges = rare.mapInArrow(_neighbours(percent), "a long, b long")
    # sets as alike as asked for are in one band or in two neighbouring ones: a band is a trifle wider than their ratio
    band = F.floor(F.log(F.col("size").cast("double")) / float(np.log(100 / percent) * (1 + 1e-9)) if percent < 100 else F.col("size").cast("double"))
    far = begins.filter(F.col("n") > _COMMON).select("shingle", "class_id", F.explode(F.array(band, band + 1)).alias("band"))
    heads = far.groupBy("shingle", "band").agg(F.min("class_id").alias("head"))
    more = far.join(heads, ["shingle", "band"]).filter("class_id <> head").select(F.col("head").alias("a"), F.col("class_id").alias("b"))
    families = components(written(edges.unionByName(more).distinct(), "edges", rows=2 * begins.count())).select(F.col("node").alias("class_id"), F.col("root").alias("family"))

    # 3. families meet: a small one in a task, a large one by blocks of its bands
    members = families.join(sizes, "class_id").withColumn("band", band)
    load = F.greatest(F.ceil(F.sum("size") / _BLOCK_SHINGLES), F.ceil(F.count("*") / F.greatest(F.lit(float(_BLOCK_SETS)), 4 * F.sqrt(F.count("*"))))).cast("long")
    whole = members.groupBy("family").agg((load > 1).alias("large"))
    by_band = Window.partitionBy("family").orderBy("band")
    next_to = lambda f, d: F.when(f("band").over(by_band) == F.col("band") + d, f("blocks").over(by_band)).otherwise(F.lit(0))
    loads = members.groupBy("family", "band").agg(load.alias("blocks")).withColumn("upper", next_to(F.lead, 1)).withColumn("lower", next_to(F.lag, -1))
    loads = written(loads.join(whole, "family"), "loads", rows=n)
    dealt = members.join(loads, ["family", "band"]).withColumn("block", F.pmod(F.xxhash64("class_id"), "blocks"))
    zero, cut, mine = F.lit(0).cast("long"), F.col("block"), F.col("band")
    upto = lambda n: F.when(n > 0, F.sequence(zero, n - 1)).otherwise(F.array().cast("array<long>"))
    meets = lambda across, at, one, two, label: F.struct(F.lit(across).alias("across"), at.alias("at"), one.alias("one"), two.alias("two"), label.alias("label"))
    own = F.when(F.col("blocks") == 1, F.array(zero)).otherwise(F.filter(upto(F.col("blocks")), lambda x: x != cut))
    every = F.concat(
        F.transform(own, lambda x: meets(0, mine, F.least(cut, x), F.greatest(cut, x), cut)),  # a block meets every other one of its band, and itself where there is only one
        F.transform(upto(F.col("upper")), lambda x: meets(1, mine, cut, x, zero)),
        F.transform(upto(F.col("lower")), lambda x: meets(1, mine - 1, x, cut, zero + 2)),
    )
    alone = F.array(meets(0, F.lit(-1).cast("long"), zero, zero, zero))
    meeting = dealt.withColumn("_meets", F.explode(F.when(F.col("large"), every).otherwise(alone))).select("class_id", "family", "_meets.*").withColumnRenamed("label", "block")

    def meet(table: pa.Table) -> pa.Table:
        rows = {}
        for c, b, s in zip(table.column("class_id").to_pylist(), table.column("block").to_pylist(), table.column("shingles"), strict=True):
            rows[c] = (b, s.values.to_numpy())
        classes = sorted(rows)
        found = _joined_all(classes, [rows[c][1] for c in classes], [rows[c][0] for c in classes], percent)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    links = written(sets.join(meeting, "class_id").groupBy("family", "across", "at", "one", "two").applyInArrow(meet, "a long, b long"), "class_links")
    found = written(components(links).select(F.col("node").alias("class_id"), F.col("root").alias("root")), "joined", rows=n)
    # written, so that the join with a component of very many classes can be split
    least = written(found.join(firsts, "class_id").groupBy("root").agg(F.min("doc_id").alias("component_id")), "least", rows=n)
    linked = found.join(least, "root").select("class_id", "component_id")
    of_class = firsts.join(linked, "class_id", "left").select("class_id", F.coalesce("component_id", "doc_id").alias("component_id"))
    of_class = written(of_class, "of_class", rows=n)  # as above, for a class of very many copies
    columns = ["doc_id", "n_shingles", "class_id", F.coalesce("component_id", "doc_id").alias("component_id")]
    return known.join(of_class, "class_id", "left").select(*columns, *(["text_key"] if text_key else []))


def _wanted(active: DataFrame) -> tuple[int, np.ndarray]:
    """A number of bits, and a bit map of hashes of the ids: 16 bits an id, ``_MOST_BITS`` at most. Ids that only meet a
    bit of others are told apart later, so a full map costs time and no correctness."""
    bits = 1 << 16
    while bits < min(_MOST_BITS, 16 * active.count()):
        bits *= 2
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    words = active.select(F.floor(bit / 64).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(doc_id), {bits}) % 64 as int))").alias("mask"))
    table = words.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()  # at most _MOST_BITS / 64 rows
    out = np.zeros(bits // 64, dtype=np.uint64)
    out[table.column("word").to_numpy()] = table.column("mask").to_numpy().view(np.uint64)
    return bits, out


def _joined_all(classes: list[int], sets: list[np.ndarray], blocks: list[int], percent: int) -> list[tuple[int, int]]:
    """As ``_joined``; where a block meets the one after it, both also meet themselves."""
    out, kinds = _joined(classes, sets, blocks, percent), sorted(set(blocks))
    for b in kinds if kinds[-1] == kinds[0] + 1 else ():
        own = [i for i, x in enumerate(blocks) if x == b]
        out += _joined([classes[i] for i in own], [sets[i] for i in own], [b] * len(own), percent)
    return out


def _starts(words: int, shared_ids: frozenset[int] = frozenset()):
    """From texts: the first quarter of each set as rows of shingle and class, each shingle once a slice of a batch. For
    shingles that several classes of the slice hold the class is null, and rows without shingle count them for these
    classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for b in batches:
            for start, stop in slices(b.column(0), _STARTS_BYTES):
                starts: dict[int, np.ndarray] = {}
                for k in range(start, stop, 256):
                    for s in shingler.sets(b.column(0).slice(k, min(256, stop - k)).to_pylist()):
                        if len(s):
                            starts[_class(s, shared_ids)] = s[: _quarter(len(s))].copy()
                if starts:
                    yield _once_each(starts)
        del shingler
        trimmed()

    return run


def _once_each(starts: dict[int, np.ndarray]) -> pa.RecordBatch:
    classes = np.repeat(np.fromiter(starts, np.int64, len(starts)), [len(x) for x in starts.values()])
    shingles = np.concatenate(list(starts.values()))
    kinds, at, counts = np.unique(shingles, return_inverse=True, return_counts=True)
    own = counts[at] == 1
    held, n = np.unique(classes[~own], return_counts=True)
    known = kinds[counts > 1]
    nulls = np.zeros(len(held), np.int64)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([shingles[own], known, nulls]), mask=np.repeat([False, False, True], [own.sum(), len(known), len(held)])),
            pa.array(np.concatenate([classes[own], np.zeros(len(known), np.int64), held]), mask=np.repeat([False, True, False], [own.sum(), len(known), len(held)])),
            pa.array(np.concatenate([np.zeros(own.sum() + len(known), np.int64), n])),
        ],
        names=["shingle", "class_id", "shared"],
    )


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by shingle and class (null first): for the classes of a batch, how many of their shingles have
    a null class or another class."""
    kept: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]

    def settle(shingle: np.ndarray, classes: np.ndarray, null: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.r_[True, shingle[1:] != shingle[:-1]]) if len(shingle) else np.zeros(0, np.int64)
        n = np.diff(np.r_[starts, len(shingle)])
        last = starts + n - 1
        shared = null[starts] | (classes[starts] != classes[last])
        new = np.r_[True, (shingle[1:] != shingle[:-1]) | (classes[1:] != classes[:-1]) | null[:-1]] if len(shingle) else np.zeros(0, bool)
        found, count = np.unique(classes[np.repeat(shared, n) & ~null & new], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(found), pa.array(count.astype(np.int64))], names=["class_id", "shared"])

    for b in batches:
        if not len(b):
            continue
        classes = b.column(1)
        own = [b.column(0).to_numpy(zero_copy_only=False), classes.fill_null(0).to_numpy(zero_copy_only=False), classes.is_null().to_numpy(zero_copy_only=False)]
        rows = [np.concatenate([x, y]) for x, y in zip(kept, own, strict=True)]
        open_at = int(np.searchsorted(rows[0], rows[0][-1]))  # the last shingle may go on in the next batch
        kept = [x[open_at:] for x in rows]
        if kept[2][0] or kept[1][0] != kept[1][-1]:  # it is shared, whatever follows: one row says so
            yield settle(*rows)
            kept = [kept[0][:1], kept[1][-1:], np.array([True])]
            continue
        kept = [x[:1] for x in kept]  # one class so far
        if open_at:
            yield settle(*(x[:open_at] for x in rows))
    if len(kept[0]):
        yield settle(*kept)


def _class(s: np.ndarray, shared_ids: frozenset[int] = frozenset()) -> int | None:
    """What a set is known by; null for the empty one. ``shared_ids``: numbers that several sets have."""
    if not len(s):
        return None
    number = xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63)
    return _second(s) if number in shared_ids else number


def _second(s: np.ndarray) -> int | None:
    return xxhash.xxh64_intdigest(s.tobytes(), 1) - (1 << 63) if len(s) else None


def _neighbours(percent: int):
    """From rows sorted by shingle and size: pairs of neighbouring classes of a shingle, unless their sizes already
    differ too much (then so do those of all classes on either side)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        for b in batches:
            if not len(b):
                continue
            own = [b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)]
            shingle, classes, size = (np.concatenate([x, y]) for x, y in zip(kept, own, strict=True))
            kept = tuple(x[-1:] for x in (shingle, classes, size))
            near = (shingle[1:] == shingle[:-1]) & (classes[1:] != classes[:-1]) & (100 * size[:-1] >= percent * size[1:])
            pairs = np.unique(np.stack([classes[:-1][near], classes[1:][near]]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    return run
