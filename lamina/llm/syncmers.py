"""Document fingerprints of closed syncmers, with DataFrame operations only.

Letters are the bytes of the text in UTF-8. Of every ``k`` bytes in a row, those are kept whose least inner substring of
``s`` bytes (by hash) is the first or the last one: a choice that depends on these bytes alone, so an edit elsewhere leaves
the anchor and its match in place, whatever lies between words. A fingerprint is the anchors' hashes in the order of the
text; every 2 * ``k`` bytes hold at least one. The least of all inner substrings of a window comes from minima over 1, 2, 4,
... of them. As an anchor depends on nothing else, those of an edited text are the text's own up to the edit, and only the
rest is looked at again. Very long texts are looked at in blocks of ``_BLOCK`` bytes.

A text of fewer than 2 * ``k`` bytes has its inner substrings as a fingerprint (itself, if it is shorter still), and is
compared with any other by the inner substrings of both. A null or empty text has none. Two fingerprints without anchors
are alike (1.0); one with and one without aren't (0.0). Null ids sort first; equal ids go by text. Repeated rows are
documents each. Other columns are ignored. No rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_LEAST_LONG = -(1 << 63)
_BLOCK = 1 << 15
#: Documents of a range that one window orders.
_RANGE_ROWS = 1024
#: Ranges whose bounds are in the plan, and parts that each may be cut into again (sent as a table of at most 8 MB).
_COARSE_RANGES = 4096
_FINER = 256
_FINE = 64


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once a row, though used inside lambdas."""
    return F.transform(F.array(value), use)[0]


def _inner(b: Column, s: int) -> Column:
    """Hashes of all substrings of ``s`` bytes (of ``s`` at least)."""
    return F.transform(F.sequence(F.lit(1), F.octet_length(b) - (s - 1)), lambda i: F.hash(F.substring(b, i, F.lit(s))))


def _least_of(h: Column, w: int) -> Column:
    """The least of every ``w`` hashes in a row, by where they start."""

    def with_later(a: Column, d: int) -> Column:
        return F.zip_with(a, F.slice(a, 1 + d, F.greatest(F.size(a) - d, F.lit(0))), lambda x, y: F.least(x, y))

    def go(a: Column, reach: int) -> Column:
        if reach == w:
            return a
        d = min(reach, w - reach)
        return _once(with_later(a, d), lambda m: go(m, reach + d))

    return go(h, 1)


def _of_block(b: Column, k: int, s: int) -> Column:
    w = k - s + 1

    def kept(h: Column) -> Column:
        def among(least: Column) -> Column:
            return F.filter(F.sequence(F.lit(0), F.octet_length(b) - k), lambda i: F.get(least, i) >= F.least(F.get(h, i), F.get(h, i + (w - 1))))

        return _once(_least_of(h, w), among)

    return F.transform(_once(_inner(b, s), kept), lambda i: F.struct(i.alias("place"), F.hash(F.substring(b, i + 1, F.lit(k))).alias("anchor")))


_ANCHORS = "array<struct<place:int,anchor:int>>"


def anchors(data: Column, k: int = 32, s: int = 9) -> Column:
    """The anchors of bytes in their order: array<struct<place int, anchor int>>; ``place`` counts bytes from 0."""
    if not 2 <= s < k:
        raise ValueError("s must be 2 at least and below k")

    def found(b: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.octet_length(b) - k) / _BLOCK).cast("int"))
        moved = lambda j: F.transform(_once(F.substring(b, j * _BLOCK + 1, F.lit(_BLOCK + k - 1)), lambda x: _of_block(x, k, s)), lambda a: F.struct((a["place"] + j * _BLOCK).alias("place"), a["anchor"].alias("anchor")))
        return F.when(F.octet_length(b) >= k, F.flatten(F.transform(blocks, moved))).otherwise(F.array().cast(_ANCHORS))

    return _once(data, found)


def _hashes(found: Column) -> Column:
    return F.transform(found, lambda a: a["anchor"])


def short_anchors(data: Column, s: int = 9) -> Column:
    """The distinct inner substrings' hashes of bytes, in their order; of fewer than ``s``, the hash of all."""
    n = F.octet_length(data)
    return F.when(n >= s, _once(data, lambda b: F.array_distinct(_inner(b, s)))).when(n > 0, F.array(F.hash(data))).otherwise(F.array().cast("array<int>"))


def fingerprint(found: Column) -> Column:
    """Anchor hashes (array<int>) as a string of eight hexadecimal digits each."""
    return F.array_join(F.transform(found, lambda a: F.lower(F.lpad(F.hex(a.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Twice the distinct anchors in common over the distinct anchors of both (Dice), 0 to 1."""
    both = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(both == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / both)


def alike(a: Column, a_data: Column, b: Column, b_data: Column, k: int, s: int) -> Column:
    """``likeness`` of the anchors ``a`` and ``b`` of two texts' bytes; of their inner substrings where one is short."""
    short = F.least(F.octet_length(a_data), F.octet_length(b_data)) < 2 * k
    return F.when(short, likeness(short_anchors(a_data, s), short_anchors(b_data, s))).otherwise(likeness(a, b))


def with_next(docs: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """Adds ``next_<c>`` for each column: its value in the next row by ``order`` (long; null first), then by the first
    of the columns; after the last row comes the first. Rows are dealt into ranges whose bounds are orders that occur,
    and the rows at a bound go to the range before it as well."""
    key = F.coalesce(F.col(order), F.lit(_LEAST_LONG))
    count = docs.count()
    wanted = max(1, count // _RANGE_ROWS)
    n, parts = min(_COARSE_RANGES, wanted), min(_FINER, -(-wanted // _COARSE_RANGES))
    if not count:
        return docs.select("*", *(F.col(c).alias(f"next_{c}") for c in columns))
    at = docs.agg(F.percentile_approx(key, F.array(*(F.lit(i / n) for i in range(n))), F.lit(20 * n + 10_000))).first()[0]
    least = docs.agg(F.min(key)).first()[0]
    bounds = sorted({least, *at})
    fine = [bounds[i : i + _FINE] for i in range(0, len(bounds), _FINE)]
    longs = lambda xs: F.array(*(F.lit(x).cast("long") for x in xs))
    coarse = F.size(F.filter(longs(f[0] for f in fine), lambda b: b <= F.col("_key")))
    inner = F.element_at(F.array(*map(longs, fine)), F.col("_coarse"))

    def ranged(df: DataFrame) -> DataFrame:
        return (
            df.withColumn("_key", key)
            .withColumn("_coarse", coarse)
            .withColumn("_range", (F.col("_coarse") - 1) * _FINE + F.size(F.filter(inner, lambda b: b <= F.col("_key"))) - 1)
            .withColumn("_first", F.array_contains(inner, F.col("_key")))
            .drop("_coarse")
        )

    dealt, last = ranged(docs), len(bounds) - 1
    if parts > 1:  # each range is cut again, at orders that occur in it above its first
        cuts = ranged(docs.select(order)).groupBy("_range").agg(F.min("_key").alias("_least"), F.percentile_approx("_key", F.array(*(F.lit(i / parts) for i in range(1, parts))), F.lit(20 * parts)).alias("_cuts"))
        cuts = cuts.select("_range", F.filter(F.array_sort(F.array_distinct("_cuts")), lambda c: c > F.col("_least")).alias("_cuts"))
        cuts = cuts.withColumn("_base", F.sum(F.size("_cuts") + 1).over(Window.orderBy("_range")) - F.size("_cuts") - 1)  # one row a range
        last = cuts.agg(F.sum(F.size("_cuts") + 1)).first()[0] - 1
        below = F.size(F.filter("_cuts", lambda c: c <= F.col("_key")))
        dealt = dealt.join(F.broadcast(cuts), "_range").withColumn("_first", F.col("_first") | F.array_contains("_cuts", F.col("_key"))).withColumn("_range", (F.col("_base") + below).cast("int")).drop("_cuts", "_base")
    own = F.struct(F.col("_range").alias("range"), F.lit(0).alias("order"))
    ahead = F.struct(F.when(F.col("_range") == 0, last).otherwise(F.col("_range") - 1).cast("int").alias("range"), F.when(F.col("_range") == 0, 2).otherwise(1).alias("order"))
    dealt = dealt.withColumn("_in", F.explode(F.when(F.col("_first"), F.array(own, ahead)).otherwise(F.array(own)))).drop("_range", "_first")
    window = Window.partitionBy("_in.range").orderBy("_in.order", "_key", columns[0])
    return dealt.select("*", *(F.lead(c).over(window).alias(f"next_{c}") for c in columns)).filter("_in.order = 0").drop("_in", "_key")


def compare(docs: DataFrame, *, k: int = 32, s: int = 9, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its fingerprint, that of its text with the last quarter replaced by the start of the next
    document, and how alike its fingerprint is to that and to the next document's."""
    plain = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = F.char_length("text")
    tail = F.floor(n / 4).cast("int")
    stays = F.octet_length(F.left("text", n - tail))  # bytes before the edit
    found = anchors(F.col("text").cast("binary"), k, s)
    own = F.transform(F.array(found), lambda a: F.struct(_hashes(a).alias("anchors"), F.size(F.filter(a, lambda x: x["place"] + k <= F.col("stays"))).alias("kept")))[0]
    plain = plain.withColumn("stays", stays).withColumn("own", own).select("doc_id", "text", "stays", F.col("own.anchors").alias("anchors"), F.col("own.kept").alias("kept"))
    pairs = with_next(plain, "doc_id", ["text", "anchors"])
    edited = pairs.withColumn("edited", F.concat(F.left("text", n - tail), F.left("next_text", tail))).withColumn("n_chars", n.cast("long"))
    data = F.col("edited").cast("binary")
    since = F.greatest(F.col("stays") - (k - 1), F.lit(0))
    rest = _hashes(anchors(F.substring(data, since + 1, F.octet_length("edited")), k, s))
    edited = edited.withColumn("edited_anchors", F.concat(F.slice("anchors", F.lit(1), F.col("kept")), rest))

    def shown(found: str, text: str) -> Column:
        return fingerprint(F.when(F.octet_length(text) < 2 * k, short_anchors(F.col(text).cast("binary"), s)).otherwise(F.col(found)))

    return edited.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        shown("anchors", "text").alias("fingerprint"),
        shown("edited_anchors", "edited").alias("edited_fingerprint"),
        alike(F.col("anchors"), F.col("text").cast("binary"), F.col("edited_anchors"), data, k, s).alias("near_edited"),
        alike(F.col("anchors"), F.col("text").cast("binary"), F.col("next_anchors"), F.col("next_text").cast("binary"), k, s).alias("near_next"),
    )
