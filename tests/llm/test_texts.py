"""Token counts, piece codec, wavelet matrices, sharding, fingerprints: exact against the libraries or brute force, and
on nulls, empty and long texts, repeated rows, clashing columns and empty tables."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lamina.llm import piece_codec, sharding, syncmers, token_counts, wavelet
from lamina.llm.queries import QUERIES

JSON, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LONG = " ".join(f"word{i % 977}" + (".\n" if i % 13 == 0 else "") for i in range(30_000))
ROWS = [
    (4, LONG), (0, ""), (1, None), (2, "word"), (3, " \n\t  "), (5, LONG), (6, "Ünï <|endoftext|> 日本語 ▁▁ \x01\nx don't  I'll"), (7, "same text here"), (7, "same text here"),
    (8, "same text here"), (None, "no id, some text"), (9, "a" * 5000), (10, "é́🙂 <s> </s>\r\n\x00 2³ "), (11, "\n\n leading"),
]


@pytest.fixture(scope="module")
def docs(spark):
    """With columns of the operators' own names in the way."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    clash = ["ids", "size", "shard", "slot", "n_tokens", "key", "piece", "part", "anchors", "_key", "payload", "n_bytes", "n_chars"]
    return df.withColumns({c: F.lit("clash") for c in clash}).repartition(3)


def _by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, str(r)))


@pytest.mark.parametrize("path", [JSON, MODEL])
def test_token_counts(docs, path):
    if path == JSON:
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    else:
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(library.encode(t))
    got = token_counts.count_tokens(docs, path, part_chars=1000, batch_bytes=5000).collect()
    want = [(i, len((t or "").encode()), n := count(t or ""), n > 512) for i, t in ROWS]
    assert _by_id(map(tuple, got)) == _by_id(want)


def test_piece_codec_units():
    import sentencepiece

    library, own = sentencepiece.SentencePieceProcessor(model_file=MODEL), piece_codec.PieceCodec(MODEL, cache_words=500)
    rng = random.Random(5)
    texts = ["".join(rng.choice("thean n\n▁é日\x01 .<>") for _ in range(rng.randint(0, 80))) for _ in range(2000)] + [t or "" for _, t in ROWS] + ["thethe" * 200, "  " * 30 + "x"]
    for _ in range(2):  # cold and from the cache
        got = own.encode(texts, end=True)
        assert [g.tolist() for g in got] == library.encode(texts, add_eos=True)
    assert [own.decode(g.tolist()) for g in got] == [library.decode(g.tolist()) for g in got]
    broken = [[rng.randrange(3, 3000 if rng.random() < 0.3 else 259) for _ in range(rng.randint(0, 9))] for _ in range(2000)]
    assert [own.decode(b) for b in broken] == [library.decode(b) for b in broken]


def test_piece_codec_long_words():
    """Words of many parts: as the library's, in a time that is about linear in their length."""
    import time

    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(6)
    texts = ["".join(rng.choice(letters) for _ in range(n)) for letters in ("a", "ab", "the", "aeiou", "=-", "0123456789", " ", " a", "é日x", "thinge r", "xyz▁\x01\n") for n in (255, 256, 257, 700, 3001)]
    texts += [w * n for w in ("the", "ing", "banana", "=", "abcde", "nation") for n in (100, 999, 4000)] + ["".join(sorted("thequickbrownfox" * 300))]
    own = piece_codec.PieceCodec(MODEL)
    assert [g.tolist() for g in own.encode(texts)] == library.encode(texts)
    assert not any(len(k) > 256 for k in own.cache)
    for text in ("the" * 100_000, " " * 100_000):
        start = time.process_time()
        assert own.encode([text])[0].tolist() == library.encode(text)
        assert time.process_time() - start < 5  # about 0.1 here


def test_piece_codec_tables(docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    both = piece_codec.decode(piece_codec.encode(docs, MODEL, end=True, slice_bytes=5000), MODEL, slice_ids=1000).collect()
    want = [(i, ids := library.encode(t or "", add_eos=True), library.decode(ids)) for i, t in ROWS]
    assert _by_id((r["doc_id"], r["ids"], r["text"]) for r in both) == _by_id(want)
    once = piece_codec.round_trip(docs, MODEL, end=True, slice_bytes=5000).collect()
    assert _by_id((r["doc_id"], r["ids"], r["decoded"]) for r in once) == _by_id(want)


def test_wavelet_units():
    rng = np.random.default_rng(2)
    for n, top in ((0, 5), (1, 1), (513, 40), (5000, 60_000)):
        values = rng.integers(0, top, n).astype(np.uint16)
        matrix, ids, lengths = wavelet.unpack(wavelet.pack(values, [None, 7], np.array([0, n]), 16))
        assert (matrix.values() == values).all() and ids == [None, 7] and lengths.tolist() == [0, n]
        assert (matrix.access(np.arange(n)) == values).all()
        for v in {*values[:5].tolist(), 3, 65_535}:
            places = np.flatnonzero(values == v)
            assert matrix.rank(v, n) == len(places) and matrix.rank(v, n // 2) == (places < n // 2).sum()
            assert (matrix.places(v) == places).all()
            assert [matrix.select(v, k) for k in range(len(places))][:20] == places[:20].tolist() and matrix.select(v, len(places)) == -1
    with pytest.raises(ValueError, match="no wavelet"):
        wavelet.unpack(b"nothing like it")


def test_wavelet_tables(docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(JSON)
    shards = wavelet.write_shards(docs, JSON, partitions=3, shard_tokens=5000)
    assert shards.count() > 3
    got = {(r["doc_id"], r["start"]): np.frombuffer(r["ids"], "<u4").tolist() for r in wavelet.read_documents(shards).collect()}
    at, want = 0, {}
    for i, t in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want[i, at] = ids
        at += len(ids)
    assert got == want


def test_wavelet_lookups(docs):
    """Access, counts and occurrences from the files, against the decoded sequence."""
    shards = wavelet.write_shards(docs, JSON, partitions=3, shard_tokens=5000)
    rows = sorted(wavelet.read_documents(shards).collect(), key=lambda r: r["start"])
    every = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in rows])
    places = [0, 1, 77, len(every) // 2, len(every) - 1, len(every), -4]
    assert {r["place"]: r["token"] for r in wavelet.tokens_at(shards, places).collect()} == {p: every[p] for p in places[:5]}
    assert wavelet.tokens_at(shards, list(range(2000))).count() == 2000
    frequent, absent = int(np.bincount(every).argmax()), 49_999
    assert {r["token"]: r["n"] for r in wavelet.count_tokens(shards, [0, frequent, absent]).collect()} == {0: len(rows), frequent: int((every == frequent).sum()), absent: int((every == absent).sum())}
    found = wavelet.occurrences(shards, frequent).collect()
    assert sorted(r["place"] for r in found) == np.flatnonzero(every == frequent).tolist()
    starts = {(r["doc_id"], r["start"]) for r in rows}
    assert all((r["doc_id"], r["place"] - r["within"]) in starts for r in found)
    assert wavelet.occurrences(shards, 1 << 20).count() == 0
    with pytest.raises(ValueError, match="at most"):
        wavelet.tokens_at(shards, list(range(100_001)))


def test_text_encoder(monkeypatch):
    """Word by word against whole texts, on strings of the pattern's own cases and on very long white space."""
    monkeypatch.setattr(wavelet, "_KNOWN_WORDS", 5000)
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(JSON), wavelet.TextEncoder(JSON, "<u4")
    rng = random.Random(8)
    latin = [chr(c) for c in range(256)]
    texts = ["".join(rng.choice("ab'strevmld  \n\t\r12²¼é.,-\x85\xa0\x1c" if rng.random() < 0.9 else latin) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    texts += [t or "" for _, t in ROWS] + ["x" + " " * 1_500_000, "\n" * 1_500_000 + "y", "a" * 50_000]
    got = own.encode(texts)
    want = library.encode_batch_fast(texts, add_special_tokens=False)
    assert all(np.frombuffer(g, "<u4").tolist() == w.ids for g, w in zip(got, want, strict=True))


def test_text_encoder_of_columns(monkeypatch):
    """Columns by distinct stretches against the library's ids of whole texts, each stretch looked up once a slice."""
    monkeypatch.setattr(wavelet, "_KNOWN_STRETCHES", 5000)
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(JSON), wavelet.TextEncoder(JSON, "<u4")
    rng = random.Random(9)
    latin = [chr(c) for c in range(256)]
    texts = ["".join(rng.choice("ab'st  \n\r1é.,-àÅ\x85\xa0\x1c" if rng.random() < 0.9 else latin) for _ in range(rng.randint(0, 40))) for _ in range(6000)]
    texts += [t or "" for _, t in ROWS] + ["x" + " " * 1_500_000, " " + "\n" * 1_500_000 + " y", "a" * 50_000, "", "\xa0 \x85 a\xa0 b\x85 c", "日 本", "a <|endoftext|> b", "", "it's é's à, Å. ×÷× a×b÷, 2²x1 ¼x'S 'll're'x"]
    for column in (pa.array(texts), pa.array(["cut off", *texts, "too"]).slice(1, len(texts)), pa.array(texts, pa.large_string())):
        flat, n = own.encode_column(column)
        want = [w.ids for w in library.encode_batch_fast(texts, add_special_tokens=False)]
        assert n.tolist() == [len(w) for w in want] and flat.tolist() == [i for w in want for i in w]
    for few in ([], [""], ["", ""], ["日"], ["a"]):
        flat, n = own.encode_column(pa.array(few, pa.string()))
        assert (flat.tolist(), n.tolist()) == (library.encode("".join(few), add_special_tokens=False).ids, [len(library.encode(t).ids) for t in few])
    asked = []
    monkeypatch.setattr(own, "_new", lambda t: asked.append(t) or b"")
    own.encode_column(pa.array(["seldomseen thing"] * 50))
    assert asked == ["seldomseen", " thing"]


def test_differencing():
    rng = random.Random(1)
    for _ in range(50):
        sizes = [rng.randint(1, 1000) for _ in range(rng.randint(0, 200))]
        found = sharding.difference([[(s, i)] for i, s in enumerate(sizes)], 4)
        sums = [sum(s for s, f in zip(sizes, found) if f == k) for k in range(4)]
        assert len(found) == len(sizes) and set(found) <= set(range(4)) and max(sums) - min(sums) <= max(sizes, default=0)
    found = sharding.difference([[(s, i)] for i, s in enumerate([8, 7, 6, 5, 4])], 2)
    assert sorted(sum(s for s, f in zip([8, 7, 6, 5, 4], found) if f == k) for k in (0, 1)) == [14, 16]


def _differenced(sizes: list[int], shards: int) -> list[int]:
    """Largest differencing method on tuples of sums, by sorting all of them at every step; the sums it ends with."""
    parts = [[s] + [0] * (shards - 1) for s in sizes]
    while len(parts) > 1:
        parts.sort(key=lambda p: max(p) - min(p))
        a, b = parts.pop(), parts.pop()
        parts.append([x + y for x, y in zip(sorted(a), sorted(b, reverse=True))])
    return sorted(parts[0])


def test_differencing_by_definition(spark):
    rng = random.Random(2)
    for shards in (2, 3, 16):
        sizes = rng.sample(range(1, 10**9), 100)  # no ties, which may be taken in any order
        found = sharding.difference([[(s, i)] for i, s in enumerate(sizes)], shards)
        assert sorted(sum(s for s, f in zip(sizes, found) if f == k) for k in range(shards)) == _differenced(sizes, shards)
    rows = [(i, "x" * n) for i, n in enumerate(rng.sample(range(1, 4000), 300))]
    sums = [0] * 5
    for r in sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect():
        sums[r["shard"]] += r["size"]
    assert sorted(sums) == _differenced([len(t) + 1 for _, t in rows], 5)


def test_sharding_over_levels(spark, monkeypatch):
    """Buckets of five groups, differenced three at a time over several levels; whole groups if asked for."""
    monkeypatch.setattr(sharding, "_BUCKET_GROUPS", 5)
    monkeypatch.setattr(sharding, "_FAN", 3)
    rng = random.Random(5)
    rows = [(i, f"{i}" * rng.randint(1, 200)) for i in range(400)] + [(1000 + i, "hot") for i in range(50)] + [(2000 + i, "large" * 500) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for whole in (False, True):
        got = sharding.shard(df, 4, whole=whole).collect()
        assert len(got) == len(rows)
        sums, where = [0] * 4, {}
        for r in got:
            sums[r["shard"]] += r["size"]
            where.setdefault(dict(rows)[r["doc_id"]], set()).add(r["shard"])
        assert (len(where["large" * 500]) == 1) == whole and len(where["hot"]) == 1
        rest = sorted(sums)[:-1] if whole else sums
        assert max(rest) - min(rest) < 0.1 * sum(rest) / len(rest)


def test_sharding_tables(spark, docs):
    got = sharding.shard(docs, 3).collect()
    assert _by_id((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == _by_id((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in ROWS)
    for s in range(3):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    # groups stay whole, unless one is larger than a shard
    rng = random.Random(4)
    rows = [(i, f"text {i % 50} " * rng.randint(1, 3) if i % 3 else "hot") for i in range(3000)] + [(3000 + i, "large" * 200) for i in range(60)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    text, where, sums = dict(rows), {}, [0] * 4
    for r in got:
        where.setdefault(text[r["doc_id"]], set()).add(r["shard"])
        sums[r["shard"]] += r["size"]
    assert all(len(s) == 1 for t, s in where.items() if "large" not in t) and len(where["large" * 200]) > 1
    assert max(sums) - min(sums) < 0.1 * sum(sums) / 4


def _closed(data: bytes, k: int, s: int, hashes: dict) -> list[bytes]:
    """Closed syncmers by definition, over given hashes of substrings."""
    out = []
    for i in range(len(data) - k + 1):
        inner = [hashes[data[j : j + s]] for j in range(i, i + k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append(data[i : i + k])
    return out


def _short(data: bytes, s: int) -> list[bytes]:
    return [data[i : i + s] for i in range(len(data) - s + 1)] or [data] * bool(data)


@pytest.mark.parametrize(("k", "s", "block"), [(32, 9, 1 << 15), (12, 4, 50)])
def test_syncmers(spark, docs, monkeypatch, k, s, block):
    monkeypatch.setattr(syncmers, "_BLOCK", block)
    rows = [r for r in ROWS if r[1] != LONG] + [(20, LONG[:9000]), (21, LONG[:8000] + "x" + LONG[8000:9000]), (22, "short one"), (23, "short one!"), (24, LONG[:63]), (25, LONG[:64])]
    got = syncmers.compare(spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("anchors", "stays", "own", "kept", "edited")}).repartition(3), k=k, s=s).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    texts = [t or "" for _, t in order]
    edited = [t[: len(t) - len(t) // 4] + n[: len(t) // 4] for t, n in zip(texts, texts[1:] + texts[:1])]
    every = [t.encode() for t in texts + edited]
    kinds = sorted({x for t in every for x in _short(t, s)} | {t[i : i + k] for t in every for i in range(len(t) - k + 1)})
    table = spark.createDataFrame([(x,) for x in kinds], "x binary")
    hashes = {bytes(r["x"]): r["h"] for r in table.select("x", F.hash("x").alias("h")).collect()}

    def prints(t: str) -> list[int]:
        b = t.encode()
        return [hashes[x] for x in (dict.fromkeys(_short(b, s)) if len(b) < 2 * k else _closed(b, k, s, hashes))]

    def like(a: str, b: str) -> float:
        short = min(len(a.encode()), len(b.encode())) < 2 * k
        x, y = ({hashes[g] for g in (_short(t.encode(), s) if short else _closed(t.encode(), k, s, hashes))} for t in (a, b))
        return 2 * len(x & y) / (len(x) + len(y)) if x or y else 1.0

    shown = lambda t: "".join(f"{h & 0xFFFFFFFF:08x}" for h in prints(t))
    want = [(i, len(t), hashlib.sha256(e.encode()).hexdigest(), shown(t), shown(e), round(like(t, e), 9), round(like(t, n), 9)) for (i, _), t, e, n in zip(order, texts, edited, texts[1:] + texts[:1])]
    assert _by_id((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got) == _by_id(want)


def test_syncmers_of_odd_texts(docs):
    """Long, null, empty and repeated texts among clashing columns; equal texts have equal fingerprints."""
    got = syncmers.compare(docs).collect()
    assert len(got) == len(ROWS)
    prints = {}
    for r in got:
        prints.setdefault(dict(ROWS)[r["doc_id"]] or "", set()).add(r["fingerprint"])
    assert all(len(p) == 1 for p in prints.values()) and prints[""] == {""}
    assert len({*map(str, prints.values())}) == len(prints)


def test_syncmers_survive_edits(spark):
    """Near copies share most anchors, also without white space and around 2 k bytes; other texts none."""
    rng = random.Random(3)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    unspaced, sentence = letters(4000), "A few plain words that make about sixty letters in all, no more"
    rows = [(1, unspaced), (2, unspaced[:1000] + "X" + unspaced[1000:]), (3, letters(4000)), (4, sentence), (5, sentence + "!!"), (6, letters(70))]
    got = {r["doc_id"]: r["near_next"] for r in syncmers.compare(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] > 0.95 and got[2] < 0.02 and got[4] > 0.9 and got[5] < 0.1


@pytest.mark.parametrize("coarse", [4096, 8, 1])
def test_next_row_over_many_ranges(spark, monkeypatch, coarse):
    monkeypatch.setattr(syncmers, "_RANGE_ROWS", 3)
    monkeypatch.setattr(syncmers, "_FINE", 4)
    monkeypatch.setattr(syncmers, "_COARSE_RANGES", coarse)
    ids = [None, *random.Random(2).sample(range(10**12), 200), 5, 5]
    df = spark.createDataFrame([(i, f"t{k:03}") for k, i in enumerate(ids)], "id long, t string").repartition(5)
    got = {r["t"]: r["next_t"] for r in syncmers.with_next(df, "id", ["t"]).collect()}
    order = [t for _, t in sorted(((i is not None, i or 0), f"t{k:03}") for k, i in enumerate(ids))]
    assert got == dict(zip(order, order[1:] + order[:1]))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, tmp_path, name):
    shapes = {"documents": "doc_id long, text string, lang string, source string, n_chars long", "labels": "doc_id long, quality int, toxic int", "embeddings": "vec_id long, embedding array<float>, label int"}
    for table, shape in shapes.items():
        spark.createDataFrame([], shape).write.parquet(str(tmp_path / f"{table}.parquet"))
    assert QUERIES[name](spark, str(tmp_path)).count() == 0
