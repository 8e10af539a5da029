"""Each operator against a brute-force version, on documents with all the awkward cases."""

import hashlib
import html as entities
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlake.llm import chat, components, decontamination, fingerprints, html_text, near_dedup, packing, quality, queries, sharding, substring_dedup, token_counts, tokens
from ledgerlake.llm.words import ALNUM, SPACED, words_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, kept_text string, rest string"
SPACE, ALPHA = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    out = [(i, say(rng.choice((3, 60, 120)))) for i in range(60)]
    passage = say(70)
    out += [(100 + i, f"{say(10)}\n{passage}\t {say(9)}") for i in range(6)]
    copy = say(150)
    out += [(200 + i, copy) for i in range(8)]
    near = copy.split()
    for i in range(12):
        k = rng.randrange(150)
        out.append((300 + i, " ".join(near[:k] + [f"edit{i}"] + near[k + 1 :])))
    out += [(400, None), (401, ""), (402, " \t\n "), (403, "A"), (404, "a"), (405, "<|endoftext|> x  y   z "), (406, say(9000)), (407, "x" * 5000), (None, say(60)), (None, None)]
    out += [(500, copy), (500, copy), (501, say(60)), (501, passage + " " + say(5)), (502, "日本語 テキスト " * 30)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(d, t, None if d == 3 else "en", "s", len(t or ""), "clash", "clash", "clash") for d, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_words():
    for letters, pattern in ((SPACED, SPACE), (ALNUM, ALPHA)):
        sample = ["a B\x0bc-d", "", None, "é1_2", "\x1cx\x1d", "tail "]
        w = words_of(pa.array(sample), letters, fold=True)
        got = [[bytes(w.raw[w.starts[k] : w.ends[k]]).decode() for k in range(w.first[i], w.first[i + 1])] for i in range(len(sample))]
        assert got == [pattern.findall(low(t or "")) for t in sample]
    a, b = words_of(pa.array(["p q r s"])), words_of(pa.array(["z", "q r s t"]))
    assert a.grams(3)[1] == b.grams(3)[1] and a.grams(3)[0] != b.grams(3)[1]


def test_difference_cover_is_perfect():
    d = {(a - b) % substring_dedup.PERIOD for a in substring_dedup.COVER for b in substring_dedup.COVER}
    assert d == set(range(substring_dedup.PERIOD))
    with pytest.raises(ValueError):
        substring_dedup.anchor_words(20)


@pytest.mark.parametrize("window", [50, 31])
def test_substring_dedup(docs, texts, empty, window):
    first = {}
    for d, t in texts:
        if d is not None:
            w = SPACE.findall(t or "")
            for i in range(len(w) - window + 1):
                k = tuple(w[i : i + window])
                first[k] = min(first.get(k, d), d)
    want = []
    for d, t in texts:
        w = SPACE.findall(t or "")
        gone = [False] * len(w)
        for i in range(len(w) - window + 1 if d is not None else 0):
            if first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        want.append((str(d), len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    out = substring_dedup.substring_dedup(docs, window=window)
    assert out.columns == [*docs.columns, "n_removed", "removed_spans"]
    rows = out.collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in rows) == sorted(want)
    assert all(sum(s.stop - s.start for s in r.removed_spans) == r.n_removed for r in rows)
    assert substring_dedup.substring_dedup(empty, window=window).count() == 0


def brute_components(texts, k, percent):
    sets, parent = {}, {}
    for d, t in texts:
        w = SPACE.findall(low(t or ""))
        s = frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
        sets.setdefault(d, []).append(s)
    nodes = sorted(d for d in sets if d is not None)
    parent = {d: d for d in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            for s in sets[a]:
                for z in sets[b]:
                    both = len(s & z)
                    if both and 100 * both >= percent * (len(s) + len(z) - both):
                        x, y = find(a), find(b)
                        parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in nodes}, sets


def test_near_dedup(docs, texts, empty):
    want, sets = brute_components(texts, 4, 80)
    rows = near_dedup.near_dedup(docs, shingle=4).collect()
    assert len(rows) == len(texts)
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == want[r.doc_id] and r.kept == (r.doc_id == want[r.doc_id])
            assert r.n_shingles in {len(s) for s in sets[r.doc_id]}
    assert near_dedup.near_dedup(empty).count() == 0


@pytest.mark.parametrize("leaf", [24, 1])
@pytest.mark.parametrize("seed", [0, 1])
def test_near_dedup_around_the_threshold(spark, monkeypatch, leaf, seed):
    """Near copies of a text that is not there itself, most a little too far apart, some shorter."""
    monkeypatch.setattr(near_dedup, "LEAF", leaf)
    rng = random.Random(seed)
    base = [f"w{rng.randrange(500)}" for _ in range(110)]
    docs = []
    for i in range(70):
        words = list(base)
        for _ in range(rng.randint(1, 5)):
            words[rng.randrange(110)] = f"e{rng.randrange(12)}"
        docs.append((i, " ".join(words[rng.randint(0, 6) : 110 - rng.randint(0, 6)])))
    want, _ = brute_components(docs, 4, 80)
    assert 2 < len(set(want.values())) < 60
    got = near_dedup.near_dedup(spark.createDataFrame(docs, "doc_id long, text string"), shingle=4).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_forest_neighbours_have_the_longest_prefix():
    keys = np.array([7, 7, 7, 8], np.int64)
    x = np.array([1 << 32, 1 << 32, 2 << 32, 0], np.int64)
    zero = np.zeros(4, np.int64)
    batch = pa.RecordBatch.from_arrays([pa.array(a) for a in (keys, x, zero, np.arange(4), zero + 5)], ["key", "x", "y", "c", "n"])
    got = pa.Table.from_batches(list(near_dedup._regions(iter([batch])))).to_pydict()
    assert dict(zip(got["c"], got["prev"])) == {0: None, 1: 0, 2: 1, 3: None} and got["prev_n"] == [None, 5, 5, None] and got["mates"] == [3, 3, 3, 1]
    assert got["parts"][0] == got["parts"][1] and not set(got["parts"][1]) & set(got["parts"][2]) and len(set(got["parts"][0])) == 4


@pytest.mark.parametrize("edges", [250_000, 7])
def test_components(spark, monkeypatch, edges):
    monkeypatch.setattr(components, "EDGES", edges)
    chain = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 105)]
    links = spark.createDataFrame(chain, "a long, b long")
    got = {r.node: r.component for r in components.components(links, len(chain)).collect()}
    assert got == {i: 0 for i in range(1, 31)} | {101: 100, 105: 100}
    assert components.components(links.limit(0), 0).count() == 0


@pytest.fixture(scope="module")
def benchmark(spark, texts):
    some = [t for d, t in texts if d in (5, 11, 100, 406)]
    items = [(i, " ".join(t.split()[2:22]).upper()) for i, t in enumerate(some)] + [(20, " ".join(some[0].split()[:3])), (21, ""), (22, None), (None, some[1]), (23, "日本語"), (20, "twice the same id here"), (24, some[3][100:900])]
    return spark.createDataFrame(items, "item_id long, text string"), items


def brute_hits(texts, items):
    windows = defaultdict(set)
    for i, t in items:
        w = ALPHA.findall(low(t or ""))
        if i is not None and w:
            for k in range(max(1, len(w) - 9)):
                windows[tuple(w[k : k + 10])].add(str(i))
    sizes = {len(k) for k in windows}
    want = []
    for d, t in texts:
        w = ALPHA.findall(low(t or ""))
        hit, found = [False] * len(w), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if names := windows.get(tuple(w[i : i + n])):
                    found |= names
                    hit[i : i + n] = [True] * n
        want.append((str(d), len(w), sum(hit), ",".join(sorted(found))))
    return sorted(want)


@pytest.mark.parametrize("bound", [1 << 24, 1 << 12])
def test_decontamination(docs, texts, empty, benchmark, monkeypatch, bound):
    """Also with a filter that lets nearly all through and with hits joined by a shuffle."""
    monkeypatch.setattr(decontamination, "FILTER_BITS", bound)
    monkeypatch.setattr(decontamination, "HITS_BYTES", bound if bound > 1 << 12 else -1)
    frame, items = benchmark
    want = brute_hits(texts, items)
    out = decontamination.decontaminate(docs, frame)
    rows = out.collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, ",".join(r.hit_items)) for r in rows) == want
    assert all(r.contaminated == (r.n_hit > 0) and sum(s.stop - s.start for s in r.hit_spans) == r.n_hit for r in rows)
    assert decontamination.decontaminate(docs, frame.limit(0)).where("contaminated").count() == 0
    assert decontamination.decontaminate(empty, frame).count() == 0


def test_decontamination_of_a_gram_that_all_share(spark):
    """One 5-gram, one window and one word run stand in all items and all documents."""
    rng = random.Random(2)
    say = lambda n: " ".join(f"w{rng.randrange(300)}" for _ in range(n))
    gram, shared = "the same five words here", "ten words that every single item and document has inside"
    items = [(i, f"{say(12)} {gram} {say(8)}" + (f" {shared}" if i % 2 else "")) for i in range(40)] + [(99, "na na na na na na na na na na na na")]
    texts = [(d, f"{say(9)} {gram} {say(9)} {shared if d % 3 else ''} {'na ' * (d % 40)}") for d in range(120)]
    docs, frame = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    out = decontamination.decontaminate(docs, frame).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, ",".join(r.hit_items)) for r in out) == brute_hits(texts, items)


def test_tokens_and_packing(spark, docs, texts, empty):
    library = tokens.Encoder(queries.tokenizer()).library
    ids = [(d, np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")) for d, t in texts]
    counted = token_counts.token_counts(docs, queries.tokenizer()).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in counted) == sorted((str(d), len((t or "").encode()), len(x) - 1) for (d, t), (_, x) in zip(texts, ids))
    assert token_counts.token_counts(empty, queries.tokenizer()).count() == 0
    rows = packing.pack(docs, queries.tokenizer(), with_ids=True).collect()
    known = {zlib.crc32(x.tobytes()): x for _, x in ids}
    pieces, padding = defaultdict(list), 0
    for r in rows:
        assert zlib.crc32(np.frombuffer(r.ids, "<u2").astype("<u4").tobytes()) == r.ids_crc32
        pieces[r.sequence_id].append((r.offset, r.length))
    for p in pieces.values():
        at = 0
        for o, n in sorted(p):
            assert o == at
            at += n
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert sum(r.length for r in rows) == sum(len(x) for _, x in ids) and padding <= 32 and len(known) > 50
    per = defaultdict(list)
    for r in rows:
        if r.doc_id is not None and r.doc_id < 500:
            per[r.doc_id].append(r)
    for d, x in ids:
        if d is not None and d < 500:
            at = 0
            for r in sorted(per[d], key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(x)
                assert zlib.crc32(x[at : at + r.length].tobytes()) == r.ids_crc32
                at += r.length
            assert at == len(x)
    assert packing.pack(empty, queries.tokenizer()).count() == 0


def test_odd_white_space_gives_the_library_s_tokens():
    rng = random.Random(3)
    parts = ["a", "B", " ", "  ", "\n", "\t", "é", "1", "'s", "<|endoftext|>", "the", "!", "日本", " \n", "\r\n", "   ", "_", "²", " ", "\x85"]
    odd = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(5000)]
    encoder = tokens.Encoder(queries.tokenizer())
    want = [e.ids for e in encoder.library.encode_batch(odd, add_special_tokens=False)]
    ids, lengths = encoder.encode(pa.array(odd))
    assert list(lengths) == [len(w) for w in want] and list(ids) == [i for w in want for i in w]
    assert list(encoder.count(pa.array(odd))) == list(lengths)


def test_long_texts_are_cut_without_a_change_of_tokens(monkeypatch):
    monkeypatch.setattr(tokens, "LONG", 300)
    monkeypatch.setattr(tokens, "PART_BYTES", 1000)
    rng = random.Random(4)
    parts = ["word", " ", "  ", "\n", "\n\n", "\t", "\r\n", "é", "12", "x9y8", "'s", "'S", "<|endoftext|>", " <|endoftext|> ", "the", "!", "...", "日本", "\u3000", "\u2009", "\x85", "\xa0", "\x1c", "_", "²", "привет"]
    long_ = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 900))) for _ in range(120)] + ["ab12" * 900, "x" * 3000, "  " * 2000, "日本語" * 700, "", "short"]
    encoder = tokens.Encoder(queries.tokenizer())
    assert encoder.cuts and max(len(p) for t in long_[:120] for p in tokens.parts_of(t.encode())) < 900
    want = [e.ids for e in encoder.library.encode_batch(long_, add_special_tokens=False)]
    ids, lengths = encoder.encode(pa.array(long_))
    assert list(lengths) == [len(w) for w in want] and list(ids) == [i for w in want for i in w]
    assert list(encoder.count(pa.array(long_))) == list(lengths)


@pytest.mark.parametrize("seed", range(40))
def test_packing_plan(seed):
    rng = random.Random(seed)
    window = rng.choice([16, 64, 2048])
    histogram = {rng.randint(1, window - 1): rng.randint(1, rng.choice([1, 3, 50])) for _ in range(rng.randint(0, min(window - 1, 60)))}
    if seed == 0:
        window, histogram = 2048, {1500: 1001}
    rows, sequences = packing.plan(histogram, window)
    fill, cover = defaultdict(list), defaultdict(list)
    for length, lo, hi, start, size, sequence, offset, per in rows:
        for r in range(lo, hi):
            fill[sequence + (r - lo) // per].append((offset + (r - lo) % per * size, size))
            cover[length, r].append((start, size))
    assert set(cover) == {(n, r) for n, c in histogram.items() for r in range(c)} and len(fill) == sequences
    for (length, _), parts in cover.items():
        at = 0
        for s, n in sorted(parts):
            assert s == at
            at += n
        assert at == length
    padding = 0
    for parts in fill.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    assert padding <= window // 64


def test_closest_fill_is_optimal():
    rng = random.Random(9)
    for _ in range(60):
        counts = {rng.randint(1, 20): rng.randint(1, 3) for _ in range(rng.randint(1, 5))}
        used = packing.closest_fill(counts, 30)
        assert all(c <= counts[n] for n, c in used.items()) and max(counts) in used
        reach = {max(counts)}
        for n, c in counts.items():
            for _ in range(c - (n == max(counts))):
                reach |= {x + n for x in reach if x + n <= 30}
        assert sum(n * c for n, c in used.items()) == max(reach)


def test_quality(spark, sf_dir, docs, empty):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.fit_quality(table, labels)
    again = quality.fit_quality(table, labels.union(labels).union(labels.limit(1).select("doc_id", F.lit(None).cast("int"), "toxic")))
    assert np.allclose(model.means, again.means)
    scored = quality.score_quality(table, model).join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string")) % 5 == 0).toPandas()
    assert (scored.predicted == scored.quality).mean() > 0.97
    odd = quality.score_quality(docs, model).toPandas()
    assert odd.score.between(0, 1).all() and len(odd) == docs.count()
    assert quality.score_quality(empty, model).count() == 0
    assert quality.fit_quality(empty, labels).flat == 0.5


def test_quality_is_the_plain_discriminant(spark, docs):
    """Scores against Gaussian densities written out, with covariances shrunk as documented."""
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    quality_of = {r.doc_id: r.quality for r in labels.collect()}
    rows = table.select("doc_id", "text").collect()
    x = np.concatenate([quality.features(pa.array([r.text], pa.string())) for r in rows])
    learn = np.array([r.doc_id in quality_of and zlib.crc32(str(r.doc_id).encode()) % 5 != 0 for r in rows])
    y = np.array([quality_of.get(r.doc_id, -1) for r in rows])
    z = (x - x[learn].mean(0)) / x[learn].std(0)
    own = [np.cov(z[learn & (y == k)].T, bias=True) for k in (0, 1)]
    share = [(learn & (y == k)).sum() / learn.sum() for k in (0, 1)]
    logs = []
    for k in (0, 1):
        c = 0.2 * own[k] + 0.8 * (share[0] * own[0] + share[1] * own[1])
        c = 0.98 * c + 0.02 * np.eye(len(c)) * np.trace(c) / len(c)
        gap = z - z[learn & (y == k)].mean(0)
        logs.append(np.log(share[k]) - 0.5 * np.einsum("ij,jk,ik->i", gap, np.linalg.inv(c), gap) - 0.5 * np.linalg.slogdet(c)[1])
    want = {r.doc_id: 1 / (1 + np.exp(min(700, a - b))) for r, a, b in zip(rows, *logs)}
    out = quality.classify(table, labels)
    assert out.columns == [*table.columns, "score", "predicted"]
    got = {r.doc_id: r.score for r in out.collect()}
    assert got.keys() == want.keys() and all(abs(got[d] - want[d]) < 1e-6 for d in want)
    apart = quality.score_quality(table, quality.fit_quality(table, labels)).collect()
    assert all(abs(r.score - got[r.doc_id]) < 1e-9 for r in apart)
    short = quality.classify(docs.withColumn("score", F.lit("clash")).withColumn("predicted", F.lit("clash")), labels, with_text=False)
    assert "text" not in short.columns and short.columns.count("score") == 1 and short.where("score between 0 and 1").count() == docs.count()


def test_discriminant_separates_by_covariance_alone():
    rng = np.random.default_rng(0)
    x = [rng.normal(0, 1, (4000, 2)), rng.normal(0, 1, (4000, 2)) * [4, 0.25]]
    model = quality.discriminant(np.array([4000.0, 4000]), np.stack([a.sum(0) for a in x]), np.stack([a.T @ a for a in x]), pooled=0.1)
    assert ((model.score(x[1]) > 0.5).mean() + (model.score(x[0]) < 0.5).mean()) / 2 > 0.85


def plain_digest(data):
    """The digest byte by byte."""
    counts = [0] * 256
    for i in range(len(data) - 3):
        a, b, c, d = data[i : i + 4]
        for salt, (x, y, z) in ((0x9E3779B1, (a, b, c)), (0x85EBCA77, (a, b, d)), (0xC2B2AE3D, (a, c, d))):
            h = (x << 16 | y << 8 | z) * (salt | 1) % 2**32
            counts[((h ^ h >> 15) * 0x2C1B3C6D % 2**32) >> 24] += 1
    q1, q2, q3 = (sorted(counts)[k] for k in (63, 127, 191))
    codes = [(c > q1) + (c > q2) + (c > q3) for c in counts]
    size = min(255, int(np.log1p(len(data)) / np.log(1.1)))
    ratio = int(15 * q1 / q3) << 4 | int(15 * q2 / q3) if q3 else 0
    return bytes([size, ratio]) + bytes(sum(codes[4 * k + j] << 2 * j for j in range(4)) for k in range(64))


def plain_likeness(a, b):
    apart = min(64, abs(a[0] - b[0]))
    for x, y in zip(a[2:], b[2:]):
        for j in range(0, 8, 2):
            gap = abs((x >> j & 3) - (y >> j & 3))
            apart += gap + (gap == 3)
    return 1 - min(1088, apart) / 1088


@pytest.mark.parametrize("per", [4, 40])
def test_fingerprints(docs, texts, empty, spark, monkeypatch, per):
    """Every row against brute force, equal ids and rows without one included."""
    from pyspark.sql import Row

    monkeypatch.setattr(fingerprints, "RANGES_PER_PARTITION", per)
    hashes = {r.t: r.h for r in spark.createDataFrame([Row(t=t or "") for _, t in texts]).select("t", F.xxhash64("t").alias("h")).collect()}
    order = sorted(((d is not None, d or 0, hashes[t or ""], d, t or "") for d, t in texts), reverse=True)
    want = []
    for i, (*_, d, t) in enumerate(order):
        follows = order[(i + 1) % len(order)][4]
        half = len(t) // 2
        edited = t[: len(t) - half] + follows[:half]
        a, b, c = (plain_digest(x.encode()) for x in (t, edited, follows))
        want.append((str(d), len(t), hashlib.sha256(edited.encode()).hexdigest(), a.hex(), b.hex(), plain_likeness(a, b), plain_likeness(a, c)))
    rows = fingerprints.with_neighbours(docs).collect()
    assert sorted((str(r.doc_id), *r[1:]) for r in rows) == sorted(want)
    by = {r.doc_id: r for r in rows}
    assert len({by[200 + i].fingerprint for i in range(8)}) == 1
    assert fingerprints.with_neighbours(empty).count() == 0
    alone = fingerprints.with_neighbours(spark.createDataFrame([(1, "abcd efgh")], "doc_id long, text string")).head()
    assert alone.near_next == 1.0 and alone.edited_sha256 == hashlib.sha256(b"abcd abcd").hexdigest()


@pytest.mark.parametrize("hot", [7, (1 << 53) + 1, (1 << 62) + 3, -(1 << 61) - 5, (1 << 63) - 1])
def test_fingerprints_of_large_ids(spark, hot):
    """Ids that doubles do not tell apart keep their order; one that most rows have is spread over tasks."""
    rng = random.Random(41)
    rows = [(hot, f"text {i} {rng.random()}") for i in range(400)] + [(hot - k, f"near {k}") for k in range(1, 60)] + [(hot + k, f"above {k}") for k in range(1, 60) if hot + k < 1 << 63] + [(rng.randrange(-(1 << 63), 1 << 63), f"far {k}") for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    hashes = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0], hashes[r[1]]), reverse=True)
    want = Counter()
    for (d, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        half = len(t) // 2
        want[d, hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()] += 1
    out = fingerprints.with_neighbours(docs)
    assert Counter((r.doc_id, r.edited_sha256) for r in out.collect()) == want
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        per = [r["count"] for r in fingerprints.with_neighbours(docs).where(F.col("doc_id") == hot).groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(per) > 1 and max(per) < 390


def test_fingerprints_of_an_id_that_most_rows_have(spark):
    texts = [(7 if i % 3 else None if i % 2 else i, f"text number {i} of many " * (i % 4)) for i in range(400)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = sorted((str(r.doc_id), r.n_chars, r.fingerprint, r.edited_sha256) for r in fingerprints.with_neighbours(docs).collect())
    hashes = {r.t: r.h for r in docs.select(F.col("text").alias("t"), F.xxhash64("text").alias("h")).collect()}
    order = sorted(((d is not None, d or 0, hashes[t], d, t) for d, t in texts), reverse=True)
    want = []
    for i, (*_, d, t) in enumerate(order):
        half = len(t) // 2
        edited = t[: len(t) - half] + order[(i + 1) % len(order)][4][:half]
        want.append((str(d), len(t), plain_digest(t.encode()).hex(), hashlib.sha256(edited.encode()).hexdigest()))
    assert got == sorted(want)


def plain_lpt(sizes, shards):
    """Every group for itself: largest first, to the least-loaded shard."""
    loads, taken = [0] * shards, defaultdict(lambda: [0] * shards)
    for n in sorted(sizes, reverse=True):
        s = min(range(shards), key=lambda k: (loads[k], k))
        loads[s] += n
        taken[n][s] += 1
    return dict(taken), loads


@pytest.mark.parametrize("seed", range(30))
def test_deal_is_longest_processing_time(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(1, rng.choice([3, 40, 5000])) for _ in range(rng.randint(0, 3000))] + [10**6] * (seed % 3) + [7] * rng.choice([0, 500])
    histogram = {n: sizes.count(n) for n in set(sizes)}
    assert sharding.deal(histogram, 16) == plain_lpt(sizes, 16)[0]
    assert sum(sum(t) for t in sharding.deal({5: 10**9, 900: 3}, 16).values()) == 10**9 + 3


def test_sharding(docs, texts, empty, spark):
    rows = sharding.shard(docs).collect()
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in rows) == sorted((str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in texts)
    groups, homes, loads = defaultdict(int), defaultdict(set), [0] * 16
    for _, t in texts:
        groups[t or ""] += len((t or "").encode()) + 1
    for r in rows:
        homes[r.text_crc32].add(r.shard)
        loads[r.shard] += r["size"]
    assert sorted(loads) == sorted(plain_lpt(groups.values(), 16)[1])
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert all(len(v) == 1 for v in homes.values()) and {r.law for r in rows} == {"bytes"}
    assert sharding.shard(empty).count() == 0
    many = [(i, f"{i % 700:03d}" * (i % 5)) for i in range(3000)] + [(None, None)] * 50 + [(9, "same row")] * 400
    out = sharding.shard(spark.createDataFrame(many, "doc_id long, text string").repartition(4)).collect()
    groups, loads = defaultdict(int), [0] * 16
    for _, t in many:
        groups[t or ""] += len(t or "") + 1
    for r in out:
        loads[r.shard] += r["size"]
    assert sorted(loads) == sorted(plain_lpt(groups.values(), 16)[1]) and max(loads) - min(loads) <= max(groups.values())
    for s in range(16):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))


def test_chat(spark):
    turns = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "yo"), (1, 2, "bob", "yo"), (1, 3, "ann", None), (2, None, None, "lost"), (None, 0, "ann", "solo"), (3, 0, "system", "only")]
    df = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, start string")
    rows = chat.rotate(df).collect()
    views = defaultdict(list)
    for r in rows:
        views[r.conv_id, r.perspective].append(r)
    assert set(views) == {(1, "ann"), (1, "bob"), (2, "unknown"), (None, "ann")}
    for (conv, who), own in views.items():
        own.sort(key=lambda r: r.position)
        full = "".join(r.segment for r in own)
        assert [r.position for r in own] == list(range(len(own)))
        for r in own:
            text = full[r.start : r.stop]
            assert text in ("be kind", "hi", "yo", "", "lost", "solo") and (r.trained == 1) == (r.role == "assistant")
            assert r.role == ("system" if text == "be kind" else "assistant" if r.trained else "user")
    assert [r.name for r in views[1, "ann"]] == [None, None, "bob", "bob", None]
    assert chat.rotate(df.limit(0)).count() == 0


def test_chat_over_blocks(spark, monkeypatch):
    """A long conversation gives the same views whatever the block of turns."""
    turns = [(1, i, "abc"[i % 3], f"turn {i} " * (i % 4)) for i in range(60)] + [(2, 3, "a", "x" * 50_000), (2, 9, "b", None)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(4)
    want = sorted(map(str, chat.rotate(df).collect()))
    monkeypatch.setattr(chat, "BLOCK", 2)
    assert sorted(map(str, chat.rotate(df).collect())) == want and len(want) == 60 * 3 + 2 * 2


def test_chat_oracle(spark):
    import duckdb

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from read_parquet('{sf}/conversations.parquet')")
    want = con.sql(queries.oracle_sql()["op1_chat_rotation"]).df()
    got = queries.op1_chat_rotation(spark, sf).toPandas()
    key = ["conv_id", "perspective", "position"]
    got, want = (df[sorted(want.columns)].sort_values(key).reset_index(drop=True).fillna("-").astype(str) for df in (got, want))
    assert got.equals(want)


def test_html(spark):
    sf = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    forest = html_text.fit_extractor(pages)
    kind = pages.schema["page_id"].dataType
    odd = [None, "", "no tags at all", "<p>x <b>y</b>z&amp;&nbsp;w<br>v", "<nav>menu</nav><article><p>Long enough story text, with words. " * 3, "<<p class='>broken", "<script>var a = '<p>';</script>", "<!-- only -->"]
    extra = spark.createDataFrame([(10**6 + i, "u", h) for i, h in enumerate(odd)], "page_id long, url string, html string").withColumn("page_id", F.col("page_id").cast(kind))
    out = {r.page_id: r for r in html_text.extract(pages.unionByName(extra), forest).collect()}
    good = 0
    for r in pages.collect():
        body = re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", re.search(r"<article>(.*?)</article>", r.html, re.S)[1]))
        good += out[r.page_id].text == " ".join(entities.unescape(body).split())
    assert good == pages.count()
    assert out[10**6].text == "" and out[10**6].n_chars == 0 and out[10**6 + 1].text == ""
    assert all(r.n_chars == len(r.text) for r in out.values())
    assert html_text.extract(pages.limit(0), forest).count() == 0
    # Held-out layouts: whole pages, decoded, equal their known article.
    exact = total = 0
    for r in pages.orderBy(F.desc("page_id")).limit(30).collect():
        for page_html in html_text.layouts(r.html, 10**6 + r.page_id):
            page = html_text.parse(page_html)
            x, label = html_text.labelled(page_html)
            _, own = html_text.node_features(page)
            exact += html_text.render(page, label.astype(bool)) == html_text.render(page, html_text.decode(page, forest.probability(x), own))
            total += 1
    assert exact >= 0.9 * total


def test_html_clashing_columns_and_repeated_rows(spark):
    page = '<html><nav><a href="#">Home</a></nav><article><p>A story with enough words, told slowly and to its end.</p></article></html>'
    pages = spark.createDataFrame([(1, page, "old", 7, "r"), (1, page, "old", 7, "r"), (None, page, None, None, None), (2, None, "x", 1, "r")], "page_id long, html string, text string, n_chars long, rest string")
    out = html_text.extract(pages, html_text.fit_extractor(pages))
    assert out.columns == ["page_id", "text", "n_chars", "rest"]
    story = "A story with enough words, told slowly and to its end."
    assert sorted((str(r.page_id), r.text, r.n_chars, str(r.rest)) for r in out.collect()) == sorted([("1", story, len(story), "r")] * 2 + [("None", story, len(story), "None"), ("2", "", 0, "r")])


def test_html_marks_and_endless_tags(spark):
    """Marks of the training layouts in an input page are attributes like others; pages of tags
    without an end or a partner take time in step with their length and give their text."""
    story = "The harbour was quiet that morning, and nobody on the quay had seen the boat leave. "
    page = "<html><body><article><h1>Quiet</h1>" + f"<p data-is-article=yes>{story}</p><p data-is-article>{story}</p><p data-is-article='0'>{story}</p>" + "</article></body></html>"
    rows = [page, "<a " * 350_000, "story <p>" + "<a x='" * 200_000, "<div>" * 100_000 + "x", "<div>" * 50_000 + "</i>" * 100_000 + "<li>y", "<b>" * 60_000 + "<p>" * 60_000, "</p>" * 200_000, "<" * 1_000_000, "a <b", "<p>a &lt; b <!-- <b> "]
    began = time.perf_counter()
    for html_ in rows:
        html_text.node_features(html_text.parse(html_))
    assert time.perf_counter() - began < 60
    assert html_text.parse("a <b").segments == [(0, "a ")] and html_text.parse(rows[1]).segments == []
    pages = spark.createDataFrame(list(enumerate(rows[:3] + rows[8:])), "page_id long, html string")
    got = {r.page_id: r.text for r in html_text.extract(pages, html_text.fit_extractor(pages)).collect()}
    assert got[0] == " ".join(["Quiet", *[story.strip()] * 3]) and got[1] == "" and set(got) == set(range(5))


def test_html_few_short_long_and_repeated_pages(spark):
    """A page gives its article in a table of its own, with copies, short ones or only long ones."""
    story = "The harbour was quiet that morning, and nobody on the quay had seen the boat leave. "
    def page(body):
        return f'<html><body><nav><ul><li><a href="#">Home</a></li><li><a href="#">News</a></li></ul></nav><article><h1>A quiet harbour</h1>{body}</article><footer>All rights reserved, contact us</footer></body></html>'
    body = "".join(f"<p>{story * 3}Part {i}.</p>" for i in range(5))
    one, long_ = page(body), [page("".join(f"<p>{story * 3}Part {i} of {k}.</p>" for i in range(900))) for k in range(3)]
    short = [f"<p>Hello {i}.</p>" for i in range(300)]
    assert all(len(t) > 200_000 for t in long_)
    def read(html):
        pages = spark.createDataFrame(list(enumerate(html)), "page_id long, html string").repartition(3)
        return {r.page_id: r.text for r in html_text.extract(pages, html_text.fit_extractor(pages)).collect()}
    def article(t):
        return " ".join(re.sub(r"<[^>]*>", " ", re.search(r"<article>(.*?)</article>", t, re.S)[1]).split())
    assert read([one]) == {0: article(one)}
    assert set(read([one] * 1000).values()) == {article(one)}
    assert read(long_) == {k: article(t) for k, t in enumerate(long_)}
    assert read(short) == {i: f"Hello {i}." for i in range(300)}
    assert read([*short[:20], one])[20] == article(one)


def test_decoding_is_the_likeliest_consistent_choice():
    """All choices of small trees, each node's log odds weighed by its own text."""
    rng = np.random.default_rng(3)
    for html_ in ("<div><p>one</p><p>two <b>x</b></p></div>", "<article><h1>t</h1><section><p>story</p></section></article><nav>m</nav>"):
        page = html_text.parse(html_)
        _, own = html_text.node_features(page)
        n = len(page.tags)
        for _ in range(10):
            p = rng.random(n)
            kept = np.array(html_text.decode(page, p, own), bool)
            weight = lambda k: float(((np.log1p(own) + 0.05) * np.log(np.where(k, p, 1 - p))).sum())  # noqa: B023, E731
            best = max(weight(np.array([bool(m >> i & 1) for i in range(n)])) for m in range(1 << n) if m & 1 and all(m >> page.parents[i] & 1 for i in range(1, n) if m >> i & 1))
            assert abs(weight(kept) - best) < 1e-9


def test_decoding_never_keeps_below_a_dropped_node():
    page = html_text.parse("<div><nav><p>kept alone?</p></nav><p>story</p></div>")
    rng = np.random.default_rng(1)
    _, own = html_text.node_features(page)
    for _ in range(50):
        kept = html_text.decode(page, rng.random(len(page.tags)), own)
        assert all(kept[page.parents[i]] for i in range(1, len(kept)) if kept[i])


def test_near_duplicates_keeps_null_ids_and_one_row_per_id_and_text(spark, sf_dir):
    rng = random.Random(11)
    a, b, c, d = (" ".join(f"w{rng.randrange(900)}" for _ in range(60)) for _ in range(4))
    near = a.replace(a.split()[30], "edit", 1)
    rows = [(None, c), (None, c), (None, None), (1, a), (1, a), (1, a), (2, near), (3, a), (3, b), (3, b), (4, None), (4, None), (5, d), (5, d + " x y z"), (6, b)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    out = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
    assert out.columns == docs.columns
    kept = min((5, d), (5, d + " x y z"), key=lambda r: int(spark.range(1).select(F.xxhash64(F.lit(r[1])).alias("h")).head().h))
    want = [(None, c), (None, c), (None, None), (1, a), (3, b), (4, None), kept]
    assert sorted((str(r.doc_id), str(r.text)) for r in out.collect()) == sorted((str(i), str(t)) for i, t in want)


def test_near_duplicates_of_ids_with_several_texts(spark, sf_dir):
    """Texts are nodes, not ids: no link is lost where an id has a second text, and no text goes for another's sake."""
    rng = random.Random(31)
    say = lambda n: " ".join(f"w{rng.randrange(9000)}" for _ in range(n))
    rows, want = [], {}
    for i in range(40):
        a, other = say(120), say(120)
        rows += [(i, a), (1000 + i, a + " extra"), (1000 + i, other)]
        want |= {(i, a): i, (1000 + i, a + " extra"): i, (1000 + i, other): 1000 + i}
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    marked = docs.withColumn("mark", F.xxhash64("text"))
    out = near_dedup.near_dedup(marked, shingle=4, mark="mark").join(marked.select("mark", "text").distinct(), "mark").collect()
    assert {(r.doc_id, r.text): r.component_id for r in out} == want and len(out) == len(rows)
    left = {(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()}
    assert left == {k for k, c in want.items() if k[0] == c}


@pytest.fixture(scope="module")
def odd_docs(spark):
    rng = random.Random(21)
    say = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    passage = say(80)
    rows = [(None, say(60)), (None, None), (1, say(70)), (1, None), (2, ""), (3, f"{passage} {say(5)}"), (3, f"{passage} {say(5)}"), (4, f"{say(5)} {passage}"), (5, passage), (6, say(9000)), (7, "  ")]
    rows += [(3, rows[5][1])] * 2
    return spark.createDataFrame([(i, t, "en", None, len(t or ""), "x", 0.5, 1, True) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, k string, score double, predicted int, contaminated boolean").repartition(4)


@pytest.mark.parametrize("stage", range(5))
def test_stages_keep_odd_rows(spark, sf_dir, odd_docs, stage):
    """Null ids and texts, repeated rows, long texts, an empty table and columns with clashing names."""
    name, run = corpus_pipeline.STAGES[stage]
    plain = sorted((str(r.doc_id), str(r.text)) for r in odd_docs.collect())
    out = run(spark, odd_docs, sf_dir)
    none = run(spark, odd_docs.limit(0), sf_dir)
    assert none.count() == 0 and none.columns == out.columns
    rows = out.collect()
    if stage < 4:
        assert out.columns == list(corpus_pipeline.COLUMNS)
        got = sorted((str(r.doc_id), str(r.text)) for r in rows)
    if stage == 0:
        assert not Counter(got) - Counter(plain)
    elif stage == 1:
        # 4 and 5 are near copies of 3; without an id nothing is a copy.
        assert got == sorted(x for x in set(plain) if x[0] not in ("4", "5"))
    elif stage == 2:
        texts = [(r.doc_id, r.text) for r in odd_docs.collect()]
        passage = next(t for d, t in texts if d == 5)
        want = Counter((str(d), str(t if d != 4 else " ".join(t.split()[:5]))) for d, t in texts if d != 5)
        assert Counter(got) == want and passage
    elif stage == 3:
        assert got == plain
    else:
        per = defaultdict(int)
        for r in rows:
            per[r.doc_id] += r.length
            assert len(r.ids) == 2 * r.length
        assert per[None] > 60 and per.keys() == {None, 1, 2, 3, 4, 5, 6, 7} and per[2] == 1


def test_pipeline(spark, sf_dir):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "MinHash near-dedup", "substring dedup", "benchmark decontamination", "packing"] and corpus_pipeline.ORACLE_SQL is None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    quality_docs = corpus_pipeline.quality(spark, docs, sf_dir).cache()
    assert quality_docs.columns == docs.columns
    kept = {r.doc_id for r in quality_docs.collect()}
    held = [d for d in labels if zlib.crc32(str(d).encode()) % 5 == 0]
    assert np.mean([(d in kept) == (labels[d] == 1) for d in held]) >= 0.9
    texts = [(r.doc_id, r.text) for r in quality_docs.collect()]
    want, _ = brute_components(texts, 5, 80)
    single = corpus_pipeline.near_duplicates(spark, quality_docs, sf_dir).cache()
    assert {r.doc_id for r in single.collect()} == {d for d, c in want.items() if d == c}
    cut = corpus_pipeline.repeated_passages(spark, single, sf_dir).cache()
    seen = set()
    for r in sorted(cut.collect(), key=lambda r: r.doc_id):
        w = SPACE.findall(r.text or "")
        own = {tuple(w[i : i + 50]) for i in range(len(w) - 49)}
        assert not own & seen
        seen |= own
    clean = corpus_pipeline.benchmark_passages(spark, cut, sf_dir).cache()
    bad = decontamination.decontaminate(cut, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated").count()
    assert clean.count() == cut.count() - bad
    packed = corpus_pipeline.packing(spark, clean, sf_dir)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in clean.collect()}
    assert corpus_pipeline.run(spark, sf_dir).count() >= clean.count()
