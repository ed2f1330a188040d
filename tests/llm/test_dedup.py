import collections
import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from foliant.llm import bloom_dedup, simhash_links, suffix_dedup
from foliant.llm import common, queries


def texts(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


# ---- exact


def test_exact_odd(spark, odd, none):
    got = bloom_dedup.exact_dedup(spark, odd)
    assert got.columns[:4] == ["doc_id", "text", "lang", "source"]
    rows = got.collect()
    assert len(rows) == odd.count() and sum(r.kept for r in rows) == 7
    by = collections.defaultdict(list)
    for r in rows:
        assert r.text_sha256 == hashlib.sha256(re.sub("[\x20\x09-\x0d]+", " ", r.text or "").encode()).hexdigest()
        by[r.text_sha256].append(r)
    for group in by.values():
        ids = [r.doc_id for r in group if r.doc_id is not None]
        assert {r.keep_id for r in group} == {min(ids)} and {r.group_size for r in group} == {len(group)}
        assert [r.doc_id for r in group if r.kept] == [min(ids)]
    assert bloom_dedup.exact_dedup(spark, none).count() == 0


def test_exact_keeps_every_column(spark):
    docs = spark.createDataFrame([(1, "a", "k1", True, 5, "x"), (2, "a", "k2", False, 6, "y"), (2, "a", "k3", False, 7, "z")], "doc_id long, text string, key string, __maybe boolean, __nth int, __Key string")
    got = bloom_dedup.exact_dedup(spark, docs).select(*docs.columns, "kept").collect()
    assert sorted(map(tuple, got)) == [(1, "a", "k1", True, 5, "x", True), (2, "a", "k2", False, 6, "y", False), (2, "a", "k3", False, 7, "z", False)]


def test_bloom_has_no_false_negatives(spark):
    keys = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 5000)
    df = spark.createDataFrame([(int(k),) for k in np.r_[keys, keys[:300]]], "key long").repartition(7)
    ranges, bits = bloom_dedup.planes_for(df.count())
    plane = bloom_dedup.repeated_plane(df, bits)
    assert ranges == 1
    at = bloom_dedup.probes(keys, bits)
    hit = ((plane[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)
    assert hit[:300].all() and hit[300:].mean() < 0.05


# ---- SimHash


def reference_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h)) if h else 0


def brute_components(ids, fps):
    f = np.array(fps, np.uint64)
    a, b = np.nonzero(np.triu(np.bitwise_count(f[:, None] ^ f[None, :]) <= 3, 1))
    label = common.roots(len(f), a, b)
    least = {}
    for i, k in zip(ids, label.tolist(), strict=True):
        least[k] = min([x for x in (least.get(k), i) if x is not None], default=None)
    return [least[k] for k in label.tolist()]


@pytest.mark.parametrize(("which", "block"), [("odd", 250_000), ("table", 250_000), ("table", 20), ("table", 3)])
def test_simhash_equals_brute_force(spark, odd, sf, which, block, monkeypatch):
    monkeypatch.setattr(simhash_links, "BLOCK", block)
    df = odd if which == "odd" else spark.read.parquet(f"{sf}/documents.parquet")
    docs = texts(df)
    fps = [reference_fingerprint(t) for _, t in docs]
    want = sorted((repr(i), f"{f:016x}", c) for (i, _), f, c in zip(docs, fps, brute_components([i for i, _ in docs], fps), strict=True))
    got = sorted((repr(r.doc_id), r.fingerprint, r.component_id) for r in simhash_links.simhash_components(spark, df).collect())
    assert got == want


def test_simhash_empty(spark, none):
    assert simhash_links.simhash_components(spark, none).count() == 0


@pytest.mark.parametrize(("words", "radius", "spread"), [(1, 3, 5), (8, 85, 95)])
def test_forest_loses_no_link(words, radius, spread):
    draw = np.random.default_rng(words)
    base = draw.integers(0, 1 << 63, (150, words)).astype(np.uint64)
    near = np.repeat(base, 4, axis=0)
    for row in near:
        for _ in range(draw.integers(0, spread)):
            row[draw.integers(0, words)] ^= np.uint64(1) << np.uint64(draw.integers(0, 64))
    fps = np.unique(np.concatenate([base, near]), axis=0)
    shard = np.sort(draw.integers(0, 3, len(fps)))
    apart = np.bitwise_count(fps[:, None] ^ fps[None, :]).sum(axis=2)
    a, b = np.nonzero((apart <= radius) & (shard[:, None] == shard[None, :]))
    assert (simhash_links.Forest(shard, fps, radius).linked() == common.roots(len(fps), a, b)).all()


def test_near_dedup_catches_copies_and_keeps_the_rest(spark):
    draw = np.random.default_rng(3)
    word = lambda: "".join(chr(97 + c) for c in draw.integers(0, 26, 7))
    rows = []
    for k in range(60):
        words = [word() for _ in range(300)]
        rows.append((2 * k, " ".join(words)))
        if k % 2 == 0:
            for at in draw.integers(0, 300, 4):
                words[at] = word()
            rows.append((2 * k + 1, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash_links.near_dedup(spark, df).collect()) == [2 * k for k in range(60)]


def test_near_dedup_compares_sets(spark):
    """A line that a document repeats counts once; a copy that repeats it otherwise is still a copy."""
    draw = np.random.default_rng(4)
    words = lambda n: " ".join("".join(chr(97 + c) for c in draw.integers(0, 26, 7)) for _ in range(n))
    line, other, own = words(17), words(17), words(300)
    rows = [(k, f"{words(300)} " + f"{line} " * 20) for k in range(8)] + [(8, f"{own} {other}"), (9, f"{own} " + f"{other} " * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash_links.near_dedup(spark, df).collect()) == list(range(9))


@pytest.mark.parametrize("rows", [20_000, 1_000_000, 64_000_000])
@pytest.mark.parametrize(("shared", "least"), [(267, 0.93), (276, 0.97), (285, 0.99)])  # of 300: 0.80, 0.85, 0.90
def test_copy_fingerprints_find_pairs(rows, shared, least):
    """Bands and radius together, at any number of rows."""
    draw, bands, found = np.random.default_rng(6), simhash_links.copy_bands(rows), 0
    for _ in range(500):
        h = draw.integers(0, 1 << 63, 600 - shared).astype(np.uint64) << np.uint64(1)
        a, b = (np.frombuffer(simhash_links.fingerprint(x, simhash_links.COPY_WORDS), np.uint8) for x in (h[:300], h[300 - shared :]))
        apart = np.unpackbits(a ^ b)
        found += apart.sum() <= simhash_links.COPY_RADIUS and any(not apart[at].any() for at in bands)
    assert found >= least * 500


def test_distances_per_copy_stay_flat(monkeypatch):
    """A band's shards hold as many strangers at any number of rows."""
    draw, each = np.random.default_rng(7), []
    for rows in (20_000, 80_000, 320_000):
        bits = draw.integers(0, 2, (rows, 256), dtype=np.uint8)
        at = simhash_links.copy_bands(rows)[0]
        sizes = np.bincount(bits[:, at] @ (1 << np.arange(len(at))))
        each.append((sizes * (sizes - 1)).sum() / rows)
    assert max(each) <= 2.2 * simhash_links.STRANGERS and max(each) < 2.5 * min(each)


@pytest.mark.parametrize("rows", [1_000, 1 << 30, 1 << 34, 1 << 40])
def test_exact_bands_lose_no_link(rows):
    draw, bands = np.random.default_rng(9), simhash_links.exact_bands(rows)
    for _ in range(2000):
        flipped = draw.choice(64, 3, replace=False)
        assert any(not np.isin(flipped, at).any() for at in bands)


def test_few_rows_shuffle_beyond_one_plane(spark, monkeypatch):
    """With planes for 32,768 rows each: hardly more rows than those that repeat are held to be repeated."""
    monkeypatch.setattr(bloom_dedup, "MOST_BITS", 1 << 19)
    assert bloom_dedup.planes_for(100_000) == (4, 1 << 19)
    docs = spark.range(100_000).selectExpr("id AS doc_id", "CAST(IF(id % 10 = 0, id % 1000, id) AS string) AS text").repartition(3)
    tested, real = [], bloom_dedup._tested
    monkeypatch.setattr(bloom_dedup, "_tested", lambda *a: tested.append(real(*a)) or tested[-1])
    got = bloom_dedup.exact_dedup(spark, docs)
    want = {str(k) for k in range(100_000) if k % 10 or k < 1000}
    assert got.count() == 100_000 and {r.text for r in got.where("kept").collect()} == want
    assert len(tested) == 4 and 10_000 <= sum(t.where("__maybe").count() for t in tested) <= 10_000 + 0.05 * 90_000


def test_near_dedup_goes_by_rows_where_ids_repeat(spark):
    words = " ".join(f"w{n}" for n in range(40))
    rows = [(3, words), (5, words + " more"), (5, "a text of its own that nothing else is like"), (6, words), (6, words), (None, words)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'s' AS own_set", "1 AS h", "2 AS g")
    got = sorted(map(repr, map(tuple, simhash_links.near_dedup(spark, docs).collect())))
    assert got == sorted(repr((*r, "s", 1, 2)) for r in (rows[0], rows[2], rows[5]))


@pytest.mark.parametrize("block", [2_000_000, 300])
def test_near_dedup_equals_brute_force(spark, block, monkeypatch):
    """Groups whose members aren't all similar, in one block and in several."""
    monkeypatch.setattr(simhash_links, "SET_BLOCK", block)
    draw, rows = np.random.default_rng(8), []
    word = lambda: "".join(chr(97 + c) for c in draw.integers(0, 26, 7))
    for _ in range(8):
        base = [word() for _ in range(200)]
        for changes in (0, 1, 2, 3, 4, 6, 8, 10):
            text = list(base)
            for at in draw.integers(0, 200, changes):
                text[at] = word()
            rows.append((len(rows), " ".join(text)))
    sets = [{" ".join(t.split()[i : i + 5]) for i in range(196)} for _, t in rows]
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    label = common.roots(len(sets), *np.array(pairs).T)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash_links.near_dedup(spark, df).collect()) == sorted(set(label.tolist()))


def test_components(spark):
    draw = np.random.default_rng(5)
    a, b = draw.integers(0, 400, 300), draw.integers(0, 400, 300)
    hub = [(1000, k) for k in range(1001, 1200)] + [(k, k + 1) for k in range(2000, 2100)]
    pairs = list(zip(a.tolist(), b.tolist(), strict=True)) + hub
    df = spark.createDataFrame(pairs, "a long, b long")
    got = {r.node: r.root for r in common.components(spark, common.Scratch(spark), df).collect()}
    x, y = np.array(pairs).T
    label = common.roots(2200, x, y)
    assert got == {i: int(label[i]) for i in range(2200) if (label == label[i]).sum() > 1 and label[i] != i}


# ---- suffix arrays


def brute_removed(docs):
    count = collections.Counter(x[i : i + 200] for x in docs for i in range(len(x) - 199))
    for x in docs:
        flags = np.zeros(len(x), bool)
        for i in range(len(x) - 199):
            if count[x[i : i + 200]] > 1:
                flags[i : i + 200] = True
        starts = int((np.diff(np.r_[0, flags.astype(int)]) == 1).sum())
        yield len(x), int(flags.sum()), starts, np.frombuffer(x, np.uint8)[~flags].tobytes()


@pytest.mark.parametrize("most", [suffix_dedup.GROUP_BYTES, 800])
def test_suffix_dedup_equals_brute_force(spark, odd, sf, most, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", most)
    draw = np.random.default_rng(1)
    passage = bytes(draw.integers(97, 123, 700)).decode()
    extra = [(100, "x" * 450, None, None), (101, "ab" * 300, None, None), (102, passage, None, None), (103, "left " + passage[100:600] + " right", None, None), (104, passage[:199], None, None), (105, "é" * 130, None, None)]
    small = odd.where("doc_id <> 4 OR doc_id IS NULL").select("doc_id", "text", "lang", "source")
    df = small.union(spark.createDataFrame(extra, small.schema)).union(spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id + 1000", "text", "lang", "source"))
    docs = texts(df)
    want = sorted((repr(i), *x) for (i, _), x in zip(docs, brute_removed([t.encode() for _, t in docs]), strict=True))
    got = sorted((repr(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(spark, df).collect())
    assert got == want


def test_suffix_dedup_odd(spark, odd, none):
    got = suffix_dedup.remove_repeats(spark, odd).collect()
    assert len(got) == odd.count() and {r.n_removed for r in got if r.doc_id == 4} == {150_000}
    assert suffix_dedup.remove_repeats(spark, none).count() == 0
    kept = suffix_dedup.without_repeats(spark, odd.withColumn("n_chars", odd.doc_id))
    assert kept.count() == odd.count() and kept.columns == [*odd.columns, "n_chars"]


def test_cuts_go_by_characters_and_leave_others(spark):
    passage = "ä" * 99 + "é漢" + "".join(chr(0x4E00 + n) for n in range(80))
    rows = [(1, f"keep \ufffd me {passage} and \ufffd me"), (2, f"{passage}"), (3, "短 \ufffd"), (4, None), (5, "ы" + passage[1:] + "ь")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.lit(0))
    got = {r.doc_id: (r.text, r.n_chars) for r in suffix_dedup.without_repeats(spark, docs).collect()}
    assert got == {1: ("keep \ufffd me  and \ufffd me", 19), 2: ("", 0), 3: (rows[2][1], 3), 4: (None, 0), 5: ("ыь", 2)}
    assert suffix_dedup._whole_characters("aéb".encode(), [2], [4]) == ([1], [4]) and suffix_dedup._whole_characters("é漢".encode(), [1, 3], [2, 4]) == ([0], [5])


@pytest.mark.parametrize("most", [suffix_dedup.SHARD_BYTES, 3000, 900, 1])
def test_groups_of_several_arrays(most, monkeypatch):
    """Repeats within an array, between two of them, and of a segment with itself, at every size of arrays."""
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", most)
    draw = np.random.default_rng(3)
    pool = [bytes(draw.integers(97, 100, n).astype(np.uint8)) for n in (220, 260, 400, 199)]
    noise = lambda: bytes(draw.integers(97, 123, int(draw.integers(0, 300))).astype(np.uint8))
    segments = [noise() + pool[draw.integers(4)] + noise() + pool[draw.integers(4)] + noise() for _ in range(24)]
    segments[5] = b"x" * 700
    group = np.repeat([0, 1], 12)
    window = suffix_dedup.WINDOW
    for g in (0, 1):
        mine = [k for k in range(24) if group[k] == g]
        count = collections.Counter(segments[k][i : i + window] for k in mine for i in range(len(segments[k]) - window + 1))
        got = suffix_dedup.shard_repeats(group, segments)
        for k in mine:
            assert got[k].tolist() == [count[segments[k][i : i + window]] > 1 for i in range(len(segments[k]) - window + 1)]


def test_blocks_of_a_hot_anchor(spark, monkeypatch):
    """Thousands of distinct segments around one passage, some of which share windows across blocks; columns of any name stay."""
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", 1 << 18)
    draw = np.random.default_rng(3)
    word = lambda n: bytes(draw.integers(97, 123, n).astype(np.uint8)).decode()
    core = word(150)
    rows = [(k, word(60) + core + word(60)) for k in range(4_000)]
    rows += [(4_000 + k, word(30) + rows[k * 37][1][20:250] + word(30)) for k in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS __row", "1 AS r")
    want = sorted((k, *x) for (k, _), x in zip(rows, brute_removed([t.encode() for _, t in rows]), strict=True))
    out = suffix_dedup.remove_repeats(spark, df)
    assert out.columns == ["doc_id", "text", "__row", "r", "n_bytes", "n_removed", "n_spans", "kept"]
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out.collect()) == want
    assert sum(x[2] > 0 for x in want) == 200


def test_long_text_in_pieces():
    draw = np.random.default_rng(2)
    x = bytes(draw.integers(97, 100, 1_300_000).astype(np.uint8))
    which, _, first, last = suffix_dedup.anchors([x])
    assert (which == 0).all() and np.array_equal(np.sort(common.ranges(first, last - first + 1)), np.arange(len(x) - 199))


def test_suffix_array():
    draw = np.random.default_rng(4)
    for _ in range(200):
        s = [*draw.integers(1, 4, draw.integers(1, 60)).tolist(), 0]
        sa = suffix_dedup.suffix_array(s, 4)
        assert sa == sorted(range(len(s)), key=lambda i: s[i:])
        plcp = suffix_dedup.permuted_common_prefixes(s, sa)
        for a, b in zip(sa, sa[1:], strict=False):
            k = plcp[b]
            assert s[a : a + k] == s[b : b + k] and s[a + k] != s[b + k]


def test_queries_keep_every_row(spark, sf):
    for name in ("op3_simhash_links", "op7_bloom_dedup", "op8_suffix_dedup"):
        assert queries.QUERIES[name](spark, sf).count() == 200


