import collections
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from foliant.llm import common, lexical_packing, piece_codec, queries

PIECES, WORDS = queries.tokenizer("piece_bpe_32k.model"), queries.tokenizer("word_bpe_49k.json")


def noise(seed, n=3000):
    draw = random.Random(seed)
    return ["".join(draw.choice(" ab\n\t'sé漢😀\u0301\u00a0\u3000.,\x00\x1c\x85<|endoftext|>İΣ\r▁</s>") for _ in range(draw.randrange(30))) for _ in range(n)]


def library_codes(texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for t in texts:
        ids = sp.encode(t, add_eos=True)
        yield len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def test_codec_equals_library(spark, odd, none, sf):
    for df in (odd, spark.read.parquet(f"{sf}/documents.parquet"), spark.createDataFrame(list(enumerate(noise(1))), "doc_id long, text string")):
        docs = [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]
        want = collections.Counter((i, *x) for (i, _), x in zip(docs, library_codes([t for _, t in docs]), strict=True))
        assert collections.Counter(map(tuple, piece_codec.piece_codec(df, PIECES).collect())) == want
    assert piece_codec.piece_codec(none, PIECES).count() == 0


def test_codec_in_slices(spark, monkeypatch):
    monkeypatch.setattr(piece_codec, "BYTES", 50)
    texts = ["a bb  cccccc d", "dddddddd e", " a e bb", "", "one two\nthree", "trailing "] * 20
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    assert [tuple(r)[1:] for r in piece_codec.piece_codec(df, PIECES).orderBy("doc_id").collect()] == list(library_codes(texts))


def library_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    return [[*t.encode(x, add_special_tokens=False).ids, 1] for x in texts]


def test_word_ids_equal_library():
    texts = noise(2) + ["", "<|endoftext|> a<|endoftext|>b", "<|ENDOFTEXT|>", "it's 's don'ts"]
    table = lexical_packing.WordIds(WORDS)
    for part in (pa.array(texts), pa.array(["x", *texts]).slice(1)):
        ids, sizes = table.encode(part)
        cut = np.r_[0, np.cumsum(sizes)]
        assert [ids[a:b].tolist() for a, b in zip(cut, cut[1:], strict=False)] == library_ids(texts)


def test_tokenizer_gets_few_words_at_once(monkeypatch):
    """What it returns for all distinct words of a slice took more memory than the slice and the table."""
    monkeypatch.setattr(lexical_packing, "WORDS", 50)
    table, most = lexical_packing.WordIds(WORDS), []

    class Counted:
        def encode_batch_fast(self, lines, **how):
            most.append(sum(len(x.split()) for x in lines))
            return real.encode_batch_fast(lines, **how)

    real, table.tokenizer = table.tokenizer, Counted()
    draw = random.Random(5)
    words = ["".join(draw.choices("abcdefgh" + "0123" * odd, k=9)) for odd in (0, 1) for _ in range(400)]
    texts = [" ".join(words[:500]), "", " ".join(words[300:]), "\n\t "]
    ids, sizes = table.encode(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == library_ids(texts)
    assert len(most) > 10 and max(most) <= 50


def test_letters_skip_the_tokenizers_steps():
    """Lower-case words of letters need neither its normaliser nor its patterns, which took more time than the merges."""
    table, seen = lexical_packing.WordIds(WORDS), []
    full = str(table.tokenizer.normalizer)

    class Watched:
        def encode_batch_fast(self, lines, **how):
            seen.extend((w, str(self.normalizer) == full) for x in lines for w in x.split())
            return real.encode_batch_fast(lines, **how)

    real, table.tokenizer = table.tokenizer, Watched()
    table.tokenizer.normalizer = real.normalizer
    texts = ["One two, é two's x1 œuvre THREE!? naïve", "two One. Ünder x1"]
    ids, sizes = table.encode(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == library_ids(texts)
    assert sorted(w for w, whole in seen if not whole) == sorted(["one", "two", "é", "œuvre", "three", "naïve", "ünder"])
    assert sorted(w for w, whole in seen if whole) == sorted([",", "!?", ".", "two's", "x1"])


def test_words_of_every_low_character_equal_library():
    places = "{c}", "a{c}", "{c}a", "A{c}B,", "{c}{c}.", ".{c}!", "x1{c}", "{c}'s", "e\u0301{c}", "{c}\u0301"
    texts = [x.format(c=chr(c)) for c in [*range(0x250), 0x3A3, 0x1E9E, 0x2019, 0x212B, 0xFB01] for x in places]
    texts += [" ".join(texts[k : k + 50]) for k in range(0, len(texts), 50)]
    ids, sizes = lexical_packing.WordIds(WORDS).encode(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == library_ids(texts)


def test_letters_of_a_tokenizer_that_changes_them(tmp_path):
    """A normaliser that changes letters is asked for every word."""
    from tokenizers import Tokenizer, normalizers

    t = Tokenizer.from_file(WORDS)
    t.normalizer = normalizers.Sequence([normalizers.NFD(), normalizers.StripAccents(), normalizers.Lowercase()])
    t.save(str(tmp_path / "words.json"))
    ids, _ = lexical_packing.WordIds(str(tmp_path / "words.json")).encode(pa.array(["Déjà vu, naïve"]))
    assert ids.tolist() == [*t.encode("Déjà vu, naïve", add_special_tokens=False).ids, 1]
    assert ids.tolist() != library_ids(["Déjà vu, naïve"])[0]


def test_counts_of_documents():
    draw = np.random.default_rng(3)
    docs = [draw.integers(0, 90, n).astype(np.uint16) for n in (0, 1, 500, 3, 40, 2000)]
    batches = [pa.RecordBatch.from_arrays([pa.array([d.tobytes() for d in part], pa.binary())], ["ids"]) for part in (docs[:4], docs[4:])]
    (found,) = lexical_packing._counts(100)(iter(batches))
    df = np.concatenate([np.frombuffer(x, np.int64) for x in found.column("df").to_pylist()])
    assert df.tolist() == [sum(i in d for d in docs) for i in range(100)]
    assert sum(found.column("rows").to_pylist()) == 6 and sum(found.column("tokens").to_pylist()) == 2544


def test_words_that_come_again_are_encoded_once(monkeypatch):
    """A full table let all words go, those of every text too."""
    monkeypatch.setattr(lexical_packing, "TABLE_WORDS", 60)
    table, seen = lexical_packing.WordIds(WORDS), collections.Counter()

    class Counted:
        def encode_batch_fast(self, lines, **how):
            seen.update(w for x in lines for w in x.split())
            return real.encode_batch_fast(lines, **how)

    real, table.tokenizer = table.tokenizer, Counted()
    draw, often = random.Random(6), ["often", "again", "met.", "1st"]
    for _ in range(40):
        texts = [" ".join([*often, "".join(draw.choices("bcdfg", k=8))]) for _ in range(9)]
        ids, sizes = table.encode(pa.array(texts))
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == library_ids(texts)
        assert len(table.core) <= 80
    assert {w: seen[w] for w in ("often", "again", "met", "1st", ".")} == {"often": 1, "again": 1, "met": 1, "1st": 1, ".": 1}


def test_table_of_words_that_all_come_again(monkeypatch):
    """Words that would fill half the table or more don't stay for having come twice."""
    monkeypatch.setattr(lexical_packing, "TABLE_WORDS", 60)
    table, draw = lexical_packing.WordIds(WORDS), random.Random(7)
    for _ in range(12):
        words = ["".join(draw.choices("bcdfg", k=8)) for _ in range(20)]
        for texts in ([" ".join(words)], ["", " ".join(reversed(words)) + "."]):
            ids, sizes = table.encode(pa.array(texts))
            assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == library_ids(texts)
            assert len(table.core) <= 60 + 21


@pytest.mark.parametrize("n", [0, 1, 300, 70_000])
def test_index_in_order(n):
    """Pairs by term and document, and each document's heaviest terms, ties by term, for few documents and for more than 16 bits count."""
    draw = np.random.default_rng(4)
    lengths = draw.integers(1, 4 if n > 1000 else 60, n)
    ids, idf = draw.integers(0, 50, int(lengths.sum())).astype(np.uint16), draw.integers(1, 4, 50).astype(np.float32)
    index = lexical_packing.Index(ids, lengths, idf, 2.5)
    pair, tf = np.unique(ids.astype(np.int64) * max(n, 1) + np.repeat(np.arange(n), lengths), return_counts=True)
    term, doc = pair // max(n, 1), pair % max(n, 1)
    weight = (idf[term] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * lengths[doc] / 2.5))).astype(np.float32)
    assert index.doc.tolist() == doc.tolist() and np.allclose(index.weight, weight) and index.start.tolist() == np.searchsorted(term, np.arange(51)).tolist()
    order = np.lexsort((-index.weight, doc))
    by_doc = np.split(term[order], np.flatnonzero(np.diff(doc[order])) + 1) if n else []
    assert len(index.query) == n and all(q.tolist() == x[:12].tolist() for q, x in zip(index.query, by_doc, strict=True))


def test_encoding_has_small_batches(spark, monkeypatch):
    """Arrow batches follow the bytes of texts while documents are encoded, and the session is left as it was."""
    key, seen, save = "spark.sql.execution.arrow.maxBytesPerBatch", [], lexical_packing.Scratch.save
    before = spark.conf.get(key)
    monkeypatch.setattr(common, "BATCH_BYTES", 1 << 16)

    def rows_of_batches(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int64())], ["n"])

    def watched(self, df, name):
        texts = spark.range(400, numPartitions=1).selectExpr("repeat('a b ', 500) AS text")
        seen.extend(r.n for r in texts.mapInArrow(rows_of_batches, "n long").collect())
        return save(self, df, name)

    monkeypatch.setattr(lexical_packing.Scratch, "save", watched)
    assert lexical_packing.pack(spark, spark.createDataFrame([(1, "a b")], "doc_id long, text string"), WORDS).count() > 0
    assert sum(seen) == 400 and max(seen) < 60
    assert spark.conf.get(key) == before


def test_words_go_before_packing():
    common.worker_kept("words of another task", dict)
    assert list(lexical_packing._counts(4)(iter([]))) == [] and not common._kept


@pytest.mark.parametrize("which", ["odd", "table"])
def test_packing_holds_every_id_once(spark, odd, sf, which, monkeypatch):
    monkeypatch.setattr(lexical_packing, "BYTES", 20_000)
    df = odd if which == "odd" else spark.read.parquet(f"{sf}/documents.parquet")
    docs = [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]
    want = collections.Counter((i, tuple(x)) for (i, _), x in zip(docs, library_ids([t for _, t in docs]), strict=True))
    rows = lexical_packing.pack(spark, df, WORDS, with_ids=True).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        by_doc[r.doc_id, r.doc_tokens].append(r)
        by_sequence[r.sequence_id].append(r)
    if which == "table":
        assert collections.Counter((i, tuple(x for r in sorted(parts, key=lambda r: r.start) for x in r.ids)) for (i, _), parts in by_doc.items()) == want
    assert sum(r.length for r in rows) == sum(len(x) * n for (_, x), n in want.items())
    padded = 0
    for parts in by_sequence.values():
        parts.sort(key=lambda r: r.offset)
        ends = np.cumsum([r.length for r in parts])
        assert [r.offset for r in parts] == [0, *ends[:-1].tolist()] and ends[-1] <= 2048
        padded += 0 if int(ends[-1]).bit_count() == 1 else 2048 - ends[-1]
    assert padded == 0


def test_packing_follows_neighbours():
    draw = np.random.default_rng(1)
    topics = [draw.integers(100 * k, 100 * k + 60, (8, 256)) for k in range(1, 9)]
    docs = [t[i] for i in range(8) for t in topics]  # topics take turns
    ids, sizes = np.concatenate(docs), np.full(64, 256)
    df = np.bincount(np.unique(np.repeat(np.arange(64), sizes) * 1000 + ids) % 1000, minlength=1000)
    pieces = lexical_packing.pack_shard(ids, sizes, np.log1p((64 - df + 0.5) / (df + 0.5)).astype(np.float32), 256.0)
    groups = collections.defaultdict(set)
    for d, _, _, s, _ in pieces:
        groups[s].add(d % 8)
    assert len(groups) == 8 and all(len(g) == 1 for g in groups.values())


def test_packing_empty(spark, none):
    assert lexical_packing.pack(spark, none, WORDS).count() == 0
