"""Packing by lexical retrieval.

Documents are dealt to shards by the rare id that each holds most often, whatever file they come from,
so that likely neighbours meet. Shards have an inverted index each; idf and mean length cover all
documents. The next unused document is the seed of a sequence; BM25 returns its unused neighbours, then
those of the documents that were put in, which fill the window greedily; the one that doesn't fit is cut
and its rest stays in the pool. What remains of a shard becomes sequences of powers of two, so that
nothing is padded.
"""

from __future__ import annotations

import os
import re
import zlib
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from foliant.llm.common import Numbered, Scratch, fresh, mix64, ranges, shards_for, slices, small_batches, unsliced, worker_kept

WINDOW, END = 2048, 1
#: Tokens of a shard, terms of a query, BM25's constants, words that a worker's table holds, slices
#: in which the counts of terms are summed, bytes of text that are encoded at once, words that the
#: tokenizer gets at once (what it returns for a word is many times as large as the word), parts of words whose ids are gathered at once, and lines that
#: the words for the tokenizer are dealt to where a line may hold several.
SHARD_TOKENS, QUERY_TERMS, K1, B, TABLE_WORDS, SLICES, BYTES, WORDS, PARTS, LINES = 1_500_000, 12, 1.2, 0.75, 300_000, 16, 4 << 20, 5_000, 1 << 18, 10
WORD_END = "</w>"
RARE = re.compile("[\u0130\u0180-\U0010ffff]")  # what changes its length in lower case, may compose, or is seldom met
TAIL = "".join(chr(x) for x in range(33, 127) if not chr(x).isalnum())
PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordIds:
    """Ids of white-space separated words; the tokenizer drops white space and no id spans it."""

    def __init__(self, tokenizer_file: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        vocabulary = self.tokenizer.get_vocab()
        self.terms = max(vocabulary.values()) + 1
        if self.terms > 1 << 16:
            raise ValueError("ids of more than 16 bits")
        self.last = np.zeros(self.terms, bool)  # ids that end a run of letters
        self.last[[i for piece, i in vocabulary.items() if piece.endswith(WORD_END)]] = True
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.mark = os.path.commonprefix(self.special)
        self.steps = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        self.quick = self._quick_steps()
        self._clear()

    def _clear(self) -> None:
        self.core = Numbered({"": 0})
        self.starts, self.lengths, self.flat = np.zeros(1, np.int32), np.zeros(1, np.int32), np.zeros(0, np.uint16)
        self.slices = np.zeros(1, np.int32)  # of text that had each core

    def _forget(self) -> None:
        """Leaves half a table at most: the cores that came again, in the most slices since the last time."""
        least = 2
        while np.count_nonzero(self.slices >= least) > TABLE_WORDS // 2:
            least *= 2
        keep = 1 + np.flatnonzero(self.slices[1:] >= least)  # behind the empty core
        cores, starts, lengths, flat = list(self.core), self.starts[keep], self.lengths[keep], self.flat
        self._clear()
        for k in keep.tolist():
            self.core[cores[k]]
        self._add(flat[ranges(starts, lengths)], lengths)

    def _add(self, coded: np.ndarray, lengths: np.ndarray) -> None:
        self.starts = np.append(self.starts, (len(self.flat) + np.cumsum(lengths) - lengths).astype(np.int32))
        self.lengths = np.append(self.lengths, lengths.astype(np.int32))
        self.flat = np.append(self.flat, coded.astype(np.uint16))
        self.slices = np.append(self.slices, np.zeros(len(lengths), np.int32))

    def _coded(self, lines: list[str], at_once: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the lines one after the other, and each line's number of ids."""
        ids, sizes = [np.zeros(0, np.uint16)], [np.zeros(0, np.int64)]
        for k in range(0, len(lines), at_once):
            coded = [x.ids for x in self.tokenizer.encode_batch_fast(lines[k : k + at_once], add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, coded), np.int64, len(coded)))
            ids.append(np.fromiter(chain.from_iterable(coded), np.uint16, int(sizes[-1].sum())))
        return np.concatenate(ids), np.concatenate(sizes)

    def _lines(self, words: list[str], steps: tuple) -> np.ndarray:
        """Ids of the words, many in a line, with these steps before the merges."""
        many = max(1, WORDS // LINES)
        self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = steps
        try:
            return self._coded([" ".join(words[k : k + many]) for k in range(0, len(words), many)], LINES)[0]
        finally:
            self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = self.steps

    def _letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of lower-case words of letters below U+0180, and each word's number of ids."""
        ids = self._lines(words, self.quick)
        sizes = np.diff(np.r_[0, np.flatnonzero(self.last[ids]) + 1])
        if len(sizes) != len(words):
            raise ValueError("this tokenizer doesn't mark the ends of words")
        return ids, sizes

    def _quick_steps(self) -> tuple:
        """Steps before the merges that do for lower-case words of letters: these are normal already and hold no
        border but spaces. The tokenizer's own steps if it says otherwise of any letter."""
        from tokenizers import normalizers, pre_tokenizers

        quick = normalizers.Sequence([]), pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        letters = [c for c in map(chr, range(0x180)) if c.isalpha() and c == c.lower()]
        probe = ["".join(letters), *(w for c in letters for w in (c, f"a{c}", f"{c}{c}e"))]
        return quick if np.array_equal(self._lines(probe, quick), self._lines(probe, self.steps)) else self.steps

    def _numbers(self, column: pa.Array) -> tuple[np.ndarray, list[str]]:
        """The number of each core of the column, and those that are new to the table."""
        coded, known = column.dictionary_encode(), len(self.core)
        cores = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        number = np.fromiter(map(self.core.__getitem__, cores), np.int32, len(cores))
        return number[coded.indices.to_numpy()], list(islice(self.core, known, None))

    def _parts(self, words: pa.Array) -> np.ndarray:
        """Numbers of each word's body and tail. The body, in lower case, and the punctuation behind it
        are tokens of their own, so that each is encoded once, bodies of letters alone many at a time."""
        if len(self.core) > TABLE_WORDS:
            self._forget()
        low = pc.utf8_lower(words)
        body = pc.ascii_rtrim(low, characters=TAIL)
        common = pc.string_is_ascii(words).to_numpy(zero_copy_only=False).copy()
        far = np.flatnonzero(~common)
        common[far] = ~pc.match_substring_regex(words.take(pa.array(far)), RARE.pattern).to_numpy(zero_copy_only=False)
        letters = common & pc.utf8_is_alpha(body).to_numpy(zero_copy_only=False)
        parts = np.zeros((len(words), 2), np.int32)  # 0 is the empty core
        parts[letters, 0], fresh = self._numbers(body.filter(pa.array(letters)))
        self._add(*self._letters(fresh))
        ends = np.where(letters, pc.binary_length(low).to_numpy() - pc.binary_length(body).to_numpy(), 0)
        tailed = np.flatnonzero(ends)
        sizes, stops = ends[tailed], np.frombuffer(low.buffers()[1], np.int64, len(low) + 1)[tailed + 1]
        tails = np.frombuffer(low.buffers()[2] or b"", np.uint8)[ranges(stops - sizes, sizes)]
        cut = np.r_[0, np.cumsum(sizes)].astype(np.int64)
        parts[tailed, 1], fresh = self._numbers(pa.Array.from_buffers(pa.large_string(), len(tailed), [None, pa.py_buffer(cut), pa.py_buffer(tails)]))
        self._add(*self._coded(fresh, WORDS))
        odd, bodies, tails = np.flatnonzero(~letters), [], []
        for w in words.take(pa.array(odd)).to_numpy(zero_copy_only=False).tolist():
            b = "" if RARE.search(w) else w.lower().rstrip(TAIL)
            whole = not b or not b[-1].isalnum() or (self.mark in w.lower() and any(x in w.lower() for x in self.special))
            bodies.append(w if whole else b)
            tails.append("" if whole else w[len(b) :])
        numbers, fresh = self._numbers(pa.array(bodies + tails, pa.large_string()))
        parts[odd] = numbers.reshape(2, -1).T
        self._add(*self._coded(fresh, WORDS))
        there = np.zeros(len(self.core), bool)
        there[parts] = True
        self.slices += there
        return parts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, END behind each, and each text's number of ids."""
        line = unsliced(texts).cast(pa.large_string()).fill_null("")
        for space in "\n\t":
            line = pc.replace_substring(line, space, " ")
        split = pc.split_pattern(line, " ")
        coded = split.flatten().dictionary_encode()
        parts = self._parts(coded.dictionary)
        k = parts[coded.indices.to_numpy()].ravel()
        lengths = self.lengths[k]
        upto = np.r_[0, np.cumsum(lengths)]
        cut = 2 * np.r_[0, np.cumsum(split.value_lengths().to_numpy())]
        sizes = np.diff(upto[cut]) + 1
        ids = np.full(int(sizes.sum()), END, np.uint16)
        inner = np.ones(len(ids), bool)
        inner[np.cumsum(sizes) - 1] = False
        parts = [slice(at, at + PARTS) for at in range(0, len(k), PARTS)]
        ids[inner] = np.concatenate([np.zeros(0, np.uint16), *[self.flat[ranges(self.starts[k[x]], lengths[x])] for x in parts]])
        return ids, sizes


def rare_ids(ids: np.ndarray, sizes: np.ndarray, least: int) -> np.ndarray:
    """Of each document the id from least on that it holds most often, the largest one of several; -1 without any."""
    doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    some = ids >= least
    pair, count = np.unique(doc[some].astype(np.int64) << 16 | ids[some], return_counts=True)
    order = np.lexsort((pair, count, pair >> 16))
    last = np.flatnonzero(np.diff(np.append(pair[order] >> 16, -1)))
    found = np.full(len(sizes), -1, np.int32)
    found[pair[order[last]] >> 16] = pair[order[last]] & 0xFFFF
    return found


def _encoded(tokenizer_file: str, doc_id: str):
    def run(batches):
        table, serial = worker_kept(tokenizer_file, lambda: WordIds(tokenizer_file)), TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, 1, BYTES):
                ids, sizes = table.encode(part.column(1))
                cut = np.r_[0, np.cumsum(2 * sizes)].astype(np.int32)
                blobs = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(cut), pa.py_buffer(ids)])
                spread = (mix64(np.arange(serial, serial + len(sizes), dtype=np.uint64)) >> np.uint64(33)).astype(np.int32)
                serial += len(sizes)
                yield pa.RecordBatch.from_arrays([part.column(0), blobs, pa.array(rare_ids(ids, sizes, table.terms // 4)), pa.array(spread)], [doc_id, "ids", "topic", "spread"])

    return run


def _counts(terms: int):
    def run(batches):
        df, rows, tokens = np.zeros(terms, np.int64), 0, 0
        last, place = np.zeros(terms, np.int32), np.zeros(0, np.int32)
        for batch in fresh(batches):
            for blob in batch.column(0).to_numpy(zero_copy_only=False).tolist():
                ids = np.frombuffer(blob, np.uint16).astype(np.intp)
                if len(ids) > len(place):
                    place = np.arange(2 * len(ids), dtype=np.int32)
                at = place[: len(ids)]
                last[ids] = at
                df[ids[last[ids] == at]] += 1  # one place of each id
                rows, tokens = rows + 1, tokens + len(ids)
        if rows:
            blobs = [x.tobytes() for x in np.array_split(df, SLICES)]
            once = lambda x: pa.array([x] + [0] * (SLICES - 1), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(blobs, pa.binary()), once(rows), once(tokens)], ["slice", "df", "rows", "tokens"])

    return run


def _summed(table: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(x, np.int64) for x in table.column("df").to_pylist()], axis=0)
    add = lambda name: pa.array([sum(table.column(name).to_pylist())], pa.int64())
    return pa.table({"slice": table.column("slice").slice(0, 1), "df": pa.array([total.tobytes()], pa.binary()), "rows": add("rows"), "tokens": add("tokens")})


def term_statistics(encoded: DataFrame, terms: int) -> tuple[np.ndarray, float, int]:
    """idf of each id, mean length and number of tokens over all rows of encoded(ids): as many numbers as the vocabulary has."""
    schema = "slice int, df binary, rows long, tokens long"
    parts = encoded.select("ids").mapInArrow(_counts(terms), schema).groupBy("slice").applyInArrow(_summed, schema).collect()
    df = np.concatenate([np.frombuffer(r.df, np.int64) for r in sorted(parts, key=lambda r: r.slice)]) if parts else np.zeros(terms, np.int64)
    n, tokens = sum(r.rows for r in parts), sum(r.tokens for r in parts)
    return np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32), tokens / max(n, 1), tokens


def _halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lower and upper 16 bits of 32."""
    return x.astype(np.uint16), (x >> np.uint32(16)).astype(np.uint16)


class Index:
    """BM25's inverted index of a shard: weights of documents by term, and each document's heaviest terms."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, idf: np.ndarray, mean: float) -> None:
        n, bits = len(lengths), len(lengths).bit_length()
        kind = np.uint32 if bits <= 16 else np.uint64
        pair, tf = np.unique(ids.astype(kind) << kind(bits) | np.repeat(np.arange(n, dtype=kind), lengths), return_counts=True)
        term, self.doc = (pair >> kind(bits)).astype(np.int64), (pair & kind((1 << bits) - 1)).astype(np.int32)
        self.weight = (idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[self.doc] / mean))).astype(np.float32)
        self.start = np.searchsorted(term, np.arange(len(idf) + 1))
        # by document, the heaviest first: weights aren't negative, so that their bits are in order, and 16 bits are sorted by counting
        order = np.lexsort((*_halves(~self.weight.view(np.uint32)), *_halves(self.doc.view(np.uint32))))
        cut = np.searchsorted(self.doc[order], np.arange(n + 1))
        top = np.minimum(np.diff(cut), QUERY_TERMS)
        self.query = np.split(term[order[ranges(cut[:-1], top)]], np.cumsum(top)[:-1]) if n else []
        self.size = n

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents that share a query term of the seed, the best first; ties in order of place."""
        spans = [slice(self.start[t], self.start[t + 1]) for t in self.query[seed].tolist()]
        if not spans:
            return np.zeros(0, np.int64)
        docs = np.concatenate([self.doc[s] for s in spans])
        score = np.bincount(docs, np.concatenate([self.weight[s] for s in spans]), self.size)
        found = np.flatnonzero((score > 0) & unused)
        return found[np.argsort(-score[found], kind="stable")]


def pack_shard(ids: np.ndarray, sizes: np.ndarray, idf: np.ndarray, mean: float):
    """(document, start, length, sequence, offset) of each piece of the shard's documents."""
    first = np.cumsum(sizes) - sizes
    out, sequence = [], 0
    for d in np.flatnonzero(sizes >= WINDOW).tolist():
        for start in range(0, int(sizes[d]) - WINDOW + 1, WINDOW):
            out.append((d, start, WINDOW, sequence, 0))
            sequence += 1
    begin = (sizes // WINDOW) * WINDOW
    left = sizes - begin
    pool = np.flatnonzero(left)
    if not len(pool):
        return out
    begin, left = begin[pool], left[pool]
    index = Index(ids[ranges(first[pool] + begin, left)], left, idf, mean)
    unused = np.ones(len(pool), bool)
    total, next_ = int(left.sum()), 0

    def rest():  # unused documents in order of place
        nonlocal next_
        while next_ < len(pool):
            if unused[next_]:
                yield next_
            else:
                next_ += 1

    while total:
        size = room = min(WINDOW, 1 << (total.bit_length() - 1))
        seed = next(rest())
        queue, k = [seed], 0
        placed, asked = [], 0
        while room:
            if k == len(queue):
                if asked < len(placed):  # the neighbours of the seed, then of each that was put in
                    queue, k, asked = index.neighbours(placed[asked], unused).tolist(), 0, asked + 1
                else:
                    queue, k = [next(rest())], 0
                continue
            d, k = queue[k], k + 1
            if not unused[d]:
                continue
            placed.append(d)
            take = min(room, int(left[d]))
            out.append((int(pool[d]), int(begin[d]), take, sequence, size - room))
            begin[d] += take
            left[d] -= take
            room -= take
            unused[d] = left[d] > 0
        total -= size
        sequence += 1
    return out


def pack(spark: SparkSession, docs: DataFrame, tokenizer_file: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of all rows of docs: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids.

    A null text counts as empty: it has the end id alone. Texts of more than a window are cut into
    whole windows first; a text of any length is encoded whole. Rows that repeat are packed each; documents
    with equal scores follow in the order in which they reach the shard; an empty table gives no piece;
    columns other than the id and the text are left out, whatever their names. Shards are runs of
    SHARD_TOKENS ids of documents in order of their topics, a topic of very many documents in several of
    them by chance. They share nothing but the statistics, so that they pack side by side. Ids are
    written to the shared folder once, for the statistics and for packing."""
    kind = docs.schema[doc_id].dataType.simpleString()
    encoded = docs.select(doc_id, text).mapInArrow(_encoded(tokenizer_file, doc_id), f"`{doc_id}` {kind}, ids binary, topic int, spread int")
    with small_batches(spark):
        encoded = Scratch(spark).save(encoded, "ids")
        idf, mean, tokens = term_statistics(encoded, WordIds(tokenizer_file).terms)
    dealt = encoded.repartitionByRange(shards_for(tokens, SHARD_TOKENS), "topic", "spread").select(doc_id, "ids")
    shared = spark.sparkContext.broadcast((idf, mean))
    names = [doc_id, *(x.split()[0] for x in PIECES.split(", ")), *["ids"] * with_ids]

    def run(batches):
        weights, average = shared.value
        sequence, held, size = TaskContext.get().partitionId() << 40, [], 0

        def packed():
            nonlocal sequence
            keys = pa.concat_arrays([k for k, _ in held])
            docs_ids = [np.frombuffer(x, np.uint16) for _, blobs in held for x in blobs]
            ids, sizes = np.concatenate(docs_ids), np.fromiter(map(len, docs_ids), np.int64, len(docs_ids))
            pieces = np.array(pack_shard(ids, sizes, weights, average), np.int64).reshape(-1, 5)
            doc, start, length = pieces[:, 0], pieces[:, 1], pieces[:, 2]
            at = (np.cumsum(sizes) - sizes)[doc] + start
            raw = ids.astype("<u4")
            crc = [zlib.crc32(raw[a : a + n]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
            columns = [keys.take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(sizes[doc]), pa.array(pieces[:, 3] + sequence), pa.array(pieces[:, 4])]
            if with_ids:
                cut = np.r_[0, np.cumsum(length)].astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(cut), pa.array(ids[ranges(at, length)].astype(np.int32))))
            sequence += int(pieces[:, 3].max()) + 1
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in fresh(batches):  # the words that a worker keeps for encoding go before it packs
            blobs, at = batch.column(1).to_pylist(), 0
            for i, x in enumerate(blobs):
                size += len(x) // 2
                if size >= SHARD_TOKENS or i == len(blobs) - 1:
                    held.append((batch.column(0).slice(at, i + 1 - at), blobs[at : i + 1]))
                    at = i + 1
                if size >= SHARD_TOKENS:
                    yield packed()
                    held, size = [], 0
        if held:
            yield packed()

    return dealt.mapInArrow(run, f"`{doc_id}` {kind}, {PIECES}" + ", ids array<int>" * with_ids)
