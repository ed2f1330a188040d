"""Suffix-array dedup: bytes that lie in a string of WINDOW bytes which also starts elsewhere go.

Every window has an anchor: the gram with the smallest hash among those inside it. Equal windows have
equal anchors at equal places, so that windows whose anchor's hash occurs once can't repeat. The
windows around the anchors that do repeat are cut out as segments, equal segments become one, and the
segments of an anchor's hash meet in a block, or in several where they are many. A block's suffix array
is built by induced sorting, and the permuted common prefixes of neighbouring suffixes tell which
windows repeat in it; blocks of one hash then compare the windows that each of them has.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import Scratch, column_bytes, fresh, mix64, ranges, shards_for, slices, small_batches, whole

WINDOW, GRAM = 200, 40
#: Bytes whose anchors are found at once, bytes of a shard's suffix array, bytes of segments that a
#: task of shards gets, and bytes of text that a task has in hand.
BLOCK, SHARD_BYTES, TASK_BYTES, BATCH_BYTES = 1 << 19, 1 << 19, 4 << 20, 4 << 20
#: Bytes of the segments of one anchor's hash that meet in a block.
GROUP_BYTES = 4 << 20
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_OTHER_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


# ---- anchors


def _hashes(data: np.ndarray, length: int, other: bool = False) -> np.ndarray:
    """A 64-bit hash of the length bytes at each place, put together from powers of two; other gives a second one."""
    a, h, w, whole, at = np.uint64(0xAEF17502108EF2D9 if other else 0x9FB21C651E98DF25), (_OTHER_BYTES if other else _BYTES)[data], 1, None, 0
    n = len(data) - length + 1
    while True:
        if length & w:
            whole = h[:n] if whole is None else whole * a + h[at : at + n]
            at += w
        if 2 * w > length:
            return mix64(whole)
        h = h[:-w] * a + h[w:]
        h ^= h >> np.uint64(29)
        w *= 2


def _window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    m, w = keys, 1
    while 2 * w <= width:
        m, w = np.minimum(m[:-w], m[w:]), 2 * w
    return np.minimum(m[: len(m) - (width - w)], m[width - w :]) if width > w else m


def _block_anchors(data: np.ndarray, ends: np.ndarray):
    """hash of the anchor, first and last window of each run of windows with one anchor. data is the
    texts one after the other, ends their ends; windows don't cross from text to text."""
    hashes = _hashes(data, GRAM)
    places = np.uint64(BLOCK * 4 - 1)
    low = _window_minima((hashes & ~places) | np.arange(len(hashes), dtype=np.uint64), WINDOW - GRAM + 1)
    starts = np.r_[0, ends[:-1]]
    at = ranges(starts, np.maximum(ends - starts - WINDOW + 1, 0))
    low = low[at]
    cut = np.flatnonzero(np.r_[True, (low[1:] != low[:-1]) | (at[1:] != at[:-1] + 1)])
    last = np.r_[cut[1:], len(at)] - 1
    return hashes[(low[cut] & places).astype(np.int64)], at[cut], at[last]


def anchors(texts: list[bytes]):
    """(text, hash, first window, last window) of every run of windows with one anchor."""
    out = []
    long_enough = [i for i, x in enumerate(texts) if len(x) >= WINDOW]
    at = 0
    while at < len(long_enough):
        block, size = [], 0
        while at < len(long_enough) and (not block or size + len(texts[long_enough[at]]) <= BLOCK):
            block.append(long_enough[at])
            size += len(texts[block[-1]])
            at += 1
        if size <= 2 * BLOCK:
            pieces = [(block, 0, b"".join(texts[i] for i in block), np.cumsum([len(texts[i]) for i in block]))]
        else:  # one long text: pieces overlap by a window less a byte
            x = texts[block[0]]
            pieces = [(block, p, x[p : p + BLOCK + WINDOW - 1], None) for p in range(0, len(x) - WINDOW + 1, BLOCK)]
        for members, offset, raw, ends in pieces:
            ends = np.array([len(raw)]) if ends is None else ends
            h, first, last = _block_anchors(np.frombuffer(raw, np.uint8), ends)
            which = np.searchsorted(ends, first, side="right")
            base = np.r_[0, ends[:-1]][which] - offset
            out.append((np.array(members)[which], h, first - base, last - base))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none, none
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


# ---- induced sorting


def suffix_array(s: list[int], alphabet: int) -> list[int]:
    """Suffix array of s, whose last symbol is 0 and occurs only there; symbols are below alphabet."""
    n = len(s)
    if n == 1:
        return [0]
    # classify: a suffix is smaller (S) or larger (L) than the one behind it
    small = bytearray(n)
    small[-1] = 1
    for i in range(n - 2, -1, -1):
        a, b = s[i], s[i + 1]
        if a < b or (a == b and small[i + 1]):
            small[i] = 1
    lms = [i for i in range(1, n) if small[i] and not small[i - 1]]
    sizes = [0] * alphabet
    for c in s:
        sizes[c] += 1

    def induce(order: list[int]) -> list[int]:
        sa = [-1] * n
        tail, total = [0] * alphabet, 0
        for c in range(alphabet):
            total += sizes[c]
            tail[c] = total
        head = [t - k for t, k in zip(tail, sizes, strict=True)]
        end = tail[:]
        for i in reversed(order):
            c = s[i]
            end[c] -= 1
            sa[end[c]] = i
        for i in range(n):  # larger suffixes from the heads
            j = sa[i] - 1
            if j >= 0 and not small[j]:
                c = s[j]
                sa[head[c]] = j
                head[c] += 1
        for i in range(n - 1, -1, -1):  # smaller ones from the tails
            j = sa[i] - 1
            if j >= 0 and small[j]:
                c = s[j]
                tail[c] -= 1
                sa[tail[c]] = j
        return sa

    sa = induce(lms)
    # name leftmost-smaller substrings in their order
    following = dict(zip(lms, lms[1:] + [n], strict=True))
    name, names, last = -1, {}, None
    for i in sa:
        if i > 0 and small[i] and not small[i - 1]:
            if last is None or s[last : following[last] + 1] != s[i : following[i] + 1]:
                name += 1
            names[i] = name
            last = i
    if name + 1 < len(lms):
        inner = suffix_array([names[i] for i in lms], name + 1)
        order = [lms[k] for k in inner]
    else:
        order = sorted(lms, key=names.__getitem__)
    return induce(order)


def permuted_common_prefixes(s: list[int], sa: list[int]) -> list[int]:
    """For each place of s the length that its suffix shares with the one before it in the array."""
    n = len(s)
    before, plcp, k = [-1] * n, [0] * n, 0
    for a, b in zip(sa, sa[1:], strict=False):
        before[b] = a
    for i in range(n):
        j = before[i]
        if j < 0:
            k = 0
            continue
        while s[i + k] == s[j + k]:
            k += 1
        plcp[i] = k
        if k:
            k -= 1
    return plcp


def repeated_windows(segments: list[bytes], least: int = WINDOW) -> list[np.ndarray]:
    """For each segment, whether the window at each of its places also starts elsewhere in the segments.

    Each segment holds least - 1 bytes more than it has windows of its own. The segments are ended by
    symbols that occur once, so that no common prefix runs from one into the next."""
    m = len(segments)
    s: list[int] = []
    own = []
    for k, x in enumerate(segments):
        own.append(np.arange(len(s), len(s) + max(0, len(x) - least + 1)))
        s += (np.frombuffer(x, np.uint8).astype(np.int64) + m + 1).tolist()
        s.append(k + 1)
    s.append(0)
    sa = suffix_array(s, m + 257)
    plcp = np.array(permuted_common_prefixes(s, sa), np.int64)
    order = np.array(sa, np.int64)
    mine = np.zeros(len(s), bool)
    mine[np.concatenate(own)] = True
    lcp = plcp[order]
    at = np.flatnonzero(mine[order])
    hit = np.zeros(len(s), bool)
    if len(at) > 1:
        # what neighbours share is the least of the prefixes between them
        shared = np.minimum.reduceat(lcp[: at[-1] + 1], at[:-1] + 1)
        near = np.flatnonzero(shared >= least)
        hit[order[at[near]]] = hit[order[at[near + 1]]] = True
    return [hit[x] for x in own]


# ---- the operator


def _anchor_rows(batches):
    for batch in (part for full in fresh(batches) for part in slices(full, 2, BATCH_BYTES)):
        texts, r, q = column_bytes(batch.column(2)), *(batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        which, h, first, last = anchors(texts)
        digest = xxhash.xxh3_64_intdigest
        seg = [digest(texts[i][a : b + WINDOW]) for i, a, b in zip(which.tolist(), first.tolist(), last.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.array(seg, np.uint64).view(np.int64)), pa.array(r[which]), pa.array(q[which]), pa.array(first.astype(np.int32)), pa.array((last - first + 1).astype(np.int32))], ["h", "seg", "r", "q", "first", "windows"])


def _cut_rows(batches):
    """(h, seg, block, copies, many, bytes) of the segments that each text is asked for."""
    for batch in (part for full in fresh(batches) for part in slices(full, 0, BATCH_BYTES)):
        out = [(p["h"], p["seg"], p["block"], p["copies"], p["many"], x[p["first"] : p["first"] + p["windows"] + WINDOW - 1]) for x, asked in zip(column_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True) for p in asked]
        for at in range(0, len(out), 20_000):
            h, seg, block, copies, many, raw = zip(*out[at : at + 20_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(seg, pa.int64()), pa.array(block, pa.int32()), pa.array(copies, pa.int64()), pa.array(many, pa.bool_()), pa.array(raw, pa.binary())], ["h", "seg", "block", "copies", "many", "bytes"])


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.r_[0, flags.astype(np.int8), 0]))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def shard_repeats(group: np.ndarray, segments: list[bytes]) -> list[np.ndarray]:
    """For each segment, whether each of its windows is also in another place of its group's segments.

    Windows whose hash is alone in the group can't repeat: what is left of each segment is cut to the
    runs of the others, equal runs become one, and suffix arrays of SHARD_BYTES settle the rest. A group of more has
    several arrays; what two of them share is told by 128-bit hashes, as it is between blocks."""
    sizes = np.array([len(x) for x in segments], np.int64)
    first = np.cumsum(sizes) - sizes
    windows = np.maximum(sizes - WINDOW + 1, 0)
    hits = [np.zeros(n, bool) for n in windows.tolist()]
    hashes = _hashes(np.frombuffer(b"".join(segments), np.uint8), WINDOW)[ranges(first, windows)]
    key = hashes ^ mix64(np.repeat(group, windows).astype(np.int64).view(np.uint64))
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    maybe = count[inverse] > 1
    runs: dict[tuple[int, bytes], list[tuple[int, int]]] = {}
    at = np.cumsum(windows) - windows
    for k, g in enumerate(group.tolist()):
        flags = maybe[at[k] : at[k] + windows[k]]
        if flags.any():
            for a, b in _runs(flags):
                runs.setdefault((g, segments[k][a : b + WINDOW - 1]), []).append((k, a))
    by_group: dict[int, list[tuple[int, bytes]]] = {}
    for place in runs:
        by_group.setdefault(place[0], []).append(place)
    shard, held = [], 0

    def settle(places: list[tuple[int, bytes]]) -> None:
        for place, flags in zip(places, repeated_windows([x for _, x in places]), strict=True):
            for k, a in runs[place]:
                hits[k][a : a + len(flags)] |= flags

    def across(parts: list[list[tuple[int, bytes]]]) -> None:
        own = [own_windows([x for _, x in part]) for part in parts]
        of, w, v = np.repeat(np.arange(len(parts)), [len(x[0]) for x in own]), *(np.concatenate([x[n] for x in own]) for n in (2, 3))
        order = np.lexsort((v, w))
        same = (w[order[1:]] == w[order[:-1]]) & (v[order[1:]] == v[order[:-1]])
        shared = np.zeros(len(of), bool)
        shared[order[1:][same]] = shared[order[:-1][same]] = True
        segment, place = (np.concatenate([x[n] for x in own]) for n in (0, 1))
        for n in np.flatnonzero(shared).tolist():
            for k, a in runs[parts[of[n]][segment[n]]]:
                hits[k][a + place[n]] = True

    for places in by_group.values():
        for place in places:
            if len(runs[place]) > 1:
                for k, a in runs[place]:
                    hits[k][a : a + len(place[1]) - WINDOW + 1] = True
        parts = _in_parts(places)
        if len(parts) > 1:
            for part in parts:
                settle(part)
            across(parts)
        elif len(places) > 1:
            shard += places
            held += sum(len(x) for _, x in places)
        if held >= SHARD_BYTES:
            settle(shard)
            shard, held = [], 0
    if shard:
        settle(shard)
    return hits


def _in_parts(places: list[tuple[int, bytes]]) -> list[list[tuple[int, bytes]]]:
    """Runs in parts of SHARD_BYTES, or of one longer run."""
    parts, held = [[]], 0
    for place in places:
        if parts[-1] and held + len(place[1]) > SHARD_BYTES:
            parts.append([])
            held = 0
        parts[-1].append(place)
        held += len(place[1])
    return parts


def own_windows(segments: list[bytes]) -> tuple[np.ndarray, ...]:
    """Segment, place and 128-bit hash (two numbers) of every distinct window of the segments, at its first place."""
    sizes = np.array([len(x) for x in segments], np.int64)
    first, windows = np.cumsum(sizes) - sizes, np.maximum(sizes - WINDOW + 1, 0)
    data, at = np.frombuffer(b"".join(segments), np.uint8), ranges(first, windows)
    w, v = _hashes(data, WINDOW)[at], _hashes(data, WINDOW, other=True)[at]
    order = np.lexsort((v, w))
    new = np.r_[True, (w[order[1:]] != w[order[:-1]]) | (v[order[1:]] != v[order[:-1]])] if len(order) else np.zeros(0, bool)
    kept = np.sort(order[new])
    segment = np.repeat(np.arange(len(segments)), windows)[kept]
    return segment, at[kept] - first[segment], w[kept].view(np.int64), v[kept].view(np.int64)


def _shard_rows(batches):
    """(h, seg, copies, runs) tells which windows of a segment repeat in its block; where a hash has several blocks,
    (h, seg, copies, at, w, v) tells place and hash of each window that the block has."""
    table = whole(fresh(batches))  # TASK_BYTES or so
    if table is None:
        return
    h, seg, block, copies, many = (table.column(k).to_numpy(zero_copy_only=False) for k in ("h", "seg", "block", "copies", "many"))
    raw = table.column("bytes").to_pylist()
    order = np.lexsort((seg, block, h))
    group = np.cumsum(np.r_[False, (h[order[1:]] != h[order[:-1]]) | (block[order[1:]] != block[order[:-1]])])
    names = ["h", "seg", "copies", "runs", "at", "w", "v"]
    no = lambda kind, n: pa.nulls(n, kind)
    at = 0
    while at < len(order):  # whole groups of about TASK_BYTES
        to, held = at, 0
        while to < len(order) and (held < TASK_BYTES or group[to] == group[to - 1]):
            held, to = held + len(raw[order[to]]), to + 1
        part, of = order[at:to], group[at:to]
        hits = shard_repeats(of, [raw[i] for i in part.tolist()])
        found = [[x for run in _runs(flags) for x in run] for flags in hits]
        some = [k for k, x in enumerate(found) if x and copies[part[k]] == 1]
        mine, n = part[some], len(some)
        runs = pa.array([found[k] for k in some], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array(h[mine]), pa.array(seg[mine]), pa.array(copies[mine]), runs, no(pa.int32(), n), no(pa.int64(), n), no(pa.int64(), n)], names)
        for g in np.unique(of[many[part]]).tolist():
            mine = part[of == g]
            which, places, w, v = own_windows([raw[i] for i in mine.tolist()])
            mine, n = mine[which], len(which)
            yield pa.RecordBatch.from_arrays([pa.array(h[mine]), pa.array(seg[mine]), pa.array(copies[mine]), no(runs.type, n), pa.array(places, pa.int32()), pa.array(w), pa.array(v)], names)
        at = to


def _across_blocks(scratch: Scratch, settled: DataFrame) -> DataFrame:
    """(h, seg, runs) of windows that several blocks of a hash have."""
    windows = settled.where("at IS NOT NULL").select("h", "seg", "copies", "at", "w", "v")
    again = scratch.save(windows.groupBy("w", "v").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("w", "v"), "shared_windows")
    hits = windows.where("copies = 1").join(again, ["w", "v"]).groupBy("h", "seg").agg(F.collect_list("at").alias("at"))
    return hits.select("h", "seg", F.flatten(F.transform("at", lambda a: F.array(a, a + 1))).alias("runs"))


def _whole_characters(x: bytes, begins: list[int], ends: list[int]) -> tuple[list[int], list[int]]:
    """Cuts widened to the bounds of the UTF-8 characters that they split; cuts that then overlap become one."""
    firsts, lasts = [], []
    for a, b in zip(begins, ends, strict=True):
        while a > 0 and x[a] & 0xC0 == 0x80:
            a -= 1
        while b < len(x) and x[b] & 0xC0 == 0x80:
            b += 1
        if lasts and a <= lasts[-1]:
            lasts[-1] = b
        else:
            firsts.append(a)
            lasts.append(b)
    return firsts, lasts


def _remove(characters: bool):
    def run(batches):
        for batch in (part for full in fresh(batches) for part in slices(full, 1, BATCH_BYTES)):
            sizes, removed, spans, kept = [], [], [], []
            for x, parts in zip(column_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                sizes.append(len(x))
                if not parts:
                    removed.append(0)
                    spans.append(0)
                    kept.append(x)
                    continue
                flat = np.array([(p["first"] + a, p["first"] + b + WINDOW - 1) for p in parts for a, b in zip(p["runs"][::2], p["runs"][1::2], strict=True)], np.int64)
                flat = flat[np.argsort(flat[:, 0], kind="stable")]
                reach = np.maximum.accumulate(flat[:, 1])
                cut = np.flatnonzero(np.r_[True, flat[1:, 0] > reach[:-1]])
                begins, ends = flat[cut, 0].tolist(), reach[np.r_[cut[1:] - 1, len(flat) - 1]].tolist()
                if characters:
                    begins, ends = _whole_characters(x, begins, ends)
                kept.append(b"".join(x[a:b] for a, b in zip([0, *ends], [*begins, len(x)], strict=True)))
                removed.append(len(x) - len(kept[-1]))
                spans.append(len(begins))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], ["kept_row", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def remove_repeats(spark: SparkSession, docs: DataFrame, characters: bool = False) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans and kept (the remaining bytes), a row for each row. If characters is set,
    characters that a cut would split go as a whole.

    A null text counts as empty. Texts shorter than WINDOW bytes lose nothing; texts that come twice,
    repeated rows among them, lose all of their bytes; long texts are read whole, in pieces. Null and
    repeated ids change nothing, since rows go by 128-bit hashes of id and text together. An empty table
    gives an empty result. Columns of docs named like the results are replaced, all others stay."""
    scratch = Scratch(spark)
    names = [c for c in docs.columns if c not in ("n_bytes", "n_removed", "n_spans", "kept")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("kept_row"), "text", F.xxhash64("doc_id", "text").alias("r"), F.xxhash64(F.lit(1), "text", "doc_id").alias("q"))
    found = rows.select("r", "q", "text").mapInArrow(_anchor_rows, "h long, seg long, r long, q long, first int, windows int")
    with small_batches(spark):
        found = scratch.save(found, "anchors")
    # written first, here and below: a join of two plain shuffles is one that Spark splits where a passage is hot
    again = scratch.save(found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "again")
    found = scratch.save(found.join(again, "h"), "repeated")
    scratch.drop("anchors")

    # one place for each distinct segment; a hot passage is counted before the shuffle
    place = F.min(F.struct("r", "q", "first", "windows")).alias("place")
    distinct = scratch.save(found.groupBy("h", "seg").agg(F.count(F.lit(1)).alias("copies"), place), "segments")
    size = F.col("place.windows").cast("long") + (WINDOW - 1)
    mixed = distinct.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("copies").alias("least"), F.sum(size).alias("size")).where("n > 1 AND least = 1")
    mixed = scratch.save(mixed.selectExpr("h", "size", f"CAST(ceil(size / {GROUP_BYTES}) AS int) AS blocks"), "mixed")
    block = F.expr("CAST(pmod(seg, blocks) AS int)").alias("block")
    asked = distinct.join(mixed, "h").select("place.r", "place.q", F.struct("h", "seg", block, "copies", (F.col("blocks") > 1).alias("many"), "place.first", "place.windows").alias("p"))
    # repeated rows have one key: their texts are equal, so that one of them is enough
    asked = scratch.save(asked.groupBy("r", "q").agg(F.collect_list("p").alias("asked")), "asked")
    cut = rows.select("r", "q", "text").join(asked, ["r", "q"]).select("text", "asked").mapInArrow(_cut_rows, "h long, seg long, block int, copies long, many boolean, bytes binary")
    shards = shards_for(mixed.agg(F.sum("size")).first()[0] or 0, TASK_BYTES)
    settled = cut.repartition(shards, "h", "block").mapInArrow(_shard_rows, "h long, seg long, copies long, runs array<int>, at int, w long, v long")
    with small_batches(spark):
        settled = scratch.save(settled, "settled")
    runs = settled.where("runs IS NOT NULL").select("h", "seg", "runs")
    if not mixed.where("blocks > 1").isEmpty():
        runs = runs.union(scratch.save(_across_blocks(scratch, settled), "across"))

    copied = distinct.where("copies > 1").select("h", "seg", F.array(F.lit(0), F.col("place.windows")).alias("runs"))
    hits = found.select("h", "seg", "r", "q", "first").join(copied.union(runs), ["h", "seg"])
    spans = hits.groupBy("r", "q").agg(F.collect_set(F.struct("first", "runs")).alias("spans"))
    joined = rows.join(scratch.save(spans, "spans"), ["r", "q"], "left")
    schema = "kept_row " + rows.schema["kept_row"].dataType.simpleString() + ", n_bytes long, n_removed long, n_spans long, kept binary"
    out = joined.select("kept_row", "text", "spans").mapInArrow(_remove(characters), schema)
    return out.select("kept_row.*", "n_bytes", "n_removed", "n_spans", "kept")


def without_repeats(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with what is left of their texts; characters that a cut splits go with it, all others stay, U+FFFD among
    them. Null texts stay null, repeated rows and null ids keep their rows, an empty table stays empty, other columns
    stay as they are; n_chars is counted anew."""
    out = remove_repeats(spark, docs, characters=True)
    text = F.when(F.col("text").isNull() | (F.col("n_removed") == 0), F.col("text")).otherwise(F.col("kept").cast("string"))
    out = out.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
w AS (SELECT doc_id, p, md5(substring(h, 2 * p + 1, 400)) AS k FROM (SELECT doc_id, h, unnest(range(n - 199)) AS p FROM d WHERE n >= 200)),
t AS (SELECT doc_id, p FROM w QUALIFY count(*) OVER (PARTITION BY k) > 1),
b AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM t),
i AS (SELECT doc_id, p, sum(CASE WHEN q IS NULL OR p > q + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM b),
r AS (SELECT doc_id, g, min(p) AS a, max(p) + 200 AS z FROM i GROUP BY ALL),
s AS (SELECT doc_id, h, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS y FROM r JOIN d USING (doc_id)),
k AS (SELECT doc_id, string_agg(substring(h, 2 * y + 1, 2 * (a - y)), '' ORDER BY a) || substring(any_value(h), 2 * max(z) + 1) AS rest, sum(z - a)::BIGINT AS gone, count(*) AS runs FROM s GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(runs, 0) AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""
