"""SentencePiece encoding and decoding by a distinct-chunk table.

No piece of the model has anything but white-space markers before a marker, so that no merge
crosses from a word into the marker after it. A text therefore falls into chunks, each a run of
markers and the word behind it; a task segments every distinct chunk of its texts once and joins
ids and decoded text back by position.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from foliant.llm.common import Numbered, slices, unsliced

CHUNK = re.compile("[ ▁]*[^ ▁]+|[ ▁]+")
#: Bytes of text whose distinct chunks are segmented at once.
BYTES = 8 << 20
SCHEMA = "n_tokens long, ids_sha256 string, decoded_sha256 string"


class Codec:
    """Encodes and decodes texts by their distinct chunks."""

    def __init__(self, model_file: str) -> None:
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = self.sp.get_piece_size()
        if any(re.search("[^▁]▁", self.sp.id_to_piece(i)) for i in range(size)):
            raise ValueError("pieces of this model cross white-space markers")
        self.marker, self.end = self.sp.piece_to_id("▁"), str(self.sp.eos_id())
        if self.marker == self.sp.unk_id():
            raise ValueError("this model has no piece for a lone marker")
        self.decimal = list(map(str, range(size)))

    def table(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of ids, ids as decimal text, and decoded text of chunks without their first marker, which the
        library puts before every text that it encodes and leaves out when it decodes."""
        coded = [x or [self.marker] for x in self.sp.encode(chunks, num_threads=1)]  # a lone marker at a text's end
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        ids, back = np.empty(len(coded), object), np.empty(len(coded), object)
        decimal = self.decimal.__getitem__
        ids[:] = [" ".join(map(decimal, x)) for x in coded]
        back[:] = [" " + x for x in self.sp.decode(coded)] if coded else []
        return sizes, ids, back

    def run(self, texts: pa.Array) -> list[tuple[int, str, str]]:
        """Number of ids with the end id, ids as decimal text, and decoded text, of each text."""
        line = unsliced(texts).cast(pa.large_string()).fill_null("")
        plain = pc.invert(pc.match_substring_regex(line, "^$|^ | $|  |▁"))
        out: list = [None] * len(line)
        # most texts have single spaces between words and nowhere else: Arrow splits them
        at = np.flatnonzero(plain.to_numpy(zero_copy_only=False))
        split = pc.split_pattern(line.filter(plain), " ")
        words = split.flatten().dictionary_encode()
        self._join(out, at.tolist(), words.dictionary.to_pylist(), words.indices.to_numpy(), split.value_lengths().to_numpy())
        rest = np.flatnonzero(~plain.to_numpy(zero_copy_only=False)).tolist()
        number, index, counts = Numbered(), [], []
        for i in rest:
            x = line[i].as_py()
            chunks = CHUNK.findall(" " + x if x else "")
            index += [number[c[1:]] for c in chunks]
            counts.append(len(chunks))
        self._join(out, rest, list(number), np.array(index, np.int64), np.array(counts, np.int64))
        return out

    def _join(self, out: list, places: list[int], chunks: list[str], index: np.ndarray, counts: np.ndarray) -> None:
        sizes, ids, back = self.table(chunks)
        cut = np.r_[0, np.cumsum(counts)].tolist()
        for i, a, b in zip(places, cut, cut[1:], strict=False):
            k = index[a:b]
            out[i] = (int(sizes[k].sum()) + 1, " ".join([*ids[k].tolist(), self.end]), "".join(back[k].tolist())[1:])


def piece_codec(docs: DataFrame, model_file: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row's whole text.

    Equal to encoding the whole text with the library, an end id only and no sampling, and decoding
    the ids. A null text counts as empty (its only id is the end id). Repeated rows, null ids and
    ties each give their own row; other columns are left out. A task holds the distinct chunks of
    BYTES of text, or of one text that is longer."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        codec = Codec(model_file)
        for batch in batches:
            for part in slices(batch, 1, BYTES):
                rows = codec.run(part.column(1))
                sums = [[hashlib.sha256(r[k].encode()).hexdigest() for r in rows] for k in (1, 2)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r[0] for r in rows], pa.int64()), *(pa.array(x, pa.string()) for x in sums)], [doc_id, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {kind}, {SCHEMA}")
