"""Sum-of-squares packing of tokenised documents into fixed-length sequences.

A document becomes its token ids plus an end id.  Only a document longer than the capacity is cut, into
full pieces of ``capacity`` ids; its first piece takes what is over and may be shorter.  Full pieces fill a
sequence of their own; all other pieces are dealt evenly into buckets of at most ``bucket_rows`` pieces and
each bucket is packed, longest pieces first, by the sum-of-squares rule: of the open sequences that can hold it,
a piece goes to the one with which the sum over all gap sizes of the squared number of open sequences with that
gap becomes smallest; a new sequence is opened when none can hold it.

Defined cases: null text counts as empty (its only id is the end id); repeated rows and repeated or null
doc_ids are packed row by row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.llm.common import batch_of
from gridlake.session import write_table

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

#: Classes of bytes: ASCII white space, ASCII letters, other visible ASCII, bytes of longer characters, controls.
SPACE, LETTER, MARK, HIGH, CONTROL = range(5)
CLASSES = np.full(256, CONTROL, np.uint8)
CLASSES[128:], CLASSES[33:127], CLASSES[[9, 10, 11, 12, 13, 32]] = HIGH, MARK, SPACE
CLASSES[65:91] = CLASSES[97:123] = LETTER
#: Longer white-space characters, as the number that their last three bytes make (of two bytes: the last two).
LONG_SPACES = np.array([int.from_bytes(chr(c).encode()) for c in (0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)])

#: A word whatever the version of Unicode: letters of the Latin, Greek and Cyrillic blocks after a space or none.
WORD = "^ ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0391-\u03a1\u03a3-\u03ce\u0400-\u0481\u048a-\u052f]+$"
#: The byte-level letter of every byte, in UTF-8: visible ones stand for themselves, the others for letters from 256 on.
#: A tab stands for the space between words.
LETTERS = np.zeros((256, 2), np.uint8)
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
for _k, _byte in enumerate([*_SHOWN, *(b for b in range(256) if b not in _SHOWN)]):
    _letter = chr(_byte if _k < len(_SHOWN) else 256 + _k - len(_SHOWN)).encode()
    LETTERS[_byte, :len(_letter)] = list(_letter)
LETTERS[9] = 32, 0


class WordEncoder:
    """Token ids of texts, as the ``tokenizers`` library gives them for a byte-level BPE vocabulary.

    Texts are taken together, as many as ``limit`` bytes hold (at least one), and cut where the vocabulary's
    pre-tokeniser always starts a new token, whatever stands around: before a run of white space, around letters next to digits
    or marks (not behind an apostrophe), after a single line feed before a letter.  Each distinct part goes to the
    library once: words (letters after a space or none) by many straight to the vocabulary's BPE model, all others
    one by one to the whole tokeniser.  Parts stay known until more than ``most`` are.
    A text with one of the special tokens spelled out is one part.
    """

    def __init__(self, vocabulary: str, limit: int = 2 << 20, most: int = 200_000):
        import public_tokenizers
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        path = vocabulary if os.path.isabs(vocabulary) else public_tokenizers.path(vocabulary)
        self.tokenizer = Tokenizer.from_file(path)
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = CharDelimiterSplit(" ")
        vocab = self.tokenizer.get_vocab()
        self.known, self.ids, self.counts = pa.array([], pa.string()), np.empty(0, "<u4"), np.empty(0, np.int64)
        self.feed = vocab["\u010a"]
        self.begins = np.zeros(max(vocab.values()) + 1, bool)
        self.begins[[i for t, i in vocab.items() if t[0] == "\u0120" or i == self.feed]] = True
        self.limit, self.most = limit, most
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _cuts(self, texts: pa.StringArray, at: np.ndarray, raw: np.ndarray) -> np.ndarray:
        """Where the parts of all texts begin; ``at``: bounds of the texts in their bytes ``raw``."""
        kind = CLASSES[raw]
        space, letter, mark = kind == SPACE, kind == LETTER, kind == MARK
        solid = letter | mark
        before = np.flatnonzero(space[1:] & (kind[:-1] == HIGH))
        if len(before):
            two = raw[before - 1].astype(np.int64) << 8 | raw[before]
            three = raw[before - 2].astype(np.int64) << 16 | two
            solid[before] = ~(np.isin(two, LONG_SPACES) | np.isin(three, LONG_SPACES))
        cut = np.zeros(len(raw), bool)
        cut[at[:-1][at[1:] > at[:-1]]] = True
        cut[1:] |= (space[1:] & solid[:-1]) | (mark[1:] & letter[:-1])
        cut[1:] |= letter[1:] & ((mark & (raw != 39)) | (cut & (raw == 10)))[:-1]
        for token in self.special:
            for k in np.flatnonzero(pc.match_substring(texts, token).to_numpy(zero_copy_only=False)).tolist():
                cut[at[k] + 1:at[k + 1]] = False
        return np.flatnonzero(cut)

    @staticmethod
    def _ids(tokenizer, texts: list[str], together: int) -> Iterator[list[int]]:
        """Ids of every text; the library's result, many times their size, is kept for so many texts only."""
        for k in range(0, len(texts), together):
            yield from (e.ids for e in tokenizer.encode_batch_fast(texts[k:k + together], add_special_tokens=False))

    def _words(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words on end and the number of each word's.  A line of words, in byte-level letters, is one piece of
        work for the library; a word begins at the id of a token with a space's letter, or behind that of a line feed."""
        line = 256
        bounds = np.append(np.arange(0, len(words), line), len(words)).astype(np.int32)
        marked = pc.replace_substring_regex(words, "^([^ ])", "\n\t\\1")
        lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds), marked), "\t")
        at = np.frombuffer(lines.buffers()[1], np.int32)[:len(lines) + 1]
        raw = np.frombuffer(lines.buffers()[2] or b"", np.uint8)[:at[-1]]
        at = np.concatenate([[0], np.cumsum(1 + (LETTERS[raw, 1] > 0))])[at].astype(np.int32)
        letters = LETTERS[raw].reshape(-1)
        lines = pa.StringArray.from_buffers(len(lines), pa.py_buffer(at), pa.py_buffer(letters[letters > 0])).to_pylist()
        ids = np.fromiter(chain.from_iterable(self._ids(self.words, lines, 32)), "<u4")
        own, real = np.cumsum(self.begins[ids]) - 1, ids != self.feed
        return ids[real], np.bincount(own[real], minlength=len(words))

    def _places(self, kinds: pa.StringArray) -> np.ndarray:
        """Places of different parts among the known ones, after the new ones have joined them."""
        if len(self.known) > self.most:
            self.known, self.ids, self.counts = self.known[:0], self.ids[:0], self.counts[:0]
        found = pc.index_in(kinds, self.known)
        new = kinds.filter(found.is_null())
        word = pc.match_substring_regex(new, WORD)
        words, others = new.filter(word), new.filter(pc.invert(word))
        ids, counts = self._words(words)
        odd = list(self._ids(self.tokenizer, others.to_pylist(), 4096))
        word = word.to_numpy(zero_copy_only=False)
        place = np.where(word, np.cumsum(word) - 1, len(words) + np.cumsum(~word) - 1) + len(self.known)
        out = found.fill_null(-1).to_numpy().astype(np.int64)
        out[out < 0] = place
        self.known = pa.concat_arrays([self.known, words, others])
        self.ids = np.concatenate([self.ids, ids, np.fromiter(chain.from_iterable(odd), "<u4")])
        self.counts = np.concatenate([self.counts, counts, np.array([len(x) for x in odd], np.int64)])
        return out

    def encode(self, texts: pa.Array, end: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by the ids ``end``, and where each text's ids end."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        _, bounds, data = texts.buffers()
        at = np.frombuffer(bounds, np.int32)[texts.offset:texts.offset + len(texts) + 1]
        raw = np.frombuffer(data or b"", np.uint8)[at[0]:at[-1]]
        at = at - at[0]
        cuts = self._cuts(texts, at, raw)
        until = pa.py_buffer(np.append(cuts, len(raw)).astype(np.int32))
        parts = pa.StringArray.from_buffers(len(cuts), until, pa.py_buffer(raw)).dictionary_encode()
        places = self._places(parts.dictionary)
        ids, counts = np.concatenate([self.ids, np.array(end, "<u4")]), np.append(self.counts, len(end))
        first = np.cumsum(counts) - counts
        ends = np.searchsorted(cuts, at[1:])
        row = np.insert(places[parts.indices.to_numpy()], ends, len(counts) - 1)
        n = counts[row]
        until = np.cumsum(n)
        return ids[np.repeat(first[row] - until + n, n) + np.arange(n.sum())], until[ends + np.arange(len(ends))]

    def together(self, batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
        """Slices of a batch with at most ``limit`` bytes of text, or one row."""
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        k = 0
        while k < batch.num_rows:
            until = max(k + 1, int(np.searchsorted(size, (size[k - 1] if k else 0) + self.limit, "right")))
            yield batch.slice(k, until - k)
            k = until

    def __call__(self, text: str) -> bytes:
        return self.encode(pa.array([text], pa.string()))[0].tobytes()


def _spans(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``total`` ids."""
    first = total % capacity or min(total, capacity)
    cuts = [0, *range(first, total + 1, capacity)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def token_pieces(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", capacity: int = 1024, end_id: int = 2,
                 with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and the ids themselves on request."""
    def cut(encoder: WordEncoder, batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, ids = [], []
        every, ends = encoder.encode(batch.column(1), (end_id,))
        at = 0
        for doc_id, until in zip(batch.column(0).to_pylist(), ends.tolist(), strict=True):
            for k, (start, length) in enumerate(_spans(until - at, capacity)):
                own = every[at + start:at + start + length]
                rows.append((doc_id, k, start, length, zlib.crc32(own)))
                if with_ids:
                    ids.append(own.astype(np.int32))
            at = until
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        names = ("doc_id", "piece", "start", "length", "ids_crc32")
        out = {n: ([r[i] for r in rows], t) for i, (n, t) in enumerate(zip(names, kinds, strict=True))}
        return batch_of(out | ({"ids": (ids, pa.list_(pa.int32()))} if with_ids else {}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(vocabulary)  # the task's: an idle worker holds no vocabulary while other stages run
        for batch in batches:
            for part in encoder.together(batch, 1):
                yield cut(encoder, part)

    schema = PIECES + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, schema)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of every length, placed in the given order.  Among equal sums the smallest gap wins.

    With N[g] open bins of gap g, moving a piece of s from gap g to gap g - s changes the sum of squares by
    2 * (N[g - s] - N[g]) + 2, or by 1 - 2 * N[g] if that fills the bin; full bins are not counted.
    """
    opened = np.zeros(capacity + 1, np.int64)
    bins_of: list[list[int]] = [[] for _ in range(capacity + 1)]
    fill: list[int] = []
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    never = np.iinfo(np.int64).max
    for i, s in enumerate(lengths.tolist()):
        here = opened[s:capacity]
        change = np.where(here > 0, 2 * (opened[:capacity - s] - here) + 2, never)
        if len(change) and here[0] > 0:
            change[0] = 1 - 2 * here[0]
        best = int(change.argmin()) if len(change) else 0
        if len(change) and change[best] < never:
            gap = s + best
            b = bins_of[gap].pop()
            opened[gap] -= 1
        else:
            gap, b = capacity, len(fill)
            fill.append(0)
        where[i], offset[i] = b, fill[b]
        fill[b] += s
        if gap > s:
            opened[gap - s] += 1
            bins_of[gap - s].append(b)
    return where, offset


def pack(pieces: DataFrame, capacity: int = 1024, bucket_rows: int = 50_000) -> DataFrame:
    """``pieces`` (with a ``length`` of 1 to ``capacity``) plus sequence_id and offset.

    A bucket is one task's work: at most about ``bucket_rows`` rows of a few numbers, dealt at random.  What
    the rule leaves open at a bucket's end is a few sequences, so more buckets cost next to nothing.
    """
    stored = write_table(pieces, "pieces")
    whole = F.col("length") == capacity
    buckets = max(1, -(-stored.where(~whole).count() // bucket_rows))

    def place(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "_order"], ascending=[False, True]).reset_index(drop=True)
        where, offset = sum_of_squares(frame["length"].to_numpy(), capacity)
        frame["sequence_id"] = (int(frame["_bucket"].iloc[0]) << 32) + where
        frame["offset"] = offset
        return frame.drop(columns=["_bucket", "_order"])

    row = F.monotonically_increasing_id()
    full = stored.where(whole).withColumns({"sequence_id": -1 - row, "offset": F.lit(0).cast("long")})
    rest = (stored.where(~whole).withColumn("_order", F.xxhash64(row))
            .withColumn("_bucket", F.pmod(F.col("_order"), F.lit(buckets)))
            .groupBy("_bucket").applyInPandas(place, full.schema))
    return full.unionByName(rest)


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves: sequence_id, ids and the doc_id of each piece, from pieces that carry ids.
    A group is one sequence, so at most ``capacity`` ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return (packed.groupBy("sequence_id").agg(parts.alias("_parts"))
            .select("sequence_id", F.flatten(F.col("_parts.ids")).alias("ids"), F.col("_parts.doc_id").alias("doc_ids")))
