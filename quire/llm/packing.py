"""Packing by powers of two: every document is cut into pieces of binary length, and a sequence is one piece.

A document's ids are cut into pieces of `max_len`, then of the powers of two that make up the rest, the largest
first. Pieces of one length form a bucket (column `bucket`, the exponent), and are gathered: pieces are dealt evenly, by a hash of
their place, sorted by bucket within each part, and numbered in that order, so that a batch is a run of equal lengths, no
sequence holds two documents and none needs padding. The numbers don't depend on how the input was split. Pieces of rows that
repeat an id lie in one part.

Defined cases: a null or empty text has the end id alone (one piece of length 1); repeated rows, and null ids, are
packed row by row; very long texts are cut like others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._core import bucket_bits, gather, pick, sliced, words_of

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, offset long, bucket int"
MB_EACH = 8.0
END_OF_WORD, MARKS = "</w>", b".,;:!?|%$&*#()[]{}<>\"+-=/\\^_`~@"
PLAIN = re.compile("[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch
#: Words whose ids a worker keeps in each of two generations: when the younger is full it becomes the older.
CACHE_WORDS = 350_000


class WordEncoder:
    """Ids of whole texts from the ids of their parts between ASCII white space, which the vocabulary drops."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        # for words of plain letters, which the normaliser leaves and the splitter keeps whole
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith(END_OF_WORD)]] = True
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def ids_of(self, words: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each of some distinct words."""
        try:
            return [self.known[w] for w in words]
        except KeyError:
            self._learn(words)
            return [self.known[w] for w in words]

    def _learn(self, parts: list[bytes]) -> None:
        new = [p for p in parts if p not in self.known]
        if self.known and len(self.known) + len(new) > CACHE_WORDS:
            self.known, self.older = {}, self.known
            new = parts
        ended: dict[bytes, tuple[bytes, bytes]] = {}  # a word and the marks after it are matched apart
        lost: dict[bytes, None] = {}
        for w in new:
            word = w.rstrip(MARKS)
            if len(word) < len(w) and word[-1:].isalnum():
                ended[w] = (word, w[len(word) :])
            for p in ended.get(w, (w,)):
                if p not in self.known:
                    ids = self.older.get(p)
                    if ids is None:
                        lost[p] = None
                    else:
                        self.known[p] = ids
        parts = list(lost)
        for low in range(0, len(parts), 1 << 14):
            self._encode(parts[low : low + (1 << 14)])
        for w, (word, marks) in ended.items():
            self.known[w] = self.known[word] + self.known[marks]

    def _encode(self, parts: list[bytes]) -> None:
        decoded = [p.decode("utf-8", "replace") for p in parts]
        plain = [PLAIN(d) is not None for d in decoded]
        # plain words have one match each, whose last id ends a word: many are encoded as one text
        words = [d.lower() for d, is_plain in zip(decoded, plain, strict=True) if is_plain]
        blobs: list[bytes] = []
        for enc in self.plain.encode_batch_fast([" ".join(words[low : low + 1024]) for low in range(0, len(words), 1024)], add_special_tokens=False):
            ids = np.array(enc.ids, "<u4")
            data, ends = ids.tobytes(), (np.flatnonzero(self.ends_word[ids]) + 1).tolist()
            blobs += [data[4 * a : 4 * b] for a, b in zip([0, *ends], ends, strict=False)]
        if len(blobs) != len(words):
            raise ValueError("the vocabulary doesn't mark the ends of words")
        self.known.update(zip([p for p, is_plain in zip(parts, plain, strict=True) if is_plain], blobs, strict=True))
        rest = [(p, d) for p, d, is_plain in zip(parts, decoded, plain, strict=True) if not is_plain]
        got = self.tokenizer.encode_batch_fast([d for _, d in rest], add_special_tokens=False)
        for (part, _), enc in zip(rest, got, strict=True):
            self.known[part] = np.array(enc.ids, "<u4").tobytes()


_ENCODERS: dict[str, WordEncoder] = {}


def piece_lengths(n: int, max_len: int) -> list[int]:
    """Whole pieces of max_len, a power of two, then the powers of two of the rest in falling order."""
    whole, rest = divmod(n, max_len)
    return [max_len] * whole + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer_path: str, max_len: int = 4096, end_id: int = 2) -> DataFrame:
    """One row a piece, sequence_id too: `ids` are little-endian unsigned 32-bit. sequence_id holds the partition and the place in it."""
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _ENCODERS:
            _ENCODERS[tokenizer_path] = WordEncoder(tokenizer_path)
        encoder = _ENCODERS[tokenizer_path]
        for batch in sliced(batches):
            starts, codes, distinct = words_of(batch.column(1), lower=True)  # the vocabulary has lower case only
            # each row's words, then the end id
            codes = np.insert(codes, starts[1:], len(distinct))
            flat, each = gather(codes, [*encoder.ids_of(distinct), end], 4)
            ends = np.append(0, np.cumsum(each))[starts[1:] + np.arange(1, len(starts))]
            totals = np.diff(np.append(0, ends))
            cut = [piece_lengths(n, max_len) for n in totals.tolist()]
            counts = np.fromiter(map(len, cut), np.int64, len(cut))
            sizes = np.fromiter(chain.from_iterable(cut), np.int64, int(counts.sum()))
            rows = np.repeat(np.arange(len(cut)), counts)
            at = np.cumsum(sizes) - sizes  # of each piece among the batch's ids
            begin = at - np.repeat(ends - totals, counts)
            step = 1 << 14
            for low in range(0, len(rows), step):
                part = slice(low, low + step)
                k = len(rows[part])
                bounds = 4 * (np.append(at[part], at[part][-1] + sizes[part][-1]) - at[low])
                data = flat[at[low] : at[low] + bounds[-1] // 4]
                blobs = pa.Array.from_buffers(pa.binary(), k, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows[part])), pa.array(begin[part]), pa.array(sizes[part]), blobs, pa.array(totals[rows[part]]),
                     pa.array(np.zeros(k, np.int64)), pa.array(np.log2(sizes[part]).astype(np.int32))],
                    names=["doc_id", "start", "length", "ids", "doc_tokens", "offset", "bucket"],
                )

    docs = pick(docs, "doc_id", "text")
    pieces = docs.select(docs.doc_id.cast("long"), docs.text.cast("string")).mapInArrow(run, SCHEMA)
    parts = 1 << bucket_bits(docs, MB_EACH)
    gathered = pieces.repartition(parts, F.xxhash64("doc_id", "start")).sortWithinPartitions("bucket", "doc_id", "start")
    return gathered.select("doc_id", "start", "length", "ids", "doc_tokens", F.monotonically_increasing_id().alias("sequence_id"), "offset", "bucket")
