"""Packing: concatenate the token stream of all documents and cut it at fixed windows.

Pass one turns each text into token ids and keeps, for each input partition, a
running sum of its tokens.  Prefix sums over the partition totals (one number
for each task) give every partition its place in one global stream.  Pass two
needs no shuffle: a document that starts at global token ``g`` occupies
``g // window`` onward, and each window boundary inside it starts a new piece.
"""

from __future__ import annotations

import itertools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, written

#: Words whose ids a worker remembers at a time, and the longest word it remembers.
CACHE_WORDS, CACHE_BYTES = 400_000, 64

#: Marks that form one token run behind letters (no apostrophe: it may start a suffix).
MARKS = ".,!?;:#*$%&)]}"

TOKENS = "doc_id long, part int, first long, n_tokens long, ids binary"
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"

_loaded: dict[str, "WordTokenizer"] = {}


def _byte_chars() -> dict[int, int]:
    """Byte-level alphabet: printable bytes stand for themselves, the others for U+0100 and up."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in own]
    return {b: 256 + k for k, b in enumerate(rest)}


_BYTE_CHARS = _byte_chars()


class WordTokenizer:
    """Token ids of whole texts, one call of the tokenizer for each new word.

    Valid for a vocabulary whose pre-tokenizer never joins across ASCII white
    space and drops it (``splits_at_space`` tests the file)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.wide = self.tok.get_vocab_size() > 65536
        self.dtype, self.code = (np.dtype("<u4"), "I") if self.wide else (np.dtype("<u2"), "H")
        self.known: dict[bytes, bytes] = {}
        self.runs: dict[str, bytes] = {}
        tries = ["Ab.", "éÀç,", "ßüÖ", "ñandÚ!", "ŒuvrE;", "the", "ÿŷŸ:", "Of***", "x$$$", "IN!!", "de%%%,", "a&&&."]
        self.simple = True
        self.learn([w.encode() for w in tries])
        self.simple = all(self.known[w.encode()] == self._plain(w) for w in tries)
        self.known.clear()

    def _plain(self, word: str) -> bytes:
        return self._pack(self.tok.encode(word, add_special_tokens=False).ids)

    def _pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def _letters(self, word: str) -> bytes:
        found = self.runs.get(word)
        if found is None:
            if not word.isascii() or word[0] == " ":
                chars = word.encode().decode("latin-1").translate(_BYTE_CHARS)
            else:
                chars = word
            found = self.runs[word] = self._pack([t.id for t in self.tok.model.tokenize(chars)])
        return found

    def learn(self, words: list[bytes]) -> None:
        """Latin letters with a few marks behind them go straight to the
        merges: their normal form and their cut are known.  All else goes
        through the whole tokenizer."""
        for raw in words:
            word = raw.decode()
            body = word.rstrip(MARKS)
            mark = word[len(body) :]
            low = body.lower()
            if self.simple and body.isalpha() and len(mark) < 8 and len(body) < 64 and max(body) < "\u0180" and len(low) == len(body) and "\u0149" not in body and "\u017f" not in body:
                self.known[raw] = self._letters(low) + (self._letters(mark) if mark else b"")
            else:
                self.known[raw] = self._plain(word)

    def ids(self, text: bytes) -> bytes:
        words = text.split()
        known = self.known
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            pass
        if len(known) > CACHE_WORDS:
            known.clear()
            self.runs.clear()
        self.learn([w for w in {*words} if w not in known])
        out = b"".join([known[w] for w in words])
        for w in words if max(map(len, words)) > CACHE_BYTES else ():
            if len(w) > CACHE_BYTES:
                known.pop(w, None)
        return out


def splits_at_space(path: str) -> bool:
    """Whether ids of a text are the ids of its words, one after another."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    words = ["Ab.", "'s", "x1", "É", "<|endoftext|>z", "9"]
    of = lambda x: tok.encode(x, add_special_tokens=False).ids
    return all(of(s.join(words)) == [i for w in words for i in of(w)] for s in (" ", "\n", "\t \r\n"))


def loaded(path: str) -> WordTokenizer:
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


def _tokenise(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = loaded(path)
        end = np.array([end_id], tok.dtype).tobytes()
        part = TaskContext.get().partitionId()
        at = 0
        for batch in small(batches):
            ids = [tok.ids(x) + end for x in batch.column(1).cast(pa.binary()).to_pylist()]
            n = np.array([len(x) // tok.dtype.itemsize for x in ids], np.int64)
            first = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(first), pa.array(n), pa.array(ids, pa.binary())], ["doc_id", "part", "first", "n_tokens", "ids"])

    return run


def _cut(offsets, window: int, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = offsets.value
        for batch in batches:
            out: list[tuple] = []
            for doc, part, first, n, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                g = place[part] + first
                all_ids = np.frombuffer(ids, dtype)
                start = 0
                while start < n:
                    seq, offset = divmod(g + start, window)
                    length = min(n - start, window - offset)
                    out.append((doc, start, length, n, seq, offset, all_ids[start : start + length].astype("<u4").tobytes()))
                    start += length
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:6]), pa.array(cols[6], pa.binary())], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, window: int = 4096, end_id: int = 2) -> DataFrame:
    """Pieces of the token stream of ``docs`` (columns doc_id, text), in windows of ``window``.

    One row for each piece: doc_id, start (ids of its document before it),
    length, doc_tokens (with the end id), sequence_id, offset in the sequence,
    ids (little-endian unsigned 32-bit).  Only the last sequence is short.

    Null and empty texts hold the end id alone.  Repeated rows are packed as
    often as they occur.  An empty table gives no rows.  A text of any length is
    cut at window boundaries.  The order of documents is that of the input's
    partitions; ids never move between tasks."""
    spark = docs.sparkSession
    if not splits_at_space(tokenizer_path):
        raise ValueError("this tokenizer joins across white space")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    tokens = written(text.mapInArrow(_tokenise(tokenizer_path, end_id), TOKENS), "tokens")
    # one number for each task of pass one
    totals = dict(tokens.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    parts = sorted(totals)
    starts = itertools.accumulate((totals[p] for p in parts), initial=0)
    offsets = spark.sparkContext.broadcast(dict(zip(parts, starts)))
    return tokens.mapInArrow(_cut(offsets, window, loaded(tokenizer_path).dtype.str), PIECES)
