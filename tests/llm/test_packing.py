import random
import zlib

import numpy as np
import public_tokenizers

from corpusgraph.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def texts():
    r = random.Random(4)
    odd = ["", None, " \n ", "Don't STOP'S 's it's", "a<|endoftext|>b <|startoftext|>", "x" * 500, "ÀÉß ñandú, İstanbul ſ ŉ Ǆ ΑΣ", "éa 1234 $$$ (a)] !!?", "日本語 текст 🙂", "\x1c\x1d a b　c", "In!! of&&& de%%%, a'b"]
    return odd + [" ".join(r.choice(["the", "Mente,", "où", "x9", "ing."]) for _ in range(n)) for n in (1, 50, 9000)] + ["same text"] * 3


def test_pieces_match_the_tokenizer(spark, docs):
    """Ids of each document by the tokenizer itself; windows full and gapless."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    t = texts()
    rows = packing.pack(docs(t).repartition(3), PATH, window=256).collect()
    for i, x in enumerate(t):
        want = [*tok.encode(x or "", add_special_tokens=False).ids, 2]
        mine = sorted((r.start, r.length, bytes(r.ids)) for r in rows if r.doc_id == i)
        assert [np.frombuffer(b, "<u4").tolist() for _, _, b in mine] == [want[a : a + n] for a, n, _ in mine]
        assert sum(n for _, n, _ in mine) == len(want) == next(r.doc_tokens for r in rows if r.doc_id == i)
    at = 0
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.sequence_id * 256 + r.offset == at and r.offset + r.length <= 256
        at += r.length


def test_empty_and_checksum(spark, docs):
    assert packing.pack(docs(["x"]).limit(0), PATH).collect() == []
    (r,) = packing.pack(docs([None]), PATH).collect()
    assert zlib.crc32(bytes(r.ids)) == zlib.crc32(np.array([2], "<u4").tobytes()) and r.length == 1
