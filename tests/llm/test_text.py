import random
import re

import numpy as np
import pyarrow as pa

from winnow.llm import text


def one_chunk(texts):
    return list(text.chunks([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])]))


def test_words_and_hashes():
    rng = random.Random(1)
    texts = ["".join(rng.choice("aB \t\né中") for _ in range(rng.randrange(30))) for _ in range(200)] + [None, "", " a"]
    (chunk,) = one_chunk(texts)
    w = text.words(chunk)
    h = text.word_hashes(chunk, w)
    seen = {}
    for i, t in enumerate(texts):
        expected = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())
        got = [chunk.data[a:b].tobytes() for a, b in zip(w.start[w.first[i] : w.first[i + 1]], w.end[w.first[i] : w.first[i + 1]])]
        assert got == expected
        for word, x in zip(got, h[w.first[i] : w.first[i + 1]]):
            assert seen.setdefault(word.lower(), x) == x
    assert len(set(seen.values())) == len(seen)


def test_chunks_are_bounded_and_whole():
    texts = ["x" * n for n in (5, 0, 3 << 20, 7, 600_000, 600_000)]
    found = one_chunk(texts)
    assert [c.text(i).decode() for c in found for i in range(c.rows.num_rows)] == texts
    assert all(len(c.data) <= text.CHUNK or c.rows.num_rows == 1 for c in found)


def test_shingles():
    (chunk,) = one_chunk(["a b c d", "a b", "", "b c d", "a b c"])
    w = text.words(chunk)
    h, row = text.shingles(text.word_hashes(chunk, w), w.first, 3, short_whole=True)
    per = [set(h[row == i].tolist()) for i in range(5)]
    assert [len(p) for p in per] == [2, 1, 0, 1, 1]
    assert per[4] < per[0] and per[3] < per[0] and not per[1] & per[0]


def test_codepoints_survive_bad_bytes():
    chunk = text.Chunk(None, np.frombuffer("é".encode() + b"\xff" + b"ab", np.uint8), np.array([0, 2, 3, 5]))
    chars, offsets = text.codepoints(chunk)
    assert offsets.tolist() == [0, 1, 2, 4] and chars[0] == 0xE9
