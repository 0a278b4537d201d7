"""Word hashes, splitting and BPE against plain Python and the tokenizers library."""

import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from catalogmatch.llm import bpe, decontaminate, pack
from catalogmatch.llm import words as w

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from("abé \t\n\x0b\x1c 中Z"), max_size=40)), max_size=6))
@settings(max_examples=60, deadline=None)
def test_words_are_the_runs_between_blanks(texts):
    x = w.split(pa.array(texts, pa.string()))
    found = [[x.data[s:e].tobytes().decode() for s, e in zip(x.start[a:b], x.end[a:b])] for a, b in zip(x.first[:-1], x.first[1:])]
    assert found == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]


def test_equal_words_have_equal_hashes_wherever_they_stand():
    long = "x" * 200_000
    a = w.split(pa.array(["one two " + long, None, "two", long + " one"]))
    b = w.split(pa.array([long]))
    assert a.hash[1] == a.hash[3] and a.hash[0] == a.hash[5] and a.hash[2] == a.hash[4] == b.hash[0]
    assert len(set(a.hash.tolist())) == 3
    assert w.split(pa.array(["AbC É"]), fold=True).hash[0] == w.split(pa.array(["abc"])).hash[0]


def test_windows_and_lowest():
    h = np.arange(20, dtype=np.uint64)
    assert w.windows(h, 3)[4] == w.windows(h[4:7], 3)[0]
    assert (w.lowest(h[::-1], 5) == np.array([h[::-1][i:i + 5].min() for i in range(16)])).all()
    assert len(w.windows(h, 21)) == 0 == len(w.lowest(h, 21))


@pytest.fixture(scope="module")
def vocabulary():
    with open(PATH, "rb") as file:
        return bpe.Vocabulary(file.read())


def check_bpe(vocabulary, texts):
    library = tokenizers.Tokenizer.from_file(PATH)
    for text, ids in zip(texts, vocabulary.all_ids(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert vocabulary.text(ids) == library.decode(want, skip_special_tokens=False)


@given(st.lists(st.text(max_size=60), min_size=1, max_size=5))
@settings(max_examples=80, deadline=None)
def test_bpe_equals_the_library(vocabulary, texts):
    check_bpe(vocabulary, texts)


def test_bpe_special_tokens_spaces_and_long_runs(vocabulary):
    check_bpe(vocabulary, ["", "<|endoftext|>", "a<|endoftext|><|endoftext|> b's", "  \n\n  x  ", "a" * 3000 + "é" * 900,
                           "\x1c\x85  　x", "don't I'LL we'll 12345 ²½"])


def test_batched_merges_equal_single_merges(vocabulary):
    random.seed(5)
    pieces = {"".join(random.choice("thersouanié ") for _ in range(random.randint(1, 60))) for _ in range(400)}
    vocabulary.known.forget()
    vocabulary.known.learn(pieces)
    for piece in pieces:
        assert vocabulary.known[piece] == bpe._Known.__missing__(vocabulary.known, piece)


@given(st.lists(st.integers(1, 16), max_size=60))
@settings(max_examples=80, deadline=None)
def test_best_fit_decreasing_equals_a_plain_search(sizes):
    rows = pack.best_fit_decreasing(np.array(sizes, int), 16)
    assert sorted(p for row in rows for p in row) == list(range(len(sizes)))
    room = []
    for size in sorted(sizes, reverse=True):
        fits = [r for r in room if r >= size]
        if fits:
            room.remove(min(fits))
            room.append(min(fits) - size)
        else:
            room.append(16 - size)
    assert sorted(room) == sorted(16 - sum(sizes[p] for p in row) for row in rows)


def plain_tiles(a, b, least):
    """Greedy string tiling by trying every pair of places."""
    a, b, used_a, used_b, out = list(a), list(b), set(), set(), []
    while True:
        best = (0, 0, 0)
        for p in range(len(a)):
            for q in range(len(b)):
                n = 0
                while p + n < len(a) and q + n < len(b) and a[p + n] == b[q + n] and p + n not in used_a and q + n not in used_b:
                    n += 1
                if n > best[0]:
                    best = (n, p, q)
        if best[0] < least:
            return out
        out.append(best)
        used_a |= set(range(best[1], best[1] + best[0]))
        used_b |= set(range(best[2], best[2] + best[0]))


def test_tiling_of_reordered_passages():
    item = w.windows(np.arange(40, dtype=np.uint64), 1)
    moved = np.concatenate([item[25:], w.windows(np.arange(90, 99, dtype=np.uint64), 1), item[:25]])
    assert sum(t[0] for t in decontaminate.tile(item, moved, 4)) == 40 == sum(t[0] for t in plain_tiles(item, moved, 4))
    assert sorted(t[0] for t in decontaminate.tile(item, moved, 4)) == [15, 25]
    assert decontaminate.tile(item[:3], item, 4) == []


def test_tiles_do_not_overlap_and_are_those_of_plain_tiling():
    rng = np.random.default_rng(2)
    for k in range(300):
        letters = 2 + k % 5
        a, b = rng.integers(0, letters, 24).astype(np.uint64), rng.integers(0, letters, 30).astype(np.uint64)
        tiles = decontaminate.tile(a, b, 3)
        for side in (1, 2):
            cells = [t[side] + i for t in tiles for i in range(t[0])]
            assert len(cells) == len(set(cells))
        assert all((a[p:p + n] == b[q:q + n]).all() for n, p, q in tiles)
        assert tiles == plain_tiles(a, b, 3)


def test_vocabulary_file_is_not_in_the_repository():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert not os.path.abspath(PATH).startswith(root + os.sep)


def test_pieces_of_many_texts_equal_the_pattern_and_are_not_made_one_by_one(vocabulary, monkeypatch):
    """Letters that meet the pattern's corners, nulls and added tokens; every code point once."""
    library, rng = regex.compile(bpe.PATTERN), random.Random(3)

    def wanted(text):
        parts = vocabulary.cut.split(text or "")
        return [piece for part in parts for piece in ([part] if part in vocabulary.added else library.findall(part))]

    letters = [*"''   stmdrevl1\n\t!é中　 ①\U0001f600\x1c\x85​", "'re", "'ll", " 've", "<|endoftext|>"]
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for texts in [[every]] + [[rng.choice([None, "".join(rng.choices(letters, k=rng.randrange(25)))]) for _ in range(rng.randrange(9))] for _ in range(400)]:
        pieces, first = vocabulary._pieces(pa.array(["x's", *texts, "'s"], pa.string()).slice(1, len(texts)))
        assert [pieces.to_pylist()[a:b] for a, b in zip(first[:-1], first[1:], strict=True)] == [wanted(text) for text in texts]
    asked = []

    class Counted(bpe._Known):
        def get(self, piece):
            asked.append(piece)
            return super().get(piece)

        def __getitem__(self, piece):
            asked.append(piece)
            return super().__getitem__(piece)

    monkeypatch.setattr(vocabulary, "known", Counted(vocabulary))
    assert len(vocabulary.all_ids(["word " * 1000] * 3)) == 3 and len(asked) == 6  # not 3,003: each distinct piece asked for, and once more when learnt
