"""Binary token files: coder, segments, and the query against the library."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from demandlens.llm import id_coder, id_files
from demandlens.llm.queries import WORDS

ALPHABET = "abcXYZ'stredvml 019!#<|>\t\n\x0b\x0c\x1c\x1f\x85  éÉßºª²½ÅǺİıΣς中文ﬁＡ🙂‍.,-"


def library(rows):
    """Rows (id, text) in order: what the query must return."""
    tokenizer, out, start = Tokenizer.from_file(WORDS), [], 0
    for key, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        out.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("top", [0, 3, 300, 65535])
@pytest.mark.parametrize("sizes", [[1], [5, 3], [300, 300, 17], [129, 128, 127, 1], [2000, 1025, 1024]])
def test_blocks_come_back_and_stand_alone(sizes, top):
    rng = np.random.default_rng(top)
    blocks = [rng.integers(0, top + 1, n).astype(np.uint16) for n in sizes]
    coded = id_coder.encode_blocks(blocks)
    for got, block in zip(id_coder.decode_blocks(coded, sizes), blocks):
        np.testing.assert_array_equal(got, block)
    for block, own in zip(blocks, coded):
        assert id_coder.encode_blocks([block]) == [own]
        np.testing.assert_array_equal(id_coder.decode_blocks([own], [len(block)])[0], block)


def test_patterns_are_learnt():
    period = np.tile(np.arange(7, dtype=np.uint16), 1000)
    random_ids = np.random.default_rng(0).integers(0, 1 << 16, 7000).astype(np.uint16)
    small, large = (len(id_coder.encode_blocks([b])[0]) for b in (period, random_ids))
    assert small < 800 and large < 1.15 * 2 * 7000


def test_chunks_have_the_librarys_ids():
    rng, tokenizer = random.Random(3), Tokenizer.from_file(WORDS)
    with open(WORDS, encoding="utf-8") as f:
        table = id_files.ChunkIds(f.read(), limit=500)
    for _ in range(5000):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 25)))
        text += rng.choice(["", "", "<|endoftext|>", "x<|startoftext|>y", " don't WE'LL it's", "a" * 60])
        assert table.encode(text.encode(), b"\2\0").tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 2]


def test_damage_is_noticed():
    ids = np.arange(500, dtype=np.uint16)
    whole = id_files.pack_segment([(7, 300, 0), (8, 200, id_files.TO_NEXT)], ids, 128) + id_files.END.encode()
    (directory, got), = id_files.unpack_segments(memoryview(whole))
    np.testing.assert_array_equal(got, ids)
    assert directory["n"].tolist() == [300, 200]
    for at in (1, 6, 30, len(whole) // 2, len(whole) - 8, len(whole) - 2):
        bad = bytearray(whole)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            list(id_files.unpack_segments(memoryview(bytes(bad))))


def test_query_equals_the_library_on_unkind_rows(spark, tmp_path):
    rng = random.Random(5)
    long = " ".join(rng.choice(["alpha", "Beta", "x1", "naïve", "#"]) for _ in range(9000))
    rows = [(5, "b"), (None, "no id"), (3, None), (4, ""), (-9, "minus"), (7, long), (7, long), (6, "repeated"), (6, "repeated"), (2, " \n "), (8, "# 2 ##"), (1 << 60, "last")]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, ids string, file int")
    got = id_files.round_trip(docs, WORDS).collect()
    want = library(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)))
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    empty = id_files.round_trip(docs.limit(0), WORDS)
    assert empty.count() == 0 and empty.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_texts_longer_than_a_segment(spark, tmp_path):
    texts = [(i, " ".join(f"w{j}" for j in range(n))) for i, n in enumerate([0, 900, 2, 2000, 1, 0, 700])]
    docs = spark.createDataFrame(texts, "doc_id int, text string").repartition(3)
    id_files.write_ids(docs, WORDS, f"{tmp_path}/files", block=64, lanes=8)
    read = id_files.read_ids(spark, f"{tmp_path}/files").orderBy("file", "before").collect()
    assert [r.doc_id for r in read] == list(range(7))
    assert [(len(r.ids) // 4, zlib.crc32(r.ids)) for r in read] == [x[2:] for x in library(texts)]


def test_ids_must_be_integers(spark, tmp_path):
    with pytest.raises(TypeError):
        id_files.write_ids(spark.createDataFrame([("a", "b")], "doc_id string, text string"), WORDS, f"{tmp_path}/x")
