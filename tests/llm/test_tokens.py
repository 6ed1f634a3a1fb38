"""BPE and token files against the tokenizers library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from bibspan.llm.bpe import ByteBpe, WordBpe, decode_ids, encode_texts, load, piece_starts
from bibspan.llm.token_files import canonical, code_lengths, packed, read_token_files, unpacked, write_token_files

PATHS = {WordBpe: public_tokenizers.path("word_bpe_49k.json"), ByteBpe: public_tokenizers.path("byte_bpe_50k.json")}
SIGNS = [*"abqxzXQZ'’stredl.!?,-_  \n\t\x1c\x85\xa0 ́éÉßİΣσfi1２%<|>", "<|endoftext|>", " <|endoftext|>", "'ll", "'s", "don't", "ΑΣ"]


def texts(seed, count=300):
    rng = random.Random(seed)
    for k in range(count):
        yield "".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 140 if k % 2 else 20)))
        yield "".join(rng.choice("abcdefqxzjvkQXZ'!.1") for _ in range(rng.randint(60, 140)))


@pytest.mark.parametrize("kind", [WordBpe, ByteBpe])
def test_fragments_give_the_ids_of_the_text(kind):
    with open(PATHS[kind], encoding="utf-8") as file:
        text = file.read()
    bpe, library = kind(text), load(text)
    some = ["", " ", "The quick brown fox, don't jump!", "x" * 500, "aqx" * 60, *texts(1)]
    for found, want in zip(bpe.encode_all(some), some):
        assert found.tolist() == library.encode(want, add_special_tokens=False).ids, want
    bpe.remembered = 0
    assert bpe.encode("The quick").tolist() == library.encode("The quick", add_special_tokens=False).ids


def test_pieces_of_many_texts_are_those_of_the_pattern():
    rng, signs = random.Random(5), [*"ab st'rvemld' \n\t\r  09.,!éÿÀ<|", "'ll", "'re", "'s ", " '", "\n\n"]
    for _ in range(500):
        some = ["".join(rng.choices(signs, k=rng.randint(0, 25))) for _ in range(rng.randint(0, 8))]
        raw = "".join(some).encode()
        ends = np.cumsum(np.array([len(t.encode()) for t in some], dtype=np.int64))
        starts = piece_starts(np.frombuffer(raw, np.uint8), ends).tolist()
        found = [raw[a:b].decode() for a, b in zip(starts, [*starts[1:], len(raw)])]
        assert found == [piece for text in some for piece in ByteBpe.pieces.findall(text)], some


def test_forced_boundaries():
    with open(PATHS[WordBpe], encoding="utf-8") as file:
        bpe = WordBpe(file.read())
    parts = bpe.forced("abzqxzqj,;12")
    assert "".join(p for p, _ in parts) == "abzqxzqj,;12" and len(parts) > 1


def test_encode_and_decode(spark):
    path = PATHS[WordBpe]
    with open(path, encoding="utf-8") as file:
        library = load(file.read())
    rows = [(1, "Some text, twice."), (1, "Some text, twice."), (None, "é É"), (2, ""), (3, None), (4, "word " * 40_000)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, ids string")
    found = decode_ids(encode_texts(docs, path), path)
    assert found.columns == ["doc_id", "text", "ids", "decoded"]
    for row in found.collect():
        want = library.encode(row["text"] or "", add_special_tokens=False).ids
        assert row["ids"] == want and row["decoded"] == library.decode(want, skip_special_tokens=False)
    assert found.count() == len(rows) and encode_texts(docs.limit(0), path).count() == 0


@pytest.mark.parametrize("counts", [[5], [3, 0, 1], [1] * 300, [2**k for k in range(40)], list(range(1, 2000))])
def test_codes_are_prefix_free_and_short(counts):
    lengths = code_lengths(np.array(counts))
    used = lengths[lengths > 0].astype(float)
    assert len(used) == np.count_nonzero(counts) and used.max() <= 16 and (2**-used).sum() <= 1
    p = np.array(counts)[lengths > 0] / sum(counts)
    if len(used) > 1 and len(counts) != 40:
        assert (p * used).sum() < -(p * np.log2(p)).sum() + 1
    rng = np.random.default_rng(0)
    ids = [rng.choice(np.flatnonzero(counts), n).astype(np.uint16) for n in (1, 256, 257, 3000)]
    codes, table = canonical(lengths)
    blocks, marks = packed(ids, codes, lengths)
    found = unpacked(blocks, marks, np.array([len(x) for x in ids]), table)
    assert all((a == b).all() for a, b in zip(found, ids))
    # A block is read alone, and from any checkpoint on.
    assert (unpacked(blocks[3:], marks[3:], np.array([3000]), table)[0] == ids[3]).all()
    tail = unpacked(blocks[3:], [marks[3][8:]], np.array([3000 - 256]), table)[0]
    assert (tail == ids[3][256:]).all()


def test_token_files(spark, tmp_path):
    with open(PATHS[ByteBpe], encoding="utf-8") as file:
        library = load(file.read())
    rows = [(k * 7 % 41, t) for k, t in enumerate(texts(3, 20))] + [(50, None), (51, ""), (None, "first"), (60, "same"), (60, "same"), (70, "long one " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    write_token_files(docs, PATHS[ByteBpe], str(tmp_path / "tokens"))
    found = sorted(read_token_files(spark, str(tmp_path / "tokens")).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in found] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    place, want = 0, {}
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.setdefault(i, []).append(zlib.crc32(np.array(ids, "<u4").tobytes()))
    for r in found:
        assert r["start"] == place
        place += len(r["ids"]) // 4
        want[r["doc_id"]].remove(zlib.crc32(r["ids"]))
    assert not any(want.values())


def test_no_token_files(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    write_token_files(docs, PATHS[ByteBpe], str(tmp_path / "none"))
    assert read_token_files(spark, str(tmp_path / "none")).count() == 0


