"""Line dedup against every earlier document, not only the first holder of a line."""

import numpy as np
import pyarrow as pa
import pytest

from bibspan.llm.common import utf8
from bibspan.llm.line_dedup import _lines, shortest_runs, without_repeated_blocks
from bibspan.llm.words import WordHasher
from tests.llm.test_text_operators import blocks_by_force, made


def deduped(spark, texts, least):
    found = without_repeated_blocks(made(spark, texts), least, "gone").collect()
    return {r["doc_id"]: (r["text"], r["gone"]) for r in found}


def test_block_whose_lines_stand_alone_in_earlier_documents(spark):
    parts = [" ".join(f"s{k}w{j}" for j in range(15)) for k in range(4)]
    block = "\n".join(parts)
    texts = [(k + 1, f"{p}\nonly here {k}") for k, p in enumerate(parts)]
    texts += [(i, f"own {i} a\n{block}\nown {i} b") for i in range(5, 30)]
    found = deduped(spark, texts, 20)
    assert found == blocks_by_force(texts, 20)
    assert found[5][1] == 0 and all(found[i] == (f"own {i} a\nown {i} b", 4) for i in range(6, 30))


def test_blocks_of_any_earlier_document_in_any_order(spark):
    rng = np.random.default_rng(6)
    pool = [" ".join(f"p{k}x{j}" for j in range(int(rng.integers(1, 9)))) for k in range(24)]
    texts = []
    for i in range(60):
        own = []
        for _ in range(int(rng.integers(1, 5))):
            at = int(rng.integers(0, 24))
            own += [f"own{i} {len(own)}", *pool[at : at + int(rng.integers(1, 6))]]
        texts.append((i, "\n".join(own)))
    a, b = "\n".join(pool[:8]), "\n".join(pool[8:16])
    texts += [(70, f"{a}\nx\n{b}"), (71, f"{b}\ny\n{a}")]
    found = deduped(spark, texts, 12)
    assert found == blocks_by_force(texts, 12)
    assert found[71][0] == "y\n" and sum(n for _, n in found.values()) > 100


def test_shortest_runs():
    starts, stops = shortest_runs(np.array([19, 1, 5, 30, 2]), np.array([0, 3, 3, 5]), 20)
    assert sorted(zip(starts.tolist(), stops.tolist())) == [(0, 2), (0, 3), (3, 4), (3, 5)]
    assert [len(x) for x in shortest_runs(np.zeros(0, np.int32), np.array([0, 0]), 20)] == [0, 0]


@pytest.mark.parametrize("letters, stop", [("天地玄黄宇宙洪荒日月盈昃辰宿列张", "。"), ("いろはにほへとちりぬるをわかよた", "！"),
                                           ("กขคงจฉชซญฎฏฐฑฒณด", " "), ("天地玄黄宇宙洪荒日月盈昃辰宿列张", "")])
def test_scripts_without_spaces(spark, letters, stop):
    rng = np.random.default_rng(7)
    said = ["".join(rng.choice(list(letters), 30)) for _ in range(9)]
    passage = stop.join(said[:5]) + stop
    texts = [(1, passage + said[5] + stop if stop else passage), (2, said[6] + stop + passage + said[7] if stop else f"{said[6]}\n{passage}"),
             (3, said[6] + stop + said[8])]
    found = deduped(spark, texts, 20)
    left = said[6] + stop + said[7] if stop else said[6] + "\n"
    assert found[1] == (texts[0][1], 0) and found[3] == (texts[2][1], 0)
    assert found[2][0] == left and found[2][1] == (5 if stop else 1)


def test_words_of_other_scripts():
    def weights(text):
        return _lines(*utf8(pa.array([text])), WordHasher("space"))[2].tolist()

    assert weights("two words. And 12 letters: 一二三四") == [2, 5] and weights("四。") == [1] and weights("한국어 말") == [2]
    assert weights("一二三四。五六\n𠀀𠀁𠀂𠀃") == [2, 1, 2] and weights("यह है। वह") == [2, 1] and weights("") == []
