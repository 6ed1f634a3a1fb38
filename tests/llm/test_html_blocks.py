"""Blocks of pages whose markup could hide the rest of the page."""

import numpy as np
import pytest

from bibspan.llm.html_blocks import blocks, vectors
from bibspan.llm.main_text import windows


def texts(page):
    return [text for text, _, _ in blocks(page)]


@pytest.mark.parametrize("before", [
    "<svg class=i/>", "<svg class='i' />", "<svg class=i>", "<svg class=i><path d='m0'>", "<video-js id=v></video-js>", "<template-x></template-x>",
    "<object-viewer>", "<audio-player src=x>", "<script-x>", "<style-guide/>", "<video src=v>", "<canvas id=c>", "<iframe src=x>", "<object data=x>",
])
@pytest.mark.parametrize("after", ["", "<svg><title>no</title></svg>", "<video>no</video>", "<canvas>no</canvas>"])
def test_rest_of_the_page_stays(before, after):
    assert texts(f"<p>zero</p>{before}<p>one</p><p>two</p>{after}<p>three</p>") == ["zero", "one", "two", "three"]


def test_what_is_skipped_and_what_is_judged():
    page = "a<svg><svg><text>no</text></svg>no</svg>b<template><p>no</p></template>c<svg><foreignObject><div>no</div></foreignObject></svg>d<VIDEO>no</VIDEO >"
    assert "no" not in " ".join(texts(page)) and "".join("".join(texts(page)).split()) == "abcd"
    assert texts("<p>x</p><script>if (a<b) '<svg>'</script ><p>y</p><style>p{}") == ["x", "y"]
    found = blocks("<article><p>so <math><mi>e</mi></math> is</p><object><p>shown</p></object><noscript><p>said</p></noscript></article>")
    assert " ".join(t for t, _, _ in found).split() == ["so", "e", "is", "shown", "said"]
    assert found[-1][1][-2][0] == "noscript" and len(texts("<svg>" * 50_000 + "<p>end")) == 1


def test_vectors_hold_the_whole_block_and_path():
    def row(page):
        return vectors(blocks(page), {})[0]

    said = [f"word{k}" for k in range(60)]
    other = [*said[:30], "elsewhere", *said[31:]]
    assert (row(f"<p>{' '.join(said)}</p>") != row(f"<p>{' '.join(other)}</p>"))[:-9].any()
    deep = "<div>" * 30 + "<p>text"
    assert (row(f"<div class=comments>{deep}") != row(f"<div class=content>{deep}")).any()
    assert len(blocks("<div>x" * 30_000)) == 30_000 and vectors(blocks("<div>x" * 3000), {}).max() < 20


def test_windows_cover_whole_pages():
    x = np.arange(1001)
    assert np.concatenate(windows(x)).tolist() == x.tolist() and max(map(len, windows(x))) <= 240 and windows(x[:0]) == []
    assert len(windows(x[:240])) == 1
