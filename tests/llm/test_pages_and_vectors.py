"""WARC archives, page text and embeddings against brute force."""

import hashlib
import re

import numpy as np
import pytest

from bibspan.llm.html_blocks import blocks
from bibspan.llm.main_text import fit, main_text, with_main_text
from bibspan.llm.recurrent import HIDDEN, gradients, label, start, train
from bibspan.llm.tiles import Tile, near_vectors, possible_pairs
from bibspan.llm.warc import read_chunks, stored_records, with_record_types, write_archives
from tests.conftest import SF_DIR, rows

PAGES = "page_id long, url string, html string, bytes string, target long"


def test_archives(spark, tmp_path):
    long = "é" * 700
    data = [(1, "http://a", long), (2, "http://b\r\nX: y", long), (3, None, long), (4, "u", "short"), (5, "u", "short"), (6, "u", None),
            (7, "u", ""), (8, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 400), (3, None, long), (None, "u", long), (None, "v", "n" * 2000),
            (9, "u", "x" * 300_000)]
    pages = spark.createDataFrame([(*d, "c", 0) for d in data], PAGES).repartition(3)
    folder = str(tmp_path / "warc")
    write_archives(with_record_types(pages), folder)
    chunks = read_chunks(spark, folder, size=4096)
    got = rows(stored_records(chunks).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    want = []
    for i, _, h in data:
        raw = (h or "").encode()
        same = [j for j, _, x in data if (x or "") == (h or "") and j is not None]
        revisit = len(raw) >= 1000 and same and max(same) != i
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", max(same) if revisit else None))
    assert got == sorted(want, key=repr)
    parts = sorted((r["chunk_no"], r["chunk"]) for r in chunks.where("page_id = 9").collect())
    assert b"".join(c for _, c in parts) == b"x" * 300_000 and max(len(c) for _, c in parts) <= 2 * 4096


def test_no_archives(spark, tmp_path):
    folder = str(tmp_path / "none")
    write_archives(with_record_types(spark.createDataFrame([], PAGES)), folder)
    assert stored_records(read_chunks(spark, folder)).count() == 0


def test_blocks():
    page = "<div class='Side bar'>a <b>b</b>c &amp; d<br>e<p>one<p>two</div><!-- no --><script>var x='</p>'</script>f<ul><li>g<li><a href=x>h</a></ul><p>last"
    found = [(text, path[-1][0] if path else None, linked) for text, path, linked in blocks(page)]
    assert [t for t, _, _ in found] == ["a bc & d e", "one", "two", "f", "g", "h", "last"]
    assert found[5][2] == 1.0 and blocks(page)[0][1] == (("div", ("side", "bar")),) and blocks(page)[2][1][-1] == ("p", ())
    assert blocks("") == [] and blocks("<p") != [] and blocks("<<<>>>&#0;&bogus;") is not None


def test_main_text(spark):
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    model = fit(pages)

    def article(page):
        body = re.sub(r"</?b>", "", re.search(r"<article>(.*?)</article>", page, re.DOTALL)[1])
        import html

        return re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", body))).strip()

    found = with_main_text(pages.withColumnRenamed("url", "text"), model).collect()
    assert sum(r["text"] == article(r["html"]) for r in found) >= 0.98 * len(found)
    more = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "<p>" * 3000)], "page_id long, html string")
    assert [r["text"] for r in with_main_text(more, model).collect()] == [""] * 4
    assert with_main_text(more.limit(0), None).count() == 0 and fit(more) is None
    page = "<body><div class=menu><a href=/>Home</a></div><div class=content><h1>A title of some length</h1><p>A text that goes on, with several words. And on.</p></div><div class=comments><p>I do not agree.</p></div></body>"
    assert main_text(model, [blocks(page)], {}) == ["A title of some length A text that goes on, with several words. And on."]


def test_gradients_of_the_labeller():
    rng = np.random.default_rng(0)
    pages = [rng.normal(size=(n, 5)).astype(np.float32) for n in (3, 5)]
    labels = [rng.integers(0, 2, len(p)).astype(np.float32) for p in pages]
    model = {k: v.astype(np.float64) for k, v in start(5, rng).items()}

    def loss():
        found = np.concatenate(label(model, pages))
        y = np.concatenate(labels)
        return -(y * np.log(found) + (1 - y) * np.log(1 - found)).mean()

    exact = gradients(model, pages, labels)
    for name, at in (("wf", (2, 3)), ("ub", (1, 2 * HIDDEN)), ("cb", (HIDDEN + 1,)), ("out", (4,)), ("end", (0,))):
        kept, size = model[name][at], 1e-2
        model[name][at] = kept + size
        more = loss()
        model[name][at] = kept - size
        assert exact[name][at] == pytest.approx((more - loss()) / (2 * size), abs=2e-3)
        model[name][at] = kept


def test_labeller_uses_the_page():
    """The label of a block is set by a block at the other end of its page."""
    rng = np.random.default_rng(1)
    pages, labels = [], []
    for _ in range(300):
        x = rng.normal(size=(int(rng.integers(3, 7)), 4)).astype(np.float32)
        x[-1, 0] = rng.choice([-3, 3])
        pages.append(x)
        labels.append(np.full(len(x), float(x[-1, 0] > 0), dtype=np.float32))
    found = label(train(pages[:250], labels[:250], 4), pages[250:])
    assert np.mean([(a > 0.5) == b for p, y in zip(found, labels[250:]) for a, b in zip(p, y)]) > 0.95


def vectors_by_force(data, threshold=0.9):
    good = [
        v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in data
    ]
    unit = [np.array(v) / np.abs(v).max() if g else None for (_, v), g in zip(data, good)]
    unit = [u / np.linalg.norm(u) if u is not None else None for u in unit]
    n, parent = len(data), list(range(len(data)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * n
    for a in range(n):
        for b in range(n):
            if a != b and good[a] and good[b] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
                links[a] += 1
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(data):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    out = [(least.get(root(k)), i is not None and least.get(root(k)) == i, links[k], i) for k, (i, _) in enumerate(data)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_rows", [2048, 16])
def test_near_vectors(spark, block_rows):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(8, 12))
    data = [(k, (centre[k % 8] + rng.normal(0, 0.12, 12)).tolist()) for k in range(90)]
    data += [(200, None), (201, [0.0] * 12), (202, [float("nan")] + [1.0] * 11), (203, [float("inf")] * 12), (204, [None, 1.0]),
             (205, []), (206, [1.0, 2.0]), (207, [2.0, 4.0]), (3, data[3][1]), (3, data[3][1]), (None, data[5][1]), (None, None),
             (300, [1e300] * 12), (301, [1e-300] * 12)]
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in data], "vec_id long, embedding array<double>, label int, cid string")
    got = rows(near_vectors(table, block_rows=block_rows).select("component_id", "kept", "n_links", "vec_id"))
    assert got == vectors_by_force(data)
    assert near_vectors(table.limit(0)).count() == 0


def test_bounds_of_quantised_products():
    rng = np.random.default_rng(5)
    one = Tile(np.concatenate([rng.normal(size=(300, 64)), np.eye(64)]))
    two = Tile(one.unit + rng.normal(0, 0.05, one.unit.shape))
    want = np.argwhere(one.unit @ two.unit.T >= 0.9)
    found = {(a, b) for x, y in possible_pairs(one, two, 0.9, np.float32) for a, b in zip(x.tolist(), y.tolist())}
    assert {tuple(p) for p in want.tolist()} <= found and len(found) < 2 * len(want) + 50


