"""HTML extraction: a recurrent labeller decides for every block of a page whether it is main text.

There are no labels for pages, so the labeller is trained on layouts made around the texts of a
bounded sample of pages: articles in several kinds of containers among menus, headers, sidebars,
notices, adverts, forms, comments and footers, whose labels are known as they are made, and on
the sampled pages, labelled by the containers that mark articles plainly.  It reads the tag
path and the words of every block in both directions, so a block is judged with the whole page.
"""

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibspan.llm import recurrent
from bibspan.llm.common import pieces
from bibspan.llm.html_blocks import WIDTH, blocks, vectors

# The sample: pages to take texts from, and layouts made of them.
MOST_PAGES = 300
LAYOUTS = 900
# Blocks the labeller learns from at once: longer pages are read in several windows, from start to end.
WINDOW = 240

# Names of containers.
ASIDE = frozenset(
    "ad ads advert advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus dialog "
    "footer form header login masthead menu modal nav navbar navigation newsletter notice pager popup promo promoted related "
    "reply search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
ASIDE_TAGS = frozenset("nav header footer aside form menu dialog head title select button noscript".split())
BODY = frozenset("article body content entry main post story text".split())
_SAID = {
    "menu": "Home|About|Contact|News|Products|Blog|Archive|Help|Login|Search|Impressum|Accueil|Inicio|Kontakt".split("|"),
    "notice": ["We use cookies to improve this site.", "This site uses cookies.", "Accept all cookies", "Read our privacy policy."],
    "share": "Share|Tweet|Print|E-mail|Like|Follow us".split("|"),
    "form": ["Name", "E-mail address", "Subscribe", "Send", "Search this site", "Password"],
    "legal": ["© All rights reserved.", "Terms of use", "Privacy", "Copyright 2020", "&copy; site.example.com &middot; Contact"],
}


def plainly_main(path) -> bool | None:
    """What the containers say: the innermost telling one counts; None if there is none."""
    for tag, names in reversed(path):
        if tag in ASIDE_TAGS or not ASIDE.isdisjoint(names):
            inside = any(t in ("article", "main") for t, _ in path) and tag == "header"
            return inside
        if tag in ("article", "main") or not BODY.isdisjoint(names):
            return True
    return None


class Layouts:
    """Pages made of given texts, with the texts that are their main blocks."""

    def __init__(self, texts: list[str], rng):
        self.texts, self.rng = texts, rng

    def _some(self, kind: str) -> str:
        return str(self.rng.choice(_SAID[kind]))

    def _text(self, most: int = 400) -> str:
        return self.texts[int(self.rng.integers(len(self.texts)))][:most].replace("<", "&lt;")

    def _short(self) -> str:
        return " ".join(self._text().split()[: int(self.rng.integers(1, 6))])

    def _menu(self) -> str:
        names = [self._some("menu") if self.rng.random() < 0.5 else self._short() for _ in range(int(self.rng.integers(2, 9)))]
        items = "".join(f'<li><a href="/{k}">{n}</a></li>' for k, n in enumerate(names))
        return self._in(f"<ul>{items}</ul>", "nav", "div class=menu", "div id=nav", "div class='top navbar'")

    def _in(self, inner: str, *wrappers: str) -> str:
        opening = str(self.rng.choice(wrappers))
        return f"<{opening}>{inner}</{opening.split()[0]}>"

    def _beside(self) -> str:
        kind = int(self.rng.integers(8))
        text = self._text(int(self.rng.integers(20, 300)))
        if kind == 0:
            return self._menu()
        if kind == 1:
            return self._in(text, "div class=ad", "div class='banner ads'", "aside class=sponsored", "div id=advert", "ins class=ads")
        if kind == 2:
            inner = f"<h3>{self._short()}</h3><p>{text}</p><ul><li><a href=/x>{self._short()}</a><li><a href=/y>{self._short()}</a></ul>"
            return self._in(inner, "aside", "div class=sidebar", "div id=sidebar", "section class=related", "div class=widget")
        if kind == 3:
            inner = f"<p>{self._some('notice')}</p><button>OK</button>"
            return self._in(inner, "div class=cookie-notice", "div id=cookie-banner", "div role=dialog", "div class=consent")
        if kind == 4:
            inner = "".join(f"<div class=comment><b>{self._short()}</b><p>{self._text(200)}</p></div>" for _ in range(int(self.rng.integers(1, 5))))
            return self._in(f"<h2>Comments</h2>{inner}", "section id=comments", "div class=comments", "div id=disqus_thread")
        if kind == 5:
            return self._in(f"<label>{self._some('form')}</label><input><p>{self._some('form')}</p>", "form", "form class=newsletter", "div class=signup")
        if kind == 6:
            return self._in(f"<a href=#>{self._some('share')}</a> <a href=#>{self._some('share')}</a>", "div class=share", "ul class=social", "div class=toolbar")
        return self._in(f"<p>{self._some('legal')} {self._short()}</p>", "footer", "div class=footer", "div id=footer")

    def _main(self) -> str:
        parts = [f"<h1>{self._text(60)}</h1>"] if self.rng.random() < 0.8 else []
        for _ in range(int(self.rng.integers(1, 9))):
            text = self._text(int(self.rng.integers(15, 600)))
            kind = self.rng.random()
            end = "" if self.rng.random() < 0.3 else "</p>"
            if kind < 0.7:
                parts.append(f"<p>{text}{end}" if self.rng.random() < 0.8 else f"<p><b>{text}<br>{end}")
            elif kind < 0.8:
                parts.append(f"<h2>{self._short()}</h2>")
            elif kind < 0.9:
                parts.append(f"<ul><li>{self._text(80)}</li><li>{self._text(80)}</li></ul>")
            else:
                parts.append(f"<blockquote>{text}</blockquote>")
        wrappers = ("article", "main", "div class=content", "div id=content", "div class='post entry'", "section class=article-body", "div", "td")
        return self._in("".join(parts), *wrappers)

    def page(self) -> tuple[np.ndarray, np.ndarray]:
        """Vectors and labels of the blocks of a new page."""
        before = [self._beside() for _ in range(int(self.rng.integers(0, 4)))]
        after = [self._beside() for _ in range(int(self.rng.integers(0, 4)))]
        head = self._in(f"<p>{self._short()}</p>", "header", "div class=header", "div id=masthead")
        before = [self._menu(), *before] if self.rng.random() < 0.7 else [head, *before]
        title = f"<head><title>{self._short()}</title></head><body>"
        counts = [len(blocks(x)) for x in (title + "".join(before), self._marked())]
        whole = blocks(title + "".join(before) + self.made + "".join(after))
        y = np.zeros(len(whole), dtype=np.float32)
        y[counts[0] : counts[0] + counts[1]] = 1
        return vectors(whole, {}), y

    def _marked(self) -> str:
        self.made = self._main()
        return self.made


def windows(values: np.ndarray) -> list[np.ndarray]:
    """All values of a page in windows of about equal length."""
    return np.array_split(values, -(-len(values) // WINDOW)) if len(values) else []


def train(pages: list[str], seed: int = 5) -> dict[str, np.ndarray] | None:
    """A labeller from some pages; None if they hold no text."""
    rng = np.random.default_rng(seed)
    found = [blocks(p) for p in pages]
    texts = [t for page in found for t, _, _ in page if len(t) > 30]
    if not texts:
        return None
    rows, labels, known = [], [], {}

    def add(x, y):
        for own, into in ((x, rows), (y, labels)):
            into.extend(windows(own))

    for page in found:
        told = [plainly_main(path) for _, path, _ in page]
        if any(told):
            add(vectors(page, known), np.array([bool(t) for t in told], dtype=np.float32))
    layouts = Layouts(texts, rng)
    for _ in range(LAYOUTS):
        add(*layouts.page())
    return recurrent.train(rows, labels, WIDTH)


def fit(pages: DataFrame, most: int = MOST_PAGES) -> dict[str, np.ndarray] | None:
    """A labeller from at most `most` pages, those of the smallest hash of page_id and html."""
    html = pages.select("page_id", F.col("html").cast("string").alias("html")).where(F.length("html") > 0)
    named = html.select(F.xxhash64("page_id", "html").alias("h"))
    picked = F.broadcast(named.distinct().orderBy("h").limit(most).withColumnRenamed("h", "picked"))
    sample = html.join(picked, F.xxhash64("page_id", "html") == F.col("picked"))
    return train(sorted(r["html"] for r in sample.groupBy("picked").agg(F.min("html").alias("html")).collect()))


def main_text(model, found: list[list], known: dict) -> list[str]:
    """The main text of pages given as blocks."""
    if len(known) > 100_000:
        known.clear()
    marks = recurrent.label(model, [vectors(page, known) for page in found]) if model else [[1.0] * len(page) for page in found]
    return [" ".join(text for (text, _, _), p in zip(page, own) if p >= 0.5) for page, own in zip(found, marks)]


def _extracting(shared, name: str):
    def extract(batches):
        model, known = shared.value, {}
        for batch in pieces(batches, "html"):
            texts = main_text(model, [blocks(h or "") for h in batch.column("html").to_pylist()], known)
            columns = [batch.column(k) for k in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], names=[*batch.schema.names, name])

    return extract


def with_main_text(pages: DataFrame, model, name: str = "text") -> DataFrame:
    """`pages` with a column `name`: the main text of the whole `html`.

    Blocks are joined by one space in page order; null and empty pages, and pages without main
    text, have an empty one.  Without a model (no page with text to learn from) all blocks are
    kept.  A column of that name is replaced; all others and repeated rows stay.
    """
    pages = pages.withColumn("html", F.col("html").cast("string")).drop(name)
    schema = pages.select("*", F.lit("").alias(name)).schema
    return pages.mapInArrow(_extracting(pages.sparkSession.sparkContext.broadcast(model), name), schema)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
