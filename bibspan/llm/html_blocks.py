"""Pages cut into blocks of text, each with its tag path and the vector a labeller reads."""

import html
import re
import sys
import zlib
from collections.abc import Sequence

import numpy as np
from pyspark import cloudpickle

INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ATTRIBUTES = r"(?:\"[^\"]*\"|'[^']*'|[^>\"'])*"
_UNREAD = r"<!--.*?(?:-->|\Z)|<(script|style)(?=[\s/>])[^>]*>.*?(?:</\1(?=[\s/>])[^>]*>|\Z)"
_PART = re.compile(rf"{_UNREAD}|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)({_ATTRIBUTES})>|</?[a-zA-Z][^>]*>", re.DOTALL | re.IGNORECASE)
#: Elements whose inside is no text of the page, if they end.
SKIPPED = frozenset("template svg iframe canvas audio video".split())
#: What cannot be inside of svg, other than in foreignObject, and ends it.
_LEAVES_SVG = "blockquote|body|center|dd|div|dl|dt|embed|h[1-6]|head|hr|img|li|main|article|section|nav|aside|header|footer|menu|ol|p|pre|table|ul"
_HIDING = re.compile(
    rf"{_UNREAD}|<(/?)({'|'.join(sorted(SKIPPED))}|foreignobject|{_LEAVES_SVG})(?=[\s/>])({_ATTRIBUTES})>", re.DOTALL | re.IGNORECASE
)
_HIDES = re.compile(rf"<(?:{'|'.join(sorted(SKIPPED))})[\s/>]", re.IGNORECASE)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
#: What the start of an element ends, if that is the innermost open one of its kind.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
         "option": {"option"}, "body": {"head"}}
_SCOPE = frozenset("ul ol dl table article section main div body nav aside header footer form".split())

PATH_WIDTH, WORD_WIDTH, NUMBERS, NEAR = 64, 64, 9, 8
WIDTH = 2 * PATH_WIDTH + WORD_WIDTH + NUMBERS


class Path(Sequence):
    """Open elements from the outermost on, as (tag, words of class, id and role); inner paths share the outer ones."""

    __slots__ = ("outer", "last", "size", "sums", "row")

    def __init__(self, outer: "Path | None" = None, last: tuple | None = None):
        self.outer, self.last, self.sums, self.row = outer, last, None, None
        self.size = outer.size + 1 if outer is not None else 0

    def __len__(self):
        return self.size

    def __reversed__(self):
        while self.size:
            yield self.last
            self = self.outer

    def __iter__(self):
        return iter(list(reversed(self))[::-1])

    def __getitem__(self, k):
        if k == -1 and self.size:
            return self.last
        return tuple(self)[k]

    def __eq__(self, other):
        return tuple(self) == tuple(other)

    def __hash__(self):
        return hash(tuple(self))


def _opened(stack: list, tag: str) -> None:
    """Close what the start of a block element ends: a paragraph, and items or cells of its own list or row."""
    if stack and stack[-1][0] == "p":
        stack.pop()
    ends = _ENDS.get(tag, ())
    for k in range(len(stack) - 1, -1, -1):
        if stack[k][0] in ends:
            del stack[k:]
            break
        if stack[k][0] in _SCOPE:
            break


def _hidden(page: str) -> dict[int, int]:
    """Where elements start whose inside is skipped, and where the page goes on: each start with its own end only."""
    found: dict[int, int] = {}
    if not _HIDES.search(page):
        return found
    started: dict[str, list[int]] = {tag: [] for tag in (*SKIPPED, "foreignobject")}
    for part in _HIDING.finditer(page):
        if not part[3]:
            continue
        tag = part[3].lower()
        own = started.get(tag)
        if own is None:
            svg, foreign = started["svg"], started["foreignobject"]
            while svg and not part[2] and (not foreign or svg[-1] > foreign[-1]):
                found[svg.pop()] = part.start()
        elif part[2]:
            if own:
                found[own.pop()] = part.end()
        elif not (tag == "svg" and part[4].endswith("/")):
            own.append(part.start())
    return found


def blocks(page: str) -> list[tuple[str, Path, float]]:
    """Blocks in page order: text, path of (tag, words of class, id and role), share of link text.

    Markup need not be well formed: paragraphs, items and cells end where the next begins,
    ends without a start are ignored, elements that never end reach to the end of the page.
    """
    found, stack, held, linked, in_link, at = [], [], [], 0, 0, 0
    paths = [Path()]

    def flush():
        nonlocal linked, in_link
        text = _SPACE.sub(" ", html.unescape("".join(held))).strip()
        if text:
            found.append((text, paths[-1], min(linked / max(len(text), 1), 1.0)))
        held.clear()
        linked = 0

    def keep(text):
        nonlocal linked
        if text:
            held.append(text)
            linked += len(text) if in_link else 0

    hidden = _hidden(page)
    for part in _PART.finditer(page):
        if part.start() < at:
            continue
        keep(page[at : part.start()])
        at = part.end()
        if not part[3]:
            continue
        tag = part[3].lower()
        if tag in SKIPPED and (part[2] or part.start() in hidden or tag == "svg" and part[4].endswith("/")):
            at = hidden.get(part.start(), at)
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if part[2] else 1
            elif tag == "br":
                held.append(" ")
            continue
        flush()
        in_link = 0
        if part[2]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            del paths[len(stack) + 1 :]
        else:
            _opened(stack, tag)
            del paths[len(stack) + 1 :]
            if tag not in VOID:
                names = " ".join(a or b or c for a, b, c in _NAMES.findall(part[4])) if part[4] else ""
                stack.append((tag, tuple(_WORD.findall(names.lower()))))
                paths.append(Path(paths[-1], stack[-1]))
    keep(page[at:])
    flush()
    return found


def _spot(name: str, width: int) -> tuple[int, float]:
    code = zlib.crc32(name.encode())
    return code % width, 1.0 if code & 0x10000 else -1.0


def _own(element: tuple, known: dict) -> np.ndarray:
    """Hashed tag and names of one element."""
    row = known.get(element)
    if row is None:
        row = known[element] = np.zeros(PATH_WIDTH, dtype=np.float32)
        for name in (f"<{element[0]}", *element[1]):
            spot, sign = _spot(name, PATH_WIDTH)
            row[spot] += sign
    return row


def _path_row(path: Path, known: dict) -> np.ndarray:
    """Hashed elements of a path: sums over the innermost few, and damped sums over all of them."""
    if path.row is None:
        new = []
        at = path
        while at.sums is None and at.size:
            new.append(at)
            at = at.outer
        for inner in reversed(new):
            outer = inner.outer.sums if inner.outer.size else 0
            inner.sums = outer + _own(inner.last, known)
        near = np.zeros(PATH_WIDTH, dtype=np.float32)
        for element, _ in zip(reversed(path), range(NEAR)):
            near += _own(element, known)
        if path.size:
            spot, sign = _spot(f"last <{path.last[0]}", PATH_WIDTH)
            near[spot] += sign
        every = path.sums if path.size else np.zeros(PATH_WIDTH, dtype=np.float32)
        path.row = np.concatenate([near, np.sign(every) * np.log2(1 + np.abs(every))])
    return path.row


def _word(word: str, known: dict) -> int:
    code = known.get(word)
    if code is None:
        spot, sign = _spot(word, WORD_WIDTH)
        code = known[word] = spot if sign > 0 else spot + WORD_WIDTH
    return code


def vectors(found: list[tuple[str, Path, float]], known: dict) -> np.ndarray:
    """A row per block: hashed tag path, all words hashed, and numbers about its text and place."""
    rows = np.zeros((len(found), WIDTH), dtype=np.float32)
    for k, (text, path, linked) in enumerate(found):
        rows[k, : 2 * PATH_WIDTH] = _path_row(path, known)
        words = text.lower().split()
        counts = np.bincount([_word(w, known) for w in words], minlength=2 * WORD_WIDTH) if words else np.zeros(2 * WORD_WIDTH)
        rows[k, 2 * PATH_WIDTH : -NUMBERS] = (counts[:WORD_WIDTH] - counts[WORD_WIDTH:]) / max(len(words), 1) ** 0.5
        n = len(text)
        rows[k, -NUMBERS:] = (
            np.log1p(n) / 5, np.log1p(len(words)) / 4, linked, text[-1] in ".!?…", sum(map(text.count, ".,;")) / max(len(words), 1),
            text[:1].isupper(), n / max(len(words), 1) / 10, k / max(len(found), 1), 1.0,
        )
    return rows


cloudpickle.register_pickle_by_value(sys.modules[__name__])
