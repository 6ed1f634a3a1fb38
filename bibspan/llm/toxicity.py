"""Toxicity: a subsequence string-kernel SVM with Nyström landmarks over sentences.

The kernel of two strings counts the subsequences of four letters they share, each occurrence
weighted by DECAY for every place skipped, within SPAN places.  A string is a sentence, or a stretch of
a long one; the beginning of a word is a place of its own, which a subsequence may start with or
skip.  So words with letters put in or left out are still alike, also when they are
parted by a space, and sentences are alike that have several such words.  The kernel is not
sized by length: what a sentence holds adds up.

Labels are of documents, so the sentences that made a document toxic have to be found: first
those with words or beginnings of words that toxic documents have far more often, then those that
the machine finds worse than nearly all clean documents.  Two machines find them for each other, each in
the half of the toxic documents that it has not learnt from.  Sentences of clean documents are
clean whatever they hold, and a beginning that toxic documents have over and over and clean
ones by chance still counts for as much as its shares tell.  A document is judged by its worst sentence and
by the sum of its bad ones, those worse than most clean ones, for its length.

With landmarks, the decision is linear in the counts of subsequences: landmarks and their weights
fold into one number per subsequence (by a hash of fixed size), and a sentence is scored by adding these up
at its places.
"""

import math
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibspan.llm.common import PIECE_BYTES, held_out, pieces, worker_state
from bibspan.llm.labelled import label_share, training_rows

# The sample: labelled documents of each class, and sentences kept of all the clean ones.
MOST_DOCUMENTS = 1500
MOST_CLEAN_SENTENCES = 12_000
LANDMARKS = 320
ROUNDS = 2
COST = 1.0
# Sentences worse than this share of the clean ones are bad.
LEVEL = 0.99
# Documents next to each other in the order of their texts that are learnt from, or not, together.
TOGETHER = 8
# The score from which documents count as toxic, and the share of clean documents that may reach it.
DECISION, FALSE_ALARMS = 0.3, 0.005
# What tells: by so many standard deviations more toxic documents, and sentences of them, in at least so many.
TELLING = 2.5
TELLING_AGAIN = 8.0
LEAST_DOCUMENTS = 4
MOST_OF_A_DOCUMENT = 5
# Telling words of at least so many letters are also learnt with a letter or a space put in, so many times.
LEAST_SPOILED = 4
SPOILED = 12
MOST_SPOILED = 2000
DECAY = 0.6
SPAN = 6
# Kernel values that are worked on at once while learning: rows of the landmarks' counts, and sentences.
ROWS_AT_ONCE = 1 << 12
# Longer sentences are cut into stretches of so many words.
WORDS_AT_ONCE = 12
HASH_BITS = 20
# Codes of places: letters from 1 on, the beginning of a word, nothing.
_BEGINS, _NOTHING = 63, 0


def _letter_codes() -> np.ndarray:
    """Codes by code point below U+0250: letters 1-26, letters with accents 27-58, digits 59, others 60-62, 0 for signs."""
    codes = np.zeros(0x250, dtype=np.uint8)
    accented = {}
    for point in range(0x250):
        c = chr(point).lower()[:1]
        if "a" <= c <= "z":
            codes[point] = ord(c) - 96
        elif c.isdigit():
            codes[point] = 59
        elif c.isalpha():
            base = unicodedata.normalize("NFKD", c)[0]
            own = c if 0xDF <= ord(c) <= 0xFF else base
            codes[point] = accented.setdefault(own, 27 + len(accented) % 32) if not "a" <= own <= "z" else ord(own) - 96
    return codes


CODES = _letter_codes()
IS_SPACE = np.zeros(0x250, dtype=bool)
IS_SPACE[[p for p in range(0x250) if chr(p).isspace()]] = True
IS_STOP = np.zeros(0x250, dtype=bool)
IS_STOP[[ord(c) for c in ".!?\n"]] = True


def places(texts: list[str]):
    """Codes of the places of some texts laid end to end, and the sentence and the text of each sentence.

    Signs within words are left out, letters spelled out one by one are one word, a letter that
    comes more than twice in a row comes twice, and a word that comes over and over in a row comes once.  Between texts lie empty places, so that no
    subsequence goes over the end of one.  Returns codes, number of the sentence of each place,
    text of each sentence and words of each sentence.
    """
    points = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    text = np.repeat(np.arange(len(texts)), sizes)[: len(points)]
    low = np.minimum(points, 0x24F)
    wide = points >= 0x250
    code = CODES[low]
    if wide.any():
        letters = np.array([chr(p).isalnum() for p in points[wide].tolist()])
        code = code.copy()
        code[wide] = np.where(letters, 60 + points[wide] % 3, 0)
    space = IS_SPACE[low] & ~wide
    if wide.any():
        space[wide] = [chr(p).isspace() for p in points[wide].tolist()]
    letter = np.flatnonzero(code)
    if not len(letter):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    n_spaces = np.cumsum(space)
    n_stops = np.cumsum(IS_STOP[low] & ~wide)
    codes, own, text = code[letter], n_spaces[letter], text[letter]
    begins = np.concatenate(([True], (own[1:] != own[:-1]) | (text[1:] != text[:-1])))
    once = ~_repeats(codes, begins, text)
    letter, codes, begins, text = letter[once], codes[once], begins[once], text[once]
    word = np.cumsum(begins) - 1
    first = np.flatnonzero(begins)
    of_word = text[first]
    ends = np.append(first[1:], len(codes)) - 1
    # A sentence ends where a full stop is followed by a space before the next word.
    stopped = np.concatenate(([True], (n_stops[letter[first[1:]]] != n_stops[letter[ends[:-1]]]) | (of_word[1:] != of_word[:-1])))
    head = np.maximum.accumulate(np.where(stopped, np.arange(len(first)), 0))
    sentence_of_word = np.cumsum((np.arange(len(first)) - head) % WORDS_AT_ONCE == 0) - 1
    n_words = np.bincount(sentence_of_word)
    of_sentence = of_word[np.flatnonzero(np.diff(sentence_of_word, prepend=-1))]
    # Words of one letter after each other are one word.
    alone = ends == first
    spelled = np.concatenate(([False], alone[1:] & alone[:-1] & (sentence_of_word[1:] == sentence_of_word[:-1])))
    marked = begins.copy()
    marked[first[spelled]] = False
    keep = np.ones(len(codes), dtype=bool)
    same = np.concatenate(([False], (codes[1:] == codes[:-1]) & ~marked[1:]))
    keep[2:] = ~(same[2:] & same[1:-1])
    new_text = np.concatenate(([False], text[1:] != text[:-1]))
    room = keep + marked.astype(np.int64) + new_text * SPAN
    at = np.cumsum(room) - 1
    out = np.zeros(int(at[-1]) + 1 + SPAN, dtype=np.uint8)
    out[at[keep]] = codes[keep]
    out[at[marked] - 1] = _BEGINS
    where = np.zeros(len(out), dtype=np.int64)
    where[at] = sentence_of_word[word]
    where[at[marked] - 1] = sentence_of_word[word[marked]]
    return out, np.maximum.accumulate(where), of_sentence, n_words


def _repeats(codes: np.ndarray, begins: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Marks the letters of words that are the same as the word before them."""
    first, word = np.flatnonzero(begins), np.cumsum(begins) - 1
    power = np.full(64, 0x9E3779B97F4A7C15, dtype=np.uint64)
    power[0] = 1
    power = np.cumprod(power, dtype=np.uint64)
    named = np.add.reduceat((codes.astype(np.uint64) + np.uint64(1)) * power[(np.arange(len(codes)) - first[word]) % 64], first)
    size = np.diff(np.append(first, len(codes)))
    same = (named[1:] == named[:-1]) & (size[1:] == size[:-1]) & (text[first[1:]] == text[first[:-1]])
    return np.concatenate(([False], same))[word]


def subsequences(codes: np.ndarray):
    """Hashes and weights of the subsequences that start at each place but the last ones."""
    n = max(len(codes) - SPAN, 0)
    c = codes.astype(np.uint32)
    inner = np.where(c == _BEGINS, 0, c)
    starts = c[:n]
    for far in range(3, SPAN):
        d = inner[far : far + n]
        for j in range(1, far - 1):
            b = inner[j : j + n]
            for k in range(j + 1, far):
                m = inner[k : k + n]
                number = ((starts * 64 + b) * 64 + m) * 64 + d
                number = (number * np.uint32(2654435761)) >> np.uint32(32 - HASH_BITS)
                number[(starts == 0) | (b == 0) | (m == 0) | (d == 0)] = 0
                yield number, DECAY ** (far - 3)


def decisions(codes: np.ndarray, sentence: np.ndarray, n: int, weights: np.ndarray, bias: float) -> np.ndarray:
    """Values of the machine for sentences."""
    total = np.zeros(max(len(codes) - SPAN, 0), dtype=np.float32)
    for number, weight in subsequences(codes):
        total += np.float32(weight) * weights[number]
    return bias + np.bincount(sentence[: len(total)], total, minlength=n)


def laid(strings: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Strings end to end, an empty stretch after each, and the number of the string of each place."""
    empty = np.zeros(SPAN, np.uint8)
    codes = np.concatenate([empty[:0], *(x for s in strings for x in (s, empty))])
    return codes, np.repeat(np.arange(len(strings)), [len(s) + SPAN for s in strings])


def spoiled(word: np.ndarray, rng) -> np.ndarray:
    """The word with a letter put in, or parted by a space."""
    at = int(rng.integers(2, len(word) - 1))
    new = _BEGINS if rng.random() < 0.4 else int(rng.integers(1, 27))
    return np.concatenate((word[:at], [np.uint8(new)], word[at:])).astype(np.uint8)


def _features(strings: list[np.ndarray]):
    """Subsequences in use in some strings, and their counts as a matrix: one row per string."""
    codes, own = laid(strings)
    found = [(number, own[: len(number)], np.full(len(number), weight)) for number, weight in subsequences(codes)]
    number, row, weight = (np.concatenate(x) for x in zip(*found))
    some = number > 0
    used, column = np.unique(number[some], return_inverse=True)
    table = np.zeros((len(strings), len(used)), dtype=np.float32)
    np.add.at(table, (row[some], column), weight[some])
    return used, table


def _products(codes, sentence, n: int, used: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Kernel values of sentences with the landmarks."""
    slot = np.full(1 << HASH_BITS, -1, dtype=np.int32)
    slot[used] = np.arange(len(used))
    right = np.ascontiguousarray(table.T)
    found = np.zeros((n, len(table)), dtype=np.float32)
    for number, weight in subsequences(codes):
        at = slot[number]
        some = np.flatnonzero(at >= 0)
        for k in range(0, len(some), 1 << 15):
            part = some[k : k + (1 << 15)]
            own = sentence[part]
            first = np.flatnonzero(np.diff(own, prepend=-1))
            # Whole sentences of the part, so many that few rows are held.
            a = 0
            while a < len(first):
                b = max(int(np.searchsorted(first, first[a] + ROWS_AT_ONCE)), a + 1)
                rows = part[first[a] : first[b] if b < len(first) else len(part)]
                found[own[first[a:b]]] += np.float32(weight) * np.add.reduceat(right[at[rows]], first[a:b] - first[a], axis=0)
                a = b
    return found


def svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Weights and bias of a linear machine with squared hinge loss, by Newton steps; the last column of x is all ones."""
    w = np.zeros(x.shape[1])
    ridge = np.ones(x.shape[1])
    ridge[-1] = 1e-3
    for _ in range(rounds):
        grad, hessian = ridge * w, np.diag(ridge)
        for k in range(0, len(x), ROWS_AT_ONCE):
            part = slice(k, k + ROWS_AT_ONCE)
            active = y[part] * (x[part] @ w) < 1
            own, weight = x[part][active], cost[part][active]
            grad -= (weight * (y[part][active] - own @ w)) @ own
            hessian += (own * weight[:, None]).T @ own
        step = np.linalg.solve(hessian, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Model:
    """Weights of subsequences and bias, and what turns the sentences of a document into a score."""

    def __init__(self):
        self.weights, self.bias = np.zeros(1 << HASH_BITS, np.float32), -1.0
        self.level, self.slopes, self.offset = 0.0, np.zeros(2), 0.0

    def plain(self):
        return self.weights, self.bias, self.level, self.slopes, self.offset


class Sentences:
    """Sentences of documents: places, the document of each, and their words; made and decided a piece at a time."""

    def __init__(self, texts: list[str]):
        codes, first, word_at, of_word, document, n_words, self.pieces, self.n, at = [], [], [], [], [], [], [], 0, 0
        start = 0
        while start < len(texts):
            stop, size = start + 1, len(texts[start])
            while stop < len(texts) and size + len(texts[stop]) <= PIECE_BYTES:
                size += len(texts[stop])
                stop += 1
            own = places(texts[start:stop])
            codes.append(own[0])
            first.append(np.flatnonzero(np.diff(own[1], prepend=-1)) + at)
            begins = np.flatnonzero(own[0] == _BEGINS)
            word_at.append(begins + at + 1)
            of_word.append(own[1][begins] + self.n)
            document.append((own[2] + start).astype(np.int32))
            n_words.append(own[3])
            self.pieces.append((at, at + len(own[0]), self.n, self.n + len(own[2])))
            at, self.n, start = at + len(own[0]), self.n + len(own[2]), stop
        whole = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts]).astype(kind)
        self.codes, self.sentence_of_word = whole(codes, np.uint8), whole(of_word, np.int32)
        self.document, self.n_words = whole(document, np.int32), whole(n_words, np.int64)
        self.n_documents = len(texts)
        self.start, self.word_at = whole(first, np.int64), whole(word_at, np.int64)
        self.stop = np.append(self.start[1:], len(self.codes))
        ends = np.flatnonzero((self.codes == _BEGINS) | (self.codes == _NOTHING))
        self.word_size = ends[np.searchsorted(ends, self.word_at)] - self.word_at if len(self.word_at) else self.word_at

    def string(self, k: int) -> np.ndarray:
        return np.trim_zeros(self.codes[self.start[k] : self.stop[k]], "b")

    def word(self, k: int, most: int = 1 << 20) -> bytes:
        at = self.word_at[k]
        return self.codes[at : at + min(self.word_size[k], most)].tobytes()

    def some(self, chosen: np.ndarray):
        """Places of some sentences only, with their new numbers; an empty stretch after each."""
        return laid([self.string(int(k)) for k in chosen])

    def decided(self, weights, bias) -> np.ndarray:
        sizes = self.stop[: self.n] - self.start
        found = [
            decisions(self.codes[a:b], np.repeat(np.arange(last - first), sizes[first:last]), last - first, weights, bias)
            for a, b, first, last in self.pieces
        ]
        return np.concatenate([np.zeros(0), *found])

    def parts(self):
        """For whole words and their first 4 and 5 letters, one after another: the part's number, and the sentence it is in, once each."""
        power = np.cumprod(np.append(np.uint64(1), np.full(63, 0x9E3779B97F4A7C15, np.uint64)), dtype=np.uint64)
        own = self.sentence_of_word
        for most in PARTS:
            named = np.full(len(self.word_at), most, dtype=np.uint64)
            for k in range(min(most, int(self.word_size.max(initial=0)), 64)):
                held = np.flatnonzero(self.word_size > k)
                named[held] += (self.codes[self.word_at[held] + k].astype(np.uint64) + np.uint64(1)) * power[k] * np.uint64(1000003)
            yield named, own


PARTS = (64, 4, 5)


def _counted(part: np.ndarray, sentence: np.ndarray, document: np.ndarray):
    """Distinct parts, in how many documents each is, and in how many sentences, at most MOST_OF_A_DOCUMENT of each."""
    order = np.lexsort((sentence, part))
    part, sentence = part[order], sentence[order]
    first = np.concatenate(([True], (part[1:] != part[:-1]) | (sentence[1:] != sentence[:-1])))[: len(part)]
    part, own = part[first], document[sentence[first]]
    new = np.flatnonzero(np.concatenate(([True], (part[1:] != part[:-1]) | (own[1:] != own[:-1])))[: len(part)])
    times = np.minimum(np.diff(np.append(new, len(part))), MOST_OF_A_DOCUMENT)
    distinct, at, documents = np.unique(part[new], return_inverse=True, return_counts=True)
    return distinct, documents, np.bincount(at, times, minlength=len(distinct))


def _telling(bad, clean, n_bad: int, n_clean: int) -> tuple[np.ndarray, np.ndarray]:
    """Parts that toxic documents have more often, and over and over, ascending, with by how many standard deviations.

    Parts of a few documents only say nothing of others.
    """
    part, documents, times = bad
    at = np.minimum(np.searchsorted(clean[0], part), max(len(clean[0]) - 1, 0))
    known = clean[0][at] == part if len(clean[0]) else np.zeros(len(part), bool)
    ratio = max(n_bad, 1) / max(n_clean, 1)

    def beyond(own, other):
        expected = ratio * np.where(known, other[at] if len(other) else 0, 0)
        return (own - expected) / np.sqrt(expected + 1)

    z = beyond(times, clean[2])
    some = (documents >= LEAST_DOCUMENTS) & (beyond(documents, clean[1]) >= TELLING) & (z >= TELLING_AGAIN)
    return part[some], z[some]


def _landmarks(telling: list[bytes], bad: Sentences, reasons: np.ndarray, clean: Sentences, rng) -> list[np.ndarray]:
    """The most telling words and beginnings, words of bad sentences, and words of clean ones."""
    marks = telling[: LANDMARKS // 2]
    of_reasons = np.flatnonzero(np.isin(bad.sentence_of_word, reasons))
    for source, chosen in ((bad, of_reasons), (clean, np.arange(len(clean.word_at)))):
        marks = marks + [source.word(int(k)) for k in rng.permutation(chosen)[: LANDMARKS // 4]]
    return [np.frombuffer(bytes([_BEGINS]) + m, np.uint8) for m in dict.fromkeys(marks)]


def _machine(marks: list[np.ndarray], bad: Sentences, reasons: np.ndarray, clean: Sentences, negative: np.ndarray, spoilt=()):
    """Weights of subsequences and bias of the machine that parts bad sentences, and spoilt words, from clean ones."""
    used, table = _features(marks)
    values, vectors = np.linalg.eigh((table @ table.T).astype(np.float64))
    strong = values > values.max() * 1e-6
    root = vectors[:, strong] / np.sqrt(values[strong])
    # All is laid into one matrix, as several of that size would be the most that learning holds.
    x, at = np.ones((len(reasons) + len(spoilt) + len(negative), root.shape[1] + 1)), 0
    for strings, n in ((lambda: bad.some(reasons), len(reasons)), (lambda: laid(list(spoilt)), len(spoilt)), (lambda: clean.some(negative), len(negative))):
        found = _products(*strings(), n, used, table)
        for k in range(0, n, ROWS_AT_ONCE):
            x[at : at + min(n - k, ROWS_AT_ONCE), :-1] = found[k : k + ROWS_AT_ONCE] @ root
            at += min(n - k, ROWS_AT_ONCE)
        del found
    y = np.concatenate([np.ones(len(reasons) + len(spoilt)), -np.ones(len(negative))])
    shares = [np.full(n, len(negative) / max(n, 1) / 4) for n in (len(reasons), len(spoilt))]
    cost = np.concatenate([*shares, np.ones(len(negative))]) * COST
    w = svm(x, y, cost)
    weights = np.zeros(1 << HASH_BITS, np.float32)
    weights[used] = table.T @ (root @ w[:-1])
    weights[0] = 0
    return weights, float(w[-1])


def _spoilt_words(telling: list[bytes], part: np.ndarray, of_clean: np.ndarray, bad: Sentences, rng) -> list[np.ndarray]:
    """Telling words that no clean document has, with a letter or a space put in."""
    unknown = np.flatnonzero(~np.isin(part, of_clean))
    insults = sorted({bad.word(int(k)) + b"\0" for k in unknown} & set(telling))
    insults = [w[:-1] for w in insults if len(w) > LEAST_SPOILED]
    return [spoiled(np.frombuffer(bytes([_BEGINS]) + w, np.uint8), rng) for w in insults * SPOILED][:MOST_SPOILED]


def judged(values: np.ndarray, document: np.ndarray, n_words: np.ndarray, n: int, level: float) -> np.ndarray:
    """How far the worst sentence of each document is beyond the level, and all that are, for its length."""
    worst = np.zeros(n)
    np.maximum.at(worst, document, np.minimum(values - level, 3))
    total = np.bincount(document, np.maximum(values - level, 0), minlength=n)
    words = np.bincount(document, n_words, minlength=n)
    dense = np.sqrt(total * WORDS_AT_ONCE / np.maximum(words, WORDS_AT_ONCE))
    return np.stack([worst, dense], axis=1)


def train(texts: list[str], labels: list[int], share: float, seed: int = 7) -> Model:
    """Fit on documents; a quarter of them only sets how sentences become scores."""
    model, rng = Model(), np.random.default_rng(seed)
    toxic = np.array(labels, dtype=bool)
    # Sorted texts in stretches, so that copies are on one side.
    order = np.argsort(np.array(texts, dtype=object), kind="stable")
    stretch = np.empty(len(texts), dtype=np.int64)
    stretch[order] = np.arange(len(texts)) // TOGETHER
    held = stretch % 4 == 0
    bad, clean = (Sentences([texts[k] for k in np.flatnonzero((toxic == kind) & ~held)]) for kind in (True, False))
    if not bad.n or not clean.n:
        model.offset = math.log(max(share, 1e-3) / max(1 - share, 1e-3))
        return model
    counted = [_counted(*own, clean.document) for own in clean.parts()]
    parts = list(bad.parts())
    halves = [np.flatnonzero(bad.document // TOGETHER % 2 == k) for k in (0, 1)] if bad.n_documents > TOGETHER else [np.arange(bad.n)] * 2

    def telling_of(chosen: np.ndarray) -> list[bytes]:
        """Telling words (with a zero at the end) and beginnings of some of the toxic sentences' documents, the most telling first."""
        found = {}
        n = len(np.unique(bad.document[chosen]))
        for (part, own), of_clean, most in zip(parts, counted, PARTS):
            inside = np.isin(own, chosen)
            names, z = _telling(_counted(part[inside], own[inside], bad.document), of_clean, n, clean.n_documents)
            for name, by in zip(names, z):
                text = bad.word(int(np.flatnonzero(part == name)[0]), most) + (b"\0" if most == PARTS[0] else b"")
                found[text] = max(by, found.get(text, 0.0))
        return sorted(found, key=lambda t: (-found[t], t))

    def holding(side: Sentences, telling: list[bytes]) -> np.ndarray:
        """Sentences with a telling word or beginning."""
        wanted = set(telling)
        held = [k for k in range(len(side.word_at)) if side.word(k) + b"\0" in wanted or side.word(k, 4) in wanted or side.word(k, 5) in wanted]
        return np.unique(side.sentence_of_word[np.array(held, dtype=np.int64)]).astype(np.int64)

    both = telling_of(np.arange(bad.n))
    telling = [list(dict.fromkeys(both + telling_of(h))) for h in halves]
    # A half's first reasons are told by what the other half has more often, or all documents by far.
    first = [np.intersect1d(holding(bad, telling[1 - k]), halves[k]) for k in (0, 1)]
    hard = [rng.permutation(holding(clean, t))[: MOST_CLEAN_SENTENCES // 8] for t in telling]
    negative = np.unique(np.concatenate([rng.permutation(clean.n)[: MOST_CLEAN_SENTENCES // 2], *hard]))
    marks_of = [[t.removesuffix(b"\0") for t in own] for own in telling]
    reasons = first
    for _ in range(ROUNDS):
        machines = [
            _machine(_landmarks(marks_of[1 - k], bad, reasons[k], clean, rng), bad, reasons[k], clean, negative) if len(reasons[k]) else None
            for k in (0, 1)
        ]
        found = list(first)
        for k in (0, 1):
            if machines[k] is None:
                continue
            values = clean.decided(*machines[k])
            most = np.full(clean.n_documents, machines[k][1])
            np.maximum.at(most, clean.document, values)
            limit = max(0.0, float(np.quantile(most, 0.98)))
            of_bad = bad.decided(*machines[k])
            found[1 - k] = np.union1d(first[1 - k], halves[1 - k][of_bad[halves[1 - k]] > limit])
            negative = np.union1d(negative, np.argsort(-values)[: MOST_CLEAN_SENTENCES // (4 * ROUNDS)])
        reasons = found
    every = np.union1d(*reasons)
    if len(every):
        spoilt = _spoilt_words(both, parts[0][0], counted[0][0], bad, rng)
        model.weights, model.bias = _machine(_landmarks([t.removesuffix(b"\0") for t in both], bad, every, clean, rng), bad, every, clean, negative, spoilt)
    del bad, clean, parts, counted
    others = Sentences([texts[k] for k in np.flatnonzero(held)])
    values = others.decided(model.weights, model.bias)
    of_clean = values[~toxic[held][others.document]]
    model.level = max(float(np.quantile(of_clean, LEVEL)), -0.5) if len(of_clean) else 0.0
    x = judged(values, others.document, others.n_words, others.n_documents, model.level)
    model.slopes, model.offset = scaled(x, toxic[held].astype(int), share)
    if (~toxic[held]).any():
        # Few clean documents may reach the score at which documents count as toxic.
        reached = float(np.quantile(x[~toxic[held]] @ model.slopes, 1 - FALSE_ALARMS, method="lower"))
        model.offset = min(model.offset, math.log(DECISION / (1 - DECISION)) - reached - 1e-3)
    return model


def scaled(values: np.ndarray, labels: np.ndarray, share: float) -> tuple[np.ndarray, float]:
    """Slopes, none below 0, and offset of the logistic curve through values, for a share of label 1 in the corpus."""
    ones = max(int(labels.sum()), 1)
    weight = np.where(labels == 1, share / ones, (1 - share) / max(len(labels) - ones, 1)) * len(labels)
    x = np.hstack([values, np.ones((len(values), 1))])
    slopes, used = np.zeros(x.shape[1]), list(range(x.shape[1]))
    while True:
        own, w = x[:, used], np.zeros(len(used))
        ridge = np.append(np.full(len(used) - 1, 1e-2), 1e-4)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(own @ w, -30, 30)))
            hessian = (own * (weight * p * (1 - p))[:, None]).T @ own + np.diag(ridge)
            w -= np.linalg.solve(hessian, own.T @ (weight * (p - labels)) + ridge * w)
        if len(used) == 1 or w[:-1].min() >= 0:
            slopes[used] = w
            return slopes[:-1], float(slopes[-1])
        used.pop(int(np.argmin(w[:-1])))


def scores(texts: list[str], model: tuple) -> np.ndarray:
    """Scores of whole texts."""
    weights, bias, level, slopes, offset = model
    codes, sentence, own, n_words = places(texts)
    values = decisions(codes, sentence, len(own), weights, bias)
    x = judged(values, own, n_words, len(texts), level)
    return 1 / (1 + np.exp(-np.clip(x @ slopes + offset, -30, 30)))


def _scoring(shared, name: str):
    def score(batches):
        worker_state("toxicity/none")
        model = shared.value
        for batch in pieces(batches):
            found = scores([t or "" for t in batch.column("text").to_pylist()], model)
            columns = [batch.column(k) for k in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found)], names=[*batch.schema.names, name])

    return score


def _training(share: float):
    def fitted(batches):
        worker_state("toxicity/none")
        rows = sorted(
            (text or "", label)
            for batch in batches
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist())
        )
        weights, bias, level, slopes, offset = train([t for t, _ in rows], [y for _, y in rows], share).plain()
        yield pa.RecordBatch.from_pydict({"weights": [weights.tobytes()], "others": [[bias, level, offset, *slopes.tolist()]]})

    return fitted


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_DOCUMENTS) -> Model:
    """A model of `labels.toxic`, from at most `most` documents of each class outside the held-out quarter.

    Without a toxic or a clean document the score is the share of toxic labels everywhere.  A task learns from the
    sample, so the driver holds neither texts nor what learning takes, only the weights.
    """
    share = label_share(labels, "toxic")
    sample = training_rows(docs, labels, "toxic", most).repartition(1)
    learnt = sample.mapInArrow(_training(share), "weights binary, others array<double>").first()
    if learnt is None:
        return train([], [], share)
    model = Model()
    model.weights = np.frombuffer(learnt["weights"], np.float32)
    model.bias, model.level, model.offset, *slopes = learnt["others"]
    model.slopes = np.array(slopes)
    return model


def with_toxicity(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """`docs` with a column `name`: how likely the whole `text` is toxic, from 0 to 1.

    Only the text counts.  Null and empty texts have the score of a text without toxic sentences.
    A column of that name is replaced; all others and repeated rows stay as they are.
    """
    docs = docs.drop(name)
    shared = docs.sparkSession.sparkContext.broadcast(model.plain())
    schema = docs.select("*", F.lit(0.0).alias(name)).schema
    return docs.mapInArrow(_scoring(shared, name), schema)


def predicted(docs: DataFrame, threshold: float) -> DataFrame:
    """doc_id, held_out, score and the decision at a threshold."""
    return docs.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


cloudpickle.register_pickle_by_value(sys.modules[__name__])
