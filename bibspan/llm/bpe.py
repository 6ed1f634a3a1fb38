"""BPE encoding and decoding with forced boundaries.

A pair of bytes that stands inside no token of the vocabulary is never merged, so a text
may be cut there and the fragments encoded one by one: their ids, one after another, are
the ids of the text.  White space is such a cut everywhere.  Fragments repeat, so a worker
remembers the ids of those it has met and cuts only new ones at the other forced pairs, words and
signs alike, whatever their length; the pieces are given to the tokenizers library, many at a time.
"""

import json
import os
import re
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from bibspan.llm.common import pieces, worker_state

# Fragments and words a worker remembers, and bytes of their texts; beyond that it starts anew.
REMEMBERED_FRAGMENTS = 100_000
REMEMBERED_WORDS = 200_000
REMEMBERED_BYTES = 8 << 20
LATIN = "[A-Za-zÀ-ÖØ-öø-ÿ]"
SIGN = "[!-/:-@\\[-`{-~]"
_ASCII_SPACE = re.compile(r"[ \t\n\r\x0b\x0c]+")
# White space for Python only, so no place to cut.
_UNCLEAR = re.compile(r"[\x1c-\x1f]")


def byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies.

    Printable bytes of Latin-1 stand for themselves, the others, in order, for the
    characters from U+0100 on.
    """
    own = {b for first, last in (("!", "~"), ("¡", "¬"), ("®", "ÿ")) for b in range(ord(first), ord(last) + 1)}
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def load(text: str):
    """A tokenizer of the library from its JSON, without truncation, padding and threads."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(text)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class Words:
    """Ids of single words, many at a time: a tokenizer of the same merges that only parts at spaces.

    The words of a line are told apart by their tokens: the last of a word has the suffix of
    the vocabulary or, in one without, the first has the space before the word.
    """

    def __init__(self, spec: dict):
        own = json.loads(json.dumps(spec)) | {"normalizer": None, "added_tokens": [], "post_processor": None}
        self.tokenizer = load(json.dumps(own | {"pre_tokenizer": {"type": "WhitespaceSplit"}}))
        letter = {b: c for c, b in byte_alphabet().items()}
        self.letters = {code: "".join(letter[b] for b in chr(code).encode()) for code in range(256)}
        suffix, vocabulary = spec["model"]["end_of_word_suffix"], spec["model"]["vocab"]
        self.is_edge = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        marked = (lambda t: t.endswith(suffix)) if suffix else (lambda t: t.startswith(letter[32]))
        self.is_edge[[k for t, k in vocabulary.items() if marked(t)]] = True
        self.last = bool(suffix)

    def encode(self, words: list[str], at_once: int = 500) -> list[bytes]:
        """Ids of words of Latin-1 letters; a space before them belongs to them."""
        groups = [words[k : k + at_once] for k in range(0, len(words), at_once)]
        # In a vocabulary without suffix every word has a space before it, which is a letter of its own there.
        letters, between = (self.letters | {32: " "}, " ") if self.last else (self.letters | {10: " "}, "\n")
        lines = [between.join(group).translate(letters) for group in groups]
        found = []
        for group, line in zip(groups, self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)):
            ids = np.array(line.ids, dtype=np.uint16)
            edges = np.flatnonzero(self.is_edge[ids])
            cuts = (edges + 1) * 2 if self.last else np.append(edges[1:], len(ids)) * 2
            if len(cuts) != len(group):
                raise ValueError("a word was parted or lost")
            raw, start = ids.tobytes(), 0
            for stop in cuts.tolist():
                found.append(raw[start:stop])
                start = stop
        return found


class FragmentBpe:
    """Encodes fragment by fragment, with a memory of fragments and one of their words."""

    simple: re.Pattern  # fragments of one word
    remembered = REMEMBERED_FRAGMENTS

    def __init__(self, text: str):
        spec = json.loads(text)
        self.whole = load(text)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.suffix = spec["model"]["end_of_word_suffix"] or ""
        self.joined = self._joined(spec["model"]["vocab"])
        self.words = Words(spec)
        self.ids: dict[str, bytes] = {}
        self.word_ids: dict[str, bytes] = {}
        self.learnt = 0

    def _joined(self, vocabulary) -> set[tuple[int, int]]:
        """Pairs of bytes that stand next to each other inside some token."""
        alphabet, found = byte_alphabet(), set()
        for token in vocabulary:
            raw = [alphabet[c] for c in (token.removesuffix(self.suffix) if self.suffix else token)]
            found.update(zip(raw, raw[1:]))
        return found

    def _learn(self, fragments: list[str]) -> None:
        parted, rest = {}, []
        simple = self.simple.fullmatch
        has_special = re.compile("|".join(map(re.escape, self.special))).search if self.special else None
        for fragment in fragments:
            found = simple(fragment)
            if found and not (has_special and has_special(fragment)):
                parted[fragment] = self.normal(found[1]), found[2]
            else:
                rest.append(fragment)
        new = list({word for word, _ in parted.values()}.difference(self.word_ids))
        self.word_ids.update(zip(new, self._words(new)))
        for signs in {signs for _, signs in parted.values() if signs}.difference(self.word_ids):
            self.word_ids[signs] = self._library(signs)
        for fragment, (word, signs) in parted.items():
            self.ids[fragment] = self.word_ids[word] + (self.word_ids[signs] if signs else b"")
        for fragment in rest:
            self.ids[fragment] = self.fragment(fragment)

    def _words(self, words: list[str]) -> list[bytes]:
        return self.words.encode(words)

    def _library(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype=np.uint16).tobytes()

    def normal(self, word: str) -> str:
        return word

    def fragment(self, fragment: str) -> bytes:
        return self._library(fragment)

    def fragments(self, text: str) -> list[str] | None:
        """The text cut at white space, or None if its white space is not clear."""
        raise NotImplementedError

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of some texts; what is new in any of them is learnt at once."""
        if len(self.ids) > self.remembered or len(self.word_ids) > REMEMBERED_WORDS or self.learnt > REMEMBERED_BYTES:
            self.forget()
        cut, found, new = [self.fragments(text) for text in texts], [], set()
        for own in cut:
            ids = list(map(self.ids.get, own or ()))
            if None in ids:
                new.update([fragment for fragment, known in zip(own, ids) if known is None])
            found.append(ids)
        if new:
            self.learnt += sum(map(len, new))
            self._learn(list(new))
            # What was known is not looked up again.
            for own, ids in zip(cut, found):
                if None in ids:
                    ids[:] = [self.ids[fragment] if known is None else known for fragment, known in zip(own, ids)]
        raw = [self._library(text) if own is None else b"".join(ids) for text, own, ids in zip(texts, cut, found)]
        return [np.frombuffer(x, dtype=np.uint16) for x in raw]

    def forget(self) -> None:
        self.ids.clear()
        self.word_ids.clear()
        self.learnt = 0

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]


class WordBpe(FragmentBpe):
    """A vocabulary of lower-case words that end in a suffix; white space is dropped."""

    simple = re.compile(f"({LATIN}+)({SIGN}*)")

    def __init__(self, text: str):
        super().__init__(text)
        # The same merges without the mark of a word's end, for what stands before a cut inside a word.
        spec = json.loads(text)
        spec["model"]["end_of_word_suffix"] = None
        spec["added_tokens"], spec["post_processor"] = [], None
        spec["normalizer"], spec["pre_tokenizer"] = None, {"type": "WhitespaceSplit"}
        self.inner = load(json.dumps(spec))
        self.heads: dict[str, bytes] = {}
        self.cuts = self._cuts()

    def _cuts(self) -> re.Pattern:
        """The places between two lower-case letters whose bytes stand next to each other in no token."""
        letters = [c for c in map(chr, range(256)) if re.fullmatch(LATIN, c) and c == c.lower()]
        ways = []
        self.apart = np.zeros((256, 256), dtype=bool)
        for a in letters:
            apart = "".join(b for b in letters if (a.encode()[-1], b.encode()[0]) not in self.joined)
            self.apart[ord(a), [ord(b) for b in apart]] = True
            if apart:
                ways.append(f"(?<={a})(?=[{apart}])")
        return re.compile("|".join(ways) or r"(?!)")

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words of lower-case Latin letters, each cut at its forced pairs."""
        # All pairs of letters are looked up at once; only words that have a forced pair are cut one by one.
        codes = np.frombuffer(" ".join(words).encode("latin-1"), np.uint8)
        at = np.flatnonzero(self.apart[codes[:-1], codes[1:]])
        cut = set(np.searchsorted(np.flatnonzero(codes == 32), at).tolist())
        parts = [self.cuts.split(word) if k in cut else [word] for k, word in enumerate(words)]
        tails = list({p[-1] for p in parts}.difference(self.word_ids))
        known = dict(zip(tails, self.words.encode(tails)))
        self._learn_heads({h for p in parts for h in p[:-1]})
        found = []
        for p in parts:
            tail = known[p[-1]] if p[-1] in known else self.word_ids[p[-1]]
            found.append(b"".join(map(self.heads.__getitem__, p[:-1])) + tail if len(p) > 1 else tail)
        return found

    def _learn_heads(self, heads: set[str]) -> None:
        new = list(heads.difference(self.heads))
        lines = [head.translate(self.words.letters) for head in new]
        for head, found in zip(new, self.inner.encode_batch_fast(lines, add_special_tokens=False) if new else []):
            self.heads[head] = np.array(found.ids, dtype=np.uint16).tobytes()

    def forget(self) -> None:
        super().forget()
        self.heads.clear()

    def normal(self, word: str) -> str:
        return word.lower()

    def fragments(self, text: str) -> list[str] | None:
        if any(" " in s for s in self.special):
            return None
        return [f for f in _ASCII_SPACE.split(text) if f] if _UNCLEAR.search(text) else text.split()

    def fragment(self, fragment: str) -> bytes:
        if any(s in fragment for s in self.special):
            return self._library(fragment)
        parts = self.forced(fragment)
        self._learn_heads({part.lower() for part, goes_on in parts if goes_on})
        return b"".join(self.heads[part.lower()] if goes_on else self._remembered(part) for part, goes_on in parts)

    def _remembered(self, part: str) -> bytes:
        """Ids of a piece that ends a word or a run of signs."""
        if part not in self.word_ids:
            self.word_ids[part] = self._library(part)
        return self.word_ids[part]

    def forced(self, fragment: str) -> list[tuple[str, bool]]:
        """Cuts of one fragment at forced pairs, each with a flag: its word goes on.

        Only cuts between ASCII characters with nothing but ASCII next to them are taken,
        as lower case and normal form of others can depend on their neighbours, and only
        where a word ends or among letters or among signs alone.  Apostrophes begin words
        after letters only, so one after a sign is not parted from it.
        """
        parts, start = [], 0
        for k in range(1, len(fragment)):
            a, b = fragment[k - 1], fragment[k]
            if fragment[k - 1 : k + 2].isascii() and self._kind(a) != self._kind(b) and self._apart(a, b) and b != "'":
                parts.append(fragment[start:k])
                start = k
        return [x for part in [*parts, fragment[start:]] for x in self._inside(part)]

    def _inside(self, part: str) -> list[tuple[str, bool]]:
        alone = part.isascii() and "'" not in part and len({self._kind(c) for c in part}) == 1 and not part.isdigit()
        cuts = [k for k in range(1, len(part)) if self._apart(part[k - 1], part[k])] if alone else []
        return [(part[a:b], b < len(part)) for a, b in zip([0, *cuts], [*cuts, len(part)])]

    def _kind(self, c: str) -> str:
        return "letter" if c.isalpha() else "digit" if c.isdigit() else "sign"

    def _apart(self, a: str, b: str) -> bool:
        return (ord(a.lower()), ord(b.lower())) not in self.joined


class ByteBpe(FragmentBpe):
    """A byte-level vocabulary in which a space belongs to the word after it.

    Texts of ASCII and Latin letters are cut into the pieces that the vocabulary's published
    pattern parts, between which nothing is merged; other texts are left to the library whole.
    Many texts are cut at once, by the kinds of neighbouring bytes, and only the different
    pieces among them are looked up.
    """

    simple = re.compile(f" {LATIN}+")
    remembered = 6 * REMEMBERED_FRAGMENTS
    pieces = re.compile(
        rf" ?{LATIN}+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^\s0-9{LATIN[1:]}+|\s+(?!\S)|\s+"
    )
    unclear = re.compile(f"[^\t\n\r -~{LATIN[1:]}")

    def fragments(self, text: str) -> list[str] | None:
        if self.unclear.search(text) or any(s in text for s in self.special):
            return None
        return self.pieces.findall(text)

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of some texts; what is new in any of them is learnt at once."""
        if len(self.ids) > self.remembered or self.learnt > REMEMBERED_BYTES:
            self.forget()
        own = [text.encode() for text in texts]
        special = [s.encode() for s in self.special]
        raw, ends = _laid_out(own)
        clear = ~_any_within(_unclear_bytes(raw), ends)
        if any(s in raw.tobytes() for s in special):
            clear &= np.array([not any(s in text for s in special) for text in own], dtype=bool)
        if not clear.all():
            raw, ends = _laid_out([text for text, fine in zip(own, clear) if fine])
        cut = iter(self._cut_and_encoded(raw, ends))
        return [next(cut) if fine else np.frombuffer(self._library(text), np.uint16) for text, fine in zip(texts, clear)]

    def _cut_and_encoded(self, raw: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        starts = piece_starts(raw, ends)
        borders = np.append(starts, len(raw)).astype(np.int32)
        found = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(borders), pa.py_buffer(raw)]).dictionary_encode()
        which, different = found.indices.to_numpy(), found.dictionary.cast(pa.string()).to_numpy(zero_copy_only=False).tolist()
        known = list(map(self.ids.get, different))
        if None in known:
            new = [f for f, ids in zip(different, known) if ids is None]
            self.learnt += sum(map(len, new))
            self._learn(new)
            known = [self.ids[f] if ids is None else ids for f, ids in zip(different, known)]
        sizes = np.array(list(map(len, known)), dtype=np.int64) // 2
        flat, first = np.frombuffer(b"".join(known), np.uint16), np.cumsum(sizes) - sizes
        lengths = sizes[which]
        until = np.concatenate(([0], np.cumsum(lengths)))
        ids = flat[np.repeat(first[which] - until[:-1], lengths) + np.arange(until[-1])]
        return np.split(ids, until[np.searchsorted(starts, ends)][:-1]) if len(ends) else []

    def _learn(self, fragments: list[str]) -> None:
        words = [f for f in fragments if self.simple.fullmatch(f)]
        self.ids.update(zip(words, self.words.encode(words)))
        rest = [f for f in fragments if f not in self.ids]
        for fragment, found in zip(rest, self.whole.encode_batch_fast(rest, add_special_tokens=False) if rest else []):
            self.ids[fragment] = np.array(found.ids, dtype=np.uint16).tobytes()


def _laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts end to end, and where each ends."""
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum(np.array(list(map(len, texts)), dtype=np.int64))


def _any_within(flags: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each text whether a byte of it is flagged."""
    at = np.flatnonzero(flags)
    return np.diff(np.searchsorted(at, ends), prepend=0) > 0


# Kinds of bytes in texts of ASCII and Latin letters.
_SIGN, _LETTER, _DIGIT, _SPACE, _UNKNOWN = range(5)
_KINDS = np.full(256, _UNKNOWN, dtype=np.uint8)
_KINDS[0x21:0x7F] = _SIGN
_KINDS[[b for b in range(256) if chr(b).isascii() and chr(b).isalpha()]] = _LETTER
_KINDS[0x30:0x3A] = _DIGIT
_KINDS[[0x09, 0x0A, 0x0D, 0x20]] = _SPACE
# U+00C0 to U+00FF begin with this byte; the signs of times and division among them are told apart below.
_KINDS[0xC3] = _KINDS[0x80:0xC0] = _LETTER


def _unclear_bytes(raw: np.ndarray) -> np.ndarray:
    """Bytes that no text of ASCII and Latin letters has."""
    flags = _KINDS[raw] == _UNKNOWN
    after = (raw[:-1] == 0xC3) & ((raw[1:] == 0x97) | (raw[1:] == 0xB7))
    flags[1:] |= after
    return flags


def piece_starts(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the pieces of clear texts start, as `ByteBpe.pieces` parts them.

    A piece is a run of one kind.  The last of some white space before anything else is parted from
    the rest of it and, if it is a space, joined to what follows.
    """
    n = len(raw)
    if not n:
        return np.zeros(0, dtype=np.int64)
    kind = _KINDS[raw]
    white = kind == _SPACE
    before_other = np.zeros(n, dtype=bool)
    before_other[:-1] = ~white[1:]
    before_other[ends[ends > 0] - 1] = False
    start = np.ones(n, dtype=bool)
    joined = white[:-1] & (raw[:-1] == 0x20) & ~white[1:]
    start[1:] = np.where(white[1:] & white[:-1], before_other[1:], (kind[1:] != kind[:-1]) & ~joined)
    begins = np.concatenate(([0], ends))
    start[begins[begins < n]] = True
    marks = np.flatnonzero((raw == 0x27) & start)
    room = ends[np.searchsorted(ends, marks, side="right")] - marks
    follows = np.concatenate((raw, np.zeros(2, np.uint8)))
    one, two = follows[marks + 1], follows[marks + 2]
    short = (room > 1) & np.isin(one, np.frombuffer(b"stmd", np.uint8))
    long = np.zeros(len(marks), dtype=bool)
    for a, b in (b"re", b"ve", b"ll"):
        long |= (room > 2) & (one == a) & (two == b)
    start[marks[short | long] + 1] = False
    after = np.concatenate((marks[short] + 2, marks[long] + 3))
    start[after[after < n]] = True
    return np.flatnonzero(start)


def tokenizer(kind, path_text: str):
    """The worker's tokenizer of a kind, made once from its JSON text."""
    made = worker_state("bpe/tokenizers")
    key = (kind.__name__, hash(path_text))
    if key not in made:
        made[key] = kind(path_text)
    return made[key]


def _encoding(shared, decoding: bool):
    def encode(batches):
        bpe = tokenizer(WordBpe, shared.value)
        for batch in pieces(batches):
            found = bpe.encode_all([t or "" for t in batch.column("text").to_pylist()])
            offsets = np.zeros(len(found) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in found], out=offsets[1:])
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found).astype(np.int32)))
            columns = [batch.column(k) for k in range(batch.num_columns)]
            more, names = [ids], ["ids"]
            if decoding:
                words = _vocabulary(shared.value, bpe.whole)
                texts = [" ".join([words[i] for i in own.tolist()]) for own in found]
                more, names = [ids, pa.array(texts, pa.string())], ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays([*columns, *more], names=[*batch.schema.names, *names])

    return encode


def _vocabulary(text: str, known=None) -> list[str]:
    """The text of every token, made once in a worker."""
    vocabulary = worker_state("bpe/vocabulary")
    if hash(text) not in vocabulary:
        known = known or load(text)
        size = known.get_vocab_size(with_added_tokens=True)
        vocabulary[hash(text)] = [known.decode([k], skip_special_tokens=False) for k in range(size)]
    return vocabulary[hash(text)]


def _decoding(shared):
    def decode(batches):
        words = _vocabulary(shared.value)
        for batch in batches:
            at = batch.schema.get_field_index("ids")
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = [" ".join([words[i] for i in ids or ()]) for ids in part.column(at).to_pylist()]
                columns = [part.column(c) for c in range(part.num_columns)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], names=[*part.schema.names, "decoded"])

    return decode


def _extended(df: DataFrame, name: str, kind: str) -> tuple[DataFrame, str]:
    """`df` without a column of that name, and the schema with it added."""
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    df = df.drop(name)
    return df, StructType([*df.schema.fields, StructField(name, _parse_datatype_string(kind))])


def encode_texts(docs: DataFrame, path: str, decoded: bool = False) -> DataFrame:
    """`docs` with `ids`, the token ids of the whole `text` under the vocabulary file at `path`.

    With `decoded`, the column of that name follows, as `decode_ids` makes it, from the same pass and worker.
    Null and empty texts have no ids.  A column named ids is replaced; all others, and
    repeated rows, stay as they are.
    """
    with open(path, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())
    docs, schema = _extended(docs.drop("decoded") if decoded else docs, "ids", "array<int>")
    if decoded:
        schema = schema.add("decoded", "string")
    return docs.mapInArrow(_encoding(shared, decoded), schema)


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """`encoded` with `decoded`, the text of `ids`: tokens joined by a space, as the library does without a decoder.

    Null and empty ids give an empty text; a column named decoded is replaced.
    """
    with open(path, encoding="utf-8") as file:
        shared = encoded.sparkSession.sparkContext.broadcast(file.read())
    encoded, schema = _extended(encoded, "decoded", "string")
    return encoded.mapInArrow(_decoding(shared), schema)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
