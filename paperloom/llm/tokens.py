"""Byte-level BPE ids inside Spark tasks, by the ``tokenizers`` library.

The vocabulary's path is a parameter; nothing is trained or copied.  A text is cut into
pieces at white space exactly where the vocabulary's own pre-tokenizer cuts too, so a piece
can be looked up in a cache that is bounded in entries and lives as long as the Python worker.
Pieces that are not in the cache are cut further by the published pre-token pattern and merged
by the library's BPE model.  Added tokens of the vocabulary in a text have their own ids, as the
library gives them, unless ``encode_special_tokens`` makes them ordinary text (its flag of that name).

``encode_all`` does the same for many texts at once: their bytes are cut into pre-tokens together,
Arrow numbers the different ones, and only those are looked up; their ids are then gathered.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space by Unicode's White_Space property (Python's ``\\s`` also has U+001C to U+001F).
SPACES = "\t-\r \x85\xa0  -     　"
#: The pre-token pattern that belongs to the byte-level vocabularies.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of texts that are encoded together; a longer text is alone.
TOGETHER = 1 << 21
#: Entries of the pieces' cache and of the pre-tokens' cache; either is emptied when full (that of ``encode_all``, which has no other, at twice as many).
CACHE_ENTRIES = 200_000
#: New words whose bytes become letters together.
AT_ONCE = 1 << 14

_COARSE = re.compile(f" ?[^{SPACES}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
_OPEN: dict[str, "ByteBpe"] = {}


def default_vocabulary() -> str:
    """Where the installed package of public vocabularies keeps the 50k byte-level BPE."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself where printable, else the next free one from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return {b: chr(b if b in shown else next(free)) for b in range(256)}


class ByteBpe:
    """``encode(text)``: the ids as unsigned 16-bit integers in the machine's order (little-endian on Spark's platforms)."""

    def __init__(self, path: str, encode_special_tokens: bool = True):
        import regex
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        self.model = whole.model
        added = {} if encode_special_tokens else {t.content: k for k, t in whole.get_added_tokens_decoder().items()}
        self.added = {content: array("H", [k]).tobytes() for content, k in added.items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.fine = regex.compile(PRE_TOKEN)
        self.letters = _byte_letters()
        self.shown = np.array([ord(self.letters[b]) for b in range(256)], dtype="<u2")
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    @staticmethod
    def of(path: str) -> "ByteBpe":
        """One per Python worker and vocabulary, with the library's ids for added tokens."""
        if path not in _OPEN:
            _OPEN[path] = ByteBpe(path, encode_special_tokens=False)
        return _OPEN[path]

    def _word(self, word: str) -> bytes:
        shown = word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters)
        got = array("H", [t.id for t in self.model.tokenize(shown)]).tobytes()
        if len(self.words) >= CACHE_ENTRIES:
            self.words.clear()
        if len(word) <= 64:
            self.words[word] = got
        return got

    def _piece(self, piece: str) -> bytes:
        known = self.words
        if piece[1:].isalpha() and (piece[0] == " " or piece[0].isalpha()):
            return known.get(piece) or self._word(piece)
        return b"".join([known.get(w) or self._word(w) for w in self.fine.findall(piece)])

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(t in text for t in self.added):
            return b"".join([self.added[t] if t in self.added else self._plain(t) for t in self.split.split(text) if t])
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        known = self.pieces
        if len(known) >= CACHE_ENTRIES:
            known.clear()
        parts = _COARSE.findall(text)
        try:
            return b"".join(map(known.__getitem__, parts))
        except KeyError:
            new = set(parts).difference(known)
        for p in new:
            known[p] = self._piece(p)
        out = b"".join(map(known.__getitem__, parts))
        for p in new:
            if len(p) > 64:
                del known[p]
        return out

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all ``texts`` one after another (unsigned 16 bits), and how many each has; a null text has none."""
        texts = texts.fill_null("").cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        starts = pre_tokens(raw, offsets)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(raw)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw))]).dictionary_encode()
        index, known, words = pieces.indices.to_numpy(zero_copy_only=False), self.words, pieces.dictionary.to_pylist()
        if len(known) >= 2 * CACHE_ENTRIES:
            known.clear()
        each = list(map(known.get, words))
        new = [k for k, ids in enumerate(each) if ids is None]
        for at in range(0, len(new), AT_ONCE):
            some = [words[k] for k in new[at : at + AT_ONCE]]
            for k, word, ids in zip(new[at : at + AT_ONCE], some, self._each(some), strict=True):
                each[k] = ids
                if len(word) <= 64:
                    known[word] = ids
        length = np.fromiter(map(len, each), np.int64, len(each)) // 2
        flat = np.frombuffer(b"".join(each), dtype=np.uint16)
        n = length[index]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat((np.cumsum(length) - length)[index] - ends[:-1], n) + np.arange(ends[-1])]
        ends = ends[np.searchsorted(starts, offsets)]
        odd = np.zeros(len(texts), dtype=bool)
        for t in self.added:
            odd |= pc.match_substring(texts.cast(pa.large_string()), t).to_numpy(zero_copy_only=False)
        if not odd.any():
            return ids, np.diff(ends)
        parts = [np.frombuffer(self.encode(texts[k].as_py().decode()), dtype=np.uint16) if odd[k] else ids[a:b] for k, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))]
        return np.concatenate(parts), np.array([len(x) for x in parts], dtype=np.int64)

    def forget(self) -> None:
        """Empty the caches."""
        self.pieces.clear()
        self.words.clear()

    def _each(self, words: list[bytes]) -> list[bytes]:
        """The ids of each of ``words``, whose bytes become letters together."""
        stops = np.cumsum([len(w) for w in words]).tolist()
        shown, merge = self.shown[np.frombuffer(b"".join(words), dtype=np.uint8)].tobytes().decode("utf-16-le"), self.model.tokenize
        return [array("H", [t.id for t in merge(shown[a:b])]).tobytes() for a, b in zip([0, *stops], stops, strict=False)]


_KINDS: list[np.ndarray] = []
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)


def _kinds() -> np.ndarray:
    """Of each code point whether the pre-token pattern sees white space, a letter, a number or something else."""
    if not _KINDS:
        import regex

        every = "".join(map(chr, range(0xD800))) + " " * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))
        kinds = np.full(0x110000, _OTHER, dtype=np.uint8)
        for name, kind in ((r"\p{L}+", _LETTER), (r"\p{N}+", _NUMBER)):
            for m in regex.finditer(name, every):
                kinds[m.start() : m.end()] = kind
        kinds[[m.start() for m in re.finditer(f"[{SPACES}]", every) if not 0xD800 <= m.start() < 0xE000]] = _SPACE
        _KINDS.append(kinds)
    return _KINDS[0]


def pre_tokens(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of UTF-8 texts begin; ``offsets`` are the texts' own beginnings and the end.

    The pattern's runs of letters, of numbers and of other characters take one blank before them.
    Of white space before a text's next run the last character stands apart (or is that blank).
    An apostrophe that no blank stands before takes the ending of a contraction.
    """
    size = len(raw)
    if not size:
        return np.zeros(0, dtype=np.int64)
    table = _kinds()
    kind = table[:128][np.minimum(raw, 127)]
    lead = np.flatnonzero(raw >= 0xC0)
    if len(lead):
        wide = np.concatenate([raw, np.zeros(3, dtype=np.uint8)]).astype(np.int32)
        a, b, c, d = (wide[lead + k] for k in range(4))
        point = np.where(a < 0xE0, (a & 31) << 6 | b & 63, np.where(a < 0xF0, (a & 15) << 12 | (b & 63) << 6 | c & 63, (a & 7) << 18 | (b & 63) << 12 | (c & 63) << 6 | d & 63))
        kinds, more = table[point], 1 + (a >= 0xE0) + (a >= 0xF0)
        kind[lead] = kinds
        for k in (1, 2, 3):
            kind[lead[more >= k] + k] = kinds[more >= k]
    begins = np.zeros(size + 1, dtype=bool)
    begins[offsets] = True
    run = begins[:-1].copy()
    run[0] = True
    run[1:] |= kind[1:] != kind[:-1]
    at = np.flatnonzero(run)
    stop = np.append(at[1:], size)
    space = kind[at] == _SPACE
    blank = np.zeros(size, dtype=bool)  # whether a blank of the same text stands before
    blank[1:] = (raw[:-1] == 0x20) & ~begins[1:-1]
    out = np.zeros(size, dtype=bool)
    out[at[space]] = True
    words = at[~space]
    out[words[~blank[words]]] = True
    inner = space & ~begins[stop]  # white space with something after it
    last = stop[inner] - 1
    while True:
        follows = (raw[last] & 0xC0) == 0x80
        if not follows.any():
            break
        last = last - follows
    out[last] = True
    quote = np.flatnonzero((raw[at] == 0x27) & (stop - at == 1) & ~blank[at] & ~begins[stop])
    if len(quote):
        p = at[quote]
        one = np.append(raw, [0, 0])[p + 1]
        two = np.where(begins[np.minimum(p + 2, size)], 0, np.append(raw, [0, 0, 0])[p + 2])
        k = np.where(np.isin(one, list(b"stmd")), 1, np.where(((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")), 2, 0))
        p, k = p[k > 0], k[k > 0]
        out[p + 1] = False
        after = p + 1 + k
        out[after[after < size]] = True
    return np.flatnonzero(out)


def together(batch: pa.RecordBatch, text: int) -> list[pa.RecordBatch]:
    """Slices of ``batch`` whose column ``text`` has at most ``TOGETHER`` bytes, or one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    out, at = [], 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        stop = max(int(np.searchsorted(ends, before + TOGETHER, side="right")), at + 1)
        out.append(batch.slice(at, stop - at))
        at = stop
    return out


def closed(ids: np.ndarray, lengths: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """``ids`` with ``end`` after each document, and where the documents begin and end then."""
    stops = np.cumsum(lengths)
    return np.insert(ids, stops, end), np.concatenate([[0], stops + np.arange(1, len(stops) + 1)])


def binaries(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The runs of ``values`` between ``bounds`` as one binary value each."""
    at = (bounds * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(values))])
