"""BPE encoding and decoding.

Encoding: an Aho-Corasick automaton over the vocabulary gives, for each position of a piece, the tokens
that start there; the encoder takes the longest one that may follow the token before it and steps back
where none can. Two tokens may stand side by side if undoing their merges, latest first, never meets a
merge across their boundary that came earlier; such a chain is the only one that BPE merging yields, so
the result is exact, in time linear in the piece. Every piece is encoded so: many new ones a step at a time in
arrays, single and last ones in a plain loop. Decoding gathers bytes by an offset table.

A text in normal form is cut at ASCII white space, which no piece crosses; a bounded memo keeps the ids of
short chunks. Edge cases: null and empty texts give no ids and an empty decoded text; special
tokens' strings in a text become their ids, as in the tokenizers library; rows may repeat.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import LETS_GO, map_rows, texts

MEMO_CHUNKS, MEMO_BYTES = 500_000, 40  # entries kept, and the longest chunk that is kept
#: White space as the vocabulary's patterns know it; Python's own also has U+001C to U+001F.
SPACE = r"\t-\r\x20\x85\xa0  -     　"
PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
END = 0xE000  # added to the code of a piece's last symbol
APART = 0xF8FF  # no symbol: between pieces
PAIRS = 1 << 21  # places of the table of pairs
AT_ONCE, FEW = 20_000, 16  # pieces that go a step at a time; so few are encoded one by one in the end


def byte_letters() -> list[str]:
    """The letter for each byte: printable Latin-1 stands for itself, the rest follows from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Bpe:
    """A vocabulary with word ends ('</w>'): encode() and decode()."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocab: dict[str, int] = file["model"]["vocab"]
        self.letters = dict(enumerate(byte_letters()))
        self.ends = {x: chr(END + ord(x)) for x in self.letters.values()}
        own = {name: self._symbols(name) for name in vocab}
        by_symbols = {own[name]: i for name, i in vocab.items()}
        size = 1 + max([*vocab.values(), *(t["id"] for t in file["added_tokens"])])
        self.length = [0] * size
        self.parts = [(i, i) for i in range(size)]
        self.pair: dict[tuple[int, int], int] = {}
        self.trie = ahocorasick.Automaton()
        for name, i in vocab.items():
            self.length[i] = len(own[name])
            if len(own[name]) > 1:  # single symbols are tokens at every place
                self.trie.add_word(own[name], i)
        self.trie.make_automaton()
        before = -1
        for a, b in file["model"]["merges"]:
            left, right = vocab[a], vocab[b]
            made = by_symbols[own[a] + own[b]]
            if made <= before:
                raise ValueError("ids must follow the order of the merges")
            before = made
            self.parts[made], self.pair[left, right] = (left, right), made
        self.lengths = np.array(self.length, np.int64)
        self.pair_keys, self.pair_fits = np.full(PAIRS, -1, np.int64), np.zeros(PAIRS, bool)
        self.codes = np.array([ord(self.letters[b]) for b in range(256)], np.uint32)
        self.single = {own[n]: i for n, i in vocab.items() if len(own[n]) == 1}
        self.singles = np.full(1 << 16, -1, np.int64)
        for x, i in self.single.items():
            self.singles[ord(x)] = i
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.special_at = re.compile("|".join(re.escape(s).encode().decode() for s in self.special).encode()) if self.special else None
        names = [b""] * size
        for name, i in [*vocab.items(), *self.special.items()]:
            names[i] = name.encode() + b" "
        self.offsets = np.concatenate([[0], np.cumsum([len(n) for n in names])]).astype(np.int64)
        self.blob = np.frombuffer(b"".join(names), np.uint8)
        self.fits = functools.lru_cache(20_000)(self._fits)
        self.memo: dict[bytes, bytes] = {}

    @staticmethod
    def _symbols(name: str) -> str:
        return name[:-5] + chr(END + ord(name[-5])) if name.endswith("</w>") and len(name) > 4 else name

    def _fits(self, a: int, b: int) -> bool:
        """Whether BPE leaves a and b apart when they stand side by side."""
        parts, bound = self.parts, 1 << 40
        while True:
            made = self.pair.get((a, b))
            if made is not None and made < bound:
                return False
            # Undo the later one of the two merges that made a and b; on a tie the right one is later.
            for side in ("a", "b") if a > b else ("b", "a"):
                if side == "a":
                    inner = parts[a][1]
                    if inner != a:
                        bound, a = a, inner
                        break
                    bound = a
                else:
                    inner = parts[b][0]
                    if inner != b:
                        bound, b = b + 1, inner
                        break
                    bound = b + 1
            else:
                return True

    def piece(self, data: bytes) -> list[int]:
        """Ids of one piece, UTF-8."""
        word = data.decode("latin-1")
        if not (data.isascii() and word.isprintable()):
            word = word.translate(self.letters)
        word = word[:-1] + self.ends[word[-1]]
        n = len(word)
        if n == 1:
            return [self.single[word]]
        single = self.single
        starts: list[list[int]] = [[single[x]] for x in word]
        length, fits = self.length, self.fits
        for end, i in self.trie.iter(word):
            starts[end + 1 - length[i]].append(i)
        out: list[int] = []
        tried: list[int] = []
        shut: set[int] = set()
        at, k, before = 0, len(starts[0]) - 1, -1
        while at < n:
            here = starts[at]
            while k >= 0:
                i = here[k]
                if (before < 0 or fits(before, i)) and at + length[i] not in shut:
                    break
                k -= 1
            if k >= 0:
                out.append(i)
                tried.append(k)
                at += length[i]
                before = i
                k = len(starts[at]) - 1 if at < n else 0
            else:
                shut.add(at)
                at -= length[out.pop()]
                k = tried.pop() - 1
                before = out[-1] if out else -1
        return out

    @staticmethod
    def pieces(data: bytes) -> list[bytes]:
        """A normal chunk without ASCII white space, cut as the vocabulary asks."""
        if data.isalpha():  # of bytes: ASCII letters
            return [data]
        if data[-1] in b".,;:!?$%&*#|" and data[:-1].isalpha():
            return [data[:-1], data[-1:]]
        text = data.decode("utf-8", "replace")
        if text.isalpha():
            return [data]
        if text[-1] in ".,;:!?$%&*#|" and text[:-1].isalpha():
            return [data[:-1], data[-1:]]
        return [p.encode() for p in PIECE.findall(text)]

    def chunk(self, data: bytes) -> bytes:
        """Ids, little-endian uint32, of a normal chunk without ASCII white space."""
        ids = [i for p in self.pieces(data) for i in self.piece(p)]
        return struct.pack(f"<{len(ids)}I", *ids)

    @staticmethod
    def normal(data: bytes) -> bytes:
        if data.isascii():
            return data.lower()
        # Letter by letter, so a capital sigma never becomes the final form.
        return unicodedata.normalize("NFC", data.decode("utf-8", "replace")).replace("Σ", "σ").lower().encode()

    def _ordinary(self, data: bytes) -> list[bytes]:
        """Ids of each chunk of a text without special tokens."""
        memo = self.memo
        out = []
        for c in self.normal(data).split():
            ids = memo.get(c)
            if ids is None:
                ids = self.chunk(c)
                if len(c) <= MEMO_BYTES:
                    if len(memo) >= MEMO_CHUNKS:
                        memo.clear()
                    memo[c] = ids
            out.append(ids)
        return out

    def encode(self, data: bytes) -> bytes:
        """Ids, little-endian uint32, of a whole text."""
        if self.special_at is None or b"<|" not in data:
            return b"".join(self._ordinary(data))
        out, done = [], 0
        for m in self.special_at.finditer(data):
            out += [*self._ordinary(data[done : m.start()]), self.special[m[0].decode()].to_bytes(4, "little")]
            done = m.end()
        return b"".join([*out, *self._ordinary(data[done:])])

    def fitting(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """fits() of many pairs, by a table of those met before: one place for each hash, the last one met keeps it."""
        key = a << 20 | b
        at = (key * 0x9E3779B1 >> 13) & PAIRS - 1
        out = self.pair_fits[at]
        miss = np.flatnonzero(self.pair_keys[at] != key)
        if len(miss):
            new, where = np.unique(key[miss], return_inverse=True)
            found = np.fromiter((self.fits(k >> 20, k & 0xFFFFF) for k in new.tolist()), bool, len(new))[where]
            out[miss] = found
            self.pair_keys[at[miss]], self.pair_fits[at[miss]] = key[miss], found
            # Of two pairs with one place, key and value must be the same one's.
            lost = self.pair_keys[at[miss]] != key[miss]
            self.pair_keys[at[miss[lost]]] = -1
        return out

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of many pieces (none empty, none with a line feed), some at a time, so that arrays stay small."""
        return [ids for k in range(0, len(pieces), AT_ONCE) for ids in self._encoded(pieces[k : k + AT_ONCE])]

    def _encoded(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces as piece() gives them, all pieces a step at a time.

        The automaton runs once over all of them. Each piece has a place, the token before it and the next token to try
        there, longest first; a step goes on behind a token that fits, or to a shorter one, or back. Ways are kept by
        place: which token was taken there, and where the one before it began."""
        raw = np.frombuffer(b"\n".join(pieces) + b"\n", np.uint8)
        stops = np.flatnonzero(raw == 10)
        codes = self.codes[raw]
        codes[stops - 1] += END
        codes[stops] = APART
        found = np.fromiter(chain.from_iterable(self.trie.iter(codes.tobytes().decode("utf-32-le"))), np.int64)
        alone = np.flatnonzero(raw != 10)
        token = np.concatenate([self.singles[codes[alone]], found[1::2]])
        after = np.concatenate([alone, found[::2]]) + 1
        starts = after - self.lengths[token]
        order = np.argsort(starts, kind="stable")  # so the shortest is first at each place
        token, after = token[order], after[order]
        low = np.concatenate([[0], np.cumsum(np.bincount(starts, minlength=len(raw) + 1))])
        taken, came = np.zeros(len(raw) + 1, np.int64), np.full(len(raw) + 1, -1, np.int64)
        shut = np.zeros(len(raw) + 1, bool)
        begin = np.concatenate([[0], stops[:-1] + 1])
        at, stop, before = begin.copy(), stops, np.full(len(pieces), -1, np.int64)
        k = low[at + 1] - 1
        left = np.arange(len(pieces))
        while len(left) > FEW:
            here = k >= low[at]
            i, to = token[k], after[k]
            good = here & ~shut[to]
            pair = np.flatnonzero(good & (before >= 0))
            good[pair] = self.fitting(before[pair], i[pair])
            none = np.flatnonzero(~here)
            on, shorter = np.flatnonzero(good), np.flatnonzero(here & ~good)
            taken[at[on]] = k[on]
            came[to[on]] = at[on]
            at[on], before[on] = to[on], i[on]
            k[on] = low[at[on] + 1] - 1
            k[shorter] -= 1
            shut[at[none]] = True
            back = came[at[none]]
            at[none], k[none] = back, taken[back] - 1
            first = came[back]
            before[none] = np.where(first < 0, -1, token[taken[first]])
            open_ = at < stop
            if not open_.all():
                left, at, stop, before, k = left[open_], at[open_], stop[open_], before[open_], k[open_]
        done = np.ones(len(pieces), bool)
        done[left] = False
        # Read each way from its end; the tokens of all pieces at the same distance from it at once.
        which, place, ids, of = np.flatnonzero(done), stops[done], [], []
        while len(which):
            place = came[place]
            ids.append(token[taken[place]])
            of.append(which)
            on = place > begin[which]
            which, place = which[on], place[on]
        out: list[bytes] = [b""] * len(pieces)
        if ids:
            of_all, rank = np.concatenate(of), np.repeat(np.arange(len(of)), [*map(len, of)])
            flat = np.concatenate(ids)[np.lexsort((-rank, of_all))].astype("<u4").tobytes()
            ends = (np.cumsum(np.bincount(of_all, minlength=len(pieces))) * 4).tolist()
            out = [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        for n in left.tolist():
            own = self.piece(pieces[n])
            out[n] = struct.pack(f"<{len(own)}I", *own)
        return out

    def encode_many(self, texts: list[bytes]) -> list[bytes]:
        """Ids, little-endian uint32, of many whole texts; new chunks are encoded all at once."""
        plain = [b"<|" not in t or not self.special_at or not self.special_at.search(t) for t in texts]
        split = [self.normal(t).split() if p else [] for t, p in zip(texts, plain, strict=True)]
        if len(self.memo) >= MEMO_CHUNKS:
            self.memo.clear()
        memo = self.memo
        found = [[*map(memo.get, s)] for s in split]
        gaps = [[k for k, ids in enumerate(f) if ids is None] if None in f else () for f in found]
        new = [*{s[k] for s, own in zip(split, gaps, strict=True) for k in own}]
        cut = [self.pieces(c) for c in new]
        distinct = [*{p for own in cut for p in own}]
        ids = dict(zip(distinct, self.encode_pieces(distinct), strict=True))
        fresh = {c: ids[own[0]] if len(own) == 1 else b"".join([ids[p] for p in own]) for c, own in zip(new, cut, strict=True)}
        for s, f, own in zip(split, found, gaps, strict=True):
            for k in own:
                f[k] = fresh[s[k]]
        memo.update(fresh if all(len(c) <= MEMO_BYTES for c in new) else {c: x for c, x in fresh.items() if len(c) <= MEMO_BYTES})
        return [b"".join(f) if p else self.encode(t) for t, p, f in zip(texts, plain, found, strict=True)]

    def decode(self, ids: bytes, at_once: int = 1 << 18) -> Iterator[bytes]:
        """The decoded text, UTF-8, in parts: token strings joined by spaces."""
        all_ids = np.frombuffer(ids, "<u4")
        for k in range(0, len(all_ids), at_once):
            part = all_ids[k : k + at_once]
            start, size = self.offsets[part], self.offsets[part + 1] - self.offsets[part]
            ends = np.cumsum(size)
            where = np.arange(ends[-1]) + np.repeat(start - (ends - size), size)
            if k + at_once >= len(all_ids):
                where = where[:-1]
            yield self.blob[where].tobytes()


@functools.lru_cache(2)
def loaded(path: str) -> Bpe:
    """One table for each Python worker."""
    return Bpe(path)


LETS_GO[__name__] = loaded.cache_clear


def encoded(rows: Iterator[tuple], bpe: Bpe, at_once: int = 1_000_000) -> Iterator[tuple]:
    """(doc_id, ids) from (doc_id, text), texts of about at_once bytes at a time."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[1])
        if size > at_once:
            yield from zip((d for d, _ in held), bpe.encode_many([t for _, t in held]), strict=True)
            held, size = [], 0
    yield from zip((d for d, _ in held), bpe.encode_many([t for _, t in held]), strict=True)


def encode_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Per document: number of ids, digests of the ids and of the text decoded from them."""

    def run(rows):
        bpe = loaded(vocabulary)
        for doc_id, ids in encoded(rows, bpe):
            decoded = hashlib.sha256()
            for part in bpe.decode(ids):
                decoded.update(part)
            yield doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), decoded.hexdigest()

    return map_rows(texts(docs), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, ids array<long>) of every whole text."""

    def run(rows):
        for doc_id, ids in encoded(rows, loaded(vocabulary)):
            yield doc_id, np.frombuffer(ids, "<u4").astype("i8")

    return map_rows(texts(docs), run, "doc_id long, ids array<long>")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, text string) from (doc_id, ids)."""

    def run(rows):
        bpe = loaded(vocabulary)
        for doc_id, ids in rows:
            yield doc_id, b"".join(bpe.decode(np.array(ids or [], "<u4").tobytes())).decode("utf-8")

    return map_rows(encoded.select("doc_id", "ids"), run, "doc_id long, text string")
