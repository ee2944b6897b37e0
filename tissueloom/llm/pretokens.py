"""Pre-tokens of the two tokenizer files, coded once per distinct pre-token.

A text is cut into units and these into pre-tokens, each distinct one is encoded once, and a text's ids are
gathered from a table by code.  The tables are caches: at ``LIMIT`` units those met least often go, which
costs time and never changes a result.

Where units are words between white space, they are found as spans of bytes and known by two 64-bit hashes, so
that only words met for the first time become strings.
"""

from __future__ import annotations

import unicodedata
from codecs import charmap_decode
from collections import defaultdict
from collections.abc import Callable, Sequence
from itertools import compress, islice

import numpy as np
import regex

from .common import Block, kept_by_worker, span_hash, splitmix, U64

LIMIT = 500_000
#: Distinct pre-tokens are only needed for units met for the first time.
CODE_LIMIT = 200_000
#: Units known by hashes take less room than strings: so many times ``LIMIT`` of them.
HASHED_TIMES = 3
OFTEN = 4
BYTE_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
WORD_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: The same over units joined by a mark that no pre-token holds (in bytes a lone surrogate, which no text has); it is a match of its own.
BYTE_MARKED = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}\ud800]+|\s+(?![^\s\ud800])|\s+|\ud800")
WORD_MARKED = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+|\n")
#: Outside these ranges Unicode versions of Python and of the library may differ; such texts take the library's own path.
_UNSURE = regex.compile("[^\u0000-ͷ΄-ԩऀ-ॣḀ-ỿ -⁤₠-₿←-⏾①-⭳ぁ-ゖァ-ヿ一-鿪가-힣︰-﹒！-ﾾ\U0001f300-\U0001f64f]")

#: A second view of the bytes, for a second hash.
_STEP = np.random.default_rng(7).permutation(256).astype(np.uint8)
_SPACE_RUN = regex.compile(r" (?:\s|$|[\x1c-\x1f])")
#: White space to the pattern as well, whatever surrounds it.
_WHITE = regex.compile(r"[ \t\n\x0b\x0c\r]+")


class Grown:
    """An array that grows at its end."""

    def __init__(self, dtype):
        self.data, self.n = np.zeros(1024, dtype), 0

    def add(self, values: np.ndarray) -> None:
        need = self.n + len(values)
        if need > len(self.data):
            self.data = np.concatenate((self.data, np.zeros(max(need, len(self.data)) - len(self.data) + need, self.data.dtype)))
        self.data[self.n : need] = values
        self.n = need


class Hashes:
    """Places of keys of two 64-bit hashes, found for many keys at once: open addressing, at most half full."""

    def __init__(self, slots: int = 1 << 16):
        self.n, self.at = 0, np.full(slots, -1, np.int32)
        self.one, self.two = np.zeros(slots, U64), np.zeros(slots, U64)

    def find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where there is none."""
        out = np.full(len(one), -1, np.int64)
        live, slot = np.arange(len(one)), (one & U64(len(self.at) - 1)).astype(np.int64)
        while len(live):
            at = self.at[slot]
            same = (at >= 0) & (self.one[slot] == one[live]) & (self.two[slot] == two[live])
            out[live[same]] = at[same]
            on = (at >= 0) & ~same
            live, slot = live[on], slot[on] + 1 & len(self.at) - 1
        return out

    def add(self, one: np.ndarray, two: np.ndarray, places: np.ndarray) -> None:
        """Distinct keys that are not there yet."""
        if 2 * (self.n + len(one)) > len(self.at):
            used = self.at >= 0
            held = self.one[used], self.two[used], self.at[used]
            self.__init__(1 << (4 * (self.n + len(one))).bit_length())
            self.add(*held)
        self.n += len(one)
        live, slot = np.arange(len(one)), (one & U64(len(self.at) - 1)).astype(np.int64)
        while len(live):
            free = self.at[slot] < 0
            self.at[slot[free]] = places[live[free]]  # of several keys for one slot the last has it
            won = free & (self.at[slot] == places[live])
            self.one[slot[won]], self.two[slot[won]] = one[live[won]], two[live[won]]
            live, slot = live[~won], slot[~won] + 1 & len(self.at) - 1


def gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices starts[i] .. starts[i] + sizes[i] - 1, one run after another."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    out = np.repeat(starts - (ends - sizes), sizes)
    out += np.arange(total)
    return out


class Coder:
    """Texts to ids through tables of distinct units and distinct pre-tokens.

    A text is first cut into units at spaces, where that cannot change its pre-tokens; otherwise its
    pre-tokens are its units.  A unit met for the first time is cut into pre-tokens, and a pre-token met for
    the first time is encoded.
    """

    def __init__(self, tokenizer, split, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], keep_space: bool, keep_ids: bool = True):
        self.tokenizer, self.split, self.encode, self.keep_space, self.keep_ids = tokenizer, split, encode, keep_space, keep_ids
        self.mark, self.marked = ("\ud800", BYTE_MARKED) if keep_space else ("\n", WORD_MARKED)
        self.special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        self.on_special = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")") if self.special else None
        self.clear()

    always: tuple[list, np.ndarray, np.ndarray] | None = None

    def clear(self) -> None:
        self.unit: dict = {}
        self.by_hash = Hashes()
        self.unit_start, self.unit_size, self.unit_flat, self.hits = Grown(np.int64), Grown(np.int64), Grown(np.uint32), Grown(np.int64)
        self.clear_codes()

    def clear_codes(self) -> None:
        self.code: defaultdict = defaultdict()
        self.code.default_factory = self.code.__len__  # a pre-token not met before gets the next code
        self.start, self.size, self.flat = Grown(np.int64), Grown(np.int64), Grown(np.uint32)
        self.put([self.mark], np.zeros(1, np.int64), np.zeros(0, np.uint32))
        self.put([("special", s) for s in self.special], np.ones(len(self.special), np.int64), np.array(list(self.special.values()), np.uint32))
        if self.always:
            self.put(*self.always)

    def trim(self) -> None:
        """Keep the units met ``OFTEN`` times, at most half of the limit; their ids stand by themselves, so codes can all go."""
        hits = self.hits.data[: self.hits.n]
        keep = np.flatnonzero(hits >= OFTEN)
        most = LIMIT if self.keep_space else HASHED_TIMES * LIMIT
        if 2 * len(keep) > most:
            keep = np.sort(keep[np.argsort(-hits[keep], kind="stable")[: most // 2]])
        now = np.full(len(hits), -1, np.int64)
        now[keep] = np.arange(len(keep))
        names, sizes = [(u, now[i]) for u, i in self.unit.items() if now[i] >= 0], self.unit_size.data[keep]
        used = np.flatnonzero(self.by_hash.at >= 0)
        used = used[now[self.by_hash.at[used]] >= 0]
        hashed = self.by_hash.one[used], self.by_hash.two[used], now[self.by_hash.at[used]]
        flat = self.unit_flat.data[gather(self.unit_start.data[keep], sizes)] if self.keep_ids else np.zeros(0, np.uint32)
        self.clear()
        self.unit = {u: int(k) for u, k in names}
        self.by_hash.add(*hashed)
        self.unit_start.add(np.cumsum(sizes) - sizes)
        self.unit_size.add(sizes)
        self.unit_flat.add(flat)
        self.hits.add(np.zeros(len(keep), np.int64))

    def put(self, words: list, sizes: np.ndarray, ids: np.ndarray) -> None:
        self.code.update(zip(words, range(len(self.code), len(self.code) + len(words))))
        self.store(sizes, ids)

    def store(self, sizes: np.ndarray, ids: np.ndarray) -> None:
        """The ids of the next codes."""
        self.start.add(self.flat.n + np.cumsum(sizes) - sizes)
        self.size.add(sizes)
        self.flat.add(ids)

    def plain(self, text: str) -> list[str]:
        """Pre-tokens of a text without special strings."""
        unsure = not text.isascii() and _UNSURE.search(text)
        if not self.keep_space:
            if unsure:
                text = self.tokenizer.normalizer.normalize_str(text)
            elif text.isascii():
                text = text.lower()
            else:
                text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        if unsure:
            return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return self.split.findall(text)

    def units(self, text: str) -> list:
        if "<" in text and self.special and self.on_special.search(text):
            out: list = []
            for part in self.on_special.split(text):
                if part in self.special:
                    out.append(("special", part))
                elif part:
                    out += [("piece", p) for p in self.plain(part)]
            return out
        if self.keep_space:
            # a space that is followed by no white space begins a pre-token, whatever stands before it
            if _SPACE_RUN.search(text):
                return [("piece", p) for p in self.plain(text)]
            out = text.split(" ")
            out[0] = ("first", out[0])
            return out
        return [u for u in _WHITE.split(text) if u]

    def pieces(self, unit) -> list:
        if isinstance(unit, str):
            return self.plain(" " + unit) if self.keep_space else self.plain(unit)
        kind, text = unit
        if kind == "special":
            return [unit]
        return [text] if kind == "piece" else self.plain(text)

    def cut(self, units: list) -> list:
        """The pre-tokens of all units, with the mark after each unit's."""
        plain = " ".join(units) if all(type(u) is str for u in units) else None
        if plain is None or not plain.isascii() and _UNSURE.search(plain):
            pieces = [self.pieces(u) for u in units]
            return [p for ps in pieces for p in (*ps, self.mark)]
        if self.keep_space:
            joined = " " + (self.mark + " ").join(units)
        elif plain.isascii():
            joined = self.mark.join(units).lower()
        else:
            joined = unicodedata.normalize("NFC", self.mark.join(units)).replace("Σ", "σ").lower()
        return [*self.marked.findall(joined), self.mark]

    def learn(self, units: list) -> np.ndarray:
        """The places of units met for the first time."""
        places = np.zeros(len(units), np.int64)
        plain = [type(u) is str for u in units]
        for kind in (False, True):
            at = [i for i, p in enumerate(plain) if p is kind] if not all(p is kind for p in plain) else range(len(units))
            for k in range(0, len(at), 50_000):
                part = np.array(at[k : k + 50_000])
                some = [units[i] for i in part.tolist()]
                words = self.lowered(some) if kind and not self.keep_space else None
                if words:
                    # letters alone are one pre-token, as the pattern has them
                    letters = np.fromiter(map(str.isalpha, words), bool, len(words))
                    places[part[letters]] = self.hits.n + np.arange(letters.sum())
                    self.add(list(compress(words, letters)), whole=True)
                    part, some = part[~letters], list(compress(some, ~letters))
                if some:
                    places[part] = self.hits.n + np.arange(len(part))
                    self.add(some)
        return places

    def lowered(self, units: list[str]) -> list[str] | None:
        """Word units as the normalizer leaves them; None if Unicode versions may differ on some."""
        joined = "\n".join(units)  # no unit has a line break
        if joined.isascii():
            return joined.lower().split("\n")
        return None if _UNSURE.search(joined) else unicodedata.normalize("NFC", joined).replace("Σ", "σ").lower().split("\n")

    def add(self, units: list, whole: bool = False) -> None:
        """Units at the next places; ``whole`` ones are normal and one pre-token each."""
        flat = units if whole else self.cut(units)
        if len(self.code) > CODE_LIMIT:
            self.clear_codes()
        known = len(self.code)
        codes = np.fromiter(map(self.code.__getitem__, flat), np.int64, len(flat))
        if fresh := len(self.code) - known:
            try:
                self.store(*self.encode(list(islice(reversed(self.code), fresh))[::-1]))
            except BaseException:
                self.clear()  # codes without ids must not stay
                raise
        sizes = self.size.data[codes]
        ids = self.flat.data[gather(self.start.data[codes], sizes)] if self.keep_ids else np.zeros(0, np.uint32)
        # the mark is code 0 and has no ids
        own = sizes if whole else per_text(sizes, np.diff(np.flatnonzero(codes == 0), prepend=-1))
        self.unit_start.add(self.unit_flat.n + np.cumsum(own) - own)
        self.unit_size.add(own)
        self.unit_flat.add(ids)
        self.hits.add(np.zeros(len(units), np.int64))

    def codes(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The code of each unit of all texts, and how many units each text has."""
        if self.hits.n > (LIMIT if self.keep_space else HASHED_TIMES * LIMIT):
            self.trim()
        special = [bool(self.special and t and "<" in t and self.on_special.search(t)) for t in texts]
        if self.keep_space:
            return self.listed(texts)
        if any(special):  # few texts: their units are listed, the others' hashed
            parts = [self.listed([t]) if s else self.hashed([t]) for t, s in zip(texts, special)]
            return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        return self.hashed(texts)

    def listed(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        all_units: list = []
        counts = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if t:
                found = self.units(t)
                counts[i] = len(found)
                all_units += found
        if new := list(set(all_units).difference(self.unit)):
            self.unit.update(zip(new, self.learn(new).tolist()))
        codes = np.fromiter(map(self.unit.__getitem__, all_units), np.int64, len(all_units))
        self.hits.data[: self.hits.n] += np.bincount(codes, minlength=self.hits.n)
        return codes, counts

    def hashed(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        block = Block([t.encode() if t else None for t in texts])
        one = block.words
        two = splitmix(one ^ U64(0x9FB21C651E98DF25)) ^ span_hash(_STEP[block.data], block.begin, block.end)
        units = self.by_hash.find(one, two)
        fresh = np.flatnonzero(units < 0)
        if len(fresh):
            order = fresh[np.argsort(one[fresh])]
            a, b = one[order], two[order]
            new = np.concatenate(([True], a[1:] != a[:-1]))
            if (b[1:] != b[:-1])[~new[1:]].any():  # words that only the second hash tells apart
                order = fresh[np.lexsort((two[fresh], one[fresh]))]
                a, b = one[order], two[order]
                new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            at = order[new]
            raw = block.data.tobytes()
            places = self.learn([raw[a:b].decode() for a, b in zip(block.begin[at].tolist(), block.end[at].tolist())])
            self.by_hash.add(one[at], two[at], places)
            units[order] = places[np.cumsum(new) - 1]
        np.add.at(self.hits.data, units, 1)
        return units, np.diff(block.first)

    def ids(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after another, and how many each text has."""
        codes, counts = self.codes(texts)
        sizes = self.unit_size.data[codes]
        return self.unit_flat.data[gather(self.unit_start.data[codes], sizes)], per_text(sizes, counts)

    def count(self, texts: Sequence[str | None]) -> np.ndarray:
        """How many ids each text has."""
        codes, counts = self.codes(texts)
        return per_text(self.unit_size.data[codes], counts)


def per_text(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of values, counts[i] values in run i."""
    total = np.concatenate(([0], np.cumsum(values)))
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def library_words(tokenizer) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """Encoder of distinct word pre-tokens by the tokenizers library's own model.

    The words are normal and cut already, so the model gets them as they are, with bytes spelled as it wants them.
    """
    from .bpe import byte_alphabet

    spelled = {b: c for c, b in byte_alphabet().items()}
    table = "".join(spelled[b] for b in range(256))
    tokenize = tokenizer.model.tokenize

    def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # no pre-token holds a line break
        shown = charmap_decode("\n".join(words).encode(), "strict", table)[0].split(table[10])
        if len(shown) != len(words):
            shown = [charmap_decode(w.encode(), "strict", table)[0] for w in words]
        sizes, ids = [], []
        for w in shown:
            got = tokenize(w)  # tokens are objects of the library: kept, they would cost much time of the garbage collector
            sizes.append(len(got))
            ids += [t.id for t in got]
        return np.array(sizes, np.int64), np.array(ids, np.uint32)

    return encode


_loaded: dict[tuple[str, int], object] = {}
kept_by_worker.append(_loaded)


def loaded(kind: str, text: str, make: Callable[[str], object]):
    """One engine for each worker process and tokenizer file."""
    key = (kind, hash(text))
    if key not in _loaded:
        _loaded[key] = make(text)
    return _loaded[key]


def open_tokenizer(text: str):
    from tokenizers import Tokenizer

    out = Tokenizer.from_str(text)
    out.no_truncation()
    out.no_padding()
    return out


def word_coder(text: str) -> Coder:
    tokenizer = open_tokenizer(text)
    return Coder(tokenizer, WORD_SPLIT, library_words(tokenizer), keep_space=False)


def tokenizer_text(path: str | None, default: str) -> str:
    """The tokenizer file's content, read on the driver; executors get it in the closure (about 2 MB)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(default)
    with open(path, encoding="utf-8") as f:
        return f.read()
