"""Byte-level BPE by backtracking over Aho-Corasick matches, and decoding by an offset table.

A sequence of tokens is what BPE gives for a text exactly if each two neighbours are: if BPE on their joint bytes gives just the two.
So the encoder takes the longest match at each place, asks a table whether it may follow the last token, tries shorter matches, and goes back when
none is left. Places that lead nowhere are marked and not tried twice, which keeps the work linear in the text.

Pre-tokens don't cross white space. Words repeat, so the encoder keeps the ids of runs "blank + word" it has seen; the store is emptied when full
and changes no result.
"""

from __future__ import annotations

import base64
import json
import re
from array import array
from collections.abc import Callable
from functools import cached_property, lru_cache

import ahocorasick
import numpy as np
import regex

# Fixed value: the pattern of byte-level pre-tokens.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# re counts U+001C to U+001F as white space, the pattern above doesn't.
RUNS = re.compile(r" ?\S+|\s+(?!\S)|\s+")
ODD = re.compile("[\x1c-\x1f]")
#: A text without longer runs of white space, or of anything else, than the library takes in its stride.
SHORT_RUNS = re.compile(r"(?:[\S\x1c-\x1f]{1,999}+(?![\S\x1c-\x1f])|[^\S\x1c-\x1f]{1,999}+(?=[\S\x1c-\x1f]|\Z))*+")
STORE = 400_000
MEMO_BYTES = 48


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files: itself where it is printable, else from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Store(dict):
    """What make gives, by key; fills itself, and starts anew when full."""

    def __init__(self, make: Callable[[str], bytes]):
        self.make = make

    def __missing__(self, key: str) -> bytes:
        if len(self) >= STORE:
            self.clear()
        out = self[key] = self.make(key)
        return out


class Bpe:
    """encode() gives ids as numpy array, as the library does for the same file; decode() the bytes.

    Strings of added tokens that occur in a text become their single ids, as by the library's default."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        raw = {i: "".join(chr(alphabet[c]) for c in t) for t, i in spec["model"]["vocab"].items() if all(c in alphabet for c in t)}
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        for content, i in self.added.items():
            raw[i] = content.encode().decode("latin-1")
        self.size = max(raw) + 1
        self.code = "H" if self.size <= 1 << 16 else "I"
        self.dtype = np.dtype("<u2" if self.code == "H" else "<u4")
        self.plain = {t: i for i, t in raw.items() if i not in self.added.values()}
        # Merges: rank by pair; per token the rank that makes it (-1: a single byte) and its two parts.
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        vocab = spec["model"]["vocab"]
        self.ranks: dict[tuple[int, int], int] = {}
        self.rank, self.left, self.right = [-1] * self.size, [-1] * self.size, [-1] * self.size
        for r, (a, b) in enumerate(merges):
            whole = vocab[a + b]
            self.ranks[vocab[a], vocab[b]] = r
            if self.rank[whole] < 0:
                self.rank[whole], self.left[whole], self.right[whole] = r, vocab[a], vocab[b]
        self.length = [len(raw.get(i, "")) for i in range(self.size)]
        self.longest = max(map(len, self.plain))
        self.pairs: dict[tuple[int, int], bool] = {}
        self.matches, self.rests = {}, {}
        self.pre = regex.compile(PRE_TOKENS)
        self.stops = re.compile("|".join(re.escape(c) for c in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.runs, self.pieces = Store(self._run), Store(self._piece)
        table = [raw.get(i, "").encode("latin-1") for i in range(self.size)]
        self.blob = np.frombuffer(b"".join(table), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in table])]).astype(np.int64)

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        out = ahocorasick.Automaton()
        for t, i in self.plain.items():
            out.add_word(t, i)
        out.make_automaton()
        return out

    @cached_property
    def shorter(self) -> list[int]:
        """Of each token, the longest token that is a proper prefix of it, or -1."""
        out = [-1] * self.size
        for t, i in self.plain.items():
            out[i] = next((self.plain[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.plain), -1)
        return out

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE on the bytes of both gives just a, b: undoes their merges from the last, asking at each step if one across the border had come before."""
        limit = len(self.ranks) + 1
        while True:
            across = self.ranks.get((a, b))
            if across is not None and across < limit:
                return False
            ra, rb = self.rank[a], self.rank[b]
            if ra > rb:
                limit, a = ra, self.right[a]
            elif rb >= 0:  # of equal merges the left one comes first
                limit, b = rb + 1, self.left[b]
            else:
                return True

    def _fits(self, a: int, b: int) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= 4 * STORE:
                self.pairs.clear()
            known = self.pairs[a, b] = self.compatible(a, b)
        return known

    def _match(self, s: str, at: int) -> int:
        for n in range(min(self.longest, len(s) - at), 0, -1):
            if (t := self.plain.get(s[at : at + n])) is not None:
                return t
        raise ValueError(f"no token for byte {ord(s[at])}")

    def piece(self, s: str) -> list[int]:
        """Ids of one pre-token; s has a character for each byte."""
        greedy, at, last, fits = [], 0, -1, self._fits
        for _, token in self.automaton.iter_long(s):
            if last >= 0 and not fits(last, token):
                break
            greedy.append(token)
            at += self.length[token]
            last = token
        if at == len(s):
            return greedy
        if len(s) <= MEMO_BYTES and len(greedy) > 1:  # mostly the last token is too long and all before it stand
            rest = self._rest(greedy[-2], s[at - self.length[last] :])
            if rest is not None:
                return [*greedy[:-1], *rest]
        if len(s) <= MEMO_BYTES:
            if len(self.rests) >= STORE:
                self.rests.clear()
            if len(self.matches) >= STORE:
                self.matches.clear()
            return list(self._rest(-1, s))
        return self._backtrack(s)

    def _rest(self, last: int, s: str) -> tuple[int, ...] | None:
        """Ids of s after the token last, or None if there are none; known endings are looked up."""
        if not s:
            return ()
        key = (last, s)
        if key in self.rests:
            return self.rests[key]
        token = self.matches.get(s)
        if token is None:
            token = self.matches[s] = self._match(s, 0)
        out = None
        while token >= 0:
            if last < 0 or self._fits(last, token):
                rest = self._rest(token, s[self.length[token] :])
                if rest is not None:
                    out = (token, *rest)
                    break
            token = self.shorter[token]
        if last >= 0:
            self.rests[key] = out
        return out

    def _backtrack(self, s: str) -> list[int]:
        """The same without recursion, for long pre-tokens: places that lead nowhere are marked."""
        length, shorter, out, at, open_ = self.length, self.shorter, [], 0, bytearray(b"\1") * (len(s) + 1)
        token = self._match(s, 0) if s else -1
        while at < len(s):
            end = at + length[token]
            if open_[end] and (not out or self._fits(out[-1], token)):
                out.append(token)
                at = end
                if at < len(s):
                    token = self._match(s, at)
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                open_[at] = 0
                token = out.pop()
                at -= length[token]
        return out

    def _piece(self, s: str) -> bytes:
        return array(self.code, self.piece(s.encode().decode("latin-1"))).tobytes()

    def _run(self, run: str) -> bytes:
        if run.lstrip(" ").isalpha():  # letters after one blank at most are one pre-token
            return self._piece(run)
        parts = self.pre.findall(run)
        return self._piece(run) if len(parts) == 1 else b"".join(map(self.pieces.__getitem__, parts))

    def packed(self, text: str) -> bytes:
        """Ids as little-endian integers of self.dtype."""
        if self.stops and self.stops.search(text):
            out, at = [], 0
            for m in self.stops.finditer(text):
                out += [self.packed_plain(text[at : m.start()]), np.array([self.added[m[0]]], self.dtype).tobytes()]
                at = m.end()
            return b"".join([*out, self.packed_plain(text[at:])])
        return self.packed_plain(text)

    def packed_plain(self, text: str) -> bytes:
        """The same, with the strings of added tokens as ordinary text."""
        if ODD.search(text):
            return b"".join(map(self.pieces.__getitem__, self.pre.findall(text)))
        return b"".join(map(self.runs.__getitem__, RUNS.findall(text)))

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.packed(text or ""), self.dtype)

    def decode(self, ids: np.ndarray, step: int = 1 << 18) -> bytes:
        """The bytes of all tokens, gathered by their offsets."""
        out = []
        for i in range(0, len(ids), step):
            part = ids[i : i + step].astype(np.int64)
            first = self.offsets[part]
            n = self.offsets[part + 1] - first
            ends = np.cumsum(n)
            at = np.repeat(first - (ends - n), n)
            at += np.arange(len(at))
            out.append(self.blob[at].tobytes())
        return b"".join(out)

    def decode_text(self, ids: np.ndarray) -> str:
        return self.decode(ids).decode("utf-8", "replace")


class LibraryBpe(Bpe):
    """The same ids, merged by a library, for operators that only need the ids; ranks: a file of the same vocabulary as ranks.

    The library's pattern runs out of stack on very long white space, and its merges are slow on very long words: such texts take the exact encoder."""

    def __init__(self, path: str, ranks: str):
        import tiktoken

        super().__init__(path)
        with open(ranks, "rb") as f:
            table = {base64.b64decode(t): int(i) for t, i in map(bytes.split, f)}
        self.library = tiktoken.Encoding("own", pat_str=PRE_TOKENS, mergeable_ranks=table, special_tokens=self.added)

    @staticmethod
    def usual(text: str) -> bool:
        return SHORT_RUNS.match(text).end() == len(text)

    def packed(self, text: str) -> bytes:
        return self.library.encode_to_numpy(text, allowed_special="all").astype(self.dtype).tobytes() if self.usual(text) else super().packed(text)

    def packed_plain(self, text: str) -> bytes:
        return np.array(self.library.encode_ordinary(text), self.dtype).tobytes() if self.usual(text) else super().packed_plain(text)


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def load(path: str | None = None) -> Bpe:
    """One backtracking encoder for each file and Python worker."""
    return Bpe(path or default_path())


@lru_cache(maxsize=2)
def load_library(path: str | None = None, ranks: str | None = None) -> Bpe:
    """One encoder for each file and Python worker, for operators that only need the ids. Without a file of ranks, load() serves."""
    if path and not ranks:
        return load(path)
    return LibraryBpe(path or default_path(), ranks or default_path("byte_bpe_50k.tiktoken"))
