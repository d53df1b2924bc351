"""Byte-level BPE as a lazily determinised finite-state transducer.

After n bytes of a word, BPE has exactly one last token for every prefix of the word: the token
ending there that is compatible with the last token of the prefix it is appended to, two tokens
being compatible if BPE keeps them apart when it encodes both alone together. A state of the
transducer is therefore the set of positions at which a token may still be growing: for each the
bytes grown so far, the last token before it, and the tokens not yet written. Reading a byte grows
every position, drops those no token continues, and adds the new position. What all positions'
unwritten tokens begin with is written at once, so output lags by a bounded lookahead of the
longest token. States and transitions are built when they are first met and then looked up.

Decoding is streaming too: an incremental UTF-8 state machine takes tokens and gives characters as
soon as they are complete, and U+FFFD for each maximal broken part.
"""

from __future__ import annotations

import base64
import os
import re

import regex

#: The folder of the public vocabularies; a parameter of every operator.
TOKENIZERS = os.environ.get("CODEXMILL_TOKENIZERS", "/opt/tokenizers")
#: Entries that memos of words and of pairs, and the table of states, may hold before they start anew.
MEMO, STATES = 300_000, 60_000
# The characters of the Unicode property White_Space, as a class.
_S = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
# The public pattern that splits a text into words before merging.
_WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class _State:
    __slots__ = ("items", "next", "rest")

    def __init__(self, items: tuple):
        self.items = items
        self.next: dict[int, tuple[_State, tuple[int, ...]]] = {}
        self.rest = items[-1][2]  # the last item is the position just reached: what to write at the end


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.grows = {t[:i] for t in ranks for i in range(1, len(t))}
        self.bytes_of = {i: t for t, i in ranks.items()}
        self._apart: dict[tuple[int, int], bool] = {}
        self._halves: dict[int, tuple[int, ...]] = {}
        self._reset()

    def _reset(self) -> None:
        self.start = _State(((b"", -1, ()),))
        self.states = {self.start.items: self.start}

    def merge(self, word: bytes, below: int | None = None) -> list[int]:
        """BPE by its definition: the leftmost pair of least rank merges until none (``below`` a rank) is left."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best, at = below, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def halves(self, t: int) -> tuple[int, ...]:
        """The two tokens whose merge makes t; itself if it is one byte; () if BPE never makes it."""
        known = self._halves.get(t)
        if known is None:
            data = self.bytes_of[t]
            made = self.merge(data, t)
            known = self._halves[t] = (t,) if len(data) == 1 else tuple(made) if len(made) == 2 else ()
        return known

    def apart(self, a: int, b: int) -> bool:
        """Whether BPE keeps token b right after token a (-1: at a start).

        The tokens that met at their border in the course of merging are walked backwards in time,
        undoing the later merge first. They would have joined if their own merge came before the
        merge that consumed one of them; of equal merges the left one comes first.
        """
        if a < 0:
            return self.halves(b) != ()
        known = self._apart.get((a, b))
        if known is not None:
            return known
        key, consumed = (a, b), len(self.ranks) + 1
        apart = self.halves(b) != ()
        while apart:
            joined = self.ranks.get(self.bytes_of[a] + self.bytes_of[b])
            if joined is not None and joined < consumed:
                apart = False
            elif a > b and len(self.bytes_of[a]) > 1:
                consumed, a = a, self.halves(a)[1]
            elif len(self.bytes_of[b]) > 1:
                consumed, b = b + 1, self.halves(b)[0]
            elif len(self.bytes_of[a]) > 1:
                consumed, a = a, self.halves(a)[1]
            else:
                break
        if len(self._apart) > MEMO:
            self._apart.clear()
        self._apart[key] = apart
        return apart

    def _grow(self, state: _State, byte: int) -> tuple[_State, tuple[int, ...]]:
        b = bytes((byte,))
        live, reached = [], None
        for grown, last, unwritten in state.items:
            now = grown + b
            if now in self.grows:
                live.append((now, last, unwritten))
            if reached is None:
                t = self.ranks.get(now)
                if t is not None and self.apart(last, t):
                    reached = (b"", t, unwritten + (t,))
        live.append(reached)
        chains = [x[2] for x in live]
        low, high = min(chains), max(chains)
        k, most = 0, min(len(low), len(high))
        while k < most and low[k] == high[k]:
            k += 1
        written = low[:k]
        items = tuple((g, t, c[k:]) for g, t, c in live) if k else tuple(live)
        known = self.states.get(items)
        if known is None:
            if len(self.states) >= STATES:  # also within a word, however long; the state just read lives on
                self._reset()
            known = self.states[items] = _State(items)
        state.next[byte] = (known, written)
        return known, written

    def encode(self, word: bytes) -> list[int]:
        """The tokens of one word."""
        state, out = self.start, []
        for byte in word:
            step = state.next.get(byte)
            if step is None:
                step = self._grow(state, byte)
            state, written = step
            if written:
                out += written
        out += state.rest
        return out


class _Unsafe(Exception):
    """A space that doesn't start a word: the text must be cut by the slower rule."""


class _Memo(dict):
    """Piece of text -> its ids as little-endian 32-bit integers, kept while the piece is short."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, piece: str) -> bytes:
        found = self.make(piece)
        if len(piece) < 64:
            if len(self) > MEMO:
                self.clear()
            self[piece] = found
        return found


class Tokenizer:
    """Texts to ids by the pattern and a transducer; strings like special tokens are plain text."""

    _loaded: dict[str, Tokenizer] = {}

    def __init__(self, path: str):
        self.transducer = Transducer(load_ranks(path))
        self.find = regex.compile(_WORDS).findall
        # A space before anything but white space always starts a word, whatever precedes it.
        self.cut = re.compile(r" (?=\S)").split
        self.words = _Memo(self._word)
        self.first, self.later = _Memo(self._chunk), _Memo(self._later)

    @classmethod
    def load(cls, path: str) -> Tokenizer:
        """One per worker process."""
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def _word(self, word: str) -> bytes:
        return b"".join(i.to_bytes(4, "little") for i in self.transducer.encode(word.encode("utf-8", "surrogatepass")))

    def _chunk(self, chunk: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.find(chunk)))

    def _later(self, chunk: str) -> bytes:
        if not chunk or chunk[0].isspace():
            raise _Unsafe
        return self._chunk(" " + chunk)

    def encode_bytes(self, text: str | None) -> bytes:
        """The ids as little-endian 32-bit integers; empty for a null or empty text."""
        if not text:
            return b""
        try:
            parts = text.split(" ")
            return self.first[parts[0]] + b"".join(map(self.later.__getitem__, parts[1:]))
        except _Unsafe:
            parts = self.cut(text)
            return self.first[parts[0]] + b"".join(map(self.later.__getitem__, parts[1:]))

    def count(self, text: str | None) -> int:
        return len(self.encode_bytes(text)) // 4


class Utf8Machine:
    """Incremental UTF-8: bytes in, characters out as they complete; a state is the bytes of an open character."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of = bytes_of
        self._steps: dict[tuple[bytes, int], tuple[str, bytes]] = {}

    @staticmethod
    def _open(head: bytes) -> tuple[int, int, int]:
        """(bytes still wanted, least and greatest next byte) after the bytes of an open character."""
        a, n = head[0], len(head)
        width = 2 if a < 0xE0 else 3 if a < 0xF0 else 4
        low = {0xE0: 0xA0, 0xF0: 0x90}.get(a, 0x80) if n == 1 else 0x80
        high = {0xED: 0x9F, 0xF4: 0x8F}.get(a, 0xBF) if n == 1 else 0xBF
        return width - n, low, high

    def feed(self, state: bytes, data: bytes) -> tuple[str, bytes]:
        out = []
        for x in data:
            if state:
                want, low, high = self._open(state)
                if low <= x <= high:
                    state += bytes((x,))
                    if want == 1:
                        out.append(state.decode("utf-8"))
                        state = b""
                    continue
                out.append("�")
                state = b""
            if x < 0x80:
                out.append(chr(x))
            elif 0xC2 <= x <= 0xF4:
                state = bytes((x,))
            else:
                out.append("�")
        return "".join(out), state

    def decode(self, ids) -> str:
        """Ids outside the vocabulary come out as U+FFFD."""
        state, out, steps = b"", [], self._steps
        for i in ids:
            step = steps.get((state, i))
            if step is None:
                if len(steps) > MEMO:
                    steps.clear()
                step = steps[(state, i)] = self.feed(state, self.bytes_of.get(i, b"\xff"))
            text, state = step
            out.append(text)
        if state:
            out.append("�")
        return "".join(out)
