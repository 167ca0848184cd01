"""Byte-pair encoding and decoding by a prefix-sharing walk over the trie of distinct words.

Byte-pair encoding has a handy property: the encoding of a prefix is the encoding of a shorter prefix plus one last
token, and that token is the only one of the vocabulary that ends the prefix and stands beside the shorter prefix's
last token without being merged with it. So one number per trie node - the last token of the prefix - holds
the encoding of every prefix. The tokens that end at a place are those of a state: an automaton over the vocabulary goes along the
path and keeps the longest end of it that begins a token. Distinct words of a slice of texts are walked depth-first (sorted order is the trie's
preorder, the path's states are the stack), and what two words share is encoded once.

Nothing is shuffled: a task reads its texts, keeps the words it has met (a bounded table, emptied when full), and puts
out one row per text. Long texts are cut into words piece by piece.

Null and empty texts have no tokens. Special strings in texts become their single id, as the tokenizers library does
by default.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import regex
from pyspark.sql import DataFrame

from cliploom.llm.common import map_slices, once

# White space and the word pattern of byte-level vocabularies.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def byte_symbols() -> dict[str, int]:
    """How byte-level vocabulary files spell bytes: printable ones as themselves, others from code point 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


MOVES = 400_000  # moves of the automaton kept besides those along tokens


class Codec:
    """Encodes and decodes with a byte-level BPE vocabulary file (ids ascend in merge order)."""

    def __init__(self, data: bytes, max_words: int = 250_000):
        spec = json.loads(data)
        spelled = byte_symbols()
        to_bytes = lambda s: bytes(spelled[c] for c in s)
        self.ids = {to_bytes(s): i for s, i in spec["model"]["vocab"].items() if all(c in spelled for c in s)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}
        self.packed = {i: i.to_bytes(4, "little") for i in self.bytes_of}
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for rule in spec["model"]["merges"]:
            left, right = (self.ids[to_bytes(s)] for s in (rule.split(" ") if isinstance(rule, str) else rule))
            whole_id = self.ids[self.bytes_of[left] + self.bytes_of[right]]
            self.merged.setdefault((left, right), whole_id)
            self.parts.setdefault(whole_id, (left, right))
        self._automaton()
        self.pattern = regex.compile(WORDS)
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.max_words = max_words
        # Encodings of words: those met lately, and the table that these filled up before.
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.beside: dict[tuple[int, int], bool] = {}

    def stays_apart(self, a: int, b: int) -> bool:
        """Whether a followed by b is left as these two tokens.

        The merges that made a and b are undone latest first. At each step the pair that faces the seam must have no
        merge that would have come before the step being undone.
        """
        key = (a, b)
        if (got := self.beside.get(key)) is not None:
            return got
        before, apart = 1 << 62, True
        while True:
            if self.merged.get((a, b), before) < before:
                apart = False
                break
            left, right = self.parts.get(a), self.parts.get(b)
            if left is None and right is None:
                break
            # A tie cannot decide for b: equal merges happen from the left, so b may then still be whole.
            if right is None or (left is not None and a > b):
                before, a = a, left[1]
            else:
                before, b = b + 1, right[0]
        if len(self.beside) > 100_000:
            self.beside.clear()
        self.beside[key] = apart
        return apart

    def _automaton(self) -> None:
        """States are the beginnings of tokens. ``moves``: state and byte to state; ``hits``: the tokens (id, length) that end in a
        state, longest first; ``shorter``: the longest proper end of a state that is a state."""
        moves: dict[int, int] = {}
        above, tokens = [(0, 0, 0)], {}  # of each state: length, the state before it, last byte
        for b, i in self.ids.items():
            state = 0
            for n, c in enumerate(b, 1):
                to = moves.get(state << 8 | c)
                if to is None:
                    to = moves[state << 8 | c] = len(above)
                    above.append((n, state, c))
                state = to
            tokens[state] = (i, len(b))
        self.shorter, self.hits = [0] * len(above), [()] * len(above)
        for state in sorted(range(1, len(above)), key=above.__getitem__):
            n, before, c = above[state]
            at = self.shorter[before]
            while at and (at << 8 | c) not in moves:
                at = self.shorter[at]
            self.shorter[state] = moves.get(at << 8 | c, 0) if n > 1 else 0
            own = self.hits[self.shorter[state]]
            self.hits[state] = (tokens[state], *own) if state in tokens else own
        self.moves, self.most_moves = moves, len(moves) + MOVES

    def move(self, state: int, c: int) -> int:
        """The state after one more byte, where no token goes on like this."""
        at = state
        while at and (at << 8 | c) not in self.moves:
            at = self.shorter[at]
        to = self.moves.get(at << 8 | c, 0)
        if len(self.moves) < self.most_moves:
            self.moves[state << 8 | c] = to
        return to

    def learn(self, words: Iterable[str]) -> None:
        """Encode distinct words in one depth-first walk of their trie."""
        moves, move, hits, beside, apart, packed = self.moves, self.move, self.hits, self.beside, self.stays_apart, self.packed
        last = [-1]  # last[i]: the last token of the first i bytes of the path
        size = [0]  # its length in bytes
        states = [0]
        above = b""
        for word, text in sorted([(w.encode(), w) for w in words]):
            keep = min(len(above), len(word))
            while above[:keep] != word[:keep]:
                keep -= 1
            del last[keep + 1 :], size[keep + 1 :], states[keep + 1 :]
            state = states[keep]
            for end in range(keep + 1, len(word) + 1):
                c = word[end - 1]
                to = moves.get(state << 8 | c)
                state = move(state, c) if to is None else to
                for token, n in hits[state]:
                    if n == end or (ok := beside.get((last[end - n], token))) or (ok is None and apart(last[end - n], token)):
                        break
                else:
                    raise ValueError("the vocabulary lacks a byte")
                last.append(token)
                size.append(n)
                states.append(state)
            above = word
            out, at = [], len(word)
            while at:
                out.append(packed[last[at]])
                at -= size[at]
            out.reverse()
            self.known[text] = b"".join(out)

    def have(self, words: set[str]) -> dict[str, bytes]:
        """The table of encodings, with all of these distinct words in it."""
        fresh = words - self.known.keys()
        if len(self.known) + len(fresh) > self.max_words:
            self.before, self.known, fresh = self.known, {}, words
        again = fresh & self.before.keys()
        self.known.update((w, self.before[w]) for w in again)
        self.learn(fresh - again)
        return self.known

    def pieces(self, text: str) -> Iterator[str | int]:
        """Text between special strings, and the ids of these."""
        if self.splitter is None:
            yield text
            return
        for i, piece in enumerate(self.splitter.split(text)):
            if i % 2:
                yield self.special[piece]
            elif piece:
                yield piece

    def chunks(self, piece: str, long: int = 2_000_000, many: int = 500_000) -> Iterator[list[str]]:
        if len(piece) <= long:
            yield self.pattern.findall(piece)
            return
        found = self.pattern.finditer(piece)
        while chunk := [m[0] for m in islice(found, many)]:
            yield chunk

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out, waiting = [], []
        small = sum(map(len, texts)) <= 4_000_000
        if small:
            cut = [[p if isinstance(p, int) else self.pattern.findall(p) for p in self.pieces(t)] for t in texts]
            met: set[str] = set()
            for row in cut:
                for p in row:
                    if not isinstance(p, int):
                        met.update(p)
            known = self.have(met)
            for row in cut:
                out.append(b"".join(p.to_bytes(4, "little") if isinstance(p, int) else b"".join(map(known.__getitem__, p)) for p in row))
            return out
        for text in texts:
            waiting = []
            for p in self.pieces(text):
                if isinstance(p, int):
                    waiting.append(p.to_bytes(4, "little"))
                    continue
                for words in self.chunks(p):
                    known = self.have(set(words))
                    waiting.append(b"".join(map(known.__getitem__, words)))
            out.append(b"".join(waiting))
        return out

    def decode(self, ids: bytes) -> str:
        table, parts = self.bytes_of, []
        whole_ids = np.frombuffer(ids, "<u4")
        for i in range(0, len(whole_ids), 1_000_000):
            parts.append(b"".join(map(table.__getitem__, whole_ids[i : i + 1_000_000].tolist())))
        return b"".join(parts).decode("utf-8", "replace")


def _file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_texts(docs: DataFrame, tokenizer_file: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and ``ids``: every whole text as little-endian unsigned 32-bit token ids."""
    data = _file(tokenizer_file)

    def make():
        codec = once(("codec", hash(data)), lambda: Codec(data))
        return lambda texts: {"ids": codec.encode_all([t or "" for t in texts])}

    return map_slices(docs, text_col, make, "ids binary", list(keep))


def decode_ids(coded: DataFrame, tokenizer_file: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and ``text``: texts of ids as ``encode_texts`` gives them; null stays null."""
    data = _file(tokenizer_file)

    def make():
        codec = once(("codec", hash(data)), lambda: Codec(data))
        return lambda ids: {"text": [None if v is None else codec.decode(v) for v in ids]}

    return map_slices(coded, "ids", make, "text string", list(keep), 8_000_000)


def round_trip(docs: DataFrame, tokenizer_file: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, n_tokens, ids_sha256 and decoded_sha256: both ways in one task, so that ids need no storing."""
    data = _file(tokenizer_file)

    def make():
        codec = once(("codec", hash(data)), lambda: Codec(data))

        def both(texts: list) -> dict:
            coded = codec.encode_all([t or "" for t in texts])
            return {
                "n_tokens": [len(v) // 4 for v in coded],
                "ids_sha256": [hashlib.sha256(v).hexdigest() for v in coded],
                "decoded_sha256": [hashlib.sha256(codec.decode(v).encode()).hexdigest() for v in coded],
            }

        return both

    return map_slices(docs, text_col, make, "n_tokens long, ids_sha256 string, decoded_sha256 string", list(keep))
