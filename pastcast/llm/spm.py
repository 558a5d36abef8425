"""A SentencePiece BPE model: normalisation with source alignment, and exact encodings of every prefix."""

from __future__ import annotations

import re
import string
from functools import lru_cache

import ahocorasick
import numpy as np
from sentencepiece import sentencepiece_model_pb2 as proto

SPACE = "▁"
_ISOLATED = 0  # in place of a token: the start of a text, or a character that no piece holds
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6


class CharsMap:
    """The compiled character map: a double-array trie from byte strings to replacements."""

    def __init__(self, blob: bytes) -> None:
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob[4 : 4 + size], dtype="<u4").tolist()
        self.strings = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes used, replacement) of the longest key that data has at ``at``."""
        units, node, found = self.units, 0, None
        step = lambda u: (u >> 10) << ((u & 512) >> 6)
        node ^= step(units[0])
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(units) or units[node] & 0x800000FF != data[k]:
                break
            unit = units[node]
            node ^= step(unit)
            if unit >> 8 & 1:
                found = (k + 1 - at, units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        end = self.strings.index(0, found[1])
        return found[0], self.strings[found[1] : end]


class Model:
    """Pieces, scores and rules of a BPE model file; raises ValueError for models with user-defined or unused pieces."""

    def __init__(self, blob: bytes) -> None:
        m = proto.ModelProto()
        m.ParseFromString(blob)
        kinds = {p.type for p in m.pieces}
        if m.trainer_spec.model_type != 2 or kinds & {_USER, _UNUSED}:
            raise ValueError("only BPE models without user-defined or unused pieces are supported")
        spec = m.normalizer_spec
        self.chars = CharsMap(spec.precompiled_charsmap) if spec.precompiled_charsmap else None
        self.dummy, self.squeeze, self.escape, self.suffix = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces, m.trainer_spec.treat_whitespace_as_suffix
        self.plain = not (self.chars or self.squeeze or self.suffix) and self.escape and self.dummy
        self.score, self.id, self.text, self.bytes_id = {}, {}, {}, {}
        self.bytes_of: list[bytes] = []
        self.control: set[int] = set()
        self.end = next((i for i, p in enumerate(m.pieces) if p.type == _CONTROL and p.piece == m.trainer_spec.eos_piece), None)
        for i, p in enumerate(m.pieces):
            kind = p.type
            self.bytes_of.append(p.piece.replace(SPACE, " ").encode() if kind == _NORMAL else b"")
            if kind == _NORMAL:
                self.score[p.piece], self.id[p.piece] = p.score, i
            elif kind == _BYTE:
                self.bytes_id[int(p.piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(p.piece[3:5], 16)])
            elif kind == _UNKNOWN:
                self.unknown, self.bytes_of[i] = i, m.trainer_spec.unk_surface.encode()
            else:
                self.control.add(i)
        # tokens for the prefix table: pieces, and single characters that are only inside pieces
        self.tokens = ["", *self.id, *sorted({c for p in self.id for c in p} - set(self.id))]
        self.length = [len(t) for t in self.tokens]
        self.count = len(self.tokens)
        trie = ahocorasick.Automaton()
        for k, t in enumerate(self.tokens):
            if t:
                trie.add_word(t, k)
        trie.make_automaton()
        self.matches = trie.iter
        self.ids = [self.ids_of(t) for t in self.tokens]
        self.joins: dict[int, bool] = {}
        self.cost = [len(x) for x in self.ids]
        self.alphabet = frozenset("".join(self.tokens))
        self.segment = self._cutter()

    def _cutter(self):
        """A function that cuts normalised text where no piece crosses, as the pieces themselves tell, or None."""
        if any(SPACE in p.lstrip(SPACE) for p in self.id) or not self.escape or self.suffix:
            return None
        alone = "".join(c for c in "\n\t\r" if not any(c in p for p in self.id))
        letter, marks, not_after = re.compile(r"[^\W\d_]").match, "", ""
        for mark in string.punctuation:  # no piece has it after a letter, but for a few letters
            before = {p[k - 1] for p in self.id for k in range(1, len(p)) if p[k] == mark and letter(p[k - 1])}
            if len(before) <= 3:
                marks, not_after = marks + mark, not_after + "".join(before)
        marks, not_after, stop = re.escape(marks), re.escape(not_after), f"{SPACE}{alone}"
        cuts = [f"{SPACE}*[^{stop}{marks}]++(?<=[^\\W\\d_{not_after}])(?=[{marks}])"] * bool(marks) + [f"{SPACE}*[^{stop}]+", f"{SPACE}+"] + [f"[{alone}]"] * bool(alone)
        return re.compile("|".join(cuts)).findall

    def ids_of(self, token: str) -> list[int]:
        """The id of a piece, or of the bytes of what is no piece."""
        if token in self.id:
            return [self.id[token]]
        return [self.bytes_id[b] for b in token.encode()] if self.bytes_id else [self.unknown]

    def merged(self, text: str) -> list[str]:
        """Merges by score, the leftmost first: for short strings."""
        parts = list(text)
        while len(parts) > 1:
            best = max(((self.score[a + b], -k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.score), default=None)
            if best is None:
                break
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _join(self, key: int) -> bool:
        """Whether two neighbouring tokens, packed into the key, keep the border between them."""
        if len(self.joins) >= 300_000:
            self.joins.clear()
        left, right = self.tokens[key // self.count], self.tokens[key % self.count]
        ok = self.joins[key] = self.merged(left + right) == ([left, right] if left else [right])
        return ok

    def prefixes(self, text: str) -> list[int]:
        """The last token of the encoding of each prefix of normalised text, _ISOLATED for a character outside all pieces.

        The encoding of a prefix is the encoding of a shorter prefix and one token more; among the tokens that end there
        exactly one keeps its border to the last token of the shorter prefix. Whether two tokens keep
        their border depends on the two alone and is remembered.
        """
        last, joins, length, n = [_ISOLATED] * (len(text) + 1), self.joins, self.length, self.count
        for end, token in self.matches(text):
            end += 1
            if last[end]:
                continue
            key = last[end - length[token]] * n + token
            if joins[key] if key in joins else self._join(key):
                last[end] = token
        return last

    def counts(self, text: str) -> np.ndarray:
        """Ids in the encoding of each non-empty prefix of a stretch of normalised text."""
        return np.array(self.count_list(text), dtype="<i4")

    def count_list(self, text: str) -> list[int]:
        if not self.alphabet.issuperset(text):
            last, out = self.prefixes(text), [0] * (len(text) + 1)
            for k in range(1, len(text) + 1):
                t = last[k]
                out[k] = out[k - self.length[t]] + self.cost[t] if t else out[k - 1] + len(self.ids_of(text[k - 1]))
            return out[1:]
        last, out, joins, length, cost, n = [_ISOLATED] * (len(text) + 1), [0] * (len(text) + 1), self.joins, self.length, self.cost, self.count
        for end, token in self.matches(text):
            end += 1
            if last[end]:
                continue
            at = end - length[token]
            key = last[at] * n + token
            if joins[key] if key in joins else self._join(key):
                last[end] = token
                out[end] = out[at] + cost[token]
        return out[1:]

    def encoded(self, text: str) -> list[tuple[list[int], int]]:
        """(ids, characters) of each token of a stretch of normalised text."""
        last, at, out = self.prefixes(text), len(text), []
        while at:
            t = last[at]
            out.append((self.ids[t], self.length[t]) if t else (self.ids_of(text[at - 1]), 1))
            at -= out[-1][1]
        return out[::-1]

    def stretches(self, text: str) -> list[str]:
        """Cuts normalised text where no piece crosses."""
        return self.segment(text) if self.segment else [text] * bool(text)

    def normalised(self, text: str) -> tuple[str, list[int]]:
        """Normalised text, and for each of its characters and its end the byte of the source where it comes from.

        At each place the longest key of the character map is replaced; what no key matches stays. Spaces are
        squeezed, escaped and prefixed as the model says.
        """
        data, out, src, at = text.encode("utf-8", "replace"), [], [], 0
        space = SPACE if self.escape else " "

        def prefix(k: int) -> tuple[int, str]:
            if self.chars and (hit := self.chars.longest(data, k)):
                return hit[0], hit[1].decode("utf-8", "replace")
            lead = data[k]
            n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            return n, data[k : k + n].decode("utf-8", "replace")

        if self.squeeze:
            while at < len(data) and (p := prefix(at))[1] == " ":
                at += p[0]
        if at >= len(data):
            return "", [at]
        if self.dummy and not self.suffix:
            out.append(space)
            src.append(at)
        blank = self.squeeze
        while at < len(data):
            used, made = prefix(at)
            while blank and made.startswith(" "):
                made = made[1:]
            for c in made:
                out.append(space if c == " " else c)
                src.append(at)
            if made:
                blank = made.endswith(" ")
            at += used
            blank = blank and self.squeeze
        if self.squeeze:
            while out and out[-1] == space:
                out.pop()
                at = src.pop()
        if self.dummy and self.suffix:
            out.append(space)
            src.append(at)
        return "".join(out), [*src, at]

    def decoded(self, ids: list[int]) -> str:
        """Text of ids: bytes that aren't UTF-8 become U+FFFD, control ids nothing."""
        of = self.bytes_of
        if (self.dummy or self.squeeze) and not self.suffix:
            k = next((k for k, i in enumerate(ids) if i not in self.control), len(ids))
            if k < len(ids) and ids[k] not in self.bytes_id.values() and of[ids[k]].startswith(b" "):
                head = of[ids[k]].lstrip(b" ") if self.squeeze else of[ids[k]][1:]
                return (head + b"".join(map(of.__getitem__, ids[k + 1 :]))).decode("utf-8", "replace")
        return b"".join(map(of.__getitem__, ids)).decode("utf-8", "replace")


class Remembered(dict):
    """Values of short stretches, made when first asked for; full at ``most``."""

    def __init__(self, make, most: int = 150_000) -> None:
        self.make, self.most = make, most

    def __missing__(self, key: str):
        value = self.make(key)
        if len(self) < self.most and len(key) <= 64:
            self[key] = value
        return value


@lru_cache(maxsize=2)
def model(blob: bytes) -> Model:
    """One model per Python worker and file."""
    return Model(blob)
