"""Byte-level BPE as a bounded-lookahead streaming transducer, and decoding by an incremental byte-to-text machine.

Encoding. For every prefix of a word there is exactly one token that can be the last one of that prefix's encoding: the
token whose pair with the last token before it is compatible, that is, no merge would ever have joined bytes across their
border. The transducer keeps that token for each place of a short window. A token is emitted once it is stable: once all
places at which a later token can still begin agree on everything up to it. How far behind the input that can be is bounded
by the merge list alone (`Merges.lookahead`), so memory is constant for words and texts of any length.

Words come from the tokenizer's splitting pattern. A run of texts is cut where no word can cross (before a space or line end
that follows a non-blank); each different piece of the run goes through the transducer once, unless a table of bounded bytes
still has it, and its ids are copied to all its places. A text over RUN bytes is streamed: read in chunks, its ids digested
and decoded as they come, an open word of any length held by the transducer's window. What a task holds beside its Arrow
batch is so bounded by RUN, CHUNK and KEPT_BYTES, whatever the length of a text.

Defined cases: null and empty texts have no tokens and decode to the empty text; special tokens written in a text become
their own ids; invalid bytes decode to U+FFFD; repeated rows each have their own; other columns are not read, so their names
can't clash; an empty table gives an empty result.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes
from .common import frugal, prepare, runs, utf8_views

# Fixed value: the splitting pattern of the tokenizer's byte-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG = 256
KEPT_BYTES = 24 << 20  # of a generation of pieces; two are held
CHUNK = 1 << 16
RUN = 1 << 20
_NEVER = 1 << 60


def byte_letters() -> dict[int, str]:
    """Byte to the letter that stands for it in the vocabulary: printable bytes for themselves, the others in order from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in plain}
    out.update({b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in out)})
    return out


class Merges:
    """A merge list in rank order over byte tokens; each merge's parts are bytes or earlier results, and results differ."""

    def __init__(self, tokens: dict[int, bytes], merges: list[tuple[int, int, int]]):
        """tokens: id to bytes. merges: (left id, right id, result id)."""
        self.bytes_of = tokens
        size = max(tokens, default=0) + 1
        self.form = [-1] * size
        self.left, self.right = list(range(size)), list(range(size))
        self.rank: dict[tuple[int, int], int] = {}
        for r, (a, b, c) in enumerate(merges):
            if self.form[c] >= 0 or tokens[c] != tokens[a] + tokens[b] or len(tokens[a]) > 1 and self.form[a] < 0 or len(tokens[b]) > 1 and self.form[b] < 0:
                raise ValueError(f"merge {r} is not proper")
            self.form[c], self.left[c], self.right[c], self.rank[a, b] = r, a, b, r
        self.id_of = {b: t for t, b in tokens.items() if len(b) == 1 or self.form[t] >= 0}
        self.longest = max(map(len, self.id_of), default=1)
        # every suffix of a token, with the token that it is or -1
        self.tails = {b[k:]: -1 for b in self.id_of for k in range(len(b))} | self.id_of
        self.prefixes = {b[: k + 1] for b in self.id_of for k in range(len(b))}
        self._pairs: dict[int, bool] = {}  # left id << 32 | right id

    @property
    def lookahead(self) -> int:
        """Bytes to the right of a place after which the border there cannot change any more.

        A merge (u, v) that happens in one continuation but not in another was forestalled: an earlier rule took a token
        that ends v (v itself or one on the right edge of its derivation) away to the right, which in turn depended on a
        still earlier rule at that one's right edge, and so on. Ranks fall along such a chain, so the longest chain is
        found by one pass over the list in rank order.
        """
        reach: dict[int, int] = {}  # token to the farthest reach of the rules so far that have it on the left
        most = 1
        for (a, b), _ in sorted(self.rank.items(), key=lambda x: x[1]):
            edge, far = b, reach.get(b, 0)
            while self.form[edge] >= 0:
                edge = self.right[edge]
                far = max(far, reach.get(edge, 0))
            mine = len(self.bytes_of[b]) + far
            reach[a] = max(reach.get(a, 0), mine)
            most = max(most, mine)
        return most

    def compatible(self, a: int, b: int) -> bool:
        """Whether the encoding of a's bytes and b's bytes is a, b: walking both derivations back from the border, no rule
        joins two tokens that stand at the border at the same time. Of equal rules the left one goes first."""
        form, rank = self.form, self.rank
        x, y, x_ends, y_ends, out = a, b, _NEVER, _NEVER, True
        while True:
            r = rank.get((x, y))
            if r is not None and r < x_ends and r <= y_ends:
                out = False
                break
            fx, fy = form[x], form[y]
            if fx < 0 and fy < 0:
                break
            if fx >= fy:
                x_ends, x = fx, self.right[x]
            if fy >= fx:
                y_ends, y = fy, self.left[y]
        if len(self._pairs) > 1 << 17:
            self._pairs.clear()
        self._pairs[a << 32 | b] = out
        return out

    def last_tokens(self, data: bytes, last: list[int], start: int) -> None:
        """Extend last (last[i]: the token that ends the encoding of the first i bytes; last[0]: the one before, or -1)
        over data[start:]."""
        tail, known, compatible = self.tails.get, self._pairs.get, self.compatible
        for end in range(start + 1, len(data) + 1):
            begin = end - 1
            token = tail(data[begin:end])
            while token is not None:
                if token >= 0:
                    before = last[begin]
                    if before < 0:
                        break
                    fits = known(before << 32 | token)
                    if fits or fits is None and compatible(before, token):
                        break
                begin -= 1
                token = tail(data[begin:end]) if begin >= 0 else None
            if token is None:
                raise ValueError(f"byte {data[end - 1]} has no token")
            last.append(token)

    def encode_word(self, data: bytes) -> list[int]:
        last = [-1]
        self.last_tokens(data, last, 0)
        return self.chain(last, len(data))

    def chain(self, last: list[int], at: int) -> list[int]:
        out = []
        while at > 0:
            out.append(last[at])
            at -= len(self.bytes_of[last[at]])
        return out[::-1]


class Transducer:
    """Encodes one word given in pieces; holds a window of unstable bytes only. Up to `step` bytes are taken in before the
    first look for stable tokens, so a short word is passed over once."""

    def __init__(self, merges: Merges):
        self.m = merges
        self.window, self.last = b"", [-1]
        self.step = max(64, merges.longest)

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        for at in range(0, len(data), self.step):
            known = len(self.window)
            self.window += data[at : at + self.step]
            self.m.last_tokens(self.window, self.last, known)
            if len(self.window) >= self.step:
                out += self._stable()
        return out

    def finish(self) -> list[int]:
        out = self.m.chain(self.last, len(self.window))
        self.window, self.last = b"", [-1]
        return out

    def _stable(self) -> list[int]:
        """The tokens up to the last place that every place where a later token may begin descends from."""
        n, size = len(self.window), self.m.bytes_of
        line, at = {n}, n
        while at > 0:
            at -= len(size[self.last[at]])
            line.add(at)
        common = n
        for begin in range(max(0, n - self.m.longest + 1), n):
            if self.window[begin:] in self.m.prefixes:
                at = begin
                while at not in line:
                    at -= len(size[self.last[at]])
                common = min(common, at)
        if common == 0:
            return []
        out = self.m.chain(self.last, common)
        self.window = self.window[common:]
        self.last = self.last[common:]
        return out


class HashTable:
    """64-bit keys to 32-bit values in two arrays with linear probing, looked up for whole arrays at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.mask, self.shift = (1 << bits) - 1, np.uint64(64 - bits)
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = np.flatnonzero(self.keys[slot] < 0)
            self.keys[slot[free]] = keys[left[free]]  # of several for one slot the last stays
            held = self.keys[slot] == keys[left]
            self.values[slot[held]] = values[left[held]]
            left, slot = left[~held], (slot[~held] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * textbytes.PRIME) >> self.shift).view(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values; -1 for keys that are not there."""
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], np.int32(-1))
        left = np.flatnonzero((found != keys) & (found >= 0))
        while len(left):
            slot_left = slot[left] = (slot[left] + 1) & self.mask
            found = self.keys[slot_left]
            out[left] = np.where(found == keys[left], self.values[slot_left], np.int32(-1))
            left = left[(found != keys[left]) & (found >= 0)]
        return out


class Lanes:
    """The transducer's step for many short words at once: at place j of all of them, the token that ends there is looked
    for from the shortest on, along a trie of reversed tokens, in arrays with a lane a word."""

    MOST = 64  # bytes; a longer word goes through a transducer of its own
    WIDTH = 1 << 14  # words at once

    def __init__(self, merges: Merges):
        self.m = merges
        self.sizes = np.zeros(len(merges.form), np.int64)
        node_of: dict[bytes, int] = {b"": 0}
        edges, tokens = [], [-1]
        for tail in sorted(merges.tails, key=len):
            parent = node_of[tail[1:]]
            node = node_of[tail] = len(tokens)
            edges.append(parent << 8 | tail[0])
            tokens.append(merges.tails[tail])
            if tokens[-1] >= 0:
                self.sizes[tokens[-1]] = len(tail)
        self.child = HashTable(np.array(edges, np.int64), np.arange(1, len(tokens), dtype=np.int32))
        self.token = np.array(tokens, np.int32)
        pairs = np.array([a << 32 | b for a, b in merges.rank], np.int64)
        self.rank = HashTable(pairs, np.fromiter(merges.rank.values(), np.int32, len(merges.rank)))
        self.form, self.left, self.right = (np.array(x, np.int64) for x in (merges.form, merges.left, merges.right))
        self.seen = np.full(1 << 16, -1, np.int64)  # pairs by slot, twice the key plus the answer

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merges.compatible for arrays; answers are kept by slot, the last one of a slot."""
        key = a.astype(np.int64) << 32 | b
        slot = ((key.view(np.uint64) * textbytes.PRIME) >> np.uint64(48)).view(np.int64)
        held = self.seen[slot]
        out = (held & 1).astype(bool)
        new = np.flatnonzero(held >> 1 != key)
        if len(new):
            some, back = np.unique(key[new], return_inverse=True)
            fits = self._walk(some >> 32, some & 0xFFFFFFFF)
            self.seen[slot[new]] = key[new] << 1 | fits[back]
            out[new] = fits[back]
        return out

    def _walk(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        at = np.arange(len(x))
        x_ends, y_ends = np.full(len(x), _NEVER), np.full(len(x), _NEVER)
        while len(at):
            r = self.rank.get(x << 32 | y)
            joined = (r >= 0) & (r < x_ends) & (r <= y_ends)
            out[at[joined]] = False
            fx, fy = self.form[x], self.form[y]
            on = ~joined & ((fx >= 0) | (fy >= 0))
            at, x, y, x_ends, y_ends, fx, fy = (v[on] for v in (at, x, y, x_ends, y_ends, fx, fy))
            one, two = fx >= fy, fy >= fx
            x_ends, x = np.where(one, fx, x_ends), np.where(one, self.right[x], x)
            y_ends, y = np.where(two, fy, y_ends), np.where(two, self.left[y], y)
        return out

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, little-endian."""
        out: list[bytes] = [b""] * len(words)
        order = sorted((i for i, w in enumerate(words) if len(w) <= self.MOST), key=lambda i: -len(words[i]))
        for start in range(0, len(order), self.WIDTH):
            own = order[start : start + self.WIDTH]
            for i, ids in zip(own, self._together([words[i] for i in own])):
                out[i] = ids
        for i, word in enumerate(words):
            if len(word) > self.MOST:
                machine = Transducer(self.m)
                out[i] = np.array(machine.feed(word) + machine.finish(), "<u4").tobytes()
        return out

    def _together(self, words: list[bytes]) -> list[bytes]:
        """words: longest first."""
        n, most = len(words), len(words[0])
        length = np.fromiter(map(len, words), np.int64, n)
        data = np.frombuffer(b"".join(w.ljust(most, b"\0") for w in words), np.uint8).reshape(n, most)
        last = np.full((most + 1, n), -1, np.int32)
        for end in range(1, most + 1):
            lanes = np.arange(np.searchsorted(-length, -end, side="right"))
            node = np.zeros(len(lanes), np.int64)
            for begin in range(end - 1, -1, -1):
                node = self.child.get(node << 8 | data[lanes, begin])
                token = self.token[node]
                if (node < 0).any():
                    raise ValueError(f"byte {int(data[lanes[node < 0][0], end - 1])} has no token")
                done = token >= 0
                if begin:
                    ask = np.flatnonzero(done)
                    done[ask] = self.compatible(last[begin, lanes[ask]], token[ask])
                last[end, lanes[done]] = token[done]
                lanes, node = lanes[~done], node[~done].astype(np.int64)
                if not len(lanes):
                    break
            if len(lanes):
                raise ValueError(f"byte {int(data[lanes[0], end - 1])} has no token")
        ids = np.zeros((n, most), np.uint32)  # from the right
        lanes, at, used = np.arange(n), length.copy(), np.zeros(n, np.int64)
        lanes = lanes[length > 0]
        k = 0
        while len(lanes):
            k += 1
            token = last[at[lanes], lanes]
            ids[lanes, most - k] = token
            at[lanes] -= self.sizes[token]
            used[lanes] = k
            lanes = lanes[at[lanes] > 0]
        flat, row = ids.astype("<u4").tobytes(), 4 * most
        return [flat[(i + 1) * row - 4 * u : (i + 1) * row] for i, u in enumerate(used.tolist())]


class Kept:
    """Encodings (little-endian 32-bit ids) by piece. A generation ends when it has `limit` bytes; it becomes the old one and
    the one before is dropped, so what is asked for often stays and the memory is bounded."""

    ENTRY = 200  # bytes that an entry takes besides its piece and ids

    def __init__(self, limit: int = KEPT_BYTES):
        self.limit, self.bytes, self.new, self.old = limit, 0, {}, {}

    def get(self, piece: bytes) -> bytes | None:
        out = self.new.get(piece)
        if out is None:
            out = self.old.get(piece)
            if out is not None:
                self.put(piece, out)
        return out

    def put(self, piece: bytes, ids: bytes) -> None:
        if len(piece) <= LONG:
            self.bytes += self.ENTRY + len(piece) + len(ids)
            if self.bytes > self.limit:
                self.old, self.new, self.bytes = self.new, {}, 0
            self.new[piece] = ids


class Tokenizer:
    """A byte-level BPE tokenizer file (JSON) with its special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        back = {c: b for b, c in byte_letters().items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.table = {i: bytes(back[c] for c in t) for t, i in model["vocab"].items() if t not in self.special}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        vocab = model["vocab"]
        self.merges = Merges(dict(self.table), [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])
        self.table |= {i: t.encode() for t, i in self.special.items()}
        self.pattern = regex.compile(PATTERN)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.split_bytes = re.compile(b"|".join(re.escape(s.encode()) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        if any(regex.search(r"\s", mark) for mark in self.special):
            raise ValueError("special tokens with blanks are not supported")
        self.lanes = Lanes(self.merges)
        self.kept = Kept()
        size = max(self.table, default=-1) + 1
        self.sizes = np.array([len(self.table.get(i, b"")) for i in range(size)], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.letters = np.frombuffer(b"".join(self.table.get(i, b"") for i in range(size)), np.uint8)

    def _words(self, piece: bytes) -> list[bytes | int]:
        """The words of a piece, and ids of special tokens in it."""
        if piece.isalpha() or piece[:1] == b" " and piece[1:].isalpha():  # ASCII letters only
            return [piece]
        text = piece.decode()
        if self.split_special is None or not any(s in text for s in self.special):
            return [w.encode() for w in self.pattern.findall(text)]
        out: list[bytes | int] = []
        for part in self.split_special.split(text):
            out += [self.special[part]] if part in self.special else [w.encode() for w in self.pattern.findall(part)]
        return out

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each of the different pieces; those that are not kept have their words encoded side by side."""
        out = list(map(self.kept.get, pieces))
        new = [i for i, ids in enumerate(out) if ids is None]
        words = [self._words(pieces[i]) for i in new]
        lane: dict[bytes | int, int] = {}
        for own in words:
            for w in own:
                lane.setdefault(w, len(lane))
        ids = dict(zip(lane, self.lanes.encode([w if isinstance(w, bytes) else b"" for w in lane])))
        ids |= {w: np.array([w], "<u4").tobytes() for w in lane if not isinstance(w, bytes)}
        for i, own in zip(new, words):
            out[i] = ids[own[0]] if len(own) == 1 else b"".join([ids[w] for w in own])
            self.kept.put(pieces[i], out[i])
        return out

    def encode_run(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts raw[off[i]:off[i+1]] (off[0] = 0, UTF-8), one after the other, and each text's offset in them.

        The run is cut into pieces that no word crosses; each different piece is encoded once and its ids are copied to all
        its places. Pieces are told apart by a 64-bit hash, and every piece is compared with the one that stands for it.
        """
        data = raw.tobytes()
        begins = piece_starts(raw, off, [m.span() for m in self.split_bytes.finditer(data)] if self.split_bytes else [])
        if not len(begins):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        ends = np.append(begins[1:], len(raw))
        sizes = ends - begins
        _, stands, which = np.unique(textbytes.word_hashes(raw, begins, ends), return_index=True, return_inverse=True)
        if not same_bytes(raw, begins, begins[stands][which], sizes, sizes[stands][which]):
            order: dict[bytes, int] = {}
            which = np.array([order.setdefault(data[a:b], len(order)) for a, b in zip(begins.tolist(), ends.tolist())])
            stands = np.unique(which, return_index=True)[1]
        coded = self.encode_pieces([data[a:b] for a, b in zip(begins[stands].tolist(), ends[stands].tolist())])
        ids = np.frombuffer(b"".join(coded), "<u4")
        length = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        own = length[which]
        at = np.zeros(len(own) + 1, np.int64)
        np.cumsum(own, out=at[1:])
        source = np.repeat((np.cumsum(length) - length)[which] - at[:-1], own) + np.arange(at[-1])
        return ids[source], at[np.searchsorted(begins, off)]

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        stream = StreamEncoder(self)
        return stream.feed((text or "").encode()) + stream.finish()

    def decode(self, ids: bytes) -> str:
        machine = Decoder(self)
        return "".join([*(machine.feed(ids[k : k + 4 * CHUNK]) for k in range(0, len(ids), 4 * CHUNK)), machine.finish()])


_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = True
_KIND = np.zeros(256, np.uint8)  # 0: not ASCII, or a control character; 1 letter, 2 digit, 3 mark, 4 blank
_KIND[0x20:0x7F] = 3
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_KIND[0x30:0x3A] = 2
_KIND[[0x20, 0x0A]] = 4


def blank_starts(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Marks the start of each text, and each space or line end right after a character that is no blank. A word takes in
    nothing before a blank but what is no blank, so no word crosses such a place. Characters that share their first bytes
    with a blank of more than one byte count as blanks, which only makes a piece longer."""
    n = len(raw)
    cut = _KIND[raw] == 4
    blank = _BLANK[raw]
    blank[1:] |= (raw[:-1] == 0xC2) & ((raw[1:] == 0x85) | (raw[1:] == 0xA0))
    if n > 2:
        lead = (raw[:-2] >= 0xE1) & (raw[:-2] <= 0xE3)
        blank[2:] |= lead & ((raw[1:-1] == 0x80) | (raw[1:-1] == 0x81) | (raw[1:-1] == 0x9A))
    cut[1:] &= ~blank[:-1]
    cut[off[:-1][off[:-1] < n]] = True
    return cut


def piece_starts(raw: np.ndarray, off: np.ndarray, marks: list[tuple[int, int]]) -> np.ndarray:
    """Places where texts are cut: blank_starts, and changes between ASCII letters, digits and other marks, but for the place
    after an apostrophe, which may begin a contraction. None is inside a special token (marks: their spans)."""
    kind = _KIND[raw]
    change = np.zeros(len(raw), bool)
    change[1:] = (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[1:] < 4) & (kind[:-1] > 0) & (kind[:-1] < 4) & (raw[:-1] != 0x27)
    cut = blank_starts(raw, off)
    cut |= change
    for low, high in marks:
        cut[low + 1 : high] = False
    cut[off[:-1][off[:-1] < len(raw)]] = True
    return np.flatnonzero(cut)


def same_bytes(raw: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray, sizes_b: np.ndarray) -> bool:
    if not np.array_equal(sizes, sizes_b):
        return False
    other = np.repeat(b - a, sizes)
    other += np.arange(len(raw))
    return np.array_equal(raw[other], raw)


class StreamEncoder:
    """Encodes a text given in UTF-8 chunks of any size; what it holds is bounded however long the text or a word in it is.

    All but the last piece of a chunk goes on as a run. An open piece is held back; once it is over `hold` bytes its words
    are taken one by one, and the bytes of a word that is itself as long go to a transducer, of which only the kind is kept.
    """

    KINDS = (regex.compile(r"\p{L}+"), regex.compile(r"\p{N}+"), regex.compile(r"[^\s\p{L}\p{N}]+"), regex.compile(r"\s+"))

    def __init__(self, tokenizer: Tokenizer, hold: int = 4 * LONG):
        self.t, self.hold = tokenizer, hold
        self.rest, self.text, self.machine, self.kind = b"", "", None, None
        self.utf8 = codecs.getincrementaldecoder("utf-8")()

    @property
    def _inside(self) -> bool:
        """Whether a long piece is open."""
        return self.machine is not None or bool(self.text) or bool(self.utf8.getstate()[0])

    def feed(self, chunk: bytes) -> bytes:
        """The ids that are stable now, little-endian."""
        out = []
        for at in range(0, len(chunk), CHUNK):
            self.rest += chunk[at : at + CHUNK]
            if self._inside:
                out.append(self._long(False))
                if self.machine is None:
                    out.append(self._leave())
            if not self._inside:
                done = self._last_cut(self.rest)
                if done:
                    out.append(self._run(self.rest[:done]))
                    self.rest = self.rest[done:]
                if len(self.rest) > self.hold:
                    out.append(self._long(False))
        return b"".join(out)

    def finish(self) -> bytes:
        out = self._long(True) if self._inside else self._run(self.rest)
        self.rest = b""
        return out

    @staticmethod
    def _last_cut(data: bytes) -> int:
        cuts = np.flatnonzero(blank_starts(np.frombuffer(data, np.uint8), np.array([0, len(data)])))
        return int(cuts[-1]) if len(cuts) else 0

    def _leave(self) -> bytes:
        """Ends the long piece if it has ended in what is held; what follows is read as pieces again."""
        data = self.text.encode()
        done = self._last_cut(data)
        if not done:
            return b""
        self.text = data[:done].decode()
        out = self._take(True)
        self.rest = data[done:] + self.utf8.getstate()[0]
        self.utf8.reset()
        return out

    def _run(self, data: bytes) -> bytes:
        return self.t.encode_run(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0].tobytes()

    def _long(self, final: bool) -> bytes:
        self.text += self.utf8.decode(self.rest, final)
        self.rest = b""
        out, marks = [], self.t.special
        while marks:
            found = min(((self.text.find(s), s) for s in marks if s in self.text), default=None)
            if found is None:
                break
            at, mark = found
            tail = self.text[at + len(mark) :]
            self.text = self.text[:at]
            out += [self._take(True), np.array([marks[mark]], "<u4").tobytes()]
            self.text = tail
        return b"".join([*out, self._take(final)])

    def _take(self, final: bool) -> bytes:
        out: list[bytes] = []
        keep = 0 if final else max([4, *map(len, self.t.special)])
        if self.machine is not None:
            run = self.kind.match(self.text)
            end = run.end() if run else 0
            limit = min(end, max(len(self.text) - keep, 0))
            blank = self.kind is self.KINDS[3]
            if blank and end < len(self.text):  # the last blank of a run stands apart before a non-blank
                limit = min(limit, max(end - 1, 0))
            out.append(self._fed(self.text[:limit]))
            self.text = self.text[limit:]
            # the run has ended for certain once enough follows it that no special token can begin right behind it
            if final or (limit >= end - blank and end <= len(self.text) + limit - keep):
                out.append(np.array(self.machine.finish(), "<u4").tobytes())
                self.machine = None
            else:
                return b"".join(out)
        words = self.t.pattern.findall(self.text)
        if final:
            self.text = ""
            return b"".join([*out, *self.t.lanes.encode([w.encode() for w in words])])
        done, size = 0, len(self.text)
        # a word may still grow or split while it is among the last ones
        while done < len(words) - 3 and size - len(words[done]) > keep:
            size -= len(words[done])
            done += 1
        out += self.t.lanes.encode([w.encode() for w in words[:done]])
        self.text = self.text[len(self.text) - size :]
        head = words[done] if done < len(words) else ""
        first = min(len(head) - 1, len(self.text) - keep)  # a special token may begin in what is kept
        if len(head) > self.hold and first > 0:
            self.kind = next(k for k in self.KINDS if k.fullmatch(head[-1]))
            self.machine = Transducer(self.t.merges)
            out.append(self._fed(self.text[:first]))
            self.text = self.text[first:]
        return b"".join(out)

    def _fed(self, text: str) -> bytes:
        return np.array(self.machine.feed(text.encode()), "<u4").tobytes()


class Decoder:
    """Ids to text: bytes are looked up and fed to a UTF-8 machine that holds an incomplete character back."""

    def __init__(self, tokenizer: Tokenizer):
        self.t = tokenizer
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: bytes) -> str:
        return self.machine.decode(decoded(self.t, np.frombuffer(ids, "<u4"))[0].tobytes())

    def finish(self) -> str:
        return self.machine.decode(b"", True)


def decoded(t: Tokenizer, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that the ids stand for, and each id's offset in them."""
    if len(ids) and (int(ids.max()) >= len(t.sizes) or not t.sizes[ids].all()):
        raise ValueError("an id has no token")
    sizes = t.sizes[ids]
    at = np.zeros(len(ids) + 1, np.int64)
    np.cumsum(sizes, out=at[1:])
    return t.letters[np.repeat(t.starts[ids] - at[:-1], sizes) + np.arange(at[-1])], at


@lru_cache(maxsize=1)
def load(path: str) -> Tokenizer:
    return Tokenizer(path)


def encoded(t: Tokenizer, column: pa.Array) -> Iterator[tuple[int, Iterator[bytes]]]:
    """Each row's number and its ids in parts. Short texts are encoded in runs of about RUN bytes; a longer text is read from
    the column's buffer in chunks and streamed, so that what is held does not grow with it."""
    off, raw = utf8_views(column)
    for start, end in runs(off, RUN):
        low, high = int(off[start]), int(off[end])
        if high - low > RUN:
            yield start, _streamed(t, raw[low:high])
            continue
        ids, at = t.encode_run(raw[low:high], off[start : end + 1] - low)
        for i in range(start, end):
            yield i, iter((ids[at[i - start] : at[i - start + 1]].tobytes(),))


def _streamed(t: Tokenizer, raw: np.ndarray) -> Iterator[bytes]:
    stream = StreamEncoder(t)
    for at in range(0, len(raw), CHUNK):
        yield stream.feed(raw[at : at + CHUNK].tobytes())
    yield stream.finish()


def round_trip(t: Tokenizer, parts: Iterator[bytes]) -> tuple[int, str, str]:
    """Number of ids, SHA-256 of the ids and of the text they decode to; parts are dropped as they are read."""
    n, own, back, machine = 0, hashlib.sha256(), hashlib.sha256(), Decoder(t)
    for ids in parts:
        n += len(ids) // 4
        own.update(ids)
        for at in range(0, len(ids), 4 * CHUNK):
            back.update(machine.feed(ids[at : at + 4 * CHUNK]).encode())
    back.update(machine.finish().encode())
    return n, own.hexdigest(), back.hexdigest()


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers in a binary)."""
    prepare(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = load(path)
        for batch in batches:
            ids = [b"".join(parts) for _, parts in encoded(t, batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return source.mapInArrow(frugal(work, load.cache_clear), f"doc_id {kind}, ids binary")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and text."""
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = load(path)
        for batch in batches:
            texts = [t.decode(ids or b"") for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(frugal(work, load.cache_clear), f"doc_id {kind}, ids binary, text string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, n_tokens, ids_sha256, decoded_sha256, each from an encode and decode round trip."""
    prepare(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = load(path)
        for batch in batches:
            rows = [round_trip(t, parts) for _, parts in encoded(t, batch.column("text"))]
            n, own, back = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(own, pa.string()), pa.array(back, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return source.mapInArrow(frugal(work, load.cache_clear), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def token_lengths(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The kept columns and n_tokens of each document."""
    prepare(docs.sparkSession)
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text).alias("__text"))
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1]), "n_tokens long"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = load(path)
        for batch in batches:
            n = pa.array([sum(map(len, parts)) // 4 for _, parts in encoded(t, batch.column("__text"))], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), n], [*keep, "n_tokens"])

    return source.mapInArrow(frugal(work, load.cache_clear), ddl)
