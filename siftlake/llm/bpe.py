"""Byte-pair encoding as a bounded-lookahead streaming transducer, and its decoder.

A merge list decides how far to the right a text can still change the tokens on the left. ``lookahead`` computes a
bound on that distance from the list alone. ``PieceStream`` keeps one window of at most ``lookahead + STEP`` bytes,
merges it, and emits a token as soon as it ends ``lookahead`` bytes before the window's end: nothing that follows can
change it. ``TextStream`` does the same for text in blocks of any size: it cuts the text into the pieces that merges
never cross, holds back what the next block may still change, and feeds pieces of any length to a ``PieceStream``.
``ByteToText`` is the inverse state machine: it holds at most three bytes of an unfinished character.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterable, Iterator
from itertools import pairwise

import regex

#: How byte-level vocabularies cut text before merging (fixed pattern of the published vocabulary).
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters from which on Unicode versions of two regular-expression libraries may class differently.
RARE = regex.compile("[\u0558\u058b\u058c\u088f\u0c5c\u0cdc\u1c89\u1c8a\u208f\u209d-\u209f\ua7cb-\ua7f1\uab6c\uab6d\U00010000-\U0010ffff]")
#: Bytes that a window takes in at once.
STEP = 4096
NO_RANK = 1 << 60
#: Characters of one block of text, and bytes of what a stream or counter keeps of words it has met.
BLOCK, CACHE_BYTES = 1 << 16, 128 << 20


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in of each byte in byte-level vocabularies: itself if printable, else 256, 257, ..."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Merges:
    """A vocabulary file's merge list over ids.

    ``end`` is the suffix that marks a word's last symbol ("" if the vocabulary has none).
    """

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model.get("end_of_word_suffix") or ""
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.rank: dict[int, int] = {}  # left << 20 | right -> rank << 20 | merged
        order = []
        for k, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            u, v, w = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.rank.setdefault(u << 20 | v, k << 20 | w)
            order.append((u, v, w))
        self.order = order
        letters = byte_alphabet()
        self.of_byte = [0] * 256
        self.last_of_byte = [0] * 256
        for ch, b in letters.items():
            self.of_byte[b] = self.vocab[ch]
            self.last_of_byte[b] = self.vocab.get(ch + self.end, self.vocab[ch])
        size = max(max(self.vocab.values()), *self.special.values(), 0) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in self.vocab.items():
            body = token.removesuffix(self.end) if self.end else token
            self.bytes_of[i] = bytes(letters[c] for c in body)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.ids = list(range(size))  # shared int objects for caches

    def start(self, data: bytes) -> list[int]:
        of = self.of_byte
        out = [of[b] for b in data]
        if self.end and out:
            out[-1] = self.last_of_byte[data[-1]]
        return out

    def merge(self, data: bytes) -> list[int]:
        """Ids of one piece, merged whole: always the lowest rank first, the leftmost of equals."""
        seq = self.start(data)
        if len(seq) > 200:
            return self._merge_long(seq)
        get = self.rank.get
        ranks = [get(a << 20 | b, NO_RANK) for a, b in pairwise(seq)]
        while ranks and (best := min(ranks)) != NO_RANK:
            k, new = ranks.index(best), best & 0xFFFFF
            seq[k] = new
            del seq[k + 1], ranks[k]
            if k < len(ranks):
                ranks[k] = get(new << 20 | seq[k + 1], NO_RANK)
            if k:
                ranks[k - 1] = get(seq[k - 1] << 20 | new, NO_RANK)
        return seq

    def _merge_long(self, seq: list[int]) -> list[int]:
        n, get = len(seq), self.rank.get
        left, right, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        heap = [(r >> 20, k, r & 0xFFFFF, seq[k], seq[k + 1]) for k in range(n - 1) if (r := get(seq[k] << 20 | seq[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, new, a, b = heapq.heappop(heap)
            j = right[k]
            if not alive[k] or seq[k] != a or j >= n or seq[j] != b:
                continue
            seq[k], alive[j], right[k] = new, False, right[j]
            for x, y in ((k, right[k]), (left[k], k)):
                if x >= 0 and y < n:
                    if y == right[k]:
                        left[y] = k
                    if (r := get(seq[x] << 20 | seq[y])) is not None:
                        heapq.heappush(heap, (r >> 20, x, r & 0xFFFFF, seq[x], seq[y]))
        return [s for s, ok in zip(seq, alive, strict=True) if ok]

    def lookahead(self) -> int:
        """Bytes to the right of a token's end that can still decide about it; a bound from the merge list alone.

        Take text whose continuation is unknown. At first every byte before its end is certain. Applying a rule (u, v)
        makes the last certain token uncertain only if it is u and what follows may be v, so the certain part shrinks
        by the length of u. What starts at the new border is u or something grown from it on its left edge; the next
        rule that moves the border must therefore have, as v, a token whose left edge contains u, and a later rank.
        The bound is the heaviest such chain. It holds for lists in which each rule's parts are made by earlier ones.
        """
        made = {*self.of_byte, *self.last_of_byte}
        edge: dict[int, int] = {}  # token -> the token on its left edge
        heaviest: dict[int, int] = {}  # token u -> heaviest chain that ended with u
        most = 0
        for u, v, w in self.order:
            if u not in made or v not in made:
                raise ValueError("a merge uses a token that no earlier merge makes; no lookahead can be derived")
            before, x = 0, v
            while x is not None:
                before = max(before, heaviest.get(x, 0))
                x = edge.get(x)
            weight = before + len(self.bytes_of[u])
            heaviest[u] = max(heaviest.get(u, 0), weight)
            most = max(most, weight)
            if w not in made:
                made.add(w)
                edge[w] = u
            elif edge.get(w) != u:  # made in two ways: both edges lead on
                heaviest[w] = max(heaviest.get(w, 0), weight)
        return most + max(map(len, self.bytes_of))


class PieceStream:
    """Ids of one piece that arrives in parts; keeps at most one window of bytes."""

    def __init__(self, merges: Merges, ahead: int):
        self.merges, self.ahead, self.window = merges, ahead, b""

    def whole(self, data: bytes) -> list[int]:
        """feed() and finish() of a piece that comes at once."""
        if len(data) <= STEP:
            # too short for a window to fill, so no token leaves before the end
            self.window += data
            return self.finish()
        return [i for part in self.feed(data) for i in part] + self.finish()

    def feed(self, data: bytes) -> Iterator[list[int]]:
        for k in range(0, len(data), STEP):
            self.window += data[k : k + STEP]
            if len(self.window) >= self.ahead + STEP:
                yield self._stable()

    def _stable(self) -> list[int]:
        ids, most = self.merges.merge(self.window), len(self.window) - self.ahead
        end = n = 0
        lengths = self.merges.bytes_of
        while end + len(lengths[ids[n]]) <= most:
            end += len(lengths[ids[n]])
            n += 1
        self.window = self.window[end:]
        return ids[:n]

    def finish(self) -> list[int]:
        ids, self.window = self.merges.merge(self.window), b""
        return ids


def kept_bytes(key: str) -> int:
    """About what a word takes in a cache with its value, both of which grow with its length; on the safe side."""
    return 240 + 6 * len(key)


class TextStream:
    """Text in blocks -> blocks of values, one value for each chunk that merges never cross.

    ``value`` turns a list of ids into what is kept and returned for a chunk (ids, packed bytes, a count ...).
    ``split`` cuts chunks with characters of ``RARE`` (the tokenizer library's own cutter). What words it has met give is
    kept until it takes ``room`` bytes; it then stays as it is, since what comes often came early.
    """

    def __init__(self, merges: Merges, ahead: int, value: Callable[[list[int]], object], split: Callable[[str], list[str]], room: int = CACHE_BYTES):
        self.merges, self.ahead, self.value, self.split, self.room = merges, ahead, value, split, room
        self.pieces = regex.compile(PIECES)
        self.short = PieceStream(merges, ahead)  # empty between pieces
        self.piece_ids: dict[str, list[int]] = {}
        self.spaced: dict[str, object] = {}
        self.bare: dict[str, object] = {}
        self.newline = value(merges.merge(b"\n"))

    def ids_of(self, piece: str, keep: bool = True) -> list[int]:
        got = self.piece_ids.get(piece)
        if got is None:
            got = self.short.whole(piece.encode())
            if keep and self.room > 0 and len(piece) < 64:
                self.piece_ids[piece] = got
                self.room -= kept_bytes(piece)
        return got

    def cut(self, chunk: str) -> list[str]:
        return self.split(chunk) if RARE.search(chunk) else self.pieces.findall(chunk)

    def _chunk(self, chunk: str, lead: str, cache: dict) -> object | None:
        """Value of a chunk that the cache lacks; None if its edges are not sure to be borders of pieces."""
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            return None
        # ASCII letters after at most a space are one piece
        pieces = [lead + chunk] if chunk.isascii() and chunk.isalpha() else self.cut(lead + chunk)
        kept = self.room > 0 and len(chunk) < 64
        # a chunk of one piece is kept as such
        got = self.value(self.ids_of(pieces[0], not kept) if len(pieces) == 1 else [i for p in pieces for i in self.ids_of(p)])
        if kept:
            cache[chunk] = got
            self.room -= kept_bytes(chunk)
        return got

    def _lines(self, text: str) -> list | None:
        """The usual case, words between single spaces and newlines: one cache lookup a word. None if it isn't that."""
        out: list = []
        spaced, bare, newline = self.spaced, self.bare, self.newline
        for n, line in enumerate(text.split("\n")):
            if n:
                out.append(newline)
            first, *rest = line.split(" ")
            got = bare.get(first)
            if got is None and (got := self._chunk(first, "", bare)) is None:
                return None
            out.append(got)
            if rest:
                at = len(out)
                out += map(spaced.get, rest)
                if None in out[at:]:
                    for k, word in enumerate(rest, at):
                        if out[k] is None:
                            if (got := self._chunk(word, " ", spaced)) is None:
                                return None
                            out[k] = got
        return out

    def _block(self, text: str) -> list:
        """Values of a text both of whose ends are borders of pieces."""
        if not text:
            return []
        got = self._lines(text)
        if got is None:
            got = [self.value([i for p in self.cut(text) for i in self.ids_of(p)])]
        return got

    def feed_all(self, blocks: Iterable[str]) -> Iterator[list]:
        """Values of the text that the blocks make up, as soon as later blocks cannot change them."""
        blocks, held = iter(blocks), ""
        for block in blocks:
            held += block
            if cut := self._safe(held):
                yield self._block(held[:cut])
                held = held[cut:]
            elif len(held) >= 2 * BLOCK:
                held = yield from self._no_space(held, blocks)
        if held:
            yield self._block(held)

    @staticmethod
    def _safe(text: str) -> int:
        """The last place before a single space inside words: there a piece begins, whatever comes later. 0: none."""
        k = text.rfind(" ", 1, len(text) - 1)
        while k > 0 and (text[k + 1].isspace() or text[k - 1].isspace()):
            k = text.rfind(" ", 1, k)
        return max(k, 0)

    def _no_space(self, held: str, blocks: Iterator[str]) -> Iterator[list]:
        """A long text without such a place. Gives out all pieces but the last two, which may go on; returns the rest."""
        pieces = self.cut(held)
        if len(pieces) > 2:
            done = pieces[:-2]
        else:
            done = pieces[:-1] if len(pieces[-1]) >= BLOCK else []
        if done:
            yield [self.value([i for p in done for i in self.ids_of(p)])]
            held = held[sum(map(len, done)) :]
        if len(pieces) > 2:
            return held
        return (yield from self._endless(held, blocks))

    def _endless(self, held: str, blocks: Iterator[str]) -> Iterator[list]:
        """A piece longer than two blocks: its bytes pass through one window. Returns the text after it."""
        letter = held[1] if held[0] == " " and not held[1].isspace() else held[0]
        run = next(r for r in (regex.compile(r"\p{L}*"), regex.compile(r"\p{N}*"), regex.compile(r"\s*"), regex.compile(r"[^\s\p{L}\p{N}]*")) if r.match(letter).end())
        blank, stream = bool(regex.match(r"\s", letter)), PieceStream(self.merges, self.ahead)
        skip = 1 if letter != held[0] else 0
        while True:
            end = run.match(held, skip).end()
            skip = 0
            if end < len(held):
                end -= blank  # a letter follows: the last space belongs to it
                rest = held[end:]
                break
            for ids in stream.feed(held[:-1].encode()):
                yield [self.value(ids)]
            last, more = held[-1], next(blocks, None)
            if more is None:
                end, rest = 1, ""
                held = last
                break
            held = last + more
        for ids in stream.feed(held[:end].encode()):
            yield [self.value(ids)]
        yield [self.value(stream.finish())]
        return rest

    def document(self, text: str) -> Iterator[list]:
        """Blocks of values of a whole text; special strings in it become their ids."""
        parts = [text]
        for name, i in self.merges.special.items():
            parts = [y for x in parts for y in (_between(x.split(name), i) if isinstance(x, str) and name in x else [x])]
        for part in parts:
            if isinstance(part, int):
                yield [self.value([part])]
            else:
                yield from self.feed_all(part[k : k + BLOCK] for k in range(0, len(part), BLOCK))


def _between(parts: list, mark: int) -> list:
    out: list = [parts[0]]
    for part in parts[1:]:
        out += [mark, part]
    return out


class ByteToText:
    """Bytes in parts -> text in parts. State: the bytes of a character that is not complete yet, three at most.

    Bytes that belong to no character become U+FFFD, one for each longest valid beginning.
    """

    #: Bytes that a character has, by the upper bits of its first byte (fixed: UTF-8).
    LENGTH = {0b110: 2, 0b1110: 3, 0b11110: 4}

    def __init__(self):
        self.held = b""

    def feed(self, data: bytes) -> str:
        data = self.held + data
        self.held = b""
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if b & 0xC0 == 0x80:
                continue
            need = self.LENGTH.get(b >> 5) or self.LENGTH.get(b >> 4) or self.LENGTH.get(b >> 3) or 1
            if need > back:
                data, self.held = data[:-back], data[-back:]
            break
        return data.decode("utf-8", "replace")

    def finish(self) -> str:
        out, self.held = self.held.decode("utf-8", "replace"), b""
        return out
