"""Byte-level BPE as a streaming transducer with bounded lookahead.

Text goes in by chunks of any size, token ids come out as soon as they are stable, and what is held in between is bounded,
whatever the length of the text or of a single piece of it. Two stages each have a lookahead computed from their rules:

* **Pieces.** The split pattern looks at most ``PIECE_LOOKAHEAD`` characters behind a piece, so a piece is final once so many
  characters follow it. One that is longer than a chunk is a run of letters, of numbers, of white space or of other characters: it is sent on in parts
  while it grows, and of a run of white space only the last character is held, as it may belong to what follows.
* **Tokens within a piece.** A sequence of tokens is the BPE encoding of its bytes exactly if each neighbouring pair is the
  encoding of its own bytes. So each prefix of a piece has one last token, found among the tokens that end there by looking
  at the last token of the shorter prefix; following these pointers back gives the encoding of any prefix. A token is stable once
  the pointers of all positions from which a later token may still begin (one longest token back) meet before or at its end. That happens
  within ``Bpe.lookahead`` bytes, the bound that is computed from the merge list as below.

The bound: let two texts agree up to a place. A merge left of the place can differ only because of an earlier merge that differs
right of it. The left edge of what differs moves left by one merge (x, t) only where t starts at the edge, that is where the x' of the earlier
difference is t or stands on its left spine, and only by the length of x. Going through the merges in order, with the longest reach
per left part, gives the longest such chain.
"""

from __future__ import annotations

import base64
import codecs
import itertools
from collections.abc import Iterable, Iterator

import regex

#: The split of byte-level BPE, a fixed value of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters behind a piece on which its end may depend: two for 're, 've and 'll, one for white space.
PIECE_LOOKAHEAD = 2
#: Pieces whose ids are remembered, and the longest of them in characters; the table is emptied when full.
MOST_PIECES, REMEMBERED = 200_000, 64
#: Characters that are split at once.
CHUNK = 1 << 16
#: What goes on with a run, by the kind of its last character.
RUNS = {"L": r"\p{L}+", "N": r"\p{N}+", "S": r"\s+", "O": r"[^\s\p{L}\p{N}]+"}


class Bpe:
    """ranks: bytes to id, in which lower ids merge first (the rank file of a vocabulary)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.text = {i: b for b, i in ranks.items()}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.own = {b for b in ranks if len(b) == 1}
        self.splits: dict[bytes, tuple[bytes, bytes] | None] = {}
        self._lookahead = 0
        self._suffixes: set[bytes] = set()

    @classmethod
    def load(cls, path: str) -> Bpe:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})

    # the merge rules -------------------------------------------------------------------------------------------------
    def merge(self, piece: bytes) -> list[bytes]:
        """The encoding of a short piece by its merges, lowest rank first, leftmost of equals."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def split_of(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two tokens of which ``token`` is made by the merges before its own; None for single bytes and what no merge makes. Remembered:
        there are no more than there are tokens."""
        if token not in self.splits:
            self.splits[token] = self._split_of(token)
        return self.splits[token]

    def _split_of(self, token: bytes) -> tuple[bytes, bytes] | None:
        limit = self.ranks[token]
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = limit, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1], limit)
                if r < best:
                    best, at = r, i
            if at < 0:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return (parts[0], parts[1]) if len(parts) == 2 else None

    @property
    def lookahead(self) -> int:
        """Bytes behind a token within which it is stable."""
        if not self._lookahead:
            reach: dict[bytes, int] = {}
            lefts: dict[bytes, bytes] = {}
            most = 0
            for token in sorted(self.ranks, key=self.ranks.get):
                if len(token) < 2 or not (two := self.split_of(token)):
                    continue
                left, right = two
                lefts[token] = left
                r, spine = 0, right
                while True:
                    r = max(r, reach.get(spine, 0))
                    if spine not in lefts:
                        break
                    spine = lefts[spine]
                r += len(left)
                reach[left] = max(reach.get(left, 0), r)
                most = max(most, r)
            self._lookahead = most + self.longest
        return self._lookahead

    @property
    def suffixes(self) -> set[bytes]:
        """All ends of tokens; what is none begins no token further left."""
        if not self._suffixes:
            self._suffixes = {t[i:] for t in self.ranks for i in range(len(t))}
        return self._suffixes

    def is_token(self, b: bytes) -> bool:
        """Is ``b`` in the vocabulary and its own encoding?"""
        return b in self.ranks and (len(b) == 1 or self.split_of(b) is not None)

    def fits(self, a: bytes, b: bytes) -> bool:
        """Is a, b the encoding of a + b?"""
        ok = self.pairs.get((a, b))
        if ok is None:
            ok = self._fits(a, b)
            if len(self.pairs) > MOST_PIECES:
                self.pairs.clear()
            self.pairs[a, b] = ok
        return ok

    def _fits(self, a: bytes, b: bytes) -> bool:
        """The merges of a and b are undone, the later one first, and what then stands at the border must not have been merged before the one
        undone last: the right side of a, the left side of b."""
        ranks = self.ranks
        # twice a rank, and one more where b's merge is meant: of equal merges the left one comes first
        before = 1 << 62
        while True:
            r = ranks.get(a + b)
            if r is not None and 2 * r < before and self.split_of(a + b) == (a, b):
                return False
            x, y = self.split_of(a), self.split_of(b)
            if x is None and y is None:
                return True
            if y is None or x is not None and ranks[a] > ranks[b]:
                before, a = 2 * ranks[a], x[1]
            else:
                before, b = 2 * ranks[b] + 1, y[0]

    def stream(self, chunks: Iterable[bytes]) -> Iterator[list[int]]:
        """Ids of one piece that comes in chunks, in lists as they become stable."""
        t = Transducer(self)
        for chunk in chunks:
            yield from t.feed(chunk)
        yield t.end()


class Transducer:
    """One piece: bytes go in, ids come out once no continuation can change them. What it holds is bounded by the lookahead."""

    def __init__(self, bpe: Bpe):
        self.bpe = bpe
        self.buf, self.last = bytearray(), [0]  # last[i]: the length of the last token of buf[:i]
        self.first = b""  # the token that was sent before buf
        self.every = max(bpe.longest, 64)
        self.due = 2 * self.every

    def feed(self, chunk: bytes) -> Iterator[list[int]]:
        for at in range(0, len(chunk), self.every):
            self.buf += chunk[at : at + self.every]
            self._advance()
            if len(self.buf) < self.due:
                continue
            out, sent = self._stable()
            if sent:
                yield [self.bpe.ranks[t] for t in out]
                self.first = out[-1]
                del self.buf[:sent]
                del self.last[:sent]
                self.last[0] = 0
            if len(self.buf) > self.bpe.lookahead + 4 * self.every:
                raise AssertionError("a token was not stable within the lookahead")
            self.due = len(self.buf) + self.every

    def end(self) -> list[int]:
        """The ids of what is left; the transducer is then as new."""
        self._advance()
        out = [self.bpe.ranks[t] for t in self._back(len(self.buf))]
        self.buf, self.last, self.first, self.due = bytearray(), [0], b"", 2 * self.every
        return out

    def _advance(self) -> None:
        bpe, last, first = self.bpe, self.last, self.first
        suffixes, longest, is_token, fits, data = bpe.suffixes, bpe.longest, bpe.is_token, bpe.fits, bytes(self.buf)
        for end in range(len(last), len(data) + 1):
            found = 0
            for start in range(end - 1, max(0, end - longest) - 1, -1):
                token = data[start:end]
                if token not in suffixes:
                    break
                if start and not last[start] or not is_token(token):
                    continue
                before = data[start - last[start] : start] if start else first
                if not before or fits(before, token):
                    found = end - start
                    break
            last.append(found)

    def _back(self, end: int) -> list[bytes]:
        out = []
        while end > 0:
            out.append(bytes(self.buf[end - self.last[end] : end]))
            end -= self.last[end]
        return out[::-1]

    def _stable(self) -> tuple[list[bytes], int]:
        """Tokens that no continuation changes, and where they end: where the pointers of all live positions meet."""
        n = len(self.buf)
        live = {i for i in range(max(0, n - self.bpe.longest), n + 1) if i == 0 or self.last[i]}
        while len(live) > 1:
            far = max(live)
            live.discard(far)
            live.add(far - self.last[far])
        meet = live.pop()
        return self._back(meet), meet


class Encoder(dict):
    """Text to ids. As a table: pieces to the ids that the transducer gave for them, short ones remembered."""

    def __init__(self, bpe: Bpe):
        super().__init__()
        self.bpe = bpe
        self.transducer = Transducer(bpe)
        self.findall = regex.compile(PATTERN).findall
        self.runs = {k: regex.compile(p) for k, p in RUNS.items()}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        t = self.transducer
        ids = tuple(itertools.chain.from_iterable((*t.feed(piece.encode()), t.end())))
        if len(piece) <= REMEMBERED:
            if len(self) > MOST_PIECES:
                self.clear()
            self[piece] = ids
        return ids

    def kind_of(self, c: str) -> str:
        return next(k for k, run in self.runs.items() if run.match(c))

    def pieces(self, chunks: Iterable[str]) -> Iterator[tuple[list[str], str, bool]]:
        """A text that comes in chunks, as (whole pieces, a part of the piece behind them, whether that part ends its piece). Of a piece
        that outgrows a chunk the parts come one after the other; what is held is no longer than two chunks."""
        buf, run = "", ""
        for chunk in chunks:
            buf += chunk
            if run:
                end = self.runs[run].match(buf).end() if self.runs[run].match(buf) else 0
                if end == len(buf):
                    # the last white space may begin the next piece
                    keep = 1 if run == "S" else 0
                    yield [], buf[: end - keep], False
                    buf = buf[end - keep :]
                    continue
                end -= run == "S"
                yield [], buf[:end], True
                buf, run = buf[end:], ""
            found = self.findall(buf)
            end = len(buf)
            while found and end > len(buf) - PIECE_LOOKAHEAD:
                end -= len(found.pop())
            buf = buf[end:]
            if len(buf) > CHUNK // 2:
                # one long run, and behind it what is shorter than the lookahead
                rest = self.findall(buf)
                run = self.kind_of(rest[0][-1])
                if len(rest) == 1:
                    keep = 1 if run == "S" else 0
                    yield found, buf[: len(buf) - keep], False
                    buf = buf[len(buf) - keep :]
                elif run != "S":
                    yield found + rest[:1], "", False
                    buf, run = buf[len(rest[0]) :], ""
                else:
                    yield found, "", False
                    run = ""
            elif found:
                yield found, "", False
        if run:
            yield [], buf, True
        elif buf:
            yield self.findall(buf), "", False

    def stream(self, chunks: Iterable[str]) -> Iterator[Iterable[int]]:
        """Ids of a text that comes in chunks, in portions as they become stable, whatever the length of the text or of a piece of it."""
        t = Transducer(self.bpe)
        for found, part, ends in self.pieces(chunks):
            yield itertools.chain.from_iterable(map(self.__getitem__, found))
            if part:
                yield from t.feed(part.encode())
            if ends:
                yield t.end()

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text, special tokens' strings being ordinary text; of null and empty texts an empty list."""
        if not text:
            return []
        return list(itertools.chain.from_iterable(self.stream(text[i : i + CHUNK] for i in range(0, len(text), CHUNK))))

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """Text by and by: the bytes of each token go through the state machine of UTF-8, which holds back unfinished characters."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        text = self.bpe.text
        for i in ids:
            if out := machine.decode(text[i]):
                yield out
        if out := machine.decode(b"", final=True):
            yield out
