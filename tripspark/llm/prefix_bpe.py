"""Byte-pair encoding by prefix dynamic programming.

The encoding of every prefix of a sequence ends in exactly one token: the one that may stand after the last
token of the prefix before it. Keeping that token for each prefix gives the encoding of the whole, exact
appends, and re-encoding near an edit, all in time linear in the length. Sequences that begin alike share the
tokens of their common prefixes, so many of them are done in ascending order.

Two tokens may stand side by side if the merges of their joined symbols never cross the seam. Going back from
the last merge of either token to the first, the two pieces that meet at the seam are known at every time; the
seam is crossed if two such pieces join by a merge that comes before both of them are taken up (of equal ranks
the left one comes first).
"""

from __future__ import annotations

import base64
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator

_NEVER = 1 << 60
#: Words, and pairs of tokens, after which the younger generation of a memo becomes the older; bounds the memory of a task.
MEMO = 100_000
PAIRS = 150_000
#: Longer words are not kept past their slice.
LONGEST = 64


class PrefixBPE:
    """pieces: sequence (bytes or str) -> rank; lower ranks merge first. Symbols without a rank stay alone, as id -1."""

    def __init__(self, pieces: dict):
        self.rank = pieces
        self.piece = {r: p for p, r in pieces.items()}
        self.split: dict[int, tuple[int, int]] = {}
        self.ends: dict = {}
        self.pairs: dict[int, bool] = {}
        self.older: dict[int, bool] = {}
        for p, r in sorted(pieces.items(), key=lambda x: x[1]):
            if len(p) > 1 and not self._grow(p, r):
                continue  # no merges lead to it, so it is never a token of an encoding
            self.ends[p] = r
        for p in list(self.ends):
            for i in range(1, len(p)):
                self.ends.setdefault(p[i:], -1)

    def _grow(self, p, r: int) -> bool:
        """Merge p's symbols by rank; note the last merge if they end up as p."""
        parts = [p[i : i + 1] for i in range(len(p))]
        while len(parts) > 1:
            best, at = min(((self.rank.get(parts[i] + parts[i + 1], _NEVER), i) for i in range(len(parts) - 1)), default=(_NEVER, 0))
            if best == _NEVER:
                return False
            if best == r and len(parts) == 2:
                self.split[r] = (self.rank[parts[0]], self.rank[parts[1]])
                return True
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return False

    def may_follow(self, a: int, b: int) -> bool:
        key = a << 32 | b
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) > PAIRS:
                self.older = dict(self.pairs)
                self.pairs.clear()
            ok = self.older.get(key)
            self.pairs[key] = ok = self._apart(a, b) if ok is None else ok
        return ok

    def _apart(self, a: int, b: int) -> bool:
        if a < 0 or b < 0:
            return True
        gone_a = gone_b = _NEVER
        while True:
            r = self.rank.get(self.piece[a] + self.piece[b], _NEVER)
            if r < gone_a and r <= gone_b and r != _NEVER:
                return False
            made_a, made_b = (t if t in self.split else -1 for t in (a, b))
            if made_a > made_b:
                gone_a, a = a, self.split[a][1]
            elif made_b >= 0:
                gone_b, b = b, self.split[b][0]
            else:
                return True

    def extend(self, seq, last: list, size: list) -> None:
        """last[i], size[i]: last token of seq[:i] and its length; continues them from where they end to len(seq)."""
        ends, pairs, n = self.ends.get, self.pairs.get, len(seq)
        for i in range(len(last), n + 1):
            j = i - 1
            while j >= 0 and (t := ends(seq[j:i])) is not None:
                if t >= 0 and (j == 0 or (ok := pairs(last[j] << 32 | t)) or (ok is None and self.may_follow(last[j], t))):
                    break
                j -= 1
            else:
                j, t = i - 1, -1  # a symbol without a rank
            last.append(t)
            size.append(i - j)

    def table(self, seq) -> tuple[list, list]:
        last, size = [-2], [0]
        self.extend(seq, last, size)
        return last, size

    def tables(self, ascending: Iterable) -> Iterator[tuple]:
        """(sequence, last, size, shared) of each sequence, which must come in ascending order: the first `shared` symbols are
        those of the sequence before, and their entries are kept. The lists are changed for the next sequence."""
        last, size, before = [-2], [0], b""
        for seq in ascending:
            shared = 0
            for x, y in zip(before, seq):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :], size[shared + 1 :]
            self.extend(seq, last, size)
            yield seq, last, size, shared
            before = seq

    @staticmethod
    def tokens(last: list, size: list) -> list[int]:
        """The encoding of the whole, read back from its last prefix."""
        out, i = [], len(last) - 1
        while i:
            out.append(last[i])
            i -= size[i]
        return out[::-1]

    def encode(self, seq) -> list[int]:
        return self.tokens(*self.table(seq))

    def counts(self, seq, alone=lambda symbol: 1) -> list[int]:
        """Number of tokens of seq[:i] for i = 0 .. len(seq); a symbol without a rank counts alone(symbol)."""
        last, size = self.table(seq)
        got = [0]
        for i in range(1, len(last)):
            got.append(got[i - size[i]] + (1 if last[i] >= 0 else alone(seq[i - 1 : i])))
        return got

    def changes(self, ascending: Iterable, alone=lambda symbol: 1) -> Iterator[bytes]:
        """counts of each sequence, in ascending order, as one int8 a symbol: how much its prefix has more than the one before."""
        got, change = [0], array("b")
        for seq, last, size, shared in self.tables(ascending):
            del got[shared + 1 :], change[shared:]
            for i in range(shared + 1, len(last)):
                got.append(got[i - size[i]] + (1 if last[i] >= 0 else alone(seq[i - 1 : i])))
                change.append(got[i] - got[i - 1])
            yield change.tobytes()

    def edited(self, seq, last: list, size: list, at: int, cut: int, put) -> tuple:
        """seq with cut symbols at `at` replaced by put: only prefixes past the edit are made anew, and where the
        state after the edit agrees with the old one for as many symbols as the longest piece, the old rest is kept."""
        fresh = seq[:at] + put + seq[at + cut :]
        new_last, new_size = last[: at + 1], size[: at + 1]
        shift, reach, same = len(put) - cut, max(map(len, self.rank)), 0
        while len(new_last) <= len(fresh):
            self.extend(fresh[: len(new_last)], new_last, new_size)
            i = len(new_last) - 1
            old = i - shift
            agrees = i > at + len(put) + reach and old >= 0 and (new_last[i], new_size[i]) == (last[old], size[old])
            same = same + 1 if agrees else 0
            if same > reach:
                new_last += last[old + 1 :]
                new_size += size[old + 1 :]
        return fresh, new_last, new_size


class Memo:
    """Words -> bytes, learnt for many words at a time and kept in two generations: a full younger one becomes the older, and
    the one before it is dropped, so words in use stay, and no more than twice `most` (and a slice's own) are held.

    learn: words in ascending order -> their bytes, in that order."""

    def __init__(self, learn: Callable[[list[str]], Iterable[bytes]], most: int = MEMO):
        self.learn, self.most = learn, most
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def joined(self, lists: list[list[str]]) -> list[bytes]:
        """For each list of words their bytes, one after another."""
        fresh, unknown = sorted(set().union(*lists).difference(self.young)), []
        for word in fresh:
            value = self.old.get(word)
            if value is None:
                unknown.append(word)
            else:
                self.young[word] = value
        self.young.update(zip(unknown, self.learn(unknown)))
        out = [b"".join(map(self.young.__getitem__, words)) for words in lists]
        for word in unknown:
            if len(word) > LONGEST:
                del self.young[word]
        if len(self.young) > self.most:
            self.young, self.old = {}, self.young
        return out


def ids_of(bpe: PrefixBPE, words: list[str]) -> Iterator[bytes]:
    """The ids, as bytes of int32, of words in ascending order of their code points (and so of their UTF-8 bytes)."""
    for _, last, size, _ in bpe.tables(map(str.encode, words)):
        yield array("i", bpe.tokens(last, size)).tobytes()


def ranks_of(path: str) -> dict[bytes, int]:
    """Pieces and ranks of a tiktoken rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def rank_file(path: str) -> PrefixBPE:
    return PrefixBPE(ranks_of(path))


def _ranges(points: Iterable[int]) -> str:
    """A character class body of the code points."""
    out, start, before = [], None, None
    for p in points:
        if before is None or p != before + 1:
            if start is not None:
                out.append((start, before))
            start = p
        before = p
    if start is not None:
        out.append((start, before))
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


def library_classes(names: Iterable[str]) -> dict[str, set[str]]:
    """Which code points the tiktoken library itself takes for each class, such as \\p{L}: it is asked to encode all of them
    by a pattern that matches the class alone, so its own Unicode tables decide, whatever their version."""
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    single = {bytes([b]): b for b in range(256)}
    found = {}
    for name in names:
        asked = tiktoken.Encoding("class", pat_str=f"{name}+", mergeable_ranks=single, special_tokens={})
        found[name] = set(asked.decode(asked.encode_ordinary(every)))
    return found


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """text -> list of matches of a pattern that knows characters by \\p{L}, \\p{N}, \\s, or as themselves if ASCII.

    Characters above U+FFFF are looked at as one below it of their class, which the pattern cannot tell apart."""
    found = library_classes([r"\p{L}", r"\p{N}", r"\s"])
    body = {name: _ranges(sorted(ord(c) for c in chars if ord(c) < 0x10000)) for name, chars in found.items()}
    inside = pattern
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        inside = re.sub(r"\[([^\]]*)\]", lambda m: "[" + m[1].replace(name, body[name]) + "]", inside)
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        inside = inside.replace(name, f"[{body[name]}]") if name in inside else inside
    find = re.compile(inside.replace(r"\S", f"[^{body[chr(92) + 's']}]"))
    stand_in = {r"\p{L}": "ª", r"\p{N}": "²", r"\s": " "}
    high = {ord(c): stand_in[name] for name, chars in found.items() for c in chars if ord(c) >= 0x10000}
    above = re.compile("[\U00010000-\U0010ffff]")

    def split(text: str) -> list[str]:
        if text.isascii() or not above.search(text):
            return find.findall(text)
        low = above.sub(lambda m: high.get(ord(m[0]), "—"), text)
        return [text[m.start() : m.end()] for m in find.finditer(low)]

    return split


#: A character that this Python's tables don't name, below U+10000, or any above.
_ODD = re.compile("[" + _ranges(p for p in range(0x10000) if unicodedata.category(chr(p)) == "Cn") + "\U00010000-\U0010ffff]")


def unnamed(text: str) -> bool:
    """Whether text has a character that this Python's Unicode tables don't name; a library with newer ones may."""
    return not text.isascii() and _ODD.search(text) is not None and any(unicodedata.category(c) == "Cn" for c in set(text))
