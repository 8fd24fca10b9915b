"""BPE encoding and decoding by prefix-sharing trie traversal.

The distinct words of a batch make a trie, laid out as the words in order, each with the length
that it shares with the one before. Its nodes are visited depth first; each node holds one state,
the last token of the encoding of its prefix, and where that token starts. The state follows from the states above it: the last token of a prefix is the one vocabulary token that
ends the prefix and may follow the last token of what is left (two tokens may follow each other
if merging their characters gives just these two). The tokens that end a prefix are those of its
longest end with which a token can begin, which is remembered. So what words share as a prefix is
encoded once, and a word's tokens are read by walking back from its leaf.

Defined results: a null text counts as empty; an empty text has no tokens (the digests are those
of the empty string); a byte that the file has no token for is its unknown token, or left out if it
names none; repeated rows are encoded alike, row by row; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable
from operator import itemgetter

from pyspark.sql import DataFrame

from .common import PIECE, kept, per_batch

#: The end-of-word mark is folded into the last symbol: a code point this much higher.
_END = 0xE000
_LATIN = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^ \t-\r\x85\xa0a-z0-9ªµºß-öø-ÿ²³¹¼-¾]+")
#: Words in one trie, words remembered (twice), states remembered, characters looked at together.
_NEW_WORDS, _REMEMBERED, _STATES, _AT_ONCE = 15_000, 80_000, 150_000, 1_000_000
_IDS, _DECODED = itemgetter(0), itemgetter(1)
#: Marks a special token among words; no word holds a space.
_SPECIAL = " "


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_symbols() -> dict[int, str]:
    """Byte to symbol: printable Latin-1 stands for itself, the rest follows from U+0100 in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class TrieEncoder:
    """Encoder and decoder for a word-level BPE file (lower-casing, byte symbols, word-end marks)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.mark = spec["model"], spec["model"]["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.text_of = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.vocab = {self._symbols(t): i for t, i in model["vocab"].items() if t not in self.special}
        self._string = {i: t for t, i in self.vocab.items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self._rank = {(self._symbols(a), self._symbols(b)): r for r, (a, b) in enumerate(merges)}
        self._starts = {t[:i] for t in self.vocab for i in range(1, len(t) + 1)}
        self._unknown = self.special.get(model.get("unk_token"), model["vocab"].get(model.get("unk_token")))
        self._gaps = any(c not in self.vocab for s in _byte_symbols().values() for c in (s, chr(ord(s) + _END)))
        self._pairs: dict[int, bool] = {}
        self._forget()
        self._byte = {i: s for i, s in _byte_symbols().items() if chr(i) != s}
        self._known: dict[str, tuple[str, str]] = {}
        self._older: dict[str, tuple[str, str]] = {}
        self._other = None

    def _symbols(self, token: str) -> str:
        if token.endswith(self.mark) and token != self.mark:
            token = token[: -len(self.mark)]
            return token[:-1] + chr(ord(token[-1]) + _END)
        return token

    def split(self, text: str) -> list[str]:
        """The words of a text without special tokens, normalised."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self._split_other(text)
        return _LATIN.findall(text.lower())  # NFC changes nothing in Latin-1

    def _split_other(self, text: str) -> list[str]:
        """As split(), by the file's own rules for any character."""
        if self._other is None:
            from tokenizers import Regex, normalizers, pre_tokenizers

            pattern = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
            self._other = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]), pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        normal, words = self._other
        return [w for w, _ in words.pre_tokenize_str(normal.normalize_str(text))]

    def _forget(self) -> None:
        """States: the ends of prefixes with which a token may begin; each knows the tokens that end it, longest first."""
        self._states, self._state_of, self._next = [""], {"": 0}, {}
        self._suffixes: list[tuple[tuple[int, int], ...]] = [()]

    def _step(self, state: int, symbol: str) -> int:
        """The state after one more symbol."""
        s = self._states[state] + symbol
        while s and s not in self._starts:
            s = s[1:]
        found = self._state_of.get(s)
        if found is None:
            found = self._state_of[s] = len(self._states)
            self._states.append(s)
            self._suffixes.append(tuple((b, len(s) - i) for i in range(len(s)) if (b := self.vocab.get(s[i:])) is not None))
        self._next[state << 17 | ord(symbol)] = found
        return found

    def _may_follow(self, key: int) -> bool:
        """Whether the characters of both tokens (the first plus one, and the second, of 20 bits) merge into just these; 0: into the second alone."""
        if len(self._pairs) > 200_000:
            self._pairs.clear()
        a, b = (key >> 20) - 1, key & (1 << 20) - 1
        left = self._string[a] if a >= 0 else ""
        known = self._pairs[key] = self._merge(left + self._string[b], len(left))
        return known

    def _merge(self, symbols: str, cut: int) -> bool:
        parts, rank = list(symbols), self._rank
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                r = rank.get((parts[i], parts[i + 1]))
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            if cut and sum(map(len, parts[: at + 1])) == cut:
                return False
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return len(parts) == (2 if cut else 1)

    def encode_words(self, words: Iterable[str]) -> dict[str, list[int]]:
        """Token ids of distinct words.

        Words in order are the trie's leaves depth first: a word goes on from the states of what it
        shares with the word before.
        """
        if len(self._states) > _STATES:
            self._forget()
        leaves = []
        for w in words:
            s = w if w.isascii() and w.isprintable() else w.encode("utf-8").decode("latin-1").translate(self._byte)
            leaves.append((s[:-1] + chr(ord(s[-1]) + _END), w))
        out: dict[str, list[int]] = {}
        if self._gaps and self._unknown is None:  # bytes without a token are left out before anything merges
            leaves = [("".join(filter(self.vocab.__contains__, s)), w) for s, w in leaves]
        leaves.sort()
        suffixes, following, pairs = self._suffixes, self._next, self._pairs
        room = max((len(s) for s, _ in leaves), default=0) + 1
        states, last, start, before = [0] * room, [-1] * room, [0] * room, [0] * room
        above = ""
        for s, w in leaves:
            shared = 0
            for x, y in zip(above, s, strict=False):
                if x != y:
                    break
                shared += 1
            state, above = states[shared], s
            for depth, symbol in enumerate(s[shared:], shared + 1):
                now = following.get(state << 17 | ord(symbol))
                if now is None:
                    now = self._step(state, symbol)
                states[depth] = state = now
                for b, n in suffixes[now]:
                    key = before[depth - n] | b
                    ok = pairs.get(key)
                    if ok if ok is not None else self._may_follow(key):
                        last[depth], start[depth], before[depth] = b, depth - n, (b + 1) << 20
                        break
                else:  # a byte without a token of its own: nothing merges with it
                    last[depth], start[depth], before[depth] = -1, depth - 1, 0
            ids, at = [], len(s)
            while at:
                ids.append(last[at])
                at = start[at]
            ids.reverse()
            out[w] = [self._unknown if i < 0 else i for i in ids] if self._gaps else ids
        return out

    def _learn(self, words: set[str]) -> dict[str, tuple[str, str]]:
        """What all words of a run give, encoding what isn't known yet; an older half of the memory goes when it is full."""
        found, older, text_of, new = self._known, self._older, self.text_of, []
        fresh = words.difference(found)
        if len(found) + len(fresh) > _REMEMBERED:  # what the run needs goes into the new half
            self._older, found = found, {w: found[w] for w in words.intersection(found)}
        for w in fresh:
            f = older.get(w)
            if f is None:
                new.append(w)
            else:
                found[w] = f
        for w in [w for w in new if w[0] == _SPECIAL]:
            found[w] = str(self.special[w[1:]]), w[1:]
        new = [w for w in new if w[0] != _SPECIAL]
        for i in range(0, len(new), _NEW_WORDS):
            for w, ids in self.encode_words(new[i : i + _NEW_WORDS]).items():
                found[w] = " ".join(map(str, ids)), " ".join([text_of[x] for x in ids])
        self._known = found if len(found) <= _REMEMBERED else {}
        return found

    def parts(self, text: str | None) -> list[str]:
        """Words and special tokens (marked) of a whole text in order."""
        if not text:
            return []
        if self._split_special is None or "<|" not in text:
            return self.split(text)
        out: list[str] = []
        for i, piece in enumerate(self._split_special.split(text)):
            out += [_SPECIAL + piece] if i % 2 else self.split(piece)
        return out

    def encode_batch(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """For each whole text: number of tokens, ids and tokens, each joined by one space."""
        out: list[tuple[int, str, str]] = []
        at = 0
        while at < len(texts):
            size, until = 0, at
            while until < len(texts) and size < _AT_ONCE:
                size += len(texts[until] or "")
                until += 1
            parts = [self.parts(t) for t in texts[at:until]]
            at = until
            known = self._learn(set().union(*parts))
            for p in parts:
                found = list(map(known.__getitem__, p))
                ids = " ".join(map(_IDS, found))
                out.append((ids.count(" ") + 1 if ids else 0, ids, " ".join(map(_DECODED, found))))
        return out

    def encode(self, text: str | None) -> list[int]:
        _, ids, _ = self.encode_batch([text])[0]
        return [int(i) for i in ids.split()]

    def decode(self, ids: Iterable[int]) -> str:
        """The tokens' texts joined by one space (the file names no decoder)."""
        return " ".join([self.text_of[i] for i in ids])


def encoder(path: str) -> TrieEncoder:
    """One encoder a worker process, while it works on this operator's tasks."""
    return kept("bpe", path, lambda: TrieEncoder(path))


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_tokens, ids (joined by a space), decoded`` of every whole text. No shuffle."""
    return _encoded(docs, path, id_col, text_col, digests=False)


def digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_tokens, ids_sha256, decoded_sha256`` of every whole text. No shuffle."""
    return _encoded(docs, path, id_col, text_col, digests=True)


def _encoded(docs: DataFrame, path: str | None, id_col: str, text_col: str, digests: bool) -> DataFrame:
    path = path or default_path()
    a, b = ("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")

    def make():
        e = encoder(path)

        def f(ids, texts):
            n, x, y = zip(*e.encode_batch(texts), strict=True)
            if digests:
                x, y = ([hashlib.sha256(s.encode()).hexdigest() for s in v] for v in (x, y))
            return {id_col: ids, "n_tokens": n, a: x, b: y}

        return f

    kind = dict(docs.dtypes)[id_col]  # pieces are smaller, as the encoder is held too
    return per_batch(docs, [id_col, text_col], f"{id_col} {kind}, n_tokens long, {a} string, {b} string", make, PIECE // 2, operator="bpe")
