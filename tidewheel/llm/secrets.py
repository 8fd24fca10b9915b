"""Secret scan by assignment-aware lexing.

Base spans come from three fixed patterns. The method then cuts source and configuration syntax into
tokens (strings of each quote kind, triple quotes, names, flags, tags, marks), parses these into
name-literal pairs (see assignments()), propagates constants (a literal given to one name and that
name given to another, in either order, whole or as a part: ``k = "…"`` then ``password = k + "…"``),
and scores each value by how sensitive the names are that it reaches, by its length and by its variety
of characters. The literals of values that score ``threshold`` or more become spans of kind ``lexed``.
Base spans always stay.

Defined results: a null text counts as empty and has no spans; texts are scanned whole, and names and
literals may have any length; repeated rows are scanned alike; other columns aren't read. Positions
are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from itertools import accumulate, pairwise

from pyspark.sql import DataFrame

from .common import change_texts, per_batch

KINDS = ("assign", "access", "hex", "lexed")
_ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS, _HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")
#: Every run of 32 or more holds one of these steps, so short runs needn't be looked at one by one.
_LONG_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
_NAME = r"[A-Za-z_$][A-Za-z0-9_$.\-]*"
#: Tokens of source and configuration: strings of each kind, tags, flags, names, marks, ends of lines, other runs.
_TOKEN = re.compile(
    r"""(?P<string>(?:(?<![A-Za-z0-9_])[rRbBfFuU]{1,2}|(?<![A-Za-z0-9_]))(?:\"\"\"(?P<s3>(?:[^\\]|\\[\s\S])*?)\"\"\"|'''(?P<t3>(?:[^\\]|\\[\s\S])*?)'''|"(?P<s1>(?:[^"\\\n]|\\.)*)"|'(?P<t1>(?:[^'\\\n]|\\.)*)'|`(?P<b1>(?:[^`\\]|\\[\s\S])*)`))"""
    rf"""|(?P<tag><(?P<t>{_NAME})>(?P<inner>[^<>\s]+)</(?P=t)>)"""
    rf"""|(?P<flag>(?<![\w-])--(?P<f>{_NAME})(?:[ =](?=[^\s"'-])))"""
    rf"""|(?P<name>{_NAME})"""
    r"""|(?P<mark>:=|=>|[=!<>]=|[=:+,;\[\](){}\n])"""
    r"""|(?P<other>[^\s"'`,;(){}\[\]<>|=:+]+)"""
)
_BARE, _FLAG_VALUE = re.compile(r"""[^\s"'`,;(){}\[\]<>|]+"""), re.compile(r"""[^\s"']+""")
_NAME_ONLY = re.compile(rf"{_NAME}\Z")
_BLOCK, _LINE = re.compile(r"[ \t]*[|>][+-]?[ \t]*\n"), re.compile(r"^([ \t]*)\S", re.M)
_BLANKS = re.compile(r"[ \t]*")
_ASSIGNS = ("=", ":", ":=", "=>")
#: Words of names, or words side by side in one, and how sensitive they are.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 0.9, "credential": 0.9, "privatekey": 1.0, "accesskey": 1.0, "auth": 0.6, "passphrase": 1.0, "salt": 0.5, "key": 0.4}
#: Of these the ones that also count at the end of a longer word: few words of prose end so.
_ENDINGS = tuple(w for w in SENSITIVE if w not in ("auth", "salt", "key"))
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_HINTS = ("pass", "pwd", "secret", "token", "key", "cred", "auth", "salt")
#: Every match of the first base pattern holds one of these in some case.
_ASSIGNED = ("passw", "secret", "token", "apikey", "api_key")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three patterns; leftmost, non-overlapping within a kind."""
    low, found = text.lower(), []
    if any(word in low for word in _ASSIGNED):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in _LONG_HEX.finditer(text)]
    return sorted(found)


def name_score(name: str) -> float:
    """How sensitive a name is by its whole words: of ``clientSecret_2`` these are client and secret, of ``secretary`` none that counts."""
    words = [w.lower() for w in _WORD.findall(name)]
    words += [w[:-1] for w in words if w.endswith("s")]
    words += [a + b for a, b in pairwise(words)]
    return max((v for k, v in SENSITIVE.items() if k in words or k in _ENDINGS and any(w.endswith(k) for w in words)), default=0.0)


def literal_score(literal: str | Counter) -> float:
    """0 to 1 by length and by the entropy of the characters; words of letters alone score low."""
    count = Counter(literal)
    n = count.total()
    if n < 6:
        return 0.0
    entropy = -sum(c / n * math.log2(c / n) for c in count.values())
    kind = lambda c: 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3
    return min(1.0, n / 16) * min(1.0, entropy / 3.2) * (0.35 if len(set(map(kind, count))) == 1 else 1.0)


#: A character's count in a value put together of others stays below this.
MOST = 1 << 40
#: A part of a value: the name it stands for, if it may be one, and its place if it is a literal.
Part = tuple[str | None, tuple[int, int] | None]


def lexed(text: str) -> list[tuple[str, str, int, int]]:
    """(kind, text, start, end) of the tokens; of strings what the quotes hold."""
    out = []
    for m in _TOKEN.finditer(text):
        kind = m.lastgroup if m.lastgroup in ("name", "mark", "other") else next(k for k in ("string", "tag", "flag") if m[k] is not None)
        if kind == "string":
            inner = next(k for k in ("s3", "t3", "s1", "t1", "b1") if m[k] is not None)
            out.append((kind, m[inner], *m.span(inner)))
        else:
            out.append((kind, m[0], *m.span()))
    return out


class Blocks:
    """Indented blocks of a text: where one ends is known for all lines from one pass over them."""

    def __init__(self, text: str):
        self.text, self.ready = text, False

    def at(self, start: int) -> tuple[int, int] | None:
        """The lines from ``start`` on, if the first is indented, up to a line that is less so."""
        if not self.ready:
            found = [(m.start(), len(m[1])) for m in _LINE.finditer(self.text)]  # lines that aren't blank
            self.starts, self.indents, self.ready = [s for s, _ in found], [n for _, n in found], True
            self.until, open_ = [len(self.text)] * len(found), []
            for k, n in enumerate(self.indents):
                while open_ and self.indents[open_[-1]] > n:
                    self.until[open_.pop()] = self.starts[k] - 1
                open_.append(k)
        k = bisect_right(self.starts, start) - 1
        if k < 0 or self.starts[k] != start or not self.indents[k]:
            return None
        return start + self.indents[k], self.until[k]


def assignments(text: str) -> list[tuple[list[str], list[Part]]]:
    """(names, parts of the value) as assigned in the text, in order.

    ``name = "x"``, ``name: x``, ``"name" => "x"``, ``a["name"] = x``, ``name: kind = "x"``, values put
    together by ``+`` (spaced, or beside a string) or side by side, blocks of lines after ``name: |``,
    ``--name x``, ``<name>x</name>``.
    """
    tokens, out, blocks = lexed(text), [], Blocks(text)
    for i, (kind, value, start, end) in enumerate(tokens):
        if kind == "tag":
            at = start + value.index(">") + 1
            out.append(([value[1 : at - start - 1]], [(None, (at, text.index("<", at)))]))
        elif kind == "flag":
            m = _FLAG_VALUE.match(text, end)
            out.append(([value[2:-1]], [(None, m.span())] if m else []))
        elif kind == "mark" and value in _ASSIGNS and (names := _targets(tokens, i)):
            out.append((names, _value(text, tokens, i + 1, end, blocks)))
    return [(names, parts) for names, parts in out if parts]


def _targets(tokens: list[tuple[str, str, int, int]], i: int) -> list[str]:
    """The names that the assignment mark at i gives a value to."""
    kind, value, start, _ = tokens[i - 1] if i else ("", "", 0, 0)
    if kind in ("name", "string"):
        names = [value] if value.strip() else []
        if i > 2 and tokens[i - 2][1] == ":" and tokens[i][1] == "=" and tokens[i - 3][0] == "name":  # name: kind = …
            names.append(tokens[i - 3][1])
        return names
    if value == "]" and i > 3 and tokens[i - 3][1] == "[" and tokens[i - 2][0] in ("name", "string"):
        return [tokens[i - 2][1]] + ([tokens[i - 4][1]] if tokens[i - 4][0] == "name" else [])
    return []


def _value(text: str, tokens: list[tuple[str, str, int, int]], i: int, at: int, blocks: Blocks) -> list[Part]:
    """The parts of the value that starts at a place of the text, before token i."""
    if tokens[i - 1][1] == ":" and (m := _BLOCK.match(text, at)) and (lines := blocks.at(m.end())):
        return [(None, lines)]
    parts: list[Part] = []
    while i < len(tokens) and tokens[i][0] == "string" and not text[at : tokens[i][2]].strip(" \t\"'`rRbBfFuU") or (m := _BARE.match(text, _BLANKS.match(text, at).end())):
        if i < len(tokens) and tokens[i][0] == "string" and not text[at : tokens[i][2]].strip(" \t\"'`rRbBfFuU"):
            parts.append((None, tokens[i][2:]))
            at = tokens[i][3] + (3 if text[tokens[i][3] : tokens[i][3] + 3] in ('\"\"\"', "'''") else 1)
            more = True  # strings side by side are one
        else:
            whole = m[0] if m[0] == "+" else m[0].rstrip("+")  # other plus signs may be of a key
            if whole in ("", "+"):
                return parts
            at = m.start() + len(whole)
            if text[at : at + 1] == "(":  # a call
                return parts
            parts.append((whole if _NAME_ONLY.match(whole) else None, (m.start(), at)))
            more = False
        after = _BLANKS.match(text, at).end()
        plus = text[after : after + 1] == "+"
        if not plus and not (more and text[after : after + 1] in ('"', "'")):
            break
        at = after + plus
        while i < len(tokens) and tokens[i][2] < at:
            i += 1
    return parts


def lexed_spans(text: str, threshold: float) -> list[tuple[int, int, int]]:
    """Spans of literals that sensitive names get, straight or through other names, before or after these are given their values."""
    low = text.lower()
    if not any(hint in low for hint in _HINTS) or not ("=" in text or ":" in text or "--" in text or "</" in text):
        return []
    every = assignments(text)
    given: dict[str, list[int]] = {}
    for k, (names, _) in enumerate(every):
        for name in names:
            given.setdefault(name, []).append(k)

    def source(name: str | None, k: int) -> int | None:
        """The assignment that a name in the k-th one stands for: the last before it, else the first after it."""
        of = given.get(name) if name else None
        if not of:
            return None
        at = bisect_left(of, k)
        return of[at - 1] if at else next((j for j in of if j != k), None)

    known: dict[int, tuple[Counter, list[tuple[int, int]], list[int]]] = {}

    def resolve(first: int) -> Counter:
        """Characters of the value of an assignment; kept with its own literals' places and the assignments that it takes others from."""
        todo, open_ = [first], set()
        while todo:
            k = todo[-1]
            if k in known:
                todo.pop()
                continue
            below = [source(name, k) for name, _ in every[k][1]]
            if k not in open_:
                open_.add(k)
                if new := [j for j in below if j is not None and j not in known and j not in open_]:
                    todo += new
                    continue
            count, places, parts = Counter(), [], []
            for (_, place), j in zip(every[k][1], below, strict=True):
                if j is not None and j in known:
                    count += known[j][0]
                    parts.append(j)
                elif j is None and place:
                    count += Counter(text[slice(*place)])
                    places.append(place)
            known[k] = Counter({c: min(n, MOST) for c, n in count.items()}), places, parts
            todo.pop()
        return known[first][0]

    told: set[int] = set()
    covered = 0  # up to here a block or string of its own is told already
    for k, (names, parts) in enumerate(every):
        score = max(map(name_score, names))
        if not score or parts[-1][1] and parts[-1][1][1] <= covered and all(source(name, k) is None for name, _ in parts):
            continue
        if score * literal_score(resolve(k)) >= threshold:
            open_ = [k]
            while open_:  # each assignment is visited once, whatever chains it is part of
                if (j := open_.pop()) not in told:
                    told.add(j)
                    open_ += known[j][2]
            if len(parts) == 1 and known[k][1]:
                covered = max(covered, known[k][1][0][1])
    return [(s, 3, e) for s, e in sorted({p for k in told for p in known[k][1]}) if e > s]


def spans(text: str | None, threshold: float = 0.5) -> list[tuple[int, int, int]]:
    """All (start, kind, end): base and lexed ones; a lexed span within a base one isn't told again."""
    if not text:
        return []
    base = base_spans(text)
    starts, ends = [s for s, _, _ in base], list(accumulate((e for *_, e in base), max))
    more = [x for x in lexed_spans(text, threshold) if not (i := bisect_right(starts, x[0])) or ends[i - 1] < x[2]]
    return sorted(base + more)


def _told(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def scan(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_assign, n_access, n_hex, n_lexed, base_sha256, spans`` of every whole text. No shuffle."""

    def make():
        def f(ids, texts):
            every = [spans(t, threshold) for t in texts]
            base = [[x for x in e if x[1] < 3] for e in every]
            out = {id_col: ids, "base_sha256": [hashlib.sha256(_told(b).encode()).hexdigest() for b in base], "spans": [_told(e) for e in every]}
            return out | {f"n_{k}": [sum(x[1] == i for x in e) for e in every] for i, k in enumerate(KINDS)}

        return f

    kind = dict(docs.dtypes)[id_col]
    return per_batch(docs, [id_col, text_col], f"{id_col} {kind}, n_assign long, n_access long, n_hex long, n_lexed long, base_sha256 string, spans string", make)


def redact(docs: DataFrame, threshold: float = 0.5, mark: str = "[SECRET]", text_col: str = "text") -> DataFrame:
    """The same rows and columns with each secret's span replaced by ``mark``; nulls stay null."""

    def hide(text: str | None) -> str | None:
        if not text:
            return text
        out, at = [], 0
        for s, k, e in spans(text, threshold):
            if k == 0:
                m = _ASSIGN.match(text, s)
                s = m.start(2)
            if e > at:
                out += [text[at : max(s, at)], mark] if s >= at else []
                at = e
        return "".join(out) + text[at:]

    return change_texts(docs, text_col, hide)
