"""Fill-in-middle transformation over seekable compressed frames.

A text is kept as independent zstandard frames of ``SIZE`` characters at most, with the lines ended
and the characters up to each frame's end. A cut after so many lines is found by these sums: only the
frame that holds it is decompressed. A digest streams the frames in the order that the form asks for,
one decompressed frame at a time, and never joins the text. A transformed text is such frames as
well, so that the original is rebuilt from it by seeking its marks.

A unit is a line (with its newline; a last one may lack it). The cuts, and whether a document is
transformed, in which form, come from the sha256 of the seed and the id alone, so a lost executor's
rows come out the same again.

Defined results: a null text is an empty one, which stays plain; so do texts that hold a mark; a null
id counts as an empty one; repeated rows give equal rows; a line of any length may span frames; empty
tables give no rows; columns other than id and text aren't read by digests(), and stay in transform().
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_batch, unused

#: Characters of a frame at most.
SIZE = 1 << 16
PREFIX, SUFFIX, MIDDLE = MARKS = (b"<P>", b"<S>", b"<M>")


class Frames:
    """A text as compressed frames with cumulative counts; bytes can be put to its end and read from anywhere."""

    def __init__(self, text: str | None = "", packer: zstandard.ZstdCompressor | None = None, size: int = SIZE):
        self.packer, self.size = packer or zstandard.ZstdCompressor(level=1), size
        self.frames: list[bytes] = []
        #: Up to the end of each frame: newlines, characters, bytes.
        self.lines, self.chars, self.ends = [], [], []
        self.open_line = False
        for i in range(0, len(text or ""), size):
            self.put(text[i : i + size].encode("utf-8", "surrogatepass"))

    def put(self, piece: bytes) -> None:
        """One more frame. It begins and ends between characters."""
        if piece:
            sums = ((self.lines, piece.count(b"\n")), (self.chars, len(piece.decode("utf-8", "surrogatepass"))), (self.ends, len(piece)))
            for sums, n in sums:
                sums.append(n + (sums[-1] if sums else 0))
            self.open_line = not piece.endswith(b"\n")
            self.frames.append(self.packer.compress(piece))

    @property
    def units(self) -> int:
        return self.lines[-1] + self.open_line if self.frames else 0

    @property
    def bytes(self) -> int:
        return self.ends[-1] if self.frames else 0

    def frame(self, k: int) -> bytes:
        return zstandard.ZstdDecompressor().decompress(self.frames[k])

    def cut(self, units: int) -> tuple[int, int]:
        """Bytes and characters before the end of so many units: one frame is decompressed at most."""
        if not units:
            return 0, 0
        if units > self.lines[-1]:  # the last unit has no newline
            return self.ends[-1], self.chars[-1]
        k = bisect_left(self.lines, units)
        piece, at = self.frame(k), -1
        for _ in range(units - (self.lines[k - 1] if k else 0)):
            at = piece.index(b"\n", at + 1)
        before = (self.ends[k - 1], self.chars[k - 1]) if k else (0, 0)
        return before[0] + at + 1, before[1] + len(piece[: at + 1].decode("utf-8", "surrogatepass"))

    def read(self, start: int = 0, end: int | None = None) -> Iterator[bytes]:
        """The bytes from ``start`` to ``end``, frame by frame."""
        end = self.bytes if end is None else end
        k = bisect_left(self.ends, start + 1)
        while start < end:
            low = self.ends[k - 1] if k else 0
            piece = self.frame(k)
            yield piece if start == low and end >= self.ends[k] else piece[start - low : end - low]
            start, k = self.ends[k], k + 1

    def find(self, mark: bytes) -> int:
        """Byte at which a mark begins first, -1 if nowhere; it may lie across two frames."""
        rest, at = b"", 0
        for piece in self.read():
            here = (rest + piece).find(mark)
            if here >= 0:
                return at - len(rest) + here
            at += len(piece)
            rest = (rest + piece)[-len(mark) + 1 :]
        return -1


def draws(seed: int, doc_id) -> list[int]:
    """The first four numbers of the id's digest."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def transform_frames(text: Frames, doc_id, seed: int = 7, rate: int = 100, spm: int = 50) -> tuple[str, Frames, int | None, int | None]:
    """Form, transformed frames, characters of prefix and middle (None in the plain form)."""
    one, two, chosen, kind = draws(seed, doc_id)
    n = text.units
    if not n or chosen % 100 >= rate or any(text.find(m) >= 0 for m in MARKS):
        return "plain", text, None, None
    low, high = sorted((one % (n + 1), two % (n + 1)))
    (a, a_chars), (b, b_chars) = text.cut(low), text.cut(high)
    out = Frames(packer=text.packer, size=text.size)
    form = "spm" if kind % 100 < spm else "psm"
    prefix, middle, suffix = (PREFIX, 0, a), (MIDDLE, a, b), (SUFFIX, b, text.bytes)
    for mark, start, end in (prefix, suffix, middle) if form == "psm" else (suffix, prefix, middle):
        first = mark
        for piece in text.read(start, end):  # a mark goes with the piece after it, to save a frame
            out.put(first + piece)
            first = b""
        out.put(first)
    return form, out, a_chars, b_chars - a_chars


def restored(form: str, out: Frames) -> Iterator[bytes]:
    """The original text, from the transformed frames and the form alone."""
    if form == "plain":
        yield from out.read()
        return
    at = {m: out.find(m) for m in MARKS}
    order = sorted(MARKS, key=at.get)
    ends = {m: at[after] for m, after in zip(order, order[1:], strict=False)} | {order[-1]: out.bytes}
    for mark in (PREFIX, MIDDLE, SUFFIX):
        yield from out.read(at[mark] + len(mark), ends[mark])


def sha256(pieces: Iterator[bytes]) -> str:
    digest = hashlib.sha256()
    for piece in pieces:
        digest.update(piece)
    return digest.hexdigest()


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n, lines, chars, ends, frames`` of every document: the frames and their sums, to be written as a table. No shuffle."""

    def make():
        packer = zstandard.ZstdCompressor(level=1)

        def f(ids, texts):
            kept = [Frames(t, packer) for t in texts]
            return {id_col: ids, "n": [x.units for x in kept]} | {c: [getattr(x, c) for x in kept] for c in ("lines", "chars", "ends", "frames")}

        return f

    schema = f"{id_col} {dict(docs.dtypes)[id_col]}, n long, lines array<long>, chars array<long>, ends array<long>, frames array<binary>"
    return per_batch(docs, [id_col, text_col], schema, make)


def digests(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256`` of every document. No shuffle.

    ``rate`` and ``spm`` are per cent: documents transformed, and of these the ones with the suffix first.
    """

    def make():
        packer = zstandard.ZstdCompressor(level=1)

        def f(ids, texts):
            rows = []
            for i, t in zip(ids, texts, strict=True):
                text = Frames(t, packer)
                form, out, before, middle = transform_frames(text, i, seed, rate, spm)
                rows.append((i, text.units, form, before, middle, sha256(out.read()), sha256(restored(form, out))))
            return dict(zip(names, zip(*rows, strict=True) if rows else [[]] * len(names), strict=True))

        return f

    names = (id_col, "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")
    schema = f"{id_col} {dict(docs.dtypes)[id_col]}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
    return per_batch(docs, [id_col, text_col], schema, make)


def transform(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, id_col: str = "doc_id", text_col: str = "text", form_col: str = "form") -> DataFrame:
    """The rows of ``docs`` with their texts transformed and one more column, the form. No shuffle.

    The form's column gets underscores before its name where ``docs`` has one of that name.
    """
    form_col, pair = unused(docs, form_col), unused(docs, "_pair")

    @F.pandas_udf("text string, form string")
    def changed(ids, texts):
        import pandas as pd

        packer, rows = zstandard.ZstdCompressor(level=1), []
        for i, t in zip(ids, texts, strict=True):
            form, out, _, _ = transform_frames(Frames(t, packer), None if i is None or pd.isna(i) else i, seed, rate, spm)
            rows.append((b"".join(out.read()).decode("utf-8", "surrogatepass"), form))
        return pd.DataFrame(rows, columns=["text", "form"])

    whole = docs.withColumn(pair, changed(F.col(id_col).cast("string"), F.col(text_col)))
    return whole.withColumns({text_col: F.col(f"{pair}.text"), form_col: F.col(f"{pair}.form")}).drop(pair)


def restore(docs: DataFrame, text_col: str = "text", form_col: str = "form") -> DataFrame:
    """The rows of transform() with their original texts (null ones are empty now). No shuffle."""

    @F.pandas_udf("string")
    def back(texts, forms):
        import pandas as pd

        packer = zstandard.ZstdCompressor(level=1)
        return pd.Series([b"".join(restored(f, Frames(t, packer))).decode("utf-8", "surrogatepass") for t, f in zip(texts, forms, strict=True)], dtype=object)

    return docs.withColumn(text_col, back(text_col, form_col))
