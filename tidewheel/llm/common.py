"""Small helpers that all document operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space and \t \n \v \f \r.
WORD = re.compile(r"[^ \t-\r]+")
#: str.split() also splits at these; texts that hold one take the pattern instead.
_OTHER_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0  -     　]")
_LOWER_AZ = {i: i + 32 for i in range(ord("A"), ord("Z") + 1)}


def words_of(text: str | None) -> list[str]:
    """Words of a text; none for null."""
    if not text:
        return []
    return WORD.findall(text) if _OTHER_SPACE.search(text) else text.split()


def lower_az(text: str) -> str:
    """Lower-case A-Z only."""
    return text.lower() if text.isascii() else text.translate(_LOWER_AZ)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints that the cluster shares: the session's ``spark.checkpoint.dir``.

    Only where that is unset and all runs in one process (tests) a temporary one is set; a cluster
    without one is an error, as a folder of one machine would lose what others wrote.
    """
    context = spark.sparkContext
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if not set_by_cluster and context.getCheckpointDir() is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return set_by_cluster or context.getCheckpointDir()


def unused(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as it takes to clash with no column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder that this library wrote, wherever it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder, so that lost executors cost little."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def settle(spark: SparkSession) -> None:
    """Let the driver collect what ended steps left behind.

    Spark frees their broadcasts, shuffle files, checkpoints and compiled code only when the driver's
    JVM collects its references; a job of hundreds of short stages ends before it would.
    """
    gc.collect()
    spark._jvm.System.gc()


#: Rows of a few numbers that are broadcast at most.
SMALL = 100_000


def if_small(df: DataFrame) -> DataFrame:
    """A checkpointed table of a few numbers a row, to be broadcast where it is counted to be small; else joined by a shuffle."""
    return F.broadcast(df) if df.count() <= SMALL else df


#: Bitmaps of 32,768 bits that rows_of_ids() broadcasts at most, 8 MB.
BITMAPS = 2048


def rows_of_ids(df: DataFrame, ids: DataFrame, n: int, id_col: str) -> DataFrame:
    """``df`` joined with the ``n`` rows of ``ids`` by a shuffle; bits of the ids' hashes keep most other rows from moving."""
    maps = min(BITMAPS, max(1, (16 * n) >> 15))
    place = F.pmod(F.xxhash64(id_col), F.lit(maps << 15))
    bits = ids.groupBy(F.shiftright(place, 15).alias("_map")).agg(F.bitmap_construct_agg(place.bitwiseAND(F.lit(32767))).alias("_bits"))
    byte = F.conv(F.hex(F.substr("_bits", (F.shiftright(F.col("_place"), 3) % 4096 + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    some = df.withColumn("_place", place).withColumn("_map", F.shiftright("_place", 15)).join(F.broadcast(bits), "_map")
    some = some.filter(byte.bitwiseAND(F.pow(F.lit(2), F.col("_place") % 8).cast("int")) > 0)
    return some.select(*df.columns).join(ids.hint("merge"), id_col)


#: Bytes of rows that a worker turns into Python values at once.
PIECE = 1_000_000


def pieces(batch: pa.RecordBatch, size: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Slices of an Arrow batch of about ``size`` bytes each; a longer row is a slice of its own."""
    step = max(1, batch.num_rows * size // max(1, batch.nbytes))
    return (batch.slice(i, step) for i in range(0, batch.num_rows, step))


def arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def _batch(out: dict, kinds: pa.Schema) -> pa.RecordBatch:
    values = lambda x, kind: x if isinstance(x, pa.Array) else pa.array(x, kind)
    return pa.RecordBatch.from_arrays([values(out[k.name], k.type) for k in kinds], kinds.names)


#: What a worker process keeps from task to task, by the operator that it belongs to.
_KEPT: dict[str, dict] = {}


def kept(operator: str, name: str, make: Callable[[], object]):
    """Something that is costly to make, kept by the worker until a task of another operator starts there."""
    own = _KEPT.setdefault(operator, {})
    if name not in own:
        own[name] = make()
    return own[name]


def _only(operator: str) -> None:
    """Drop what other operators keep.

    Of its own name: what Spark ships by value, as functions within functions, brings a copy of each global that it reads.
    """
    if others := [k for k in _KEPT if k != operator]:
        for k in others:
            del _KEPT[k]
        give_back()


def give_back() -> None:
    """Return what isn't used to the machine: workers and drivers live on, and other stages need the memory."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def _tasks(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], operator: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` without what other operators keep, and with the memory given back at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _only(operator)
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def per_batch(df: DataFrame, columns: list[str], schema: str, make: Callable[[], Callable[..., dict]], piece_bytes: int = PIECE, operator: str = "") -> DataFrame:
    """Map Arrow batches of ``columns``: ``make()`` once a task gives ``f(*lists) -> {column: values}``.

    A batch is worked on in pieces of about ``piece_bytes``, which bounds what a worker holds at once.
    ``operator`` names the owner of what the tasks have kept().
    """
    kinds = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in (p for whole in batches for p in pieces(whole, piece_bytes)):
            out = _batch(f(*(c.to_pylist() for c in batch.columns)), kinds)
            if out.num_rows:
                yield out

    return df.select(*columns).mapInArrow(_tasks(run, operator), schema)


def per_task(df: DataFrame, columns: list[str], schema: str, make: Callable[[], tuple[Callable[..., dict | None], Callable[[], dict]]]) -> DataFrame:
    """Sum up partitions of ``columns``: ``make()`` gives ``f(*lists)``, called piece by piece, and ``end() -> {column: values}``.

    ``f`` may give such columns as well where a task would hold too much.
    """
    kinds = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, end = make()
        for batch in (p for whole in batches for p in pieces(whole)):
            if (some := f(*(c.to_pylist() for c in batch.columns))) is not None:
                yield _batch(some, kinds)
        yield _batch(end(), kinds)

    return df.select(*columns).mapInArrow(_tasks(run), schema)


def keep_rows(df: DataFrame, column: str, make: Callable[[], Callable[[list], list[bool]]]) -> DataFrame:
    """The rows for whose ``column`` ``make()``'s function says so, with all columns. No shuffle. Pieces are smaller, as its functions hold a model too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = make()
        for batch in (p for whole in batches for p in pieces(whole, PIECE // 2)):
            yield batch.filter(pa.array(keep(batch.column(batch.schema.get_field_index(column)).to_pylist()), pa.bool_()))

    return df.mapInArrow(_tasks(run), df.schema)


def change_texts(df: DataFrame, column: str, change: Callable[[str | None], str | None]) -> DataFrame:
    """The same rows with each text of ``column`` changed. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for whole in batches for p in pieces(whole)):
            i = b.schema.get_field_index(column)
            yield b.set_column(i, b.schema.field(i), pa.array([change(t) for t in b.column(i).to_pylist()], b.schema.field(i).type))

    return df.mapInArrow(_tasks(run), df.schema)


def crc_mod(doc_id: int, modulus: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % modulus


def crc_mod_col(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo."""
    return F.crc32(F.col(column).cast("string")) % F.lit(modulus)


_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the output."""
    x = x ^ (x >> np.uint64(33))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(33))
    x = x * _MIX2
    return x ^ (x >> np.uint64(33))


_P = np.uint64(0x9E3779B97F4A7C15)
_TABLES: dict[str, np.ndarray] = {}


def _powers(n: int) -> np.ndarray:
    """_P to the powers 0 to n at least; longer ones than usual aren't kept."""
    known = _TABLES.get("powers")
    if known is None or len(known) <= n:
        known = np.full(max(n, 1 << 20) + 1, _P, np.uint64)
        known[0] = 1
        np.cumprod(known, dtype=np.uint64, out=known)
        if len(known) <= 2 << 20:
            _TABLES["powers"] = known
    return known


def _table(kind: str) -> np.ndarray:
    """For each code point whether it is a letter or digit (``alnum``), a digit, no space (``word``), or a letter or beyond ASCII (``term``)."""
    if kind not in _TABLES:
        inside = {"alnum": str.isalnum, "digit": str.isdigit, "word": lambda c: c != " " and not "\t" <= c <= "\r", "term": lambda c: c > "\x7f" or c.isalpha()}[kind]
        _TABLES[kind] = np.array([inside(chr(i)) for i in range(0x110000)])
    return _TABLES[kind]


class Tokens:
    """The tokens of some texts as 64-bit hashes of their characters, without a Python value for each.

    They are runs of letters and digits of the lower-cased texts (``alnum``), words as words_of() has
    them of texts with A-Z lower-cased (``word``), or of the texts as they are (``exact``), or runs of
    ASCII letters and characters beyond ASCII, A-Z lower-cased (``term``).
    """

    def __init__(self, texts: list[str | None], kind: str = "alnum"):
        lower = [t.lower() if t else "" for t in texts] if kind == "alnum" else [t or "" for t in texts]
        code = np.frombuffer(" ".join([*lower, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        if kind in ("word", "term"):
            code = code + 32 * ((code >= 65) & (code <= 90)).astype(np.uint32)
        self.code = code
        inside = np.zeros(len(code) + 2, np.int8)
        inside[1:-1] = _table(kind if kind in ("alnum", "term") else "word")[code]
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = edge[::2], edge[1::2]
        until = np.cumsum(np.fromiter((len(t) + 1 for t in lower), np.int64, len(lower)))
        #: Place of each text's first token; one more than texts.
        self.bound = np.r_[0, np.searchsorted(self.start, until)]
        self._powers = _powers(len(code))
        self._sum = np.zeros(len(code) + 1, np.uint64)
        np.cumsum(code * self._powers[: len(code)], out=self._sum[1:])
        self._down = np.uint64(pow(pow(int(_P), -1, 1 << 64), len(self._powers) - 1, 1 << 64))

    def text(self) -> np.ndarray:
        """Of each token the place of its text."""
        return np.repeat(np.arange(len(self.bound) - 1), np.diff(self.bound))

    def hashes(self, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
        """Hash of each stretch of characters: a sum holds a power of its start, so all are brought to one power."""
        up = self._powers[len(self._powers) - 1 - start] * self._down
        return mix64((self._sum[end] - self._sum[start]) * up + np.uint64(salt * int(_MIX1) % (1 << 64)))

    def words(self) -> np.ndarray:
        """Hash of each token."""
        return self.hashes(self.start, self.end)

    def lists(self) -> list[np.ndarray]:
        """Hashes of the tokens of each text."""
        return np.split(self.words(), self.bound[1:-1])

    def token(self, at: int) -> str:
        """The characters of one token."""
        return self.code[self.start[at] : self.end[at]].tobytes().decode("utf-32-le", "surrogatepass")

    def beginnings(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of tokens of more than n characters, and hashes of their first n (another than those of tokens)."""
        long = np.flatnonzero(self.end - self.start > n)
        start = self.start[long]
        return long, self.hashes(start, start + n, n)

    def endings(self, n: int, at: np.ndarray) -> np.ndarray:
        """Hashes of the last n characters of the tokens at these places."""
        return self.hashes(np.maximum(self.start[at], self.end[at] - n), self.end[at], n)

    def digits(self, at: np.ndarray) -> np.ndarray:
        """Which of the tokens at these places have a digit."""
        count = np.r_[0, np.cumsum(_table("digit")[self.code])]
        return count[self.end[at]] > count[self.start[at]]


class HashTable:
    """Numbers of distinct 64-bit hashes: an open table, looked up for many hashes at once."""

    def __init__(self, hashes: np.ndarray):
        self.size = len(hashes)
        bits = max(4, int(2 * self.size).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.key, self.number = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        left = np.arange(self.size)
        slot = (hashes >> self.shift).astype(np.int64)
        while len(left):
            free = np.flatnonzero(self.number[slot[left]] < 0)
            _, first = np.unique(slot[left[free]], return_index=True)
            now = left[free[first]]
            self.key[slot[now]], self.number[slot[now]] = hashes[now], now
            left = left[self.key[slot[left]] != hashes[left]]
            slot[left] = (slot[left] + 1) & self.mask

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 if there is none."""
        slot = (hashes >> self.shift).astype(np.int64)
        out = self.number[slot]
        left = np.flatnonzero((out >= 0) & (self.key[slot] != hashes))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & self.mask
            out[left] = self.number[slot]
            more = np.flatnonzero((out[left] >= 0) & (self.key[slot] != hashes[left]))
            left, slot = left[more], slot[more]
        return out
