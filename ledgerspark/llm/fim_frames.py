"""Fill-in-middle over seekable compressed frames.

A text is kept as independent zstandard frames of a fixed number of code points, each
with the number of code points before it. A range of the text needs only the frames
that it cuts; the others are never decompressed. A transformed text is written frame by
frame in the same form, and read back frame by frame: no step after the first holds more
than one frame of a text in the clear."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerspark.llm.common import with_struct, with_text_struct

#: Code points of a frame.
FRAME_UNITS = 1 << 13
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

_FRAMES = T.ArrayType(
    T.StructType([
        T.StructField("first_unit", T.LongType(), False),
        T.StructField("n_units", T.IntegerType(), False),
        T.StructField("data", T.BinaryType(), False),
    ]),
    False,
)
_STORED = T.StructType([
    T.StructField("n_units", T.LongType(), False),
    T.StructField("has_marks", T.BooleanType(), False),
    T.StructField("frames", _FRAMES, False),
])
_DIGESTS = T.StructType([T.StructField("output_sha256", T.StringType(), False), T.StructField("restored_sha256", T.StringType(), False)])


class FrameWriter:
    """Collects text into frames of ``units`` code points."""

    def __init__(self, units: int):
        self.units, self.frames, self.first = units, [], 0
        self.open, self.held = [], 0
        self.packer = zstandard.ZstdCompressor(level=1)

    def put(self, text: str) -> None:
        at = 0
        while at < len(text):
            piece = text[at : at + self.units - self.held]
            self.open.append(piece)
            self.held += len(piece)
            at += len(piece)
            if self.held == self.units:
                self._flush()

    def _flush(self) -> None:
        if self.held:
            data = self.packer.compress("".join(self.open).encode("utf-8"))
            self.frames.append({"first_unit": self.first, "n_units": self.held, "data": data})
            self.first += self.held
            self.open, self.held = [], 0

    def close(self) -> list[dict]:
        self._flush()
        return self.frames


class FrameReader:
    """Reads ranges of code points of a framed text; ``opened`` counts decompressions."""

    def __init__(self, frames: list[dict]):
        self.frames, self.starts = frames, [f["first_unit"] for f in frames]
        self.length = frames[-1]["first_unit"] + frames[-1]["n_units"] if frames else 0
        self.unpacker, self.opened = zstandard.ZstdDecompressor(), 0

    def pieces(self, start: int, end: int) -> Iterator[str]:
        """The text from start to end, one frame at a time."""
        k = max(bisect_right(self.starts, start) - 1, 0)
        while start < end and k < len(self.frames):
            first = self.starts[k]
            text = self.unpacker.decompress(self.frames[k]["data"]).decode("utf-8")
            self.opened += 1
            piece = text[start - first : end - first]
            yield piece
            start += len(piece)
            k += 1

    def find(self, mark: str, start: int) -> int:
        """Where mark is first found at or after start, also across frames; -1 if nowhere."""
        held, at = "", start
        for piece in self.pieces(start, self.length):
            window = held + piece
            found = window.find(mark)
            if found >= 0:
                return at - len(held) + found
            held = window[-(len(mark) - 1) :]
            at += len(piece)
        return -1


def has_marks(text: str) -> bool:
    return PREFIX in text or SUFFIX in text or MIDDLE in text


def store_frames(df: DataFrame, text_col: str = "text", out: str = "stored", frame_units: int = FRAME_UNITS) -> DataFrame:
    """df with struct ``out`` (n_units, has_marks, frames) in place of the text column.

    Null and empty texts have no frames. A very long text is more frames, not larger
    ones. Repeated rows are stored each; an empty table gives none; an existing column
    named ``out`` is replaced and all other columns pass, whatever their names."""

    def make():
        def store(text):
            text = text or ""
            writer = FrameWriter(frame_units)
            writer.put(text)
            return len(text), has_marks(text), writer.close()

        return store

    framed = with_text_struct(df, text_col, out, _STORED, make)
    return framed.select(*[F.col(f"`{c}`") for c in framed.columns if c.lower() != text_col.lower()])


def _draw(doc_id: Column, k: int) -> Column:
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def cuts(stored: Column, doc_id: Column) -> Column:
    """Struct (form, first, second): plain, psm or spm, and the code points before the
    middle and before the suffix, null where the form is plain. A null doc_id draws as
    an empty one, so rows that repeat a doc_id are cut alike if their texts are."""
    n = stored.n_units
    plain = (n == 0) | stored.has_marks | (_draw(doc_id, 3) % 100 >= 90)
    form = F.when(plain, "plain").when(_draw(doc_id, 4) % 100 < 20, "spm").otherwise("psm")
    a, b = _draw(doc_id, 1) % (n + 1), _draw(doc_id, 2) % (n + 1)
    return F.struct(form.alias("form"), F.when(~plain, F.least(a, b)).alias("first"), F.when(~plain, F.greatest(a, b)).alias("second"))


def arranged(frames: list[dict], form: str, first: int | None, second: int | None, units: int = FRAME_UNITS) -> list[dict]:
    """The frames of the transformed text. A plain text keeps its frames as they are."""
    if form == "plain":
        return frames
    reader, writer = FrameReader(frames), FrameWriter(units)
    prefix, middle, suffix = (PREFIX, 0, first), (MIDDLE, first, second), (SUFFIX, second, reader.length)
    for mark, start, end in (prefix, suffix, middle) if form == "psm" else (suffix, prefix, middle):
        writer.put(mark)
        for piece in reader.pieces(start, end):
            writer.put(piece)
    return writer.close()


def original(frames: list[dict], form: str) -> Iterator[str]:
    """The text that was transformed, from its output and form alone."""
    reader = FrameReader(frames)
    if form == "plain":
        yield from reader.pieces(0, reader.length)
        return
    inner = reader.find(SUFFIX if form == "psm" else PREFIX, 3)
    last = reader.find(MIDDLE, inner + 3)
    head, tail = (3, inner), (inner + 3, last)
    prefix, suffix = (head, tail) if form == "psm" else (tail, head)
    for start, end in (prefix, (last + 3, reader.length), suffix):
        yield from reader.pieces(start, end)


def _sha256(pieces: Iterable[str]) -> str:
    digest = hashlib.sha256()
    for piece in pieces:
        digest.update(piece.encode("utf-8"))
    return digest.hexdigest()


def fill_in_middle(df: DataFrame, stored: str = "stored", doc_id: str = "doc_id", out: str = "fim", frame_units: int = FRAME_UNITS) -> DataFrame:
    """df with struct ``out``: form, first, second (see cuts) and the frames of the
    output. Every row stays; see store_frames for odd rows."""
    from_cuts = "_cuts"
    while from_cuts in {c.lower() for c in df.columns}:
        from_cuts += "_"
    fields = T.StructType([
        T.StructField("form", T.StringType(), False),
        T.StructField("first", T.LongType()),
        T.StructField("second", T.LongType()),
        T.StructField("frames", _FRAMES, False),
    ])

    def make():
        def arrange(kept, cut):
            return cut["form"], cut["first"], cut["second"], arranged(kept["frames"], cut["form"], cut["first"], cut["second"], frame_units)

        return arrange

    cut = df.withColumn(from_cuts, cuts(F.col(stored), F.col(f"`{doc_id}`")))
    found = with_struct(cut, [stored, from_cuts], out, fields, make)
    return found.select(*[F.col(f"`{c}`") for c in found.columns if c != from_cuts])


def digests(df: DataFrame, fim: str = "fim", out: str = "digests") -> DataFrame:
    """df with struct ``out``: the SHA-256 of each output, streamed over its frames in
    order, and of the text rebuilt from output and form."""

    def make():
        def digest(made):
            reader = FrameReader(made["frames"])
            return _sha256(reader.pieces(0, reader.length)), _sha256(original(made["frames"], made["form"]))

        return digest

    return with_struct(df, [fim], out, _DIGESTS, make)


def text_of(df: DataFrame, fim: str = "fim", out: str = "output") -> DataFrame:
    """df with the whole transformed text as a string, for sinks that take texts."""

    def make():
        def text(made):
            reader = FrameReader(made["frames"])
            return ("".join(reader.pieces(0, reader.length)),)

        return text

    return with_struct(df, [fim], out, T.StructType([T.StructField("text", T.StringType(), False)]), make)
