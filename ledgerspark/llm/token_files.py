"""Token ids as Arrow stream files of equal-length sequences.

A shard is one Arrow IPC stream whose batches all hold the same number of rows;
a row is a fixed-size list of ids and a fixed-size list of mask bits (unset where
the last sequence of a shard is padded). Equal shapes make every sequence's place
a product of two numbers: ``SequenceFile`` maps the file and slices it without a
copy. Beside each shard lies a small Arrow file with its documents' places.

Documents are dealt by ranges of doc_id, so shards follow each other in order of
doc_id; each task encodes, packs and writes its own range in one pass.

Null texts count as empty and hold the end id only. Rows with the same doc_id all
stay, in order of their text; null ids come first. An empty table gives no shard. Very
long texts are encoded whole, one at a time. Only the id and text columns are read,
whatever else the table holds. What the driver collects is one row a shard."""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ids of one sequence, and sequences of one batch.
LENGTH, BATCH_ROWS = 2048, 128
#: Bytes of runs and ids that a worker remembers before it starts anew, what an entry
#: takes besides its run, and characters of a run above which it isn't remembered.
MEMORY_BYTES, ENTRY_BYTES, WORD_CHARS = 240_000_000, 200, 64
#: Characters of the texts whose words are looked up together.
GROUP_CHARS = 4_000_000

#: Where a longer text may be cut.
_CUT = re.compile(r"(?= [A-Za-z])")
#: What the byte-level pattern keeps apart, by byte: letters, digits, marks but for the
#: apostrophe (contractions), and a space, which goes with what follows. OTHER bytes and
#: apostrophes leave their word whole.
OTHER, LETTER, DIGIT, MARK, SPACE, NEWLINE, APOSTROPHE = range(7)


def _kind(b: int) -> int:
    c = chr(b)
    if b >= 128 or b < 33:
        return SPACE if c == " " else NEWLINE if c == "\n" else OTHER
    return LETTER if c.isalpha() else DIGIT if c.isdigit() else APOSTROPHE if c == "'" else OTHER if b == 127 else MARK


_KINDS = np.array([_kind(b) for b in range(256)], np.uint8)
#: Characters of two bytes that every version of Unicode has as letters.
_PAIRS = np.zeros(1 << 16, bool)
for _first, _last in ((0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x1BF), (0x400, 0x481), (0x48A, 0x4FF)):
    for _c in range(_first, _last + 1):
        _PAIRS[int.from_bytes(chr(_c).encode(), "big")] = True


def run_starts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places where the pattern surely begins a new unit in UTF-8 texts that lie one
    behind the other; starts: where each begins. Words begin at a space before a letter,
    digit, mark or apostrophe; a word of nothing but runs of one kind, with newlines that
    have no white space beside them, is cut into its runs."""
    n = len(data)
    kind = _KINDS[data]
    lead = np.flatnonzero(data[:-1] >= 0xC3)
    lead = lead[_PAIRS[data[lead].astype(np.int64) << 8 | data[lead + 1]]]
    kind[lead] = kind[lead + 1] = LETTER
    first = np.unique(starts[starts < n])
    after, before = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    after[:-1], before[1:] = kind[1:], kind[:-1]
    after[first[1:] - 1], before[first] = OTHER, OTHER
    word = (kind == SPACE) & (after != OTHER) & (after != SPACE) & (after != NEWLINE)
    word[first] = True
    blank = lambda k: (k == SPACE) | (k == NEWLINE)
    next_word = np.zeros(n, bool)
    next_word[:-1] = word[1:]
    alone = ~blank(before) & (~blank(after) | next_word)
    odd = (kind == OTHER) | (kind == APOSTROPHE) | ((kind == SPACE) & ~word) | ((kind == NEWLINE) & ~alone)
    number = np.cumsum(word, dtype=np.int32) - 1
    whole = np.zeros(int(number[-1]) + 1, bool)
    whole[number[odd]] = True
    return np.flatnonzero(word | ((kind != before) & (before != SPACE) & ~whole[number]))


SHARDS = "shard int, path string, n_docs long, n_ids long"
INDEX = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType(), False),
        T.StructField("n_tokens", T.LongType(), False),
        T.StructField("ids_crc32", T.LongType(), False),
        T.StructField("shard", T.IntegerType(), False),
        T.StructField("sequence", T.LongType(), False),
    ]
)


class ByteBpe:
    """The tokenizers library with a memory of words. The byte-level pattern never
    joins text across a space before a character that isn't white space, nor across the
    edges of runs of letters, digits and marks, so a text's ids are those of its runs."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.lib.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.held = 0

    def _learned(self, runs: list[str]) -> list[bytes]:
        """Ids of runs that aren't known, most of which are known from then on."""
        code = "H" if self.dtype.itemsize == 2 else "I"
        found = [array(code, g.ids).tobytes() for g in self.lib.encode_batch_fast(runs, add_special_tokens=False)]
        for run, ids in zip(runs, found):
            if len(run) <= WORD_CHARS:
                self.known[run] = ids
                self.held += ENTRY_BYTES + len(run)
        return found

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each whole text, in the file's integer type. Each distinct run
        of the texts is looked up once."""
        out = [None if len(t) <= 2 * GROUP_CHARS and not any(s in t for s in self.special) else self._alone(t) for t in texts]
        column = pa.array([t if o is None else "" for t, o in zip(texts, out)], pa.large_string())
        bounds = np.frombuffer(column.buffers()[1], np.int64)[: len(texts) + 1]
        if not bounds[-1]:
            return [o or b"" for o in out]
        data = column.buffers()[2]
        cuts = run_starts(np.frombuffer(data, np.uint8)[: bounds[-1]], bounds[:-1])
        runs = pa.LargeStringArray.from_buffers(len(cuts), pa.py_buffer(np.append(cuts, bounds[-1]).astype(np.int64)), data)
        coded = runs.dictionary_encode()
        distinct, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        ids = list(map(self.known.get, distinct))
        missed = [i for i, b in enumerate(ids) if b is None]
        for i, new in zip(missed, self._learned([distinct[i] for i in missed])):
            ids[i] = new
        if self.held > MEMORY_BYTES:
            self.known.clear()
            self.held = 0
        size = self.dtype.itemsize
        held = np.frombuffer(b"".join(ids), self.dtype)
        n = np.fromiter(map(len, ids), np.int64, len(ids)) // size
        first, n_at = (np.cumsum(n) - n)[at], n[at]
        ends = np.concatenate([[0], np.cumsum(n_at)])
        flat = held[np.repeat(first - ends[:-1], n_at) + np.arange(ends[-1])].tobytes()
        places = (ends[np.searchsorted(cuts, bounds)] * size).tolist()
        return [flat[a:b] if o is None else o for o, a, b in zip(out, places, places[1:])]

    def _alone(self, text: str) -> bytes:
        """Ids of a text that holds special tokens, by the library as it is, or of a
        very long one, in stretches that end before a space and a letter."""
        if any(s in text for s in self.special):
            return np.array(self.lib.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
        out, at = [], 0
        while at < len(text):
            cut = _CUT.search(text, at + GROUP_CHARS)
            end = cut.start() if cut else len(text)
            if end - at > 2 * GROUP_CHARS:  # nowhere to cut it
                out.append(np.array(self.lib.encode(text[at:end], add_special_tokens=False).ids, self.dtype).tobytes())
            else:
                out += self.encode_all([text[at:end]])
            at = end
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


_loaded: dict[str, ByteBpe] = {}


def tokenizer(path: str) -> ByteBpe:
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


class ShardWriter:
    """Packs ids into equal-length sequences and writes batches as they fill."""

    def __init__(self, sink: pa.NativeFile, dtype: np.dtype, length: int = LENGTH, rows: int = BATCH_ROWS) -> None:
        self.dtype, self.length, self.rows = dtype, length, rows
        self.schema = pa.schema(
            [
                pa.field("ids", pa.list_(pa.from_numpy_dtype(dtype), length)),
                pa.field("mask", pa.list_(pa.bool_(), length)),
            ]
        )
        self.out, self.held, self.size = pa.ipc.new_stream(sink, self.schema), [], 0

    def add(self, ids: bytes) -> None:
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= (full := self.length * self.rows * self.dtype.itemsize):
            data = b"".join(self.held)
            for at in range(0, len(data) - full + 1, full):
                self._put(np.frombuffer(data, self.dtype, self.length * self.rows, at), self.length * self.rows)
            rest = data[len(data) - len(data) % full :]
            self.held, self.size = [rest], len(rest)

    def _put(self, ids: np.ndarray, real: int) -> None:
        mask = pa.array(np.arange(len(ids)) < real)
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(ids), self.length), pa.FixedSizeListArray.from_arrays(mask, self.length)]
        self.out.write_batch(pa.record_batch(lists, schema=self.schema))

    def close(self) -> None:
        ids = np.frombuffer(b"".join(self.held), self.dtype)
        if len(ids):
            padded = np.zeros(-(-len(ids) // self.length) * self.length, self.dtype)
            padded[: len(ids)] = ids
            self._put(padded, len(ids))
        self.out.close()


class SequenceFile:
    """Random access to the sequences of one shard; nothing is copied where the
    file system can map files."""

    def __init__(self, path: str, rows: int = BATCH_ROWS) -> None:
        fs, at = pafs.FileSystem.from_uri(path)
        self.source = pa.memory_map(at) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(at)
        self.batches = list(pa.ipc.open_stream(self.source))
        self.rows = rows

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (a view of the file) and mask of the i-th sequence."""
        batch, row = self.batches[i // self.rows], i % self.rows
        ids, mask = batch.column(0), batch.column(1)
        n = ids.type.list_size
        view = ids.flatten().to_numpy(zero_copy_only=True)[row * n : (row + 1) * n]
        return view, mask.flatten().slice(row * n, n).to_numpy(zero_copy_only=False)

    def ids(self, start: int, n: int) -> np.ndarray:
        """n ids from a place in the shard, across sequences and batches."""
        out = []
        while n:
            batch = self.batches[start // (self.rows * LENGTH)]
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=True)
            at = start % (self.rows * LENGTH)
            part = flat[at : at + n]
            out.append(part)
            start, n = start + len(part), n - len(part)
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.empty(0, "<u2")


def _put_file(folder: str, name: str, fill) -> str:
    """Writes beside its final place and renames: a task that runs twice, or dies,
    leaves one whole file."""
    fs, at = pafs.FileSystem.from_uri(folder)
    fs.create_dir(at, recursive=True)
    draft = f"{at}/.{name}.{uuid.uuid4().hex[:8]}"
    with fs.open_output_stream(draft) as sink:
        fill(sink)
    fs.move(draft, f"{at}/{name}")
    return f"{folder}/{name}"


def _groups(texts: Iterable[str]) -> Iterator[list[str]]:
    """Lists of whole texts, each of about GROUP_CHARS or one longer text."""
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size >= GROUP_CHARS:
            yield group
            group, size = [], 0
    if group:
        yield group


def write_token_files(
    docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text"
) -> list[tuple[int, str, int]]:
    """Writes the shards and returns (shard, path, ids of all shards before) of
    each: one entry a file."""
    ranged = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(tokenizer_path)
        end = np.array([end_id], bpe.dtype).tobytes()
        shard = TaskContext.get().partitionId()
        keys: list = []
        counts: list[int] = []

        def fill(sink) -> None:
            out = ShardWriter(sink, bpe.dtype)
            for batch in batches:
                keys.append(batch.column(0))
                for texts in _groups(x.as_py() for x in batch.column(1)):
                    for ids in bpe.encode_all(texts):
                        counts.append(len(ids) // bpe.dtype.itemsize + 1)
                        out.add(ids + end)
            out.close()

        path = _put_file(folder, f"shard-{shard:06d}.arrow", fill)
        n = np.array(counts, np.int64)
        table = pa.table({"doc_id": pa.chunked_array(keys, pa.int64()), "start": np.cumsum(n) - n, "n_tokens": n})
        _put_file(folder, f"shard-{shard:06d}.index.arrow", lambda sink: pa.ipc.new_stream(sink, table.schema).write_table(table))
        if counts:
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [path], "n_docs": [len(counts)], "n_ids": [int(n.sum())]})

    found, base = [], 0
    for row in sorted(ranged.mapInArrow(run, SHARDS).collect()):
        found.append((row.shard, row.path, base))
        base += row.n_ids
    return found


def read_token_files(spark, shards: list[tuple[int, str, int]]) -> DataFrame:
    """One row per document, from the files: its place, length and checksum."""
    files = spark.createDataFrame(shards, "shard int, path string, base long").repartition(max(1, len(shards)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = SequenceFile(row["path"])
                fs, at = pafs.FileSystem.from_uri(row["path"].removesuffix(".arrow") + ".index.arrow")
                with fs.open_input_file(at) as f:
                    index = pa.ipc.open_stream(f).read_all()
                for part in index.to_batches(max_chunksize=4096):
                    start, n = part.column(1).to_numpy(), part.column(2).to_numpy()
                    sums = [zlib.crc32(shard.ids(int(a), int(k)).astype("<u4")) for a, k in zip(start, n)]
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), pa.array(start + row["base"]), part.column(2), pa.array(sums, pa.int64()), pa.array([row["shard"]] * len(n), pa.int32()), pa.array(start // LENGTH)],
                        names=INDEX.fieldNames(),
                    )

    return files.mapInArrow(run, INDEX)
