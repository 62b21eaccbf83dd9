"""Byte-pair encoding as a streaming transducer with bounded lookahead.

The merge list alone bounds how far to the right of a token boundary the text can
still change that boundary (``sufficient_lookahead``). The encoder therefore holds
a window of a run of letters, merges it, and emits the tokens that end at least
that far before the window's end: they are stable. Decoding is an incremental
state machine from token bytes to text.

Null texts count as empty; an empty text has no tokens. Repeated rows give
repeated results. Texts of any length pass in pieces of bounded size. An empty table
gives no rows. Other columns pass unchanged, whatever their names; one that has the
name of the result is replaced. Ids are unpacked in the byte order of the machine,
little-endian."""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterable, Iterator

import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ledgerspark.llm.common import with_text_struct

#: Characters of a text that are normalised at once.
PIECE_CHARS = 1 << 16
#: Distinct words whose tokens a worker remembers before it starts anew.
MEMORY_WORDS = 150_000
#: White space as the tokenizer's patterns have it.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACES = re.compile(f"[{SPACE}]+")
_PIECE = re.compile(f"(?s:.){{{PIECE_CHARS}}}[^{SPACE}]*|(?s:.)+")
_SEPARATORS = re.compile("[\x1c-\x1f]")

RESULT = T.StructType(
    [
        T.StructField("n_tokens", T.LongType(), False),
        T.StructField("ids", T.BinaryType(), False),
        T.StructField("decoded", T.StringType(), False),
    ]
)
DIGESTS = T.StructType(
    [
        T.StructField("n_tokens", T.LongType(), False),
        T.StructField("ids_sha256", T.StringType(), False),
        T.StructField("decoded_sha256", T.StringType(), False),
    ]
)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Merges:
    """The merge list over symbol numbers."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str) -> None:
        self.vocab, self.suffix = vocab, suffix
        self.rank: dict[int, int] = {}  # by left << 20 | right
        self.made: list[int] = []
        self.sides: list[tuple[int, int]] = []
        for r, (a, b) in enumerate(merges):
            pair = vocab[a], vocab[b]
            self.rank.setdefault(pair[0] << 20 | pair[1], r)
            self.made.append(vocab[a + b])
            self.sides.append(pair)
        bytes_ = byte_symbols()
        self.inner = [vocab[c] for c in bytes_]
        self.last = [vocab[c + suffix] for c in bytes_]
        self.width = {self.inner[i]: 1 for i in range(256)} | {self.last[i]: 1 for i in range(256)}
        for (a, b), c in zip(self.sides, self.made, strict=True):
            self.width[c] = self.width[a] + self.width[b]
        self.lookahead = self.sufficient_lookahead()
        self.widest = max(self.width.values())

    def sufficient_lookahead(self) -> int:
        """Symbols right of a merge's end on which whether it happens can depend.

        In order of rank: merge i joins u and v if both formed and no earlier merge
        broke into them. Forming v, forming u, a merge of v's right edge with what
        follows, of u's left edge with what precedes, and one across the seam each
        carry their own reach; the largest, measured from v's end, is i's reach."""
        left_of: dict[int, int] = {}
        right_of: dict[int, int] = {}
        parts: dict[int, tuple[int, int]] = {}
        own: dict[int, int] = {}
        reach: list[int] = []

        def edge(x: int, side: int) -> list[int]:
            out = [x]
            while out[-1] in parts:
                out.append(parts[out[-1]][side])
            return out

        width = self.width
        for (u, v), made in zip(self.sides, self.made, strict=True):
            wu, wv = width[u], width[v]
            far = max(0, own.get(v, 0), own.get(u, 0) - wv)
            into_v, out_u = edge(v, 0), edge(u, 1)
            for x in edge(v, 1):
                far = max(far, left_of.get(x, 0))
            for x in edge(u, 0):
                far = max(far, right_of.get(x, 0) - (wu - width[x]) - wv)
            for x in out_u:
                for y in into_v:
                    j = self.rank.get(x << 20 | y)
                    if j is not None and j < len(reach):
                        far = max(far, reach[j] - (wv - width[y]))
            reach.append(far)
            left_of[u] = max(left_of.get(u, 0), wv + far)
            right_of[v] = max(right_of.get(v, 0), far)
            own[made] = max(own.get(made, 0), far)
            parts.setdefault(made, (u, v))
        return max(reach, default=0)

    def merge(self, ids: list[int]) -> list[int]:
        """Merges by lowest rank, leftmost first, until none is left."""
        if len(ids) > 48:
            return self._merge_long(ids)
        get, never = self.rank.get, len(self.made)
        ranks = [get(a << 20 | b, never) for a, b in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == never:
                break
            i = ranks.index(best)
            ids[i] = x = self.made[best]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(x << 20 | ids[i + 1], never)
            if i:
                ranks[i - 1] = get(ids[i - 1] << 20 | x, never)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, get = len(ids), self.rank.get
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            if not alive[i] or ids[i] != a or (j := after[i]) >= n or ids[j] != b:
                continue
            ids[i], alive[j] = self.made[r], False
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (q := get(ids[i] << 20 | ids[after[i]])) is not None:
                    heapq.heappush(heap, (q, i, ids[i], ids[after[i]]))
            if (h := before[i]) >= 0 and (q := get(ids[h] << 20 | ids[i])) is not None:
                heapq.heappush(heap, (q, h, ids[h], ids[i]))
        return [x for x, ok in zip(ids, alive) if ok]

    def stream(self, word: bytes, ended: bool = True) -> Iterator[int]:
        """Tokens of one run of bytes, each as soon as it is stable."""
        hold = self.lookahead + self.widest
        window, at, n = max(64, 4 * hold), 0, len(word)
        while at < n:
            end = min(n, at + window)
            ids = [self.inner[b] for b in word[at:end]]
            if end == n:
                if ended:
                    ids[-1] = self.last[word[-1]]
                yield from self.merge(ids)
                return
            room = end - at - hold
            for x in self.merge(ids):
                if self.width[x] > room:
                    break
                room -= self.width[x]
                at += self.width[x]
                yield x


class WordBpe:
    """Encoder and decoder of a word-level BPE tokenizer file (lower case, NFC,
    white space dropped, the last symbol of each word marked by a suffix)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = dict(model["vocab"])
        self.merges = Merges(vocab, [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]], model["end_of_word_suffix"] or "")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in (vocab | self.special).items()}
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.shown = {i: b" " + t.encode() for i, t in self.token.items()}
        self.words = regex.compile(pattern.replace(r"\s", SPACE))
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[str, bytes] = {}

    def _word(self, unit: str) -> bytes:
        """Ids of a stretch between white space, remembered."""
        if len(unit) > 1 and unit[-1] in ",." and unit[:-1].isalpha():
            a, b = (self.known.get(u) or self._word(u) for u in (unit[:-1], unit[-1]))
            out = a + b
        else:
            ids: list[int] = []
            for run in [unit] if unit.isalpha() else self.words.findall(unit):
                ids.extend(self.merges.stream(run.encode()))
            out = struct.pack(f"<{len(ids)}I", *ids)
        if len(unit) <= 64:
            if len(self.known) >= MEMORY_WORDS:
                self.known.clear()
            self.known[unit] = out
        return out

    def pieces(self, text: str) -> Iterator[bytes]:
        """Ids of the text, a bounded stretch at a time."""
        parts = self.at_special.split(text) if self.at_special and "<" in text else [text]
        for part in parts:
            if part in self.special:
                yield struct.pack("<I", self.special[part])
                continue
            for piece in [part] if len(part) <= PIECE_CHARS else (m[0] for m in _PIECE.finditer(part)):
                if not piece.isascii():
                    piece = unicodedata.normalize("NFC", piece).replace("Σ", "σ")
                piece = piece.lower()
                units = _SPACES.split(piece) if _SEPARATORS.search(piece) else piece.split()
                known, word = self.known.get, self._word
                found = [known(u) or word(u) for u in units if u]
                if found:
                    yield b"".join(found)

    def encode(self, text: str) -> list[int]:
        data = b"".join(self.pieces(text))
        return list(struct.unpack(f"<{len(data) // 4}I", data))

    def decode(self, ids: Iterable[int]) -> str:
        state = Decoding(self.shown)
        return state.feed(ids) + state.end()


class Decoding:
    """Text of a stream of ids: a state machine over the bytes of their tokens, a space
    before each but the first. Between calls it keeps whether a token has been, and at
    most the three bytes of a character begun; what can't be text becomes U+FFFD."""

    def __init__(self, shown: dict[int, bytes]) -> None:
        self.shown, self.state, self.begun = shown, codecs.getincrementaldecoder("utf-8")("replace"), False

    def feed(self, ids: Iterable[int]) -> str:
        """The text that is certain after these ids."""
        data = b"".join(map(self.shown.__getitem__, ids))
        if data and not self.begun:
            data, self.begun = data[1:], True
        return self.state.decode(data)

    def end(self) -> str:
        return self.state.decode(b"", True)


_loaded: dict[str, WordBpe] = {}


def tokenizer(path: str) -> WordBpe:
    """The tokenizer of a worker process, loaded once."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def encode_column(docs: DataFrame, tokenizer_path: str, text_col: str = "text", out: str = "bpe") -> DataFrame:
    """docs with a struct column: n_tokens, ids (little-endian unsigned 32-bit
    integers) and the text that decoding them gives."""

    def make():
        bpe = tokenizer(tokenizer_path)

        def one(text: str | None) -> tuple[int, bytes, str]:
            ids = b"".join(bpe.pieces(text or ""))
            back = Decoding(bpe.shown)
            return len(ids) // 4, ids, back.feed(memoryview(ids).cast("I")) + back.end()

        return one

    return with_text_struct(docs, text_col, out, RESULT, make)


def encode_digests(docs: DataFrame, tokenizer_path: str, text_col: str = "text", out: str = "bpe") -> DataFrame:
    """As encode_column, but with the SHA-256 of the ids and of the decoded text,
    both fed as the transducer emits them: no text's tokens are held whole."""

    def make():
        bpe = tokenizer(tokenizer_path)

        def one(text: str | None) -> tuple[int, str, str]:
            n, digest, text_digest, back = 0, hashlib.sha256(), hashlib.sha256(), Decoding(bpe.shown)
            for ids in bpe.pieces(text or ""):
                n += len(ids) // 4
                digest.update(ids)
                text_digest.update(back.feed(memoryview(ids).cast("I")).encode())
            text_digest.update(back.end().encode())
            return n, digest.hexdigest(), text_digest.hexdigest()

        return one

    return with_text_struct(docs, text_col, out, DIGESTS, make)
