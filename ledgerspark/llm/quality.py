"""Quality rules: counts, then divergence from the language's own habits.

For each language the corpus gives two reference histograms, summed over all its
documents long enough to tell: classes of characters and common words. A document
is held against its language's references by Jensen-Shannon distance (the square
root of the divergence in bits, 0 to 1). Common words are judged twice: by their own
distribution, which tells languages apart, and by the share of all other words, which
tells prose from lists. In one histogram the other words would swamp both. Short
documents are never judged by divergence, nor are languages whose reference rests on
few documents.

Null and empty texts have no words. A null language is a language of its
own. Repeated rows give repeated results and count again in the references. Very long
texts count whole. An empty table gives no rows. Other columns pass unchanged, whatever
their names."""

from __future__ import annotations

import functools
import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerspark.llm.common import small_rows, with_text_struct

SYMBOLS = b"#*$%&|<>"
#: A document under these isn't judged by divergence; a language whose reference
#: has fewer documents judges none.
LEAST_WORDS, LEAST_CHARS, LEAST_DOCS = 50, 200, 20
#: Greatest distances that a kept document may have. Of sf0.1's documents labelled as
#: of quality, 2 of 3243 have common words more than 0.7 away, and 65 of 9729 are as
#: near to another language; on sf0.01 the share of other words is at most 0.12 away,
#: and 0.235 to 0.393 in lists and texts of words with signs.
MOST_CLASS, MOST_WORD, MOST_SHARE = 0.3, 0.7, 0.2
#: Languages whose references are sent to every task; with more, a join deals them.
MOST_LANGUAGES = 1000

#: Classes of bytes of UTF-8 text; a character beyond ASCII counts by its first byte.
CLASSES = ("lower", "upper", "digit", "space", "stop", "quote", "bracket", "symbol", "control", "latin", "script", "wide", "rare")
#: Common words, fixed values: the most usual words of some languages.
COMMON = (
    "the of and to in a is that it for as with was on be by this are from or at an not but he she they his her you we "
    "le la les de des du et un une en est que qui dans pour pas sur au avec ce il elle par plus ne se "
    "der die das den dem und ist von zu mit ein eine im für auf sich nicht es auch er sie werden "
    "el los las del que y una por con no su para es lo como más o pero sus al se "
    "il di che e per non si una della con sono i da uma os do não com mais het een van op te dat niet"
).split()
WORDS = tuple(dict.fromkeys(COMMON))

FEATURES = T.StructType(
    [T.StructField(n, T.LongType(), False) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("base_failed", T.BooleanType(), False)]
    + [T.StructField(n, T.ArrayType(T.LongType(), False), False) for n in ("classes", "words")]
)
HISTOGRAMS = T.StructType([T.StructField("n_words", T.LongType(), False), T.StructField("n_chars", T.LongType(), False), *FEATURES.fields[-2:]])


def _class_of(b: int) -> int | None:
    c = chr(b)
    if b >= 128:
        return None if b < 0xC0 else 9 if b < 0xC4 else 10 if b < 0xE0 else 11 if b < 0xF0 else 12
    if c.isalpha():
        return 0 if c.islower() else 1
    if c.isdigit():
        return 2
    if c in " \t\n\r\f\v":
        return 3
    if c in ".,;:!?":
        return 4
    if c in "'\"`-":
        return 5
    if c in "()[]{}":
        return 6
    return 7 if 32 < b < 127 else 8


_CLASS = np.array([len(CLASSES) if (k := _class_of(b)) is None else k for b in range(256)])
_COMMON_AT = {w.encode(): i for i, w in enumerate(WORDS)}
_EDGES = b".,;:!?\"'()[]"
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def class_histogram(data: bytes) -> np.ndarray:
    by_byte = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    return np.bincount(_CLASS, by_byte, len(CLASSES) + 1)[:-1].astype(np.int64)


def word_histogram(words: list[bytes]) -> np.ndarray:
    """Common words by place in WORDS, then all other words. Case and the
    punctuation around a word don't count."""
    out = np.zeros(len(WORDS) + 1, np.int64)
    for word, n in Counter(words).items():
        if len(word) <= 16:
            out[_COMMON_AT.get(word.strip(_EDGES).lower(), -1)] += n
        else:
            out[-1] += n
    return out


def repeated_words(words: list[bytes], window: int = 5) -> int:
    """Words that lie in a window of words found twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = np.zeros(n, np.uint64)
    for k in range(window):
        x = h[k : k + n] * _MIX[k]
        mixed = (mixed ^ (x ^ (x >> np.uint64(29)))) * np.uint64(0xBF58476D1CE4E5B9)
    ordered = np.sort(mixed)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    twice = np.unique(twice)
    at = np.minimum(np.searchsorted(twice, mixed), len(twice) - 1)
    starts = np.flatnonzero(twice[at] == mixed)
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + window, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def features(text: str | None) -> tuple:
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    chars = len(text or "") - (len(data) - len(data.translate(None, b" \t\n\v\f\r")))
    lines = [x for x in data.split(b"\n") if x.strip()]
    repeats = repeated_words(words)
    failed = n < 10 or 100 * repeats > 20 * n
    return (
        n, chars, len(data) - len(data.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeats, failed,
        class_histogram(data), word_histogram(words),
    )


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """For each language: documents, and both histograms summed. Partial sums are
    made before the shuffle, so that it carries a row per language and task."""

    def make():
        def one(text: str | None) -> tuple:
            data = (text or "").encode("utf-8", "surrogatepass")
            words = data.split()
            return len(words), len(text or ""), class_histogram(data), word_histogram(words)

        return one

    each = with_text_struct(docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")), "text", "h", HISTOGRAMS, make)
    each = each.where((F.col("h.n_words") >= LEAST_WORDS) & (F.col("h.n_chars") >= LEAST_CHARS)).select("lang", "h")
    sums = lambda name, n: F.array(*[F.sum(F.col(f"h.{name}")[i]) for i in range(n)])
    return each.groupBy("lang").agg(
        F.count("*").alias("n_docs"), sums("classes", len(CLASSES)).alias("ref_classes"), sums("words", len(WORDS) + 1).alias("ref_words")
    )


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms; null if either is empty. Both and
    their totals are bound once, so that the time is linear in the bins."""
    total = lambda h: F.aggregate(h, F.lit(0).cast("long"), lambda a, x: a + x)
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    def of(both: Column) -> Column:
        shares = F.zip_with(both.p, both.q, lambda x, y: F.struct((x / both.a).alias("x"), (y / both.b).alias("y")))
        terms = F.transform(shares, lambda s: part(s.x, (s.x + s.y) / 2) + part(s.y, (s.x + s.y) / 2))
        sound = (both.a > 0) & (both.b > 0)
        return F.when(sound, F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2)))

    bound = F.array(F.struct(p.alias("p"), q.alias("q"), total(p).alias("a"), total(q).alias("b")))
    return F.element_at(F.transform(bound, of), 1)


def own_words(words: Column) -> Column:
    """The common words of a word histogram, without the bin of all other words."""
    return F.slice(words, 1, len(WORDS))


def shares(words: Column) -> Column:
    """Common words and all other words, as a histogram of two bins."""
    return F.array(F.aggregate(own_words(words), F.lit(0).cast("long"), lambda a, x: a + x), F.element_at(words, -1))


def private(name: str, columns: list[str]) -> str:
    """A column name that none of these is, in any case of letters."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", out: str = "quality") -> DataFrame:
    """docs with a struct column: the counts, base_failed, the distances (null where
    not judged) and kept. An existing column of that name is replaced; all others pass
    unchanged, whatever their names."""
    ref, far = private("_reference", [*docs.columns, out]), private("_distances", [*docs.columns, out])
    names = ("lang", "n_docs", "ref_classes", "ref_words")
    refs = references(docs, text_col, lang_col).select(F.struct(*names).alias(ref))
    rows = small_rows(refs, MOST_LANGUAGES)
    if rows is not None:
        refs = F.broadcast(docs.sparkSession.createDataFrame(rows, refs.schema))

    def make():
        return features

    each = with_text_struct(docs, text_col, out, FEATURES, make)
    held = each.join(refs, F.col(f"`{lang_col}`").eqNullSafe(F.col(f"`{ref}`.lang")), "left")
    f, r = (lambda n: F.col(f"`{out}`.{n}")), (lambda n: F.col(f"`{ref}`.{n}"))
    long_enough = (f("n_words") >= LEAST_WORDS) & (f("word_chars") >= LEAST_CHARS) & (r("n_docs") >= LEAST_DOCS)
    words = f("words"), r("ref_words")
    pairs = {"class_distance": (f("classes"), r("ref_classes")), "word_distance": tuple(map(own_words, words)), "share_distance": tuple(map(shares, words))}
    held = held.withColumn(far, F.struct(*[F.when(long_enough, distance(*both)).alias(n) for n, both in pairs.items()]))
    d = lambda n: F.col(f"`{far}`.{n}")
    bounds = {"class_distance": MOST_CLASS, "word_distance": MOST_WORD, "share_distance": MOST_SHARE}
    too_far = functools.reduce(lambda a, b: a | b, [F.coalesce(d(n) > most, F.lit(False)) for n, most in bounds.items()])
    return held.select(
        *[F.col(f"`{c}`") for c in docs.columns if c.lower() != out.lower()],
        F.struct(
            *[f(n).alias(n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")],
            *[d(n).alias(n) for n in pairs], (~f("base_failed") & ~too_far).alias("kept"),
        ).alias(out),
    )


def words_of(text: str) -> list[str]:
    """Words as the rules count them."""
    return re.findall(r"[^\x20\x09-\x0D]+", text)
