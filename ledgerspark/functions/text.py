"""Text columns: normal forms, words, scripts, shingles and statements. All but
``normalized`` stay inside the JVM. A null text gives null."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = r"[\p{L}\p{M}\p{Nd}\p{Pc}]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(value: Column, use) -> Column:
    """use(value) with the value computed once for the row: as a lambda's argument it
    isn't computed again inside the lambdas within."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


@F.pandas_udf(T.StringType())
def _folded_beyond_ascii(text: pd.Series) -> pd.Series:
    return text.map(lambda s: unicodedata.normalize("NFKC", s).casefold(), na_action="ignore") if text.notna().any() else text


def _beyond(text: Column) -> Column:
    return text.rlike(r"[^\x00-\x7F]")


def _folded(text: Column) -> Column:
    """NFKC, case folded. Of ASCII that is its lower case, so only other texts go to Python."""
    beyond = _beyond(text)
    return F.when(beyond, _folded_beyond_ascii(F.when(beyond, text))).otherwise(F.lower(text))


def _spaced(folded: Column) -> Column:
    return F.trim(F.regexp_replace(folded, r"[^\p{L}\p{M}\p{N}]+", " "))


def normalized(text: Column | str) -> Column:
    """NFKC, case folded, everything but letters, marks and digits as one space.
    NFKC and case folding have no built-in: one Arrow batch passes through Python."""
    return _spaced(_folded(_col(text)))


def with_normalized(df: DataFrame, col: str) -> DataFrame:
    """df with a column in its normal form. Rows whose text is ASCII don't pass Python, not
    even as nulls; df is read twice for that."""
    beyond = F.coalesce(_beyond(F.col(col)), F.lit(False))
    return df.where(~beyond).withColumn(col, _spaced(F.lower(col))).union(df.where(beyond).withColumn(col, normalized(col)))


def archive_key(text: Column | str) -> Column:
    """The archive's normal form: NFKC, case folded, everything but letters and digits
    (marks too) as one space."""
    return F.trim(F.regexp_replace(_folded(_col(text)), r"[^\p{L}\p{N}]+", " "))


def name_key(text: Column | str) -> Column:
    """The form in which names are looked for: NFKC, case folded, letters, digits and
    underscores alone, so that spaces, hyphens and apostrophes don't count."""
    return F.regexp_replace(_folded(_col(text)), r"[^\p{L}\p{N}_]+", "")


def words(text: Column | str) -> Column:
    return F.regexp_extract_all(_col(text), F.lit(WORD), F.lit(0))


def estimated_tokens(text: Column | str) -> Column:
    """The larger of the words and the characters other than white space by 3.5, rounded up."""
    dense = F.length(F.regexp_replace(_col(text), r"\s+", ""))
    return F.greatest(F.size(words(text)).cast("long"), F.ceil(dense / 3.5))


def letters(text: Column | str, script: str) -> Column:
    """Letters of a script (a Unicode script name)."""
    return F.length(F.regexp_replace(_col(text), rf"\P{{Is{script}}}+", ""))


def script(text: Column | str) -> Column:
    """cyrillic, latin, mixed, or other."""
    c, lat = letters(text, "Cyrillic") > 0, letters(text, "Latin") > 0
    return F.when(c & lat, "mixed").when(c, "cyrillic").when(lat, "latin").when(_col(text).isNotNull(), "other")


def shingles(text: Column | str, k: int) -> Column:
    """The distinct runs of k lower-case words; none where there are fewer words."""

    def runs(w: Column) -> Column:
        found = F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: F.array_join(F.slice(w, i, k), " "))
        return F.when(F.size(w) >= k, F.array_distinct(found)).when(w.isNotNull(), F.array().cast("array<string>"))

    return bound(words(F.lower(_col(text))), runs)


def statements(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row a sentence: (id, position from 0, statement); blank ones are left out."""
    parts = F.filter(F.transform(F.split(_col(text_col), r"(?<=[.!?…])[ \t\n\f\r]+"), lambda s: F.trim(s)), lambda s: s != "")
    return df.select(id_col, F.posexplode(parts).alias("position", "statement"))


EDITS = T.StructType([T.StructField(n, T.LongType()) for n in ("n_reference", "substitutions", "deletions", "insertions")])


def edit_path(reference: list[str], hypothesis: list[str]) -> tuple[int, int, int]:
    """Substitutions, deletions and insertions of the shortest edit path; of several
    that with the fewest substitutions, then deletions.

    A path's counts are the digits of one number whose leading digit is the distance, so
    the least number is the path asked for. A row of the table is one array: its
    insertions are a running minimum."""
    base = max(len(reference), len(hypothesis)) * 2 + 2
    kind = np.int64 if base**4 < 2**62 else object
    edit = base**3
    substitution, deletion, insertion = edit + base**2, edit + base, edit + 1
    of = {u: n for n, u in enumerate(dict.fromkeys([*reference, *hypothesis]))}
    other = np.array([of[u] for u in hypothesis], np.int64)
    along = np.arange(len(hypothesis) + 1).astype(kind) * insertion
    row = along.copy()
    for unit in reference:
        new = row + deletion
        step = np.where(other == of[unit], 0, substitution).astype(kind)
        new[1:] = np.minimum(new[1:], row[:-1] + step)
        row = np.minimum.accumulate(new - along) + along
    left = int(row[-1]) % edit
    return left // base**2, left // base % base, left % base


#: Cells that one step of edit_paths may hold, and units beyond which a pair is taken alone.
EDIT_CELLS, EDIT_LONG = 1_000_000, 2_000


def edit_paths(pairs: list[tuple[list[str], list[str]]]) -> list[tuple[int, int, int]]:
    """edit_path of many pairs: those of about one length have their rows in one array, which
    goes through their references a unit at a time."""
    out: list = [None] * len(pairs)
    order = sorted(range(len(pairs)), key=lambda i: (len(pairs[i][1]), len(pairs[i][0])))
    while order and max(map(len, pairs[order[-1]])) > EDIT_LONG:
        out[order[-1]] = edit_path(*pairs[order.pop()])
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and (hi + 1 - lo) * (len(pairs[order[hi]][1]) + 1) <= EDIT_CELLS and len(pairs[order[hi]][0]) <= EDIT_LONG:
            hi += 1
        some = [pairs[i] for i in order[lo:hi]]
        sizes = np.array([(len(r), len(h)) for r, h in some], np.int64)
        base = int(sizes.max()) * 2 + 2
        if base**4 >= 2**62:
            found = [edit_path(*p) for p in some]
        else:
            of: dict[str, int] = {}
            sides = [np.full((len(some), most), fill, np.int64) for most, fill in zip(sizes.max(axis=0), (-1, -2), strict=True)]
            for n, pair in enumerate(some):
                for side, units in zip(sides, pair, strict=True):
                    side[n, : len(units)] = [of.setdefault(u, len(of)) for u in units]
            edit = base**3
            substitution, deletion, insertion = edit + base**2, edit + base, edit + 1
            along = np.arange(sides[1].shape[1] + 1) * insertion
            row = np.tile(along, (len(some), 1))
            for i in range(sides[0].shape[1]):
                new = row + deletion
                np.minimum(new[:, 1:], row[:, :-1] + np.where(sides[1] == sides[0][:, i : i + 1], 0, substitution), out=new[:, 1:])
                new = np.minimum.accumulate(new - along, axis=1) + along
                row = np.where((sizes[:, 0] > i)[:, None], new, row)
            left = row[np.arange(len(some)), sizes[:, 1]] % edit
            found = list(zip((left // base**2).tolist(), (left // base % base).tolist(), (left % base).tolist(), strict=True))
        for i, counts in zip(order[lo:hi], found, strict=True):
            out[i] = counts
        lo = hi
    return out


def edit_counts(reference: Column | str, hypothesis: Column | str) -> Column:
    """T4: a struct of n_reference, substitutions, deletions and insertions of two lists
    of units (words or characters); null where either is. Arrow batches pass through
    Python, as no built-in function splits the distance."""

    @F.pandas_udf(EDITS)
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        whole = [i for i, (x, y) in enumerate(zip(a, b)) if x is not None and y is not None]
        rows: list = [(None,) * 4] * len(a)
        for i, counts in zip(whole, edit_paths([(list(a[i]), list(b[i])) for i in whole])):
            rows[i] = (len(a[i]), *counts)
        return pd.DataFrame(rows, columns=EDITS.fieldNames())

    return run(_col(reference), _col(hypothesis))


def characters(text: Column | str) -> Column:
    """The code points of a text."""
    return F.filter(F.split(_col(text), ""), lambda c: c != "")
