"""Texts against fixed word lists: stems, sensitivity, states of a relation, corrections,
quotes, and whether a text supports a statement. All but the last stay inside the JVM."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerspark.functions.text import _col, bound, normalized

# Endings of Russian and Kazakh words.
ENDINGS = (
    "ами ями ого его ому ему ыми ими ией иям ием иях ой ей ий ый ая яя ое ее ую юю ых их ом ем ам ям ах ях "
    "ью ия ие ии ся сь а я у ю е о ы и ь ның нің дың дің тың тің ға ге қа ке нда нде да де та те дан ден тан тен "
    "нан нен ды ді ты ті ны ні мен бен пен лар лер дар дер тар тер ым ім ың ің сы сі м ң"
).split()
LEAST_STEM = 3
STRIPS = 2

# Words of negation and of causes.
NEGATION = {"не", "ни", "нет", "никогда", "емес", "жоқ", "ешқашан", "not", "never", "no"}
CAUSALITY = {"потому", "поэтому", "ради", "из-за", "чтобы", "себебі", "сондықтан", "үшін", "because", "therefore", "so"}

# Markers of sensitive subjects; a star stands for any ending.
SENSITIVE = {
    "health_or_death": "болезнь болел больница рак диагноз смерть умер умерла ауру аурухана қайтыс өлім health illness hospital death died",
    "family_conflict": "конфликт ссора развод жанжал ажырас* divorce",
    "legal_or_financial": "долг деньги суд тюрьма қарыз сот debt court",
}
HIGHLY_SENSITIVE = {
    "violence_or_self_harm": "насилие изнасил* самоубий* суицид зорлық abuse rape suicide",
    "reproductive_or_addiction": "аборт зависимость наркот* есірткі abortion addiction",
}

# What a text says of a relation, the first state that is found stands.
RELATION_STATES = [
    ("unresolved", [r"не\s+не\s+(брат|сестра|отец|мать|муж|жена)"]),
    ("figurative", [r"как\s+(родной\s+)?брат", r"как\s+(родная\s+)?сестра", "ағамдай", "бауырдай", r"неродн(ой|ая)\s+(брат|сестра)"]),
    (
        "negated",
        [
            r"никогда\s+не\s+были\s+женаты", r"не\s+является\s+(его\s+|её\s+|ее\s+)?(отцом|матерью)", r"не\s+(мой|моя|его|её|ее|ей|ему)?\s*(брат|сестра|отец|мать|муж|жена)",
            r"(әкесі|анасы|ағасы|інісі|әпкесі|сіңлісі|күйеуі|әйелі)\s+емес", r"туыс\s+емес", r"ерлі[-\s]?зайыпты\s+емес",
        ],
    ),
    ("ended", [r"развел(ись|ся|ась)", r"вдов(а|ец|ы|цы)", "жесір", r"ажыраст(ы|ық|ыңыз)", r"уже\s+не\s+женаты", r"больше\s+не\s+супруги", r"қазір\s+бірге\s+емес"]),
    ("former", [r"бывш(ий|ая|ие|его|ей)", "бұрынғы", r"раньше\s+были\s+женаты", r"бұрын\s+ерлі[-\s]?зайыпты\s+болған"]),
]

# Phrases that correct what was said, and a frame of two parts.
CORRECTION_CUES = ["жоқ", "дұрыс айтсам", "дұрысы", "дәлірек айтсам", "нақтырақ айтсам", "нет", "точнее", "вернее", "правильнее сказать", "no", "i mean", "rather"]
CORRECTION_FRAME = ("емес", "болуы керек")

# Letters that only Kazakh has, and function words of one language.
LANGUAGE_LETTERS = {"kk": "әғқңөұүһі", "ru": ""}
LANGUAGE_WORDS = {
    "kk": """мен бен пен және бірақ сол бұл ол біз олар үшін кейін содан сосын ма ме ба бе па пе ғой қой деп керек бар жоқ менің оның
    біздің сонда қазір""",
    "ru": """и в на с со что как я мы он она они но потом же к по у за от до это был была были было не мне нас нам там тогда когда
    очень ещё еще уже его её ее их тоже""",
}

# Marks around what is said.
QUOTE_MARKS = ["«»", "“”", "„“", '""']
LEAST_QUOTE = 5


def inflection_stems(word: Column | str) -> Column:
    """The word and what is left of it without one or two endings, three letters at
    least, sorted. Digits and shorter words stand for themselves."""
    word = _col(word)
    endings = F.array(*[F.lit(e) for e in ENDINGS])

    def shorter(w: Column) -> Column:
        fits = F.filter(endings, lambda e: F.endswith(w, e) & (F.length(w) - F.length(e) >= LEAST_STEM))
        return F.transform(fits, lambda e: F.left(w, F.length(w) - F.length(e)))

    once = shorter(word)
    twice = F.flatten(F.transform(once, shorter))
    all_ = F.array_sort(F.array_distinct(F.concat(F.array(word), once, twice)))
    return F.when(word.rlike(r"^\p{Nd}+$") | (F.length(word) < LEAST_STEM), F.array(word)).when(word.isNotNull(), all_)


def same_word(a: Column, b: Column) -> Column:
    """Whether two words have a stem in common."""
    digits = a.rlike(r"^\p{Nd}+$") | b.rlike(r"^\p{Nd}+$")
    long = (F.length(a) >= LEAST_STEM) & (F.length(b) >= LEAST_STEM)
    return (a == b) | (~digits & long & F.arrays_overlap(inflection_stems(a), inflection_stems(b)))


def _has(flat: Column, marker: str) -> Column:
    """Whether a normal form between spaces holds a marker as whole words."""
    return flat.contains(f" {marker[:-1]}" if marker.endswith("*") else f" {marker} ")


def _categories(flat: Column, markers: dict[str, str]) -> Column:
    def one(words: str) -> Column:
        open_, whole = [], []
        for m in words.split():
            (open_ if m.endswith("*") else whole).append(rf"\Q{m.rstrip('*')}\E")
        return flat.rlike("|".join([f" (?:{'|'.join(whole)}) "] * bool(whole) + [f" (?:{'|'.join(open_)})"] * bool(open_)))

    return F.array_compact(F.array(*[F.when(one(markers[c]), F.lit(c)) for c in sorted(markers)]))


def sensitivity(text: Column | str) -> Column:
    """A struct of level (highly_sensitive, sensitive, normal) and the categories of
    that level whose markers occur, sorted. The normal form is made once, and each
    category is one expression over it."""

    def told(found: Column) -> Column:
        level = F.when(F.size(found.high) > 0, "highly_sensitive").when(F.size(found.some) > 0, "sensitive").otherwise("normal")
        return F.struct(level.alias("level"), F.when(F.size(found.high) > 0, found.high).otherwise(found.some).alias("categories"))

    both = lambda flat: F.struct(_categories(flat, HIGHLY_SENSITIVE).alias("high"), _categories(flat, SENSITIVE).alias("some"))
    return bound(bound(F.concat(F.lit(" "), normalized(text), F.lit(" ")), both), told)


def relationship_state(text: Column | str) -> Column:
    """Unresolved, figurative, negated, ended or former, the first of them that is
    found; else current. Null gives null."""
    text = _col(text)
    out = F.when(text.isNull(), F.lit(None).cast("string"))
    for state, patterns in RELATION_STATES:
        out = out.when(text.rlike(rf"(?iU)\b({'|'.join(patterns)})\b"), state)
    return out.otherwise("current")


def correction_cues(text: Column | str) -> Column:
    """The cues that a text holds as whole phrases, in the list's order, and its frame last."""
    first, second = CORRECTION_FRAME

    def found(flat: Column) -> Column:
        frame = F.when(_has(flat, first) & _has(flat, second), F.lit(f"{first} ... {second}"))
        return F.array_compact(F.array(*[F.when(_has(flat, c), F.lit(c)) for c in CORRECTION_CUES], frame))

    return bound(F.concat(F.lit(" "), normalized(text), F.lit(" ")), found)


def read_language(text: Column | str) -> Column:
    """T5: a struct of the languages that a text shows, by letters or function words of one
    language only, and what it is in: one of them, mixed, or unknown. Null shows none."""
    flat = F.coalesce(F.lower(_col(text)), F.lit(""))
    words = F.regexp_extract_all(flat, F.lit(r"\p{L}+"), F.lit(0))
    shown = []
    for code in sorted(LANGUAGE_WORDS):
        seen = F.arrays_overlap(words, F.array(*[F.lit(w) for w in LANGUAGE_WORDS[code].split()]))
        if LANGUAGE_LETTERS[code]:
            seen = seen | flat.rlike(f"[{LANGUAGE_LETTERS[code]}]")
        shown.append(F.when(seen, F.lit(code)))
    languages = F.array_compact(F.array(*shown))
    detected = F.when(F.size(languages) == 0, "unknown").when(F.size(languages) == 1, F.get(languages, F.lit(0))).otherwise("mixed")
    return F.struct(languages.alias("languages"), detected.alias("detected"))


def quotes(text: Column | str) -> Column:
    """What a text says in quotation marks on one line, then what follows a dash at
    the start of a line or after a colon; white space as one space, outer marks off,
    five characters at least, each once."""
    text = _col(text)
    found = [F.regexp_extract_all(text, F.lit(rf"{a}([^{b}\n]{{{LEAST_QUOTE},}}){b}"), F.lit(1)) for a, b in QUOTE_MARKS]
    dash = rf"(?m)(?:^|\n|:\s*)[ \t]*[—–]\s*([^\n—–]{{{LEAST_QUOTE},}}?)(?=\s*,\s*[—–]|\s*$)"
    found.append(F.regexp_extract_all(text, F.lit(dash), F.lit(1)))
    trimmed = F.transform(F.concat(*found), lambda q: F.regexp_replace(F.regexp_replace(q, r"\s+", " "), "^[ ,;:—–-]+|[ ,;:—–-]+$", ""))
    return F.array_distinct(F.filter(trimmed, lambda q: F.length(q) >= LEAST_QUOTE))


def significant(flat: str) -> list[str]:
    """Words of a normal form that have two characters, or are digits."""
    return [w for w in flat.split(" ") if len(w) >= 2 or w.isdecimal()]


@lru_cache(maxsize=1 << 16)
def _stems(word: str) -> frozenset[str]:
    if word.isdigit() or len(word) < LEAST_STEM:
        return frozenset({word})
    found = last = {word}
    for _ in range(STRIPS):
        last = {w[: -len(e)] for w in last for e in ENDINGS if w.endswith(e) and len(w) - len(e) >= LEAST_STEM}
        found = found | last
    return frozenset(found)


def support(statement: list[str], evidence: list[str]) -> str:
    """How evidence bears out a statement that it doesn't hold word for word."""
    said, known = set(statement), set(evidence)
    if said & CAUSALITY and not known & CAUSALITY:
        return "adds_causality"
    if known & NEGATION and not said & NEGATION:
        return "drops_negation"
    by_stem: dict[str, list[int]] = {}
    for n, form in enumerate(dict.fromkeys(evidence)):
        for stem in _stems(form):
            by_stem.setdefault(stem, []).append(n)
    forms = list(dict.fromkeys(evidence))
    mapped = []
    for word in statement:
        near = [by_stem[s][0] for s in _stems(word) if s in by_stem and not s.isdigit()]
        if word not in known and not near:
            return "unsupported"
        mapped.append(word if word in known else forms[min(near)])
    rest = iter(evidence)
    if mapped and all(any(e == m for e in rest) for m in mapped):
        return "ordered"
    shared = set(mapped) & known
    changed = mapped != [e for e in evidence if e in shared]
    return "role_order_changed" if len(shared) >= 2 and changed else "unsupported"


@F.pandas_udf(T.StringType())
def _supports(statement: pd.Series, evidence: pd.Series) -> pd.Series:
    return pd.Series([None if s is None else support(significant(s), significant(e)) for s, e in zip(statement, evidence)], dtype=object)


def factual_support(statement: Column | str, evidence: Column | str) -> Column:
    """Unsupported, exact, adds_causality, drops_negation, ordered or
    role_order_changed. Only exact and ordered support the statement; null or empty
    texts are unsupported. Words of one stem count as one. The order needs Python."""
    s, e = (F.coalesce(normalized(c), F.lit("")) for c in (statement, evidence))
    both = lambda x: F.when((x.s == "") | (x.e == ""), "unsupported").when(x.e.contains(x.s), "exact")
    read = bound(F.struct(s.alias("s"), e.alias("e")), lambda x: F.struct(both(x).alias("told"), x.s.alias("s"), x.e.alias("e")))
    open_ = read.told.isNull()
    return F.coalesce(read.told, _supports(F.when(open_, read.s), F.when(open_, read.e)))
