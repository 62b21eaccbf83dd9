"""Personal data by anchor expansion.

One Aho-Corasick automaton finds anchors (at-signs, schemes, identifier cues) in a
pass over the text; at each anchor a deterministic local parser grows the span to
both sides and checks it: e-mail addresses, web addresses that name a user, and account
numbers behind a cue. Numbers (network addresses, cards, telephones) have no
literal anchor but their first digit or plus sign and are grown from it by
patterns that never look at a character twice.

Null and empty texts have no spans. Repeated rows give repeated results. Spans of a kind
don't overlap; those of two kinds may, and are listed by kind, so there are no ties. Very long texts
are scanned whole, one at a time. An empty table gives no rows. Other columns pass
unchanged, whatever their names; one that has the name of the result is replaced."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ledgerspark.llm.common import with_text_struct

BASE = ("email", "ip", "card", "phone")
ADDED = ("address", "account")
RESULT = T.StructType(
    [T.StructField(f"n_{k}", T.LongType(), False) for k in BASE]
    + [T.StructField("base_sha256", T.StringType(), False), T.StructField("spans", T.StringType(), False)]
)

#: Words before an identifier; the identifier must be close behind.
CUES = ("account", "acct", "iban", "passport", "ssn", "konto", "compte", "cuenta")
SCHEMES = ("http://", "https://", "ftp://")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LABEL = re.compile(r"(?:[ ]?(?:number|no|nr|id)\b\.?)?[ ]?[:#=]?[ ]?")
_FIRST = re.compile(r"[A-Z]{0,2}[0-9][0-9A-Z]*+")
#: What may follow in an identifier: digits behind a space or hyphen, letters and digits
#: behind a hyphen, and the short groups of an IBAN.
_MORE = re.compile(r"[ -][0-9]++(?![0-9A-Za-z])|-(?=[A-Z]*[0-9])[0-9A-Z]++(?![0-9A-Za-z])")
_MORE_IBAN = re.compile(r"[ -](?=[A-Z]{0,3}[0-9])[0-9A-Z]{1,4}+(?![0-9A-Za-z])")
_LONGEST = 36
_IBAN_HEAD = re.compile(r"[A-Z]{2}[0-9]{2}")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}")
#: A web address holds no quotes, brackets, braces or blanks; stops behind it aren't its own.
_WEB = re.compile(r"[a-z]++://[^\s\"'<>`{}|\\^]++")
_STOPS, _CLOSING = ".,;:!?*", {")": "(", "]": "["}
_HOST = r"(?:[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+|\[[0-9A-Fa-f:.]++\])(?::[0-9]{1,5})?"
_USER_ADDRESS = re.compile(rf"[a-z]++://(?:[^\s/@:]++:[^\s/@]++@{_HOST}(?:[/?#]\S*)?|{_HOST}/(?:~|@|u/|user/|users/)[^/?#]\S*)")

#: The part of it that decides, so that what is no user's is left at once.
_USER_HEAD = re.compile(rf"[a-z]++://(?:[^\s/@:]++:[^\s/@]++@{_HOST}(?=[/?#]|[.,;:!?*)\]]*+\Z)|{_HOST}/(?:~|@|u/|user/|users/)[^/?#])")


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word in ("@", *CUES, *SCHEMES):
        for form in {word, word.upper(), word.capitalize()}:
            found.add_word(form, word)
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails_at(text: str, signs: list[int]) -> list[tuple[int, int]]:
    """Grows each at-sign to the left over what a local part may hold, not into the
    last address, and to the right over a domain with a dot."""
    out, last = [], 0
    for at in signs:
        if at < last:
            continue
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, last := m.end()))
    return out


def base_numbers(text: str) -> dict[str, list[tuple[int, int]]]:
    def card(m: re.Match) -> bool:
        d = m[0].replace(" ", "").replace("-", "")
        return 16 <= len(d) <= 19 and luhn(d)

    return {
        "ip": [m.span() for m in _IP.finditer(text) if all(int(p) <= 255 for p in m.groups() if len(p) < 99) and max(map(len, m.groups())) < 99],
        "card": [m.span() for m in _CARD.finditer(text) if len(m[0]) >= 16 and card(m)],
        "phone": [m.span() for m in _PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15] if "+" in text else [],
    }


def sound_account(cue: str, found: str) -> bool:
    """Whether an identifier passes what its kind is checked by: two letters and two
    digits before eleven or more begin an IBAN, which is 1 modulo 97; a social security
    number has nine digits, and areas, groups and serials that are given out; any other
    has six digits or more."""
    plain = found.replace(" ", "").replace("-", "")
    digits = sum("0" <= c <= "9" for c in plain)
    if _IBAN.fullmatch(plain):
        return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
    if cue == "ssn":
        return digits == len(plain) == 9 and plain[:3] not in ("000", "666") and plain[0] != "9" and plain[3:5] != "00" and plain[5:] != "0000"
    return digits >= 6


def addresses_at(text: str, starts: list[int]) -> list[tuple[int, int]]:
    """The web addresses from schemes that name a user: grown over what an address may
    hold, cut before stops and closing brackets that it didn't open, then validated. An
    address inside another one is part of it."""
    out, last, grown = [], 0, 0
    for start in starts:
        if start < last:
            continue
        if start >= grown:
            grown = m.end() if (m := _WEB.match(text, start)) else start
        if not _USER_HEAD.match(text, start, grown):
            continue
        end, held = grown, Counter(text[start:grown])
        while end > start and (text[end - 1] in _STOPS or (text[end - 1] in _CLOSING and held[text[end - 1]] > held[_CLOSING[text[end - 1]]])):
            held[text[end - 1]] -= 1
            end -= 1
        if _USER_ADDRESS.fullmatch(text, start, end):
            out.append((start, last := end))
    return out


def identifier_at(text: str, at: int) -> tuple[int, int] | None:
    """The identifier behind a cue that ends at ``at``: one group of digits and capitals, and
    further groups as long as they can't be words of the sentence."""
    start = _LABEL.match(text, at).end()
    m = _FIRST.match(text, start)
    if not m or text[m.end() : m.end() + 1].isalpha():
        return None
    more, end = _MORE_IBAN if _IBAN_HEAD.match(m[0]) else _MORE, m.end()
    while (m := more.match(text, end)) and m.end() - start <= _LONGEST:
        end = m.end()
    return start, end


def accounts_at(text: str, cues: list[tuple[int, str]]) -> list[tuple[int, int]]:
    """Identifiers close behind a cue that is a word of its own, if they pass their check."""
    out = []
    for end, cue in cues:
        start = end - len(cue)
        if start and text[start - 1].isalnum():
            continue
        if (span := identifier_at(text, end)) and sound_account(cue, text[span[0] : span[1]]):
            out.append(span)
    return out


def scanner() -> Callable[[str | None], dict[str, list[tuple[int, int]]]]:
    """The function that finds all spans of a text by kind."""
    automaton, schemes = _automaton(), set(SCHEMES)

    def scan(text: str | None) -> dict[str, list[tuple[int, int]]]:
        text = text or ""
        signs, cues, starts = [], [], []
        for end, word in automaton.iter(text):
            if word == "@":
                signs.append(end)
            elif word in schemes:
                starts.append(end + 1 - len(word))
            else:
                cues.append((end + 1, word))
        spans = {"email": emails_at(text, signs), **base_numbers(text)}
        spans["address"] = addresses_at(text, starts)
        spans["account"] = sorted(set(accounts_at(text, cues)))
        return spans

    return scan


def listed(spans: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in spans[k])


def find_pii(docs: DataFrame, text_col: str = "text", out: str = "pii") -> DataFrame:
    """docs with a struct column of counts and spans (code points, end exclusive)."""

    def make():
        scan = scanner()

        def one(text: str | None) -> tuple:
            spans = scan(text)
            base = listed(spans, BASE)
            return *(len(spans[k]) for k in BASE), hashlib.sha256(base.encode()).hexdigest(), listed(spans, BASE + ADDED)

        return one

    return with_text_struct(docs, text_col, out, RESULT, make)
