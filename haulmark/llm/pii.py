"""Personal data in texts: patterns propose spans, checksums confirm them, words nearby raise or lower their score.

Four *base* kinds are reported wherever their pattern and test hold, whatever stands around them. *Added* spans
(account numbers, national numbers, IPv6 addresses, spelled-out mail addresses, cards and phones that the base patterns miss)
are proposed by looser patterns; each has a prior, a checksum or range test confirms or drops it, and words within
``NEAR`` code points before or after it move its score. Those that reach ``ACCEPT`` are reported, unless they overlap a base span
or a better one.

Every scan is linear in the text: a run of characters is entered at its start only, and repeats are possessive.
"""

from __future__ import annotations

import bisect
import ipaddress
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from haulmark.llm.common import pieces

BASE = ("email", "ip", "card", "phone")
#: Code points before and after a proposed span in which words count, and the score a span needs.
NEAR, ACCEPT = 48, 0.6

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_DIGITS = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]*+")
_NUMBER = re.compile("[0-9]+")

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    """The check digit of cards: every second digit from the right doubled, the sum a multiple of ten."""
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def mod97(text: str) -> bool:
    """The check of account numbers: the first four characters last, letters as 10 to 35, remainder 1."""
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[Span]:
    """A run of local characters, ``@``, and labels joined by dots; found from each ``@``, so that long runs cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        local = text[done:at]
        length = len(local) - len(local.rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if length else None
        if domain:
            yield at - length, domain.end()
        done = domain.end() if domain else at + 1
        at = text.find("@", done)


def ips(text: str) -> Iterator[Span]:
    """Of numbers joined by dots, four after four."""
    for m in _DOTTED.finditer(text):
        parts = [n.span() for n in _NUMBER.finditer(text, *m.span())] if m.group().count(".") > 2 else []
        for k in range(0, len(parts) - 3, 4):
            numbers = [text[s:e].lstrip("0") or "0" for s, e in parts[k:k + 4]]
            if all(len(n) <= 3 and int(n) <= 255 for n in numbers):
                yield parts[k][0], parts[k + 3][1]


def is_card(run: str) -> bool:
    digits = digits_of(run) if len(run) < 40 else ""
    return 13 <= len(digits) <= 19 and luhn(digits)


def cards(text: str) -> Iterator[Span]:
    return (m.span() for m in _DIGITS.finditer(text) if is_card(m.group()))


def phones(text: str) -> Iterator[Span]:
    for m in _PHONE.finditer(text):
        run = m.group().rstrip(" ().-")
        if len(run) > 3 and 9 <= len(digits_of(run)) <= 15:
            yield m.start(), m.start() + len(run)


FINDERS: dict[str, Callable[[str], Iterator[Span]]] = {"email": emails, "ip": ips, "card": cards, "phone": phones}

# Length of an account number (IBAN) by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28,
    "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18,
    "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32,
    "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15,
    "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25,
    "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}


def iban_end(text: str, start: int) -> int | None:
    """End of the account number that begins at ``start``, if its country's length and the remainder of 97 say so."""
    length = IBAN_LENGTHS[text[start:start + 2].upper()]
    found, at = [], start
    while at < len(text) and len(found) < length:
        c = text[at]
        if c.isascii() and c.isalnum():
            found.append(c)
        elif c not in " -" or text[at - 1] in " -":
            return None
        at += 1
    if len(found) < length or (at < len(text) and text[at].isascii() and text[at].isalnum()):
        return None
    return at if mod97("".join(found).upper()) else None


def nir_ok(digits: str) -> bool:
    """A French national number: sex, month and a key that completes the number to a multiple of 97."""
    month = int(digits[3:5])
    return digits[0] in "12" and (1 <= month <= 12 or 20 <= month <= 42) and 97 - int(digits[:13]) % 97 == int(digits[13:])


def dni_ok(text: str) -> bool:
    """A Spanish identity number: its letter follows from the remainder of 23."""
    return "TRWAGMYFPDXBNJZSQVHLCKE"[int(text[:8]) % 23] == text[-1].upper()


def ssn_ok(text: str) -> bool:
    """A United States social security number: areas 000, 666 and from 900 on, group 00 and serial 0000 are never given out."""
    area, group, serial = text.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def ipv6_ok(text: str) -> bool:
    try:
        ipaddress.IPv6Address(text)
    except ValueError:
        return False
    return sum(bool(g) for g in text.split(":")) >= 3


Proposer = Callable[[str, list[Span]], Iterator[Span]]


def around_digits(text: str, margin: int = 64) -> list[Span]:
    """Parts of the text that hold digits, with what stands near them; prose without any is passed over at once."""
    found: list[list[int]] = []
    for m in _NUMBER.finditer(text):
        if found and m.start() - margin <= found[-1][1]:
            found[-1][1] = m.end() + margin
        else:
            found.append([max(0, m.start() - margin), m.end() + margin])
    return [(s, e) for s, e in found]


def checked(pattern: str, check: Callable[[str], bool]) -> Proposer:
    """Matches of a pattern of bounded length that holds a digit, if they pass a check."""
    compiled = re.compile(pattern)

    def propose(text: str, places: list[Span]) -> Iterator[Span]:
        for place in places:
            yield from (m.span() for m in compiled.finditer(text, *place) if check(m.group()))

    return propose


_ACCOUNT = re.compile(r"(?<![A-Za-z0-9])[A-Za-z]{2}[0-9]{2}(?=[ -]?[A-Za-z0-9])")


def accounts(text: str, places: list[Span]) -> Iterator[Span]:
    """International account numbers."""
    for place in places:
        for m in _ACCOUNT.finditer(text, *place):
            end = iban_end(text, m.start()) if m.group()[:2].upper() in IBAN_LENGTHS else None
            if end:
                yield m.start(), end


_SPELLED_AT = re.compile(r"[\[({]at[\])}] ?", re.IGNORECASE)
_SPELLED_DOMAIN = re.compile(r"[A-Za-z0-9-]{1,63}+(?: ?(?:[\[({]dot[\])}]|\.) ?[A-Za-z0-9-]{1,63}+){1,4}", re.IGNORECASE)


def spelled_emails(text: str, places: list[Span]) -> Iterator[Span]:
    """Mail addresses whose ``@`` is spelled (at), [at] or {at}, and perhaps their dots."""
    done = 0
    for m in _SPELLED_AT.finditer(text):
        end = m.start() - (m.start() > done and text[m.start() - 1] == " ")
        local = text[max(done, end - 65):end]
        length = len(local) - len(local.rstrip(_LOCAL))
        domain = _SPELLED_DOMAIN.match(text, m.end())
        if domain and 1 <= length <= 64:
            done = domain.end()
            yield end - length, done


def cards_in_runs(text: str, places: list[Span]) -> Iterator[Span]:
    """Cards inside digit runs that as a whole are none: one written next to other numbers, or in four groups of four."""
    for m in _DIGITS.finditer(text):
        if len(m.group()) < 15 or is_card(m.group()):
            continue
        groups = [g.span() for g in _NUMBER.finditer(text, *m.span())]
        at = 0
        while at < len(groups):
            width = 4 if groups[at][1] - groups[at][0] == 4 else 1
            own = groups[at:at + width]
            sizes = [e - s for s, e in own]
            if (sizes == [4] * 4 or width == 1 and 13 <= sizes[0] <= 19) and luhn(digits_of(text[own[0][0]:own[-1][1]])):
                yield own[0][0], own[-1][1]
                at += width
            else:
                at += 1


def issued(text: str) -> bool:
    """Lengths and first digits that issuers of cards use."""
    digits = digits_of(text)
    first, size = int(digits[:4]), len(digits)
    return (first // 1000 == 4 and size in (13, 16, 19) or (5100 <= first < 5600 or 2221 <= first < 2721) and size == 16
            or first // 100 in (34, 37) and size == 15 or (first == 6011 or first // 100 == 65 or 6440 <= first < 6500) and size == 16)


@dataclass(frozen=True)
class Rule:
    """An added kind: spans that passed their check, the score they have then, and the words that raise it."""

    kind: str
    propose: Proposer
    prior: Callable[[str], float]
    words: re.Pattern


def _near(words: str) -> re.Pattern:
    return re.compile(rf"(?<![^\W_])(?:{words})(?![^\W_])", re.IGNORECASE)


#: Words near a span that make it likelier in any kind, and those that speak for another sort of number.
OWNER_WORDS = _near("contact|kontakt|contacto|name|nombre|nom|customer|kunde|client|cliente|personal|private|privat")
OTHER_WORDS = _near("order|invoice|version|build|isbn|issn|doi|serial|sku|part|ticket|tracking|bestellung|rechnung|facture|factura|pedido|commande|artikel")
WORDS_SHARE, OWNER_SHARE, OTHER_SHARE = 0.3, 0.1, -0.25

PHONE_WORDS = _near("phone|tel|telephone|mobile|cell|call|fax|whatsapp|telefon|handy|mobil|rufnummer|anruf|t[ée]l[ée]phone|portable|appele[zr]|tel[ée]fono|m[óo]vil|llam[ae]r?")
CARD_WORDS = _near("card|credit|debit|visa|mastercard|amex|kreditkarte|karte|carte|tarjeta|payment|zahlung|paiement|pago|cvv|cvc")
MAIL_WORDS = _near("mail|email|e-mail|correo|courriel|write|contact")
NET_WORDS = _near("ip|ipv6|address|host|server|client|adresse|direcci[óo]n")

#: Scores of the base kinds before words count; they are reported whatever their score.
BASE_PRIOR = {"email": (0.9, MAIL_WORDS), "ip": (0.5, NET_WORDS), "card": (0.7, CARD_WORDS), "phone": (0.6, PHONE_WORDS)}

#: Added kinds; of equal scores the earlier kind wins.
RULES = (
    Rule("iban", accounts, lambda s: 0.85, _near("iban|account|konto|kontonummer|bank|bic|swift|compte|cuenta")),
    Rule("card", cards_in_runs, lambda s: 0.65 if issued(s) else 0.35, CARD_WORDS),
    Rule("email", spelled_emails, lambda s: 0.7, MAIL_WORDS),
    Rule("nir", checked(r"(?<![0-9])[12](?: ?[0-9]{2}){3}(?: ?[0-9]{3}){2} ?[0-9]{2}(?![0-9])", lambda s: nir_ok(digits_of(s))), lambda s: 0.6,
         _near("nir|insee|s[ée]curit[ée]|sociale|assur[ée]")),
    Rule("dni", checked(r"(?<![A-Za-z0-9])[0-9]{8}-?[A-Za-z](?![A-Za-z0-9])", dni_ok), lambda s: 0.35, _near("dni|nif|identidad|documento")),
    Rule("ssn", checked(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", ssn_ok), lambda s: 0.4, _near("ssn|social|security|taxpayer|itin")),
    Rule("ipv6", checked(r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{1,4}:(?:[0-9A-Fa-f]{0,4}:){1,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:.])", ipv6_ok), lambda s: 0.6, NET_WORDS),
    Rule("phone", checked(r"(?<![0-9A-Za-z+.-])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9A-Za-z]|[.-][0-9])",
                          lambda s: 9 <= len(digits_of(s)) <= 12), lambda s: 0.35, PHONE_WORDS),
)
KINDS = list(dict.fromkeys([*BASE, *[rule.kind for rule in RULES]]))


@dataclass(frozen=True)
class Found:
    kind: str
    start: int
    end: int
    score: float
    base: bool


def score(text: str, start: int, end: int, prior: float, words: re.Pattern) -> float:
    """The prior and what the words nearby add to it or take off, from 0 to 1."""
    near = text[max(0, start - NEAR):start] + "\n" + text[end:end + NEAR]
    total = prior + WORDS_SHARE * bool(words.search(near)) + OWNER_SHARE * bool(OWNER_WORDS.search(near)) + OTHER_SHARE * bool(OTHER_WORDS.search(near))
    return round(min(1.0, max(0.0, total)), 3)


def find(text: str) -> list[Found]:
    """All spans of a text by kind and start."""
    base = [Found(kind, s, e, score(text, s, e, *BASE_PRIOR[kind]), True) for kind in BASE for s, e in FINDERS[kind](text)]
    places = around_digits(text)
    proposed = [Found(rule.kind, s, e, score(text, s, e, rule.prior(text[s:e]), rule.words), False)
                for rule in RULES for s, e in rule.propose(text, places)]
    return sorted(base + apart(base, [x for x in proposed if x.score >= ACCEPT]), key=lambda x: (KINDS.index(x.kind), x.start))


def apart(base: list[Found], added: list[Found]) -> list[Found]:
    """Added spans, best first, that overlap neither a base span nor one taken before."""
    taken: list[Span] = []
    for s, e in sorted((x.start, x.end) for x in base):
        if taken and s <= taken[-1][1]:
            taken[-1] = (taken[-1][0], max(e, taken[-1][1]))
        else:
            taken.append((s, e))
    kept = []
    for x in sorted(added, key=lambda x: (-x.score, x.start)):
        at = bisect.bisect(taken, (x.start, x.end))
        if (at == 0 or taken[at - 1][1] <= x.start) and (at == len(taken) or taken[at][0] >= x.end):
            taken.insert(at, (x.start, x.end))
            kept.append(x)
    return kept


SPAN = StructType().add("kind", "string").add("start", "long").add("end", "long").add("score", "double").add("base", "boolean")
SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())]))


def personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``found``, the spans of personal data in ``text``: kind, start, end (code points, exclusive), score, base.

    Whole texts are read, also very long ones; null and empty texts have no spans. Any column may be null, rows may repeat
    and keep their own result, an empty table gives an empty one. A column named ``found`` is replaced; other columns pass
    through. Of two added spans that overlap the better one stays, of equal ones the earlier kind in ``RULES``.
    """
    rest = docs.drop("found") if "found" in docs.columns else docs
    names = rest.columns

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for run in pieces([part.append_column("__text", part.column(text)).rename_columns([*names, "text"])] if text != "text" else [part], 1 << 20):
                found = [[{"kind": x.kind, "start": x.start, "end": x.end, "score": x.score, "base": x.base} for x in find(t or "")]
                         for t in run.column("text").to_pylist()]
                columns = [run.column(i) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found, SPANS)], names=[*names, "found"])

    return rest.mapInArrow(scan, StructType([*rest.schema.fields, StructField("found", ArrayType(SPAN))]))


def digest_columns(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans and all spans as text."""
    written = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("found", lambda x: x["base"])

    def is_kind(kind: str):
        return lambda x: x["kind"] == kind

    return found.withColumns(
        {f"n_{kind}": F.size(F.filter(base, is_kind(kind))).cast("long") for kind in BASE}
        | {"base_sha256": F.sha2(written(base), 256), "spans": written(F.col("found")),
           "scores": F.transform("found", lambda x: x["score"])})
