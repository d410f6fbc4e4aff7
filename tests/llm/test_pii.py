"""Personal data: base spans against the plain patterns, added spans by example, long texts by the clock."""

import hashlib
import random
import re
import time

import pytest

from haulmark.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SCHEMA = "doc_id long, text string, found string, score double"


def plain_luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def plain(text):
    spans = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if (kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m.group().split("."))
                    or kind == "card" and 13 <= len(digits) <= 19 and plain_luhn(digits) or kind == "phone" and 9 <= len(digits) <= 15):
                spans.append((kind, m.start(), m.end()))
    return spans


def base_spans(text):
    return [(x.kind, x.start, x.end) for x in pii.find(text) if x.base]


def added(text):
    return [(x.kind, text[x.start:x.end]) for x in pii.find(text) if not x.base]


@pytest.mark.parametrize("letters", ["a1.@-+% é", "0123456789 -", "1.25+() -", "@a.b1 ", "+0123456789().- "])
def test_base_spans_are_those_of_the_plain_patterns(letters):
    dice = random.Random(letters)
    for _ in range(4_000):
        text = "".join(dice.choice(letters) for _ in range(dice.randrange(45)))
        assert base_spans(text) == plain(text), text


def test_base_spans_of_mixed_pieces():
    dice = random.Random(3)
    parts = ["4111 1111 1111 1111", "4465758382889437", "+1 (499) 555-6503", "8.196.197.208", "256.1.1.1", "0001.2.3.4", "a.b@c-d.co.uk", "é", " ", "-", ".", "@", "+", "x"]
    seen = 0
    for _ in range(4_000):
        text = "".join(dice.choice(parts) for _ in range(dice.randrange(8)))
        assert base_spans(text) == plain(text), text
        seen += bool(plain(text))
    assert seen > 1_000


def test_checksums():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB83WEST12345698765432")
    assert pii.nir_ok("255081416802538") and not pii.nir_ok("255081416802539")
    assert pii.dni_ok("12345678Z") and not pii.dni_ok("12345678A")
    assert pii.ssn_ok("078-05-1120") and not pii.ssn_ok("666-05-1120") and not pii.ssn_ok("900-05-1120")
    dice = random.Random(9)
    for _ in range(500):
        digits = "".join(dice.choice("0123456789") for _ in range(dice.randrange(13, 20)))
        assert pii.luhn(digits) == plain_luhn(digits)


def test_added_spans():
    assert added("pay GB82 WEST 1234 5698 7654 32 and more") == [("iban", "GB82 WEST 1234 5698 7654 32")]
    assert added("DE89370400440532013000.") == [("iban", "DE89370400440532013000")]
    assert added("DE89370400440532013001 DE8937040044053201300 XX89370400440532013000") == []
    assert added("x 4465758382889437 4465758382889437 y") == [("card", "4465758382889437")] * 2
    assert added("jane.doe (at) example [dot] org") == [("email", "jane.doe (at) example [dot] org")]
    assert added("1 84 12 76 451 089 46") == [("nir", "1 84 12 76 451 089 46")]
    assert added("2 55 08 14 168 025 38") == []  # passes as a card, which is a base kind
    assert added("fe80::1ff:fe23:4567:890a") == [("ipv6", "fe80::1ff:fe23:4567:890a")]
    assert added("at 12:30:45 in std::vector, 3:4 or a::b") == []


def test_words_nearby_decide():
    assert added("number 743-555-3824 here") == [] and added("phone 743-555-3824 here") == [("phone", "743-555-3824")]
    assert added("078-05-1120") == [] and added("SSN: 078-05-1120") == [("ssn", "078-05-1120")]
    assert added("12345678Z") == [] and added("DNI 12345678Z") == [("dni", "12345678Z")]
    assert added("order part 743-555-3824, phone") == []
    assert added("phone " + "x" * pii.NEAR + " 743-555-3824") == []
    card, = pii.find("credit card 4111 1111 1111 1111")
    other, = pii.find("serial 4111 1111 1111 1111")
    assert card.base and other.base and card.score > other.score


def test_added_spans_overlap_nothing():
    dice = random.Random(1)
    parts = ["GB82 WEST 1234 5698 7654 32", "4465758382889437", "phone", "743-555-3824", "+1 743-555-3824", "SSN", "078-05-1120", " ", "-", "12345678Z", "DNI", "2.3.4.5", "1234 "]
    for _ in range(3_000):
        spans = pii.find(" ".join(dice.choice(parts) for _ in range(dice.randrange(9))))
        for x in spans:
            assert x.base or all(y is x or y.end <= x.start or x.end <= y.start for y in spans), spans


@pytest.mark.parametrize("piece", ["a", "1", "1 ", "1.", "+1 (", "a@", "GB82 ", "(at) ", "ab:", "4111 ", "12-", "a" * 200 + "@b ", "078-05-1120 "])
def test_long_texts_take_linear_time(piece):
    text = piece * (400_000 // len(piece))
    started = time.process_time()
    pii.find(text)
    assert time.process_time() - started < 20


def test_rows(spark):
    texts = [None, "", "mail a@b.co", "mail a@b.co", "héllo +1 (499) 555-6503", "GB82 WEST 1234 5698 7654 32", "word " * 300_000 + "a@b.co"]
    docs = spark.createDataFrame([(None if i == 2 else i, t, "x", 1.0) for i, t in enumerate(texts)], SCHEMA)
    rows = {(r.doc_id, r.text): r for r in pii.digest_columns(pii.personal_data(docs)).collect()}
    assert len(rows) == len(texts) and rows[0, None].spans == "" and rows[1, ""].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert rows[None, "mail a@b.co"].spans == rows[3, "mail a@b.co"].spans == "email:5:11"
    assert rows[4, texts[4]].n_phone == 1 and rows[4, texts[4]].base_sha256 == hashlib.sha256(b"phone:6:23").hexdigest()
    assert rows[5, texts[5]].spans == "iban:0:27" and rows[5, texts[5]].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert rows[6, texts[6]].spans == "email:1500000:1500006" and rows[6, texts[6]].score == 1.0
    assert pii.digest_columns(pii.personal_data(docs.limit(0))).count() == 0
