"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust a score.

The base kinds (email, ip, card, phone) are settled by pattern and checksum
alone. The method adds two kinds: IBANs, proposed by country and its length and
confirmed by mod 97, and secrets, long strings of mixed characters. Context
words within ``REACH`` characters raise or lower the score of every span; of the
added kinds only spans that reach ``KEEP`` stay.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

REACH = 40

# The patterns of the base kinds. Possessive repeats and the look
# behind change no match; they keep long runs of digits from being tried anew at
# every digit. The local part of an address is found from its "@" backwards.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]++")
_IBAN = re.compile(r"(?<![A-Za-z0-9])([A-Z]{2})[0-9]{2}(?=\x20?[A-Z0-9])")
_SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,200}+(?![A-Za-z0-9+/_-])")
# Characters of an IBAN by country.
IBAN_LENGTHS = dict(
    AD=24, AE=23, AL=28, AT=20, AZ=28, BA=20, BE=16, BG=22, BH=22, BR=29, BY=28, CH=21, CR=22, CY=28, CZ=24, DE=22, DK=18, DO=28, EE=20, EG=29, ES=24, FI=18, FO=18,
    FR=27, GB=22, GE=22, GI=23, GL=18, GR=27, GT=28, HR=21, HU=28, IE=22, IL=23, IQ=23, IS=26, IT=27, JO=30, KW=30, KZ=20, LB=28, LC=32, LI=21, LT=20, LU=20, LV=21,
    LY=25, MC=27, MD=24, ME=22, MK=19, MR=27, MT=31, MU=30, NL=18, NO=15, PK=24, PL=28, PS=29, PT=25, QA=29, RO=24, RS=22, SA=24, SC=31, SE=24, SI=19, SK=24, SM=27,
    ST=25, SV=28, TL=23, TN=24, TR=26, UA=29, VA=22, VG=24, XK=20,
)
_DIGIT = re.compile("[0-9]")

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "secret")

#: Score of a span before its context is looked at.
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.7, "secret": 0.5}
#: Score that an added span needs.
KEEP = 0.6
RAISE = re.compile(r"\b(?:mail|e-mail|email|contact|write|phone|tel|telephone|call|mobile|fax|card|visa|mastercard|credit|payment|iban|bic|bank|account|konto|address|server|host|login)\b", re.I)
RAISE_SECRET = re.compile(r"(?:\b|_)(?:api|key|secret|token|password|passwd|pwd|credentials?|auth|bearer)(?:\b|_)", re.I)
LOWER = re.compile(r"\b(?:version|release|build|isbn|order|invoice|serial|example|sample|test|dummy)\b", re.I)
STEP = 0.2


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = ord(digit) - 48
        if place % 2:
            value = value * 2 - 9 * (value > 4)
        total += value
    return total % 10 == 0


def mod97(text: str) -> bool:
    """ISO 7064 mod 97-10 over the IBAN's rearranged characters."""
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        found = _DOMAIN.match(text, at) if begin < at else None
        if found:
            yield begin, found.end()
            done = found.end()
        # characters before a failed "@" are passed over once, as no address can cross it
        at = text.find("@", max(at + 1, done))


def _phones(text: str):
    at = text.find("+")
    while at >= 0:
        found = _PHONE.match(text, at)
        after = at + 1
        if found:
            end = found.end()
            while end > at + 2 and text[end - 1] not in "0123456789":
                end -= 1
            # the sign, a digit, at least one more character and a last digit
            if end >= at + 4:
                if 8 <= len(_DIGIT.findall(text, at, end)) <= 15:
                    yield at, end
                after = end
        at = text.find("+", after)


def _cards(text: str):
    for found in _CARD.finditer(text):
        digits = found[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield found.span()


def _ips(text: str):
    for found in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in found[0].split(".")):
            yield found.span()


def _ibans(text: str):
    at = 0
    while found := _IBAN.search(text, at):
        at = found.start() + 2
        left, end = IBAN_LENGTHS.get(found[1], 0) - 4, found.end()
        while left > 0 and end < len(text):
            # single spaces may stand between its characters
            step = 1 + (text[end] == " ")
            if not (text[end + step - 1 : end + step].isascii() and text[end + step - 1 : end + step].isalnum()):
                break
            end, left = end + step, left - 1
        after = text[end : end + 1]
        if left == 0 and not (after.isascii() and after.isalnum()) and mod97(text[found.start() : end].replace(" ", "").upper()):
            yield found.start(), end
            at = end


def _secrets(text: str):
    for found in _SECRET.finditer(text):
        letters = sum(map(str.isalpha, found[0]))
        if 5 <= letters <= len(found[0]) - 5 and len(set(found[0])) >= 10:
            yield found.span()


def find_spans(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind as listed in ``KINDS``, then start."""
    if not text:
        return []
    digits = _DIGIT.search(text) is not None
    found = [("email", *s) for s in _emails(text)]
    if digits:
        found += [("ip", *s) for s in _ips(text)]
        found += [("card", *s) for s in _cards(text)]
        found += [("phone", *s) for s in _phones(text)]
        found += [("iban", *s) for s in _ibans(text)]
        found += [("secret", *s) for s in _secrets(text)]
    scored = [(kind, a, b, context_score(text, kind, a, b)) for kind, a, b in found]
    return [s for s in scored if s[0] in BASE_KINDS or s[3] >= KEEP]


def context_score(text: str, kind: str, start: int, end: int) -> float:
    around = text[max(0, start - REACH) : start] + " " + text[end : end + REACH]
    raised = (RAISE_SECRET if kind == "secret" else RAISE).search(around)
    score = PRIOR[kind] + STEP * bool(raised) - STEP * bool(LOWER.search(around))
    return round(min(1.0, max(0.0, score)), 2)


COLUMNS = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_iban long, n_secret long, scores string"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: counts of each kind, all spans, their scores.

    Offsets count code points, the end is exclusive. A null or empty text has no
    spans; equal texts have equal results, repeated rows repeat them; a very
    long text is searched whole; other columns are not read.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(9)]
            for text in batch.column(1):
                spans = find_spans(text.as_py() or "")
                n = dict.fromkeys(KINDS, 0)
                named = []
                for kind, a, b, _ in spans:
                    n[kind] += 1
                    named.append(f"{kind}:{a}:{b}")
                base = ",".join(named[: sum(n[k] for k in BASE_KINDS)])
                row = (n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(base.encode()).hexdigest(), ",".join(named), n["iban"], n["secret"], ",".join(f"{s[3]:g}" for s in spans))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64(), pa.int64(), pa.string()]
            names = [c.split()[0] for c in COLUMNS.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, COLUMNS)
