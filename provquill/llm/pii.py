"""Personal data by anchor expansion.

One Aho-Corasick pass over a whole text finds anchors: at-signs, plus-signs before digits, neighbouring digits
and dotted digits, schemes and identifier cues.  A parser per kind of anchor expands it to the left and right
and validates the result (part ranges, digit counts, check digits).  Anchors inside what the same parser has
already read are passed over, so a text costs one pass however dense its anchors are.

Base kinds: email, ip, card, phone.  The method adds ``account`` (an IBAN whose remainder is 1 after the cue
IBAN, a social security number after its cue, an account number after its cue) and ``address`` (a web address
that carries a user's name).  Added spans never touch base spans.

Defined results: null and empty texts have no spans; ties start in the order of the kinds; repeated rows are
scanned each; an empty table gives an empty one; columns beside doc_id and text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .spans import Span, Taken, count_of, find_spans, joined

KINDS = ("email", "ip", "card", "phone", "account", "address")

# Character classes and bounds of the base kinds.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IP_MOST, CARD_DIGITS, PHONE_DIGITS = 255, (14, 19), (10, 15)

CUES = ("iban", "account", "acct", "ssn", "social security")
SCHEMES = ("http://", "https://", "ftp://", "sftp://")
_DIGITS = "0123456789"


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def iban_ok(text: str) -> bool:
    packed = text.replace(" ", "")
    return 15 <= len(packed) <= 34 and int("".join(str(int(c, 36)) for c in packed[4:] + packed[:4])) % 97 == 1


def automaton() -> object:
    """Anchors, each with the parser it calls for and its length."""
    import ahocorasick

    found = ahocorasick.Automaton()
    add = lambda word, kind: found.add_word(word, (kind, len(word)))
    add("@", "email")
    for a in _DIGITS:
        add(f"+{a}", "phone")
        for b in _DIGITS:
            add(f"{a}.{b}", "ip")
            for gap in ("", " ", "-"):
                add(f"{a}{gap}{b}", "card")
    for cue in CUES:
        for word in {cue, cue.upper(), cue.title()}:
            add(word, "cue")
    for scheme in SCHEMES:
        add(scheme, "scheme")
    found.make_automaton()
    return found


def make_finder() -> Callable[[str], list[Span]]:
    anchors = automaton()
    domain, ip, card, phone = (re.compile(p) for p in (DOMAIN, IP, CARD, PHONE))
    iban = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
    ssn = re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9])")
    number = re.compile(r"[0-9]{6,17}(?![0-9A-Za-z])")
    link = re.compile(r"(?:(?P<user>[^\s/@:]+)(?::[^\s/@]*)?@)?[A-Za-z0-9.-]+(?::[0-9]+)?(?P<path>/[^\s\"'<>]*)?")
    after_cue = re.compile(r"(?i:\x20*(?:number|no\.?|id)?\x20*[:#=]?\x20*)")
    personal = re.compile(r"/(?:~|u/|user/|users/|profile/)[A-Za-z0-9._-]+")

    def find(text: str) -> list[Span]:
        out: list[Span] = []
        wide: list[Span] = []
        read = {"email": 0, "ip": 0, "card": 0, "phone": 0}
        for last, (kind, size) in anchors.iter(text):
            at = last - size + 1
            if kind == "email":
                start = at
                while start > read["email"] and text[start - 1] in LOCAL:
                    start -= 1
                if start < at and (m := domain.match(text, at + 1)):
                    out.append(("email", start, m.end()))
                    read["email"] = m.end()
            elif kind == "ip":
                if at >= read["ip"]:
                    start = at
                    while start > read["ip"] and text[start - 1] in _DIGITS:
                        start -= 1
                    if m := ip.match(text, start):
                        if all(len(p) <= 3 and int(p or 0) <= IP_MOST for p in (x.lstrip("0") for x in m.group().split("."))):
                            out.append(("ip", start, m.end()))
                        read["ip"] = m.end()
            elif kind == "card":
                if at >= read["card"]:
                    m = card.match(text, at)
                    read["card"] = m.end()
                    digits = m.group().replace(" ", "").replace("-", "")
                    if CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and luhn(digits):
                        out.append(("card", at, m.end()))
            elif kind == "phone":
                if at >= read["phone"] and (m := phone.match(text, at)):
                    read["phone"] = m.end()
                    if PHONE_DIGITS[0] <= sum(c in _DIGITS for c in m.group()) <= PHONE_DIGITS[1]:
                        out.append(("phone", at, m.end()))
            elif kind == "cue":
                if (at and (text[at - 1].isalnum())) or (last + 1 < len(text) and text[last + 1].isalpha()):
                    continue
                begin = after_cue.match(text, last + 1).end()
                cue = text[at : last + 1].lower()
                m = iban.match(text, begin) if cue == "iban" else ssn.match(text, begin) if cue in ("ssn", "social security") else number.match(text, begin)
                if m and (cue != "iban" or iban_ok(m.group())):
                    wide.append(("account", m.start(), m.end()))
            else:
                m = link.match(text, last + 1)
                if m and (m["user"] or personal.search(m["path"] or "")):
                    wide.append(("address", at, m.end()))
        base = Taken(out)
        return out + [s for s in wide if base.clear(s[1], s[2])]

    return find


def find_personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) of every whole text."""
    return find_spans(docs, make_finder)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = joined("spans", KINDS[:4])
    return find_personal_data(table(spark, sf_dir, "documents")).select("doc_id", *[count_of("spans", k).alias(f"n_{k}") for k in KINDS[:4]], F.sha2(base, 256).alias("base_sha256"), joined("spans", KINDS).alias("spans"))
