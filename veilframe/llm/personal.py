"""Personal data by anchor expansion.

One pass of an Aho-Corasick automaton over the text finds anchors: at-signs,
scheme marks, plus-digit pairs, digits and words that announce identifiers. A
parser local to each anchor kind expands it to the left and right, decides the
boundaries and validates what it found. Text without anchors is never looked at
twice.

Base kinds: ``email``, ``ip``, ``card`` (13 to 19 digits that pass Luhn's test) and
``phone``. Added: ``url`` (user and password in an address), ``iban`` (check digits),
``account`` and ``ssn``, the last three only after their announcing word.

Defined results: a null text counts as empty and has no spans; offsets are code
points, ends exclusive; spans of one kind do not overlap; repeated rows are
scanned alike; an empty table gives an empty result; other columns are not read.
"""
from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veilframe.llm.common import documents, scan_texts, span_digests
from veilframe.llm.registry import query

KINDS = ["email", "ip", "card", "phone", "url", "iban", "account", "ssn"]
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_CUES = {"iban": "iban", "account": "account", "acct": "account", "konto": "account", "ssn": "ssn", "social security": "ssn"}
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOGIN = re.compile(r"://[^\s/?#@:\"'<>]++:[^\s/?#@\"'<>]++@[A-Za-z0-9.-]+(?::[0-9]+)?(?:[/?#][^\s\"'<>]*)?")
_AFTER = r"(?:\x20?(?i:number|no\.?|nr\.?))?[\x20:#=]{1,4}"
_IBAN = re.compile(_AFTER + r"([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
_ACCOUNT = re.compile(_AFTER + r"([0-9](?:-?[0-9]){7,16})(?![0-9-])")
_SSN = re.compile(_AFTER + r"([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def iban_valid(value: str) -> bool:
    value = value.replace(" ", "")
    return 15 <= len(value) <= 34 and int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def ssn_valid(value: str) -> bool:
    area, group, serial = value.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def automaton():
    """Anchor words to their kinds; announcing words are lower-cased."""
    import ahocorasick

    anchors = ahocorasick.Automaton()
    anchors.add_word("@", ("@", 1))
    anchors.add_word("://", ("url", 3))
    for d in "0123456789":
        anchors.add_word(d, ("digit", 1))
        anchors.add_word("+" + d, ("+", 2))
    for word, kind in _CUES.items():
        anchors.add_word(word, (kind, len(word)))
    anchors.make_automaton()
    return anchors


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def finder() -> Callable[[str], list[tuple]]:
    anchors = automaton()
    order = {k: i for i, k in enumerate(KINDS)}
    announced = {"iban": (_IBAN, iban_valid), "account": (_ACCOUNT, lambda v: True), "ssn": (_SSN, ssn_valid)}

    def spans_of(text: str) -> list[tuple[str, int, int, bool]]:
        found: list[tuple[str, int, int, bool]] = []
        done = dict.fromkeys(KINDS, 0)
        # Announcing words count in any case; lowering ASCII letters only keeps every offset.
        for last, (kind, size) in anchors.iter(text.encode().lower().decode()):
            at = last - size + 1
            if kind == "digit":
                if at >= done["ip"]:
                    chain = _DOTTED.match(text, at)
                    done["ip"] = chain.end()
                    parts = chain.group().split(".")
                    start = at
                    for k in range(0, len(parts) - 3, 4):
                        four = parts[k:k + 4]
                        size = sum(map(len, four)) + 3
                        if all(map(_octet, four)):
                            found.append(("ip", start, start + size, True))
                        start += size + 1
                if at >= done["card"]:
                    run = _DIGITS.match(text, at)
                    done["card"] = run.end() if run else at + 1
                    if run and 13 <= len(digits := run.group().replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
                        found.append(("card", *run.span(), True))
            elif kind == "@":
                start = at
                while start > done["email"] and text[start - 1] in _LOCAL:
                    start -= 1
                domain = _DOMAIN.match(text, at + 1) if start < at else None
                if domain:
                    done["email"] = domain.end()
                    found.append(("email", start, domain.end(), True))
            elif kind == "+":
                number = _PHONE.match(text, at) if at >= done["phone"] else None
                if number:
                    done["phone"] = number.end()
                    if 9 <= sum(map(str.isdigit, number.group())) <= 15:
                        found.append(("phone", *number.span(), True))
            elif kind == "url":
                login = _LOGIN.match(text, at) if at >= done["url"] else None
                start = at
                while login and start > done["url"] and at - start < 16 and text[start - 1] in _LOCAL:
                    start -= 1
                if login and start < at:
                    done["url"] = login.end()
                    found.append(("url", start, login.end(), False))
            else:
                pattern, valid = announced[kind]
                value = pattern.match(text, last + 1)
                if value and value.start(1) >= done[kind] and valid(value.group(1)):
                    done[kind] = value.end(1)
                    found.append((kind, *value.span(1), False))
        return sorted(found, key=lambda s: (order[s[0]], s[1]))

    return spans_of


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and personal spans (kind, start, stop, base) of every row."""
    return scan_texts(docs, finder)


@query("op4_personal_data")
def _personal(spark: SparkSession, folder: str) -> DataFrame:
    return span_digests(scan(documents(spark, folder)), KINDS[:4])
