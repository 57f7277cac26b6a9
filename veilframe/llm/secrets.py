"""Secret scans with structural confirmation.

Base kinds are patterns: assignments to a secret's name, access keys, long hex
runs. On top of them base64 and hex candidates are decoded and parsed, and only
what has the structure of a secret is reported:

* ``key``: a private key in base64, possibly over several lines,
  indented or with escaped breaks. DER must nest
  exactly (every length fits, children fill their parent) and have the fields of
  an RSA, EC, plain or encrypted private key; OpenSSH's format must have its
  length-prefixed fields end where the blob ends.
* ``hexkey``: the same in hex.
* ``jwt``: a signed token whose header is a JSON object that names an algorithm,
  whose payload is a JSON object and whose signature fits.

Each text is scanned whole, once, in time linear in its length: a candidate is
parsed through its headers, and only the bytes of those are decoded. Defined results: a null text counts as empty and has no spans;
offsets are code points, ends exclusive; repeated rows are scanned alike; an
empty table gives an empty result; other columns are not read.
"""
from __future__ import annotations

import base64
import binascii
import bisect
import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veilframe.llm.common import documents, scan_texts, span_digests
from veilframe.llm.registry import query

KINDS = ["assign", "access", "hex", "key", "hexkey", "jwt"]
_NAMES = ["password", "passwd", "secret", "token"]
_EITHER = "|".join(["".join(f"[{c.upper()}{c}]" for c in n) for n in _NAMES] + ["[Aa][Pp][Ii]_?[Kk][Ee][Yy]"])
_ASSIGN = re.compile(rf"""(?:{_EITHER})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
#: A line break in a key, bare or escaped (a string of JSON), and the blanks it indents with.
_BREAK = r"(?:\r?\n|(?:\\+r)?\\+n)[\x20\t]*"
_B64_RUN = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{32,}}(?:{_BREAK}[A-Za-z0-9+/_-]+)*={{0,2}}")
_BETWEEN = re.compile(_BREAK + "|=+")
_ANCHOR = re.compile(r"M[A-P]|b3BlbnNzaC1r")
_HEX_RUN = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{64,}")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])(e[wy][A-Za-z0-9_-]{6,})\.(e[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
_SSH = b"openssh-key-v1\0"
#: A private key has at most nine fields and a few optional ones.
MOST_PARTS = 12


def _of_bytes(data: bytes) -> Callable[[int, int], bytes]:
    """Reads n bytes at a place."""
    return lambda at, n: data[at:at + n]


def _of_base64(chars: str, begin: int) -> Callable[[int, int], bytes]:
    """Reads n bytes at a place of what base64 from ``begin`` on stands for; decodes no more than that."""
    def read(at: int, n: int) -> bytes:
        part = chars[begin + at // 3 * 4:begin - (-(at + n) // 3) * 4]
        return (_decode(part[:len(part) - (len(part) % 4 == 1)]) or b"")[at % 3:at % 3 + n]
    return read


def _header(read: Callable, at: int) -> tuple[int, int, int] | None:
    """Tag, start and length of the DER value at a place."""
    head = read(at, 2)
    if len(head) < 2:
        return None
    tag, size = head
    at += 2
    if size & 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4:
            return None
        more = read(at, n)
        size, at = int.from_bytes(more, "big"), at + n
        if len(more) < n or size < 0x80:
            return None
    return tag, at, size


def _children(read: Callable, start: int, stop: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, stop) of the values that fill a range exactly; None if they don't or are more than a key has."""
    out = []
    while start < stop:
        head = _header(read, start)
        if head is None or head[1] + head[2] > stop or len(out) == MOST_PARTS:
            return None
        out.append((head[0], head[1], head[1] + head[2]))
        start = head[1] + head[2]
    return out


def private_der(read: Callable, have: int) -> int | None:
    """Length of the DER private key that bytes begin with; ``have`` is how many there are."""
    head = _header(read, 0)
    if head is None or head[0] != 0x30 or head[1] + head[2] > have:
        return None
    total = head[1] + head[2]
    parts = _children(read, head[1], total)
    if not parts or len(parts) < 2:
        return None
    tags, sizes = [p[0] for p in parts], [b - a for _, a, b in parts]

    def algorithm(part: tuple[int, int, int]) -> list[int]:
        inner = _children(read, part[1], part[2])
        return [t for t, _, _ in inner] if inner and inner[0][0] == 0x06 else []

    good = False
    if tags[0] == 0x02 and sizes[0] == 1 and (version := read(parts[0][1], 1)) in (b"\0", b"\1"):
        if len(tags) >= 9 and set(tags[1:9]) == {0x02}:
            good = all(sizes[1:9])  # RSA: modulus, exponents, primes, coefficients
        elif version == b"\1" and tags[1] == 0x04 and 16 <= sizes[1] <= 80:
            good = True  # EC: the scalar
        elif tags[1] == 0x30 and len(tags) >= 3 and tags[2] == 0x04:
            good = bool(algorithm(parts[1])) and sizes[2] >= 16  # plain, any algorithm
    elif tags == [0x30, 0x04]:
        good = algorithm(parts[0])[1:2] == [0x30] and sizes[1] >= 16  # encrypted
    return total if good else None


def private_ssh(read: Callable, have: int) -> int | None:
    """Length of the OpenSSH private key that bytes begin with."""
    at = len(_SSH)
    if read(0, at) != _SSH:
        return None

    def number(at: int) -> int | None:
        return int.from_bytes(read(at, 4), "big") if at + 4 <= have else None

    def field(at: int | None) -> int | None:
        size = None if at is None else number(at)
        return at + 4 + size if size is not None and at + 4 + size <= have else None

    for _ in range(3):  # cipher, derivation and its options
        at = field(at)
    keys = None if at is None else number(at)
    if keys is None or not 1 <= keys <= 16:
        return None
    at += 4
    for _ in range(keys + 1):  # public keys, then the private block
        at = field(at)
    return at if at is not None and at > len(_SSH) + 20 else None


def private_key(read: Callable, have: int) -> int | None:
    return private_der(read, have) or private_ssh(read, have)


def _decode(chars: str) -> bytes | None:
    try:
        return base64.b64decode(chars.translate({45: 43, 95: 47}) + "=" * (-len(chars) % 4))
    except (binascii.Error, ValueError):
        return None


def _keys(text: str) -> list[tuple[int, int]]:
    out = []
    for run in _B64_RUN.finditer(text):
        # The run's characters without its breaks, and where each of its lines begins in both.
        lines, begins, places, at, n = [], [], [], run.start(), 0
        for stop, after in [g.span() for g in _BETWEEN.finditer(text, *run.span())] + [(run.end(), run.end())]:
            lines.append(text[at:stop])
            begins.append(n)
            places.append(at)
            n, at = n + stop - at, after
        chars, done = "".join(lines), 0
        place = lambda i: places[(k := bisect.bisect_right(begins, i) - 1)] + i - begins[k]
        for anchor in _ANCHOR.finditer(chars):
            begin = anchor.start()
            if begin < done:
                continue
            size = private_key(_of_base64(chars, begin), (n - begin) * 3 // 4)
            if size:
                done = begin - (-size * 4 // 3)
                stop = place(done - 1) + 1
                while text[stop:stop + 1] == "=" and stop < run.end():
                    stop += 1
                out.append((place(begin), stop))
    return out


def _hex_keys(text: str) -> list[tuple[int, int]]:
    out = []
    for run in _HEX_RUN.finditer(text):
        at = run.start()
        data = bytes.fromhex(text[at:run.end() - (run.end() - at) % 2])
        size = private_key(_of_bytes(data), len(data))
        if size:
            out.append((at, at + 2 * size))
    return out


def signed_token(header: str, payload: str, signature: str) -> bool:
    """Whether three base64url parts are a signed token's."""
    parts = []
    for part in (header, payload):
        try:
            parts.append(json.loads(_decode(part) or b""))
        except (ValueError, RecursionError):
            return False
    if not all(isinstance(p, dict) for p in parts) or not isinstance(parts[0].get("alg"), str) or not parts[0]["alg"]:
        return False
    if parts[0]["alg"].lower() == "none":
        return signature == ""
    return len(_decode(signature) or b"") >= 16


def spans_of(text: str) -> list[tuple[str, int, int, bool]]:
    """All spans by start, then kind. A check for a letter that a kind cannot do without saves most searches."""
    found = []
    if ":" in text or "=" in text:
        found += [("assign", *m.span(), True) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span(), True) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", *m.span(), True) for m in _HEX.finditer(text)]
    found += [("key", *s, False) for s in _keys(text)]
    found += [("hexkey", *s, False) for s in _hex_keys(text)]
    if "." in text:
        found += [("jwt", *m.span(), False) for m in _JWT.finditer(text) if signed_token(*m.groups())]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and secret spans (kind, start, stop, base) of every row."""
    return scan_texts(docs, lambda: spans_of)


@query("op1_secret_scan")
def _secrets(spark: SparkSession, folder: str) -> DataFrame:
    return span_digests(scan(documents(spark, folder)), KINDS[:3])
