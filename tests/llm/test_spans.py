"""Secret and personal spans against plain patterns, and added kinds on built cases."""
import base64
import hashlib
import json
import random
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from veilframe.llm import personal, secrets
from veilframe.llm.common import span_digests

SCHEMA = "doc_id bigint, text string, spans string, kind string"


def plain_secrets(text):
    out = []
    pattern = r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for m in re.finditer(pattern, text, re.I | re.A):
        if len(m.group(1)) >= 6:
            out.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    out += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    out += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return [s for _, _, s in sorted(out)]


def plain_personal(text):
    out = [f"email:{m.start()}:{m.end()}" for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [f"ip:{m.start()}:{m.end()}" for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        if 13 <= len(digits) <= 19 and sum(d // 10 + d % 10 for d in doubled) % 10 == 0:
            out.append(f"card:{m.start()}:{m.end()}")
    out += [f"phone:{m.start()}:{m.end()}" for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
            if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return out


def lines(spans, base=True):
    return [f"{k}:{a}:{b}" for k, a, b, own in spans if own or not base]


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="aT1255.@- +()%éx\n", max_size=60))
def test_personal_like_patterns(text):
    assert lines(personal.finder()(text)) == plain_personal(text)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["token", "PassWord", "api_key", "APIKEY", "secret", "passwd", "'", '"', " ", ":", "=", "abc12", "deadbeef" * 3, "f",
                                 "AKIA", "ABCDEFGH1234567890", "é", "\n", "."]), max_size=12).map("".join))
def test_secrets_like_patterns(text):
    assert lines(secrets.spans_of(text)) == plain_secrets(text)


def test_whole_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = dict(docs.select("doc_id", "text").collect())
    for scan, plain, kinds in ((secrets.scan, plain_secrets, secrets.KINDS[:3]), (personal.scan, plain_personal, personal.KINDS[:4])):
        rows = span_digests(scan(docs), kinds).collect()
        assert len(rows) == len(texts)
        for r in rows:
            want = plain(texts[r.doc_id] or "")
            assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
            assert [r[f"n_{k}"] for k in kinds] == [sum(w.startswith(k + ":") for w in want) for k in kinds]
            assert set(want) <= set(r.spans.split(",")) | {""}


def tlv(tag, *parts):
    body = b"".join(parts)
    size = len(body)
    head = bytes([size]) if size < 128 else bytes([0x80 + (n := (size.bit_length() + 7) // 8)]) + size.to_bytes(n, "big")
    return bytes([tag]) + head + body


def keys():
    rng = random.Random(1)
    number = lambda n: tlv(2, b"\x01" + rng.randbytes(n))
    rsa = tlv(0x30, tlv(2, b"\0"), *[number(n) for n in (128, 3, 128, 64, 64, 64, 64, 64)])
    algorithm = tlv(0x30, tlv(6, b"\x2a\x86\x48"), tlv(5))
    ec = tlv(0x30, tlv(2, b"\1"), tlv(4, rng.randbytes(32)), tlv(0xA0, tlv(6, b"\x2b\x81")))
    plain = tlv(0x30, tlv(2, b"\0"), algorithm, tlv(4, rsa))
    locked = tlv(0x30, tlv(0x30, tlv(6, b"\x2a\x86"), tlv(0x30, tlv(4, b"salt"))), tlv(4, rng.randbytes(64)))
    field = lambda b: len(b).to_bytes(4, "big") + b
    ssh = b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4, "big") + field(rng.randbytes(51)) + field(rng.randbytes(136))
    return {"rsa": rsa, "ec": ec, "plain": plain, "locked": locked, "ssh": ssh}


def test_confirmed_keys():
    for name, data in keys().items():
        b64 = base64.b64encode(data).decode()
        for blob in (b64, b64.replace("+", "-").replace("/", "_"), "\n".join(b64[i:i + 64] for i in range(0, len(b64), 64))):
            text = f"é before {blob} after words"
            added = [s for s in secrets.spans_of(text) if s[0] == "key"]
            assert added == [("key", 9, 9 + len(blob), False)], name
        text = "é " + data.hex().upper() + "!"
        assert [s for s in secrets.spans_of(text) if s[0] == "hexkey"] == [("hexkey", 2, 2 + 2 * len(data), False)], name
        # A wrong length anywhere, a cut or noise is not confirmed.
        if name == "plain":
            continue  # the key inside it is a key by itself
        broken = bytearray(data)
        broken[3 if name != "ssh" else 18] ^= 0x41
        for bad in (bytes(broken), data[:-2], random.Random(2).randbytes(len(data)), b"0" + data):
            assert not [s for s in secrets.spans_of("x " + base64.b64encode(bad).decode().rstrip("=") + " y") if s[0] == "key" and bad != data], name


def test_keys_in_configuration_files():
    for name, data in keys().items():
        b64 = base64.b64encode(data).decode()
        lines = [b64[i:i + 64] for i in range(0, len(b64), 64)]
        for gap in ("\\n", "\\r\\n", "\\\\n", "\n    ", "\r\n\t"):
            text = f'é "-----BEGIN PRIVATE KEY-----{gap}{gap.join(lines)}{gap}-----END PRIVATE KEY-----{gap}"'
            start = text.index(lines[0])
            added = [s for s in secrets.spans_of(text) if s[0] == "key"]
            assert added == [("key", start, start + len(gap.join(lines)), False)], (name, gap)


def test_confirmed_tokens():
    part = lambda x: base64.urlsafe_b64encode(x if isinstance(x, bytes) else json.dumps(x).encode()).decode().rstrip("=")
    sign = part(b"s" * 32)
    good = f"{part({'alg': 'HS256', 'typ': 'JWT'})}.{part({'sub': 'a'})}.{sign}"
    assert [s[:3] for s in secrets.spans_of(f"see {good} now") if s[0] == "jwt"] == [("jwt", 4, 4 + len(good))]
    for bad in (f"{part({'typ': 'JWT'})}.{part({'sub': 'a'})}.{sign}", f"{part({'alg': 'HS256'})}.{part([1])}.{sign}",
                f"{part({'alg': 'HS256'})}.{part({'a': 1})}.abc", f"{part(b'{{broken')}.{part({'a': 1})}.{sign}"):
        assert not [s for s in secrets.spans_of(bad) if s[0] == "jwt"]


def test_added_personal():
    find = personal.finder()
    text = "IBAN: DE89 3704 0044 0532 0130 00, account number 12345678, SSN 123-45-6789, postgres://joe:s3cr@db.example.com/x"
    added = {k: text[a:b] for k, a, b, base in find(text) if not base}
    assert added == {"iban": "DE89 3704 0044 0532 0130 00", "account": "12345678", "ssn": "123-45-6789",
                     "url": "postgres://joe:s3cr@db.example.com/x"}
    assert not [s for s in find("IBAN DE88 3704 0044 0532 0130 00 SSN 000-12-3456 of account in http://example.com/a") if not s[3]]


def test_announced_in_any_case():
    find = personal.finder()
    for text, kind, value in (
            ("Social Security Number: 123-45-6789", "ssn", "123-45-6789"), ("é SSN Number: 123-45-6789", "ssn", "123-45-6789"),
            ("Account Number: 12345678", "account", "12345678"), ("İ Account No. 12345678", "account", "12345678"),
            ("ACCOUNT NR. 12345678", "account", "12345678"), ("Iban No: DE89370400440532013000", "iban", "DE89370400440532013000")):
        assert [(k, text[a:b]) for k, a, b, base in find(text) if not base] == [(kind, value)], text
    for user, password in (("u" * 65, "p"), ("u", "p" * 2000), ("u" * 300, "p" * 300)):
        url = f"https://{user}:{password}@db.example.com/x"
        assert [s[:3] for s in find(f"at {url} now") if s[0] == "url"] == [("url", 3, 3 + len(url))]


def test_defined_cases(spark):
    rows = [(1, None), (2, ""), (3, "1" * 100_000), (4, "@" * 50_000), (5, "a@b.c " * 20_000), (None, "x@y.zz"), (5, "a@b.c " * 20_000),
            (6, "1.2.3.4." * 5000), (7, "M" * 20_000), (8, "ab" * 30_000), (9, "+1" * 30_000), (10, "😀 x@y.zz token=abcdef")]
    docs = spark.createDataFrame([(i, t, "a", "b") for i, t in rows], SCHEMA)
    for scan, kinds in ((secrets.scan, secrets.KINDS[:3]), (personal.scan, personal.KINDS[:4])):
        got = span_digests(scan(docs), kinds).collect()
        assert len(got) == len(rows)
        empty = hashlib.sha256(b"").hexdigest()
        assert all(r.base_sha256 == empty and r.spans == "" for r in got if r.doc_id in (1, 2))
        assert span_digests(scan(docs.limit(0)), kinds).count() == 0
    by_id = {r.doc_id: r for r in span_digests(personal.scan(docs), personal.KINDS[:4]).collect()}
    assert by_id[5].n_email == 20_000 and by_id[None].n_email == 1 and by_id[6].n_ip == 5000
    assert by_id[10].spans == "email:2:8"


def test_base64_that_is_no_key():
    """Runs that break off inside a header, noise, nested payloads: no crash, nothing reported."""
    rng = random.Random(8)
    part = lambda b: base64.urlsafe_b64encode(b).decode().rstrip("=")
    texts = ["Zq" * 16 + "M" + c + d for c in "ABCDEFGH" for d in "AQgw"]
    texts.append(f"{part(b'{}')}.{part(b'[' * 100_000)}.{part(b's' * 32)}")
    texts.append(f"{part(json.dumps({'alg': 'HS256'}).encode())}.e{part(b'[' * 99_999)}.{part(b's' * 32)}")
    texts += [part(rng.randbytes(rng.randrange(24, 61))) for _ in range(30_000)]
    texts += ["Zq" * 15 + part(bytes([0x30, 0x82]) + rng.randbytes(rng.randrange(0, 40))) for _ in range(3000)]
    for text in texts:
        assert not [s for s in secrets.spans_of(text) if s[0] in ("key", "hexkey", "jwt")], text[:80]


def test_long_lines_take_linear_time():
    rng, key = random.Random(9), base64.b64encode(keys()["rsa"]).decode()
    for line in (base64.b64encode(rng.randbytes(6_000_000)).decode(), "MIIEowIBAAKCAQEA" * 200_000, "b3BlbnNzaC1rZXktdjEA" * 200_000):
        began = time.time()
        text = f"{line}{'A' * (-len(line) % 4)} {key}"
        assert [s[:2] for s in secrets.spans_of(text) if s[0] == "key"][-1] == ("key", len(text) - len(key))
        assert time.time() - began < 30
