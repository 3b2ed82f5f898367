"""Keys and tokens wherever they stand: glued, wrapped, misaligned; held against a search of every place."""

import base64
import json
import random

from chronopanel.llm import secrets


def der(tag, body):
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x81, n]) if n < 256 else b"\x82" + n.to_bytes(2)
    return bytes([tag]) + size + body


def block(data):
    return len(data).to_bytes(4) + data


draw = random.Random(8)
RSA = der(0x30, der(2, b"\0") + b"".join(der(2, bytes([1]) + draw.randbytes(59)) for _ in range(8)))
EC = der(0x30, der(2, b"\1") + der(4, draw.randbytes(32)) + der(0xA0, draw.randbytes(10)))
LONG_EC = der(0x30, der(2, b"\1") + der(4, draw.randbytes(66)) + der(0xA0, draw.randbytes(9)) + der(0xA1, draw.randbytes(70)))
EDWARDS = der(0x30, der(2, b"\0") + der(0x30, der(6, b"\x2b\x65\x70")) + der(4, der(4, draw.randbytes(32))))
SSH = secrets.OPENSSH + block(b"none") + block(b"none") + block(b"") + (1).to_bytes(4) + block(draw.randbytes(51)) + block(draw.randbytes(130))
KEYS = [RSA, EC, LONG_EC, EDWARDS, SSH]


def url(data):
    return base64.urlsafe_b64encode(data).decode().rstrip("=")


def token():
    return f"{url(json.dumps({'alg': 'HS256', 'k': draw.randint(0, 99)}).encode())}.{url(json.dumps({'sub': draw.randint(0, 9)}).encode())}.{url(draw.randbytes(9))}"


def wrapped(text, end):
    return end.join(text[i : i + 64] for i in range(0, len(text), 64))


def test_every_encoding_of_every_key_is_found_anywhere():
    for key in KEYS:
        b64 = base64.b64encode(key).decode()
        for form in (b64, b64.rstrip("="), url(key), key.hex(), key.hex().upper(), wrapped(b64, "\n"), wrapped(b64, "\\n"), wrapped(b64, "\r\n  "), wrapped(key.hex(), "\n")):
            for before in ("", " ", "path/", "https://host/a/b+", "\\n", "name-", "abc", "f", "é🙂", "key=", "a1"):
                for after in ("", " ", "\n", '"', "/x", "; more", "é"):
                    if after == "/x" and ("n" in form[64:68] and "\\" in form or "\n" in form):
                        continue  # a wrapped key must end with its line
                    text = before + form + after
                    assert secrets.confirmed_spans(text) == [(len(before), len(before) + len(form), "key")], (before, form, after)


def test_broken_keys_are_not_found():
    for key in KEYS:
        b64 = base64.b64encode(key).decode().rstrip("=")
        for text in (b64[:-3], b64[4:], key.hex()[:-2], key.hex()[2:], b64[:40] + " " + b64[40:], b64[:30] + "!" + b64[31:], base64.b64encode(key[:3] + b"\x05" + key[4:]).decode()):
            assert secrets.confirmed_spans(text) == []
        assert secrets.confirmed_spans(wrapped(b64[:-9], "\n") + "\nso it ends") == secrets.confirmed_spans(b64[:-9] + "\n" + "A" * 80) == []
    assert secrets.confirmed_spans("M" * 300 + "MCAQ" * 80 + "30" * 400) == []


def test_tokens_in_dotted_names():
    for before in ("", "service-account-prod.", "authorization-v1.bearer.", "aaaa.bbbbbbbbbbbbbbbbb.cc.", "name-", "user_", "Bearer ", "a.b.c.", "x" * 20 + ".", "é"):
        for after in ("", " ", "/", ".more", '"', "\n"):
            t = token()
            assert secrets.confirmed_spans(before + t + after) == [(len(before), len(before) + len(t), "jwt")], before
    assert secrets.confirmed_spans(".".join([url(b'{"alg": 3}'), url(b"{}"), "x"])) == secrets.confirmed_spans("eyJhbGciOiJIUzI1NiJ9.eyJz") == []


def test_texts_of_many_kinds_against_a_search_of_every_place():
    """Every place is tried with every length, which needs no idea of how an encoding begins."""

    def slow(text):
        found, at = [], 0
        while at < len(text):
            ends = [e for e in range(at + 60, len(text) + 1) if text[at:e].isascii() and (secrets.is_key(strict(text[at:e])) or (e - at) % 2 == 0 and secrets.is_key(hexed(text[at:e])))]
            if ends:
                end = ends[0]
                while text[end : end + 1] == "=":
                    end += 1
                found.append((at, end, "key"))
                at = end
            else:
                at += 1
        return found

    def strict(t):
        try:
            return base64.b64decode(t + "=" * (-len(t) % 4), validate=True) if "=" not in t else b""
        except ValueError:
            return b""

    def hexed(t):
        try:
            return bytes.fromhex(t) if t.isalnum() else b""
        except ValueError:
            return b""

    for _ in range(12):
        text = ""
        for _ in range(3):
            text += draw.choice(["so ", "x/", "ab", "M", "30", "\n"])
            key = draw.choice([EC, EDWARDS])
            text += draw.choice([base64.b64encode(key).decode(), key.hex(), key.hex()[:-1], base64.b64encode(key).decode()[1:]])
            text += draw.choice([" ", "!", "\n\n. "])
        assert sorted(secrets.confirmed_spans(text)) == slow(text), text
