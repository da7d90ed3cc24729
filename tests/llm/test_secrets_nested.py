"""Keys and tokens inside encodings."""

import base64
import itertools
import json
import random
import textwrap
import time

import pytest

from gristmill.llm import secrets
from tests.llm.test_operators import der

b64 = lambda x: base64.b64encode(x).decode()
url = lambda x: base64.urlsafe_b64encode(x).rstrip(b"=").decode()
PLAIN = der(0x30, der(2, b"\0") + der(0x30, der(6, b"\x2a\x86\x48")) + der(4, bytes(range(100))))
LOCKED = der(0x30, der(0x30, der(6, b"\x2a\x86\x48\x86\xf7\x0d\x01\x05\x0d") + der(0x30, der(0x30, der(6, b"\x2a\x86") + der(0x30, der(4, b"saltsalt") + der(2, b"\x08\0"))))) + der(4, bytes(range(256)) * 2))
TOKEN = f"{url(json.dumps({'alg': 'HS256', 'typ': 'JWT'}).encode())}.{url(b'{}')}.{url(bytes(32))}"
WRAPS = {"base64": b64, "url": url, "hex": bytes.hex, "HEX": lambda x: x.hex().upper()}


def armour(key, name="PRIVATE KEY"):
    return f"-----BEGIN {name}-----\n{textwrap.fill(b64(key), 64)}\n-----END {name}-----\n"


@pytest.mark.parametrize("kind, text", [("private_key", armour(PLAIN)), ("private_key", armour(LOCKED, "ENCRYPTED PRIVATE KEY")), ("private_key", b64(LOCKED)), ("signed_token", TOKEN)])
def test_each_wrapping(kind, text):
    for wraps in [(), *((w,) for w in WRAPS), *itertools.product(WRAPS, WRAPS)]:
        wrapped = text
        for w in wraps:
            wrapped = WRAPS[w](wrapped.encode())
        found = [s for s in secrets.scan(f"tls.key: {wrapped} and more") if s[2] in ("private_key", "signed_token")]
        # A key in base64 is an encoding itself; with two around it the depth is reached.
        want = [(kind, wrapped.rstrip("\n="))]
        assert [(s[2], s[4].rstrip("\n=")) for s in found] == want, wraps


def test_deeper_and_broken_encodings_are_not_reported():
    deep = armour(PLAIN)
    for _ in range(secrets.DEPTH + 1):
        deep = b64(deep.encode())
    broken = bytearray(PLAIN)
    broken[1:3] = b"\x82\x01"
    for text in (deep, b64(bytes(broken)), b64(armour(bytes(broken)).encode()), b64(b"just some longer text that says nothing of any key at all, twice"), LOCKED[:-40].hex(), b64(TOKEN[:-20].encode())):
        assert not [s for s in secrets.scan(f"x {text} y") if s[2] in ("private_key", "signed_token")], text[:60]


def test_time_grows_with_the_text():
    rng = random.Random(4)
    took = []
    for n in (2000, 8000):
        parts = [b64(f"plain words number {rng.random()} that are no key {'x' * 60}".encode()) if i % 2 else b64(PLAIN) for i in range(n)]
        start = time.time()
        assert len(secrets.scan(" ".join(parts))) == n // 2
        took.append(time.time() - start)
    assert took[1] < 8 * max(took[0], 0.3)
