"""PDF streams: filters, predictors, ciphers by published vectors, files encrypted with the empty password."""

import base64
import hashlib
import random
import struct
import zlib

import pytest

from quarry.sources import pdf_streams as P
from quarry.sources.parsers import parse_bytes

MOST = 1 << 20


def test_published_vectors():
    assert P.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3" and P.rc4(b"Wiki", b"pedia").hex() == "1021bf0420"
    plain = bytes.fromhex("00112233445566778899aabbccddeeff")
    for n, want in ((16, "69c4e0d86a7b0430d8cdb78070b4c55a"), (24, "dda97ca4864cdfe06eaf70a0ec0d7191"), (32, "8ea2b7ca516745bfeafc49904b496089")):
        key = bytes(range(n))
        assert P.aes_cbc_encrypt(key, bytes(16), plain).hex() == want
        assert P.aes_cbc_decrypt(key, bytes(16), bytes.fromhex(want)) == plain
    rng = random.Random(1)
    for n in (0, 16, 160, 1600):
        key, start, data = rng.randbytes(32), rng.randbytes(16), rng.randbytes(n)
        assert P.aes_cbc_decrypt(key, start, P.aes_cbc_encrypt(key, start, data)) == data


def lzw(data):
    """Codes as the format's description says; the width grows one code early."""
    table, out, own, size = {bytes([i]): i for i in range(256)}, [(256, 9)], b"", 9
    n = 258
    for b in data:
        if own + bytes([b]) in table:
            own += bytes([b])
            continue
        out.append((table[own], size))
        table[own + bytes([b])] = n
        n, own = n + 1, bytes([b])
        size = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
        if n > 4093:  # the last code of 12 bits stays free
            out.append((256, size))
            table, n, size = {bytes([i]): i for i in range(256)}, 258, 9
    if own:
        out.append((table[own], size))
        n += 1
        size = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
    out.append((257, size))
    bits = "".join(f"{code:0{width}b}" for code, width in out)
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))


def predicted(data, width, step, how):
    """Rows written as PNG's differences of one kind."""
    out, above = bytearray(), bytes(width)
    for at in range(0, len(data), width):
        row = data[at : at + width]
        out.append(how)
        for i, x in enumerate(row):
            left, up, corner = row[i - step] if i >= step else 0, above[i], above[i - step] if i >= step else 0
            near = left + up - corner
            out.append((x - (0, left, up, (left + up) // 2, min((left, up, corner), key=lambda v: abs(near - v)))[how]) & 255)
        above = row
    return bytes(out)


def test_filters():
    rng = random.Random(2)
    for data in (b"", b"a", b"abc" * 5000, rng.randbytes(20_000), bytes(9000), b"BT (text) Tj ET\n" * 700):
        hexed = data.hex().encode() + b">"
        for name, stored in (("FlateDecode", zlib.compress(data)), ("LZWDecode", lzw(data)), ("ASCIIHexDecode", hexed), ("ASCII85Decode", base64.a85encode(data) + b"~>"), ("Fl", zlib.compress(data)), ("AHx", hexed)):
            assert P.decoded(stored, f"<< /Filter /{name} >>".encode(), MOST) == data, name
        both = base64.a85encode(zlib.compress(data)) + b"~>"
        assert P.decoded(both, b"<< /Filter [ /ASCII85Decode /FlateDecode ] >>", MOST) == data
        assert P.decoded(data, b"<< /Length 5 >>", MOST) == data
        packed = b"".join(bytes([len(data[i : i + 128]) - 1]) + data[i : i + 128] for i in range(0, len(data), 128)) + b"\x80"
        assert P.decoded(packed, b"<< /Filter /RunLengthDecode >>", MOST) == data
    assert P.decoded(bytes([254]) + b"x" + bytes([1]) + b"yz\x80", b"/Filter /RL", MOST) == b"xxxyz"
    assert P.decoded(zlib.compress(bytes(10 * MOST)), b"/Filter /FlateDecode", MOST) == bytes(MOST)
    rows = rng.randbytes(5 * 12)
    for how in range(5):
        params = b"/Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 4 /Colors 3 >>"
        assert P.decoded(zlib.compress(predicted(rows, 12, 3, how)), params, MOST) == rows
    tiff = bytes((b - (rows[i - 3] if i % 12 >= 3 else 0)) & 255 for i, b in enumerate(rows))
    assert P.decoded(zlib.compress(tiff), b"/Filter /FlateDecode /DecodeParms << /Predictor 2 /Columns 4 /Colors 3 >>", MOST) == rows
    with pytest.raises(ValueError):
        P.decoded(b"x", b"/Filter /DCTDecode", MOST)
    text = b"".join(b"word %d and more; " % (i * i) for i in range(4000))
    whole = zlib.compress(text)
    cut = P.decoded(whole[:-400], b"/Filter /FlateDecode", MOST)
    assert len(cut) > 10_000 and text.startswith(cut)
    damaged = whole[: len(whole) // 2] + bytes(50) + whole[len(whole) // 2 :]
    assert P.decoded(damaged, b"/Filter /FlateDecode", MOST).startswith(text[:5000])  # what stands before the damage


def literal(data):
    return b"(" + data.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").replace(b"\r", b"\\r") + b")"


class Locked:
    """The writing side: keys and entries of the standard handler for a user's password."""

    def __init__(self, kind, password=b"", seed=3):
        self.kind, rng = kind, random.Random(seed)
        self.file_id, owner = rng.randbytes(16), rng.randbytes(32)
        if kind in ("r5", "r6"):
            check, salt, self.key = rng.randbytes(8), rng.randbytes(8), rng.randbytes(32)
            hashed = (lambda s: hashlib.sha256(password + s).digest()) if kind == "r5" else (lambda s: self.hardened(password, s))
            user, wrapped = hashed(check) + check + salt, P.aes_cbc_encrypt(hashed(salt), bytes(16), self.key)
            self.entry = b"<< /Filter /Standard /V 5 /R %d /Length 256 /P -4 /O " % (5 if kind == "r5" else 6) + literal(rng.randbytes(48)) + b" /U " + literal(user) + b" /UE " + literal(wrapped) + b" /OE " + literal(rng.randbytes(32))
            self.entry += b" /CF << /StdCF << /AuthEvent /DocOpen /CFM /AESV3 /Length 32 >> >> /StmF /StdCF /StrF /StdCF >>"
            return
        v, r, n = {"rc4-40": (1, 2, 5), "rc4-128": (2, 3, 16), "aes-128": (4, 4, 16), "v4-rc4": (4, 4, 16), "streams only": (4, 4, 16)}[kind]
        padded = (password + P._PAD)[:32]
        key = hashlib.md5(padded + owner + struct.pack("<i", -44) + self.file_id).digest()
        for _ in range(50 if r > 2 else 0):
            key = hashlib.md5(key[:n]).digest()
        self.key = key[:n]
        if r == 2:
            user = P.rc4(self.key, P._PAD)
        else:
            user = hashlib.md5(P._PAD + self.file_id).digest()
            for i in range(20):
                user = P.rc4(bytes(b ^ i for b in self.key), user)
            user += bytes(16)
        self.entry = b"<< /Filter /Standard /V %d /R %d /Length %d /P -44 /O <%s> /U " % (v, r, 8 * n, owner.hex().encode()) + literal(user)
        if v == 4:
            self.entry += b" /CF << /StdCF << /CFM /%s /Length 16 >> >> /StmF /StdCF /StrF /%s" % (b"V2" if kind == "v4-rc4" else b"AESV2", b"Identity" if kind == "streams only" else b"StdCF")
        self.entry += b" >>"

    @staticmethod
    def hardened(password, salt):
        key, done = hashlib.sha256(password + salt).digest(), 0
        while True:
            block = P.aes_cbc_encrypt(key[:16], key[16:32], (password + key) * 64)
            key = hashlib.new(("sha256", "sha384", "sha512")[int.from_bytes(block[:16], "big") % 3], block).digest()
            done += 1
            if done >= 64 and block[-1] <= done - 32:
                return key[:32]

    def close(self, data, number, is_string=False):
        if is_string and self.kind == "streams only":
            return data
        aes = self.kind in ("aes-128", "streams only", "r5", "r6")
        key = self.key
        if self.kind not in ("r5", "r6"):
            key = hashlib.md5(key + struct.pack("<I", number)[:3] + b"\0\0" + (b"sAlT" if aes else b"")).digest()[: min(16, len(key) + 5)]
        if not aes:
            return P.rc4(key, data)
        fill = 16 - len(data) % 16
        start = hashlib.md5(data).digest()
        return start + P.aes_cbc_encrypt(key, start, data + bytes([fill]) * fill)


def locked_pdf(lock, compressed=False):
    """Two pages with labels; ``compressed``: the objects lie in an object stream behind a predictor."""
    plain = {1: b"<< /Type /Catalog /Pages 2 0 R /PageLabels 7 0 R >>", 2: b"<< /Type /Pages /Count 2 /Kids [3 0 R 5 0 R] >>", 3: b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>", 5: b"<< /Type /Page /Parent 2 0 R /Contents 6 0 R >>"}
    label = b"Part-" if compressed else lock.close(b"Part-", 7, True)
    plain[7] = b"<< /Nums [0 << /S /r /P " + literal(label) + b" >>] >>"
    out = [b"%PDF-1.7\n"]

    def stream(number, data, more=b""):
        own = lock.close(data, number)
        out.append(b"%d 0 obj << /Length %d%s >>\nstream\n" % (number, len(own), more) + own + b"\nendstream\nendobj\n")

    for number, text in ((4, b"first (locked) page"), (6, b"second page")):
        stream(number, zlib.compress(b"BT 72 720 Td " + literal(text) + b" Tj ET"), b" /Filter /FlateDecode")
    if compressed:
        head, body = b"", b""
        for number, own in plain.items():
            head += b"%d %d " % (number, len(body))
            body += own + b" "
        whole = head + body
        whole += b" " * (-len(whole) % 8)
        stream(9, zlib.compress(predicted(whole, 8, 1, 2)), b" /Type /ObjStm /N %d /First %d /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 8 >>" % (len(plain), len(head)))
        table = zlib.compress(bytes(20))
        out.append(b"10 0 obj << /Type /XRef /Size 11 /W [1 2 1] /Root 1 0 R /Encrypt 8 0 R /ID [<%s> <00>] /Filter /FlateDecode /Length %d >>\nstream\n" % (lock.file_id.hex().encode(), len(table)) + table + b"\nendstream\nendobj\n")
    else:
        out += [b"%d 0 obj " % number + own + b" endobj\n" for number, own in plain.items()]
    out.append(b"8 0 obj " + lock.entry + b" endobj\n")
    if not compressed:
        out.append(b"trailer << /Root 1 0 R /Encrypt 8 0 R /ID [" + literal(lock.file_id) + b" <00>] >>\n")
    return b"".join(out)


KINDS = ["rc4-40", "rc4-128", "v4-rc4", "aes-128", "streams only", "r5", "r6"]


@pytest.mark.parametrize("compressed", [False, True])
@pytest.mark.parametrize("kind", KINDS)
def test_the_empty_password_opens(kind, compressed):
    row = parse_bytes("a.pdf", locked_pdf(Locked(kind), compressed))
    assert row["outcome"] == "ok", row
    assert [u["text"] for u in row["units"]] == ["first (locked) page", "second page"]
    assert [u["location"].get("page_label") for u in row["units"]] == ["Part-i", "Part-ii"]


@pytest.mark.parametrize("kind", KINDS)
def test_other_passwords_do_not(kind):
    row = parse_bytes("a.pdf", locked_pdf(Locked(kind, b"secret")))
    assert (row["outcome"], row["units"]) == ("password_protected", [])


def test_broken_entries_never_raise():
    whole = locked_pdf(Locked("aes-128"))
    rng = random.Random(5)
    for _ in range(150):
        data = bytearray(whole)
        for _ in range(rng.randint(1, 12)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        assert parse_bytes("a.pdf", bytes(data[: rng.randint(20, len(data))]))["outcome"] in ("ok", "no_text", "corrupt", "password_protected")
    other = whole.replace(b"/Filter /Standard", b"/Filter /Adobe.PubSec")
    assert parse_bytes("a.pdf", other)["outcome"] == "password_protected"
    assert parse_bytes("a.pdf", whole.replace(b"8 0 obj", b"88 0 obj"))["outcome"] == "password_protected"
