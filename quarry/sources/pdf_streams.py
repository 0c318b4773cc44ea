"""What stands between a PDF's bytes and its streams: filters, and the standard security handler with the empty password."""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import cache

import numpy as np

# --- filters -----------------------------------------------------------------------

# The filters' names and their short forms.
_SHORT = {b"Fl": b"FlateDecode", b"LZW": b"LZWDecode", b"A85": b"ASCII85Decode", b"AHx": b"ASCIIHexDecode", b"RL": b"RunLengthDecode"}


def _flate(data: bytes, most: int) -> bytes:
    inflate = zlib.decompressobj()
    try:
        return inflate.decompress(data, most)
    except zlib.error:  # a damaged end: what can be read is
        inflate, out = zlib.decompressobj(), b""
        try:
            for at in range(0, len(data), 256):
                out += inflate.decompress(data[at : at + 256], most - len(out))
                if len(out) >= most:
                    break
        except zlib.error:
            pass
        if not out:
            raise
        return out


def _lzw(data: bytes, most: int, early: int = 1) -> bytes:
    """Codes of 9 to 12 bits, highest bit first; 256 clears the table, 257 ends."""
    out, size, known, last = bytearray(), 9, [bytes([i]) for i in range(256)] + [b"", b""], b""
    held = bits = 0
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < size:
            continue
        bits -= size
        code = held >> bits & (1 << size) - 1
        if code == 257 or len(out) >= most:
            break
        if code == 256:
            del known[258:]
            size, last = 9, b""
            continue
        entry = known[code] if code < len(known) else last + last[:1]
        out += entry
        if last and len(known) < 4096:
            known.append(last + entry[:1])
        last = entry
        size = 9 if len(known) + early < 512 else 10 if len(known) + early < 1024 else 11 if len(known) + early < 2048 else 12
    return bytes(out[:most])


def _ascii85(data: bytes) -> bytes:
    out, group = bytearray(), []
    for c in data.partition(b"~")[0]:
        if c == 0x7A and not group:
            out += bytes(4)
        elif 33 <= c <= 117:
            group.append(c - 33)
            if len(group) == 5:
                out += (sum(d * 85 ** (4 - i) for i, d in enumerate(group)) & 0xFFFFFFFF).to_bytes(4, "big")
                group = []
    if len(group) > 1:
        whole = group + [84] * (5 - len(group))
        out += (sum(d * 85 ** (4 - i) for i, d in enumerate(whole)) & 0xFFFFFFFF).to_bytes(4, "big")[: len(group) - 1]
    return bytes(out)


def _ascii_hex(data: bytes) -> bytes:
    digits = re.sub(rb"[^0-9A-Fa-f]", b"", data.partition(b">")[0])
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


def _run_length(data: bytes, most: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and data[at] != 128 and len(out) < most:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
    return bytes(out[:most])


def _number(params: bytes, name: bytes, otherwise: int) -> int:
    found = re.search(rb"/" + name + rb"\s+(\d+)", params)
    return int(found[1]) if found else otherwise


def _unpredicted(data: bytes, params: bytes) -> bytes:
    """Rows as they were before each was written as differences (PNG's five kinds, TIFF's one for whole bytes)."""
    kind = _number(params, b"Predictor", 1)
    if kind < 2:
        return data
    colors, depth, columns = _number(params, b"Colors", 1), _number(params, b"BitsPerComponent", 8), _number(params, b"Columns", 1)
    width, step = (colors * depth * columns + 7) // 8, max(1, colors * depth // 8)
    if kind == 2:
        rows = np.frombuffer(data[: len(data) // width * width], np.uint8).reshape(-1, columns, step)
        return np.cumsum(rows, axis=1, dtype=np.uint8).tobytes() if depth == 8 else data
    out, above = bytearray(), bytearray(width)
    for at in range(0, len(data), width + 1):
        own, how = bytearray(data[at + 1 : at + 1 + width]), data[at]
        for i in range(len(own)):
            left, corner = (own[i - step], above[i - step]) if i >= step else (0, 0)
            if how == 1:
                own[i] = (own[i] + left) & 255
            elif how == 2:
                own[i] = (own[i] + above[i]) & 255
            elif how == 3:
                own[i] = (own[i] + (left + above[i]) // 2) & 255
            elif how == 4:
                near = left + above[i] - corner
                own[i] = (own[i] + min((left, above[i], corner), key=lambda x: abs(near - x))) & 255
        out += own
        above = own + bytearray(width - len(own))
    return bytes(out)


def decoded(data: bytes, dictionary: bytes, most: int) -> bytes:
    """A stream's data behind the filters that its dictionary names; ValueError for a filter that is no text's."""
    named = re.search(rb"/Filter\s*(?:\[(.*?)\]|/([A-Za-z0-9]+))", dictionary, re.S)
    names = re.findall(rb"/([A-Za-z0-9]+)", named[1]) if named and named[1] is not None else [named[2]] if named else []
    params = re.search(rb"/(?:DecodeParms|DP)\s*(?:\[(.*?)\]|(<<.*?>>))", dictionary, re.S)
    each = re.findall(rb"<<.*?>>|null", params[1], re.S) if params and params[1] is not None else [params[2]] if params else []
    for i, name in enumerate(names):
        own, name = each[i] if i < len(each) else b"", _SHORT.get(name, name)
        if name == b"FlateDecode":
            data = _unpredicted(_flate(data, most), own)
        elif name == b"LZWDecode":
            data = _unpredicted(_lzw(data, most, _number(own, b"EarlyChange", 1)), own)
        elif name == b"ASCII85Decode":
            data = _ascii85(data)
        elif name == b"ASCIIHexDecode":
            data = _ascii_hex(data)
        elif name == b"RunLengthDecode":
            data = _run_length(data, most)
        elif name != b"Crypt":
            raise ValueError(f"filter {name.decode()}")
    return data


# --- ciphers -------------------------------------------------------------------------


def rc4(key: bytes, data: bytes) -> bytes:
    state, j = list(range(256)), 0
    for i in range(256):
        j = (j + state[i] + key[i % len(key)]) & 255
        state[i], state[j] = state[j], state[i]
    out, i, j = bytearray(len(data)), 0, 0
    for at, byte in enumerate(data):
        i = (i + 1) & 255
        j = (j + state[i]) & 255
        state[i], state[j] = state[j], state[i]
        out[at] = byte ^ state[(state[i] + state[j]) & 255]
    return bytes(out)


@cache
def _aes_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The substitution, its inverse, and products in AES's field, all by its rule: inverses modulo x^8 + x^4 + x^3 + x + 1, then an affine map."""
    power, log = [1] * 256, [0] * 256
    for i in range(1, 256):
        x = power[i - 1]
        x ^= (x << 1) ^ (0x11B if x & 0x80 else 0)  # times 3
        power[i] = x & 255
        log[power[i]] = i % 255
    times = np.zeros((256, 256), np.uint8)
    for a in range(1, 256):
        for b in (1, 2, 3, 9, 11, 13, 14):
            times[b, a] = power[(log[a] + log[b]) % 255]
    box = np.zeros(256, np.uint8)
    for a in range(256):
        x = power[(255 - log[a]) % 255] if a else 0
        box[a] = 0x63 ^ x ^ (x << 1 | x >> 7) & 255 ^ (x << 2 | x >> 6) & 255 ^ (x << 3 | x >> 5) & 255 ^ (x << 4 | x >> 4) & 255
    back = np.zeros(256, np.uint8)
    back[box] = np.arange(256)
    return box, back, times


def _round_keys(key: bytes) -> np.ndarray:
    """(rounds + 1) x 16 bytes."""
    box, _, _ = _aes_tables()
    n, words, constant = len(key) // 4, [list(key[i : i + 4]) for i in range(0, len(key), 4)], 1
    while len(words) < 4 * (n + 7):
        w = list(words[-1])
        if len(words) % n == 0:
            w = [int(box[x]) for x in w[1:] + w[:1]]
            w[0] ^= constant
            constant = constant << 1 ^ (0x11B if constant & 0x80 else 0)
        elif n > 6 and len(words) % n == 4:
            w = [int(box[x]) for x in w]
        words.append([a ^ b for a, b in zip(words[-n], w)])
    return np.array(words, np.uint8).reshape(-1, 16)


_ROWS = np.array([(i + 4 * (i % 4)) % 16 for i in range(16)])  # a row's shift: byte i comes from here


def aes_cbc_decrypt(key: bytes, start: bytes, data: bytes) -> bytes:
    """All blocks side by side: of each only the one before must be known."""
    _, back, times = _aes_tables()
    blocks = np.frombuffer(data[: len(data) // 16 * 16], np.uint8).reshape(-1, 16)
    keys, x, unshift = _round_keys(key), blocks, np.argsort(_ROWS)
    x = x ^ keys[-1]
    for k in range(len(keys) - 2, -1, -1):
        x = back[x[:, unshift]] ^ keys[k]
        if k:
            c = x.reshape(-1, 4, 4)
            x = np.stack([times[14][c[:, :, i]] ^ times[11][c[:, :, (i + 1) % 4]] ^ times[13][c[:, :, (i + 2) % 4]] ^ times[9][c[:, :, (i + 3) % 4]] for i in range(4)], axis=2).reshape(-1, 16)
    before = np.concatenate([np.frombuffer(start, np.uint8)[None], blocks[:-1]]) if len(blocks) else blocks
    return (x ^ before).tobytes()


@cache
def _mixed_tables() -> list[list[int]]:
    """Substitution and column mixing as one table of words for each byte of a column."""
    box, _, times = _aes_tables()
    out = []
    for turn in range(4):
        column = [2, 1, 1, 3][-turn:] + [2, 1, 1, 3][:-turn] if turn else [2, 1, 1, 3]
        out.append([int.from_bytes(bytes(int(times[m][int(box[a])]) for m in column), "big") for a in range(256)])
    return out


def aes_cbc_encrypt(key: bytes, start: bytes, data: bytes) -> bytes:
    """Block after block (the hash of revision 6 asks for it)."""
    box = [int(x) for x in _aes_tables()[0]]
    t0, t1, t2, t3 = _mixed_tables()
    keys = [[int.from_bytes(row[i : i + 4].tobytes(), "big") for i in (0, 4, 8, 12)] for row in _round_keys(key)]
    last, out = [int.from_bytes(start[i : i + 4], "big") for i in (0, 4, 8, 12)], bytearray()
    for at in range(0, len(data) // 16 * 16, 16):
        s = [int.from_bytes(data[at + i : at + i + 4], "big") ^ v ^ k for i, v, k in zip((0, 4, 8, 12), last, keys[0])]
        for own in keys[1:-1]:
            s = [t0[s[i] >> 24] ^ t1[s[(i + 1) % 4] >> 16 & 255] ^ t2[s[(i + 2) % 4] >> 8 & 255] ^ t3[s[(i + 3) % 4] & 255] ^ own[i] for i in range(4)]
        last = [(box[s[i] >> 24] << 24 | box[s[(i + 1) % 4] >> 16 & 255] << 16 | box[s[(i + 2) % 4] >> 8 & 255] << 8 | box[s[(i + 3) % 4] & 255]) ^ keys[-1][i] for i in range(4)]
        for v in last:
            out += v.to_bytes(4, "big")
    return bytes(out)


# --- the standard security handler ---------------------------------------------------

# Fixed value: what a password is filled up with.
_PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")
_ESCAPED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_LITERAL = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>(?!>)", re.S)


class WrongPassword(ValueError):
    pass


def string(token: bytes) -> bytes:
    """The bytes of a literal or hexadecimal string."""
    if token[:1] == b"<":
        return _ascii_hex(token[1:])

    def one(m: re.Match) -> bytes:
        x = m[1]
        return bytes([int(x, 8) & 255]) if x[:1].isdigit() else b"" if x in (b"\n", b"\r\n", b"\r") else _ESCAPED.get(x, x)

    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", one, token[1:-1], flags=re.S)


def _entry(body: bytes, name: bytes) -> bytes:
    found = re.search(rb"/" + name + rb"\s*(?=[(<])", body)
    token = _LITERAL.match(body, found.end()) if found else None
    return string(token[0]) if token else b""


def _hash(data: bytes, salt: bytes, revision: int) -> bytes:
    """Of the empty password; from revision 6 on, rounds of encryption whose results choose the next hash."""
    key = hashlib.sha256(data + salt).digest()
    if revision < 6:
        return key
    done = 0
    while True:
        block = aes_cbc_encrypt(key[:16], key[16:32], (data + key) * 64)
        key = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(block[:16]) % 3](block).digest()
        done += 1
        if done >= 64 and block[-1] <= done - 32:
            return key[:32]


class Security:
    """Decrypts strings and streams of a file that opens with the empty password; raises WrongPassword for another."""

    def __init__(self, encrypt: bytes, file_id: bytes):
        self.version, self.revision = _number(encrypt, b"V", 0), _number(encrypt, b"R", 0)
        if not re.search(rb"/Filter\s*/Standard\b", encrypt) or self.version not in (1, 2, 4, 5):
            raise WrongPassword("another security handler")
        methods = dict(re.findall(rb"/([A-Za-z0-9]+)\s*<<[^<>]*?/CFM\s*/([A-Za-z0-9]+)", encrypt))
        self.streams, self.strings = (self._method(encrypt, name, methods) for name in (b"StmF", b"StrF"))
        owner, user = _entry(encrypt, b"O"), _entry(encrypt, b"U")
        if self.version == 5:
            if _hash(b"", user[32:40], self.revision) != user[:32]:
                raise WrongPassword("password")
            self.key = aes_cbc_decrypt(_hash(b"", user[40:48], self.revision), bytes(16), _entry(encrypt, b"UE")[:32])
            return
        n = 5 if self.revision == 2 else 16 if self.version == 4 else _number(encrypt, b"Length", 40) // 8
        allowed = re.search(rb"/P\s+(-?\d+)", encrypt)
        seed = _PAD + owner[:32] + (int(allowed[1]) & 0xFFFFFFFF).to_bytes(4, "little") if allowed else b""
        seed += file_id + (b"\xff" * 4 if self.revision >= 4 and re.search(rb"/EncryptMetadata\s+false", encrypt) else b"")
        key = hashlib.md5(seed).digest()
        for _ in range(50 if self.revision >= 3 else 0):
            key = hashlib.md5(key[:n]).digest()
        self.key = key[:n]
        if self.revision == 2:
            right = rc4(self.key, _PAD) == user[:32]
        else:
            told = hashlib.md5(_PAD + file_id).digest()
            for i in range(20):
                told = rc4(bytes(b ^ i for b in self.key), told)
            right = told == user[:16]
        if not right:
            raise WrongPassword("password")

    def _method(self, encrypt: bytes, name: bytes, methods: dict[bytes, bytes]) -> bytes:
        if self.version < 4:
            return b"V2"
        chosen = re.search(rb"/" + name + rb"\s*/([A-Za-z0-9]+)", encrypt)
        return methods.get(chosen[1], b"None") if chosen and chosen[1] != b"Identity" else b"None"

    def _opened(self, data: bytes, method: bytes, number: int, generation: int) -> bytes:
        if method == b"None":
            return data
        key = self.key
        if self.version < 5:
            key = hashlib.md5(key + number.to_bytes(3, "little") + generation.to_bytes(2, "little") + (b"sAlT" if method == b"AESV2" else b"")).digest()[: min(16, len(key) + 5)]
        if method == b"V2":
            return rc4(key, data)
        plain = aes_cbc_decrypt(key, data[:16], data[16:]) if len(data) >= 32 else b""
        return plain[: -plain[-1]] if plain and 1 <= plain[-1] <= 16 else plain

    def stream(self, data: bytes, number: int, generation: int) -> bytes:
        return self._opened(data, self.streams, number, generation)

    def body(self, body: bytes, number: int, generation: int) -> bytes:
        """An object without a stream, its strings in the clear."""
        return _LITERAL.sub(lambda m: b"<" + self._opened(string(m[0]), self.strings, number, generation).hex().encode() + b">", body)
