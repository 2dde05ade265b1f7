"""BIP-340 Schnorr verification, after the published specification, and its Arrow UDF.

One signature at a time (``verify``), points are in Jacobian coordinates and ``s G - e P`` is an
interleaved double-and-add. A batch (``check_all``) goes step by step through all its signatures together:
additions are affine and share one inversion a step. Multiples of G come from a fixed table of byte
windows; a key of several signatures gets a table of its own for the batch, which leaves 96 additions
and no doubling to a signature; other keys are doubled along. Tables live as long as a batch, a bounded
number of keys at a time.
"""

from __future__ import annotations

import functools
import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed values of the curve secp256k1: field, group order, generator.
P = 0xFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFEFFFFFC2F
N = 0xFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFEBAAEDCE6AF48A03BBFD25E8CD0364141
G = (0x79BE667EF9DCBBAC55A06295CE870B07029BFCDB2DCE28D959F2815B16F81798, 0x483ADA7726A3C4655DA4FBFC0E1108A8FD17B448A68554199C47D08FFB10D4B8)

OK, BAD_SIGNATURE, BAD_KEY, MISMATCH = "", "signature_parse", "pubkey_parse", "signature_invalid"
Point = tuple[int, int, int]
INFINITY: Point = (1, 1, 0)


def _double(p: Point) -> Point:
    x, y, z = p
    if not z or not y:
        return INFINITY
    yy = y * y % P
    s = 4 * x * yy % P
    m = 3 * x * x % P
    x3 = (m * m - 2 * s) % P
    return x3, (m * (s - x3) - 8 * yy * yy) % P, 2 * y * z % P


def _add(p: Point, q: Point) -> Point:
    x1, y1, z1 = p
    x2, y2, z2 = q
    if not z1:
        return q
    if not z2:
        return p
    z1z1, z2z2 = z1 * z1 % P, z2 * z2 % P
    u1, u2 = x1 * z2z2 % P, x2 * z1z1 % P
    s1, s2 = y1 * z2 * z2z2 % P, y2 * z1 * z1z1 % P
    if u1 == u2:
        return _double(p) if s1 == s2 else INFINITY
    h, r = u2 - u1, s2 - s1
    hh = h * h % P
    hhh, v = h * hh % P, u1 * hh % P
    x3 = (r * r - hhh - 2 * v) % P
    return x3, (r * (v - x3) - s1 * hhh) % P, h * z1 * z2 % P


def _multiples(p: Point) -> list[Point]:
    """0 to 15 times a point."""
    out = [INFINITY, p]
    for _ in range(14):
        out.append(_add(out[-1], p))
    return out


_OF_G = _multiples((*G, 1))


def lift_x(x: int) -> tuple[int, int] | None:
    """The point of even y at x, if there is one."""
    if x >= P:
        return None
    square = (pow(x, 3, P) + 7) % P
    y = pow(square, (P + 1) // 4, P)
    if y * y % P != square:
        return None
    return x, y if y % 2 == 0 else P - y


@functools.lru_cache(maxsize=20_000)
def _key_table(x: int) -> list[Point] | None:
    point = lift_x(x)
    return None if point is None else _multiples((*point, 1))


def combine(a: int, b: int, table: list[Point]) -> Point:
    """a G + b Q for the multiples of Q, four bits at a time."""
    out = INFINITY
    for shift in range(252, -4, -4):
        if out[2]:
            out = _double(_double(_double(_double(out))))
        if i := a >> shift & 15:
            out = _add(out, _OF_G[i])
        if j := b >> shift & 15:
            out = _add(out, table[j])
    return out


def tagged_hash(tag: str, data: bytes) -> bytes:
    """The tagged SHA-256 of BIP-340."""
    head = hashlib.sha256(tag.encode()).digest()
    return hashlib.sha256(head + head + data).digest()


def verify(message: bytes, key: bytes, signature: bytes) -> bool:
    """Whether a 64-byte signature of the message is the x-only key's."""
    return len(key) == 32 and len(signature) == 64 and _reason(message, key, signature) == OK


def _reason(message: bytes, key: bytes, signature: bytes) -> str:
    table = _key_table(int.from_bytes(key, "big"))
    if table is None:
        return BAD_KEY
    r, s = int.from_bytes(signature[:32], "big"), int.from_bytes(signature[32:], "big")
    if r >= P or s >= N:
        return MISMATCH
    e = int.from_bytes(tagged_hash("BIP0340/challenge", signature[:32] + key + message), "big") % N
    x, y, z = combine(s, (N - e) % N, table)
    if not z:
        return MISMATCH
    inverse = pow(z, P - 2, P)
    if y * pow(inverse, 3, P) % P % 2 or x * inverse * inverse % P != r:
        return MISMATCH
    return OK


Affine = tuple[int, int] | None
#: A key with so many signatures in a batch gets a table; so many keys have theirs at a time.
OWN_TABLE, TABLES = 4, 64


def _inverses(values: list[int]) -> list[int]:
    """The inverse of each value modulo P, none of them 0, by one inversion of their product."""
    before, product = [], 1
    for v in values:
        before.append(product)
        product = product * v % P
    rest, out = pow(product, -1, P), [0] * len(values)
    for i in range(len(values) - 1, -1, -1):
        out[i] = rest * before[i] % P
        rest = rest * values[i] % P
    return out


def add_all(left: list[Affine], right: list[Affine]) -> list[Affine]:
    """The sums of two lists of points, place by place; None is the point at infinity."""
    out: list[Affine] = [None] * len(left)
    places, rises, runs = [], [], []
    for i, (p, q) in enumerate(zip(left, right, strict=True)):
        if p is None or q is None:
            out[i] = q if p is None else p
        elif p[0] != q[0]:
            places.append(i)
            rises.append(q[1] - p[1])
            runs.append(q[0] - p[0])
        elif p[1] == q[1]:  # no point of this curve has y = 0
            places.append(i)
            rises.append(3 * p[0] * p[0])
            runs.append(2 * p[1])
    for i, rise, inverse in zip(places, rises, _inverses(runs), strict=True):
        x1, y1 = left[i]
        slope = rise * inverse % P
        x = (slope * slope - x1 - right[i][0]) % P
        out[i] = x, (slope * (x1 - x) - y1) % P
    return out


def windows_of(points: list[Affine], bits: int) -> list[list[list[Affine]]]:
    """For each point, for each window of a 256-bit scalar, the multiples that its value stands for."""
    bases = [points]
    for _ in range(256 // bits - 1):
        here = bases[-1]
        for _ in range(bits):
            here = add_all(here, here)
        bases.append(here)
    flat = [p for base in bases for p in base]
    multiples = [[None] * len(flat), flat]
    for _ in range(2, 1 << bits):
        multiples.append(add_all(multiples[-1], flat))
    count = len(points)
    return [[[m[w * count + k] for m in multiples] for w in range(len(bases))] for k in range(count)]


@functools.cache
def _windows_of_g() -> list[list[Affine]]:
    return windows_of([G], 8)[0]


def _times(scalars: list[int], tables: list[list[list[Affine]]], bits: int, sums: list[Affine]) -> list[Affine]:
    """``sums`` plus each scalar's multiple, from the tables of its point."""
    mask = (1 << bits) - 1
    for w in range(256 // bits):
        sums = add_all(sums, [t[w][k >> (bits * w) & mask] for k, t in zip(scalars, tables, strict=True)])
    return sums


#: Fixed values of the curve's endomorphism: LAMBDA times a point is (BETA x, y); a short basis of the pairs (a, b) with
#: a + b LAMBDA = 0 modulo N.
LAMBDA = 0x5363AD4CC05C30E0A5261C028812645A122E22EA20816678DF02967C1B23BD72
BETA = 0x7AE96A2B657C07106E64479EAC3434E99CF0497512F58995C1396C28719501EE
BASIS = (
    (0x3086D221A7D46BCDE86C90E49284EB15, -0xE4437ED6010E88286F547FA90ABFE4C3),
    (0x114CA50F7A8E2F3F657C1108D9D44CFD8, 0x3086D221A7D46BCDE86C90E49284EB15),
)


def halves(k: int) -> tuple[int, int]:
    """Two numbers of about 128 bits, of either sign, with first + second LAMBDA = k modulo N."""
    (a1, b1), (a2, b2) = BASIS
    c1, c2 = (2 * b2 * k + N) // (2 * N), (-2 * b1 * k + N) // (2 * N)
    return k - c1 * a1 - c2 * a2, -c1 * b1 - c2 * b2


def _times_new(scalars: list[int], points: list[Affine]) -> list[Affine]:
    """Each scalar's multiple of its own point, both halves of it together by four bits at a time."""
    split = [halves(k) for k in scalars]
    signed = [(x, y if a >= 0 else P - y) for (x, y), (a, _) in zip(points, split, strict=True)]
    multiples = [[None] * len(points), signed]
    for _ in range(2, 16):
        multiples.append(add_all(multiples[-1], signed))
    # Halves of the same sign share the table but for its x.
    turned = [[p and (BETA * p[0] % P, p[1] if (a < 0) == (b < 0) else P - p[1]) for p, (a, b) in zip(m, split, strict=True)] for m in multiples]
    sums: list[Affine] = [None] * len(points)
    for shift in range(128, -4, -4):
        for _ in range(4):
            sums = add_all(sums, sums)
        for table, half in ((multiples, 0), (turned, 1)):
            sums = add_all(sums, [table[abs(s[half]) >> shift & 15][i] for i, s in enumerate(split)])
    return sums


@functools.lru_cache(maxsize=20_000)
def _point(x: int) -> tuple[int, int] | None:
    return lift_x(x)


def check_all(hashes: list[str | None], keys: list[str | None], signatures: list[str | None]) -> list[str | None]:
    """What ``check`` says of each row, for a whole batch; None where a hash or key or signature is null."""
    out: list[str | None] = [None] * len(hashes)
    waiting: dict[tuple[int, int], list[tuple[int, int, int, int]]] = {}
    for i, (h, k, s) in enumerate(zip(hashes, keys, signatures, strict=True)):
        if h is None or k is None or s is None:
            continue
        signature, key = _bytes(s, 64), _bytes(k, 32)
        point = None if key is None else _point(int.from_bytes(key, "big"))
        if signature is None:
            out[i] = BAD_SIGNATURE
        elif point is None:
            out[i] = BAD_KEY
        else:
            r, scalar = int.from_bytes(signature[:32], "big"), int.from_bytes(signature[32:], "big")
            out[i] = MISMATCH
            if r < P and scalar < N:
                e = int.from_bytes(tagged_hash("BIP0340/challenge", signature[:32] + key + bytes.fromhex(h)), "big") % N
                waiting.setdefault(point, []).append((i, r, scalar, (N - e) % N))
    often = [p for p, rows in waiting.items() if len(rows) >= OWN_TABLE]
    rarely = [(p, row) for p, rows in waiting.items() if len(rows) < OWN_TABLE for row in rows]
    for a in range(0, len(often), TABLES):
        some = often[a : a + TABLES]
        tables = dict(zip(some, windows_of(some, 4), strict=True))
        rows = [(row, tables[p]) for p in some for row in waiting[p]]
        _judge([row for row, _ in rows], _times([row[3] for row, _ in rows], [t for _, t in rows], 4, [None] * len(rows)), out)
    for a in range(0, len(rarely), 2048):
        rows = rarely[a : a + 2048]
        _judge([row for _, row in rows], _times_new([row[3] for _, row in rows], [p for p, _ in rows]), out)
    return out


def _judge(rows: list[tuple[int, int, int, int]], sums: list[Affine], out: list[str | None]) -> None:
    """Add ``s G`` and compare with r: an even point of that x is what a signature stands for."""
    sums = _times([row[2] for row in rows], [_windows_of_g()] * len(rows), 8, sums)
    for (i, r, _, _), point in zip(rows, sums, strict=True):
        if point is not None and point[0] == r and point[1] % 2 == 0:
            out[i] = OK


def _bytes(text: str, size: int) -> bytes | None:
    try:
        raw = bytes.fromhex(text)
    except ValueError:
        return None
    return raw if len(raw) == size and len(text) == 2 * size else None


def check(hash_hex: str, key_hex: str, signature_hex: str) -> str:
    """What is wrong with a signature over a hash: '' or a reason; the signature is parsed first."""
    signature = _bytes(signature_hex, 64)
    if signature is None:
        return BAD_SIGNATURE
    key = _bytes(key_hex, 32)
    if key is None:
        return BAD_KEY
    return _reason(bytes.fromhex(hash_hex), key, signature)


def sign(message: bytes, secret: int, extra: bytes = bytes(32)) -> tuple[bytes, bytes]:
    """(x-only key, signature): for fixtures; not hardened against timing."""

    def affine(k: int) -> tuple[int, int]:
        x, y, z = combine(k, 0, _OF_G)
        inverse = pow(z, P - 2, P)
        return x * inverse * inverse % P, y * pow(inverse, 3, P) % P

    x, y = affine(secret)
    d = secret if y % 2 == 0 else N - secret
    masked = (d ^ int.from_bytes(tagged_hash("BIP0340/aux", extra), "big")).to_bytes(32, "big")
    key = x.to_bytes(32, "big")
    k = int.from_bytes(tagged_hash("BIP0340/nonce", masked + key + message), "big") % N
    rx, ry = affine(k)
    k = k if ry % 2 == 0 else N - k
    r = rx.to_bytes(32, "big")
    e = int.from_bytes(tagged_hash("BIP0340/challenge", r + key + message), "big") % N
    return key, r + ((k + e * d) % N).to_bytes(32, "big")


@F.pandas_udf(StringType())
def _check_udf(hashes: pd.Series, keys: pd.Series, signatures: pd.Series) -> pd.Series:
    return pd.Series(check_all(*([None if pd.isna(x) else x for x in c] for c in (hashes, keys, signatures))), dtype=object)


def signature_reason(hash_hex: Column, key: Column, signature: Column, needed: Column) -> Column:
    """'' or what is wrong; null where not ``needed``, as those rows go to Python as nulls."""
    return _check_udf(F.when(needed, hash_hex), key, signature)
