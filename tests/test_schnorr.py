import hashlib
import random

from veldt.functions import schnorr as s


def test_published_vectors():
    """Vectors 0 and 1 of the specification, and its key that is not on the curve."""
    key, sig = s.sign(bytes(32), 3)
    assert key.hex().upper() == "F9308A019258C31049344F85F89D5229B531C845836F99B08601F113BCE036F9"
    assert sig.hex().upper() == (
        "E907831F80848D1069A5371B402410364BDF1C5F8307B0084C55F1CE2DCA8215"
        "25F66A4A85EA8B71E482A74F382D2CE5EBEEE8FDB2172F477DF4900D310536C0"
    )
    assert s.verify(bytes(32), key, sig)
    message = bytes.fromhex("243F6A8885A308D313198A2E03707344A4093822299F31D0082EFA98EC4E6C89")
    secret = 0xB7E151628AED2A6ABF7158809CF4F3C762E7160F38B4DA56A784D9045190CFEF
    key, sig = s.sign(message, secret, (1).to_bytes(32, "big"))
    assert sig.hex().upper() == (
        "6896BD60EEAE296DB48A229FF71DFE071BDE413E6D43F917DC8DCF8C78DE3341"
        "8906D11AC976ABCCB20B091292BFF4EA897EFCB639EA871CFA95F6DE339E4B0A"
    )
    assert s.verify(message, key, sig)
    off_curve = bytes.fromhex("EEFDEA4CDB677750A420FEE807EACF21EB9898AE79B9768766E4FAA04A2D4A34")
    assert s.check(message.hex(), off_curve.hex(), sig.hex()) == s.BAD_KEY


def test_changed_bits_fail():
    message = b"m" * 32
    key, sig = s.sign(message, 12345)
    for i in (0, 31, 32, 63):
        bad = bytearray(sig)
        bad[i] ^= 1
        assert not s.verify(message, key, bytes(bad))
    assert not s.verify(b"n" * 32, key, sig)
    assert s.check(message.hex(), key.hex(), "zz" * 64) == s.BAD_SIGNATURE
    assert s.check(message.hex(), "00", sig.hex()) == s.BAD_KEY


def _signed(secrets, n):
    rows = []
    for i in range(n):
        message = hashlib.sha256(str(i).encode()).digest()
        key, sig = s.sign(message, secrets[i % len(secrets)])
        rows.append([message.hex(), key.hex(), sig.hex()])
    return rows


def test_a_batch_says_what_one_at_a_time_says():
    """Keys of one and of many signatures, broken in every way, on both sides of the table rule."""
    rows = _signed([3, 5, 3, 2**200 + 9, 3], 30) + _signed(range(100, 130), 30)
    r = random.Random(1)
    for i in range(0, 60, 3):
        column, place = r.randrange(3), r.randrange(64)
        old = rows[i][column][place]
        rows[i][column] = rows[i][column][:place] + ("0" if old != "0" else "7") + rows[i][column][place + 1 :]
    rows += [["00" * 32, "ee" * 32, "zz"], ["00" * 32, "11" * 31, "cc" * 64], ["00" * 32, rows[1][1], "ff" * 64], ["00" * 32, rows[1][1], "cc" * 32 + "ff" * 32]]
    rows += [["00" * 32, f"{s.G[0]:064x}", "00" * 32 + f"{k:064x}"] for k in (0, 1, s.N - 1)]
    told = s.check_all(*zip(*rows, strict=True))
    assert told == [s.check(*row) for row in rows]
    assert told.count(s.OK) > 30 and s.BAD_KEY in told and s.BAD_SIGNATURE in told and s.MISMATCH in told
    assert s.check_all([None, "00" * 32], ["a", None], ["b", "c"]) == [None, None] and s.check_all([], [], []) == []


def test_sums_of_equal_and_opposite_points():
    g, minus = s.G, (s.G[0], s.P - s.G[1])
    double = s.add_all([g], [g])[0]
    assert s.add_all([g, g, None, g, None], [g, minus, g, None, None]) == [double, None, g, g, None]
    tables = s.windows_of([g, double], 4)
    assert tables[0][0][2] == double and tables[1][0][1] == double and tables[0][1][1] == s.add_all([tables[0][0][15]], [g])[0]


def test_halves_are_short():
    r = random.Random(2)
    for k in [0, 1, s.N - 1, s.LAMBDA, *(r.randrange(s.N) for _ in range(300))]:
        a, b = s.halves(k)
        assert (a + b * s.LAMBDA - k) % s.N == 0 and max(abs(a), abs(b)) < 2**132
