"""Operator 8, media columns: FLAC streams in numpy.

A payload is stored as 8-bit mono samples in FLAC: STREAMINFO with the MD5 of the samples, a SEEKTABLE with the sample
and byte offset of every frame, then frames with a CONSTANT, VERBATIM, FIXED (order 0 to 4) or LPC subframe, whichever is
shortest. Residuals are Rice coded. All frames of a chunk of payloads are handled side by side: step s decodes sample s of
every frame, so numpy works on vectors as long as the chunk has frames.

Reading starts at all seek points at once and walks on from each until every byte belongs to a frame, so a sparse or missing
seek table only takes more steps. It checks the CRC-8 of each frame header, the CRC-16 of each frame, that the frames' own
numbers say where their samples lie, and the MD5 of the stream, and gives PCM blocks with their sample offsets. ``samples_at``
reads a span of samples from the seek point before it, without the rest of the stream.

Defined results: null and empty texts store 64 zero bytes; equal texts give equal bytes and features; a damaged stream
raises ``ValueError``, and so does one that is not 8-bit mono; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import chunks
from tessera.runtime import ship_package

#: Samples of a block, sample rate in Hz, and multiple that payloads are filled up to.
BLOCK, RATE, ALIGN = 1024, 8000, 64
CONSTANT, VERBATIM, FIXED, LPC = 0, 1, 8, 32
#: Fixed predictors: x[n] is predicted from the samples before it with these factors.
PREDICT = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
MOST_RICE = 14
#: Order of the encoder's linear prediction, bits of its coefficients, least and most of their shift.
ORDER, PRECISION, SHIFTS = 4, 8, (2, 12)
SEEK_POINT = np.dtype([("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")])


def crc_table(poly: int, bits: int, index_bits: int) -> np.ndarray:
    """Remainders of all ``index_bits``-bit values under a CRC of ``bits`` bits, most significant bit first."""
    value = np.arange(1 << index_bits, dtype=np.uint32) << (bits - index_bits if bits > index_bits else 0)
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    for _ in range(index_bits):
        value = np.where(value & top, (value << 1) ^ poly, value << 1) & mask
    return value


CRC8 = crc_table(0x07, 8, 8).tolist()
CRC16_BYTE = crc_table(0x8005, 16, 8)
CRC16_PAIR = crc_table(0x8005, 16, 16)


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = CRC8[c ^ b]
    return c


def crc16(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-16 of many spans of ``data`` (uint8), two bytes of every span in a step."""
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    c = np.zeros(len(start), np.uint32)
    pairs = length // 2
    wide = data.astype(np.uint32)
    left = len(start)
    for j in range(int(pairs.max(initial=0))):
        while left and pairs[left - 1] <= j:
            left -= 1
        at = start[:left] + 2 * j
        c[:left] = CRC16_PAIR[c[:left] ^ (wide[at] << 8 | wide[at + 1])]
    odd = length % 2 == 1
    last = wide[(start + length - 1)[odd]]
    c[odd] = CRC16_BYTE[(c[odd] >> 8) ^ last] ^ (c[odd] << 8 & 0xFFFF)
    out = np.empty_like(c)
    out[order] = c
    return out


def frame_header(n: int, number: int) -> bytes:
    size = n.bit_length() - 1
    plain = 256 <= n <= 32768 and n == 1 << size
    head = b"\xff\xf8" + bytes([(size if plain else 7) << 4 | 4, 1 << 1]) + utf8_number(number) + (b"" if plain else struct.pack(">H", n - 1))
    return head + bytes([crc8(head)])


def utf8_number(n: int) -> bytes:
    """A frame number in the extended UTF-8 form (up to 36 bits)."""
    if n < 0x80:
        return bytes([n])
    more = []
    limit = 0x3F
    while n > limit:
        more.append(0x80 | n & 0x3F)
        n >>= 6
        limit = (1 << (6 - len(more))) - 1
    return bytes([(0xFF << (7 - len(more))) & 0xFF | n, *reversed(more)])


def samples_of(payload: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A row of samples for each block; beyond a block's end its last sample is repeated."""
    at = start[:, None] + np.minimum(np.arange(int(n.max()))[None, :], n[:, None] - 1)
    return payload[at].astype(np.int16) - np.int16(128)


def zigzag(residual: np.ndarray, inside: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Residuals behind the warm-up samples as unsigned numbers, and which they are."""
    coded = inside & (np.arange(inside.shape[1])[None, :] >= order[:, None])
    return np.where(coded, (residual << 1) ^ (residual >> 31), 0).astype(np.uint16), coded


def rice_bits(u: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the Rice codes of each row, and the parameter of fewest bits: one next to the logarithm of the mean."""
    mean = u.sum(axis=1, dtype=np.int64) / np.maximum(n, 1)
    middle = np.floor(np.log2(np.maximum(mean, 1))).astype(np.int64)
    bits, rice = np.full(len(n), 2**62), np.zeros(len(n), np.int64)
    for step in (-1, 0, 1):
        k = np.clip(middle + step, 0, MOST_RICE)
        cost = (u >> k[:, None].astype(np.uint16)).sum(axis=1, dtype=np.int64) + n * (k + 1)
        win = cost < bits
        bits[win], rice[win] = cost[win], k[win]
    return bits, rice


def linear_prediction(s: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients of order ORDER (integers), their shifts, and for which rows there are any; by Levinson's recursion."""
    x = np.where(np.arange(s.shape[1])[None, :] < n[:, None], s, 0).astype(np.float32)
    r = np.stack([(x[:, lag:] * x[:, : x.shape[1] - lag]).sum(axis=1, dtype=np.float64) for lag in range(ORDER + 1)], axis=1) if len(s) else np.zeros((0, ORDER + 1))
    a, error = np.zeros((len(s), ORDER)), r[:, 0] * (1 + 1e-9) + 1e-9
    for i in range(ORDER):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(axis=1)) / error
        a[:, :i], a[:, i] = a[:, :i] - k[:, None] * a[:, :i][:, ::-1], k
        error = np.maximum(error * (1 - k * k), 1e-9)
    most = np.abs(a).max(axis=1, initial=0)
    shift = PRECISION - 1 - np.ceil(np.log2(np.maximum(most, 1e-6))).astype(np.int64)
    shift = np.minimum(shift, SHIFTS[1])
    factors = np.clip(np.rint(a * (2.0 ** shift)[:, None]), -(1 << PRECISION - 1), (1 << PRECISION - 1) - 1).astype(np.int32)
    return factors, shift, (shift >= SHIFTS[0]) & (most > 0)


def linear_residual(s: np.ndarray, factors: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """What the coefficients leave of the samples behind the first ORDER ones."""
    x = s.astype(np.int32)
    total = np.zeros((len(x), x.shape[1] - ORDER), np.int32)
    for j in range(ORDER):
        total += factors[:, j : j + 1] * x[:, ORDER - 1 - j : x.shape[1] - 1 - j]
    out = np.zeros_like(x)
    out[:, ORDER:] = x[:, ORDER:] - (total >> shift[:, None].astype(np.int32))
    return out


def encode(payloads: list[bytes]) -> list[bytes]:
    """FLAC streams of payloads (each of at least one byte), one byte a sample."""
    if not payloads:
        return []
    sizes = np.fromiter(map(len, payloads), np.int64, len(payloads))
    per = -(-sizes // BLOCK)
    owner = np.repeat(np.arange(len(payloads)), per)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    n = np.minimum(BLOCK, sizes[owner] - number * BLOCK)
    start = np.repeat(np.cumsum(sizes) - sizes, per) + number * BLOCK
    s = samples_of(np.frombuffer(b"".join(payloads), np.uint8), start, n)
    inside = np.arange(s.shape[1])[None, :] < n[:, None]

    # the fixed predictor of least sum of absolute residuals, and linear prediction where it takes fewer bits
    best, residual, order = np.full(len(n), 2**62), np.zeros(s.shape, np.int32), np.zeros(len(n), np.int64)
    d = s
    for o in range(5):
        if o:
            d = np.concatenate([np.zeros((len(n), o), np.int16), np.diff(d[:, o - 1 :], axis=1)], axis=1) if s.shape[1] > o else np.zeros_like(s)
        cost = np.where(inside, np.abs(d), 0).sum(axis=1, dtype=np.int64) + 8 * o
        win = (cost < best) & (n > o)
        best[win], order[win] = cost[win], o
        residual[win] = d[win]
    constant = (s == s[:, :1]).all(axis=1)
    u, coded = zigzag(residual, inside, order)
    bits, rice = rice_bits(u, n - order)
    bits += 8 * order + 10
    kind = np.full(len(n), FIXED)
    mine = np.flatnonzero(~constant & (n > 2 * ORDER))
    factors, shift, known = linear_prediction(s[mine], n[mine])
    mine = mine[known]
    factors, shift = factors[known], shift[known]
    if len(mine):
        left = linear_residual(s[mine], factors, shift)
        v, coded_ = zigzag(left, inside[mine], np.full(len(mine), ORDER))
        cost, k = rice_bits(v, n[mine] - ORDER)
        cost += 8 * ORDER + 9 + PRECISION * ORDER + 10
        # a residual must fit 16 bits, as the shorter of two codings of 8-bit samples does
        win = (cost < bits[mine]) & (np.abs(left).max(axis=1) < 1 << 15)
        own = mine[win]
        kind[own], order[own], u[own], coded[own], bits[own], rice[own] = LPC, ORDER, v[win], coded_[win], cost[win], k[win]
        factors, shift = factors[win], shift[win]
    else:
        own = mine
    kind = np.where(constant, CONSTANT, np.where(bits >= 8 * n, VERBATIM, kind))
    factors, shift, own = factors[kind[own] == LPC], shift[kind[own] == LPC], own[kind[own] == LPC]
    body = np.where(kind == CONSTANT, 1, np.where(kind == VERBATIM, n, (bits + 7) // 8))
    heads = [frame_header(int(a), int(b)) for a, b in zip(n, number, strict=True)]
    head = np.fromiter(map(len, heads), np.int64, len(heads))
    total = head + 1 + body + 2
    offset = np.cumsum(total) - total

    bit = np.zeros(8 * int(total.sum()), np.uint8)
    rows = np.flatnonzero((kind == FIXED) | (kind == LPC))
    if len(rows):
        at = 8 * (offset + head + 1 + order)
        for j, (value, width) in enumerate([(np.full(len(own), PRECISION - 1), 4), (shift, 5), *((factors[:, i], PRECISION) for i in range(ORDER))]):
            for i in range(width):
                bit[at[own] + i] = value >> (width - 1 - i) & 1
            at[own] += width
        at = at[rows]
        for j in range(4):
            bit[at + 6 + j] = rice[rows] >> (3 - j) & 1
        what_, take = u[rows], coded[rows]
        k = rice[rows]
        length = np.where(take, (what_ >> k[:, None].astype(np.uint16)).astype(np.int32) + 1 + k[:, None].astype(np.int32), 0)
        stop = (at + 10)[:, None] + np.cumsum(length, axis=1) - 1 - k[:, None]
        for value in np.unique(k):
            mine = k == value
            where, what = stop[mine][take[mine]], what_[mine][take[mine]]
            bit[where] = 1
            for j in range(int(value)):
                bit[where + 1 + j] = what >> np.uint16(value - 1 - j) & np.uint16(1)
    out = np.packbits(bit)
    del bit
    flat = np.frombuffer(b"".join(heads), np.uint8)
    out[np.repeat(offset - (np.cumsum(head) - head), head) + np.arange(len(flat))] = flat
    out[offset + head] = np.where(kind == CONSTANT, CONSTANT, np.where(kind == VERBATIM, VERBATIM, np.where(kind == FIXED, FIXED + order, LPC + order - 1))) << 1
    raw = s.astype(np.int8).view(np.uint8)
    first = offset + head + 1
    out[first[kind == CONSTANT]] = raw[kind == CONSTANT, 0]
    for j in range(min(4, raw.shape[1])):
        mine = ((kind == FIXED) | (kind == LPC)) & (order > j)
        out[first[mine] + j] = raw[mine, j]
    mine = np.flatnonzero(kind == VERBATIM)
    if len(mine):
        r, c = np.nonzero(inside[mine])
        out[first[mine][r] + c] = raw[mine[r], c]
    check = crc16(out, offset, total - 2)
    out[offset + total - 2], out[offset + total - 1] = check >> 8, check & 0xFF

    streams, ends = [], np.cumsum(per)
    for i, payload in enumerate(payloads):
        a, b = int(ends[i] - per[i]), int(ends[i])
        signed = np.frombuffer(payload, np.uint8) ^ np.uint8(128)  # b - 128 as a signed byte
        info = struct.pack(">HH", BLOCK, BLOCK) + int(total[a:b].min()).to_bytes(3, "big") + int(total[a:b].max()).to_bytes(3, "big") + (RATE << 44 | 0 << 41 | 7 << 36 | len(payload)).to_bytes(8, "big") + hashlib.md5(signed.tobytes()).digest()
        seek = np.zeros(b - a, SEEK_POINT)
        seek["sample"], seek["offset"], seek["n"] = number[a:b] * BLOCK, offset[a:b] - offset[a], n[a:b]
        end = int(offset[b - 1] + total[b - 1])
        streams.append(b"fLaC" + bytes([0]) + len(info).to_bytes(3, "big") + info + bytes([0x83]) + (18 * (b - a)).to_bytes(3, "big") + seek.tobytes() + out[offset[a] : end].tobytes())
    return streams


def parse(stream: bytes) -> tuple[dict, np.ndarray, int]:
    """STREAMINFO fields, the seek points (SEEK_POINT), and where frames begin."""
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, info, seek = 4, False, {}, np.zeros(0, SEEK_POINT)
    while not last:
        if at + 4 > len(stream):
            raise ValueError("the stream ends within its metadata")
        last, kind, size = bool(stream[at] & 0x80), stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        data = stream[at + 4 : at + 4 + size]
        at += 4 + size
        if kind == 0:
            packed = int.from_bytes(data[10:18], "big")
            info = {"block": int.from_bytes(data[2:4], "big"), "rate": packed >> 44, "channels": (packed >> 41 & 7) + 1, "bits": (packed >> 36 & 31) + 1, "samples": packed & (1 << 36) - 1, "md5": data[18:34]}
        elif kind == 3:
            table = np.frombuffer(data, SEEK_POINT, len(data) // SEEK_POINT.itemsize)
            seek = table[table["sample"] != 2**64 - 1]
    if info.get("bits") != 8 or info.get("channels") != 1:
        raise ValueError("only 8-bit mono streams are read")
    return info, seek, at


def read_header(data: bytes, at: int) -> tuple[int, int, int, int]:
    """(block size, number, first byte behind, 1 if the number is the first sample's and not the frame's); the CRC-8 is checked."""
    if at + 16 > len(data) + 8 or data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8:
        raise ValueError("no frame begins here")
    if data[at + 3] >> 4 or data[at + 3] >> 1 & 7 not in (0, 1):
        raise ValueError("only 8-bit mono frames are read")
    size, pos = data[at + 2] >> 4, at + 4
    lead = data[pos]
    more = 0 if lead < 0x80 else 7 - (lead ^ 0xFF).bit_length()  # leading ones but the first
    number = lead if lead < 0x80 else lead & (1 << (6 - more)) - 1
    for j in range(more):
        number = number << 6 | data[pos + 1 + j] & 0x3F
    pos += 1 + more
    if size == 6:
        n, pos = data[pos] + 1, pos + 1
    elif size == 7:
        n, pos = int.from_bytes(data[pos : pos + 2], "big") + 1, pos + 2
    else:
        n = 192 if size == 1 else 576 << (size - 2) if size < 6 else 256 << (size - 8)
    rate = data[at + 2] & 15
    pos += 1 if rate == 12 else 2 if rate in (13, 14) else 0
    if crc8(data[at:pos]) != data[pos]:
        raise ValueError("a frame header's checksum is wrong")
    return n, number, pos + 1, data[at + 1] & 1


def undo_linear(out: np.ndarray, n: np.ndarray, factors: np.ndarray, shift: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Samples from residuals behind ``order`` warm-up samples of each row, all rows in a step."""
    width = factors.shape[1]
    x = np.concatenate([np.zeros((len(out), width), np.int64), out], axis=1)
    back = factors[:, ::-1].astype(np.int64)
    for i in range(int(order.min(initial=0)), int(n.max(initial=0))):
        step = (x[:, i : i + width] * back).sum(axis=1) >> shift
        x[:, i + width] += step if i >= width else np.where(order <= i, step, 0)
    return x[:, width:]


class Bits:
    """Reads bit fields of one subframe, for what the vectorised reader leaves out."""

    def __init__(self, data: bytes, at: int) -> None:
        self.data, self.at = data, at

    def unsigned(self, width: int) -> int:
        first, last = self.at >> 3, self.at + width + 7 >> 3
        if last > len(self.data):
            raise ValueError("a frame ends too early")
        value = int.from_bytes(self.data[first:last], "big") >> (8 * last - self.at - width) & (1 << width) - 1
        self.at += width
        return value

    def signed(self, width: int) -> int:
        value = self.unsigned(width)
        return value - (1 << width) if width and value >> (width - 1) else value

    def unary(self) -> int:
        count = 0
        while not self.unsigned(1):
            count += 1
        return count


def subframe(data: bytes, pos: int, n: int) -> tuple[list[int], int]:
    """Samples of any mono subframe of 8 bits (with wasted bits, too), and the byte behind it; one by one."""
    bits = Bits(data, 8 * pos)
    bits.unsigned(1)
    kind, wasted = bits.unsigned(6), bits.unsigned(1)
    wasted = bits.unary() + 1 if wasted else 0
    depth = 8 - wasted
    if depth < 1:
        raise ValueError("more bits are wasted than there are")
    if kind == CONSTANT:
        x = [bits.signed(depth)] * n
    elif kind == VERBATIM:
        x = [bits.signed(depth) for _ in range(n)]
    else:
        order = kind - FIXED if kind < LPC else kind - LPC + 1
        x = [bits.signed(depth) for _ in range(order)]
        factors, shift = PREDICT[order] if kind < LPC else (), 0
        if kind >= LPC:
            precision, shift = bits.unsigned(4) + 1, bits.signed(5)
            if precision == 16 or shift < 0:
                raise ValueError("an invalid linear predictor")
            factors = [bits.signed(precision) for _ in range(order)]
        method, parts = bits.unsigned(2), 1 << bits.unsigned(4)
        if method > 1 or n % parts or n // parts < order:
            raise ValueError("an invalid residual")
        for part in range(parts):
            k = bits.unsigned(4 + method)
            raw = bits.unsigned(5) if k == 15 + 16 * method else None
            while len(x) < n // parts * (part + 1):
                if raw is None:
                    v = bits.unary() << k
                    v |= bits.unsigned(k)
                    v = v >> 1 ^ -(v & 1)
                else:
                    v = bits.signed(raw)
                x.append(v + (sum(c * x[-1 - j] for j, c in enumerate(factors)) >> shift))
    return [v << wasted for v in x], bits.at + 7 >> 3


def decode_frames(data: np.ndarray, raw: bytes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Samples (a row for each frame), block sizes, numbers and what they count, and ends of the frames that begin at ``at``."""
    heads = [read_header(raw, int(x)) for x in at]
    n, number, pos, counts = (np.array([h[j] for h in heads], np.int64) for j in range(4))
    if (pos >= len(data)).any():
        raise ValueError("a frame ends too early")
    kind = data[pos].astype(np.int64) >> 1 & 63
    if (data[pos] & 0x80).any():
        raise ValueError("a subframe header is damaged")
    fixed, lpc = (kind >= FIXED) & (kind <= FIXED + 4), kind >= LPC
    if not (fixed | lpc | (kind <= VERBATIM)).all():
        raise ValueError("a reserved subframe type")
    out = np.zeros((len(at), int(n.max())), np.int32)
    end = np.zeros(len(at), np.int64)
    pad = np.concatenate([data, np.zeros(16, np.uint8)])
    signed = pad.view(np.int8)

    def read(where: np.ndarray, width: np.ndarray) -> np.ndarray:
        """Up to 16 bits at bit positions."""
        byte = where >> 3
        if len(byte) and int(byte.max()) + 2 >= len(pad):
            raise ValueError("a frame ends too early")
        word = pad[byte].astype(np.int64) << 16 | pad[byte + 1].astype(np.int64) << 8 | pad[byte + 2]
        return word >> (24 - (where & 7) - width) & (1 << width) - 1

    order = np.where(fixed, kind - FIXED, kind - LPC + 1)
    p = 8 * (pos + 1 + order)
    # wasted bits, and residuals that begin otherwise than with 4-bit parameters, are read one by one; so are escaped ones below
    odd = data[pos] & 1 == 1
    plain = fixed | lpc
    factors, shift = np.zeros((len(at), int(order[lpc].max(initial=0))), np.int64), np.zeros(len(at), np.int64)
    if lpc.any():
        rows = np.flatnonzero(lpc & ~odd)
        precision, shift[rows] = read(p[rows], np.full(len(rows), 4)) + 1, read(p[rows] + 4, np.full(len(rows), 5))
        if (precision == 16).any() or (shift[rows] > 15).any():
            raise ValueError("an invalid linear predictor")
        p[rows] += 9
        for j in range(factors.shape[1]):
            mine = order[rows] > j
            value = read(p[rows[mine]], precision[mine])
            factors[rows[mine], j] = value - (value >> (precision[mine] - 1) << precision[mine])
            p[rows[mine]] += precision[mine]
    rows = np.flatnonzero(plain & ~odd)
    odd[rows] |= read(p[rows], np.full(len(rows), 2)) != 0

    rows = np.flatnonzero((kind == CONSTANT) & ~odd)
    out[rows] = signed[pos[rows] + 1][:, None]
    end[rows] = pos[rows] + 2
    for r in np.flatnonzero((kind == VERBATIM) & ~odd):
        if pos[r] + 1 + n[r] > len(data):
            raise ValueError("a frame ends too early")
        out[r, : n[r]] = signed[pos[r] + 1 : pos[r] + 1 + n[r]]
        end[r] = pos[r] + 1 + n[r]
    rows = np.flatnonzero(plain & ~odd)
    if len(rows):
        for j in range(int(order[rows].max())):
            mine = rows[order[rows] > j]
            out[mine, j] = signed[np.minimum(pos[mine] + 1 + j, len(pad) - 1)]
        odd[rows] |= residuals(pad, read, at, rows, n, order, p, out, end)
        for o in range(1, 5):  # undo the fixed predictors: sums of sums, with the warm-up samples as starts
            mine = np.flatnonzero(fixed & ~odd & (order == o))
            if not len(mine):
                continue
            x = out[mine]
            starts = [x[:, :o].astype(np.int64)]
            for _ in range(o - 1):
                starts.append(np.diff(starts[-1], axis=1))
            run = x[:, o:]
            for level in range(o - 1, -1, -1):
                run = np.cumsum(run, axis=1, dtype=np.int32) + starts[level][:, -1:].astype(np.int32)
            out[mine, o:] = run
        mine = np.flatnonzero(lpc & ~odd)
        if len(mine):
            out[mine] = undo_linear(out[mine], n[mine], factors[mine], shift[mine], order[mine])
    for r in np.flatnonzero(odd):
        own, end[r] = subframe(raw, int(pos[r]), int(n[r]))
        out[r, : n[r]] = own
    if (end + 2 > len(data)).any():
        raise ValueError("a frame ends too early")
    return out, n, number, counts, end


def residuals(pad: np.ndarray, read, at: np.ndarray, rows: np.ndarray, n: np.ndarray, order: np.ndarray, p: np.ndarray, out: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Writes the Rice-coded residuals of the frames ``rows`` into ``out`` and where they end into ``end``; True for frames with escaped partitions."""
    p = p[rows]
    parts = np.left_shift(1, read(p + 2, np.full(len(p), 4)))
    if (n[rows] % parts).any() or (n[rows] // parts < order[rows]).any():
        raise ValueError("an invalid residual")
    p = p + 6
    # where the next 1 is, from every bit on
    lo, hi = int(p.min()) // 8, min(len(pad), int(at.max()) + 16 * int(n.max()) + 64)
    own = np.unpackbits(pad[lo:hi])
    ones = np.where(own, np.arange(len(own), dtype=np.int32), np.int32(2**31 - 1))
    ones = np.minimum.accumulate(ones[::-1])[::-1]
    base = 8 * lo
    k, escaped = np.zeros(len(rows), np.int64), np.zeros(len(rows), bool)
    size, take_from = n[rows] // parts, order[rows]
    by = np.argsort(-n[rows], kind="stable")  # rows whose block has ended are at the back
    to, p, size, take_from = rows[by], p[by], size[by], take_from[by]
    left, lengths, most = len(to), n[rows][by], int(order[rows].max())
    single = bool((parts == 1).all())
    for i in range(int(lengths[0])):
        while left and lengths[left - 1] <= i:
            left -= 1
        live = slice(0, left)
        if i == 0 or not single:
            fresh = (i % size[live] == 0) & ~escaped[live]
            if fresh.any():
                k[:left] = np.where(fresh, read(p[live], np.full(left, 4)), k[live])
                p[:left] += np.where(fresh, 4, 0)
                escaped[:left] |= k[live] == 15
        where = p[live] - base
        if (where >= len(ones)).any():
            raise ValueError("a frame ends too early")
        stop = ones[where].astype(np.int64) + base
        width = k[live]
        ended = (stop + 1 + width >= 8 * len(pad)) & ~escaped[live]
        if ended.any():
            raise ValueError("a frame ends too early")
        stop = np.where(escaped[live], p[live], stop)
        value = (stop - p[live]) << width | np.where(width > 0, read(stop + 1, width), 0)
        value = value >> 1 ^ -(value & 1)
        go = take_from[live] <= i if i < most else slice(None)
        out[to[live][go], i] = value[go]
        after = np.where(escaped[live], p[live], stop + 1 + width)
        p[:left] = np.where(go, after, p[live]) if i < most else after
    end[to] = (p + 7) // 8
    odd = np.empty(len(rows), bool)
    odd[by] = escaped
    return odd


def walk(data: np.ndarray, raw: bytes, starts: np.ndarray, stops: np.ndarray) -> list[tuple[int, int, int, int, bytes, int]]:
    """(position, end, number, what it counts, samples, block size) of all frames from ``starts`` on, up to their ``stops``.

    Every round reads one frame at each place where one is known to begin.
    """
    found, known = [], set()
    now = sorted({(int(a), int(b)) for a, b in zip(starts, stops, strict=True) if a < b})
    while now:
        known.update(a for a, _ in now)
        at = np.array([a for a, _ in now], np.int64)
        out, n, number, counts, end = decode_frames(data, raw, at)
        if (crc16(data, at, end - at) != (data[end].astype(np.uint32) << 8 | data[end + 1])).any():
            raise ValueError("a frame's checksum is wrong")
        pcm = (out + 128).astype(np.uint8)
        found += [(int(at[r]), int(end[r]) + 2, int(number[r]), int(counts[r]), pcm[r, : n[r]].tobytes(), int(n[r])) for r in range(len(at))]
        now = sorted({(f[1], stop) for f, (_, stop) in zip(found[-len(at) :], now, strict=True) if f[1] < stop and f[1] not in known})
    return sorted(found)


def first_sample(info: dict, number: int, counts: int) -> int:
    """Where a frame's samples begin by its own header."""
    return number if counts else number * info["block"]


def decode(streams: list[bytes]) -> list[list[tuple[int, bytes]]]:
    """PCM blocks of each stream: (first sample, unsigned 8-bit samples). All checksums and offsets are checked."""
    parsed = [parse(s) for s in streams]
    base = np.cumsum([0, *map(len, streams)])
    whole = b"".join(streams)
    starts, stops = [], []
    for i, (_, seek, body) in enumerate(parsed):
        points = np.union1d(body, body + seek["offset"].astype(np.int64)) + base[i]
        if points[0] < base[i] + body or points[-1] > base[i + 1]:
            raise ValueError("a seek point is outside the frames")
        starts.append(points), stops.append(np.full(len(points), base[i + 1]))
    frames = walk(np.frombuffer(whole, np.uint8), whole, np.concatenate(starts), np.concatenate(stops)) if streams else []
    found: list[list[tuple[int, bytes]]] = [[] for _ in streams]
    k = 0
    for i, (info, seek, body) in enumerate(parsed):
        at, sample, begins = int(base[i]) + body, 0, {}
        while at < base[i + 1]:
            if k == len(frames) or frames[k][0] != at or first_sample(info, *frames[k][2:4]) != sample:
                raise ValueError("frames or seek points are not where they should be")
            _, end, _, _, pcm, n = frames[k]
            begins[at] = sample
            found[i].append((sample, pcm))
            at, sample, k = end, sample + n, k + 1
        if any(begins.get(int(base[i]) + body + int(p["offset"])) != int(p["sample"]) for p in seek):
            raise ValueError("a seek point is wrong")
        pcm = b"".join(b for _, b in found[i])
        if info["samples"] not in (0, len(pcm)) or info["md5"] not in (bytes(16), hashlib.md5((np.frombuffer(pcm, np.uint8) ^ np.uint8(128)).tobytes()).digest()):
            raise ValueError("the samples do not have the stream's length or MD5")
    return found


def samples_at(stream: bytes, first: int, count: int) -> bytes:
    """Up to ``count`` samples from sample ``first`` on. Only the frames from the seek point before them are read."""
    info, seek, body = parse(stream)
    before = seek[seek["sample"] <= max(first, 0)]
    at = body + int(before["offset"][-1]) if len(before) else body
    data, out = np.frombuffer(stream, np.uint8), []
    first, last = max(first, 0), max(first, 0) + max(count, 0)
    while at < len(stream):
        ((_, end, number, counts, pcm, n),) = walk(data, stream, np.array([at]), np.array([at + 1]))
        sample = first_sample(info, number, counts)
        if sample >= last:
            break
        out.append(pcm[max(0, first - sample) : max(0, last - sample)])
        at = end
    return b"".join(out)


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Length of the text in bytes, and the bytes filled up with zeros to a positive multiple of ALIGN."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(-len(raw) % ALIGN if raw else ALIGN)


def features(payload: bytes) -> str:
    """Mean, root mean square, peak and rate of sign changes of the samples."""
    x = np.frombuffer(payload, np.uint8).astype(np.int16) - np.int16(128)
    sign = x < 0
    return f"samples={len(x)};mean={x.mean():.4f};rms={np.sqrt((x.astype(np.int32) ** 2).mean()):.4f};peak={int(np.abs(x).max())};crossings={np.count_nonzero(sign[1:] != sign[:-1]) / max(1, len(x) - 1):.4f}"


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (binary FLAC stream) of every text."""
    ship_package(docs.sparkSession)

    def run(batches):
        for rest, texts in chunks(batches, limit=1_500_000):
            made = [payload_of(t) for t in texts]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(rest["doc_id"], pa.int64()), "n_bytes": pa.array([n for n, _ in made], pa.int64()), "media": pa.array(encode([p for _, p in made]), pa.binary())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def blocks(media: DataFrame) -> DataFrame:
    """doc_id, block, first_sample, samples, pcm (binary): the PCM blocks of stored streams, by their sample offsets."""
    ship_package(media.sparkSession)

    def run(batches):
        for rest, streams in chunks(batches, "media", limit=1_500_000):
            out = [(d, k, first, len(pcm), pcm) for d, own in zip(rest["doc_id"], decode(streams), strict=True) for k, (first, pcm) in enumerate(own)]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate(kinds)], ["doc_id", "block", "first_sample", "samples", "pcm"])

    return media.select(F.col("doc_id").cast("long").alias("doc_id"), "media").mapInArrow(run, "doc_id long, block int, first_sample long, samples int, pcm binary")


def spans(media: DataFrame, first: Column, count: Column) -> DataFrame:
    """doc_id, first_sample, pcm (binary): of each stored stream, up to ``count`` samples from sample ``first`` on.

    Only the frames of the span are read. A null first or count gives no bytes.
    """
    ship_package(media.sparkSession)

    def run(batches):
        for rest, streams in chunks(batches, "media", limit=1_500_000):
            pcm = [samples_at(m, a or 0, c or 0) if m is not None else b"" for m, a, c in zip(streams, rest["first_sample"], rest["n"], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(rest["doc_id"], pa.int64()), pa.array(rest["first_sample"], pa.int64()), pa.array(pcm, pa.binary())], ["doc_id", "first_sample", "pcm"])

    return media.select(F.col("doc_id").cast("long").alias("doc_id"), first.cast("long").alias("first_sample"), count.cast("long").alias("n"), "media").mapInArrow(run, "doc_id long, first_sample long, pcm binary")


def digest(media: DataFrame) -> DataFrame:
    """Reads every stored stream back and gives the digests and features of its samples."""
    ship_package(media.sparkSession)

    def run(batches):
        for rest, streams in chunks(batches, "media", limit=1_500_000):
            pcm = [b"".join(b for _, b in own) for own in decode(streams)]
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(rest["doc_id"], pa.int64()),
                "n_bytes": pa.array(rest["n_bytes"], pa.int64()),
                "payload_bytes": pa.array(list(map(len, pcm)), pa.int64()),
                "payload_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in pcm], pa.string()),
                "tail_crc32": pa.array([zlib.crc32(x[-ALIGN:]) for x in pcm], pa.int64()),
                "media_bytes": pa.array(list(map(len, streams)), pa.int64()),
                "media_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in streams], pa.string()),
                "feature": pa.array(list(map(features, pcm)), pa.string()),
            })

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
