"""What the bytes of one audio file say of its sound: samples of WAV and FLAC files, headers of MP3, Ogg and MP4 files.

Each function raises ValueError where the bytes aren't what they should be; ``sound_of`` says which formats there are.
"""

from __future__ import annotations

import hashlib
import io
import struct
import wave
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np


class Sound(NamedTuple):
    """stream: hash of the samples as 16-bit integers (WAV, FLAC) or of the coded sound without its tags (MP3, Ogg, MP4)."""

    stream: str
    seconds: float
    rate: int
    channels: int
    bitrate: int


#: Frames of a FLAC file that are decoded together.
FRAMES = 256


def _after_id3(data: bytes) -> int:
    if data[:3] == b"ID3" and len(data) >= 10:
        return 10 + ((data[6] & 127) << 21 | (data[7] & 127) << 14 | (data[8] & 127) << 7 | data[9] & 127)
    return 0


def _sixteen(samples: np.ndarray, bits: int) -> np.ndarray:
    """Samples of so many bits as 16-bit integers: high bits are kept."""
    return (samples >> (bits - 16) if bits > 16 else samples << (16 - bits)).astype("<i2")


# WAV


def wav_sound(data: bytes) -> Sound:
    """A RIFF file of integer samples."""
    try:
        with wave.open(io.BytesIO(data)) as sound:
            width, rate, channels, n = sound.getsampwidth(), sound.getframerate(), sound.getnchannels(), sound.getnframes()
            raw = sound.readframes(n)
    except (wave.Error, EOFError, struct.error) as fault:
        raise ValueError(str(fault)) from fault
    if not rate or not 1 <= width <= 4:
        raise ValueError("no rate, or samples of an unknown width")
    if width != 2:
        each = np.frombuffer(raw[: len(raw) // width * width], np.uint8).reshape(-1, width).astype(np.int64)
        value = (each << (8 * np.arange(width))).sum(1)
        value = value - 128 if width == 1 else value - ((value >> (8 * width - 1)) << (8 * width))
        raw = _sixteen(value, 8 * width).tobytes()
    return Sound(hashlib.md5(raw).hexdigest(), n / rate, rate, channels, 8 * width * channels * rate)


# FLAC


def _crc8(data: bytes) -> int:
    crc = 0
    for byte in data:
        crc = _CRC8[crc ^ byte]
    return crc


def _crc8_of(byte: int) -> int:
    for _ in range(8):
        byte = (byte << 1 ^ 0x07) & 255 if byte & 128 else byte << 1
    return byte


_CRC8 = [_crc8_of(byte) for byte in range(256)]


class _Bits:
    """Bits of a frame, read one after the other."""

    def __init__(self, data: bytes):
        self.text = format(int.from_bytes(b"\1" + data, "big"), "b")[1:]
        self.each = np.frombuffer(self.text.encode(), np.uint8) - 48
        self.at = 0

    def number(self, n: int) -> int:
        self.at += n
        if self.at > len(self.text):
            raise ValueError("the file ends within a frame")
        return int(self.text[self.at - n : self.at], 2) if n else 0

    def signed(self, n: int) -> int:
        value = self.number(n)
        return value - (1 << n) if n and value >> (n - 1) else value

    def unary(self) -> int:
        one = self.text.find("1", self.at)
        if one < 0:
            raise ValueError("the file ends within a frame")
        zeros, self.at = one - self.at, one + 1
        return zeros

    def fields(self, starts: np.ndarray, n: int) -> np.ndarray:
        """Numbers of n bits at these places."""
        if len(starts) and starts[-1] + n > len(self.each):
            raise ValueError("the file ends within a frame")
        return self.each[starts[:, None] + np.arange(n)].astype(np.int64) @ (1 << np.arange(n - 1, -1, -1, dtype=np.int64))

    def signed_fields(self, count: int, n: int) -> np.ndarray:
        """The next numbers, of n bits each, with a sign."""
        value = self.fields(self.at + n * np.arange(count), n) if n and count else np.zeros(count, np.int64)
        self.at += n * count
        return value - (value >> max(0, n - 1) << n) if n else value

    def rice(self, count: int, k: int) -> np.ndarray:
        """The next residuals of a partition with this parameter."""
        find, text, at, step, stops = self.text.find, self.text, self.at, 1 + k, []
        for _ in range(count):
            at = text.find("1", at)
            if at < 0:
                raise ValueError("the file ends within a frame")
            stops.append(at)
            at += step
        ones = np.array(stops, np.int64)
        high = np.diff(ones, prepend=self.at - step) - step
        value = (high << k) + (self.fields(ones + 1, k) if k else 0)
        self.at = at
        return (value >> 1) ^ -(value & 1)


class _Subframe(NamedTuple):
    """Samples once predictions are added: each sample is its residual and the weighted sum of those before it, shifted down."""

    first: np.ndarray
    weights: np.ndarray
    shift: int
    rest: np.ndarray
    wasted: int


def _residual(bits: _Bits, size: int, order: int) -> np.ndarray:
    wide = bits.number(2)
    if wide > 1:
        raise ValueError("residuals of an unknown kind")
    parts = bits.number(4)
    width, each, out = 4 + wide, size >> parts, []
    if each < order or each << parts != size:
        raise ValueError("partitions that don't divide a frame")
    for part in range(1 << parts):
        k, count = bits.number(width), each - (0 if part else order)
        out.append(bits.signed_fields(count, bits.number(5)) if k == (1 << width) - 1 else bits.rice(count, k))
    return np.concatenate(out)


#: Fixed values of the format: weights of the fixed predictors, nearest sample first.
_FIXED = ([], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1])


def _subframe(bits: _Bits, size: int, depth: int) -> _Subframe:
    if bits.number(1):
        raise ValueError("no subframe")
    kind, wasted = bits.number(6), 0
    if bits.number(1):
        wasted = 1 + bits.unary()
    depth -= wasted
    none = np.zeros(0, np.int64)
    if depth < 1:
        raise ValueError("no bits are left")
    if kind == 0:
        return _Subframe(np.full(size, bits.signed(depth)), none, 0, none, wasted)
    if kind == 1:
        return _Subframe(bits.signed_fields(size, depth), none, 0, none, wasted)
    if 8 <= kind <= 12 and kind - 8 <= size:
        first = bits.signed_fields(kind - 8, depth)
        return _Subframe(first, np.array(_FIXED[kind - 8], np.int64), 0, _residual(bits, size, kind - 8), wasted)
    if kind >= 32 and kind - 31 <= size:
        order = kind - 31
        first, precision = bits.signed_fields(order, depth), bits.number(4) + 1
        shift = bits.signed(5)
        if precision == 16 or shift < 0:
            raise ValueError("a predictor of an unknown kind")
        return _Subframe(first, bits.signed_fields(order, precision), shift, _residual(bits, size, order), wasted)
    raise ValueError("a subframe of an unknown kind")


def _predicted(subframes: list[_Subframe]) -> list[np.ndarray]:
    """Their samples; those of one length and order go on side by side, sample after sample."""
    out: list[np.ndarray | None] = [None] * len(subframes)
    alike: dict[tuple[int, int], list[int]] = {}
    for k, s in enumerate(subframes):
        alike.setdefault((len(s.rest), len(s.weights)), []).append(k)
    for (length, order), where in alike.items():
        x = np.zeros((order + length, len(where)), np.int64)
        if order and length:
            rest = np.stack([subframes[k].rest for k in where], 1)
            x[:order] = np.stack([subframes[k].first for k in where], 1)
            weights = np.ascontiguousarray(np.stack([subframes[k].weights for k in where], 1)[::-1])
            shift = np.array([subframes[k].shift for k in where])
            for t in range(length):
                x[order + t] = rest[t] + (np.einsum("of,of->f", x[t : t + order], weights) >> shift)
        for column, k in enumerate(where):
            s = subframes[k]
            samples = x[:, column] if order and length else np.concatenate([s.first, s.rest])
            out[k] = samples << s.wasted
    return out


class _Frame(NamedTuple):
    channels: int
    side: int
    depth: int
    subframes: list[_Subframe]


def _frame(data: bytes, at: int, depth: int, most: int) -> tuple[_Frame, int]:
    """The frame that begins at a byte, and where it ends."""
    head = data[at : at + 16]
    if len(head) < 6 or head[0] != 0xFF or head[1] & 0xFE != 0xF8:
        raise ValueError("no frame")
    code, rate, layout, width = head[2] >> 4, head[2] & 15, head[3] >> 4, head[3] >> 1 & 7
    number = 1 if head[4] < 128 else 8 - (head[4] ^ 255).bit_length()
    end = 4 + number
    if not code or layout > 10 or width == 3:
        raise ValueError("a frame of an unknown kind")
    if code in (6, 7):
        size, end = int.from_bytes(head[end : end + code - 5], "big") + 1, end + code - 5
    else:
        size = 192 if code == 1 else 576 << code - 2 if code < 6 else 256 << code - 8
    end += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if data[at + end : at + end + 1] != bytes([_crc8(head[:end])]):
        raise ValueError("a frame's header is damaged")
    depth = {0: depth, 1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}[width]
    channels = layout + 1 if layout < 8 else 2
    bits = _Bits(data[at + end + 1 : at + end + 1 + (most or 64 + size * channels * (depth + 2) // 4)])
    side = {8: 1, 9: 0, 10: 1}.get(layout, -1)
    subframes = [_subframe(bits, size, depth + (c == side)) for c in range(channels)]
    return _Frame(channels, layout, depth, subframes), at + end + 1 + -(-bits.at // 8) + 2


def _samples(frames: list[_Frame]) -> Iterator[np.ndarray]:
    """Samples x channels of each frame."""
    all_ = iter(_predicted([s for f in frames for s in f.subframes]))
    for f in frames:
        x = [next(all_) for _ in f.subframes]
        if f.side == 8:
            x[1] = x[0] - x[1]
        elif f.side == 9:
            x[0] = x[0] + x[1]
        elif f.side == 10:
            middle = (x[0] << 1) + (x[1] & 1)
            x = [(middle + x[1]) >> 1, (middle - x[1]) >> 1]
        yield np.stack(x, 1)


def flac_sound(data: bytes) -> Sound:
    """A FLAC file, decoded from its first frame to its last."""
    at = _after_id3(data)
    if data[at : at + 4] != b"fLaC" or len(data) < at + 42 or data[at + 4] & 127:
        raise ValueError("no stream information")
    about = data[at + 8 : at + 42]
    packed = int.from_bytes(about[10:18], "big")
    most, rate, channels, depth, total = int.from_bytes(about[7:10], "big"), packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1
    if not rate:
        raise ValueError("no rate")
    at += 4
    while True:
        if at + 4 > len(data):
            raise ValueError("no frames")
        last, at = data[at] & 128, at + 4 + int.from_bytes(data[at + 1 : at + 4], "big")
        if last:
            break
    begun, stream, seen, held = at, hashlib.md5(), 0, []
    while at < len(data) and data[at : at + 3] != b"TAG":
        frame, at = _frame(data, at, depth, most)
        if frame.channels != channels:
            raise ValueError("channels that come or go")
        held.append(frame)
        if len(held) == FRAMES or at >= len(data) or data[at : at + 3] == b"TAG":
            for f, x in zip(held, _samples(held), strict=True):
                stream.update(_sixteen(x, f.depth).tobytes())
                seen += len(x)
            held = []
    if not seen or total > seen:
        raise ValueError("samples are missing")
    return Sound(stream.hexdigest(), seen / rate, rate, channels, int(8 * (at - begun) * rate / seen))


# MP3

#: Fixed values of the format: kbit/s of layer III by version (1, or 2 and 2.5) and index; rates of version 1 by index.
_KBITS = {1: (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), 2: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)}
_RATES = (44_100, 48_000, 32_000)


def _mp3_frame(data: bytes, at: int) -> tuple[int, int, int, int, int] | None:
    """(bytes, samples, rate, channels, kbit/s) of the layer III frame that begins there."""
    head = data[at : at + 4]
    if len(head) < 4 or head[0] != 0xFF or head[1] & 0xE6 != 0xE2 or head[1] >> 3 & 3 == 1:
        return None
    index, slow = head[2] >> 4, {3: 0, 2: 1, 0: 2}[head[1] >> 3 & 3]
    if index in (0, 15) or head[2] >> 2 & 3 == 3:
        return None
    kbits, rate = _KBITS[1 if not slow else 2][index], _RATES[head[2] >> 2 & 3] >> slow
    return (72 if slow else 144) * 1000 * kbits // rate + (head[2] >> 1 & 1), 576 if slow else 1152, rate, 1 if head[3] >> 6 == 3 else 2, kbits


def mp3_sound(data: bytes) -> Sound:
    """The frames of an MP3 file, one after the other; an encoder's first frame of information isn't sound."""
    at = min(_after_id3(data), len(data))
    limit = min(len(data), at + (1 << 16))
    while True:  # the first of two frames in a row, or of one that ends the file or stands before a tag
        at = data.find(b"\xff", at, limit)
        if at < 0:
            raise ValueError("no frame")
        frame = _mp3_frame(data, at)
        follows = at + frame[0] if frame else 0
        after = _mp3_frame(data, follows) if frame else None
        if frame and (after and after[1:3] == frame[1:3] or follows == len(data) or data[follows : follows + 3] == b"TAG" or data[follows : follows + 8] == b"APETAGEX"):
            break
        at += 1
    slow, mono = frame[1] == 576, frame[3] == 1
    tag = at + 4 + ((9 if mono else 17) if slow else (17 if mono else 32))
    if data[tag : tag + 4] in (b"Xing", b"Info") or data[at + 36 : at + 40] == b"VBRI":
        at += frame[0]
    stream, samples, size, kinds, first = hashlib.md5(), 0, 0, set(), frame
    while (frame := _mp3_frame(data, at)) and frame[1:3] == first[1:3] and at + frame[0] <= len(data):
        stream.update(data[at : at + frame[0]])
        samples, size, at = samples + frame[1], size + frame[0], at + frame[0]
        kinds.add(frame[4])
    if not samples:
        raise ValueError("no whole frame")
    seconds = samples / first[2]
    return Sound(stream.hexdigest(), seconds, first[2], first[3], 1000 * kinds.pop() if len(kinds) == 1 else int(8 * size / seconds))


# Ogg


def ogg_packets(data: bytes) -> Iterator[tuple[bytes, int]]:
    """(packet, last granule of its page) of the first logical stream."""
    at, serial, held = 0, None, b""
    while data[at : at + 4] == b"OggS" and at + 27 <= len(data):
        granule, of = struct.unpack_from("<qI", data, at + 6)
        sizes = data[at + 27 : at + 27 + data[at + 26]]
        at += 27 + len(sizes)
        serial = of if serial is None else serial
        for size in sizes:
            if of == serial:
                held += data[at : at + size]
                if size < 255:
                    yield held, granule
                    held = b""
            at += size


def ogg_sound(data: bytes) -> Sound:
    """A Vorbis or Opus stream, by its headers and last page."""
    packets = ogg_packets(data)
    head = next(packets, (b"", 0))[0]
    if head[:7] == b"\x01vorbis" and len(head) >= 30:
        channels, rate, _, nominal = struct.unpack_from("<BIii", head, 11)
        headers, skipped, wanted = 2, 0, max(0, nominal)
    elif head[:8] == b"OpusHead" and len(head) >= 19:
        channels, skipped = struct.unpack_from("<BH", head, 9)
        headers, rate, wanted = 1, 48_000, 0
    else:
        raise ValueError("no stream of a known kind")
    stream, size, last = hashlib.md5(), 0, 0
    for k, (packet, granule) in enumerate(packets):
        if k >= headers:
            stream.update(packet)
            size, last = size + len(packet), max(last, granule)
    if not rate or last <= skipped:
        raise ValueError("no sound")
    seconds = (last - skipped) / rate
    return Sound(stream.hexdigest(), seconds, rate, channels, wanted or int(8 * size / seconds))


# MP4

_INNER = (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"udta", b"ilst")


def mp4_atoms(data: bytes, low: int = 0, high: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path of names, start, end) of the atoms' bodies, an atom before those in it."""
    at, high = low, len(data) if high is None else high
    while at + 8 <= high:
        size, name, head = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8], 8
        if size == 1:
            size, head = int.from_bytes(data[at + 8 : at + 16], "big"), 16
        end = high if size == 0 else at + size
        if end < at + head or end > high:
            return
        yield (*path, name), at + head, end
        if name in _INNER or path[-1:] == (b"ilst",):
            yield from mp4_atoms(data, at + head, end, (*path, name))
        elif name == b"meta":
            yield from mp4_atoms(data, at + head + 4, end, (*path, name))
        at = end


def mp4_sound(data: bytes) -> Sound:
    """The sound track of an MP4 file, by its headers."""
    if data[4:8] != b"ftyp":
        raise ValueError("no MP4 file")
    stream, size, found, track = hashlib.md5(), 0, {}, {}
    for path, a, b in mp4_atoms(data):
        if path[-1] == b"trak":
            track = {}
        elif path[-1] == b"mdat":
            stream.update(data[a:b])
            size += b - a
        elif path[-1] == b"mdhd" and b - a >= 24:
            track["time"] = struct.unpack_from(">IQ", data, a + 20) if data[a] == 1 and b - a >= 32 else struct.unpack_from(">II", data, a + 12)
        elif path[-1] == b"hdlr" and data[a + 8 : a + 12] == b"soun":
            track["sound"] = True
        elif path[-1] == b"stsd" and b - a >= 44:
            track["kind"] = (int.from_bytes(data[a + 32 : a + 34], "big"), int.from_bytes(data[a + 40 : a + 42], "big"))
        if not found and len(track) == 3:
            found = dict(track)
    if not found or not found["time"][0] or not found["time"][1]:
        raise ValueError("no sound track")
    seconds = found["time"][1] / found["time"][0]
    return Sound(stream.hexdigest(), seconds, found["kind"][1] or found["time"][0], found["kind"][0], int(8 * size / seconds))


def sound_of(data: bytes) -> Sound:
    """The sound of a file, whose format its first bytes tell."""
    first = data[_after_id3(data) :][:4]
    if first == b"fLaC":
        return flac_sound(data)
    if data[:4] == b"RIFF":
        return wav_sound(data)
    if data[:4] == b"OggS":
        return ogg_sound(data)
    if data[4:8] == b"ftyp":
        return mp4_sound(data)
    return mp3_sound(data)
