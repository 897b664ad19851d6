"""Sound of files that the tests write themselves: samples of WAV and FLAC, headers of MP3, Ogg and MP4; damaged files."""

import hashlib
import random
import struct

import numpy as np
import pytest

from tessera.sources import audio, media


class Writer:
    def __init__(self):
        self.bits = ""

    def put(self, value, n):
        if n:
            self.bits += format(value & ((1 << n) - 1), f"0{n}b")

    def unary(self, n):
        self.bits += "0" * n + "1"

    def data(self):
        bits = self.bits + "0" * (-len(self.bits) % 8)
        return int(bits, 2).to_bytes(len(bits) // 8, "big") if bits else b""


def residual(w, values, order, parts, rng):
    """Rice partitions, now and then one of plain numbers."""
    wide = rng.randint(0, 1)
    w.put(wide, 2)
    w.put(parts, 4)
    each = (len(values) + order) >> parts
    at = 0
    for p in range(1 << parts):
        part = values[at : at + each - (0 if p else order)]
        at += len(part)
        mean = sum(abs(v) for v in part) / max(1, len(part))
        k = max(0, int(mean).bit_length() + rng.randint(-1, 1))
        if k > 13 or rng.random() < 0.15:
            n = 0 if not any(part) else 1 + max(v.bit_length() for v in part)
            if n < 32:
                w.put(15 + 16 * wide, 4 + wide)
                w.put(n, 5)
                for v in part:
                    w.put(v, n)
                continue
        k = min(k, 14)
        w.put(k, 4 + wide)
        for v in part:
            u = 2 * v if v >= 0 else -2 * v - 1
            w.unary(u >> k)
            w.put(u, k)


FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]


def subframe(w, x, depth, rng):
    wasted = 0
    while any(x) and all(v % 2 == 0 for v in x):
        x, wasted = [v // 2 for v in x], wasted + 1
    depth -= wasted
    kind = rng.choice(["verbatim", "fixed", "lpc", "lpc"]) if len(set(x)) > 1 else "constant"
    order = min(len(x), rng.randint(0, 4) if kind == "fixed" else rng.randint(1, 12))
    parts = max(p for p in range(5) if len(x) % (1 << p) == 0 and len(x) >> p >= order)
    code = {"constant": 0, "verbatim": 1, "fixed": 8 + order, "lpc": 31 + order}[kind]
    w.put(0, 1), w.put(code, 6), w.put(wasted > 0, 1)
    if wasted:
        w.unary(wasted - 1)
    if kind == "constant":
        w.put(x[0], depth)
        return
    if kind == "verbatim":
        for v in x:
            w.put(v, depth)
        return
    for v in x[:order]:
        w.put(v, depth)
    weights, shift = FIXED[order] if kind == "fixed" else None, 0
    if kind == "lpc":
        precision, shift = rng.randint(8, 15), rng.randint(3, 7)
        weights = [(1 << shift) - 2] + [rng.randint(-3, 3) for _ in range(order - 1)]
        w.put(precision - 1, 4), w.put(shift, 5)
        for c in weights:
            w.put(c, precision)
    rest = [x[t] - (sum(c * x[t - 1 - i] for i, c in enumerate(weights)) >> shift) for t in range(order, len(x))]
    residual(w, rest, order, parts, rng)


def flac_file(x, rate, depth, seed=0, comments=(), total=True):
    """x: samples x channels."""
    rng = random.Random(seed)
    channels, frames, at = x.shape[1], b"", 0
    number = 0
    while at < len(x):
        size = min(len(x) - at, rng.choice([16, 192, 576, 1000, 4096]))
        block = [x[at : at + size, c].tolist() for c in range(channels)]
        layout = rng.choice([1, 8, 9, 10]) if channels == 2 else channels - 1
        if layout == 8:
            block[1] = [a - b for a, b in zip(*block, strict=True)]
        elif layout == 9:
            block[0] = [a - b for a, b in zip(*block, strict=True)]
        elif layout == 10:
            block = [[(a + b) >> 1 for a, b in zip(*block, strict=True)], [a - b for a, b in zip(*block, strict=True)]]
        code = {192: 1, 576: 2, 4096: 12}.get(size, 7)
        head = bytes([0xFF, 0xF9, code << 4 | 12, layout << 4 | {8: 1, 16: 4, 24: 6}[depth] << 1]) + chr(number).encode()
        head += (struct.pack(">H", size - 1) if code == 7 else b"") + bytes([rate // 1000])
        w = Writer()
        for c, values in enumerate(block):
            subframe(w, values, depth + (layout == 8 and c == 1 or layout == 9 and c == 0 or layout == 10 and c == 1), rng)
        frames += head + bytes([audio._crc8(head)]) + w.data() + b"\0\0"
        at, number = at + size, number + 1
    packed = rate << 44 | channels - 1 << 41 | depth - 1 << 36 | (len(x) if total else 0)
    about = struct.pack(">HH", 16, 4096) + bytes(6) + packed.to_bytes(8, "big") + bytes(16)
    block = struct.pack("<I", 0) + struct.pack("<I", len(comments)) + b"".join(struct.pack("<I", len(c)) + c for c in comments)
    return b"fLaC" + bytes([0]) + len(about).to_bytes(3, "big") + about + bytes([132]) + len(block).to_bytes(3, "big") + block + frames, len(frames)


def tone(n, channels, depth, seed=0):
    rng = np.random.default_rng(seed)
    t = np.arange(n)[:, None]
    top = (1 << (depth - 1)) - 1
    wave = np.sin(t / (20 + 7 * np.arange(channels))) * 0.6 + rng.normal(0, 0.01, (n, channels))
    wave[n // 3 : n // 2] = 0.25  # a constant stretch
    return np.clip(wave * top, -top - 1, top).astype(np.int64)


def sixteen(x, depth):
    return (x >> (depth - 16) if depth > 16 else x << (16 - depth)).astype("<i2").tobytes()


@pytest.mark.parametrize("channels, depth, seed", [(1, 16, 0), (2, 16, 1), (2, 16, 2), (2, 24, 3), (1, 8, 4), (6, 16, 5), (2, 24, 6)])
def test_flac_samples(channels, depth, seed):
    x = tone(9_000, channels, depth, seed)
    x[5000:6000] &= ~7  # low bits that are wasted
    data, frames = flac_file(x, 48_000, depth, seed, total=seed % 2 == 0)
    want = audio.Sound(hashlib.md5(sixteen(x, depth)).hexdigest(), 9_000 / 48_000, 48_000, channels, int(8 * frames * 48_000 / 9_000))
    assert audio.sound_of(data) == want
    tagged = b"ID3\4\0\0\0\0\0\5hello" + data + b"TAG" + bytes(125)
    assert audio.sound_of(tagged) == want


def test_flac_frames_in_several_runs(monkeypatch):
    x = tone(6_000, 2, 16, 9)
    data, _ = flac_file(x, 44_000, 16, 9)
    whole = audio.sound_of(data)
    monkeypatch.setattr(audio, "FRAMES", 2)
    assert audio.sound_of(data) == whole and whole.stream == hashlib.md5(sixteen(x, 16)).hexdigest()


def test_damaged_files_get_what_is_assumed(spark):
    data, _ = flac_file(tone(3_000, 2, 16), 44_000, 16)
    rng = random.Random(2)
    bad = [data[:n] for n in (0, 3, 20, 45, 60, len(data) // 2, len(data) - 40)] + [b"RIFF", b"OggS", b"\xff\xfb\x90\x00", b"ID3", b"xxxxftyp", bytes(100)]
    for _ in range(200):
        other = bytearray(data)
        for _ in range(rng.randint(1, 4)):
            other[rng.randrange(42, len(other))] = rng.randrange(256)
        bad.append(bytes(other[: rng.randint(1, len(other))]))
    for x in bad:
        sound = media.audio_of(x)
        assert sound.rate and len(sound.stream) == 32
        if sound.seconds == 0.0:
            assert sound == audio.Sound(hashlib.md5(x[min(len(x), 8192) :]).hexdigest(), 0.0, 44_100, 2, 0)


def riff(raw, channels, rate, width):
    kind = struct.pack("<HHIIHH", 1, channels, rate, rate * channels * width, channels * width, 8 * width)
    return b"RIFF" + struct.pack("<I", 36 + len(raw)) + b"WAVEfmt " + struct.pack("<I", 16) + kind + b"data" + struct.pack("<I", len(raw)) + raw


@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_wav_of_any_width(width):
    x = tone(500, 2, 8 * width, width).ravel()
    raw = b"".join(int(v + (128 if width == 1 else 0)).to_bytes(width, "little", signed=width > 1) for v in x)
    assert audio.sound_of(riff(raw, 2, 22_050, width)) == audio.Sound(hashlib.md5(sixteen(x, 8 * width)).hexdigest(), 500 / 22_050, 22_050, 2, 16 * width * 22_050)


def mp3_frame(kbit, rate=0, version=3, mono=False, fill=b"\x55"):
    index = audio._KBITS[1 if version == 3 else 2].index(kbit)
    head = bytes([0xFF, 0xE2 | version << 3 | 1, index << 4 | rate << 2, 0xC0 if mono else 0])
    size = audio._mp3_frame(head, 0)[0]
    return head + fill * (size - 4)


def test_mp3_frames():
    body = mp3_frame(128) * 20
    want = audio.Sound(hashlib.md5(body).hexdigest(), 20 * 1152 / 44_100, 44_100, 2, 128_000)
    for data in (body, b"ID3\3\0\0\0\0\0\4abcd" + body, body + b"TAG" + bytes(125), b"junk\xff" + body, body + mp3_frame(128)[:100]):
        assert audio.sound_of(data) == want
    info = bytearray(mp3_frame(128, fill=b"\0"))
    info[36:40] = b"Xing"
    assert audio.sound_of(bytes(info) + body) == want
    mixed = mp3_frame(64, 1, 2, True) + mp3_frame(32, 1, 2, True)
    assert audio.sound_of(mixed) == audio.Sound(hashlib.md5(mixed).hexdigest(), 1152 / 24_000, 24_000, 1, int(8 * len(mixed) * 24_000 / 1152))


def ogg_page(packets, granule, serial=7, number=0):
    lacing, body = b"", b""
    for p in packets:
        lacing += b"\xff" * (len(p) // 255) + bytes([len(p) % 255])
        body += p
    return b"OggS\0\0" + struct.pack("<qIII", granule, serial, number, 0) + bytes([len(lacing)]) + lacing + body


def test_ogg_streams():
    comments = struct.pack("<I", 1) + b"v" + struct.pack("<I", 2) + b"".join(struct.pack("<I", len(c)) + c for c in (b"TITLE=Two", b"Genre=Jazz" + b"x" * 300))
    head = b"\x01vorbis" + struct.pack("<IBIiii", 0, 2, 44_100, 0, 160_000, 0) + b"\xb8\1"
    vorbis = ogg_page([head], 0) + ogg_page([b"\x03vorbis" + comments, b"\x05vorbis" + b"s" * 600], 0) + ogg_page([b"other"], 10, serial=8) + ogg_page([b"a" * 700, b"b"], 44_100) + ogg_page([b"c" * 255], 88_200)
    coded = b"a" * 700 + b"b" + b"c" * 255
    assert audio.sound_of(vorbis) == audio.Sound(hashlib.md5(coded).hexdigest(), 2.0, 44_100, 2, 160_000)
    assert media.tags_of(vorbis, "ogg")[0] == {"title": "Two", "genre": "Jazz" + "x" * 300}
    opus = ogg_page([b"OpusHead" + struct.pack("<BBHIHB", 1, 1, 312, 44_100, 0, 0)], 0) + ogg_page([b"OpusTags" + comments], 0) + ogg_page([b"z" * 900], 48_312)
    assert audio.sound_of(opus) == audio.Sound(hashlib.md5(b"z" * 900).hexdigest(), 1.0, 48_000, 1, 7200)
    assert media.tags_of(opus, "ogg")[0]["title"] == "Two"


def atom(name, *parts):
    body = b"".join(parts)
    return struct.pack(">I", 8 + len(body)) + name + body


def test_mp4_track_and_items():
    text = lambda name, value, kind=1: atom(name, atom(b"data", struct.pack(">II", kind, 0), value))
    items = atom(b"ilst", text(b"\xa9nam", "Größe".encode()), text(b"trkn", struct.pack(">HHHH", 0, 3, 12, 0), 0), text(b"covr", b"\xff\xd8", 13))
    entry = atom(b"mp4a", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 2, 16, 0, 0, 44_100 << 16))
    track = lambda kind, scale, length: atom(b"trak", atom(b"mdia", atom(b"mdhd", bytes(12), struct.pack(">II", scale, length), bytes(4)), atom(b"hdlr", bytes(8), kind, bytes(12)), atom(b"minf", atom(b"stbl", atom(b"stsd", struct.pack(">II", 0, 1), entry)))))
    data = atom(b"ftyp", b"M4A ") + atom(b"moov", track(b"vide", 600, 6000), track(b"soun", 44_100, 88_200), atom(b"udta", atom(b"meta", bytes(4), items))) + atom(b"mdat", b"m" * 32_000)
    assert audio.sound_of(data) == audio.Sound(hashlib.md5(b"m" * 32_000).hexdigest(), 2.0, 44_100, 2, 128_000)
    assert media.tags_of(data, "m4a") == ({}, {"\xa9nam": ["Größe"], "trkn": ["3/12"]})


def test_parsed_rows_of_real_sound(spark, rows):
    x = tone(2_000, 2, 16, 3)
    data, size = flac_file(x, 44_000, 16, 3, [b"title=One", b"GENRE=Rock"])
    parsed = media.parse_media(rows([("/m/a.flac", bytearray(data)), ("/m/b.mp3", bytearray(mp3_frame(320) * 9))], "path string, content binary"))
    a, b = sorted(parsed.collect())
    assert (a.audio_stream_hash, a.sample_rate, a.channels, a.bitrate, a.duration) == (hashlib.md5(sixteen(x, 16)).hexdigest(), 44_000, 2, int(8 * size * 44_000 / 2_000), 2_000 / 44_000)
    assert a.tags == {"title": "One", "genre": "Rock"} and (b.bitrate, b.format, b.status) == (320_000, "MP3", "SUCCESS")
