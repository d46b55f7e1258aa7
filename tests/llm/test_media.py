import hashlib
import random
import zlib

import numpy as np

from lodestone.llm import media, vp8l
from tests.llm.helpers import ODD, docs, prose


class Sent(vp8l._Writer):
    """A writer of whole streams for the reader's tests."""

    def header(self, width, height):
        self.put(0x2F, 8), self.put(width - 1, 14), self.put(height - 1, 14), self.put(1, 1), self.put(0, 3)

    def pixels(self, symbols, cache_bits=0, main=False, tile=None):
        """symbols: (green symbol, red, blue, alpha) literals, ('copy', length, distance code) or ('cache', index)."""
        self.put(1, 1), self.put(cache_bits, 4) if cache_bits else None
        if not cache_bits:
            self.at -= 1
            self.value &= ~(1 << self.at)
            self.at += 1
        if main:
            self.put(0, 1)
        sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
        used = [set() for _ in sizes]
        sent = []
        for s in symbols:
            if s[0] == "copy":
                (p, pe, pn), (d, de, dn) = self.prefix(s[1]), self.prefix(s[2])
                sent.append([(0, 256 + p), (None, pe, pn), (4, d), (None, de, dn)])
            elif s[0] == "cache":
                sent.append([(0, 280 + s[1])])
            else:
                sent.append(list(enumerate(s)))
        for one in sent:
            for part in one:
                if part[0] is not None:
                    used[part[0]].add(part[1])
        lengths = [vp8l.code_lengths([int(k in u) for k in range(n)]) if len(u) > 1 else tuple(int(k in u) for k in range(n)) for u, n in zip(used, sizes, strict=True)]
        for x in lengths:
            vp8l.put_code(self, x) if sum(x) != 1 or x.index(1) < 256 else self.single(x)
        codes = [vp8l.prefix_codes(x) if sum(n > 0 for n in x) > 1 else {} for x in lengths]
        for one in sent:
            for part in one:
                if part[0] is None:
                    self.put(part[1], part[2])
                elif codes[part[0]]:
                    self.put(*codes[part[0]][part[1]])

    @staticmethod
    def prefix(value):
        """(prefix code, extra bits, their number) of a length or distance."""
        if value <= 4:
            return value - 1, 0, 0
        n = (value - 1).bit_length() - 2
        top = (value - 1) >> n
        return 2 * n + 2 + (top & 1), (value - 1) & ((1 << n) - 1), n

    def bytes(self):
        return self.value.to_bytes((self.at + 7) // 8 + 1, "little")


def argb(rng, n, kinds=5):
    colours = [tuple(rng.randrange(256) for _ in range(4)) for _ in range(kinds)]
    return [rng.choice(colours) for _ in range(n)]


def literal(p):
    a, r, g, b = p
    return g, r, b, a


def decoded(out):
    return [tuple(map(int, p)) for p in vp8l.decode_stream(out.bytes()).reshape(-1, 4)]


def test_literals_back_references_and_cache():
    rng = random.Random(5)
    for cache_bits in (0, 3):
        out = Sent()
        out.header(8, 6)
        want = argb(rng, 8)
        symbols = [literal(p) for p in want]
        cache = {}
        key = lambda p: (vp8l.CACHE_FACTOR * (p[0] << 24 | p[1] << 16 | p[2] << 8 | p[3]) & 0xFFFFFFFF) >> (32 - cache_bits)
        symbols.append(("copy", 8, 1))  # distance code 1: the pixel above
        want += want[-8:]
        symbols.append(("copy", 5, 2))  # distance code 2: the pixel to the left, overlapping itself
        want += [want[-1]] * 5
        symbols.append(("copy", 7, 120 + 13))
        for _ in range(7):
            want.append(want[-13])
        if cache_bits:
            for p in want:
                cache[key(p)] = p
        while len(want) < 48:
            p = rng.choice(want)
            if cache_bits and cache.get(key(p)) == p:
                symbols.append(("cache", key(p)))
            else:
                symbols.append(literal(p))
                if cache_bits:
                    cache[key(p)] = p
            want.append(p)
        out.put(0, 1)
        out.pixels(symbols, cache_bits, main=True)
        assert decoded(out) == want


def forward_predictor(image, modes, tile):
    """What a writer would send: each pixel less its prediction, from RFC 9649's words."""
    h, w, _ = image.shape
    flat, out = image.reshape(-1, 4).astype(np.int32), np.zeros((h, w, 4), np.int32)
    for y in range(h):
        for x in range(w):
            i = y * w + x
            if not y:
                p = flat[i - 1] if x else np.array([255, 0, 0, 0])
            elif not x:
                p = flat[i - w]
            else:
                p = vp8l._predict(modes[y >> tile][x >> tile], flat[i - 1], flat[i - w], flat[i - w + 1], flat[i - w - 1])
            out[y, x] = (flat[i] - p) & 255
    return out


def test_predictor_and_cross_colour_and_subtract_green():
    rng = np.random.default_rng(4)
    image = rng.integers(0, 256, (12, 20, 4))
    modes = [[int(m) for m in row] for row in np.arange(15).reshape(3, 5) % 14]
    sent = vp8l._packed(forward_predictor(image, modes, 2))
    assert (vp8l._channels(vp8l.invert_predictor(sent, np.array(modes, np.uint32) << 8, 2)) == image).all()

    out = Sent()
    out.header(20, 12)
    out.put(1, 1), out.put(vp8l.PREDICTOR, 2), out.put(0, 3)
    out.pixels([literal((0, 0, m, 0)) for row in modes for m in row])
    green = (image - image[..., 2:3] * [0, 1, 0, 1]) & 255  # red and blue less green, then predicted
    out.put(1, 1), out.put(vp8l.SUBTRACT_GREEN, 2)
    residue = forward_predictor(image, modes, 2)
    residue[..., 1] -= residue[..., 2]
    residue[..., 3] -= residue[..., 2]
    assert green.shape == residue.shape
    out.put(0, 1)
    out.pixels([literal(tuple(int(v) & 255 for v in p)) for p in residue.reshape(-1, 4)], main=True)
    assert decoded(out) == [tuple(map(int, p)) for p in image.reshape(-1, 4)]

    factors = rng.integers(0, 256, (3, 5, 4))
    signed = lambda v: ((int(v) & 255) ^ 128) - 128
    plain = image.copy()
    for y in range(12):
        for x in range(20):
            _, red_to_blue, green_to_blue, green_to_red = factors[y >> 2, x >> 2]
            a, r, g, b = image[y, x]
            plain[y, x, 1] = (r - (signed(green_to_red) * signed(g) >> 5)) & 255
            plain[y, x, 3] = (b - (signed(green_to_blue) * signed(g) >> 5) - (signed(red_to_blue) * signed(r) >> 5)) & 255
    assert (vp8l._channels(vp8l.invert_cross_colour(vp8l._packed(plain), vp8l._packed(factors), 2)) == image).all()


def test_prediction_modes_by_hand():
    l, t, tr, tl = (np.array(v, np.int32) for v in ([10, 20, 30, 250], [50, 5, 30, 251], [7, 7, 7, 7], [20, 20, 20, 20]))
    want = {0: [255, 0, 0, 0], 1: l, 2: t, 3: tr, 4: tl, 5: [(8 + 50) >> 1, (13 + 5) >> 1, (18 + 30) >> 1, (128 + 251) >> 1], 6: [15, 20, 25, 135], 7: [30, 12, 30, 250], 8: [35, 12, 25, 135], 9: [28, 6, 18, 129], 10: [(15 + 28) >> 1, (20 + 6) >> 1, (25 + 18) >> 1, (135 + 129) >> 1], 12: [40, 5, 40, 255]}
    for mode, p in want.items():
        assert list(vp8l._predict(mode, l, t, tr, tl)) == list(p), mode
    # distance of the prediction l + t - tl to left is |t - tl|, to top |l - tl|; the nearer one is taken
    assert list(vp8l._predict(11, l, t, tr, tl)) == list(l if np.abs(t - tl).sum() < np.abs(l - tl).sum() else t)


def test_palette_with_bundled_pixels():
    rng = random.Random(8)
    for n in (2, 4, 16, 200):
        colours = [tuple(rng.randrange(256) for _ in range(4)) for _ in range(n)]
        index = [[rng.randrange(n) for _ in range(21)] for _ in range(5)]
        shift = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
        out = Sent()
        out.header(21, 5)
        out.put(1, 1), out.put(vp8l.PALETTE, 2), out.put(n - 1, 8)
        before = [(0, 0, 0, 0), *colours[:-1]]
        out.pixels([literal(tuple((a - b) & 255 for a, b in zip(c, d, strict=True))) for c, d in zip(colours, before, strict=True)])
        depth, per = 8 >> shift, 1 << shift
        bundles = [sum(v << (depth * k) for k, v in enumerate(row[i : i + per])) for row in index for i in range(0, 21, per)]
        out.put(0, 1)
        out.pixels([literal((255, 0, v, 0)) for v in bundles], main=True)
        assert decoded(out) == [colours[i] for row in index for i in row]


def test_near_distances_are_the_formats():
    assert vp8l.NEAR[:8] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2)] and len(vp8l.NEAR) == 120 and vp8l.NEAR[-1] == (8, 7)


def test_payload_round_trip():
    rng = random.Random(3)
    for payload in (bytes(64), bytes(range(256)) * 9, rng.randbytes(64 * 700), b"text " * 64, bytes(media.LARGEST + 64)):
        assert media.to_payload(media.to_pixels(media.to_media(payload))) == payload


def test_contract_columns(spark):
    texts = ODD + [prose(1), prose(1)]
    rows = {r["doc_id"]: r for r in media.read(media.store(docs(spark, texts))).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        full = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
    one, two = (rows[len(texts) - k].asDict() for k in (1, 2))
    assert {k: v for k, v in one.items() if k != "doc_id"} == {k: v for k, v in two.items() if k != "doc_id"}
    assert media.read(media.store(docs(spark, []))).collect() == []


def form(media_bytes):
    """The first transform of a stored image, or 'literals' under the fixed code, or 'own' codes."""
    (stream,) = vp8l.streams(media_bytes)
    bits = vp8l.Bits(stream, 40)
    if bits.read(1):
        return bits.read(2)
    return "literals" if stream[5:40] == vp8l.literal_stream(np.zeros(64, np.uint8), 16)[5:40] else "own"


def test_the_writer_chooses_by_image_and_stays_lossless():
    rng = np.random.default_rng(9)
    noise = rng.integers(0, 256, (64, 16, 4), dtype=np.uint8)
    green = np.stack([noise[..., 0]] * 3 + [np.full((64, 16), 9, np.uint8)], -1)
    line = (prose(2, 90).encode() + b"\n")[:601]
    images = {
        "literals": prose(5, 400).encode(),
        "own": line * 40,
        vp8l.PALETTE: rng.choice(rng.integers(0, 256, (12, 4), dtype=np.uint8), 900).tobytes(),
        vp8l.SUBTRACT_GREEN: green.tobytes(),
        vp8l.PREDICTOR: np.cumsum(rng.integers(0, 3, (64, 16, 4), dtype=np.uint8), 0, dtype=np.uint8).tobytes(),
    }
    for want, payload in images.items():
        payload += bytes(-len(payload) % 64)
        stored = media.to_media(payload)
        assert form(stored) == want
        assert media.to_payload(media.to_pixels(stored)) == payload == media.to_payload(media.to_pixels(media.to_media(payload)))
        assert want == "literals" or 2 * len(stored) < len(media.vp8l.literal_stream(np.frombuffer(payload, np.uint8), 16)) + 40


def test_copies_and_cache_are_sent_for_repeated_lines(monkeypatch):
    seen = set()
    symbol = vp8l.Bits.symbol

    def watched(self, code):
        s = symbol(self, code)
        seen.add("cache" if s >= 280 else "copy" if s >= 256 else "literal")
        return s

    monkeypatch.setattr(vp8l.Bits, "symbol", watched)
    lines = "".join(f"{prose(k % 7, 12)} | {k % 3}\n" for k in range(400)).encode()
    lines += bytes(-len(lines) % 64)
    assert media.to_payload(media.to_pixels(media.to_media(lines))) == lines
    assert seen == {"literal", "copy", "cache"}


def test_round_trip_of_random_images():
    rng = random.Random(12)
    for _ in range(150):
        unit = [rng.randbytes(4) for _ in range(rng.choice([1, 2, 3, 5, 17, 300]))]
        payload = b"".join(rng.choice(unit) for _ in range(16 * rng.randint(1, 90)))
        stored = media.to_media(payload)
        assert media.to_payload(media.to_pixels(stored)) == payload
        for kind, mode in ((None, 0), (vp8l.PALETTE, 0)):
            c = np.frombuffer(payload, np.uint8).reshape(-1, 16, 4)
            if kind is None or len(unit) <= 256:
                assert media.to_payload([vp8l.decode_stream(vp8l._own_stream(c, 16, kind, mode))]) == payload
