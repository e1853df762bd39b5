from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cellweave.llm import media, webp


def back(image, **options):
    file = webp.encode(image, **options)
    out, used = webp.decode(file + b"more")
    assert used == len(file) and (out == image).all()


@pytest.mark.parametrize("height,width", [(1, 1), (3, 5), (17, 33), (40, 64)])
def test_every_transform_is_inverted(height, width):
    rng = np.random.default_rng(height)
    image = webp.pixels(rng.integers(0, 40, (height, width, 4)).astype(np.uint8))
    back(image)
    back(image, green=True)
    back(image, cache_bits=6)
    for bits in (2, 3):
        tiles = (webp.shrunk(height, bits), webp.shrunk(width, bits))
        for mode in range(14):
            back(image, modes=np.full(tiles, mode), bits=bits)
        factors = rng.integers(0, 256, (*tiles, 4)).astype(np.uint8)
        modes = rng.integers(0, 14, tiles)
        back(image, factors=factors, bits=bits)
        back(image, groups=rng.integers(0, 3, tiles), tile=bits, cache_bits=3)
        back(image, modes=modes, factors=factors, bits=bits, green=True, groups=rng.integers(0, 2, tiles), tile=bits, cache_bits=5)


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 5, 16, 17, 200])
def test_palettes_bundle_pixels(colours):
    rng = np.random.default_rng(colours)
    image = rng.integers(0, 2**32, colours, dtype=np.uint32)[rng.integers(0, colours, (7, 21))]
    back(image, palette=True)
    back(image, palette=True, cache_bits=2)


def test_back_references_near_and_far():
    rng = np.random.default_rng(3)
    image = np.tile(webp.pixels(rng.integers(0, 256, (1, 50, 4)).astype(np.uint8)), (8, 1))
    back(image, references=[(50, 350, 50)])
    back(image, references=[(50, 3, 50), (60, 100, 50), (200, 150, 150)], cache_bits=4)
    with pytest.raises(ValueError):
        webp.decode(webp.encode(image, references=[(50, 350, 350)]))


def test_distance_codes_of_near_pixels():
    """A few entries of the format's list of 120."""
    assert len(webp.NEAR) == 120 and webp.NEAR[:6] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0)]
    assert webp.NEAR[42:46] == [(4, 3), (-4, 3), (5, 0), (1, 5)] or webp.NEAR.index((5, 0)) > webp.NEAR.index((-4, 3)) and webp.NEAR[-1] == (8, 7)


def test_a_file_written_by_hand():
    """One opaque pixel of red 1, green 2, blue 3: five simple codes of one symbol each."""
    bits = "".join(f"{v:0{n}b}"[::-1] for v, n in [(0x2F, 8), (0, 14), (0, 14), (0, 1), (0, 3), (0, 1), (0, 1), (0, 1)] + [f for s in (2, 1, 3, 255, 0) for f in ((1, 1), (0, 1), (1, 1), (s, 8))])
    body = int(bits[::-1], 2).to_bytes(-(-len(bits) // 8), "little")
    body += bytes(len(body) & 1)
    image, _ = webp.decode(b"RIFF" + (12 + len(body)).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body)
    assert image.tolist() == [[0xFF010203]]


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=3000))
def test_payloads_come_back(raw):
    payload = media.pad(raw)
    assert len(payload) % media.ROW == 0 and len(payload) >= max(1, len(raw))
    assert media.from_media(media.to_media(payload)).tobytes() == payload.tobytes() == raw.ljust(len(payload), b"\xff")


def test_payloads_of_several_files(monkeypatch):
    monkeypatch.setattr(media, "MOST_SIDE", 3)
    payload = media.pad(bytes(range(256)) * 20)
    assert media.from_media(media.to_media(payload)).tobytes() == payload.tobytes()


def test_broken_files_are_errors():
    file = media.to_media(media.pad(b"some text " * 100))
    for bad in (b"", file[:30], b"RIFX" + file[4:], file[:60]):
        with pytest.raises((ValueError, IndexError)):
            webp.decode(bad)


def test_features_of_texts(spark):
    texts = [None, "", "a", "é" * 288, "same", "same", "long " * 40_000]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(None, "no id", "x")], "doc_id long, text string, media string")
    rows = {r.doc_id: r for r in media.media_features(media.encode_texts(docs)).collect()}
    assert len(rows) == len(texts) + 1
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 576)) * 576, b"\xff")
        r = rows[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), sha256(payload).hexdigest(), crc32(payload[-32:]))
        file = media.to_media(np.frombuffer(payload, np.uint8))
        assert (r.media_bytes, r.media_sha256) == (len(file), sha256(file).hexdigest())
    assert rows[4].feature == rows[5].feature
    assert media.media_features(media.encode_texts(docs.where("false"))).collect() == []


def test_a_file_of_another_encoder():
    """The published one-pixel file by which browsers are asked whether they read lossless images: transparent."""
    import base64

    image, used = webp.decode(base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA=="))
    assert image.tolist() == [[0]] and used == 34


def plain(file, monkeypatch):
    """The pixels by the reader that takes one symbol at a time."""
    with monkeypatch.context() as m:
        m.setattr(webp, "_read_samples", lambda *args: None)
        return webp.decode(file)[0]


@pytest.mark.parametrize("kind", ["prose", "many values", "runs", "rows repeat", "long", "colliding cache places"])
def test_fast_reader_equals_the_plain_one(kind, monkeypatch):
    rng = np.random.default_rng(5)
    prose = " ".join("".join(chr(97 + k) for k in rng.integers(0, 26, rng.integers(1, 9))) for _ in range(900)).encode()
    raw = {
        "prose": prose, "many values": rng.integers(0, 256, 5000).astype(np.uint8).tobytes(), "runs": b"".join(bytes([k % 40]) * (k % 90) for k in range(300)),
        "rows repeat": prose[:576] * 9 + prose[:300], "long": prose * 60, "colliding cache places": bytes(rng.integers(0, 128, 9000).astype(np.uint8)),
    }[kind]
    if kind == "long":
        monkeypatch.setattr(webp._Chain, "PIECE", 1 << 12)
    file = media.to_media(media.pad(raw))
    image, used = webp.decode(file)
    assert used == len(file) and (image == plain(file, monkeypatch)).all()
    assert media.from_media(file).tobytes() == media.pad(raw).tobytes()


def test_cache_places_that_change_colour_are_read_in_order():
    """Two greys share a place of a cache of one bit, so the general encoder's files need the plain reader."""
    grey = np.tile(np.array([[7, 7, 9, 9, 11, 7, 7, 13, 9, 9]], np.uint8), (3, 7))
    image = grey.astype(np.uint32) << np.uint32(8) | np.uint32(webp.OPAQUE)
    back(image, cache_bits=1)
    back(image, cache_bits=1, references=[(20, 11, 10)])


def test_queries_use_cache_predictor_palette_and_references():
    """What the files of texts are made of, by the first bits after their size: transforms, then the cache."""
    prose = ("The quick brown fox jumps over the lazy dog, again and again. " * 40).encode()

    def kinds(raw):
        r = webp.Reader(media.to_media(media.pad(raw))[20:])
        r.bits(40)
        return r.bits(1) and r.bits(2), r

    kind, r = kinds(prose)
    assert kind == webp.SUBTRACT_GREEN and r.bits(1) == 0 and r.bits(1) == 1 and r.bits(4) == webp.CACHE_BITS
    assert kinds(b"ab" * 700)[0] == webp.PALETTE
    lines = np.random.default_rng(1).integers(32, 120, 576).astype(np.uint8).tobytes()
    assert kinds(lines * 5)[0] in (webp.SUBTRACT_GREEN, webp.PREDICTOR)
    assert len(media.to_media(media.pad(lines * 50))) < 3 * 576


def test_stored_features_equal_those_in_flight(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([None, "", "one two", "lines\n" * 500])], "doc_id long, text string")
    assert sorted(map(tuple, media.stored_features(docs).collect())) == sorted(map(tuple, media.media_features(media.encode_texts(docs)).collect()))
