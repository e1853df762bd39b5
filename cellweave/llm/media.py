"""Media columns: texts as grey images in lossless WebP files, read back as pixel arrays."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, pick, prepare
from .webp import MOST_SIDE, OPAQUE, decode, encode, encode_grey

#: Samples in a row of the image; what fills the last row.
ROW, FILL = 576, 255
#: Least samples of one value in a row that become a back-reference; the share of samples equal to those above from which they are predicted.
RUN, ALIKE = 24, 0.3

MEDIA = "doc_id bigint, n_bytes bigint, media binary"
FEATURES = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def pad(raw: bytes) -> np.ndarray:
    size = max(1, -(-len(raw) // ROW)) * ROW
    return np.frombuffer(raw.ljust(size, bytes([FILL])), np.uint8)


def _runs(flat: np.ndarray) -> list[tuple[int, int, int]]:
    """References (place, length, 1) for long runs of one value; the first sample of a run stays a literal."""
    edge = np.flatnonzero(np.diff(flat)) + 1
    start, end = np.append(0, edge), np.append(edge, len(flat))
    out = []
    for k in np.flatnonzero(end - start > RUN).tolist():
        for at in range(int(start[k]) + 1, int(end[k]), 4096):
            out.append((at, min(4096, int(end[k]) - at), 1))
    return out


def to_media(payload: np.ndarray) -> bytes:
    """The samples as grey pixels in rows of ROW; over MOST_SIDE rows, several files follow each other.

    Images of up to 16 values get a palette, which bundles pixels. In others red
    and blue lose green, which leaves nothing of them. Where rows repeat, pixels
    are predicted from those above. All but these use the colour cache for
    repeated values, if there are few.
    """
    files = []
    for k in range(0, len(payload), ROW * MOST_SIDE):
        grey = payload[k : k + ROW * MOST_SIDE].reshape(-1, ROW)
        few = np.count_nonzero(np.bincount(grey.ravel(), minlength=256)) <= 16
        above = len(grey) > 1 and not few and np.count_nonzero(grey[1:] == grey[:-1]) > ALIKE * grey.size
        if few or above:
            image = grey.astype(np.uint32) * np.uint32(0x010101) | np.uint32(OPAQUE)
        if few:
            files.append(encode(image, palette=True))
        elif above:
            tiles = np.full((-(-len(grey) // 512), -(-ROW // 512)), 2)
            rest = grey - np.concatenate([np.zeros((1, ROW), np.uint8), grey[:-1]])
            rest[0] = np.diff(grey[0], prepend=np.uint8(0))
            files.append(encode(image, green=True, modes=tiles, bits=9, references=_runs(rest.ravel())))
        else:
            files.append(encode_grey(grey, _runs(grey.ravel())))
    return b"".join(files)


def from_media(media: bytes) -> np.ndarray:
    """The samples of one file or several."""
    out = []
    while media:
        image, used = decode(media)
        out.append((image & np.uint32(255)).astype(np.uint8).ravel())
        media = media[used:]
    return np.concatenate(out)


def describe(payload: np.ndarray) -> str:
    """Rows, mean, deviation and entropy of the samples, and the share of the commonest."""
    n = np.bincount(payload, minlength=256)
    p = n[n > 0] / len(payload)
    mean = float((n * np.arange(256)).sum() / len(payload))
    spread = float((n * (np.arange(256) - mean) ** 2).sum() / len(payload)) ** 0.5
    return f"rows={len(payload) // ROW};mean={mean:.4f};sd={spread:.4f};entropy={float(-(p * np.log2(p)).sum()):.4f};top={p.max():.4f}"


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
        for lo in range(0, len(texts), 128):
            raw = [(x or "").encode() for x in texts[lo : lo + 128]]
            yield pa.RecordBatch.from_arrays([ids[lo : lo + 128], pa.array([len(x) for x in raw], pa.int64()), pa.array([to_media(pad(x)) for x in raw], pa.binary())], names=["doc_id", "n_bytes", "media"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for n, media in zip(batch.column("n_bytes").to_pylist(), batch.column("media").to_pylist()):
            payload = from_media(media)
            raw = payload.tobytes()
            rows.append((len(raw), sha256(raw).hexdigest(), crc32(raw[-32:]), len(media), sha256(media).hexdigest(), describe(payload)))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes")] + [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A media column: (doc_id, n_bytes, media), the whole text's UTF-8 bytes as a lossless WebP file.

    Null texts are empty; an empty text is one row of FILL. Null ids and repeated
    rows stay. Equal texts have equal files. Other columns are ignored. Each row
    is worked on by itself; nothing is shuffled.
    """
    prepare(docs.sparkSession)
    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return rows.mapInArrow(_encode, MEDIA)


def stored_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The media of `encode_texts` written to the shared folder, read back and described: FEATURES."""
    scratch = Scratch(docs.sparkSession, "media")
    return media_features(scratch.store(encode_texts(docs, id_col, text_col), "media"))


def media_features(media: DataFrame) -> DataFrame:
    """Decode each stored file (doc_id, n_bytes, media) and describe its samples: FEATURES. A broken file is an error."""
    return pick(media, doc_id="doc_id", n_bytes="n_bytes", media="media").where("media is not null").mapInArrow(_features, FEATURES)
