"""Properties of binary columns: images by their headers, sound by its, in Arrow batches.

Decoding to samples needs libraries that may be absent; then the result is missing.
"""

from __future__ import annotations

import io
import struct
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

_IMAGE = "struct<format:string,width:int,height:int>"
_SOUND = "struct<channels:int,rate:int,frames:bigint,seconds:double>"


def image_header(b: bytes | None) -> dict | None:
    if not b:
        return None
    if b[:8] == b"\x89PNG\r\n\x1a\n" and len(b) >= 24:
        w, h = struct.unpack(">II", b[16:24])
        return {"format": "PNG", "width": w, "height": h}
    if b[:6] in (b"GIF87a", b"GIF89a") and len(b) >= 10:
        w, h = struct.unpack("<HH", b[6:10])
        return {"format": "GIF", "width": w, "height": h}
    if b[:2] == b"BM" and len(b) >= 26:
        w, h = struct.unpack("<ii", b[18:26])
        return {"format": "BMP", "width": w, "height": abs(h)}
    if b[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(b) and b[at] == 0xFF:
            if 0xC0 <= b[at + 1] <= 0xCF and b[at + 1] not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", b[at + 5 : at + 9])
                return {"format": "JPEG", "width": w, "height": h}
            at += 2 + struct.unpack(">H", b[at + 2 : at + 4])[0]
    return None


def sound_header(b: bytes | None) -> dict | None:
    try:
        with wave.open(io.BytesIO(b or b"")) as w:
            return {"channels": w.getnchannels(), "rate": w.getframerate(), "frames": w.getnframes(), "seconds": w.getnframes() / w.getframerate()}
    except (wave.Error, EOFError):
        return None


def _frame(rows: list[dict | None], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame([r or dict.fromkeys(names) for r in rows], columns=names)


def image_property(column: Column) -> Column:
    """Format, width and height; missing where the header is none that is known."""
    @F.pandas_udf(_IMAGE)
    def run(x: pd.Series) -> pd.DataFrame:
        return _frame([image_header(b) for b in x], ["format", "width", "height"])

    return run(column)


def audio_property(column: Column) -> Column:
    """Channels, rate, frames and seconds of WAV bytes; missing for others."""
    @F.pandas_udf(_SOUND)
    def run(x: pd.Series) -> pd.DataFrame:
        return _frame([sound_header(b) for b in x], ["channels", "rate", "frames", "seconds"])

    return run(column)


def image_decode(column: Column) -> Column:
    """RGB bytes, row by row, where Pillow is installed."""
    @F.pandas_udf("binary")
    def run(x: pd.Series) -> pd.Series:
        try:
            from PIL import Image
        except ImportError:
            return pd.Series([None] * len(x))
        return pd.Series([Image.open(io.BytesIO(b)).convert("RGB").tobytes() if b else None for b in x])

    return run(column)


def audio_decode(column: Column) -> Column:
    """Samples of 16-bit WAV bytes; missing for others."""
    @F.pandas_udf("array<int>")
    def run(x: pd.Series) -> pd.Series:
        out = []
        for b in x:
            head = sound_header(b)
            if head is None:
                out.append(None)
                continue
            with wave.open(io.BytesIO(b)) as w:
                raw = w.readframes(w.getnframes())
            out.append(list(struct.unpack(f"<{len(raw) // 2}h", raw)) if w.getsampwidth() == 2 else None)
        return pd.Series(out)

    return run(column)


def url_download(column: Column, errors: str = "raise", timeout: float = 30.0) -> Column:
    """Bytes behind each address, read where the rows are; with ``coerce`` what can't be read is missing."""
    @F.pandas_udf("binary")
    def run(x: pd.Series) -> pd.Series:
        from urllib.request import urlopen

        out = []
        for address in x:
            try:
                with urlopen(address, timeout=timeout) as got:
                    out.append(got.read())
            except (OSError, ValueError, AttributeError):
                if errors == "raise" and address is not None:
                    raise
                out.append(None)
        return pd.Series(out)

    return run(column)


def voice_spans(column: Column, rate: int, frame_ms: int = 20, least: float = 0.1) -> Column:
    """Where sound is, of arrays of samples: [first, last + 1] of runs of frames with at least ``least`` of the loudest frame's level."""
    @F.pandas_udf("array<array<bigint>>")
    def run(x: pd.Series) -> pd.Series:
        out = []
        size = max(1, rate * frame_ms // 1000)
        for samples in x:
            if samples is None or not len(samples):
                out.append(None if samples is None else [])
                continue
            wave_ = np.asarray(samples, float)
            frames = -(-len(wave_) // size)
            level = np.sqrt((np.pad(wave_, (0, frames * size - len(wave_))).reshape(frames, size) ** 2).mean(1))
            on = np.concatenate([[False], level >= max(least * level.max(), 1e-9), [False]])
            begin, end = np.flatnonzero(on[1:] & ~on[:-1]), np.flatnonzero(~on[1:] & on[:-1])
            out.append([[int(a * size), int(min(b * size, len(wave_)))] for a, b in zip(begin, end)])
        return pd.Series(out)

    return run(column)
