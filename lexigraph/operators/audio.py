"""Features of sampled sound: means over frames of level, zero crossings and the spectrum, and a tempo from how its energy recurs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

FRAME, HOP, ROLL = 2048, 512, 0.85
#: Frames that are transformed at a time.
STEP = 512
NAMES = ("duration_s", "tempo_bpm", "rms_energy", "spectral_centroid_hz", "spectral_rolloff_hz", "zcr", "spectral_bandwidth_hz")


def frames(y: np.ndarray, mode: str):
    """Blocks of frames; the signal is continued by half a frame at both ends, so a frame is centred on every HOP-th sample. Only a block's samples are copied."""
    n = 1 + len(y) // HOP
    for lo in range(0, n, STEP):
        hi = min(lo + STEP, n)
        a, b = lo * HOP - FRAME // 2, (hi - 1) * HOP + FRAME // 2
        part = np.pad(y[max(a, 0) : min(b, len(y))], (max(0, -a), max(0, b - len(y))), mode=mode) if len(y) else np.zeros(b - a)
        yield np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP]


def tempo(flux: np.ndarray, rate: float) -> float:
    """Beats a minute at which a rise of energy recurs most, weighted towards 120 by octaves; 0 for a signal that never rises."""
    x = flux - flux.mean() if len(flux) else flux
    if len(x) < 4 or not np.abs(x).max() > 1e-9:
        return 0.0
    size = 1 << (2 * len(x) - 1).bit_length()
    f = np.fft.rfft(x, size)
    lags = np.fft.irfft(f * f.conj(), size)[: len(x)]
    bpm = 60 * rate / HOP / np.arange(1, len(x))
    weight = np.where((bpm >= 30) & (bpm <= 300), np.exp(-0.5 * np.log2(bpm / 120) ** 2), 0)
    score = weight * lags[1:]
    return float(bpm[score.argmax()]) if score.max() > 0 else 0.0


def features(y: np.ndarray, rate: float) -> tuple[float, ...]:
    """NAMES of a signal between -1 and 1. Frames of silence have no spectrum and count 0. An empty signal is one frame of silence."""
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(FRAME) / FRAME)
    hz = np.fft.rfftfreq(FRAME, 1 / rate)
    rms, crossings, centroid, roll, width, flux, last = [], [], [], [], [], [], None
    for part in frames(y, "constant"):
        rms.append(np.sqrt((part**2).mean(1)))
        s = np.abs(np.fft.rfft(part * window, axis=1))
        total = s.sum(1)
        p = s / np.where(total > 0, total, 1)[:, None]
        c = p @ hz
        centroid.append(c)
        roll.append(np.where(total > 0, hz[(np.cumsum(s, axis=1) >= ROLL * total[:, None]).argmax(1)], 0.0))
        width.append(np.sqrt((p * (hz - c[:, None]) ** 2).sum(1)))
        log = np.log1p(s)
        before = np.vstack([log[:1] if last is None else last, log[:-1]])
        flux.append(np.maximum(log - before, 0).mean(1))
        last = log[-1:]
    for part in frames(y, "edge"):
        sign = part < 0
        crossings.append((sign[:, 1:] != sign[:, :-1]).sum(1) / FRAME)
    mean = lambda parts: float(np.concatenate(parts).mean())
    return len(y) / rate, tempo(np.concatenate(flux), rate), mean(rms), mean(centroid), mean(roll), mean(crossings), mean(width)


def scan(df: DataFrame, id_col: str, samples: str, rate: float = 22050.0, bits: int = 16) -> DataFrame:
    """(id, NAMES) of a column of little-endian signed samples (8 bits are unsigned), one channel. Null samples are an empty signal; a last half sample is dropped. A row is read whole, its frames a block at a time."""
    kind, zero, size = {8: ("u1", 128.0, 128.0), 16: ("<i2", 0.0, 32768.0), 32: ("<i4", 0.0, 2147483648.0)}[bits]

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                raw = batch.column(1)[i].as_py() or b""
                y = (np.frombuffer(raw, kind, len(raw) // (bits // 8)).astype(float) - zero) / size
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), *(pa.array([v]) for v in features(y, rate))], ["id", *NAMES])

    return df.select(id_col, samples).mapInArrow(run, f"id {df.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{n} double" for n in NAMES)).withColumnRenamed("id", id_col)
