"""One variant's dosages as bytes, in the design's order of subjects: two bits a call, or four bytes a dosage.

The first byte tells the form. Calls 0, 1 and 2 take two bits, four subjects a byte, 3 is missing; anything else is a
32-bit float, missing as not-a-number. Decoding looks bytes up in a table, so that no value passes through Python.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CALLS, DOSES = 2, 4
#: A byte's four calls.
FOUR = np.array([0.0, 1.0, 2.0, np.nan])[(np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3]


def encode_codes(codes: np.ndarray) -> bytes:
    """Calls 0, 1, 2, 3 (missing) as bytes."""
    padded = np.zeros(-(-len(codes) // 4) * 4, np.uint8)
    padded[: len(codes)] = codes
    four = padded.reshape(-1, 4)
    return bytes([CALLS]) + (four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6).astype(np.uint8).tobytes()


def encode(g: np.ndarray) -> bytes:
    """Dosages, missing as not-a-number, as bytes."""
    missing = np.isnan(g)
    codes = np.where(missing, 3, g)
    if np.isin(codes, (0, 1, 2, 3)).all() and not (g == 3).any():
        return encode_codes(codes.astype(np.uint8))
    return bytes([DOSES]) + g.astype("<f4").tobytes()


def decode(column: pa.Array, n: int) -> np.ndarray:
    """Rows of n dosages: of bytes, or of lists of numbers; missing as not-a-number."""
    out = np.full((len(column), n), np.nan)
    if pa.types.is_list(column.type):
        for i, g in enumerate(column):
            if g.is_valid:
                out[i] = g.values.to_numpy(zero_copy_only=False)
        return out
    for i, value in enumerate(column):
        data = value.as_buffer()
        if data is not None:
            kind = memoryview(data)[0]
            out[i] = FOUR[np.frombuffer(data, np.uint8, offset=1)].reshape(-1)[:n] if kind == CALLS else np.frombuffer(data, "<f4", n, 1)
    return out
