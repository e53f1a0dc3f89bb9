"""Word shingles of a text as hashes, and the SimHash fingerprint of them."""

from __future__ import annotations


def shingle_hashes(text: str | None, shingle: int):
    """XXH64 (seed 42) of each shingle, repeats included; none for a text without words."""
    import numpy as np
    import xxhash

    ws = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes.lower and bytes.split know ASCII alone
    if not ws:
        return np.zeros(0, np.uint64)
    line = b" ".join(ws)
    digest = xxhash.xxh64_intdigest
    if len(ws) <= shingle:
        return np.array([digest(line, 42)], np.uint64)
    ends, at = [], -1
    for w in ws:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[:-shingle]]]
    return np.fromiter((digest(line[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :], strict=True)), np.uint64, len(starts))


def fingerprint(hashes) -> int:
    """The 64 bits as a signed number; a bit is 1 if it is set in over half the hashes."""
    import numpy as np

    sums = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65536):
        sums += np.unpackbits(hashes[k : k + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * sums > len(hashes)).tobytes(), "big", signed=True)
