"""Captures that come in one batch are decoded in a few calls, and as each would be alone."""

import pyarrow as pa

from edgewright import config
from edgewright.operators import decode

PROFILE = config.load_config().profile("remote-b04287")
NAMES = ("capture_id", "stretch", "edge_idx", "tick", "us", "level", "beyond")


def capture(name, frames, cut=0):
    """Rows of ``marked`` of a capture of some frames, without its last ``cut`` edges."""
    rows, t, size = [], 50_000, decode.block_us(PROFILE.rules)
    for k in range(frames):
        body = [0xAA, 0xAA, 0x2D, 0xD4, 1, k, len(name), 4, 0xB0, 0x42, 0x87, 9, 0x21, 0xAA, 0xAA]
        before = 1
        for i, b in enumerate([*config.byte_bits(body), 1]):
            if b != before:
                at = t + i * 416 + (7 * i + k) % 11
                rows.append((name, 0, len(rows), at // size, float(at % size), 1 - b, 0))
            before = b
        t += 240 * 416
    return rows[: len(rows) - cut]


def decoded(batches, best_only):
    stream, calls, out = decode.EdgeStream(PROFILE.rules, PROFILE.inverted, best_only=best_only), [], []
    inner = stream.decoder.found
    stream.decoder.found = lambda s, best: calls.append(1) or inner(s, best)
    for b in [*batches, None]:
        pieces, tables = stream.end() if b is None else stream.feed(pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*b, strict=True)], names=NAMES))
        for table in tables:
            size = stream.size
            for block, (k, row) in zip(table["block"].tolist(), decode.tuples(table), strict=True):
                r = dict(zip(decode._CANDIDATE, row, strict=True))
                times = [round(block * size + r.pop(c), 4) for c in ("prelude_us", "associated_us", "start_us", "end_us")]
                out.append((pieces[k][0], *times, *(round(v, 6) if isinstance(v, float) else str(v) for v in r.values())))
    return sorted(out), len(calls)


def test_many_captures_in_one_call():
    captures = [capture(f"c{k:03}", 1 + k % 3, k % 4) for k in range(60)]
    for best_only in (True, False):
        alone, calls = zip(*(decoded([c], best_only) for c in captures), strict=True)
        together, few = decoded([[r for c in captures for r in c]], best_only)
        assert together == sorted(r for rows in alone for r in rows) and len(together) >= 110
        assert few < sum(calls) / 3
        rows = [r for c in captures for r in c]
        assert decoded([rows[k : k + 37] for k in range(0, len(rows), 37)], best_only)[0] == together
