"""From edges to candidate frames, and to the frames that stay.

Time is cut into blocks longer than a frame, and many blocks make a stretch; each stretch is decoded by one task, so a long
capture is spread over as many tasks as it has stretches. The candidates that start in a block need its edges, those of
the blocks beside it and one edge more at both ends; a stretch therefore sees the block before it, the block behind it and
the edges that lie beside those, and decodes its own starts only. Edges stream by, so no more than a few blocks are held.
Duplicates are settled where they arise; only candidates near the ends of a stretch wait until all stretches are done.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import ROUND_CEILING, ROUND_FLOOR, Decimal
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import UNKNOWN_ACTION, UNKNOWN_CHANNEL, Profile, Rules, commands
from ..functions.bits import text_to_bytes
from ..storage import cut
from .blocks import along

#: Outcomes of the recovery of a missing last bit (fixed values).
NOT_NEEDED = "不适用，CSV已直接恢复104 bit"
TOO_SHORT = "恢复失败，直接恢复不足103 bit，禁止补齐"
NO_EDGE = "恢复失败，未采集第104 bit起始边沿"
BAD_EDGE = "恢复失败，最后边沿不符合第104 bit预期起点及局部周期约束"
EXTENDED = "恢复成功，最后1 bit电平已记录，仅缺结束边界，延伸最后已知电平到正式帧估算结束时间"
#: Reasons of an invalid frame, in order (fixed values).
TRUNCATED, BAD_HEADER, BAD_ID, BAD_COMMAND, BAD_TAIL = "正式帧数据截断", "帧头不匹配", "遥控器 ID 不匹配", "命令字节未知", "尾帧不匹配"
CORE_TRUNCATED = "核心帧数据截断"


#: The type of exact times (s).
TIME_TYPE = "decimal(20,12)"
#: Digits of the ratios that decide between candidates; the rest is rounding.
DIGITS = 9
#: Blocks that are decoded at once: few enough for times since the first one to be exact to a millionth of a us.
TOGETHER = 1000
#: Blocks of the line on which pieces of captures are decoded together: few enough for its tables to stay in a cache.
LINE_BLOCKS = 80
#: Blocks of a stretch, half a minute with the shipped rules: what one task decodes at least.
STRETCH_BLOCKS = 400


def block_us(rules: Rules) -> int:
    return int(150 * rules.pulse_max_us) + 1


def marked(edges: DataFrame, rules: Rules, stretch_blocks: int = STRETCH_BLOCKS) -> DataFrame:
    """capture_id, stretch, edge_idx, tick (block of time), us (since it began), level, beyond; sorted by capture, stretch and
    edge. An edge in the last or first block of a stretch is also in the neighbour's rows. beyond: -1 for the last edge
    before all that a stretch sees, 1 for the first one behind it, 0 for what it sees.

    A stretch has three parts: its first block, its last one, and those between. What a stretch sees begins and ends with
    a part; the edges before and behind come from a summary of the parts (one row each)."""
    size = Decimal(block_us(rules)) / 1_000_000
    rows = edges.select(F.col("capture_id").cast("string").alias("capture_id"), F.col("edge_idx").cast("long").alias("edge_idx"), "t", F.col("level").cast("int").alias("level"))
    tick = F.floor(F.col("t").cast("double") / float(size)).cast("long")
    stretch, place = F.floor(F.col("tick") / stretch_blocks).cast("long"), F.pmod("tick", F.lit(stretch_blocks))
    at_start, at_end = place == 0, place == stretch_blocks - 1
    low, high = stretch - at_start.cast("long"), stretch + at_end.cast("long")  # the stretches that see an edge
    rows = rows.withColumn("tick", tick).withColumns({"_low": low, "_high": high})

    parts = rows.withColumn("edge_block", stretch * 3 + F.when(at_end, 2).when(at_start, 0).otherwise(1))
    by = lambda pick, end: [end("edge_idx").alias("edge_idx"), *[pick(c, "edge_idx").alias(c) for c in ("t", "level")]]
    first, last = by(F.min_by, F.min), by(F.max_by, F.max)
    ends = parts.groupBy("capture_id", "edge_block", "_low", "_high").agg(*[c.alias(f"{name}{k}") for name, cols in (("_a", first), ("_z", last)) for k, c in enumerate(cols)])
    edge = lambda name: F.struct(*[F.col(f"{name}{k}").alias(c) for k, c in enumerate(("edge_idx", "t", "level"))], "_low", "_high")
    ends = ends.select("capture_id", F.lead(edge("_a")).over(along()).alias("_next"), edge("_z").alias("_last")).where("_next IS NOT NULL")
    step = lambda edge, a, z, side: ends.where(a <= z).select(
        "capture_id", F.explode(F.sequence(a, z)).alias("stretch"), f"{edge}.edge_idx", f"{edge}.t", f"{edge}.level", F.lit(side).alias("beyond")
    )
    behind = step("_next", F.col("_last._low"), F.least(F.col("_last._high"), F.col("_next._low") - 1), 1)
    before = step("_last", F.greatest(F.col("_next._low"), F.col("_last._high") + 1), F.col("_next._high"), -1)
    views = F.explode(F.when(F.col("_low") == F.col("_high"), F.array("_low")).otherwise(F.sequence("_low", "_high")))
    seen = rows.select("capture_id", views.alias("stretch"), "edge_idx", "t", "level", F.lit(0).alias("beyond"))
    rows = seen.unionByName(before).unionByName(behind).withColumn("tick", tick)

    us = ((F.col("t") - F.col("tick").cast("decimal(12,0)") * F.lit(size)) * 1_000_000).cast("double")
    if edges.schema["t"].dataType.simpleString() == TIME_TYPE:  # whole units of the last decimal, where they fit a long
        fine = (F.col("t") * F.lit(Decimal(10**12))).cast("long") - F.col("tick") * int(size * 10**12)
        us = F.when(F.abs("tick") < int(9_000_000 / size), fine / 1e6).otherwise(us)
    rows = rows.select("capture_id", "stretch", "edge_idx", "tick", us.alias("us"), "level", "beyond")
    return rows.repartition("capture_id", "stretch").sortWithinPartitions("capture_id", "stretch", "edge_idx")


@dataclass
class Slices:
    """Pieces of captures one behind the other, for all of whose start edges at once: times since the first block of each
    (tl) and on a line on which no two pieces are near each other (t = tl + off), the piece of each edge (part), and for each
    piece where it begins and ends, its last edge's time if the capture ends there (else inf), and that edge's level, the
    time of the one before it and its level (NaN where there is none)."""

    tl: np.ndarray
    part: np.ndarray
    edge_idx: np.ndarray
    level: np.ndarray
    one: np.ndarray
    own: np.ndarray
    off: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    tail: np.ndarray  # rows: last, last_level, before, before_level

    def __post_init__(self):
        self.t = self.tl + self.off[self.part]

    def at_edge(self, at: np.ndarray, part: np.ndarray) -> np.ndarray:
        """The last edge at or before each time; ``part`` in as many dimensions as ``at``."""
        return np.searchsorted(self.t, (at + self.off[part]).ravel(), "right").reshape(at.shape) - 1


class BlockDecoder:
    def __init__(self, rules: Rules, inverted: bool):
        self.r, self.inverted = rules, inverted
        self.marker, self.transitions = np.array(rules.marker_bits), np.array(rules.transitions, float)
        self.residual, self.tail = float(rules.max_residual), float(rules.tail_tolerance)
        self.low, self.high = float(rules.pulse_min_us), float(rules.pulse_max_us)
        same = [i for i in range(1, len(self.marker)) if self.marker[i] == self.marker[i - 1]]
        self.telling = np.array(sorted({x for i in same[:2] for x in (i - 1, i)})) if same else np.arange(len(self.marker))

    def sample(self, s: Slices, bit, part, start, period, n):
        """For each row: bits, how many could be sampled, least distance to an edge in periods."""
        at = start[:, None] + period[:, None] * np.arange(n)[None, :]
        lo, hi, last = s.lo[part], s.hi[part], s.tail[0][part]
        i, count = s.at_edge(at, part[:, None]), np.full(len(at), n)
        cut = np.flatnonzero((i[:, 0] < lo) | (i[:, -1] + 1 >= hi) | (at[:, -1] >= last))  # times rise, so these rows alone
        if len(cut):
            bad = (at[cut] >= last[cut, None]) | (i[cut] < lo[cut, None]) | (i[cut] + 1 >= hi[cut, None])
            count[cut] = np.where(bad.any(axis=1), bad.argmax(axis=1), n)
            i[cut] = np.minimum(np.maximum(i[cut], lo[cut, None]), hi[cut, None] - 1)
        j = np.minimum(i, hi[:, None] - 2) if len(cut) else i
        near = np.minimum(at - s.tl[j], s.tl[j + 1] - at)
        if len(cut):
            near[cut] = np.where(np.arange(n) < count[cut, None], near[cut], np.inf)
        return bit[i], count, np.where(count > 0, near.min(axis=1) / period, 0.0)

    def refined(self, s: Slices, first, start, period):
        """The fits over the edges nearest to the marker's transitions, each after the one before: which rows have one, the
        edge of the first transition, period, intercept and residual."""
        part = s.part[first]
        off, p = s.off[part, None], part[:, None]
        at, half = start[:, None] + period[:, None] * self.transitions, period[:, None] / 2
        limit = np.minimum(s.at_edge(start + period * (len(self.marker) + 1), part) + 1, s.hi[part])[:, None]
        left = lambda x: np.searchsorted(s.t, x.ravel(), "left").reshape(x.shape)
        a, b = np.maximum(left(at - half + off), first[:, None]), np.minimum(s.at_edge(at + half, p) + 1, limit)
        some = (a < b).all(axis=1)
        j, a, most = left(at + off), np.where(some[:, None], a, 0), np.where(some[:, None], b - 1, 0)
        i, k = np.minimum(np.maximum(j - 1, a), most), np.minimum(np.maximum(j, a), most)
        k = np.where(np.abs(s.tl[i] - at) <= np.abs(s.tl[k] - at), i, k)
        k = np.maximum(left(s.t[k]), a)
        for row in np.flatnonzero(some & (np.diff(k, axis=1) <= 0).any(axis=1)).tolist():  # two transitions want one edge
            upto, picked = 0, []
            for x, lo, hi in zip(at[row].tolist(), a[row].tolist(), (most[row] + 1).tolist(), strict=True):
                lo = max(lo, upto)
                if lo >= hi:
                    some[row] = False
                    break
                picked.append(min(range(lo, hi), key=lambda i: abs(s.tl[i] - x)))  # noqa: B023
                upto = picked[-1] + 1
            else:
                k[row] = picked
        y, x = s.tl[k] - s.tl[k[:, :1]], self.transitions
        mx, my = x.mean(), y.mean(axis=1)
        slope = ((x - mx) * (y - my[:, None])).sum(axis=1) / ((x - mx) ** 2).sum()
        intercept = my - slope * mx
        residual = np.abs(y - (intercept[:, None] + slope[:, None] * x)).max(axis=1)
        some &= (np.diff(y, axis=1) > 0).all(axis=1) & (slope > 0)
        some[some] &= residual[some] / slope[some] <= self.residual
        return some, k[:, 0], slope, intercept, residual

    def initial_fits(self, s: Slices, bit, starts, run):
        """Start edge, pulses, period, residual and sync start of the runs whose fit is good and shows the marker."""
        end = s.hi[s.part[starts]] - 1
        n = np.minimum(run[starts], end - starts)
        x = np.arange(self.r.max_pulses + 1)
        inside = x[None, :] <= n[:, None]
        y = s.tl[np.minimum(starts[:, None] + x, end[:, None])] - s.tl[starts][:, None]
        rising = (np.diff(y, axis=1) > 0) | ~inside[:, 1:]
        mx, my = n / 2, (y * inside).sum(axis=1) / (n + 1)
        dx = (x[None, :] - mx[:, None]) * inside
        slope = (dx * (y - my[:, None])).sum(axis=1) / (dx * dx).sum(axis=1)
        intercept = my - slope * mx
        residual = (np.abs(y - (intercept[:, None] + slope[:, None] * x)) * inside).max(axis=1)
        good = rising.all(axis=1) & (slope > 0)
        good[good] &= residual[good] / slope[good] <= self.residual
        starts, n, slope, residual = starts[good], n[good], slope[good], residual[good]
        sync, part = s.tl[starts] + intercept[good], s.part[starts]
        k, phase = (x.ravel() for x in np.indices((len(starts), self.r.phases)))
        for bits in (*self.telling[:, None], np.arange(len(self.marker))):  # single bits rule out most places and phases
            p = part[k, None]
            at = sync[k, None] + slope[k, None] * (phase[:, None] / self.r.phases + bits)
            i = s.at_edge(at, p)
            ok = (at < s.tail[0][p]) & (i >= s.lo[p]) & (i + 1 < s.hi[p]) & (bit[np.minimum(np.maximum(i, 0), len(bit) - 1)] == self.marker[bits])
            k, phase = k[ok.all(axis=1)], phase[ok.all(axis=1)]
        k = np.unique(k)
        return starts[k], n[k], slope[k], residual[k], sync[k]

    def preferred(self, start, full, near, values):
        """Of the rows of a start edge that read the same whole frame (rows of it lie together), the preferred one."""
        rows = np.arange(len(start))
        first = np.flatnonzero(np.r_[True, start[1:] != start[:-1]])
        group = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(start)]))
        odd = np.zeros(len(first), bool)
        odd[group[~full | (values != values[first][group]).any(axis=1)]] = True
        order = np.lexsort((rows, -near, group))
        stay = order[first][~odd].tolist()
        for g in np.flatnonzero(odd).tolist():
            seen = {}
            for k in order[first[g] : first[g] + np.count_nonzero(group == g)].tolist():
                seen.setdefault(values[k].tobytes() if full[k] else k, k)
            stay += seen.values()
        return np.sort(np.array(stay, int))

    def found(self, s: Slices, best_only=False) -> dict | None:
        """The candidates of all pieces as columns (see ``_CANDIDATE``), with their piece (part). best_only: of a start
        edge's phases that read the same whole frame, the preferred one alone; the others start at the same time, so they
        are its duplicates."""
        r, size = self.r, len(s.tl)
        bit = (1 - s.level if self.inverted else s.level).astype(np.uint8)
        stops, here = np.flatnonzero(~s.one), np.arange(size)
        run = np.minimum(stops[np.searchsorted(stops, here)] - here, r.max_pulses)
        starts = np.flatnonzero(s.own & (run >= r.min_pulses) & (here < s.hi[s.part] - 1))
        if not len(starts):
            return None
        first, pulses, first_period, first_residual, start = self.initial_fits(s, bit, starts, run)
        some, at, period, intercept, residual = self.refined(s, first, start, first_period)
        keep = np.flatnonzero(some)
        if not len(keep):
            return None
        first, pulses, first_period, first_residual = (x[keep] for x in (first, pulses, first_period, first_residual))
        period, residual, sync = period[keep], residual[keep], s.tl[at[keep]] + intercept[keep]
        part, n = s.part[first], len(self.marker)
        c, k = (x.ravel() for x in np.indices((len(first), r.phases)))
        phase = k * (period[c] / r.phases)
        bits, count, _ = self.sample(s, bit, part[c], sync[c] + phase, period[c], n)
        ok = (count == n) & (bits == self.marker).all(axis=1)
        c, phase = c[ok], phase[ok]
        if not len(c):
            return None
        n, begin = r.frame_bits, sync + period * r.prelude_bits
        end = begin + period * n
        bits, count, near = self.sample(s, bit, part[c], begin[c] + phase, period[c], n)
        if best_only:
            k = self.preferred(c, count == n, np.round(near, DIGITS), bits)
            c, phase, bits, count, near = c[k], phase[k], bits[k], count[k], near[k]
        p, step = part[c], period[c]
        status, extended, figures, safe = self.recovered(count, begin[c], end[c], step, phase, *s.tail[:, p])
        near = np.where(extended, np.minimum(near, safe), near)
        last = s.tail[1][p]
        bits[extended, n - 1] = (1 - last if self.inverted else last)[extended]
        i = np.maximum(np.searchsorted(s.t, end + s.off[part], "left") - 1, s.lo[part])
        first = first[c]
        return {
            "part": p, "edge_idx": s.edge_idx[first], "pulses": pulses[c], "initial_period_us": first_period[c], "initial_residual_us": first_residual[c], "period_us": step,
            "residual_us": residual[c], "phase_us": phase, "phase_no": np.round(phase * r.phases / step).astype(np.int64), "prelude_us": s.tl[first], "associated_us": s.tl[i[c]],
            "start_us": begin[c], "end_us": end[c], "direct_bits": count, "bits": bits, "bytes": count + extended, "tail_deviation_us": figures[0], "tail_tolerance_us": figures[1],
            "previous_pulse_error_us": figures[2], "tail_status": status, "tail_extended": extended, "safety_ratio": near,
        }

    def candidates(self, us, edge_idx, level, one, own, last, last_level, before, before_level, best_only=False):
        """The same of one piece, as tuples in the order of ``_CANDIDATE``."""
        if len(us) > 1:
            none = lambda x: np.nan if x is None else x
            one = np.r_[np.asarray(one, bool)[:-1], False]
            piece = Slices(
                np.asarray(us, float), np.zeros(len(us), int), np.asarray(edge_idx), np.asarray(level, np.int64), one, np.asarray(own, bool), np.zeros(1), np.zeros(1, int),
                np.array([len(us)]), np.array([[last], [none(last_level)], [none(before)], [none(before_level)]], float),
            )
            for _, row in tuples(self.found(piece, best_only)):
                yield row

    def recovered(self, count, begin, end, period, phase, last, last_level, before, before_level):
        """Of each row: its outcome (a place in OUTCOMES), whether a bit is added, (deviation, tolerance, previous pulse's
        error; NaN where they do not apply), and the safety of the added bit."""
        n = self.r.frame_bits
        tried = (count == n - 1) & (before == before)  # not NaN
        due, tolerance, pulse = begin + period * (n - 1), period * self.tail, last - before
        sample = begin + phase + period * (n - 1)
        with np.errstate(invalid="ignore"):
            deviation, error = np.abs(last - due), np.abs(pulse - period)
            tiny = 1e-6  # a billionth of a millisecond: inclusive bounds hold in spite of rounding
            good = (
                tried & (before < last) & (before_level != last_level) & (deviation <= tolerance + tiny) & (self.low - tiny <= pulse) & (pulse <= self.high + tiny)
                & (error <= period * float(self.r.previous_pulse_tolerance) + tiny) & (last <= sample) & (sample < end)
            )
            status = np.select([count == n, ~tried, good, last < due - tolerance], [0, 1, 4, 2], 3)
            figures = [np.where(tried, x, np.nan) for x in (deviation, tolerance, error)]
            return status, good, figures, np.where(good, (sample - last) / period, np.inf)


#: What ``BlockDecoder.recovered`` gives places in.
OUTCOMES = (NOT_NEEDED, TOO_SHORT, NO_EDGE, BAD_EDGE, EXTENDED)

_CANDIDATE = {
    "edge_idx": pa.int64(), "pulses": pa.int32(), "initial_period_us": pa.float64(), "initial_residual_us": pa.float64(), "period_us": pa.float64(),
    "residual_us": pa.float64(), "phase_us": pa.float64(), "phase_no": pa.int32(), "prelude_us": pa.float64(), "associated_us": pa.float64(), "start_us": pa.float64(),
    "end_us": pa.float64(), "direct_bits": pa.int32(), "bits": pa.string(), "bytes": pa.list_(pa.int32()), "tail_deviation_us": pa.float64(), "tail_tolerance_us": pa.float64(),
    "previous_pulse_error_us": pa.float64(), "tail_status": pa.string(), "tail_extended": pa.bool_(), "safety_ratio": pa.float64(),
}
_DDL = {pa.int64(): "long", pa.int32(): "int", pa.float64(): "double", pa.string(): "string", pa.bool_(): "boolean", pa.list_(pa.int32()): "array<int>"}


def values_of(found: dict, name: str) -> list:
    """A column of what ``BlockDecoder.found`` gives, as it goes into tables."""
    if name == "bits":
        n, text = found["bits"].shape[1], (found["bits"] + 48).tobytes().decode()
        return [text[k * n : k * n + m] for k, m in enumerate(found["bytes"].tolist())]
    if name == "bytes":
        return [v[: m // 8] for v, m in zip(np.packbits(found["bits"], axis=1).tolist(), found["bytes"].tolist(), strict=True)]
    if name == "tail_status":
        return [OUTCOMES[k] for k in found[name].tolist()]
    values = found[name].tolist()
    return [None if v != v else v for v in values] if name in ("tail_deviation_us", "tail_tolerance_us", "previous_pulse_error_us") else values


def tuples(found: dict | None):
    """(piece, row in the order of ``_CANDIDATE``) of what ``BlockDecoder.found`` gives."""
    if found is not None:
        yield from zip(found["part"].tolist(), zip(*(values_of(found, c) for c in _CANDIDATE), strict=True), strict=True)


class EdgeStream:
    """Candidates of sorted rows of ``marked`` that come in batches, one stretch of a capture after the other.

    ``feed`` gives the pieces that a batch ends or carries on as (capture_id, stretch, block up to which all is known), that
    number None at a stretch's end, and what is found in them as tables of ``BlockDecoder.found`` whose part is the
    piece, with the block that times count from. Pieces of many captures are decoded together. No more is held than the
    edges of blocks that wait for the next one's."""

    def __init__(self, rules: Rules, inverted: bool, stretch_blocks: int = STRETCH_BLOCKS, best_only: bool = False):
        self.best_only = best_only
        self.decoder, self.size, self.stretch_blocks = BlockDecoder(rules, inverted), float(block_us(rules)), stretch_blocks
        self.key, self.held, self.done = None, None, None
        finest = lambda us, way: float((us * 1_000_000).to_integral_value(way)) / 1_000_000
        self.low, self.high = finest(rules.pulse_min_us, ROUND_CEILING) - 5e-7, finest(rules.pulse_max_us, ROUND_FLOOR) + 5e-7

    def feed(self, batch: pa.RecordBatch) -> tuple[list[tuple], list[dict]]:
        names = batch.column(0).dictionary_encode(null_encoding="encode")
        stretch, *columns = (c.to_numpy(zero_copy_only=False) for c in batch.columns[1:])
        code, pieces, parts = names.indices.to_numpy(zero_copy_only=False), [], []
        new = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (stretch[1:] != stretch[:-1])]).tolist() if len(stretch) else []
        for a, z in zip(new, [*new[1:], len(stretch)], strict=True):
            key, part = (names.dictionary[int(code[a])].as_py(), int(stretch[a])), [c[a:z] for c in columns]
            if self.held is not None and key == self.key:
                part = [np.concatenate(x) for x in zip(self.held, part, strict=True)]
            else:
                if self.held is not None:
                    parts += self._parts(self.held, True, pieces)
                self.key, self.done = key, key[1] * self.stretch_blocks - 1
            self.held = part
            if z < len(stretch):
                parts += self._parts(part, True, pieces)
                self.held = None
            else:
                parts += self._parts(part, False, pieces)
        return pieces, self._decoded(parts)

    def end(self) -> tuple[list[tuple], list[dict]]:
        pieces: list[tuple] = []
        parts = self._parts(self.held, True, pieces) if self.held is not None else []
        self.key = self.held = None
        return pieces, self._decoded(parts)

    def _parts(self, rows, ended, pieces) -> list[tuple]:
        """What of a stretch's rows can be decoded: (piece, first and last block, columns, own, tail)."""
        edge_idx, tick, us, level, _ = rows
        final = (self.key[1] + 1) * self.stretch_blocks - 1
        upto = final if ended else min(int(tick[-1]) - 2, final)  # the next block's edges, and one more, are there
        if not ended and upto <= self.done:
            return []
        pulse = np.diff(us) + np.diff(tick) * self.size  # times are whole millionths of a us, so bounds can be inclusive
        one = np.append((pulse >= self.low) & (pulse <= self.high), False)
        inside = one & (tick > self.done) & (tick <= upto)
        live = tick[inside]
        live = live[np.r_[True, live[1:] != live[:-1]]] if len(live) else live
        at_end, out = ended and rows[4][-1] == 0, []
        groups = np.split(live, np.flatnonzero(np.diff((live - live[0]) // TOGETHER)) + 1) if len(live) else []
        for b, upper in ((int(g[0]), int(g[-1])) for g in groups):
            (i, before), (j, behind) = np.searchsorted(tick, (b, b - 1), "left").tolist(), np.searchsorted(tick, (upper, upper + 1), "right").tolist()
            a, z = max(before - 1, 0), min(behind + 1, len(tick))
            t = us[a:z] + (tick[a:z] - b) * self.size
            own = np.zeros(z - a, bool)
            own[i - a : j - a] = True
            tail = [np.inf, np.nan, np.nan, np.nan]
            if at_end:
                ends = us[-2:] + (tick[-2:] - b).astype(float) * self.size
                tail = [ends[-1], level[-1], ends[0] if len(ends) > 1 else np.nan, level[-2] if len(ends) > 1 else np.nan]
            out.append((len(pieces), b, upper, t, edge_idx[a:z], level[a:z], one[a:z], own, tail))
        pieces.append((*self.key, None if ended else upto))
        if not ended:
            self.done = max(self.done, upto)
            keep = max(int(np.searchsorted(tick, self.done, "left")) - 1, 0)
            self.held = [x[keep:] for x in rows]
        return out

    def _decoded(self, parts: list[tuple]) -> list[dict]:
        """Parts side by side on lines of LINE_BLOCKS, a longer part on one of its own. An edge far outside a part's blocks (the
        one before and the one behind them) counts as one at a distance that no frame spans."""
        out, group, used = [], [], 0
        for part in [*parts, None]:
            width = 0 if part is None else part[2] - part[1] + 7
            if group and (part is None or used + width > LINE_BLOCKS):
                out += self._together(group)
                group, used = [], 0
            if part is not None:
                group.append((part, used))
                used += width
        return out

    def _together(self, group: list[tuple]) -> list[dict]:
        size, parts = self.size, [p for p, _ in group]
        lengths = np.array([len(p[3]) for p in parts])
        hi = np.cumsum(lengths)
        one = np.concatenate([p[6] for p in parts])
        one[hi - 1] = False
        tl = np.concatenate([np.clip(t, -1.5 * size, (upper - b + 3.5) * size) for _, b, upper, t, *_ in parts])
        join = lambda k: np.concatenate([p[k] for p in parts])
        off = np.array([(used + 2) * size for _, used in group])
        found = self.decoder.found(
            Slices(tl, np.repeat(np.arange(len(parts)), lengths), join(4), join(5).astype(np.int64), one, join(7), off, hi - lengths, hi, np.array([p[8] for p in parts]).T), self.best_only
        )
        if found is None:
            return []
        of, block = (np.array([p[k] for p in parts])[found["part"]] for k in (0, 1))
        return [found | {"part": of, "block": block}]


def _finished(found: DataFrame, rules: Rules, capture) -> DataFrame:
    """Times in seconds and the derived columns of decoded rows."""
    size = Decimal(block_us(rules)) / 1_000_000
    base = F.col("block").cast("decimal(12,0)") * F.lit(size)
    exact = lambda c: (base + F.round(c, 6).cast("decimal(18,6)") * F.lit(Decimal("0.000001"))).cast("decimal(20,12)")
    double = lambda c: base.cast("double") + F.col(c) / 1e6
    found = found.withColumns({"prelude_t": exact("prelude_us"), "associated_t": exact("associated_us"), "start_t": double("start_us"), "end_t": double("end_us")})
    found = found.withColumns({
        "initial_residual_ratio": F.col("initial_residual_us") / F.col("initial_period_us"), "initial_threshold_us": F.col("initial_period_us") * float(rules.max_residual),
        "residual_ratio": F.col("residual_us") / F.col("period_us"), "threshold_us": F.col("period_us") * float(rules.max_residual),
        "phase_step_us": F.col("period_us") / rules.phases, "final_bits": F.length("bits"), "capture_id": F.col("capture_id").cast(capture),
    })
    return found.drop("block", "prelude_us", "associated_us", "start_us", "end_us")


def _schema() -> tuple[pa.Schema, str]:
    rows = pa.schema([("capture_id", pa.string()), ("settled", pa.bool_()), ("block", pa.int64()), *_CANDIDATE.items()])
    return rows, "capture_id string, settled boolean, block long, " + ", ".join(f"{c} {_DDL[t]}" for c, t in _CANDIDATE.items())


def _streamed(edges: DataFrame, profile: Profile, settle, stretch_blocks: int = STRETCH_BLOCKS) -> DataFrame:
    """Decoded rows of all captures, without a start edge's phases that read the same frame; ``settle()`` gives a
    function from a piece of ``EdgeStream`` and its candidates (block, ...) to the rows that stay."""
    rules, inverted = profile.rules, profile.inverted
    schema, ddl = _schema()

    def run(batches):
        stream, stay, out = EdgeStream(rules, inverted, stretch_blocks, True), settle(), []
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        for b in chain(batches, (None,)):
            pieces, tables = stream.end() if b is None else stream.feed(b)
            found = [[] for _ in pieces]
            for table in tables:
                for block, (k, row) in zip(table["block"].tolist(), tuples(table), strict=True):
                    found[k].append((block, *row))
            for piece, rows in zip(pieces, found, strict=True):
                out += stay(*piece, rows)
            if len(out) >= 500 or out and b is None:
                yield batch()
                out = []

    return marked(edges, rules, stretch_blocks).mapInArrow(run, ddl)


def candidates(edges: DataFrame, profile: Profile, only: tuple[str, ...] = ()) -> DataFrame:
    """One row for each confirmed start edge and phase, times in seconds: those of edges as exact decimals, others as
    doubles. Invalid candidates are kept; without a confirmed marker there is none, nor in an empty table. Null captures
    are one capture; other columns are not read. only: these columns alone (beside capture_id), as they are decoded."""
    rules, inverted = profile.rules, profile.inverted
    wanted = only or tuple(_CANDIDATE)
    schema = pa.schema([("capture_id", pa.string()), ("block", pa.int64()), *((c, _CANDIDATE[c]) for c in wanted)])

    def run(batches):
        stream = EdgeStream(rules, inverted)
        for b in chain(batches, (None,)):
            pieces, tables = stream.end() if b is None else stream.feed(b)
            names = [capture for capture, _, _ in pieces]
            for table in tables:
                columns = [[names[k] for k in table["part"].tolist()], table["block"], *(values_of(table, c) for c in wanted)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    found = marked(edges, rules).mapInArrow(run, "capture_id string, block long, " + ", ".join(f"{c} {_DDL[_CANDIDATE[c]]}" for c in wanted))
    capture = edges.schema["capture_id"].dataType
    return found.select(F.col("capture_id").cast(capture).alias("capture_id"), *only) if only else _finished(found, rules, capture)


def frames(edges: DataFrame, profile: Profile, stretch_blocks: int = STRETCH_BLOCKS) -> DataFrame:
    """The candidates that stay when duplicates have gone. ``dedup.Settler`` settles them where they are decoded, those
    near the ends of a stretch when all are there, by the same rule. The edges are decoded once, when this is called."""
    from .dedup import Settler, settled_islands

    found = cut(_streamed(edges, profile, lambda: Settler(profile, stretch_blocks).feed, stretch_blocks), "decoded")
    rest = settled_islands(found.where("NOT settled").drop("settled"), profile)
    rows = found.where("settled").drop("settled").unionByName(rest)
    return _finished(rows, profile.rules, edges.schema["capture_id"].dataType)


def failure_reasons(values: Column, command_known: Column, profile: Profile, core: bool = False) -> Column:
    """Why the bytes of a frame are not valid, in a fixed order; ``core``: the older form that begins with the whole
    marker, already cut to the formal bytes."""
    r = profile.rules
    same = lambda at, want: F.slice(values, at + 1, len(want)) == F.array(*[F.lit(b) for b in want])
    complete = F.size(values) >= r.frame_bytes
    return F.array_compact(F.array(
        F.when(~complete, CORE_TRUNCATED if core else TRUNCATED), F.when(complete & ~same(0, r.header), BAD_HEADER), F.when(complete & ~same(r.id_at, profile.remote_id), BAD_ID),
        F.when(complete & ~command_known, BAD_COMMAND), F.when(complete & ~same(r.tail_at, r.tail), BAD_TAIL),
    ))


def with_commands(frames: DataFrame, rules: Rules, bytes_col: str = "bytes") -> DataFrame:
    """``frames`` with channel, action and command_known. A frame too short for a command looks up FF. The command
    table is as large as its configuration, 256 rows at most."""
    known = F.broadcast(commands(frames.sparkSession, rules))
    code = F.coalesce(F.get(bytes_col, F.lit(rules.command_at)), F.lit(255))
    out = frames.withColumn("code", code).join(known, "code", "left").drop("code")
    hit = F.col("channel").isNotNull()
    return out.withColumns({"channel": F.coalesce("channel", F.lit(UNKNOWN_CHANNEL)), "action": F.coalesce("action", F.lit(UNKNOWN_ACTION)), "command_known": hit})


def validated(frames: DataFrame, profile: Profile) -> DataFrame:
    """``frames`` (column bits, and bytes if they are known) with bytes, complete, reasons, valid, channel, action."""
    if "bytes" not in frames.columns:
        frames = frames.withColumn("bytes", text_to_bytes(F.col("bits")))
    rows = with_commands(frames, profile.rules)
    rows = rows.withColumn("reasons", failure_reasons(F.col("bytes"), F.col("command_known"), profile)).drop("command_known")
    return rows.withColumns({"complete": F.size("bytes") >= profile.rules.frame_bytes, "valid": F.size("reasons") == 0})
