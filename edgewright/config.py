"""Rules and remote profiles: the shipped configuration, a closed validator and typed views.

A configuration is a small document that a driver reads once; what it resolves to is passed to the operators as a
frozen object, and the dimension tables are DataFrames of its rows.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .errors import CaptureError

#: The shipped configuration (fixed values).
DEFAULT_CONFIG = {
    "schemaVersion": 1,
    "remoteConfigs": [
        {
            "key": "remote-b04287", "name": "NRZ-L 类遥控器（B0 42 87）", "remoteId": "B0 42 87", "charset": "GBK",
            "idleThresholdMs": 40, "idleLevel": 0, "levelMapping": "inverted", "protocolRuleKey": "nrzlDefault",
        }
    ],
    "protocolRuleSets": [
        {
            "key": "nrzlDefault", "name": "NRZ-L 104 位帧规则",
            "timing": {
                "nominalBitPeriodUs": 416, "prefilterToleranceRatio": Decimal("0.20"), "minValidPulseCount": 5,
                "maxInitialFitPulseCount": 16, "maxFitResidualRatio": Decimal("0.15"),
                "tailEdgeToleranceRatio": Decimal("0.35"), "phaseCount": 16, "dedupToleranceRatio": Decimal("0.50"),
            },
            "frame": {
                "syncMarkerHex": "AA 2D D4", "formalHeaderHex": "2D D4", "formalFrameBits": 104, "remoteIdByteOffset": 6,
                "commandByteOffset": 10, "tailByteOffset": 11, "tailHex": "AA AA",
            },
            "commands": [
                {"code": "01", "channel": "通道1", "action": "停"}, {"code": "02", "channel": "通道1", "action": "上"},
                {"code": "04", "channel": "通道1", "action": "下"}, {"code": "21", "channel": "通道2", "action": "停"},
                {"code": "22", "channel": "通道2", "action": "上"}, {"code": "24", "channel": "通道2", "action": "下"},
                {"code": "41", "channel": "通道3", "action": "停"}, {"code": "42", "channel": "通道3", "action": "上"},
                {"code": "44", "channel": "通道3", "action": "下"}, {"code": "61", "channel": "通道4", "action": "停"},
                {"code": "62", "channel": "通道4", "action": "上"}, {"code": "63", "channel": "通道4", "action": "下+停"},
                {"code": "64", "channel": "通道4", "action": "下"}, {"code": "66", "channel": "通道4", "action": "停长按 15 秒"},
                {"code": "67", "channel": "通道4", "action": "停长按 5 秒"}, {"code": "68", "channel": "通道4", "action": "上+停"},
            ],
        }
    ],
}
#: Fixed values of the frame layout.
MARKER, HEADER, TAIL = "AA 2D D4", "2D D4", "AA AA"
FRAME_BITS, ID_AT, COMMAND_AT, TAIL_AT = 104, 6, 10, 11
UNKNOWN_CHANNEL, UNKNOWN_ACTION = "未知通道", "未知命令"


#: What an error says of a field, whose name stands before it (fixed values).
EMPTY, TOO_FEW, NOT_POSITIVE, NOT_COUNT, FIXED = "不能为空", "至少包含一项", "必须大于 0", "必须是正整数", "必须固定为"
BELOW_ONE, BELOW_MINIMUM, BELOW_HALF, TWO_PHASES = "必须小于 1", "不能小于 minValidPulseCount", "必须小于 0.5", "必须大于等于 2"
BAD_SUFFIX, SAME_CODE, SAME_KEY = "末尾必须等于 formalHeaderHex", "命令码不能重复", "key 不能重复"
BAD_LEVEL, BAD_MAPPING, NO_RULE, NO_DOCUMENT = "只能是 0 或 1", "只能是 direct 或 inverted", "关联规则不存在", "配置文档不能为空"


def hex_bytes(text: str) -> tuple[int, ...]:
    return tuple(int(x, 16) for x in text.split())


def hex_text(values) -> str:
    return " ".join(f"{v & 0xFF:02X}" for v in values)


def byte_bits(values) -> tuple[int, ...]:
    """Most significant bit first."""
    return tuple(int(b) for v in values for b in f"{v & 0xFF:08b}")


@dataclass(frozen=True)
class Rules:
    key: str
    name: str
    period_us: Decimal
    prefilter: Decimal
    min_pulses: int
    max_pulses: int
    max_residual: Decimal
    tail_tolerance: Decimal
    phases: int
    dedup_tolerance: Decimal
    marker: tuple[int, ...]
    header: tuple[int, ...]
    tail: tuple[int, ...]
    frame_bits: int
    id_at: int
    command_at: int
    tail_at: int
    commands: tuple[tuple[int, str, str], ...]

    @property
    def pulse_min_us(self) -> Decimal:
        return self.period_us * (1 - self.prefilter)

    @property
    def pulse_max_us(self) -> Decimal:
        return self.period_us * (1 + self.prefilter)

    @property
    def previous_pulse_tolerance(self) -> Decimal:
        return 2 * self.max_residual

    @property
    def frame_bytes(self) -> int:
        return self.frame_bits // 8

    @property
    def prelude_bits(self) -> int:
        return 8 * (len(self.marker) - len(self.header))

    @property
    def marker_bits(self) -> tuple[int, ...]:
        return byte_bits(self.marker)

    @property
    def transitions(self) -> tuple[int, ...]:
        """Bit 0 and each bit of the marker that differs from the one before."""
        b = self.marker_bits
        return tuple(i for i in range(len(b)) if i == 0 or b[i] != b[i - 1])

    @property
    def phase_step(self) -> str:
        return f"T_est / {self.phases}"

    @property
    def dedup_fraction(self) -> str:
        f = Fraction(self.dedup_tolerance)
        return str(f.numerator) if f.denominator == 1 else f"{f.numerator}/{f.denominator}"


@dataclass(frozen=True)
class Profile:
    key: str
    name: str
    remote_id: tuple[int, ...]
    charset: str
    idle_ms: Decimal
    idle_level: int
    inverted: bool
    rules: Rules

    @property
    def mapping(self) -> str:
        return "inverted" if self.inverted else "direct"

    @property
    def mapping_text(self) -> str:
        return "反相映射（CSV 0 -> 1，CSV 1 -> 0）" if self.inverted else "直映射（CSV 0 -> 0，CSV 1 -> 1）"


@dataclass(frozen=True)
class Config:
    profiles: tuple[Profile, ...]
    rules: tuple[Rules, ...]

    def profile(self, key: str | None) -> Profile:
        """The profile with that key, blanks around it ignored."""
        wanted = (key or "").strip()
        found = next((p for p in self.profiles if p.key == wanted), None)
        if not wanted or found is None:
            raise CaptureError("CONFIG_NOT_FOUND")
        return found


def _no(message: str) -> CaptureError:
    return CaptureError("CONFIG_INVALID", message)


class _Reader:
    """Fields of one object of the document; every field must be known, and typed getters name it in errors."""

    def __init__(self, raw, where: str, fields: str):
        if raw is None:
            raise _no(f"{where} {EMPTY}")
        if not isinstance(raw, dict):
            raise _no(f"{where} 必须是对象")
        unknown = sorted(set(raw) - set(fields.split()))
        if unknown:
            raise _no(f"{where} 含有未知字段: {unknown[0]}")
        self.raw, self.where = raw, where

    def at(self, field: str) -> str:
        return f"{self.where}.{field}" if self.where else field

    def text(self, field: str) -> str:
        v = self.raw.get(field)
        if not isinstance(v, str) or not v.strip():
            raise _no(f"{self.at(field)} {EMPTY}")
        return v.strip()

    def positive(self, field: str) -> Decimal:
        v = self.raw.get(field)
        if isinstance(v, bool) or not isinstance(v, (int, float, Decimal)) or Decimal(str(v)) <= 0:
            raise _no(f"{self.at(field)} {NOT_POSITIVE}")
        return Decimal(str(v))

    def count(self, field: str) -> int:
        v = self.raw.get(field)
        if isinstance(v, bool) or not isinstance(v, int) or v <= 0:
            raise _no(f"{self.at(field)} {NOT_COUNT}")
        return v

    def fixed(self, field: str, value):
        if self.raw.get(field) != value or isinstance(self.raw.get(field), bool):
            raise _no(f"{self.at(field)} {FIXED} {value}")
        return value

    def hex(self, field: str, n: int) -> tuple[int, ...]:
        parts = self.text(field).split()
        if len(parts) != n or not all(len(p) == 2 and all(c in "0123456789abcdefABCDEF" for c in p) for p in parts):
            raise _no(f"{self.at(field)} 必须是 {n} 个十六进制字节")
        return tuple(int(p, 16) for p in parts)

    def fixed_hex(self, field: str, value: str) -> tuple[int, ...]:
        got = self.hex(field, len(value.split()))
        if hex_text(got) != value:
            raise _no(f"{self.at(field)} {FIXED} {value}")
        return got

    def items(self, field: str) -> list:
        v = self.raw.get(field)
        if v is None or v == []:
            raise _no(f"{self.at(field)} {TOO_FEW}")
        if not isinstance(v, list):
            raise _no(f"{self.at(field)} 必须是列表")
        return v


def _rules(raw, where: str) -> Rules:
    top = _Reader(raw, where, "key name timing frame commands")
    key, name = top.text("key"), top.text("name")
    timing_fields = "nominalBitPeriodUs prefilterToleranceRatio minValidPulseCount maxInitialFitPulseCount maxFitResidualRatio"
    t = _Reader(top.raw.get("timing"), top.at("timing"), f"{timing_fields} tailEdgeToleranceRatio phaseCount dedupToleranceRatio")
    timing = {
        "period_us": t.positive("nominalBitPeriodUs"), "prefilter": t.positive("prefilterToleranceRatio"), "min_pulses": t.count("minValidPulseCount"),
        "max_pulses": t.count("maxInitialFitPulseCount"), "max_residual": t.positive("maxFitResidualRatio"), "tail_tolerance": t.positive("tailEdgeToleranceRatio"),
        "phases": t.count("phaseCount"), "dedup_tolerance": t.positive("dedupToleranceRatio"),
    }
    for bad, field, text in (
        (timing["prefilter"] >= 1, "prefilterToleranceRatio", BELOW_ONE),
        (timing["max_pulses"] < timing["min_pulses"], "maxInitialFitPulseCount", BELOW_MINIMUM),
        (timing["tail_tolerance"] >= Decimal("0.5"), "tailEdgeToleranceRatio", BELOW_HALF),
        (timing["phases"] < 2, "phaseCount", TWO_PHASES),
    ):
        if bad:
            raise _no(f"{t.at(field)} {text}")
    f = _Reader(top.raw.get("frame"), top.at("frame"), "syncMarkerHex formalHeaderHex formalFrameBits remoteIdByteOffset commandByteOffset tailByteOffset tailHex")
    frame = {
        "marker": f.fixed_hex("syncMarkerHex", MARKER), "header": f.fixed_hex("formalHeaderHex", HEADER), "frame_bits": f.fixed("formalFrameBits", FRAME_BITS),
        "id_at": f.fixed("remoteIdByteOffset", ID_AT), "command_at": f.fixed("commandByteOffset", COMMAND_AT), "tail_at": f.fixed("tailByteOffset", TAIL_AT),
        "tail": f.fixed_hex("tailHex", TAIL),
    }
    if frame["marker"][-len(frame["header"]) :] != frame["header"]:
        raise _no(f"{f.at('syncMarkerHex')} {BAD_SUFFIX}")
    commands: dict[int, tuple[int, str, str]] = {}
    for i, raw_command in enumerate(top.items("commands")):
        c = _Reader(raw_command, f"{top.at('commands')}[{i}]", "code channel action")
        code = c.hex("code", 1)[0]
        if code in commands:
            raise _no(f"{top.at('commands')} {SAME_CODE}: {code:02X}")
        commands[code] = (code, c.text("channel"), c.text("action"))
    return Rules(key=key, name=name, commands=tuple(commands.values()), **timing, **frame)


def _profile(raw, where: str, rules: dict[str, Rules]) -> Profile:
    r = _Reader(raw, where, "key name remoteId charset idleThresholdMs idleLevel levelMapping protocolRuleKey")
    key, name, remote_id, charset = r.text("key"), r.text("name"), r.hex("remoteId", 3), r.text("charset")
    try:
        "".encode(charset)  # text encodings only
    except LookupError:
        raise _no(f"{r.at('charset')} 不是支持的字符集: {charset}") from None
    idle = r.positive("idleThresholdMs")
    level = r.raw.get("idleLevel")
    if isinstance(level, bool) or level not in (0, 1):
        raise _no(f"{r.at('idleLevel')} {BAD_LEVEL}")
    mapping = r.text("levelMapping").lower()
    if mapping not in ("direct", "inverted"):
        raise _no(f"{r.at('levelMapping')} {BAD_MAPPING}")
    rule_key = r.text("protocolRuleKey")
    if rule_key not in rules:
        raise _no(f"{r.at('protocolRuleKey')} {NO_RULE}: {rule_key}")
    return Profile(key, name, remote_id, charset, idle, level, mapping == "inverted", rules[rule_key])


def _keyed(items: list, where: str, make) -> dict:
    out: dict = {}
    for i, raw in enumerate(items):
        x = make(raw, f"{where}[{i}]")
        if x.key in out:
            raise _no(f"{where} {SAME_KEY}: {x.key}")
        out[x.key] = x
    return out


def validated(document) -> Config:
    """The typed configuration; the first broken rule raises CONFIG_INVALID and names its field."""
    if document is None:
        raise _no(NO_DOCUMENT)
    top = _Reader(document, "", "schemaVersion remoteConfigs protocolRuleSets")
    top.fixed("schemaVersion", 1)
    remotes, sets = top.items("remoteConfigs"), top.items("protocolRuleSets")
    rules = _keyed(sets, "protocolRuleSets", _rules)
    profiles = _keyed(remotes, "remoteConfigs", lambda raw, where: _profile(raw, where, rules))
    return Config(tuple(profiles.values()), tuple(rules.values()))


def parsed(text: str) -> Config:
    """The configuration in a JSON text."""
    try:
        document = json.loads(text, parse_float=Decimal)
    except ValueError as e:
        raise CaptureError("CONFIG_INVALID") from e
    return validated(document)


def load_config(path: str | None = None) -> Config:
    """The configuration in a JSON file (UTF-8), the shipped one without a path."""
    if path is None:
        return validated(DEFAULT_CONFIG)
    try:
        text = Path(path).read_text("utf-8")
    except OSError as e:
        raise CaptureError("CONFIG_READ_FAILED") from e
    except ValueError as e:
        raise CaptureError("CONFIG_INVALID") from e
    return parsed(text)


PROFILE_COLUMNS = (
    "config_key string, name string, remote_id string, charset string, idle_threshold_ms string, idle_level int, level_mapping string, rule_key string, rule_name string"
)
SETTING_COLUMNS = "rule_key string, section string, setting string, value string"


def profile_rows(config: Config) -> list[tuple]:
    return [
        (p.key, p.name, hex_text(p.remote_id), p.charset, str(p.idle_ms), p.idle_level, p.mapping, p.rules.key, p.rules.name)
        for p in config.profiles
    ]


def setting_rows(config: Config) -> list[tuple]:
    """(rule_key, section, setting, value), derived values included."""
    rows = []
    for r in config.rules:
        timing = {
            "nominal_bit_period_us": r.period_us, "prefilter_tolerance_ratio": r.prefilter, "min_valid_pulse_count": r.min_pulses, "max_initial_fit_pulse_count": r.max_pulses,
            "max_fit_residual_ratio": r.max_residual, "tail_edge_tolerance_ratio": r.tail_tolerance, "phase_count": r.phases, "dedup_tolerance_ratio": r.dedup_tolerance,
        }
        frame = {
            "sync_marker_hex": hex_text(r.marker), "formal_header_hex": hex_text(r.header), "formal_frame_bits": r.frame_bits, "remote_id_byte_offset": r.id_at,
            "command_byte_offset": r.command_at, "tail_byte_offset": r.tail_at, "tail_hex": hex_text(r.tail),
        }
        derived = {
            "single_bit_pulse_min_us": r.pulse_min_us, "single_bit_pulse_max_us": r.pulse_max_us, "previous_pulse_tolerance_ratio": r.previous_pulse_tolerance, "formal_frame_bytes": r.frame_bytes,
            "sync_prelude_bits": r.prelude_bits, "sync_inclusive_bits": r.prelude_bits + r.frame_bits, "phase_step": r.phase_step, "marker_transitions": ",".join(map(str, r.transitions)),
        }
        for section, values in (("timing", timing), ("frame", frame), ("derived", derived)):
            rows += [(r.key, section, k, format(v.normalize(), "f") if isinstance(v, Decimal) else str(v)) for k, v in values.items()]
    return rows


def remote_profiles(spark: SparkSession, config: Config | None = None) -> DataFrame:
    """One row for each profile."""
    return spark.createDataFrame(profile_rows(config or load_config()), PROFILE_COLUMNS)


def parser_settings(spark: SparkSession, config: Config | None = None) -> DataFrame:
    """(rule_key, section, setting, value), derived values included, one row for each setting."""
    return spark.createDataFrame(setting_rows(config or load_config()), SETTING_COLUMNS)


def _of_documents(documents: DataFrame, id_col: str, text_col: str, columns: str, rows) -> DataFrame:
    """The rows that a function makes of each JSON text, behind its id; a batch of documents is read at a time."""
    import pyarrow as pa

    names = [id_col, *[c.split()[0] for c in columns.split(", ")]]
    kinds = [pa.int64() if documents.schema[id_col].dataType.simpleString() == "bigint" else pa.string()]
    kinds += [pa.int32() if c.endswith(" int") else pa.string() for c in columns.split(", ")]
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def run(batches):
        for b in batches:
            found = [(i, *r) for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for r in rows(text)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], f.type) for k, f in enumerate(schema)], schema=schema)

    key = documents.schema[id_col].dataType.simpleString()
    ids = documents if key == "bigint" else documents.withColumn(id_col, documents[id_col].cast("string"))
    return ids.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {'bigint' if key == 'bigint' else 'string'}, {columns}")


def profiles_of(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The profiles of many configurations (JSON texts), each behind its document's id. A broken one raises; so does a null."""
    return _of_documents(documents, id_col, text_col, PROFILE_COLUMNS, lambda text: profile_rows(parsed(text or "")))


def settings_of(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The settings of many configurations, likewise."""
    return _of_documents(documents, id_col, text_col, SETTING_COLUMNS, lambda text: setting_rows(parsed(text or "")))


def outcomes_of(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, code, message) of many configurations: OK and no message, or the first broken rule. A null text is no JSON."""

    def told(text):
        try:
            parsed(text or "")
        except CaptureError as e:
            return [(e.code, e.message)]
        return [("OK", None)]

    return _of_documents(documents, id_col, text_col, "code string, message string", told)


def commands(spark: SparkSession, rules: Rules) -> DataFrame:
    """(code, channel, action) of a rule set."""
    return spark.createDataFrame([*rules.commands], "code int, channel string, action string")
