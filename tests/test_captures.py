"""Golden cases of the capture engine."""

import copy
import zipfile
from decimal import Decimal
from xml.dom import minidom

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from edgewright import config
from edgewright.errors import CaptureError
from edgewright.operators import decode, dedup, signal
from edgewright.plans import captures, synth
from edgewright.sources import edge_csv, report, workbook

PROFILE = config.load_config().profile(" remote-b04287 ")
GOOD = [0x2D, 0xD4, 1, 2, 3, 4, 0xB0, 0x42, 0x87, 9, 0x21, 0xAA, 0xAA]
T = 416
EDGE = "capture_id string, edge_idx long, t decimal(20,12), level int, source_line long"


def wave(frames, start=60_000, gap=50_000, inverted=True, lead=(0xAA, 0xAA)):
    """(us, level) of the edges of frames, each a list of bytes or bits."""
    out, at, idle = [], start, 1
    for f in frames:
        bits = list(config.byte_bits([*lead])) + (list(config.byte_bits(f)) if max(f) > 1 or len(f) < 30 else list(f)) + [idle]
        before = idle
        for i, b in enumerate(bits):
            if b != before:
                out.append((at + i * T, 1 - b if inverted else b))
            before = b
        at += len(bits) * T + gap
    return out


def edges(spark, *waves):
    rows = [(f"c{n}", i, Decimal(us) / 1_000_000, level, i + 2) for n, w in enumerate(waves) for i, (us, level) in enumerate(w)]
    return spark.createDataFrame(rows, EDGE)


def frames(spark, *waves, profile=PROFILE):
    return captures.decoded(edges(spark, *waves), profile).orderBy("capture_id", "frame_no").collect()


def test_clean_frame(spark):
    (f,) = frames(spark, wave([GOOD]))
    assert f.valid and f.bytes == GOOD and (f.pulses, f.phase_no, f.direct_bits, f.final_bits) == (7, 8, 104, 104)
    assert (f.channel, f.action, f.tail_status, f.frame_no) == ("通道2", "停", decode.NOT_NEEDED, 1)
    assert abs(f.period_us - T) < 1e-6 and abs(f.safety_ratio - 0.5) < 1e-6
    assert f.prelude_t == Decimal("0.060000") + Decimal(8 * T) / 1_000_000


def test_many_cases_in_one_run(spark):
    put = lambda at, v: [v if i == at else b for i, b in enumerate(GOOD)]
    cases = {
        "wrong id": (wave([put(7, 1)]), ["遥控器 ID 不匹配"]), "command": (wave([put(10, 3)]), ["命令字节未知"]), "tail": (wave([put(12, 0xA8)]), ["尾帧不匹配"]),
        "two": (wave([[0x2D, 0xD4, 1, 2, 3, 4, 0xB0, 0x42, 0x86, 9, 3, 0xAA, 0xAA]]), ["遥控器 ID 不匹配", "命令字节未知"]), "cut": (wave([GOOD])[:-20], ["正式帧数据截断"]), "good": (wave([GOOD]), []),
    }
    got = {f.capture_id: f for f in frames(spark, *[w for w, _ in cases.values()])}
    for n, (name, (_, reasons)) in enumerate(cases.items()):
        assert got[f"c{n}"].reasons == reasons and got[f"c{n}"].valid == (not reasons), name
    assert got["c1"].action == "未知命令" and got["c4"].channel == "未知通道"


def test_repeats_and_noise(spark):
    noise = [(1_000 + 5_000 * i, i % 2) for i in range(8)]
    got = frames(spark, wave([GOOD, GOOD]), noise, [], [(5, 0)], [*noise, *wave([GOOD], start=200_000)])
    assert [(f.capture_id, f.frame_no) for f in got] == [("c0", 1), ("c0", 2), ("c4", 1)]


def test_tail_recovery_on_candidates(spark):
    full = wave([GOOD])
    start = 60_000 + 16 * T
    open_end = full[:-1]  # the closing edge is missing
    absent = full[:-2]  # the edge that starts bit 104 is missing too
    early = [*absent, (start + int(102.5 * T), absent[-1][1] ^ 1)]
    late = [*absent, (start + int(103.4 * T), absent[-1][1] ^ 1)]
    rows = decode.candidates(edges(spark, open_end, absent, early, late), PROFILE).collect()
    of = lambda c: {(r.direct_bits, r.tail_status) for r in rows if r.capture_id == c}
    assert (103, decode.EXTENDED) in of("c0")
    assert of("c1") == {(102, decode.TOO_SHORT)}
    assert (103, decode.NO_EDGE) in of("c2") and (102, decode.TOO_SHORT) in of("c2")
    assert (103, decode.BAD_EDGE) in of("c3") or (104, decode.NOT_NEEDED) in of("c3")
    (f,) = frames(spark, open_end)
    assert f.valid and f.tail_extended and (f.direct_bits, f.final_bits) == (103, 104) and f.bytes == GOOD


def test_direct_mapping_gives_the_same_bytes(spark):
    document = copy.deepcopy(config.DEFAULT_CONFIG)
    document["remoteConfigs"][0] |= {"levelMapping": "DIRECT", "idleLevel": 1}
    (f,) = frames(spark, wave([GOOD], inverted=False), profile=config.validated(document).profile("remote-b04287"))
    assert f.valid and f.bytes == GOOD


def test_truncated_frame_looks_up_ff(spark):
    document = copy.deepcopy(config.DEFAULT_CONFIG)
    document["protocolRuleSets"][0]["commands"].append({"code": "ff", "channel": "all", "action": "reset"})
    (f,) = frames(spark, wave([GOOD])[:30], profile=config.validated(document).profile("remote-b04287"))
    assert (f.channel, f.action, f.reasons) == ("all", "reset", ["正式帧数据截断"])


def test_pulse_bounds_and_run_length(spark):
    low, high, out = [0], [0], [0]
    for _ in range(5):
        low.append(low[-1] + Decimal("332.8"))
        high.append(high[-1] + Decimal("499.2"))
        out.append(out[-1] + Decimal("499.3"))
    four = [Decimal(416 * i) for i in range(5)]
    rows = edges(spark, *[[(us, i % 2) for i, us in enumerate(w)] for w in (low, high, out, four)])
    r = PROFILE.rules
    runs = signal.pulse_runs(rows, r.pulse_min_us / 1_000_000, r.pulse_max_us / 1_000_000, r.min_pulses, r.max_pulses).collect()
    assert sorted((x.capture_id, x.edge_idx, x.pulses, len(x.points)) for x in runs) == [("c0", 0, 5, 6), ("c1", 0, 5, 6)]


def test_segments_and_boundaries(spark):
    s = lambda ms: ms * 1000
    w = [(0, 0), (s(40), 1), (s(41), 0), (s(80), 1), (s(81), 1), (s(81), 0), (s(130), 1), (s(180), 0)]
    got = signal.segments(signal.intervals(edges(spark, w, [(0, 1)], [])), 0, Decimal("0.040")).collect()
    assert [(float(x.start_t), float(x.end_t), x.left_known, x.right_known, x.segment) for x in got] == [(0.04, 0.081, True, True, 1), (0.13, 0.18, True, False, 2)]


def test_fragments(spark):
    noise = [(1_000 + 3_000 * i, i % 2) for i in range(9)]
    after = [(400_000 + 3_000 * i, 1 - i % 2) for i in range(6)]
    result = captures.decode_edges(edges(spark, [*noise, *wave([GOOD], start=100_000), *after], noise), PROFILE)
    got = [(r.capture_id, r.reason) for r in result.fragments.orderBy("capture_id", "number").collect()]
    assert got[0] == ("c0", "文件开头未识别数据") and ("c0", "文件结尾未识别数据") in got and got[-1] == ("c1", "文件开头未识别数据")
    counts = {r.capture_id: (r.n_edges, r.n_valid, r.n_invalid) for r in result.summary.collect()}
    assert counts["c1"] == (9, 0, 0) and counts["c0"][1] == 1


def write(tmp_path, files):
    for name, data in files.items():
        (tmp_path / name).write_bytes(data if isinstance(data, bytes) else data.encode("gbk"))
    return str(tmp_path)


def test_strict_csv(spark, tmp_path):
    path = write(tmp_path, {
        "ok.csv": "时间[s],通道 0\r\n 0.1 ,1\n0.1,0\r0.25,1,extra\n", "head.csv": "Time,Level\n", "empty.csv": "", "quoted.csv": 'T,L\n"0.3",1\n', "blank.csv": "T,L\n0.1,1\n\n0.2,0\n",
        "level.csv": "T,L\n0.1,01\n", "back.csv": "T,L\n0.2,1\n0.1,0\n", "header.csv": "T, \n0.1,1\n", "exp.csv": "T,L\n1e-2,1\n+.5,0\n",
    })
    rows = edge_csv.checked(edge_csv.file_lines(spark, path)).cache()
    bad = {r.capture_id: (r.source_line, r.message) for r in edge_csv.csv_errors(rows).collect()}
    assert {k: v[0] for k, v in bad.items()} == {"empty.csv": 1, "quoted.csv": 2, "blank.csv": 3, "level.csv": 2, "back.csv": 3, "header.csv": 1}
    assert bad["back.csv"][1] == "第 3 行: 时间不能倒退"
    good = edge_csv.edges_of(rows).collect()
    assert sorted((r.capture_id, float(r.t), r.level, r.source_line) for r in good) == [("exp.csv", 0.01, 1, 2), ("exp.csv", 0.5, 0, 3), ("ok.csv", 0.1, 0, 3), ("ok.csv", 0.1, 1, 2), ("ok.csv", 0.25, 1, 4)]
    with pytest.raises(CaptureError) as e:
        edge_csv.read_edges(spark, path, strict=True)
    assert e.value.code == "CSV_READ_FAILED" and e.value.status == 422


def test_whole_capture_and_workbook(spark, tmp_path):
    lines = "".join(f"{Decimal(us) / 1_000_000},{level}\n" for us, level in wave([GOOD, GOOD]))
    path = write(tmp_path, {"a.csv": "时间,电平\n" + lines, "bad.csv": "时间,电平\nx,1\n"})
    result = captures.decode_captures(spark, path, "remote-b04287")
    assert result.frames.count() == 2 and [r.capture_id for r in result.errors.collect()] == ["bad.csv"]
    view = report.result_view(result.frames, PROFILE)
    assert len(view.columns) == 1 + len(report.HEADERS) == 44
    out = str(tmp_path / "out" / report.download_name("a.csv"))
    workbook.save(view, report.summary_view(result.summary, PROFILE), result.fragments, str(tmp_path / "out"))
    with zipfile.ZipFile(out) as z:
        texts = {n: z.read(n).decode() for n in z.namelist()}
    for t in texts.values():
        minidom.parseString(t)
    assert "2D D4 01 02 03 04 B0 42 87 09 21 AA AA" in texts["xl/worksheets/sheet1.xml"] and "1/2" in texts["xl/worksheets/sheet2.xml"]
    assert sorted(p.name for p in (tmp_path / "out").rglob("*")) == ["a-解析结果.xlsx"]


@pytest.mark.parametrize(("name", "size", "code"), [("a.csv", 1, None), ("x/y\\b.CSV", 5, None), (".csv", 5, "INVALID_REQUEST"), ("a.txt", 5, "INVALID_REQUEST"), ("a.csv", 0, "INVALID_REQUEST"), ("a.csv", 21 * 1024 * 1024, "UPLOAD_TOO_LARGE")])
def test_upload(name, size, code):
    if code is None:
        assert edge_csv.check_upload(name, size).lower() in ("a.csv", "b.csv")
    else:
        with pytest.raises(CaptureError) as e:
            edge_csv.check_upload(name, size)
        assert e.value.code == code


@pytest.mark.parametrize("change", [
    lambda d: d.update(schemaVersion=2), lambda d: d.update(extra=1), lambda d: d.update(remoteConfigs=[]), lambda d: d["remoteConfigs"].append(d["remoteConfigs"][0]), lambda d: d["remoteConfigs"][0].update(remoteId="B0 42"),
    lambda d: d["remoteConfigs"][0].update(charset="none"), lambda d: d["remoteConfigs"][0].update(idleThresholdMs=0), lambda d: d["remoteConfigs"][0].update(idleLevel=2), lambda d: d["remoteConfigs"][0].update(levelMapping="up"),
    lambda d: d["remoteConfigs"][0].update(protocolRuleKey="x"), lambda d: d["protocolRuleSets"][0]["timing"].update(prefilterToleranceRatio=1), lambda d: d["protocolRuleSets"][0]["timing"].update(maxInitialFitPulseCount=4),
    lambda d: d["protocolRuleSets"][0]["timing"].update(tailEdgeToleranceRatio=0.5), lambda d: d["protocolRuleSets"][0]["timing"].update(phaseCount=1), lambda d: d["protocolRuleSets"][0]["frame"].update(syncMarkerHex="AA 2D D5"),
    lambda d: d["protocolRuleSets"][0]["frame"].update(formalFrameBits=96), lambda d: d["protocolRuleSets"][0]["commands"].append({"code": "01", "channel": "a", "action": "b"}), lambda d: d["protocolRuleSets"][0].update(commands=None),
    lambda d: d["protocolRuleSets"][0]["commands"].append({"code": "0x", "channel": "a", "action": "b"}), lambda d: d["protocolRuleSets"][0]["commands"][0].update(action=" "), lambda d: d["remoteConfigs"].append(None),
])
def test_broken_configurations(change):
    document = copy.deepcopy(config.DEFAULT_CONFIG)
    change(document)
    with pytest.raises(CaptureError) as e:
        config.validated(document)
    assert e.value.code == "CONFIG_INVALID"


def test_configuration_files(tmp_path):
    (tmp_path / "c.json").write_text("{", "utf-8")
    for path, code in ((tmp_path / "none.json", "CONFIG_READ_FAILED"), (tmp_path / "c.json", "CONFIG_INVALID")):
        with pytest.raises(CaptureError) as e:
            config.load_config(str(path))
        assert e.value.code == code
    for key in ("x", " ", None):
        with pytest.raises(CaptureError) as e:
            config.load_config().profile(key)
        assert e.value.code == "CONFIG_NOT_FOUND" and e.value.status == 404


def test_greedy_rule():
    key = (0,)
    assert dedup.greedy([(0.0, 400, key), (200e-6, 400, key), (200.1e-6, 400, key)], 0.5) == [0, 2]
    assert dedup.greedy([(0.0, 400, (1,)), (200e-6, 400, (0,)), (390e-6, 400, (1,))], 0.5) == [1]


def test_fast_and_exact_deduplication_agree(spark):
    """An island with two starts goes through the rule itself."""
    rows = [(1, i, 4, start, "d") for i, start in enumerate([0.0, 150e-6, 300e-6, 0.01, 0.01])]
    df = spark.createDataFrame(rows, "capture_id long, edge_idx long, pulses int, start_t double, s string").selectExpr(
        "*", "true AS valid", "false AS tail_extended", "true AS complete", "0.1 AS residual_ratio", "0.5 AS safety_ratio", "416D AS period_us", "CAST(edge_idx AS DOUBLE) AS phase_us", "CAST(start_t AS DECIMAL(20,12)) AS prelude_t"
    )
    df = df.withColumn("residual_ratio", df.residual_ratio.cast("double")).withColumn("safety_ratio", df.safety_ratio.cast("double"))
    assert sorted(r.edge_idx for r in dedup.deduplicated(df, PROFILE.rules).collect()) == [0, 2, 3]


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 255), min_size=5, max_size=5), st.lists(st.integers(-9, 9), min_size=130, max_size=130))
def test_decoding_undoes_encoding(payload, jitter):
    """Without Spark: the block decoder on a jittered frame."""
    f = [0x2D, 0xD4, *payload[:4], 0xB0, 0x42, 0x87, payload[4], 0x21, 0xAA, 0xAA]
    w = wave([f])
    us = [float(t + j) for (t, _), j in zip(w, jitter, strict=False)]
    one = [332.8 <= b - a <= 499.2 for a, b in zip(us, us[1:], strict=False)] + [False]
    found = list(decode.BlockDecoder(PROFILE.rules, True).candidates(us, list(range(len(us))), [level for _, level in w], one, [True] * len(us), us[-1], w[-1][1], us[-2], w[-2][1]))
    want = "".join(map(str, config.byte_bits(f)))
    if found:
        assert any(c[13] == want for c in found)
    else:  # a marker in the payload cannot hide the frame's own
        pytest.fail("no candidate")


def test_synthesised_orders_come_back(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").where("o_custkey < 20")
    sent = synth.payloads(orders, PROFILE)
    got = captures.decoded(synth.waveform(sent, PROFILE, drop_last=True), PROFILE)
    assert got.where("valid").count() == sent.count() and sent.select("capture_id", "bytes").exceptAll(got.select("capture_id", "bytes")).count() == 0


def test_stream_of_files(spark, tmp_path):
    from edgewright.streaming.captures import decode_stream

    lines = "".join(f"{Decimal(us) / 1_000_000},{level}\n" for us, level in wave([GOOD]))
    source = tmp_path / "in"
    source.mkdir()
    for number, names in enumerate((("a.csv", "bad.csv"), ("b.csv",))):
        write(source, {n: "T,L\n" + ("x,1\n" if n == "bad.csv" else lines) for n in names})
        query = decode_stream(spark, f"file://{source}", f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint", PROFILE)
        assert query.awaitTermination(120)
    frames = spark.read.option("basePath", f"{tmp_path}/out/frames").parquet(f"{tmp_path}/out/frames")
    assert sorted((r.capture_id, r.valid) for r in frames.collect()) == [("a.csv", True), ("b.csv", True)]
    assert [r.capture_id for r in spark.read.parquet(f"{tmp_path}/out/errors").collect()] == ["bad.csv"]


def test_service(spark, tmp_path):
    from edgewright.plans.service import parse_capture

    lines = "".join(f"{Decimal(us) / 1_000_000},{level}\n" for us, level in wave([GOOD]))
    write(tmp_path, {"a.csv": "时间,电平\n" + lines, "head.csv": "T,L\n", "bad.csv": "T,L\nx,1\n", "bytes.csv": b"\xff\xff,T\n0.1,1\n", "none.csv": ""})
    out = parse_capture(spark, f"{tmp_path}/a.csv", "remote-b04287", f"{tmp_path}/out")
    assert out.endswith("/out/a-解析结果.xlsx") and zipfile.is_zipfile(out)
    assert zipfile.is_zipfile(parse_capture(spark, f"{tmp_path}/head.csv", "remote-b04287", f"{tmp_path}/out"))
    for name, key, code in (("a.csv", "x", "CONFIG_NOT_FOUND"), ("none.csv", "remote-b04287", "INVALID_REQUEST"), ("gone.csv", "remote-b04287", "INVALID_REQUEST"), ("bad.csv", "remote-b04287", "CSV_READ_FAILED"), ("bytes.csv", "remote-b04287", "CSV_READ_FAILED")):
        with pytest.raises(CaptureError) as e:
            parse_capture(spark, f"{tmp_path}/{name}", key, f"{tmp_path}/out")
        assert e.value.code == code, name


def test_files_with_one_name_are_different_captures(spark, tmp_path):
    for folder, text in (("a", "T,L\n5,1\n6,0\n"), ("b", "T,L\n1,1\n2,0\n3,1\n"), ("c", "T,L\n")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.csv").write_text(text)
    result = captures.decode_captures(spark, f"{tmp_path}/*", "remote-b04287")
    assert {(r.capture_id, r.n_edges) for r in result.summary.collect()} == {("a/x.csv", 2), ("b/x.csv", 3), ("c/x.csv", 0)}
    assert result.errors.count() == 0


def test_times_are_rounded_to_twelve_decimals(spark):
    lines = spark.createDataFrame([("a", 1, "T,L"), ("a", 2, "0.1234567890123,1"), ("a", 3, "0.1234567890126,0"), ("a", 4, "123456789,1"), ("b", 1, "T,L"), ("b", 2, "0.12345678901234,1"), ("b", 3, "0.12345678901233,0"), ("c", 2, "1e-2,1"), ("c", 3, "0.0100000000000000000000001,1"), ("c", 4, "0.01,1")], "capture_id string, line long, text string")
    found = edge_csv.checked(edge_csv.text_lines(lines)).collect()
    rows = {r.source_line: (str(r.t), r.reason) for r in found if r.capture_id == "a"}
    assert {(r.capture_id, r.source_line) for r in found if r.capture_id != "a" and r.reason} == {("b", 3), ("c", 4)}  # back by less than is kept
    assert rows[2] == ("0.123456789012", None) and rows[3] == ("0.123456789013", None) and rows[4][1] == "时间不是合法数值"
