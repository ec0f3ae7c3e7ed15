import pytest

from trunkline.__main__ import main
from trunkline.operators.query import LogQuery
from trunkline.operators.rotation import Fill, archive_moves
from trunkline.plans.config import from_properties, from_yaml, size_bytes
from trunkline.sources import protobuf as P

YAML = """
logging:
  root: {level: debug}
  appenders:
    out: {type: console, target: SYSTEM_ERR, level: fatal}
    disk:
      type: file
      fileName: app.log
      compression: zstd
      trunkSizeKb: 100000
      splitByLevel: true
      policies: {size: {size: 1MB}}
  masking: {contentRules: [Password, email, password], variableRules: {user: PARTIAL}}
"""
PROPERTIES = """
# the same
logging.root.level = debug
logging.appender.out.type = console
logging.appender.out.target = SYSTEM_ERR
logging.appender.out.level = fatal
logging.appender.disk.type=file
logging.appender.disk.fileName=app.log
logging.appender.disk.compression=zstd
logging.appender.disk.trunkSizeKb=100000
logging.appender.disk.splitByLevel=true
logging.appender.disk.policies.size.size=1MB
logging.masking.contentRules=Password, email,password
logging.masking.variableRules.user=PARTIAL
other.key=1
"""


def test_yaml_and_properties_agree(spark):
    a = from_yaml(YAML, "logging")
    assert a == from_properties(PROPERTIES, "logging")
    disk = a.appenders["disk"]
    assert (a.level, a.root, disk.format, disk.trunk_size_kb, disk.max_file_size_bytes, disk.max_archived_files) == ("DEBUG", ("out", "disk"), "text", 65_535, 1 << 20, 5)
    assert (a.appenders["out"].level, a.content_rules, a.variable_rules) == ("ERROR", ("password", "email"), {"user": "partial"})
    assert a.appenders_table(spark).where("split_by_level").first()["file_name"] == "app.log"
    assert a.masking_table(spark).count() == 3


@pytest.mark.parametrize("text", ["", "logging: {}", YAML.replace("fileName: app.log", ""), YAML.replace("{level: debug}", "{appenders: [none]}"), YAML.replace("zstd", "rar"), YAML.replace("console", "socket")])
def test_bad_configurations(text):
    with pytest.raises(ValueError):
        from_yaml(text, "logging")


def test_sizes():
    assert [size_bytes(x) for x in (None, "", "10", "10B", " 2 kb", "1MB", "1GB")] == [0, 0, 10, 10, 2048, 1 << 20, 1 << 30]
    with pytest.raises(ValueError):
        size_bytes("1 parsec")


def test_rotation():
    turns = lambda sizes, *a: [f.take(s) for f in [Fill(*a)] for s in sizes]
    assert turns([60, 40, 1, 500, 1], 100) == [0, 0, 1, 2, 3]
    assert turns([60, 40, 1, 500, 1], 100, True) == [0, 0, 0, 1, 2]
    assert turns([60, 400], 0) == turns([60, 400], -1) == [0, 0]
    assert archive_moves([1, 2, 3], 3) == ([3], [(2, 3), (1, 2), (0, 1)])
    assert archive_moves([2], 3) == ([], [(2, 3), (0, 1)])
    assert archive_moves([1], 0) == ([0], [])


def test_messages():
    assert P.encode_record(300, 0, "a", None, "", {"k": ""}) == b"\x08\xac\x02\x10\x01\x1a\x01a\x32\x03\x0a\x01k"
    record = (1_777_672_860_253, 4, "src", "ctx", "méssage", {"a": "1", "": "2"})
    assert P.decode_record(P.encode_record(*record)) == record
    for q in (LogQuery(), LogQuery(0, 5, "TRACE", ""), LogQuery(keyword="x"), LogQuery(end=7, minimum_level="ERROR")):
        assert P.decode_query(P.encode_query(q)) == q
    for bad in (b"\x08", b"\x1a\x05ab", b"\x10\x09", b""):
        with pytest.raises(ValueError):
            P.decode_record(bad)


def test_command_line(spark, tmp_path, capsys):
    lines = ["2026-05-01 22:01:00,253 [INFO] service started", "2026-05-01 22:01:00,278 [ERROR] request failed", "\tat x", "2026-05-01 22:01:01,000 [WARN] queue depth"]
    (tmp_path / "app.log").write_text("\n".join(lines) + "\n")
    logs, text = str(tmp_path / "logs"), str(tmp_path / "text")
    assert main(["convert", str(tmp_path / "app.log"), logs, "zstd", "1"], spark) == 0
    assert main(["restore", logs, text], spark) == 0
    assert sorted(r.value for r in spark.read.text(text).collect()) == sorted(lines)
    for args, want in ((["scan", logs, "--level", "warn"], 3), (["search", logs, "depth"], 1), (["filter", logs, "info"], 1), (["window", logs, "0", "9"], 4)):
        capsys.readouterr()
        assert main(args, spark) == 0
        assert len(capsys.readouterr().out.splitlines()) == want
