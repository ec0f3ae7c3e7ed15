import os

import pytest

from trunkline.functions import masking as M
from trunkline.functions import text as T
from trunkline.operators.browse import parse_viewer_command
from trunkline.plans.queries import ORACLE_SQL, QUERIES
from trunkline.sources import trunklog
from trunkline.sources.codec import LINE, encode_file
from trunkline.sources.plaintext import assemble

SF = "/root/testdata/sf0.001"


def rows_of(values):
    return sorted(repr([round(v, 9) if isinstance(v, float) else v for v in row]) for row in values)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == cols
    assert rows_of(map(tuple, df.select(cols).collect())) == rows_of([tuple(r[names.index(c)] for c in cols) for r in want.fetchall()])


def one(spark, column, **values):
    df = spark.range(1)
    from pyspark.sql import functions as F

    return df.select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()[0] if values else df.select(column.alias("x")).first()[0]


def test_multiline_and_levels(spark):
    lines = ["2026-05-01 22:01:00,253 [ERROR] request failed", "java.lang.E", "\tat x", "  ", "2026-05-01 22:01:00,278 [FATAL] boom", "2026-05-01 22:01:00,353 [GID:] no level"]
    got = assemble(spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, line_no int, line string")).orderBy("record_index").collect()
    assert [(r.timestamp_millis - 1_777_672_860_253, r.level, r.message) for r in got] == [(0, "ERROR", "request failed\njava.lang.E\n\tat x\n"), (25, "ERROR", "boom"), (100, "INFO", "[GID:] no level")]
    with pytest.raises(Exception, match="before the first record"):
        assemble(spark.createDataFrame([("f", 0, "garbage"), ("f", 1, lines[0])], "file string, line_no int, line string")).collect()


def test_masking(spark):
    from pyspark.sql import functions as F

    text = F.lit("password=secret phone=13812345678 email=someone@example.com a@b.com@c.com")
    assert one(spark, M.mask_content(text, ["password", "mobile", "email"])) == "password=****** phone=138****5678 email=s***@example.com ***@b.com@c.com"
    assert one(spark, M.mask_variable("r", F.lit("REQ-123456"), {"r": "partial"})) == "RE****56"


def test_sizes_and_highlights(spark):
    from pyspark.sql import functions as F

    assert [one(spark, T.format_size(F.lit(n))) for n in (999, 1536, 1 << 20)] == ["999 B", "1.50 KiB", "1.00 MiB"]
    assert [one(spark, T.format_duration(F.lit(n))) for n in (912, 42_000, 1_250_000)] == ["912us", "42ms", "1.250s"]
    assert [tuple(r) for r in one(spark, T.highlight_ranges(F.lit("a😀.b.😀."), "."))] == [(2, 3), (4, 5), (6, 7)]
    assert [r.content for r in one(spark, T.wrap_rows(F.lit("abcdef\n\ngh"), 4))] == ["abcd", "ef", "", "gh"]


def test_commands():
    assert parse_viewer_command(":128") == ("jump", 128)
    assert parse_viewer_command(":fatal") == ("level", "ERROR")
    for bad in ("+42", ":0", "/", ":verbose"):
        with pytest.raises(ValueError):
            parse_viewer_command(bad)


def test_sidecar_and_modes(spark, tmp_path):
    trunklog.register(spark)
    path = tmp_path / "a.tog"
    path.write_bytes(encode_file([(1000 + i, 1, f"m{i}") for i in range(5)], "zstd", 1))
    (tmp_path / "a.tog.buffer").write_bytes((1000).to_bytes(8, "big") + LINE.pack(25, 3, 4) + b"tail" + b"\0\0")
    read = lambda **o: spark.read.format("trunklog").options(**o).load(str(path))
    assert [(r.message, r.buffered, r.record_index, r.timestamp_millis) for r in read().orderBy("record_index").collect()][-1] == ("tail", True, 5, 1025)
    assert read(includeBuffer="false").count() == 5
    assert [r.message for r in read(includeBuffer="false").where("record_index >= 2 and record_index < 4").orderBy("record_index").collect()] == ["m2", "m3"]
    path.write_bytes(path.read_bytes() + b"xx")
    with pytest.raises(Exception, match="trailing"):
        read(mode="strict").count()
    assert read(mode="index", includeBuffer="false").count() == 5
