"""Arrays of JSON objects cut anywhere by splits."""

import json
import random

import pytest

from auditframe.sources.json_arrays import json_objects
from auditframe.sources.query_log import scan_query_log_json
from auditframe.sources.schema import scan_schema_json


def records(n):
    rng = random.Random(5)
    texts = ["plain", "a } b", "{ \"q\": [1] }", "quote \\\" and \\\\", "}", "{{", '"', "\\", "é🙂 }{", "[ , ]", "line\nend", "\\}\\{", ""]
    return [{"i": i, "s": rng.choice(texts) + rng.choice(texts), "o": {"k": {"}": rng.choice(texts)}}, "l": [{"x": 1}, {}]} for i in range(n)]


@pytest.mark.parametrize("split", ["10m", "700", "61"])
@pytest.mark.parametrize("style", [{}, {"indent": 2}, {"ensure_ascii": False, "separators": (",", ":")}])
def test_objects_come_back_in_order_whatever_the_splits(spark, tmp_path, split, style):
    many = records(40)
    (tmp_path / "a.json").write_text(json.dumps(many, **style), encoding="utf-8")
    (tmp_path / "b.json").write_text(json.dumps(many[7], **style) + "\n", encoding="utf-8")
    (tmp_path / "c.json").write_text("[]")
    (tmp_path / "d.json").write_text(" [ \n" + json.dumps({}) + " , {\"i\": 1} ] \n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = json_objects(spark, str(tmp_path)).orderBy("seq").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    got = {}
    for r in rows:
        got.setdefault(r["seq"]["path"].rsplit("/", 1)[-1], []).append(json.loads(r["value"]))
    assert got == {"a.json": many, "b.json": [many[7]], "d.json": [{}, {"i": 1}]}
    if split == "61":
        assert len({r["seq"]["block"] for r in rows if r["seq"]["path"].endswith("a.json")}) > 10


def test_an_array_reads_as_its_lines_do(spark, tmp_path):
    log = [{"query": f"SELECT '}}{i}'", "timestamp": "2024-01-01T00:00:00", "duration_ms": i if i % 7 else None, "rows_affected": i, "database": "d"} for i in range(50)]
    log += [{"query": "bad", "duration_ms": "slow"}]
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, log)))
    (tmp_path / "array.json").write_text(json.dumps(log))
    fields = ["ts", "query", "duration_ms", "rows_affected", "database", "user"]
    lines, array = (scan_query_log_json(spark, str(tmp_path / f"{n}.json"), lines=n == "lines").orderBy("seq").select(*fields).collect() for n in ("lines", "array"))
    assert lines == array and len(lines) == 50


def test_an_array_of_dumps(spark, tmp_path):
    dumps = [{"database_name": f"d{i}", "total_tables": 1, "total_columns": 1, "tables": [{"name": "t", "columns": [{"name": "c", "type": "INT"}]}]} for i in range(3)]
    (tmp_path / "a.json").write_text(json.dumps(dumps))
    rows = scan_schema_json(spark, str(tmp_path)).collect()
    assert sorted(r["database_name"] for r in rows) == ["d0", "d1", "d2"] and len({r["dump"] for r in rows}) == 3
