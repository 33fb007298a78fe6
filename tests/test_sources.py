"""Arrays of objects in files, and JSON in texts."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from rulespan.functions import parsing as P
from rulespan.sources.json_array import read_array

SCHEMA = "no int, text string, tags array<string>, sub struct<a: int, b: string>"
TEXTS = ["plain", 'a "quoted" } brace', "two \\ back { slashes \\\\", "", "[ ] , } {", "line\nbreak", "é 中 😀 \\\"}"]
RECORDS = [{"no": i, "text": TEXTS[i % len(TEXTS)], "tags": ["}", "x"][: i % 3], "sub": {"a": i, "b": "}" * (i % 4)} if i % 2 else None} for i in range(60)]


def found(df):
    return sorted((r.asDict(True) for r in df.collect()), key=lambda r: r["no"])


@pytest.fixture
def blocks(spark):
    """Blocks far smaller than a record."""
    names = {"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "1"}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k in names:
        spark.conf.unset(k)


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("strict", [False, True])
def test_array_in_many_blocks(spark, tmp_path, blocks, indent, strict):
    for part in (0, 1):
        (tmp_path / f"{part}.json").write_text(json.dumps(RECORDS[part::2], indent=indent, ensure_ascii=False))
    assert found(read_array(spark, str(tmp_path), SCHEMA, strict)) == RECORDS


def test_cut_and_empty_arrays(spark, tmp_path, blocks):
    (tmp_path / "empty.json").write_text(" [ ]\n")
    assert found(read_array(spark, str(tmp_path / "empty.json"), SCHEMA, True)) == []
    text = json.dumps(RECORDS)
    (tmp_path / "cut.json").write_text(text[: len(text) // 2])
    got = found(read_array(spark, str(tmp_path / "cut.json"), SCHEMA))
    assert got and got == RECORDS[: len(got)]
    (tmp_path / "object.json").write_text('{"no": 1}')
    for name in ("cut", "object"):
        with pytest.raises(PySparkException, match="no whole array"):
            read_array(spark, str(tmp_path / f"{name}.json"), SCHEMA, True).collect()


def test_every_cut_of_an_answer_is_closed(spark):
    text = json.dumps({"diagnostics": [{"severity": "error", "message": 'a "b" \\ }', "evidence": {"quote": "q"}}, {"message": "[x"}]})
    cuts = [text[:n] for n in range(1, len(text) + 1)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cuts)], "i int, t string")
    rows = df.select("i", P.json_object(F.col("t"), repair=True).alias("o")).collect()
    assert not [cuts[r.i] for r in rows if r.o is None]
    assert json.loads(rows[-1].o) == json.loads(text)


def test_texts_without_json(spark):
    df = spark.createDataFrame([(None,), ("",), ("no {json",), ("[1, 2]",)], "t string")
    assert [r.o for r in df.select(P.json_object(F.col("t")).alias("o")).collect()] == [None] * 4
    assert [r.n for r in df.select(F.size(P.scraped_errors(F.col("t"))).alias("n")).collect()] == [0] * 4
    assert [r.n for r in df.select(F.size(P.clamped_diagnostics(F.col("t"))).alias("n")).collect()] == [0] * 4
