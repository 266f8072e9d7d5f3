import json

import pytest

from ledgerloom.__main__ import main
from ledgerloom.functions.register import register
from ledgerloom.sinks.artifacts import verify_artifacts, write_artifacts
from ledgerloom.sources.cases import load_case

COLUMNS = {"pixels": {"row": "int", "col": "int", "red": "decimal(10,6)"}}


def test_case_with_its_files(spark, tmp_path):
    (tmp_path / "p.csv").write_text("row,col,red\n0,0,0.5\n0,1,x\n")
    (tmp_path / "m.json").write_text(json.dumps({"files": {"pixels": "p.csv"}}))
    case = load_case(spark, tmp_path / "m.json", COLUMNS)
    assert case.tables["pixels"].count() == 1 == case.violations["pixels"].count() and case.evidence["pixels"]["bytes"] == 26
    for files in ({"pixels": "../p.csv"}, {"pixels": "p.csv", "more": "p.csv"}, {}):
        (tmp_path / "m.json").write_text(json.dumps({"files": files}))
        with pytest.raises(ValueError):
            load_case(spark, tmp_path / "m.json", COLUMNS)


def test_artifacts_are_the_same_bytes_again(tmp_path):
    (tmp_path / "in").write_text("x")
    first = write_artifacts(tmp_path / "a", {"o.json": "{}\n"}, {"in": tmp_path / "in"})
    assert first == write_artifacts(tmp_path / "b", {"o.json": "{}\n"}, {"in": tmp_path / "in"})
    assert (tmp_path / "a/manifest.json").read_bytes() == (tmp_path / "b/manifest.json").read_bytes()
    assert verify_artifacts(tmp_path / "a", first) == []
    (tmp_path / "a/o.json").write_text("{ }\n")
    assert verify_artifacts(tmp_path / "a", first) == ["o.json"]


def test_sql_functions(spark):
    register(spark)
    assert spark.sql("SELECT compatibility_fold('ＡＢ')").first()[0] == "ab"
    assert [tuple(r) for r in spark.sql("SELECT * FROM word_grams('abc x')").collect()] == [("ab", 2), ("bc", 2), ("abc", 3)]


def test_command_line(spark, small_data, tmp_path, capsys):
    assert main(["list"]) == 0 and "select_winner" in capsys.readouterr().out
    assert main(["run", "nothing", small_data, str(tmp_path / "x")]) == 2
    assert main(["run", "status_counts", small_data, str(tmp_path / "o")]) == 0
    assert spark.read.parquet(str(tmp_path / "o")).count() >= 3
