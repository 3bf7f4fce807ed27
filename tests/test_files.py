from __future__ import annotations

import json
import zipfile

import pytest

from skysieve.functions.checks import ConstraintError
from skysieve.sources import files


def test_rosters(spark, tmp_path):
    for name, value in (("a.json", ["x", "y"]), ("b.json", {"event_ids": ["x", "y"]})):
        (tmp_path / name).write_text(json.dumps(value))
        assert sorted(r[0] for r in files.read_roster(spark, str(tmp_path / name)).collect()) == ["x", "y"]
    for i, value in enumerate((["x", "x"], ["x", " "], [], ["x", None])):
        (tmp_path / f"bad{i}.json").write_text(json.dumps(value))
        with pytest.raises(ConstraintError):
            files.read_roster(spark, str(tmp_path / f"bad{i}.json"))


def test_archive(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("train_data.csv", "event_id,risk\n1,-6.5\n1,-7\n2,\n")
    df = files.read_archive(spark, str(tmp_path / "a.zip"), rows=3, events=2)
    assert df.filter("risk is null").count() == 1
    with pytest.raises(ConstraintError):
        files.read_archive(spark, str(tmp_path / "a.zip"), rows=4)
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("other.csv", "x\n")
    with pytest.raises(ConstraintError):
        files.read_archive(spark, str(tmp_path / "b.zip"))


def test_audits_and_sinks(spark, tmp_path):
    h = "a" * 64
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    files.write_once(spark.createDataFrame([("e", 1, h)], "event_id string, sequence_number int, model_sha256 string"), a)
    files.write_once(spark.createDataFrame([("e", 2, h, 1.0)], "event_id string, sequence_number int, model_sha256 string, score double"), b)
    assert files.read_audits(spark, [a, b], ("model_sha256",)).count() == 2
    with pytest.raises(ConstraintError):
        files.read_audits(spark, [a, a])
    with pytest.raises(Exception, match="(?i)exists"):
        files.write_once(spark.range(1), a)
    files.write_report(spark.range(3), str(tmp_path / "r"))
    assert spark.read.csv(str(tmp_path / "r"), header=True).count() == 3
