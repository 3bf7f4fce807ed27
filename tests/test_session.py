from __future__ import annotations

from skysieve import session


def test_cut_tables_are_read_from_the_shared_folder_and_released(spark, tmp_path):
    df = session.cut(spark.range(10).selectExpr("id", "struct(id as a) as s"))
    assert df.count() == 10 and all(session.shared_dir(spark).rpartition(":")[2].strip("/") in f for f in df.inputFiles())
    own = session.stored(spark.range(3), "own", path=f"file://{tmp_path}/own")
    assert session.release(spark) >= 1 and session.release(spark) == 0
    assert own.count() == 3
