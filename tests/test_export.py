from __future__ import annotations

from datetime import date
from decimal import Decimal

import pytest

from navloom.sources import export

SCHEMA = "scheme_id long, nav_date date, nav decimal(18,6), note string"
ROWS = [(1, date(2024, 1, 1), Decimal("10.123456"), None), (1, date(2024, 1, 2), Decimal("99999999.000001"), "é\n\""), (2, date(2024, 1, 1), None, "")]


def test_round_trip_fills_gaps_only(spark, tmp_path):
    path = str(tmp_path / "e")
    export.save(spark.createDataFrame(ROWS, SCHEMA), path, "prices")
    assert sorted(map(tuple, export.load(spark, path, "prices").collect()), key=str) == sorted(ROWS, key=str)
    mine = (1, date(2024, 1, 2), Decimal("5.000000"), "mine")
    got = export.restore(spark.createDataFrame([mine], SCHEMA), path, "prices", ["scheme_id", "nav_date"]).collect()
    assert sorted(map(tuple, got), key=str) == sorted([mine, ROWS[0], ROWS[2]], key=str)


def test_foreign_and_damaged_exports_are_refused(spark, tmp_path):
    path = str(tmp_path / "e")
    df = spark.createDataFrame(ROWS, SCHEMA)
    export.save(df, path, "prices")
    with pytest.raises(export.ForeignExport, match="wanted 'holdings'"):
        export.load(spark, path, "holdings")
    with pytest.raises(export.ForeignExport, match="its columns"):
        export.restore(df.drop("note"), path, "prices", ["scheme_id"])
    df.limit(1).write.mode("append").json(f"{path}/rows")
    with pytest.raises(export.ForeignExport, match="4 rows"):
        export.load(spark, path, "prices")
