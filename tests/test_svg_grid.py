import pytest

from ledgerloom.sinks import canonical


def test_a_grid_is_drawn_whole_or_not_at_all(spark, monkeypatch):
    monkeypatch.setattr(canonical, "MOST_ROWS", 4)
    cells = spark.range(5).selectExpr("id AS row", "0L AS col", "'red' AS fill")
    assert canonical.svg_grid(cells.filter("row < 4")).count("<rect") == 4
    with pytest.raises(ValueError):
        canonical.svg_grid(cells)
