"""Tiles follow the size of the matrix, whatever number is asked for."""

from meshloom.operators import tiles


def test_a_large_matrix_gets_more_tiles(spark, monkeypatch):
    monkeypatch.setattr(tiles, "ENTRIES_PER_TILE", 500)
    near = spark.range(600).selectExpr("id as i", "explode(sequence(greatest(0L, id - 3), least(599L, id + 3))) as j")
    matrix = near.selectExpr("i", "j", "cast((i * 7 + j * 3) % 5 as double) as a").cache()
    vector = spark.range(600).selectExpr("id as i", "cast(id % 11 as double) as x")
    with tiles.tiled(matrix, vector, 2) as held:
        assert held.held.count() >= matrix.count() / 500
        found = sorted(map(tuple, held.product().collect()))
    by_sql = {r["i"]: r["y"] for r in matrix.join(vector.withColumnRenamed("i", "j"), "j").selectExpr("i", "a * x as t").groupBy("i").sum("t").toDF("i", "y").collect()}
    assert len(found) == 600 and all(by_sql[i] == y for i, y in found)
