"""What only larger tables show, on small ones that are made for it."""

import duckdb
import pytest
from test_queries import rows

from millrace import queries as core


def held(spark, duck_tables, name, d):
    duck = duckdb.connect()
    for t in duck_tables:
        duck.execute(f"create view {t} as select * from '{d}/{t}.parquet/*.parquet'")
    return rows(core.QUERIES[name](spark, str(d)).toPandas()), rows(duck.execute(core.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", ["emotion_classes", "thread_class_breakdown", "thread_fold", "fold_outcomes"])
def test_prose_that_is_a_feeling_by_chance(spark, tmp_path, name):
    prose = ["The haha.", "No.", "Thenou is the.", "Y es.", "Thon of thorbleou of."]
    made = [(c, t, "user", prose[(c + t) % 5]) for c in range(8, 14) for t in range(6)]
    spark.createDataFrame(made, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got, want = held(spark, ["conversations"], name, tmp_path)
    assert got == want


def test_images_are_rows_of_their_own(spark, tmp_path):
    """Pixels are neither dealt out nor sorted: the plan of the pictures' queries has no shuffle by pixel, and odd pictures count as before."""
    from millrace.operators import media

    spark.range(1, 41).withColumnRenamed("id", "p_partkey").write.parquet(str(tmp_path / "part.parquet"))
    for name in ("image_verdicts", "best_images"):
        got, want = held(spark, ["part"], name, tmp_path)
        assert got == want and want
    plan = core.QUERIES["image_verdicts"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Window" not in plan
    pixels = [(i, 3, 2, x, y, 50 * x * i % 256, 20 * y, 10 * i) for i in (1, 2) for x in range(3) for y in range(2)][::-1]
    table = spark.createDataFrame(pixels, "image_id int, width int, height int, x int, y int, r int, g int, b int")
    whole = {r["image_id"]: r for r in media.image_stats(table).collect()}
    media.PIECE, piece = 4, media.PIECE
    try:
        parts = {r["image_id"]: r for r in media.image_stats(table).collect()}
    finally:
        media.PIECE = piece
    assert whole == parts and whole[1]["pixels"] == 6 and (whole[1]["texture"], whole[2]["texture"]) == (0, 1)


def test_pages_of_one_file_are_read_by_all_cores(spark, tmp_path):
    """The customers' file has one row group, which one task would read and parse; the posts are the SQL's."""
    spark.range(1, 401, numPartitions=1).withColumnRenamed("id", "c_custkey").write.parquet(str(tmp_path / "customer.parquet"))
    assert core.QUERIES["timeline_extraction"](spark, str(tmp_path)).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    got, want = held(spark, ["customer"], "timeline_extraction", tmp_path)
    assert got == want and len(want) == 400
