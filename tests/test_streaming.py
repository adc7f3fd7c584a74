from seasight.operators.screening import screen
from seasight.streaming.screening import screen_stream


def test_stream_says_what_the_batch_says(spark, tmp_path):
    cells = [(0, 0, r, c, 0.03, 0.01, 0.01, 0.02 if r < 3 and c < 4 else 0.002, 0.001, 6) for r in range(12) for c in range(12)]
    px = spark.createDataFrame(cells, "tr long, tc long, r long, c long, green double, red double, rededge2 double, nir double, swir1 double, scl int")
    px.write.parquet(f"file://{tmp_path}/in")
    q = screen_stream(spark.readStream.schema(px.schema).parquet(f"file://{tmp_path}/in"), f"file://{tmp_path}/out", f"file://{tmp_path}/at")
    q.awaitTermination(120)
    got = spark.read.parquet(f"file://{tmp_path}/out").drop("batch")
    assert got.collect() == screen(px).collect() and got.first()["n_pixels"] == 144
