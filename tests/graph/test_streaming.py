from tessera.streaming.degrees import degree_stream, edge_stream


def test_degrees_grow(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("# c\n1 2\n2 3\n3 3\n")
    q = degree_stream(edge_stream(spark, str(folder))).writeStream.outputMode("complete").format("memory").queryName("degrees_so_far").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        q.processAllAvailable()
        assert {r.node: r.deg for r in spark.table("degrees_so_far").collect()} == {1: 1, 2: 2, 3: 1}
        (folder / "b.txt").write_text("2 1\n")
        q.processAllAvailable()
        assert {r.node: r.deg for r in spark.table("degrees_so_far").collect()} == {1: 2, 2: 3, 3: 1}
    finally:
        q.stop()
