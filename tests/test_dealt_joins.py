"""Tables by node are broadcast only where they are known to be small."""

from ledgerspark.operators import modularity


def test_great_labellings_are_not_broadcast(spark, tmp_path):
    edges = spark.range(40).selectExpr("id AS src", "id + 1 AS dst")
    modularity.weighted(edges).write.parquet(f"{tmp_path}/links")
    links = spark.read.parquet(f"{tmp_path}/links")
    modularity.degrees(links).selectExpr("node", "node AS label", "k").write.parquet(f"{tmp_path}/state")
    state = spark.read.parquet(f"{tmp_path}/state")

    def broadcasts(rows: int) -> list[int]:
        both = modularity.moved(links, state, 80.0, 0, rows), modularity.modularity_parts(links, state.select("node", "label"), rows)
        return [d._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") for d in both]

    assert broadcasts(modularity.FEW + 1) == [0, 0] and min(broadcasts(41)) > 0
    many, few = ({r["node"]: r["label"] for r in modularity.moved(links, state, 80.0, 0, n).collect()} for n in (None, 41))
    assert many == few and len(few) == 41
