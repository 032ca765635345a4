"""Weights read anew for each micro-batch."""

import json

from sondage.functions import lists
from sondage.streaming import weights


def test_scores_change_between_batches(spark, tmp_path):
    folder, source = str(tmp_path / "weights"), tmp_path / "hits"
    source.mkdir()
    hits = [{"query": "q", "path": "a", "channel": "w_recency", "rrf": 0.5}, {"query": "q", "path": "a", "channel": "other", "rrf": 0.25}]
    for i in range(3):
        (source / f"{i}.json").write_text("\n".join(json.dumps(h) for h in hits))
    stream = spark.readStream.schema("query string, path string, channel string, rrf double").option("maxFilesPerTrigger", 1).json(str(source))
    seen = []

    def write(rows, number):
        seen.extend((number, r["score"]) for r in rows.collect())
        # A new version while the stream runs; the last one makes no sense for its key and leaves the default.
        weights.publish(spark.createDataFrame([("w_recency", 2.0)] if number == 0 else [("rrf_k", -1.0)], "key string, value double"), folder)

    query = weights.rescored(stream, folder, write, str(tmp_path / "c"))
    assert query.awaitTermination(120)
    usual = round(0.5 * lists.WEIGHTS["w_recency"] + 0.25, 9)
    assert seen == [(0, usual), (1, 1.25), (2, usual)]
    assert weights.latest(spark, folder) == 3
    now = {r["key"]: r["value"] for r in weights.current(spark, folder).collect()}
    assert now == dict(lists.WEIGHTS)
    assert weights.latest(spark, str(tmp_path / "none")) == 0
