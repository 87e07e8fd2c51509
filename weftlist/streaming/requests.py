"""Requests for lists as a stream: each (request_id, phrase, url) gets the best list of its page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftlist.operators import candidates, features, ranking
from weftlist.sources import html

REQUEST = "request_id long, phrase string, url string"


def predict(requests: DataFrame, pages: DataFrame, params: DataFrame) -> DataFrame:
    """(request_id, phrase, xpath, score, entities) of the best candidate; a page that is not there gives no row."""
    wanted = pages.join(requests.select("url").distinct(), "url", "left_semi")
    cands = candidates.candidates(html.nodes(wanted))
    keys = ["page_id", "root_no", "xpath"]
    scores = ranking.dot(features.path_tail(cands.withColumn("path", F.col("xpath")), keys), params, keys)
    best = ranking.ranked(cands.join(scores, keys), ["page_id"], "score", ["root_no", "xpath"], "entities").where("rank = 1")
    return requests.join(wanted.select("url", "page_id"), "url").join(best, "page_id").select("request_id", "phrase", "xpath", "score", "entities")


def serve(requests: DataFrame, pages: DataFrame, params: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Answer a stream of requests into Parquet, a folder for each batch, so that a repeated batch replaces its own rows."""

    def answer(batch: DataFrame, number: int) -> None:
        predict(batch, pages, params).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return requests.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
