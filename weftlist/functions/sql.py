"""The scalar functions and the page parser under names for SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from weftlist.sources import html

# Bodies are SQL, which the optimiser puts in place of a call.
BODIES = {
    "list_ws_normalize(s STRING) RETURNS STRING": r"regexp_replace(regexp_replace(s, r'[ \t\n\x0B\f\r]+', ' '), r'^[\x00-\x20]+|[\x00-\x20]+\z', '')",
    "list_phrase_shape(s STRING) RETURNS STRING": r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, r'\p{javaLowerCase}', 'a'), r'[\p{L}&&[^a]]', 'A'), r'\p{Nd}', '0'), r'[\p{Z}\t-\r\x1c-\x1f]', ' '), r'(?s)(.)\1+', '$1')",
    "list_bag_of_words(s STRING) RETURNS ARRAY<STRING>": "array_sort(array_distinct(regexp_extract_all(regexp_replace(s, '[0-9]+', '0'), '[A-Za-z0-9]+', 0)))",
    "list_tokens(s STRING) RETURNS ARRAY<STRING>": "regexp_extract_all(lower(s), '[a-z]+|[0-9]+', 0)",
}


@udtf(returnType=html.SCHEMA.replace("page_id long, ", ""))
class HtmlNodes:
    """html_nodes(html): the rows of the node table of one page."""

    def eval(self, page: str):
        for row in html.rows_of(0, page):
            yield (*row[1:7], dict(row[7]), *row[8:])


def register(spark: SparkSession) -> None:
    """Makes list_ws_normalize, list_phrase_shape, list_bag_of_words, list_tokens and the table function html_nodes known to SQL."""
    for head, body in BODIES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udtf.register("html_nodes", HtmlNodes)
