"""A handful of documents and links to try the engine with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_TEXTS = (
    ("Rivers and floods", "A river floods when more rain falls than its bed can carry. Meadows beside a river store the water, and so floods downstream are lower."),
    ("How bread rises", "Yeast turns sugar into gas, and the dough holds the gas in bubbles. Warm dough rises fast, cold dough slowly and with more taste."),
    ("Search engines", "A search engine reads many documents and keeps an inverted index: for each word the documents that have it. A query is answered from the index."),
    ("Ranking pages", "Links between pages say which pages others find worth reading. A page with links from much linked pages ranks high in a search."),
    ("Keeping bees", "Bees store honey for the winter. A keeper takes some of the honey and gives sugar instead, and looks for mites in summer."),
    ("Machine learning", "A model learns from examples. A search engine may use learning to rank documents by what readers chose before."),
)
_LINKS = ((2, 3), (3, 2), (5, 2), (5, 3), (0, 4), (1, 4), (4, 0))
QUERIES = ("search engine", "honey", '"inverted index"', "rivr floods", "learning AND search")


def documents(spark: SparkSession) -> DataFrame:
    rows = [(k, f"http://sample.example/{k}", title, text, None) for k, (title, text) in enumerate(_TEXTS)]
    return spark.createDataFrame(rows, "doc_id bigint, url string, title string, content string, crawled_at timestamp")


def links(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_LINKS, "src bigint, dst bigint")
