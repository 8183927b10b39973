"""Which reader an engine's replies go to, and whether an engine of the registry can be used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import feeds, html_replies, json_replies

#: Families whose engines need a spec of their own to be read.
SPEC_FAMILIES = ("xpath", "css_engine")


def implemented(family: Column, has_spec: Column, has_request: Column, has_response: Column) -> Column:
    """Whether an engine can be used: JSON engines always, selector engines with a spec or a request, others with both ends."""
    return F.when(family == "json_engine", F.lit(True)).when(family.isin(*SPEC_FAMILIES), has_spec | has_request).otherwise(has_request & has_response)


def interpret(replies: DataFrame, engine: str) -> DataFrame:
    """Hits of an engine's replies, by its JSON spec, its selectors or its feed."""
    if engine in json_replies.SPECS:
        return json_replies.extract(replies, json_replies.SPECS[engine])
    if engine in html_replies.SPECS:
        return html_replies.extract(replies, html_replies.SPECS[engine])
    if engine == "arxiv":
        return feeds.atom(replies)
    raise ValueError(f"no reader for {engine}")


def known_engines(spark: object) -> DataFrame:
    """(name, family, implemented): the engines that specs describe."""
    rows = [(n, "json_engine") for n in json_replies.SPECS] + [(n, "css_engine") for n in html_replies.SPECS] + [("arxiv", "atom")]
    d = spark.createDataFrame(rows, "name string, family string")
    yes = F.lit(True)
    return d.withColumn("implemented", implemented(F.col("family"), yes, yes, yes))
