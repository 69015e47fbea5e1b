"""The Spark session that the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: What results depend on, and what plans want at scale.
CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def get_session(app: str = "sessionloom", **conf: str) -> SparkSession:
    """A session with CONF; further settings replace those."""
    return SparkSession.builder.appName(app).config(map=CONF | conf).getOrCreate()
