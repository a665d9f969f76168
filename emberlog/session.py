"""Session settings that the operators count on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",  # naive timestamps are UTC
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",  # a repeated logfmt key: the last value counts
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def get_session(app: str = "emberlog", **settings: str) -> SparkSession:
    """A session with our settings; ``settings`` (dots as double underscores) override them."""
    conf = SETTINGS | {k.replace("__", "."): v for k, v in settings.items()}
    spark = SparkSession.builder.appName(app).config(map=conf).getOrCreate()
    return configure(spark)


def configure(spark: SparkSession) -> SparkSession:
    """Apply the SQL settings to a session that somebody else made."""
    for key, value in SETTINGS.items():
        if spark.conf.isModifiable(key):
            spark.conf.set(key, value)
    return spark
