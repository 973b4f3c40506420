"""A local Spark session with the settings the engine is tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(cores: int = 8, name: str = "orrery") -> SparkSession:
    """On a cluster take the session that it gives, whose ``spark.checkpoint.dir`` all executors share; these settings
    suit one machine, where a folder of its own does."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.sql.shuffle.partitions", str(max(8, cores)))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
