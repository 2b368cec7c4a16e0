"""Session settings the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Runtime (per-session) settings only; cluster sizing belongs to spark-submit.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    # Runtime re-planning: coalesce small partitions, split skewed join inputs
    # even where the split costs one more exchange downstream.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Methods the JVM would not compile are split by operator instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # `row_number() <= n` is cut to n rows per group before the shuffle.
    "spark.sql.optimizer.windowGroupLimitThreshold": "10000",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", app: str = "sluice", shuffle_partitions: int = 8,
                  memory: str = "12g") -> SparkSession:
    """A local session for tests and the benchmark."""
    spark = (SparkSession.builder.master(f"local[{cores}]").appName(app)
             .config("spark.ui.enabled", "false")
             .config("spark.driver.memory", memory)
             .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
             .config("spark.ui.showConsoleProgress", "false")
             # Recording a Python stack per column expression slows plan building.
             .config("spark.python.sql.dataFrameDebugging.enabled", "false")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)
