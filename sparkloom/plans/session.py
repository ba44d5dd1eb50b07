"""Session settings that the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(name: str = "sparkloom", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, ANSI and adaptive execution on; everything else is the cluster's."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    fixed = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for k, v in (fixed | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def cut(df):
    """Materialise df in the shared checkpoint folder: later uses read the same rows, whatever executors are lost.

    The folder is the one that the cluster names in spark.checkpoint.dir; where it is unset, as in tests, a local one if the master is local.
    """
    import tempfile

    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if not named and sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="sparkloom-checkpoint-"))
    return df.checkpoint(eager=True)
