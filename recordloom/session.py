"""Session settings the library is tuned for.

Every value can be overridden by the cluster's own configuration; nothing here
is needed for correctness.
"""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession

#: Settings that pay off at scale. AQE splits skewed join sides and coalesces
#: small shuffle partitions; the larger object-aggregate threshold keeps
#: ``collect_list`` in hash mode for more than the default 128 groups per task.
#: Plans are put together from many small column expressions; noting the Python
#: line of each, for error messages, would double the time that takes.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "4096",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.showConsoleProgress": "false",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with :data:`DEFAULTS`, then ``conf`` on top."""
    builder = SparkSession.builder.appName("recordloom")
    if master is not None:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names in
    ``spark.checkpoint.dir``. Only a local session without one gets a folder of
    its own; on a cluster a machine-local folder would be lost with the machine,
    so there the missing setting is an error."""
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get(
        "spark.checkpoint.dir", None
    )
    if named is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    context.setCheckpointDir(named)
    return named


def together(*steps: Callable[[], None]) -> None:
    """Run steps that do not wait for each other at the same time; their jobs are small."""
    with ThreadPoolExecutor(len(steps)) as pool:
        for done in [pool.submit(step) for step in steps]:
            done.result()


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, whose Python workers import it. Not
    needed where it is installed on every machine or passed by ``--py-files``."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="spark-", dir="/tmp"), "recordloom.zip")
    with zipfile.ZipFile(path, "w") as bundle:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    bundle.write(full, os.path.relpath(full, os.path.dirname(here)))
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)
