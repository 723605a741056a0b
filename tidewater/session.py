"""Session factory (A12) and the shared scratch folder.

The library uses neither the Spark context object, the JVM gateway nor RDDs, so every
function works the same on a classic session and on a Spark Connect session.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Mapping

from pyspark.sql import SparkSession

from .config import BATCH_CONF, ENV_CONNECT_URL, INTERACTIVE_CONF


class SessionError(RuntimeError):
    """The session cannot be opened or is not of the expected kind."""


def get_session(
    remote: str | None = None,
    *,
    app_name: str = "tidewater",
    conf: Mapping[str, str] | None = None,
    env: Mapping[str, str] | None = None,
) -> SparkSession:
    """Open a session.

    ``remote`` (or ``SPARK_CONNECT_URL`` when ``remote`` is ``"env"``) selects a
    Spark Connect session: an active local session is stopped first, since the
    two cannot coexist in one process; the session must report a version and be
    a Connect session, otherwise the error is raised.  Without ``remote`` a
    named batch session is built (or the active one reused).
    """
    env = os.environ if env is None else env
    url = env.get(ENV_CONNECT_URL) if remote == "env" else remote
    if remote == "env" and not url:
        raise SessionError(f"{ENV_CONNECT_URL} is not set")
    if url:
        active = SparkSession.getActiveSession()
        if active is not None and "connect" not in type(active).__module__:
            active.stop()
        builder = SparkSession.builder.remote(url)
        # Only SQL settings can change in a running server session; the rest of
        # INTERACTIVE_CONF belongs in the server's own configuration.
        for k, v in {**INTERACTIVE_CONF, **(conf or {})}.items():
            if k.startswith("spark.sql."):
                builder = builder.config(k, v)
        spark = builder.getOrCreate()
        check_session(spark, expect_connect=True)
        return spark
    builder = SparkSession.builder.appName(app_name)
    for k, v in {**BATCH_CONF, **(conf or {})}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def check_session(spark: SparkSession, *, expect_connect: bool) -> str:
    """Return the server version; fail if the session type is not the expected one."""
    version = spark.version
    is_connect = "connect" in type(spark).__module__
    if expect_connect and not is_connect:
        raise SessionError(f"expected a Spark Connect session, got {type(spark).__module__}")
    return version


_LOCAL_FALLBACK: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder: ``spark.checkpoint.dir`` from the session.

    Only a local-mode session without that setting (tests) gets a private
    temporary folder; on a cluster a machine-local folder would be invisible to
    the executors and lost with the driver, so that case is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.conf.get("spark.master", "") or ""
    if not master.startswith("local"):
        raise SessionError(
            "spark.checkpoint.dir is not set; point it at a folder every executor can reach"
        )
    if "dir" not in _LOCAL_FALLBACK:
        _LOCAL_FALLBACK["dir"] = tempfile.mkdtemp(prefix="tidewater-")
    return _LOCAL_FALLBACK["dir"]


def scratch_path(spark: SparkSession, *parts: str, unique: bool = True) -> str:
    """A path under the shared folder; with ``unique`` a fresh sub-folder."""
    pieces = [shared_root(spark), "tidewater", *[p.strip("/") for p in parts if p]]
    if unique:
        pieces.append(uuid.uuid4().hex[:12])
    return "/".join(pieces)
