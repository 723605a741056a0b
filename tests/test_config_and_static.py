"""A10, A12, A13, A14 and static checks on the library code."""

import pathlib
import re

import pytest

from tidewater import config as C
from tidewater.session import SessionError, check_session, scratch_path, shared_root

LIB = pathlib.Path(__file__).resolve().parent.parent / "tidewater"


def test_from_env_defaults_and_paths():
    cfg = C.JobConfig.from_env({})
    assert (cfg.bucket, cfg.input_prefix, cfg.output_prefix, cfg.run_date) == (
        "data-pro", "raw", "processed", "19700101")
    assert cfg.input_path == "s3a://data-pro/raw/"
    assert cfg.output_path == "s3a://data-pro/processed/19700101/"
    assert cfg.attempt_path("a1") == "s3a://data-pro/processed/run_date=19700101/attempt=a1"
    env = {"MINIO_BUCKET": "b", "INPUT_PREFIX": "in", "OUTPUT_PREFIX": "out", "RUN_DATE": "20240102",
           "MINIO_ENDPOINT": "http://store:9000"}
    cfg = C.JobConfig.from_env(env)
    assert (cfg.input_path, cfg.output_path, cfg.endpoint) == (
        "s3a://b/in/", "s3a://b/out/20240102/", "http://store:9000")


def test_date_range():
    assert C.date_range("20240130", "20240202") == ["20240130", "20240131", "20240201", "20240202"]


def test_s3a_conf_keys_from_env_and_redacted():
    env = {"AWS_ACCESS_KEY_ID": "AK", "AWS_SECRET_ACCESS_KEY": "SK"}
    conf = C.s3a_conf("http://store:9000", env=env)
    assert conf["spark.hadoop.fs.s3a.endpoint"] == "http://store:9000"
    assert conf["spark.hadoop.fs.s3a.connection.ssl.enabled"] == "false"
    assert conf["spark.hadoop.fs.s3a.path.style.access"] == "true"
    red = C.redact(conf)
    assert "AK" not in red.values() and "SK" not in red.values()
    assert "spark.hadoop.fs.s3a.access.key" not in C.s3a_conf("https://s3", env={})


def test_profiles_do_not_fix_two_partitions():
    assert C.BATCH_CONF["spark.sql.adaptive.enabled"] == "true"
    assert "spark.sql.shuffle.partitions" not in C.BATCH_CONF
    assert C.INTERACTIVE_CONF["spark.driver.maxResultSize"] == "4g"


def test_session_checks(spark):
    assert check_session(spark, expect_connect=False) == spark.version
    with pytest.raises(SessionError):
        check_session(spark, expect_connect=True)


def test_scratch_under_shared_folder(spark):
    root = shared_root(spark)
    assert root == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert scratch_path(spark, "x").startswith(root + "/tidewater/x/")


FORBIDDEN = [r"sparkContext", r"\._jvm", r"\._jdf", r"\.rdd\b", r"localCheckpoint",
             r"\budf\(", r"pandas_udf"]


@pytest.mark.parametrize("pattern", FORBIDDEN)
def test_library_is_connect_safe(pattern):
    hits = [f"{p.name}:{i}" for p in LIB.rglob("*.py")
            for i, line in enumerate(p.read_text().splitlines(), 1) if re.search(pattern, line)]
    assert not hits, hits


def test_no_unbounded_collect():
    """Every collect() in the library is bounded: a limit in the same statement
    or a ``# bounded:`` note stating the bound (one row per date, ...)."""
    unjustified = []
    for p in LIB.rglob("*.py"):
        lines = p.read_text().splitlines()
        for i, line in enumerate(lines):
            if ".collect()" not in line or line.lstrip().startswith("#"):
                continue
            window = "\n".join(lines[max(0, i - 3):i + 1])
            if ".limit(" not in window and "# bounded:" not in window:
                unjustified.append(f"{p.name}:{i + 1}")
    assert not unjustified, unjustified


def test_get_session_batch_profile(spark):
    from tidewater.session import get_session
    s = get_session(app_name="t", conf={"spark.sql.shuffle.partitions": "8"})
    assert s.conf.get("spark.sql.adaptive.enabled") == "true"
    assert s.conf.get("spark.sql.adaptive.skewJoin.enabled") == "true"


def test_get_session_env_remote_needs_url():
    from tidewater.session import get_session
    with pytest.raises(SessionError):
        get_session("env", env={})


def test_functions_exist_in_connect_client():
    """Every ``F.<name>`` the library calls also exists in the Spark Connect
    client, and so do the DataFrame methods it relies on.  Checked on the
    installed client's source (importing it needs grpc; no server is used)."""
    import pyspark
    connect = pathlib.Path(pyspark.__file__).parent / "sql" / "connect"
    defined = set()
    for f in (connect / "functions").glob("*.py"):
        defined |= set(re.findall(r"^def ([a-z_]+)\(", f.read_text(), re.M))
    used = set()
    for p in LIB.rglob("*.py"):
        used |= set(re.findall(r"\bF\.([a-z_]+)\(", p.read_text()))
    assert used and not sorted(used - defined), sorted(used - defined)
    source = (connect / "dataframe.py").read_text()
    df_methods = set(re.findall(r"^    def ([A-Za-z_]+)\(", source, re.M))
    df_methods |= set(re.findall(r"^    ([A-Za-z_]+) = ", source, re.M))  # aliases
    needed = {"observe", "hint", "dropna", "withColumns", "unionByName", "join", "groupBy",
              "select", "filter", "limit", "orderBy", "drop", "fillna",
              "createOrReplaceTempView", "exceptAll"}
    assert not sorted(needed - df_methods), sorted(needed - df_methods)
