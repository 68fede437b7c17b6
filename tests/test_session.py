from types import SimpleNamespace

import pytest

from echoframe import session as SE


def fake(named=None, current=None, master="local[2]"):
    made = []
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: current, setCheckpointDir=made.append)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: named), sparkContext=context), made


def test_the_named_folder_wins():
    assert SE.shared_dir(fake(named="hdfs:///shared/", current="/other")[0]) == "hdfs:///shared"
    assert SE.shared_dir(fake(current="/set/already")[0]) == "/set/already"


def test_a_cluster_without_a_shared_folder_is_an_error():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        SE.shared_dir(fake(master="spark://host:7077")[0])


def test_a_local_session_makes_its_own():
    session, made = fake()
    assert [SE.shared_dir(session)] == made


def test_configure_sets_what_operators_count_on(spark):
    SE.configure(spark)
    assert all(spark.conf.get(k) == v for k, v in SE.RUNTIME_CONF.items())


def test_materialize_keeps_rows_and_schema(spark):
    df = spark.range(10).selectExpr("id", "cast(id as string) as s")
    out = SE.materialize(df, "test-table")
    assert out.dtypes == df.dtypes and sorted(out.collect()) == sorted(df.collect())
    assert SE.new_table_path(spark, "t") != SE.new_table_path(spark, "t")
