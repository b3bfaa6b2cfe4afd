import glob

import pytest

from panelweave import session


def test_materialise_and_clear(spark):
    folder = f"{session.shared_dir(spark).removeprefix('file://')}/panelweave-{session.RUN}"
    df = session.materialise(spark.range(5), "five")
    assert df.count() == 5 and glob.glob(f"{folder}/*/five")
    assert session.materialise(spark.range(0), "none").dtypes == spark.range(0).dtypes
    session.clear_shared(spark)
    assert not glob.glob(f"{folder}/*")


def test_a_round_is_discarded(spark):
    one, two = session.materialise(spark.range(3), "one"), session.materialise(spark.range(4), "two")
    session.discard(one)
    folder = f"{session.shared_dir(spark).removeprefix('file://')}/panelweave-{session.RUN}"
    assert not glob.glob(f"{folder}/*/one") and two.count() == 4


def test_a_cluster_must_name_its_shared_folder():
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())


def test_partitions_follow_the_session(spark):
    assert session.partitions(spark) == int(spark.conf.get("spark.sql.shuffle.partitions"))
