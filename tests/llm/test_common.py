from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from reviewlake.llm import common
from reviewlake.llm.components import connected_components


def session(conf, checkpoint, master="local[2]"):
    seen = []
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: checkpoint, setCheckpointDir=seen.append)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: conf or d), sparkContext=context), seen


def test_the_shared_folder_is_the_clusters():
    assert common.shared_folder(session("hdfs://x", None)[0]) == "hdfs://x"
    assert common.shared_folder(session(None, "file:/y")[0]) == "file:/y"
    own, seen = session(None, None)
    assert seen == [] and common.shared_folder(own).startswith("file://") and len(seen) == 1


def test_a_cluster_without_a_shared_folder_is_an_error():
    own, seen = session(None, None, "spark://host:7077")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_folder(own)
    assert seen == [] and common.shared_folder(session("s3a://x", None, "yarn")[0]) == "s3a://x"


def test_components_of_chains_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 130)] + [(7, 7), (100, 101), (101, 100)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_clashing_names_pass_through(spark):
    df = spark.createDataFrame([(1, "t", "x", "y")], "doc_id long, text string, _row string, `a.b` string")
    out = common.replaced(common.packed(df, n=F.lit(1)), df, text=F.lit("z"))
    assert out.columns == df.columns and tuple(out.first()) == (1, "z", "x", "y")
