import os

from loanscope.session import checkpoint_dir, materialize, new_folder


def test_local_session_without_a_checkpoint_folder(spark):
    if spark.conf.get("spark.checkpoint.dir", None):
        return
    path = checkpoint_dir(spark)
    assert path == checkpoint_dir(spark) and os.path.isdir(path)
    assert new_folder(spark, "x").startswith(path) and new_folder(spark, "x") != new_folder(spark, "x")
    assert materialize(spark.range(5), "five").count() == 5
