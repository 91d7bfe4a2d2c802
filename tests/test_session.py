from __future__ import annotations

from pathlib import Path
from types import SimpleNamespace

import pytest

from folioscan.session import scratch_path, shared_folder, staged, temporary_tables


def session(**conf):
    names = {name.replace("_", "."): value for name, value in conf.items()}
    return SimpleNamespace(conf=SimpleNamespace(get=lambda name, default=None: names.get(name, default)))


def test_the_named_folder_is_used():
    named = session(spark_checkpoint_dir="hdfs:///shared/", spark_master="yarn")
    assert shared_folder(named) == "hdfs:///shared"


def test_a_cluster_has_to_name_a_folder():
    with pytest.raises(RuntimeError):
        shared_folder(session(spark_master="yarn"))


def test_a_local_session_gets_one_temporary_folder():
    local = session(spark_master="local[8]")
    assert shared_folder(local) == shared_folder(local)


def test_staged_tables_go_with_their_scope(spark):
    outside = staged(spark.range(3), "kept")
    paths = []
    with temporary_tables(spark):
        table = staged(spark.range(5), "gone")
        paths.append(table.inputFiles()[0].removeprefix("file://"))
        assert table.count() == 5 and Path(paths[0]).exists()
        scratch_path(spark, "never written")
    assert not Path(paths[0]).exists() and outside.count() == 3
