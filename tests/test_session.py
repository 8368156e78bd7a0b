import os
from types import SimpleNamespace

import pytest

from pairloom import session


def test_tables_go_to_the_shared_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "_written", {})
    monkeypatch.setattr(session, "shared_folder", lambda _: str(tmp_path))
    df = session.write_through(spark.range(10).repartition(3))
    assert df.count() == 10 and len(os.listdir(tmp_path)) == 1
    assert "Range" not in df._jdf.queryExecution().toString()
    session.release(spark)
    assert os.listdir(tmp_path) == []


def fake(setting, master):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda *_: setting), sparkContext=context)


def test_the_setting_names_the_folder():
    assert session.shared_folder(fake("hdfs://shared/x", "yarn")) == "hdfs://shared/x"
    with pytest.raises(RuntimeError):
        session.shared_folder(fake(None, "yarn"))


def test_a_local_session_finds_a_folder(spark):
    assert session.shared_folder(spark)


def test_only_a_local_session_makes_a_folder():
    local = fake(None, "local[2]")
    made = []
    local.sparkContext.setCheckpointDir = made.append
    local.sparkContext.getCheckpointDir = lambda: made[0] if made else None
    assert os.path.isdir(session.shared_folder(local))
    os.rmdir(made[0])
