"""The settings must work on a session that someone else made."""

from types import SimpleNamespace

import pytest

from geoweave import session


def test_runtime_settings_can_be_set_on_a_running_session(spark):
    assert [k for k in session.RUNTIME_CONF if not spark.conf.isModifiable(k)] == []
    assert session.configure(spark) is spark


def test_intermediate_tables_go_to_the_named_folder(spark):
    kept = session.cut_lineage(spark.range(5), "numbers")
    assert kept.count() == 5
    folder = session.shared_dir(spark).removeprefix("file:")
    assert all(f.removeprefix("file:").lstrip("/").startswith(folder.lstrip("/")) for f in kept.inputFiles())


def fake(named, master):
    """A session with only what the choice of folder reads."""
    state = {"dir": None}
    context = SimpleNamespace(
        master=master, getCheckpointDir=lambda: state["dir"],
        setCheckpointDir=lambda d: state.update(dir=d),
    )
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default=None: named), sparkContext=context
    )


def test_choice_of_folder():
    assert session.shared_dir(fake("/shared/x", "spark://host:7077")) == "/shared/x"
    with pytest.raises(ValueError):
        session.shared_dir(fake(None, "spark://host:7077"))
    local = fake(None, "local[2]")
    made = session.shared_dir(local)
    assert made.startswith("/tmp/run-") and session.shared_dir(local) == made
