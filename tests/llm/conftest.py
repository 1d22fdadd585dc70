from __future__ import annotations

import pytest

from docketry import store


@pytest.fixture
def results_only(spark, monkeypatch, tmp_path):
    """Tables go to a folder of the test's own, in which a registered query may leave its result alone."""
    monkeypatch.setattr(store, "shared_folder", lambda spark: str(tmp_path))
    yield tmp_path
    left = [p.name.rsplit("_", 1)[0] for p in tmp_path.glob("docketry/*/*")]
    store.clean_up(spark)
    assert len(left) <= 1 and all(name.startswith(("op", "bpe_encode")) for name in left)
