"""What a task hands on of arrivals that come again."""

import pandas as pd

from newsline.streaming import ingest


def test_a_key_leaves_a_task_once(monkeypatch):
    """Rows of one key in many Arrow batches are one row, the earliest; many keys are handed on in parts, none lost."""
    rows = [pd.DataFrame({"id": [f"k{i}" for i in range(50)], "url": "u", "fetched_at": pd.Timestamp("2024-01-09") - pd.Timedelta(hours=b)}) for b in range(20)]
    got = pd.concat(ingest._earliest(iter(rows)))
    assert len(got) == 50 and set(got.fetched_at) == {rows[-1].fetched_at[0]}
    monkeypatch.setattr(ingest, "HELD", 60)
    parts = list(ingest._earliest(iter([r.assign(id=[f"{b}-{i}" for i in range(50)]) for b, r in enumerate(rows)])))
    assert len(pd.concat(parts).id.unique()) == 1000 and len(parts) > 5
    assert list(ingest._earliest(iter([]))) == []
