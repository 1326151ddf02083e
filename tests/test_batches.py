"""A batch of the stream of closed windows is read by as many tasks as its events need."""

import os

import pytest

from siftlake.plans import q_stream
from test_oracle import SF, duck, test_query as compare  # noqa: F401


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_batches_have_several_files_and_the_same_windows(spark, duck, monkeypatch):  # noqa: F811
    monkeypatch.setattr(q_stream, "TASK_EVENTS", 60, raising=False)
    real, files = q_stream.S.stream, []
    monkeypatch.setattr(q_stream.S, "stream", lambda events, path, files_=1, **k: files.append(k.get("files", files_)) or real(events, path, **k))
    compare(spark, duck, "STR8_closed_windows")
    assert files == [3]
    got = q_stream.closed_windows(spark, SF)
    assert got.first().late_rows > 0
