import pytest

from cairn.progress import Progress, elapsed_text, rate_text


def test_weighted_percentage():
    heard = []
    p = Progress({"scan": 1, "store": 3})
    p.register(lambda percent, step: heard.append((percent, step)))
    p.estimate("scan", 4)
    p.record("scan", 2)
    p.complete("scan")
    p.estimate("store", 200)
    p.record("store", 100)
    p.record("store", 1000)
    assert heard == [(13, "scan"), (25, "scan"), (63, "store"), (100, "store")]
    with pytest.raises(KeyError):
        p.record("other")
    p.reset()
    assert p.percent == 0


def test_texts():
    assert elapsed_text(3_723_004) == "01:02:03.004"
    assert rate_text(3 << 20, 1500) == "3.000 MiB (2.000 MiB/s)"
