import numpy as np
import pytest

from corpusgraph.llm import secrets


@pytest.fixture(scope="module")
def net():
    rows = secrets.made()
    return secrets.fit(np.array([secrets.encode(t, a, z) for t, a, z, _ in rows], np.int32), np.array([y for *_, y in rows], float))


def covered(net, text, a, z):
    spans = secrets._scan_texts([text], net)[0]
    return all(any(s <= i < e for s, _, e, _ in spans) for i in range(a, z))


def test_keys_deep_inside_long_candidates(net):
    key = "Zq8RtY2mKx0VbN4cLw7JhD5s"
    for head in ("com/services/T00000000/B00000000/", "a" * 30 + "/" + "b" * 30 + "/", "x/" * 200):
        text = "see " + head + key + " now"
        assert covered(net, text, 4 + len(head), 4 + len(head) + len(key))


def test_rest_of_a_key_beside_a_base_finding(net):
    head, tail = "QZ7RTY2MKX0VBN4CLW7JHD5S", "0123456789abcdef01234567"
    assert covered(net, "key: " + head + tail + " end", 5, 5 + len(head) + len(tail))
    text = "key: " + head[:10] + tail
    assert secrets.candidates(text, secrets.base(text)) == [(5, 15, 5, len(text))]


def test_threshold_keeps_recall_below_any_floor():
    """Overlapping classes: the secrets kept in the validation part are RECALL at least, and scores are frequencies."""
    r = np.random.default_rng(2)
    y = (r.random(1500) < 0.4).astype(float)
    codes = r.integers(2, 40, (1500, secrets.WIDTH)).astype(np.int32)
    codes[(y == 1) & (r.random(1500) < 0.6), 30:36] = 60
    net = secrets.fit(codes, y, rounds=3)
    held = np.arange(1500) % 5 == 4
    s = net.scores(codes[held])
    assert (s[y[held] == 1] >= net.threshold).mean() >= secrets.RECALL and net.threshold < 0.9
    assert net.recall >= secrets.RECALL and abs(s.mean() - y[held].mean()) < 0.05


@pytest.mark.parametrize("left_out", [(0, 9), (2,), (3,), (4, 5), (6,), (7,), (8,)])
def test_recall_on_key_formats_never_seen(left_out):
    """Whole formats are held out of training; nine in ten of their keys are found at the threshold."""
    rows = secrets.made(without=left_out)
    net = secrets.fit(np.array([secrets.encode(t, a, z) for t, a, z, _ in rows], np.int32), np.array([y for *_, y in rows], float))
    other = [(t, a, z) for t, a, z, y in secrets.made(300, seed=78, only=left_out) if y]
    found = np.mean([any(s <= a and z <= e for s, _, e, _ in secrets._scan_texts([t], net)[0]) for t, a, z in other])
    assert found >= 0.9
