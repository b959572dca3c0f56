import random

import pytest

from evidence_spark.operators import timeline


def plain(risks):
    """All paths by walking from every event."""
    out = {}
    for a in range(len(risks)):
        high = risks[a]
        for b in range(a + 1, len(risks)):
            high = max(high, risks[b])
            out[f"event-{a}", f"event-{b}"] = (b - a, high)
    return out


def ranked(spark, risks):
    rows = [(100 * i, i, None if r == 0 and i % 2 else r) for i, r in enumerate(risks)]
    return timeline.ranked_events(spark.createDataFrame(rows, "event_us long, sequence long, risk double"), ["event_us", "sequence"])


@pytest.mark.parametrize("size", [0, 1, 2, 9, 40])
def test_paths_equal_a_plain_walk(spark, monkeypatch, size):
    monkeypatch.setattr(timeline, "BLOCK", 4)
    rng = random.Random(size)
    risks = [float(rng.randrange(12)) for _ in range(size)]
    table, want = ranked(spark, risks), plain(risks)
    got = timeline.paths_from(table.filter("rank % 3 = 1").select("rank", "id"), timeline.risk_index(table)).collect()
    assert {(r.source, r.target): (r.length, r.risk) for r in got} == {k: v for k, v in want.items() if int(k[0][6:]) % 3 == 0}
    assert len(got) == len({(r.source, r.target) for r in got})
    best = [(r.source, r.target, r.length, r.risk) for r in timeline.best_paths(table, 10).collect()]
    order = sorted(((*k, *v) for k, v in want.items()), key=lambda p: (-p[3], p[2], p[0], p[1]))
    assert best == order[:10]
