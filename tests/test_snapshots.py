from __future__ import annotations

import random

from marketloom.operators import snapshots
from marketloom.operators.snapshots import snapshot_changes

SCHEMA = "no int, key string, h string, value double, bucket string"


def brute(rows):
    snaps: dict = {}
    for no, e, m, odds, _ in rows:
        if no is not None:
            old = snaps.setdefault(no, {}).get((e, m), (odds,))
            snaps[no][e, m] = min([old[0], odds], key=lambda x: (x is not None, x or 0)) if old else odds
            snaps[no][e, m] = (snaps[no][e, m],)
    out, numbers = set(), sorted(snaps)
    for a, b in zip(numbers, numbers[1:], strict=False):
        for k in snaps[a].keys() | snaps[b].keys():
            kind = "added" if k not in snaps[a] else "removed" if k not in snaps[b] else "changed" if snaps[a][k] != snaps[b][k] else None
            if kind:
                out.add((a, b, *k, kind))
    return out


def found(spark, rows):
    got = snapshot_changes(spark.createDataFrame(rows, SCHEMA), "no", ["key", "h"], "value").collect()
    assert len(got) == len({tuple(r) for r in got})
    return {tuple(r) for r in got}


def test_against_brute_force_with_a_hot_event(spark, monkeypatch):
    monkeypatch.setattr(snapshots, "CHUNK_ROWS", 4)
    rng = random.Random(3)
    rows = []
    for no in (3, 4, 9):
        for i in range(400):
            if rng.random() < 0.9:
                event = "hot" if i % 3 == 0 else f"e{i % 40}"
                rows.append((no, event, f"m{i}", None if rng.random() < 0.1 else 1.5 if rng.random() < 0.9 else float(no), "x"))
    rows += rows[:50]
    assert found(spark, rows) == brute(rows)


def test_nulls_ties_single_and_empty(spark):
    rows = [(1, None, "m", 2.0, None), (2, None, "m", None, None), (2, "e", None, 1.0, None), (None, "e", "m", 1.0, None), (2, "e", None, 3.0, None)]
    assert found(spark, rows) == {(1, 2, None, "m", "changed"), (1, 2, "e", None, "added")}
    assert found(spark, [(1, "e", "m", 2.0, None)]) == set()
    assert found(spark, [(None, "e", "m", 2.0, None)]) == set()


def test_many_snapshots_are_numbered_in_ranges(spark, monkeypatch):
    rows = [(no, "e", f"m{i}", float((no * i) % 3), None) for no in range(1, 30, 2) for i in range(6) if (no + i) % 4]
    monkeypatch.setattr(snapshots, "BROADCAST_SNAPSHOTS", 3)
    assert found(spark, rows) == brute(rows)
