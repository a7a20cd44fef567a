"""Every query on the smallest tables against its SQL."""

import pytest

from darkroom.plans import catalogue
from tests.comparing import connect, same

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


#: Queries that SQL does not express; each has a test of its own below.
PLAIN = {"duplicate_groups", "sequential_chapters", "cleaning_pipeline", "cleaning_queue"}


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - PLAIN))
def test_query(spark, con, name):
    same(catalogue.queries()[name](spark, SF), con, catalogue.oracle_sql()[name])


def linked_groups(photos, edges, most=64):
    """Complete-link groups of one album by plain merging: {photo: group}. edges: (kind, hamming, a, b) of related pairs."""
    groups = {}
    for i, sha in photos.items():
        groups.setdefault(("sha", sha) if sha is not None else ("id", i), set()).add(i)
    groups = list(groups.values())
    related = {(a, b) for _, _, a, b in edges}
    find = lambda i: next(g for g in groups if i in g)
    for _, _, a, b in sorted(edges):
        x, y = find(a), find(b)
        if x is not y and len(x) + len(y) <= most and all((min(i, j), max(i, j)) in related for i in x for j in y):
            groups.remove(y)
            x |= y
    return {i: min(g) for g in groups if len(g) > 1 for i in g}


def test_duplicate_groups(spark):
    from darkroom.operators import duplicates
    from darkroom.plans.analogs import embedded
    from darkroom.plans.cleaning import WIDE_BURST, WIDE_NEAR

    rows = embedded(spark, SF).cache()
    pairs = duplicates.relations(duplicates.candidates(rows), rows, WIDE_NEAR, WIDE_BURST).where("relation IS NOT NULL").collect()
    want = {}
    for album in {r.album_id for r in rows.select("album_id").collect()}:
        photos = {r.photo_id: r.sha for r in rows.where(rows.album_id == album).collect()}
        edges = [({"exact": 0, "near": 1, "burst": 2}[p.relation], p.hamming, p.a, p.b) for p in pairs if p.album_id == album]
        want |= {(album, i): g for i, g in linked_groups(photos, edges).items()}
    got = {(r.album_id, r.photo_id): r.group_id for r in catalogue.queries()["duplicate_groups"](spark, SF).collect()}
    assert got == want and got
    rows.unpersist()


def test_cleaning_queries(spark):
    """The chain's outcome from the groups and ranks that other queries check, decided row by row."""
    from darkroom.plans import lifecycles

    c = lifecycles._clean(spark, SF)
    members = {(r.album_id, r.photo_id): r for r in c.members.collect()}
    photos = {(r.album_id, r.photo_id): r for r in c.photos.collect()}
    got = {(r.album_id, r.photo_id): r for r in catalogue.queries()["cleaning_pipeline"](spark, SF).collect()}
    assert set(got) == set(photos)
    pending = {}
    for k, r in got.items():
        m, reject = members.get(k), k[1] % 31 == 0
        if m is not None:
            close = m.relation == "near" and m.hamming <= 4 and (m.histogram_distance or 1.0) <= 0.10
            want = "review" if reject else "keep" if m.rank == 1 else "remove" if m.exact_rank > 1 or close else "review"
            assert r.suggestion == want
            assert r.exclusion == ("system_exact_duplicate" if m.rank > 1 and m.exact_rank > 1 else None)
        elif reject:
            assert r.suggestion == "review" and r.exclusion is None
        if r.exclusion:
            assert r.decision is not None
        pending[k] = r.decision is None and r.suggestion in ("review", "remove")
    queue = catalogue.queries()["cleaning_queue"](spark, SF).collect()
    asked = {(r.album_id, r.item) for r in queue}
    assert len(asked) == len(queue)
    want = {(a, f"group:{m.group_id}") for (a, i), m in members.items() if pending[a, i]}
    grouped = {k for k, m in members.items() if (k[0], f"group:{m.group_id}") in want}
    assert asked == want | {(a, f"photo:{i}") for (a, i), p in pending.items() if p and (a, i) not in grouped}


def test_sequential_chapters(spark):
    """Chapters of every album are contiguous in its order of time, numbered from 1, and as good as the best partition of so many parts."""
    import numpy as np

    from darkroom.operators import timeline
    from darkroom.plans.analogs import embedded

    rows = embedded(spark, SF).toPandas()
    got = catalogue.queries()["sequential_chapters"](spark, SF).toPandas()
    assert sorted(got["photo_id"]) == sorted(rows["photo_id"])
    both = rows.merge(got, on=["album_id", "photo_id"])
    for _, album in both.groupby("album_id"):
        timed = album[album["taken_at"].notna()].sort_values(["taken_at", "photo_id"])
        labels = timed["chapter"].to_numpy() - 1
        assert labels[0] == 0 and set(np.diff(labels)) <= {0, 1} and labels[-1] + 1 == album["chapters"].iloc[0]
        d = timeline.matrix(timeline.channels(*timeline._arrays(timed)), timeline.STRATEGIES["balanced"])
        k, n = labels[-1] + 1, len(d)
        cost = np.full((k + 1, n + 1), np.inf)
        cost[0, 0] = 0
        for p in range(1, k + 1):
            for end in range(1, n + 1):
                cost[p, end] = min(cost[p - 1, s] + d[s:end, s:end].sum() / (2 * (end - s)) for s in range(end))
        mine = sum(d[np.ix_(labels == j, labels == j)].sum() / (2 * (labels == j).sum()) for j in range(k))
        assert mine == pytest.approx(cost[k, n], abs=1e-9)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(catalogue.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
