"""Publishers that share nothing but a folder."""

from concurrent.futures import ThreadPoolExecutor

import pytest

from tallyforge.sources import artifacts, coordination


class Clock:
    now = 1000.0

    def __call__(self):
        return self.now


@pytest.fixture()
def root(tmp_path):
    return f"file://{tmp_path}/r"


def package(spark, root, run_id):
    artifacts.write_package({"nodes": spark.createDataFrame([(run_id,)], "v string")}, root, run_id)


def at_once(tasks):
    def tried(task):
        try:
            return task()
        except (artifacts.Invalid, coordination.Lost) as error:
            return error

    with ThreadPoolExecutor(len(tasks)) as pool:
        return list(pool.map(tried, tasks))


def test_a_file_is_made_once(spark, root):
    made = at_once([lambda i=i: (i, coordination.create_exclusively(spark, f"{root}/x.json", b"%d" % i)) for i in range(16)])
    winners = [i for i, ok in made if ok]
    assert len(winners) == 1 and coordination.read_small(spark, f"{root}/x.json") == b"%d" % winners[0]


def test_of_publishers_with_one_expectation_one_wins(spark, root):
    names = [f"v{i}" for i in range(6)]
    for name in names:
        package(spark, root, name)
    for expected in (None, "next"):
        expected = expected and artifacts.pointer(spark, root)["current"]
        found = at_once([lambda n=n, e=expected: artifacts.promote(spark, root, n, e) for n in names])
        won = [x["current"] for x in found if isinstance(x, dict)]
        assert len(won) == 1 and artifacts.pointer(spark, root) == {"current": won[0], "previous": expected}
        assert all(isinstance(x, (dict, artifacts.Invalid)) for x in found)


def test_one_owner_holds_a_lease(spark, root):
    clock = Clock()
    take = lambda who: coordination.acquire(spark, f"{root}/lease", who, 60, clock)
    found = at_once([lambda w=w: take(w) for w in "abcdef"])
    held = [x for x in found if isinstance(x, coordination.Lease)]
    assert len(held) == 1 and sum(isinstance(x, coordination.Lost) for x in found) == 5
    first = held[0]
    with pytest.raises(coordination.Lost):
        take("z")
    clock.now += 50
    first.renew()
    clock.now += 50
    first.check()
    again = take(first.owner)  # the same owner replaces its own lease
    with pytest.raises(coordination.Lost):
        first.check()
    again.release()
    with pytest.raises(coordination.Lost):
        again.check()
    later = take("z")
    assert (first.number, again.number, later.number) == (1, 2, 3)
    clock.now += 61
    with pytest.raises(coordination.Lost):
        later.renew()


def test_a_stale_holder_fails_whatever_its_clock_says(spark, root):
    for name in ("v1", "v2", "v3"):
        package(spark, root, name)
    clock, slow = Clock(), Clock()
    a = coordination.acquire(spark, f"{root}/lease", "a", 60, slow)
    artifacts.promote(spark, root, "v1", None, a)
    clock.now += 100
    b = coordination.acquire(spark, f"{root}/lease", "b", 60, clock)
    with pytest.raises(coordination.Lost):
        artifacts.promote(spark, root, "v2", "v1", a)  # its own clock has not moved
    generation, seen = artifacts._pointed(spark, root)  # a has checked all, then stands still
    artifacts.promote(spark, root, "v2", "v1", b)
    assert not artifacts._moved(spark, root, generation, {**seen, "current": "v3"})
    a.check = lambda: None  # even a holder that does not look
    with pytest.raises(artifacts.Invalid):
        artifacts.promote(spark, root, "v3", "v2", a)
    assert artifacts.pointer(spark, root) == {"current": "v2", "previous": "v1"}


def test_between_taking_over_and_publishing_a_stale_holder_cannot_slip_in(spark, root, monkeypatch):
    """The new holder's fencing number is in the pointer before it reads the package; what the old one saw before is void."""
    for name in ("v1", "v2"):
        package(spark, root, name)
    clock = Clock()
    coordination.acquire(spark, f"{root}/lease", "a", 60, clock)
    generation, seen = artifacts._pointed(spark, root)
    clock.now += 100
    b = coordination.acquire(spark, f"{root}/lease", "b", 60, clock)
    read, stale = artifacts.read_package, []
    monkeypatch.setattr(artifacts, "read_package", lambda *x: stale.append(artifacts._moved(spark, root, generation, {**seen, "current": "v1"})) or read(*x))
    assert artifacts.promote(spark, root, "v2", None, b)["current"] == "v2" and stale == [False]


def test_old_generations_go(spark, root, monkeypatch):
    monkeypatch.setattr(artifacts, "GENERATIONS", 2)
    package(spark, root, "v1")
    for i in range(5):
        artifacts.promote(spark, root, "v1", "v1" if i else None)
    assert coordination.numbered(spark, f"{root}/pointers") == [4, 5]
