"""Stateful streams of links against a plain walk over the log: any order and batches, late rows, restarts, silence."""

import json
import os
import random
from datetime import datetime, timedelta, timezone

import pytest

from weft.streaming import changes, links

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
LATE, SILENCE = 600, 3000


def put(place, k, log):
    """A file of changes, newer than those before it: files are taken by their times."""
    file = place / f"{k:03d}.json"
    file.write_text("".join(json.dumps({"ts": None if t is None else (START + timedelta(seconds=t)).isoformat(), "op": op, "a_gid": a, "b_gid": b}) + "\n" for t, op, a, b in log))
    os.utime(file, (1_700_000_000 + 10 * k,) * 2)


def stream(spark, place):
    return spark.readStream.schema(changes.CHANGES).option("maxFilesPerTrigger", 1).json(str(place))


def moved(spark, place, path):
    told = links.table_of(links.moves(stream(spark, place), SILENCE, f"{LATE} seconds", "10 seconds"), str(path))
    return sorted((r["a_gid"], r["b_gid"], r["s"], r["change"], r["why"]) for r in told.selectExpr("*", f"unix_seconds(moment) - {int(START.timestamp())} as s").collect())


def walked(log):
    """What a walk over the sorted log tells, up to the newest change less the lateness."""
    log = [x for x in log if None not in x and x[2] != x[3] and x[1] in ("add", "remove")]
    upto = max(x[0] for x in log) - LATE
    grains = {}
    for t, op, a, b in sorted(log):
        grains.setdefault((min(a, b), max(a, b)), {})[t // 10 * 10 + 10] = op
    out = []
    for pair, ops in grains.items():
        since = None
        for at, op in [*sorted(x for x in ops.items() if x[0] <= upto), (upto, None)]:
            if since is not None and at >= since + SILENCE:
                out.append((*pair, since + SILENCE, -1, "silent"))
                since = None
            if op == "add" and since is None:
                out.append((*pair, at, 1, "add"))
            if op == "remove" and since is not None:
                out.append((*pair, at, -1, "remove"))
            since = {"add": at, "remove": None, None: since}[op]
    return sorted(out)


def made(seed, n=400):
    """A log over some hours, each change up to five minutes from its place; one pair has a third of all."""
    r = random.Random(seed)
    pair = lambda: ("hub", "h2") if r.random() < 0.33 else r.choice([("hub", r.choice("abcdef")), tuple(r.sample("abcdef", 2)), ("a", "a")])
    log = [(60 * k + r.randrange(300) + 1, r.choice(["add", "add", "remove", "touch", None] if r.random() < 0.2 else ["add", "add", "remove"]), *pair()) for k in range(n)]
    return [*log, (None, "add", "a", "b"), (5000, "add", None, "b"), *log[:5]]  # repeated rows come at once, below


def test_moves_and_degrees_equal_a_walk(spark, tmp_path):
    log = made(3)
    one, many = tmp_path / "one", tmp_path / "many"
    one.mkdir(), many.mkdir()
    put(one, 0, random.Random(1).sample(log, len(log)))
    cuts = [0, 5, 120, 290, len(log)]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        put(many, k, (log[:5] if not k else []) + [x for x in log[a:b] if x not in log[:5] or not k])
    want = walked(log)
    assert {w[-1] for w in want} == {"add", "remove", "silent"}
    assert moved(spark, one, tmp_path / "p1") == want
    assert moved(spark, many, tmp_path / "p2") == want
    told = spark.read.parquet(str(tmp_path / "p2" / "rows"))
    degree = {}
    for a, b, _, change, _ in want:
        degree[a], degree[b] = degree.get(a, 0) + change, degree.get(b, 0) + change
    got = {r["gid"]: r for r in links.live_nodes(told).collect()}
    assert {g: r["degree"] for g, r in got.items()} == degree
    last = max((s, b if a == "hub" else a) for a, b, s, change, _ in want if change == 1 and "hub" in (a, b))
    assert (int(got["hub"]["last_at"].replace(tzinfo=timezone.utc).timestamp() - START.timestamp()), got["hub"]["last_gid"]) == last


def test_silence_restart_and_a_batch_run_twice(spark, tmp_path):
    place, path = tmp_path / "in", tmp_path / "p"
    place.mkdir()
    put(place, 0, [(5, "add", "a", "b"), (7, "add", "c", "b"), (1000, "add", "b", "a")])
    assert moved(spark, place, path) == [("a", "b", 10, 1, "add"), ("b", "c", 10, 1, "add")]
    put(place, 1, [(3700, "add", "x", "y")])  # the pair b, c is silent since 3010; a, b was added again
    first = moved(spark, place, path)
    assert ("b", "c", 3010, -1, "silent") in first and all(x[:2] != ("a", "b") or x[3] == 1 for x in first)
    put(place, 2, [(100, "remove", "a", "b"), (3650, "remove", "b", "a")])  # the first is too late
    put(place, 3, [(9000, "add", "x", "z")])
    whole = moved(spark, place, path)
    assert [x for x in whole if x[:2] == ("a", "b")] == [("a", "b", 10, 1, "add"), ("a", "b", 3660, -1, "remove")]
    assert ("x", "y", 6710, -1, "silent") in whole and len(whole) == len(set(whole))
    commits = path / "checkpoint" / "commits"
    newest = max((f for f in os.listdir(commits) if f.isdigit()), key=int)
    for f in (newest, f".{newest}.crc"):  # as if the driver had died before it noted the batch as done
        if (commits / f).exists():
            (commits / f).unlink()
    assert moved(spark, place, path) == whole


def test_nothing_came(spark, tmp_path):
    (tmp_path / "in").mkdir()
    assert moved(spark, tmp_path / "in", tmp_path / "p") == []
    assert links.live_nodes(spark.createDataFrame([], links.MOVES)).count() == 0


@pytest.mark.parametrize("files", [1, 4])
def test_sessions_equal_a_walk(spark, tmp_path, files):
    log = [x for x in made(8, 250) if x[0] is None or x[0] % 7]
    place = tmp_path / "in"
    place.mkdir()
    timed = sorted((x for x in log if x[0] is not None), key=lambda x: x[0])
    for k in range(files):
        put(place, k, timed[len(timed) * k // files: len(timed) * (k + 1) // files] + [x for x in log if x[0] is None])
    told = links.table_of(links.sessions(stream(spark, place), "200 seconds", f"{LATE} seconds"), str(tmp_path / "p"))
    got = sorted((r["gid"], r["b"], r["e"], r["n"]) for r in told.selectExpr("gid", f"unix_seconds(began) - {int(START.timestamp())} as b", f"unix_seconds(ended) - {int(START.timestamp())} as e", "n").collect())
    upto = max(t for t, *_ in timed) - LATE
    times, want = {}, []
    for t, _, a, b in timed:
        for g in {a, b} - {None}:
            times.setdefault(g, []).append(t)
    for g, ts in times.items():
        run = [ts[0]]
        for t in [*ts[1:], None]:
            if t is None or t - run[-1] >= 200:
                want += [(g, run[0], run[-1], len(run))] if run[-1] + 1 + 200 <= upto else []
                run = []
            run.append(t)
    assert got == sorted(want) and len(got) > 10


def test_a_replayed_table_loses_nothing_in_any_files(spark, tmp_path):
    """Twelve files that all span the whole time, the newest dated first."""
    log = sorted((x for x in made(9, 250) if x[0] is not None), key=lambda x: x[0])
    place = tmp_path / "in"
    place.mkdir()
    for k in range(12):
        put(place, 12 - k, log[k::12])
    table = spark.read.schema(changes.CHANGES).json(str(place))
    told = [links.table_of(links.sessions(changes.replayed(table, "ts", str(tmp_path / p), rows), "200 seconds", f"{LATE} seconds"), str(tmp_path / f"told-{p}")) for p, rows in (("one", 10**6), ("many", 20))]
    one, many = (sorted(map(tuple, t.collect())) for t in told)
    assert one == many and len(one) > 10
    files = sorted((tmp_path / "many" / "log").glob("part-*"))
    assert len(files) > 10 and [f.stat().st_mtime for f in files] == sorted(f.stat().st_mtime for f in files)


def test_sessions_end_at_a_gap_of_exactly_that_length(spark, tmp_path):
    """Changes whose grains end exactly the gap apart are two runs; a second less is one."""
    place = tmp_path / "in"
    place.mkdir()
    put(place, 0, [(5, "add", "a", "b"), (205, "add", "a", "c"), (404, "add", "a", "d"), (9000, "add", "y", "z")])
    told = links.table_of(links.sessions(stream(spark, place), "200 seconds", f"{LATE} seconds"), str(tmp_path / "p"))
    assert sorted(r["n"] for r in told.where("gid = 'a'").collect()) == [1, 2]
