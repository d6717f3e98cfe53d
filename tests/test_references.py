"""Orphan references against a plain look-up, with nulls, ties, copies, hot keys and extra columns."""

import datetime as dt
import random

from duelframe.operators import references as R

T0 = dt.datetime(2024, 1, 1)
SLOT = "battle_id string, player_side string, slot_no smallint, loaded_at timestamp_ntz, note string"
PLAYER = "battle_id string, username string, side string, loaded_at timestamp_ntz, k1 string"
BATTLE = "battle_id string, loaded_at timestamp_ntz, deleted_at timestamp_ntz, target string"
USER = "username string, loaded_at timestamp_ntz, deleted_at timestamp_ntz"


def at(h):
    return None if h is None else T0 + dt.timedelta(hours=h)


def plain(slots, players, battles, users):
    k = lambda s: (s or "").strip().lower() or None

    def judge(records, t):
        if not records:
            return "missing"
        if t is None or any(a is not None and a <= t and (d is None or t < d) for a, d in records):
            return None
        return "late" if not any(a is not None and a <= t for a, _ in records) else "deleted"

    out = set()
    month = lambda t: t and t.strftime("%Y-%m")
    for b, s, n, t, _ in slots:
        if k(b):
            out.add(("battle_team_slot", "battle_id", month(t), b, s, n, judge([(x[1], x[2]) for x in battles if k(x[0]) == k(b)], t)))
            if k(s):
                out.add(("battle_team_slot", "player_side", month(t), b, s, n, judge([(x[3], None) for x in players if k(x[0]) == k(b) and k(x[2]) == k(s)], t)))
    for b, u, s, t, _ in players:
        if k(u):
            out.add(("battle_players", "username", month(t), b, s, 0, judge([(x[1], x[2]) for x in users if k(x[0]) == k(u)], t)))
    return {r for r in out if r[-1]}


def run(spark, slots, players, battles, users, **kw):
    df = R.contest_orphans(spark.createDataFrame(slots, SLOT), spark.createDataFrame(players, PLAYER), spark.createDataFrame(battles, BATTLE), spark.createDataFrame(users, USER), **kw)
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_random_tables_in_one_and_two_levels(spark):
    rnd = random.Random(3)
    ids = ["A-1", " a-1 ", "b-2", "C-3", "", " ", None, "hot"]
    hour = lambda: rnd.choice([None, *range(0, 2000, 37)])
    slots = [(rnd.choice(ids + ["hot"] * 4), rnd.choice(["p1", "P2 ", "p9", None, ""]), rnd.choice([1, 2, None]), at(hour()), "x") for _ in range(150)]
    players = [(rnd.choice(ids + ["hot"] * 4), rnd.choice(["Ann", "ann ", "bo", None, " "]), rnd.choice(["p1", "p2", None]), at(hour()), "y") for _ in range(40)]
    battles = [(rnd.choice(ids), at(hour()), at(hour()), "z") for _ in range(14)]
    users = [(rnd.choice(["ANN", "bo", None]), at(hour()), at(hour())) for _ in range(4)]
    want = plain(slots, players, battles, users)
    assert run(spark, slots + slots[:20], players, battles + battles[:3], users) == want
    assert run(spark, slots, players, battles, users, hot_rows=5) == want
    assert run(spark, slots, players, battles, users, hot_rows=1, most_hot=1) == want  # every key is split


def test_equal_times_and_empty_tables(spark):
    assert run(spark, [("a", "p1", 1, at(5), None)], [("A", "u", "p1", at(5), None)], [("a", at(5), None, None)], [("u", at(1), at(5))]) == {("battle_players", "username", "2024-01", "A", "p1", 0, "deleted")}
    assert run(spark, [], [], [], []) == set()
    assert run(spark, [("a", None, None, None, None)], [], [], []) == {("battle_team_slot", "battle_id", None, "a", None, None, "missing")}


def test_a_ledger_judges_a_batch_without_the_rows_of_earlier_ones(spark, tmp_path):
    rnd = random.Random(8)
    ids = ["a", "b", "C ", "d", "e", "f"]
    hour = lambda: rnd.randrange(0, 2000)
    slots = [(rnd.choice(ids), rnd.choice(["p1", "p2"]), rnd.choice([1, 2]), at(hour()), "x") for _ in range(120)]
    user_of = {(b, s): rnd.choice(["ann", "bo", "cy"]) for b in ids for s in ("p1", "p2")}
    players = [(b, user_of[b, s], s, at(hour()), "y") for b, s in (rnd.choice(list(user_of)) for _ in range(40))]
    battles = [(rnd.choice(ids[:4]), at(hour()), at(hour()) if rnd.random() < 0.5 else None, "z") for _ in range(7)]
    users = [("ann", at(hour()), None), ("bo", at(1500), at(1700))]
    frames = [spark.createDataFrame(r, c) for r, c in ((slots, SLOT), (players, PLAYER), (battles, BATTLE), (users, USER))]
    deltas = R.contest_deltas(*frames).persist()
    want = {tuple(r) for r in R.contest_orphans(*frames).collect()}
    cut = int((T0 + dt.timedelta(hours=1000)).replace(tzinfo=dt.timezone.utc).timestamp() * 1_000_000)
    folder = str(tmp_path / "ledger")
    got = {tuple(r) for r in R.orphan_rows(R.ReferenceLedger(spark, folder).advance(deltas.where(f"at < {cut}"), "1")).collect()}
    ledger = R.ReferenceLedger(spark, folder)  # opened again: only the new deltas and the kept sums are read
    for _ in range(2):  # a batch that is repeated replaces itself
        second = {tuple(r) for r in R.orphan_rows(ledger.advance(deltas.where(f"at >= {cut}"), "2", hot=None)).collect()}
    late = {(r.level, r.space, r.k1, r.k2) for r in ledger.settled("2").collect()}
    k = lambda s: s.strip().lower()
    def settled(row):
        table, field, period, battle, side, _, reason = row
        if reason != "missing":
            return row
        if table == "battle_players":
            name = ("a", "user", user_of[battle, side], None)
        else:
            name = ("a", "battle", k(battle), None) if field == "battle_id" else ("b", "battle", k(battle), k(side))
        return (*row[:-1], "late") if name in late else row

    assert {settled(r) for r in got} | second == want and any(r[-1] == "late" for r in want)
    whole = R.ReferenceLedger(spark, str(tmp_path / "whole"))
    whole.advance(deltas, "all")
    rows = lambda l: {tuple(r) for r in l.orphans().collect()}
    assert rows(ledger) == rows(whole) and rows(whole)
