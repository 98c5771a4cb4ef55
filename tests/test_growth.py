"""Steps that must grow with their tables: results against plain Python, and what their joins make."""

import datetime

from lodestone.operators import facts
from lodestone.operators.access import subjects
from lodestone.operators.index import postings
from lodestone.plans import evaluating
from lodestone.plans.retrieval import merge_islands
from lodestone.plans.reviewing import leaders
from lodestone.sources import tables
from test_seeds import most_rows


def test_subjects_are_counted_and_not_paired(spark):
    kinds = (["all"], ["team"], ["own"], ["own", "team"], [], None)
    people = [(i, i % 3 if i % 7 else None, kinds[i % 6]) for i in range(60)] + [(None, 1, ["team"])]
    others = [(i, i % 3) for i in range(600)] + [(None, 1), (700, None)]
    p, o = spark.createDataFrame(people, "me long, team int, scopes array<string>"), spark.createDataFrame(others, "subject long, team int")
    made = subjects(p, o, "me", "subject", "team")
    want = []
    for me, team, scopes in people:
        seen = [s for s, t in others if s is not None and me is not None and t == team and team is not None and scopes and ("all" in scopes or "team" in scopes or ("own" in scopes and s == me))]
        want.append((me, len(seen)))
    assert sorted(map(repr, map(tuple, made.collect()))) == sorted(map(repr, want))
    assert most_rows(made._jdf.queryExecution().executedPlan()) <= len(people)  # pairs would be some 10,000


def test_a_nations_leaders_are_joined_to_a_text_once(spark, sf_dir):
    made = leaders(spark, sf_dir)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("array_join") > plan.index("Join LeftOuter")  # below the join: for each nation, not for each customer


def test_postings_of_plain_words_leave_stems_out(spark):
    docs = spark.createDataFrame([(1, "b a b"), (2, None), (3, "a")], "id long, text string")
    got = {(r.kind, r.token, r.key, tuple(r.positions)) for r in postings(docs, "id", ("simple",)).collect()}
    assert got == {("simple", "b", 1, (1, 3)), ("simple", "a", 1, (2,)), ("simple", "a", 3, (1,))}


def test_quality_facts_run_over_days_not_over_versions(spark, monkeypatch):
    day = lambda n: datetime.date(2020, 1, 1) + datetime.timedelta(n)
    rows = []
    for i in range(240):
        since = None if i % 29 == 0 else day(i % 12)
        until = None if i % 5 == 0 else day(i % 12 + i % 4)
        rows.append((i, i % 2 if i % 31 else None, None if i % 3 == 0 else "da", ("published", "under_review", "discarded")[i % 7 % 3] if i % 11 < 4 else "under_review", "x", "t", since, until, i % 10 == 0, i % 9))
    schema = "version long, document int, language string, status string, label string, title string, valid_from date, valid_to date, superseded boolean, checksum int"
    sizes, whole = [], facts.carried
    monkeypatch.setattr(facts, "carried", lambda df, *given, **more: sizes.append(df.count()) or whole(df, *given, **more))
    got = {r.version: r for r in facts.quality_facts(spark.createDataFrame(rows, schema), spark.createDataFrame([(1,)], "document int")).collect()}
    assert sizes and max(sizes) <= 3 * 2 * (12 + 3 + 3)  # groups times days, with those of no begin and no end; not four rows a version
    assert len(got) == len(rows)
    for v, doc, lang, status, _, _, since, until, _, checksum in rows:
        g = got[v]
        public = [r for r in rows if r[1:3] == (doc, lang) and r[3] == "published" and r[6] and (not r[7] or r[6] < r[7])]
        others = [r for r in public if r[0] != v]
        assert g.no_grants == (doc != 1)
        assert g.duplicates == sum(r[9] == checksum and r[3] != "discarded" and r[0] != v for r in rows)
        real = since and (not until or since < until)
        assert g.overlaps == (sum((not until or r[6] < until) and (not r[7] or since < r[7]) for r in others) if real else 0)
        before = since and since - datetime.timedelta(1)
        held = lambda d: any(r[6] <= d and (not r[7] or r[7] > d) for r in public)
        assert g.gap_before == (max((r[7] for r in public if r[7] and r[7] < since), default=None) if since and not held(before) else None)
        assert g.gap_after == (min((r[6] for r in public if r[6] > until), default=None) if since and until and not held(until) else None)
        last = max(((r[6], r[0], r[7]) for r in public if since and r[6] <= since), default=None)
        if g.predecessor is not None:
            assert status != "published" and last[1] == g.predecessor and (not last[2] or last[2] > since)


def test_runs_are_told_in_one_sort(spark):
    from lodestone.operators.search import runs

    rows = [(1, "a", n) for n in (3, 1, 2, 2, 2, 7, 8, 10, None, None)] + [(1, None, n) for n in (5, 5)] + [(2, "a", n) for n in (4, 3)]
    made = runs(spark.createDataFrame(rows, "version long, flag string, at int"), ["version", "flag"], "at")
    want = [(1, "a", None, None, 1), (1, "a", 1, 3, 3), (1, "a", 7, 8, 2), (1, "a", 10, 10, 1), (1, None, 5, 5, 1), (2, "a", 3, 4, 2)]
    assert sorted(map(repr, map(tuple, made.collect()))) == sorted(map(repr, want))


def test_merge_islands_sorts_once_and_keeps_no_groups(spark, sf_dir):
    plan = merge_islands(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1 and "Aggregate" not in plan


def shuffled_rows(plan):
    """The rows that an executed plan shuffled; an exchange that is used again counts once."""
    name = plan.nodeName()
    if name.startswith("AdaptiveSparkPlan"):
        return shuffled_rows(plan.executedPlan())
    if name.startswith("Reused"):
        return 0
    if "QueryStage" in name:
        return shuffled_rows(plan.plan())
    own = plan.metrics().get("shuffleRecordsWritten").get().value() if name == "Exchange" else 0
    children = plan.children()
    return own + sum(shuffled_rows(children.apply(i)) for i in range(children.size()))


def test_breaches_shuffle_no_items(spark, sf_dir):
    """Items meet their case in buckets, and what the facit has of documents is small: a rule shuffles no items."""
    # Joins as with large tables: nothing goes to every task but what is known to be small.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines, orders = evaluating._stored(spark, sf_dir, whole=False)
        made = evaluating._breaches(spark, sf_dir, lines, orders)
        made.collect()
        moved, items = shuffled_rows(made._jdf.queryExecution().executedPlan()), lines.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert moved <= 3 * items  # marks told by a text once, and small tables; case_breaches as a whole moved 34 rows an item before, 5.5 after, at 4 x sf0.1


def test_observations_shuffle_nothing(spark, sf_dir):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines, orders = evaluating._stored(spark, sf_dir)
        made = evaluating.ob.observations(evaluating._items(lines), evaluating._facit(spark, sf_dir, lines, orders))
        n = made.count()
        plan = made._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert n == orders.count() and "Exchange" not in plan


def test_only_small_tables_go_to_every_task(spark, monkeypatch):
    df = spark.createDataFrame([("a" * 100, i) for i in range(50)] + [(None, None)], "a string, n int")
    join = lambda: spark.range(5).withColumnRenamed("id", "n").join(tables.few(df), "n")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in join()
    monkeypatch.setattr(tables, "FEW", 6000)
    assert "broadcast" not in join()
    assert tables.few(df.limit(0)).count() == 0 and sorted(map(repr, tables.few(df).collect())) == sorted(map(repr, df.collect()))
