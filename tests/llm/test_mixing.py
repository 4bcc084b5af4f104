from fractions import Fraction

import pytest

from regimeflow.llm import mixing
from regimeflow.llm.mixing import allot, budgets, build, mixture, shares, sized, whole_tokens

SCHEMA = "doc_id bigint, name string, lang string, n_tokens bigint"


def test_shortages_go_to_siblings_before_ancestors():
    tree = build([(("a", "x"), 0.3, 10, 10.0), (("a", "y"), 0.2, 1000, 1000.0), (("b", "z"), 0.5, 1000, 1000.0)])
    assert allot(tree, 100.0) == 0
    a, b = tree.children["a"], tree.children["b"]
    assert (a.children["x"].budget, a.children["y"].budget, b.budget) == (10.0, pytest.approx(40.0), pytest.approx(50.0))
    tree = build([(("a", "x"), 0.3, 10, 10.0), (("a", "y"), 0.2, 15, 15.0), (("b", "z"), 0.5, 1000, 1000.0)])
    assert allot(tree, 100.0) == 0 and tree.children["b"].budget == pytest.approx(75.0)
    assert allot(build([(("a",), 1.0, 5, 5.0)]), 8.0) == 3.0
    assert allot(build([(("a",), 0.0, 5, 5.0)]), 8.0) == 8.0


def test_mixture_keeps_caps_and_reports_shares(spark):
    rows = [(i, "listserv", "en", 10 + i % 7) for i in range(3000)] + [(10_000 + i, "lab notes", "de", 20) for i in range(200)]
    rows += [(20_000, "field notes", "fr", 500), (20_001, None, "en", 900), (20_002, "other thing", "en", 900), (20_003, "lab notes", "de", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    sources = [dict(source=s, name=s, share=w, repeats=r) for s, w, r in (("listserv", 0.5, 1), ("lab notes", 0.3, 4), ("field notes", 0.1, 2), ("board mail", 0.1, 5))]
    for s in sources:
        s["domain"] = s["source"].split(" ")[-1]
    leaves, total = budgets(df, sources)
    assert total == sum(r[3] for r in rows)
    got = mixture(df, leaves)
    uses = {r.doc_id: r.uses for r in got.collect()}
    size = {r[0]: r[3] for r in rows}
    assert set(uses) == {r[0] for r in rows if r[1] in {"listserv", "lab notes", "field notes"}}
    by = {r.source: r for r in shares(got, leaves).collect()}
    for x in leaves:
        own = [r[0] for r in rows if r[1] == x["name"] and r[2] == x["lang"]]
        used = sum(uses[i] * size[i] for i in own)
        assert all(uses[i] <= x["repeats"] for i in own)
        assert x["budget"] - 20 < used <= x["budget"] + 20 or not own
    used, allotted = sum(uses[i] * size[i] for i in uses), sum(x["budget"] for x in leaves)
    assert allotted - 20 < used <= allotted
    assert [s for s, r in sorted(by.items()) if r.misses] == ["board mail", "field notes"]
    assert sum(r.actual_share for r in by.values()) == pytest.approx(1)
    assert mixture(df, leaves).exceptAll(got).count() == 0


def test_no_documents(spark):
    df = spark.createDataFrame([], SCHEMA)
    leaves, total = budgets(df, [dict(source="a", name="a", domain="a", share=1.0, repeats=2)])
    got = mixture(df, leaves)
    assert got.count() == 0 and total == 0
    assert [(r.tokens, r.used, r.actual_share, r.misses) for r in shares(got, leaves).collect()] == [(0, 0, 0.0, False)]


def test_budgets_are_whole_and_exact_at_caps():
    assert whole_tokens([Fraction(7, 2), Fraction(9, 4), Fraction(5, 4), Fraction(4)]) == [4, 2, 1, 4]
    third = 1 / 3
    leaves = [(("d", "l", "a"), 0.12 * third, 3683, 2 * 3683), (("d", "l", "b"), 0.12 * (1 - third), 3810, 2 * 3810), (("d", "m", "c"), 0.88, 10**9, 10**9)]
    tree = build(leaves)
    assert allot(tree, 590_447) == 0
    d = tree.children["d"]
    assert d.children["l"].children["a"].budget == 7366 and d.children["l"].children["b"].budget == 7620 and d.budget == 590_447


def test_remainders_go_to_siblings_and_less_than_a_mail_is_lost(spark):
    """Long mails and small budgets; the prefix of each leaf against a plain walk through the seeded order."""
    rows = [(i, name, lang, 50 + (i * 37) % 400) for i, (name, lang) in enumerate([("a x", "en"), ("b x", "en"), ("c y", "de"), ("d y", "de")] * 60)]
    rows += [(5, "a x", "en", 70)]  # an id that comes twice
    df = spark.createDataFrame(rows, SCHEMA)
    sources = [dict(source=n, name=n, domain=n[-1], share=0.25, repeats=3) for n in ("a x", "b x", "c y", "d y")]
    leaves, total = budgets(df, sources)
    plan = mixing.cuts(df, leaves)
    assert 0 <= sum(x["budget"] for x in leaves) - sum(x["planned"] for x in plan) < 450
    got = mixture(df, leaves)
    used = {r[0]: r[1] for r in got.groupBy("source").agg({"n_tokens": "sum"}).collect()}
    by = {r.source: r for r in shares(got, leaves).collect()}
    assert {s: r.used for s, r in by.items()} == {x["source"]: x["planned"] for x in plan} and set(used) == set(by)


def test_crowded_bins_are_cut_again(spark, monkeypatch):
    rows = [(i, "a", "en", 1 + i % 3) for i in range(3000)] + [(9000 + i, "b", "en", 2) for i in range(900)]
    df = spark.createDataFrame(rows, SCHEMA)
    sources = [dict(source=n, name=n, domain=n, share=s, repeats=2) for n, s in (("a", 0.6), ("b", 0.4))]
    leaves, _ = budgets(df, sources)
    want = mixing.cuts(df, leaves)
    monkeypatch.setattr(mixing, "BIN_BITS", 4)
    monkeypatch.setattr(mixing, "BIN_ROWS", 3)
    assert mixing.cuts(df, leaves) == want


def test_domains_come_from_the_weights_or_the_last_word(spark):
    documents = spark.createDataFrame([(1, "x", "en", "Lab-Notes "), (None, "y", None, None)], "doc_id bigint, text string, lang string, source string")
    weights = spark.createDataFrame([("lab_notes", 0.5, 2, None), ("Lab notes", 0.1, 1, None), ("listserv", None, None, " Lists")], "source string, target_share double, max_repeats int, domain string")
    rows, sources = sized(documents, weights)
    assert [(s["source"], s["name"], s["domain"], s["share"], s["repeats"]) for s in sources] == [("Lab notes", "lab notes", "notes", 0.1, 1), ("listserv", "listserv", "lists", 0.0, 0)]
    assert rows.count() == 2 and sized(documents, weights.drop("domain"))[1][1]["domain"] == "listserv"
