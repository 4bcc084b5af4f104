"""Problem 7: mix sources to target weights, by hierarchical budgeting.

The leaves of a tree (domain, language, source) have a weight, the tokens they hold and a cap: `max_repeats` times
these tokens. A node's budget goes to its children by weight; what a child can't take goes to its siblings that still
have room, by weight, and only what all of them can't take goes back to the parent's level. The arithmetic is exact
(fractions), and a leaf's budget is whole tokens. Each leaf takes whole epochs, and of the next one a prefix of the
mails in a seeded order; the few tokens before the mail that doesn't fit go on to the leaf's next sibling, and behind
the last sibling to what follows in the tree, so all in all less than one mail is missing from the mixture's size.

The tree has as many leaves as there are combinations of domain, language and source known, so budgets are worked out
on the driver; the rows never come there. The prefix needs no sort of a leaf: rows fall into bins of the seeded order,
the bins' sums say which bin holds the end, a crowded bin is cut into bins again, and what comes to the driver are the
mails around the end of each leaf's prefix, no more than one mail has tokens. The end is then a place in the seeded
order, which every row compares itself with.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..common import materialize, table
from .tokens import with_tokens

SEED = 5
#: Bits of a cut of the seeded order into bins, and mails that a bin may hold and not be cut again.
BIN_BITS, BIN_ROWS = 12, 2000
#: Languages that are told apart.
LANGUAGES = ("de", "en", "es", "fr")
#: Leaf of a row: source's plain name and language.
LEAF = ["name", "lang"]


@dataclass
class Node:
    name: str = ""
    weight: Fraction = Fraction(0)
    tokens: int = 0
    cap: int = 0
    budget: Fraction = Fraction(0)
    children: dict[str, Node] = field(default_factory=dict)


def build(leaves: list[tuple[tuple[str, ...], Fraction | float, int, int]]) -> Node:
    """Tree of leaves (path, weight, tokens, cap); a node's weight, tokens and cap are the sums of its children's."""
    root = Node()
    for path, weight, tokens, cap in leaves:
        node = root
        for part in path:
            node = node.children.setdefault(part, Node(part))
        node.weight, node.tokens, node.cap = Fraction(weight), tokens, cap

    def up(node: Node) -> None:
        for child in node.children.values():
            up(child)
        if node.children:
            node.weight = sum((c.weight for c in node.children.values()), Fraction(0))
            node.tokens = sum(c.tokens for c in node.children.values())
            node.cap = sum(c.cap for c in node.children.values())

    up(root)
    return root


def allot(node: Node, budget: Fraction | int) -> Fraction:
    """Give a budget to a node; returns what it can't take. Shortages move to siblings first, then upwards."""
    node.budget = min(Fraction(budget), Fraction(node.cap))
    open_ = [c for c in node.children.values() if c.weight > 0 and c.cap > 0]
    given = {id(c): Fraction(0) for c in open_}
    rest = node.budget
    while open_ and rest > 0:
        total = sum(c.weight for c in open_)
        for c in open_:
            given[id(c)] += rest * c.weight / total
        rest = Fraction(0)
        for c in list(open_):
            if given[id(c)] >= c.cap:
                rest += given[id(c)] - c.cap
                given[id(c)] = Fraction(c.cap)
                open_.remove(c)
    taken = Fraction(0)
    for c in node.children.values():
        allot(c, given.get(id(c), Fraction(0)))
        taken += c.budget
    if node.children:
        node.budget = taken
    return budget - node.budget


def whole_tokens(budgets: list[Fraction]) -> list[int]:
    """Budgets in whole tokens: rounded down, and the tokens lost go one each to those that lost most. As caps are whole
    a budget stays within its cap, and one that equals its cap stays equal."""
    out = [int(b) for b in budgets]
    lost = int(sum(budgets, Fraction(0)) + Fraction(1, 2)) - sum(out)
    for i in sorted(range(len(out)), key=lambda i: (out[i] - budgets[i], i))[:lost]:
        out[i] += 1
    return out


def plain_name(c: Column) -> Column:
    """Sources are equal if they differ only in case, outer spaces, or in spaces, `-` and `_` between words."""
    return F.trim(F.regexp_replace(F.lower(c), r"[\s_\-]+", " "))


def plain_language(c: Column) -> Column:
    short = F.substring(F.trim(F.lower(c)), 1, 2)
    return F.when(short.isin(*LANGUAGES), short).otherwise("other")


def sized(documents: DataFrame, weights: DataFrame) -> tuple[DataFrame, list[dict]]:
    """Rows (doc_id, name, lang, n_tokens); and the sources with their weights.

    The domain of a source is the column `domain` of `weights`; where there is none, or null, it is the last word of the
    source's name. A null share is 0, null repeats are none. A source that is listed twice counts once, by its first
    spelling in alphabetical order.
    """
    rows = with_tokens(documents.select("doc_id", plain_name(F.col("source")).alias("name"), plain_language(F.col("lang")).alias("lang"), "text"))
    name = plain_name(F.col("source"))
    domain = F.element_at(F.split(name, " "), -1)
    if "domain" in weights.columns:
        domain = F.coalesce(F.lower(F.trim(F.col("domain"))), domain)
    known = weights.filter("source IS NOT NULL").select(
        "source", name.alias("name"), domain.alias("domain"), F.coalesce("target_share", F.lit(0.0)).alias("share"), F.coalesce("max_repeats", F.lit(0)).alias("repeats")
    )
    sources: dict[str, dict] = {}
    for r in sorted(known.collect(), key=lambda r: r.source):
        sources.setdefault(r.name, r.asDict())
    return materialize(rows, "sized"), list(sources.values())


def budgets(rows: DataFrame, sources: list[dict]) -> tuple[list[dict], int]:
    """Leaf rows (name, lang, domain, tokens, repeats, cap, want, budget), in the tree's order, and the tokens of all rows,
    which is the mixture's size.

    A source's weight spreads over its languages by their tokens, so each leaf of a source has the same share to cap.
    Rows without an id can't be named: their tokens count in the mixture's size only. So do those of unknown sources.
    """
    known = F.when(F.col("name").isin([s["name"] for s in sources]) & F.col("doc_id").isNotNull(), F.col("name"))  # all others are one, however many
    tokens = {(r["name"], r["lang"]): r["t"] or 0 for r in rows.groupBy(known.alias("name"), "lang").agg(F.sum("n_tokens").alias("t")).collect()}
    total = sum(tokens.values())
    leaves = []
    for s in sources:
        own = {lang: t for (name, lang), t in tokens.items() if name == s["name"]}
        all_own = sum(own.values())
        for lang, t in sorted(own.items()) or [("other", 0)]:
            weight = Fraction(s["share"]) * (Fraction(t, all_own) if all_own else 1)
            leaves.append(s | {"lang": lang, "tokens": t, "cap": s["repeats"] * t, "weight": weight, "want": weight * total})
    leaves.sort(key=lambda x: (x["domain"], x["lang"], x["name"]))
    path = lambda x: (x["domain"], x["lang"], x["name"])
    tree = build([(path(x), x["weight"], x["tokens"], x["cap"]) for x in leaves])
    allot(tree, total)
    shares_ = [tree.children[a].children[b].children[c].budget for a, b, c in map(path, leaves)]
    for x, b in zip(leaves, whole_tokens(shares_)):
        x["budget"] = b
    return leaves, total


def _order(seed: int) -> Column:
    """Place of a mail in the seeded order of its leaf's last, partial epoch: 0 to 2**63 - 1."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("epochs"), F.col("doc_id")), 1)


def _near_ends(keyed: DataFrame, slack: int) -> DataFrame:
    """(name, lang, h, doc_id, t, upto): mails whose end in the order lies between a mail before `rest` and `slack` behind it.

    `keyed` has a leaf's rest on each row. The order is cut into bins; those that hold that stretch are cut again until
    they hold few mails, so no task ever orders more.
    """
    here = keyed.groupBy(*LEAF, "rest", "h", "doc_id").agg(F.sum("n_tokens").alias("t"))
    here = here.withColumn("before", F.lit(0).cast("bigint"))
    shift = 63
    while True:
        shift = max(0, shift - BIN_BITS)
        bins = here.groupBy(*LEAF, "rest", "before", F.shiftright("h", shift).alias("bin")).agg(F.sum("t").alias("bt"), F.count("*").alias("n"))
        upto = Window.partitionBy(*LEAF).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        # at most 2**BIN_BITS bins of each bin that was kept
        bins = bins.withColumn("b0", F.col("before") + F.coalesce(F.sum("bt").over(upto), F.lit(0)))
        bins = bins.filter((F.col("b0") + F.col("bt") > F.col("rest") - F.lit(slack)) & (F.col("b0") <= F.col("rest") + F.lit(slack)))
        bins = materialize(bins.select(*LEAF, "bin", "b0", "n"), "bins")
        first = Window.partitionBy(*LEAF)
        low = bins.withColumn("low", F.min("b0").over(first)).select(*LEAF, "bin", "low")
        here = here.drop("before").withColumn("bin", F.shiftright("h", shift)).join(low, [*LEAF, "bin"]).withColumnRenamed("low", "before").drop("bin")
        if not shift or (bins.agg(F.max("n")).first()[0] or 0) <= BIN_ROWS:
            break
        here = materialize(here, "ends")
    inside = Window.partitionBy(*LEAF).orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    ends = here.withColumn("upto", F.col("before") + F.sum("t").over(inside))
    return ends.filter((F.col("upto") > F.col("rest") - F.lit(slack)) & (F.col("upto") <= F.col("rest") + F.lit(slack)))


def cuts(rows: DataFrame, leaves: list[dict], seed: int = SEED) -> list[dict]:
    """Per leaf: name, lang, source, epochs, and the last place (h, doc_id) of its prefix (null if there is none), with
    `planned`, the tokens it uses."""
    spark = rows.sparkSession
    plan = []
    for x in leaves:
        whole, rest = divmod(x["budget"], x["tokens"]) if x["tokens"] else (0, 0)
        plan.append({"name": x["name"], "lang": x["lang"], "source": x["source"], "epochs": whole, "rest": rest, "tokens": x["tokens"], "cap": x["cap"]})
    partial = [(x["name"], x["lang"], x["epochs"], x["rest"]) for x in plan if x["epochs"] * x["tokens"] < x["cap"]]
    near: dict[tuple[str, str], list] = {}
    usable = rows.filter("doc_id IS NOT NULL AND n_tokens > 0")
    if partial:
        leaf = F.broadcast(spark.createDataFrame(partial, "name string, lang string, epochs int, rest bigint"))  # a row per leaf
        keyed = usable.join(leaf, LEAF).withColumn("h", _order(seed))
        slack = keyed.groupBy(*LEAF, "doc_id").agg(F.sum("n_tokens").alias("t")).agg(F.max("t")).first()[0] or 0
        # a row per mail around each end: not more than twice the tokens of the longest mail
        for r in _near_ends(keyed, slack).collect():
            near.setdefault((r.name, r.lang), []).append((r.h, r.doc_id, r.t, r.upto))
    carry = 0
    for x in plan:  # in the tree's order: to the next sibling first, then to what follows its parent
        want = x["rest"] + carry
        end = (None, None, 0)
        if x["epochs"] * x["tokens"] < x["cap"]:
            for h, doc, _, upto in sorted(near.get((x["name"], x["lang"]), [])):
                if upto <= want:
                    end = (h, doc, upto)
            carry = want - end[2]
        x["h"], x["doc"], used = end
        x["planned"] = x["epochs"] * x["tokens"] + used
    return plan


def mixture(rows: DataFrame, leaves: list[dict], seed: int = SEED) -> DataFrame:
    """(doc_id, source, lang, n_tokens, uses): how often each mail of a known source is used, at most `max_repeats` times.

    A leaf's budget of b tokens is b // tokens whole epochs and a prefix of the next. Mails without tokens are used in
    whole epochs only. Rows that repeat an id stand at one place of the order and are used alike.
    """
    schema = "name string, lang string, source string, epochs int, cut bigint, last string"
    plan = [(x["name"], x["lang"], x["source"], x["epochs"], x["h"], None if x["doc"] is None else str(x["doc"])) for x in cuts(rows, leaves, seed)]
    plan_df = F.broadcast(rows.sparkSession.createDataFrame(plan, schema))  # a row per leaf
    keyed = rows.filter("doc_id IS NOT NULL").join(plan_df, LEAF).withColumn("h", _order(seed))
    last = F.col("last").cast(rows.schema["doc_id"].dataType)
    within = (F.col("h") < F.col("cut")) | (F.col("h") == F.col("cut")) & (F.col("doc_id") <= last)
    more = F.when(within & (F.col("n_tokens") > 0), 1).otherwise(0)
    return keyed.select("doc_id", "source", "lang", "n_tokens", (F.col("epochs") + more).alias("uses"))


def shares(mixed: DataFrame, leaves: list[dict]) -> DataFrame:
    """Per source: target and actual share of the mixture, tokens held, tokens allotted by the tree and used in the
    mixture, and whether it misses its target: all that it may give is used, and that is less than its target."""
    spark = mixed.sparkSession
    by: dict[str, list] = {}
    for x in leaves:
        row = by.setdefault(x["source"], [x["source"], x["share"], x["repeats"], 0, 0, 0, Fraction(0)])
        for i, k in enumerate(("tokens", "budget", "cap", "want")):
            row[3 + i] += x[k]
    known = spark.createDataFrame([(*r[:6], r[5] < r[6]) for r in by.values()], "source string, target_share double, max_repeats int, tokens bigint, allotted bigint, cap bigint, short boolean")
    used = mixed.groupBy("source").agg(F.sum(F.col("uses") * F.col("n_tokens")).alias("u"))
    out = known.join(F.broadcast(used), "source", "left").withColumn("used", F.coalesce("u", F.lit(0)).cast("bigint"))
    whole = F.sum("used").over(Window.partitionBy())  # a row per source
    return out.select(
        "source", "target_share", "max_repeats", "tokens", "allotted", "used", F.coalesce(F.try_divide(F.col("used"), whole), F.lit(0.0)).alias("actual_share"),
        (F.col("short") & (F.col("used") >= F.col("cap"))).alias("misses"),
    )


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[dict]]:
    rows, sources = sized(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_weights"))
    leaves, _ = budgets(rows, sources)
    return mixture(rows, leaves), leaves


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares(*_mix(spark, sf_dir)).filter("misses").select("source")


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares(*_mix(spark, sf_dir))


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[0]


# The rows don't depend on the measure of size, so characters stand in for tokens, which SQL can't count.
P7_FOUND_SQL = r"""
WITH n AS (SELECT trim(regexp_replace(lower(source), '[\s_\-]+', ' ', 'g')) AS name, CAST(coalesce(length(text), 0) AS DOUBLE) AS size FROM documents),
t AS (SELECT name, sum(size) AS own FROM n GROUP BY name)
SELECT w.source FROM source_weights w LEFT JOIN t ON t.name = trim(regexp_replace(lower(w.source), '[\s_\-]+', ' ', 'g'))
WHERE w.max_repeats * coalesce(t.own, 0) < w.target_share * (SELECT sum(size) FROM n)"""
