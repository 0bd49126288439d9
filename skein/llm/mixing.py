"""Mixing sources to target weights by hierarchical budgets.

Weights flow down a tree of domain, language and source.  A node never gets
more than its documents can give in the allowed epochs; what one child cannot
use goes to its siblings first, and only what a whole family cannot use goes
up.  Each leaf then takes whole epochs of its documents and a prefix of one
more, in an order that the seed and the epoch decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import give_back_in_driver, hold

LEVELS = ("domain", "lang", "source")
#: Weights of nodes by level; a node that is not named weighs 1.
WEIGHTS = {
    "domain": {"web0": 3.0, "web1": 2.0, "web2": 2.0, "web3": 1.0},
    "lang": {"en": 5.0, "de": 2.0, "fr": 2.0, "es": 2.0},
    "source": {},
}
MAX_EPOCHS = 4
SEED = 17
#: Order keys of a leaf fall into so many bins, and again as many finer ones;
#: only the fine bin in which the prefix ends is sorted.
BINS = 1 << 8
#: Leaves come to the driver, a row each; more than this is an error.
MOST_LEAVES = 200_000


def default_domain(source: Column) -> Column:
    """web0 to web3 by the number at the end of a source's name, else `other`."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), r"(\d{1,9})$", 1)
    return F.when(number != "", F.concat(F.lit("web"), (number.cast("int") % 4).cast("string"))).otherwise(F.lit("other"))


def share_out(budget: float, children: list[tuple[float, float]]) -> list[float]:
    """Split a budget among (weight, capacity) children by weight.

    A child that would pass its capacity gets just that, and the rest is split
    anew among the others.  What no child can take stays unassigned; so does
    the budget that only children of weight 0 could take.
    """
    out = [0.0] * len(children)
    open_ = [i for i, (w, c) in enumerate(children) if w > 0 and c > 0]
    while open_ and budget > 0:
        total = sum(children[i][0] for i in open_)
        full = [i for i in open_ if budget * (children[i][0] / total) >= children[i][1]]
        if not full:
            for i in open_:
                out[i] = budget * (children[i][0] / total)
            break
        for i in full:
            out[i] = children[i][1]
        budget -= sum(children[i][1] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def leaf_budgets(leaves: dict[tuple, int], budget: float, weights: dict, max_epochs: float) -> dict[tuple, float]:
    """Tokens for each leaf (path of names), given its tokens."""

    def walk(paths: list[tuple], depth: int, amount: float, out: dict):
        if depth == len(LEVELS):
            out[paths[0]] = amount
            return
        groups: dict = {}
        for p in paths:
            groups.setdefault(p[depth], []).append(p)
        names = sorted(groups, key=lambda x: (x is None, x or ""))
        held = weights.get(LEVELS[depth], {})
        parts = share_out(
            amount, [(held.get(n, 1.0), max_epochs * sum(leaves[p] for p in groups[n])) for n in names]
        )
        for n, part in zip(names, parts, strict=True):
            walk(groups[n], depth + 1, part, out)

    out: dict[tuple, float] = {}
    if leaves:
        walk(list(leaves), 0, float(budget), out)
    return out


def _placed(rows: DataFrame, plan: dict[tuple, list], order_id: Column, seed: int) -> DataFrame:
    """rows with what plan has for their leaf (_PLAN), and the bin and fine bin of their order key.

    plan has a row a leaf, of which there are MOST_LEAVES at most.
    """
    names = [f"p_{x}" for x in LEVELS]
    held = rows.sparkSession.createDataFrame([(*path, *of) for path, of in plan.items()], ", ".join(f"{n} string" for n in names) + ", " + _PLAN)
    a, b, c = (F.col(x).eqNullSafe(F.col(n)) for x, n in zip(LEVELS, names, strict=True))
    bits = (BINS - 1).bit_length()
    return (
        rows.join(F.broadcast(held), a & b & c)
        .withColumn("at", F.xxhash64(F.lit(seed), "epochs", order_id))
        .withColumn("bin", F.shiftrightunsigned("at", 64 - bits).cast("int"))
        .withColumn("fine", (F.shiftrightunsigned("at", 64 - 2 * bits) % BINS).cast("int"))
    )


#: Of a leaf: whole epochs, tokens of the one more that is not whole; the bin and
#: the finer bin in which these end, null if they are all, and the tokens before.
_PLAN = "epochs bigint, rest bigint, end_bin int, end_fine int, before bigint"


def _ends(rows: DataFrame, bins: str) -> list[tuple[tuple, int, int]]:
    """For each leaf the bin in which its tokens pass its rest, and the tokens before that bin.

    before is what comes before the first bin.  A leaf has BINS sums at most,
    which stay where they are; a row a leaf comes to the driver.
    """
    running = Window.partitionBy(*LEVELS).orderBy(bins)
    found = (
        rows.groupBy(*LEVELS, bins)
        .agg(F.sum("n_tokens").alias("held"), F.max("rest").alias("rest"), F.max("before").alias("before"))
        .withColumn("up_to", F.col("before") + F.sum("held").over(running))
        .where(F.col("up_to") > F.col("rest"))
        .groupBy(*LEVELS)
        .agg(F.min(bins).alias("end"), F.min_by(F.col("up_to") - F.col("held"), bins).alias("before"))
    )
    return [(tuple(r)[:3], r["end"], r["before"]) for r in found.collect()]


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    domain: Column | None = None,
    weights: dict | None = None,
    budget: int | None = None,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
) -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens, copies) of each row.

    Tokens are words between blanks.  copies says how often the row is taken: a
    leaf whose budget is b and whose rows have t tokens takes all of them
    b // t times, and then, in the order of a hash of seed, epoch and id, the
    longest run of first rows that fits what is left.  budget is that of the
    whole mix, by default as many tokens as docs have.  Null languages, sources
    and ids are names of their own; null texts have no tokens.  Rows that tie
    in the order are taken in the order of their tokens; rows without an id are
    ordered by a hash of their texts.  No rows give no rows; other columns are
    not looked at.  More than MOST_LEAVES leaves are an error.
    """
    spark = docs.sparkSession
    ids = dict(docs.dtypes)[id_col] == "bigint"
    domain = default_domain(F.col(source_col)) if domain is None else domain
    rows = hold(
        docs.select(
            F.col(id_col).alias("doc_id"),
            domain.alias("domain"),
            F.col(lang_col).alias("lang"),
            F.col(source_col).alias("source"),
            F.regexp_count(F.coalesce(text_col, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("n_tokens"),
            F.when(F.col(id_col).isNull(), F.xxhash64(text_col)).alias("alias"),
        )
    )
    found = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("n")).limit(MOST_LEAVES + 1).collect()
    if len(found) > MOST_LEAVES:
        raise ValueError(f"more than {MOST_LEAVES} leaves")
    leaves = {tuple(r)[:3]: r["n"] for r in found}
    if budget is None:
        budget = sum(leaves.values())
    given = leaf_budgets(leaves, budget, WEIGHTS if weights is None else weights, max_epochs)
    plan = {}
    for path, n in leaves.items():
        whole = int(given[path] // n) if n else 0
        plan[path] = [whole, int(given[path] - whole * n), None, None, 0]
    # Rows without an id are ordered by their texts, so that they do not share a bin.
    order_id = F.coalesce("doc_id", "alias") if ids else F.col("doc_id")
    # The bin in which the rest ends, then the finer bin within it.  Each is found
    # by a query of its own, so that no plan holds the others' several times.
    for path, end, before in _ends(_placed(rows, plan, order_id, seed), "bin"):
        plan[path][2], plan[path][4] = end, before
    for path, end, before in _ends(_placed(rows, plan, order_id, seed).where("bin = end_bin"), "fine"):
        plan[path][3], plan[path][4] = end, before
    give_back_in_driver(spark)
    placed = _placed(rows, plan, order_id, seed)
    cols = ["doc_id", *LEVELS, "n_tokens"]
    # Without an end the rest covers the leaf, which then has no tokens at all.
    last = F.col("end_bin").isNotNull() & (F.col("bin") == F.col("end_bin")) & (F.col("fine") == F.col("end_fine"))
    taken = F.col("end_bin").isNull() | (F.struct("bin", "fine") < F.struct(F.col("end_bin").alias("bin"), F.col("end_fine").alias("fine")))
    order = Window.partitionBy(*LEVELS).orderBy("at", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    border = placed.where(last).withColumn("run", F.col("before") + F.sum("n_tokens").over(order))
    return (
        placed.where(~last)
        .select(*cols, (F.col("epochs") + taken.cast("bigint")).alias("copies"))
        .unionByName(border.select(*cols, (F.col("epochs") + (F.col("run") <= F.col("rest")).cast("bigint")).alias("copies")))
    )


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
