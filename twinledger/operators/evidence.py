"""How complete what was gathered about a contract is, and what may be said from it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The states of one kind of evidence.
STATES = ["complete", "empty", "truncated", "failed", "not_requested"]


def page_state(rows: Column, truncated: Column, failed: Column | None = None) -> Column:
    """The state of evidence: failed, or truncated if pages are left, or empty without rows, or complete."""
    return F.when(F.lit(False) if failed is None else failed, "failed").when(truncated, "truncated").when(rows > 0, "complete").otherwise("empty")


def combined_state(*states: Column) -> Column:
    """The state of what needs several kinds of evidence: the worst of failed, not_requested and truncated; empty if all are, else complete.
    Null states are not needed; without any it is empty."""
    given = F.filter(F.array(*states), lambda s: s.isNotNull())
    out = F.when(F.forall(given, lambda s: s == "empty"), "empty").otherwise("complete")
    for s in ("truncated", "not_requested", "failed"):
        out = F.when(F.array_contains(given, s), s).otherwise(out)
    return out


def is_complete(states: Sequence[Column], open_counts: Sequence[Column] = (), excluded: Column | None = None) -> Column:
    """Whether nothing is missing: all states are complete or empty (null ones are not needed) and no count of open matters is above 0; what is excluded misses nothing."""
    fine = reduce(lambda a, b: a & b, (F.coalesce(s.isin("complete", "empty"), F.lit(True)) for s in states), F.lit(True))
    closed = reduce(lambda a, b: a & b, (F.coalesce(c, F.lit(0)) == 0 for c in open_counts), fine)
    return closed if excluded is None else excluded | closed


def state_counts(rows: DataFrame, keys: Sequence[str], kinds: Sequence[str]) -> DataFrame:
    """(keys, kind, STATES): how many rows have each state of each kind of evidence, one column for each state."""
    each = rows.select(*keys, F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("state")) for k in kinds))).alias("x")).select(*keys, "x.*")
    return each.groupBy(*keys, "kind").agg(*(F.count(F.when(F.col("state") == s, 1)).alias(s) for s in STATES))


def reason_counts(rows: DataFrame, keys: Sequence[str], reasons: str) -> DataFrame:
    """(keys, reason, n): how often each of an array of reasons occurs; null arrays and reasons give none."""
    return rows.select(*keys, F.explode(reasons).alias("reason")).filter("reason is not null").groupBy(*keys, "reason").agg(F.count(F.lit(1)).alias("n"))


def population(holders: DataFrame, states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, nfts): the tokens of a collection by its holders (keys, token_id, balance), null unless the evidence (keys, state) is complete or empty and every
    holder names its tokens. Balances are decimal texts; 0 is no holder, null one of an unknown amount."""
    held = holders.filter("balance is null or not balance rlike '^0*$'").filter("token_id <> ''").select(*keys, "token_id").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    blank = holders.groupBy(*keys).agg(F.bool_or(F.coalesce(F.trim("token_id"), F.lit("")) == "").alias("__blank"))
    known = F.col("state").isin("complete", "empty") & ~F.coalesce("__blank", F.lit(False))
    return states.join(held, list(keys), "left").join(blank, list(keys), "left").select(*keys, F.when(known, F.coalesce("__n", F.lit(0))).alias("nfts"))


def first_source(sources: Sequence[tuple[DataFrame, DataFrame]], keys: Sequence[str]) -> DataFrame:
    """Rows of the first source that answered, per key; sources are never mixed within one.

    sources: (rows, states (keys, state)) in order of preference, all rows with the same columns. A source answers unless its state is failed,
    not_requested or missing; one that answers with no rows counts too. States must be unique by key and are what is joined, so rows of a key
    with most of them don't move for the choice where the states are few.
    """
    taken, out = None, []
    for rows, states in sources:
        answers = states.filter(F.col("state").isin("complete", "empty", "truncated")).select(*keys)
        mine = answers if taken is None else answers.join(taken, list(keys), "left_anti")
        out.append(rows.join(mine, list(keys), "left_semi"))
        taken = answers if taken is None else taken.unionByName(mine)
    return reduce(DataFrame.unionByName, (o.select(*out[0].columns) for o in out))


def unambiguous(quotes: DataFrame, keys: Sequence[str], identity: str, value: str) -> DataFrame:
    """(keys, value) of quotes whose key stands for one identity only: a symbol that several addresses bear has no quote. Null identities are one; of
    several values the smallest."""
    one = quotes.groupBy(*keys).agg(F.min(value).alias(value), F.min(F.coalesce(identity, F.lit(""))).alias("lo"), F.max(F.coalesce(identity, F.lit(""))).alias("hi"))
    return one.filter(F.col("lo") == F.col("hi")).filter(F.col(value).isNotNull()).select(*keys, value)


def without_listed(rows: DataFrame, excluded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not explicitly excluded (keys, excluded boolean): only a true flag excludes, a null or missing one does not."""
    return rows.join(excluded.filter("excluded").select(*keys).distinct(), list(keys), "left_anti")
