"""Rule-based text checks: the first rule that a text breaks, coverage of topics, and near-repeats.

Dictionaries are parameters: words by rule. A claim rule holds words that may only be used if the keywords
have them too, or if the keywords match its gate.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions import text as T
from tesserae.operators import pieces
from tesserae.session import materialise

#: Code points of an acceptable text, topics it must touch, exclamation marks it may have, and how many texts back are compared.
LEAST_LENGTH, MOST_LENGTH = 75, 250
LEAST_TOPICS, MOST_EXCLAMATIONS, RECENT, SHARED_WORDS = 3, 1, 30, 2


@dataclass(frozen=True)
class Claim:
    """Words (or a pattern) that the keywords must support."""

    words: Sequence[str] = ()
    pattern: str = ""
    gate: str = ""  # keywords that match it allow every word
    projects: Sequence[str] = ()  # only for these, if any
    except_for: Sequence[str] = ()

    def broken(self, text: Column, keywords: Column, project: Column) -> Column:
        hit = F.lit(False)
        for w in self.words:
            hit = hit | (F.contains(text, F.lit(w)) & (F.lit(True) if self.gate else ~F.contains(keywords, F.lit(w))))
        if self.pattern:
            hit = hit | (text.rlike(self.pattern) & (F.lit(True) if self.gate else ~keywords.rlike(self.pattern)))
        if self.gate:
            hit = hit & ~keywords.rlike(self.gate)
        if self.projects:
            hit = hit & project.isin(*self.projects)
        if self.except_for:
            hit = hit & ~project.isin(*self.except_for)
        return hit


@dataclass(frozen=True)
class Rules:
    """The dictionaries of one language."""

    instructional: Sequence[str] = ()
    marketing: Sequence[str] = ()
    negative: Sequence[str] = ()
    project_words: Mapping[str, Sequence[str]] = field(default_factory=dict)  # bad for that project
    claims: Mapping[str, Claim | Sequence[Claim]] = field(default_factory=dict)  # in the order they are checked; of several under one name any may be broken
    formal: Sequence[str] = ()  # patterns
    topics: Sequence[Sequence[str]] = ()
    project_topics: Mapping[str, Sequence[str]] = field(default_factory=dict)
    signature: Sequence[str] = ()
    aliases: Mapping[str, str] = field(default_factory=dict)
    projects: Sequence[str] = ()
    marks: Sequence[str] = ("！", "!")


def bad_words(text: Column, project: Column, rules: Rules) -> Column:
    marks = sum((T.occurrences(text, m) for m in rules.marks), start=F.lit(0))
    out = T.has_any(text, rules.marketing) | T.has_any(text, rules.negative) | (marks > MOST_EXCLAMATIONS)
    for name, words in rules.project_words.items():
        out = out | ((project == name) & T.has_any(text, words))
    return out


def topics_hit(text: Column, project: Column, rules: Rules) -> Column:
    """How many topics the text touches; a project's own words (or its name) are one of them."""
    own = F
    for name, words in rules.project_topics.items():
        own = own.when(project == name, T.has_any(text, words))
    named = F.contains(text, project) if own is F else own.otherwise(F.contains(text, project))
    return T.count_hits(text, rules.topics) + F.coalesce(named, F.lit(False)).cast("int")


def known_project(project: Column, rules: Rules) -> Column:
    """The project under its alias, null if it is not on the list."""
    named = F.trim(project)
    for alias, name in rules.aliases.items():
        named = F.when(F.trim(project) == alias, name).otherwise(named)
    return F.when(named.isin(*rules.projects), named)


def broken_claims(text: Column, keywords: Column, project: Column, claims: Mapping[str, Claim | Sequence[Claim]]) -> list[tuple[str, Column]]:
    """For each name, in its order, whether the text breaks one of its claims."""
    every = {name: [c] if isinstance(c, Claim) else c for name, c in claims.items()}
    return [(name, reduce(or_, (c.broken(text, keywords, project) for c in some))) for name, some in every.items()]


def first_broken_claim(text: Column, keywords: Column, project: Column, claims: Mapping[str, Claim | Sequence[Claim]]) -> Column:
    """The name of the first claim that the text breaks; empty if none. Nulls are empty texts, keywords and projects."""
    none = F.lit("")
    out = F
    for name, broken in broken_claims(F.coalesce(text, none), F.coalesce(keywords, none), F.coalesce(project, none), claims):
        out = out.when(broken, name)
    return none if out is F else out.otherwise("")


def first_reason(text: Column, project: Column, keywords: Column, rules: Rules, similar: Column | None = None) -> Column:
    """The first rule that the text breaks, in the order of the rules; empty if none."""
    # Bound to a name, so that each text is stripped once and not for every rule.
    return F.transform(F.array(T.strip_noise(text)), lambda plain: _first_reason(plain, project, keywords, rules, similar))[0]


def _first_reason(plain: Column, project: Column, keywords: Column, rules: Rules, similar: Column | None) -> Column:
    words = F.coalesce(keywords, F.lit(""))
    size = T.length(plain)
    out = F.when(plain.isNull() | (plain == ""), "empty").when((size < LEAST_LENGTH) | (size > MOST_LENGTH), "length")
    out = out.when(T.has_any(plain, rules.instructional), "instructional").when(bad_words(plain, project, rules), "bad_words")
    for name, broken in broken_claims(plain, words, project, rules.claims):
        out = out.when(broken, name)
    formal = F.lit(False)
    for p in rules.formal:
        formal = formal | plain.rlike(p)
    out = out.when(formal, "formal").when(topics_hit(plain, project, rules) < LEAST_TOPICS, "low_reference_value")
    return out.when(F.lit(False) if similar is None else similar, "similar").otherwise("")


def near_repeats(texts: DataFrame, by: Sequence[str], order: Sequence[str], rules: Rules, piece: int = pieces.PIECE) -> DataFrame:
    """texts (text, ...) with `similar`: empty, equal to one of the RECENT before it, or sharing SHARED_WORDS signature words with one.

    A history (the rows of one `by`) of any length is spread over tasks: rows are dealt out by ranges of (by, order), and each range
    is given copies of the last RECENT rows before it, of the ranges before (a halo), which its own rows look back on. Texts
    are compared by their hash, so what is looked back on holds none. Rows of equal (by, order) keep some order, the same for all.
    """
    keys = [*by, *order]
    rows = texts.select(F.struct("*").alias("row"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keys)], F.trim("text").alias("bare"))
    signs = F.filter(F.array(*[F.when(F.contains("bare", F.lit(w)), F.lit(w)) for w in rules.signature]), lambda x: x.isNotNull())
    rows = rows.select("row", *[f"k{i}" for i in range(len(keys))], F.sha2("bare", 256).alias("hash"), signs.alias("signs"), (F.coalesce("bare", F.lit("")) == "").alias("blank"))
    group, at = [f"k{i}" for i in range(len(by))], [f"k{i}" for i in range(len(by), len(keys))]
    dealt = pieces.dealt(rows, [*group, *at], piece)
    # Of a history that goes on in later pieces, those that begin within RECENT rows after a piece: as few rows as there are pieces, about.
    spans = dealt.groupBy("piece", *group).agg(F.count("*").alias("n"))
    later = Window.partitionBy(*group).orderBy("piece").rowsBetween(1, RECENT)
    between = lambda i: F.aggregate(F.slice("next", 1, i), F.lit(0).cast("long"), lambda s, x: s + x["n"])
    reach = spans.withColumn("next", F.collect_list(F.struct("piece", "n")).over(later)).filter(F.size("next") > 0)
    reach = reach.select("piece", *group, F.explode(F.transform("next", lambda x, i: F.struct(x["piece"].alias("to"), between(i).alias("between")))).alias("next"))
    reach = materialise(reach.filter(F.col("next.between") < RECENT), "reach")
    same = [F.col(f"t.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ("piece", *group)]
    tails = dealt.alias("t").join(reach.alias("r"), same).select("t.piece", *[f"t.{c}" for c in (*group, *at, "tie", "hash", "signs")], "r.next")
    nth = F.row_number().over(Window.partitionBy("piece", *group, "next.to").orderBy(*[F.desc_nulls_last(c) for c in (*at, "tie")]))
    halo = tails.withColumn("nth", nth).filter(F.col("nth") <= RECENT).filter(F.col("nth") + F.col("next.between") <= RECENT)
    halo = halo.select(F.col("next.to").alias("piece"), *group, *at, "tie", "hash", "signs")
    both = dealt.withColumn("own", F.lit(True)).unionByName(halo.withColumn("own", F.lit(False)), allowMissingColumns=True)
    before = Window.partitionBy("piece", *group).orderBy(*at, "tie").rowsBetween(-RECENT, -1)
    seen = both.withColumn("recent", F.collect_list(F.struct("hash", "signs")).over(before)).filter("own")
    shared = F.exists("recent", lambda r: F.size(F.array_intersect(F.col("signs"), r["signs"])) >= SHARED_WORDS)
    equal = F.exists("recent", lambda r: r["hash"] == F.col("hash"))
    similar = F.col("blank") | F.coalesce(equal, F.lit(False)) | ((F.size("signs") > 0) & shared)
    return seen.select("row", similar.alias("similar")).select("row.*", "similar")


safe_to_copy = T.safe_to_copy


def cached(requests: DataFrame, by: str, payload: str, ts: str, ttl_seconds: int = 8) -> DataFrame:
    """requests with `cached`: the one before it had the same payload, not longer ago than the time to live."""
    order = Window.partitionBy(by).orderBy(ts)
    same = F.lag(payload).over(order).eqNullSafe(F.col(payload)) & (F.timestamp_diff("SECOND", F.lag(ts).over(order), F.col(ts)) < ttl_seconds)
    return requests.withColumn("cached", F.coalesce(same, F.lit(False)))
