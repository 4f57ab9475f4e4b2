"""Stories: token sequences of a window or of a user's events, their families, transitions and distances."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters that stand for the nine families.
LETTERS = {"INITIAL_CONTEXT": "I", "RANGE_CHANGE": "R", "DIRECTION_CHANGE": "D", "BODY_CHANGE": "B", "LEVEL_INTERACTION": "L", "REJECTION": "J", "PULLBACK": "P", "HOLD": "H", "EXPANSION_AFTER_TEST": "E"}
#: Token pairs that are cheaper to exchange, at .35 (tokens) and .5 (families).
RELATED = {
    0.35: [("LEVEL_INTERACTION_CLUSTER", "REPEATED_TEST_CLUSTER"), ("REJECTION_CLUSTER", "HOLD_CLUSTER"), ("RANGE_EXPANSION", "BODY_EXPANSION"), ("RANGE_COMPRESSION", "BODY_COMPRESSION"), ("DIRECTIONAL_SHIFT", "DIRECTION_CHANGE_IN_CHARACTER")],
    0.5: [("LEVEL_INTERACTION", "REJECTION"), ("LEVEL_INTERACTION", "PULLBACK"), ("LEVEL_INTERACTION", "EXPANSION_AFTER_TEST"), ("REJECTION", "HOLD"), ("RANGE_CHANGE", "BODY_CHANGE"), ("DIRECTION_CHANGE", "BODY_CHANGE")],
}


def parsed(story: Column) -> Column:
    """The tokens of 'A -> B'; empty for null."""
    return F.coalesce(F.filter(F.transform(F.split(story, "->"), lambda x: F.trim(x)), lambda x: x != ""), F.array().cast("array<string>"))


def without_repeats(tokens: Column) -> Column:
    """tokens less those equal to the one before."""
    return F.filter(tokens, lambda x, i: (i == 0) | (x != F.get(tokens, i - 1)))


def family(token: Column) -> Column:
    return (
        F.when(token.startswith("INITIAL_"), "INITIAL_CONTEXT").when(token.contains("RANGE_"), "RANGE_CHANGE").when(token.isin("DIRECTIONAL_SHIFT", "DIRECTION_CHANGE_IN_CHARACTER", "COUNTERMOVE_AND_RENEWAL"), "DIRECTION_CHANGE")
        .when(token.contains("BODY_"), "BODY_CHANGE").when(token.isin("LEVEL_INTERACTION_CLUSTER", "REPEATED_TEST_CLUSTER"), "LEVEL_INTERACTION").when(token == "REJECTION_CLUSTER", "REJECTION").when(token == "PULLBACK_CLUSTER", "PULLBACK")
        .when(token == "HOLD_CLUSTER", "HOLD").otherwise(token)
    )


def families(tokens: Column) -> Column:
    return without_repeats(F.transform(tokens, lambda x: family(x)))


#: The phases that open a story.
OPENINGS = ("INITIAL_BULLISH_BIAS", "INITIAL_BEARISH_BIAS", "INITIAL_BALANCED_BEHAVIOUR")
NO_STORY = "NO_MEANINGFUL_STORY"


def phases() -> Column:
    """Tokens of a window of levels.windows_of: its opening, and what changes in its second half; ranges and bodies in units of price."""
    d1, d2, r1, r2, b1, b2 = (F.col(f"{side}_{k}") for k in ("direction", "range", "body") for side in ("first", "second"))
    x, y, z = (F.col(f"direction_{i}") for i in range(3))  # thirds
    turn = F.abs(d2 - d1) >= 0.35
    return F.array_compact(F.array(
        F.when(d1 >= 0.25, OPENINGS[0]).when(d1 <= -0.25, OPENINGS[1]).otherwise(OPENINGS[2]), F.when(r2 > r1 * 1.2, "RANGE_EXPANSION").when(r2 < r1 * 0.8, "RANGE_COMPRESSION"),
        F.when((d1 * d2 < -0.03) & turn, "DIRECTIONAL_SHIFT").when(turn, "DIRECTION_CHANGE_IN_CHARACTER"), F.when(b2 > b1 * 1.2, "BODY_EXPANSION").when(b2 < b1 * 0.8, "BODY_COMPRESSION"),
        F.when((x * y < -0.05) & (z * x > 0.02), "COUNTERMOVE_AND_RENEWAL"),
    ))


def told(level_rows: DataFrame) -> DataFrame:
    """Rows of levels.level_rows with their story's tokens: phases, then episodes at levels."""
    return level_rows.withColumn("tokens", without_repeats(F.concat(phases(), F.col("level_tokens"))))


def story(tokens: Column) -> Column:
    return F.when(F.size(tokens) == 0, NO_STORY).otherwise(F.array_join(tokens, " -> "))


def feature_similarity(columns: list[str], own: str = "own_") -> Column:
    """1 / (1 + root mean square difference) of columns and those with a prefix, each by a quarter of the latter's size, or 1."""
    far = [F.pow((F.col(c) - F.col(f"{own}{c}")) / F.greatest(F.abs(F.col(f"{own}{c}")) * 0.25, F.lit(1.0)), 2) for c in columns]
    return 1 / (1 + F.sqrt(sum(far, F.lit(0.0)) / len(columns)))


def transitions(stories: DataFrame, tokens: str = "tokens") -> DataFrame:
    """stories with a row for each pair of neighbouring tokens: place, from_token, to_token."""
    t = F.col(tokens)
    pairs = F.transform(F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), lambda x, i: F.struct(i.alias("place"), F.get(t, i).alias("from_token"), x.alias("to_token")))
    # Outer: see levels.level_events.
    return stories.select(*(c for c in stories.columns if c != tokens), F.inline_outer(pairs)).where("place IS NOT NULL")


def transition_counts(stories: DataFrame, group: str, id: str, tokens: str = "tokens") -> DataFrame:
    """By group and pair: how often it occurs, and in how many stories (a share of all of the group)."""
    per = transitions(stories, tokens).groupBy(group, id, "from_token", "to_token").agg(F.count("*").alias("_n"))
    counts = per.groupBy(group, "from_token", "to_token").agg(F.sum("_n").alias("occurrences"), F.count("*").alias("stories"))
    whole = stories.groupBy(group).agg(F.count_distinct(id).alias("_all"))
    return counts.join(whole, group).withColumn("presence_pct", F.col("stories") * 100.0 / F.col("_all")).drop("_all")


def top_transitions(counts: DataFrame, group: str, k: int = 15) -> DataFrame:
    w = Window.partitionBy(group).orderBy(F.desc("stories"), F.desc("occurrences"), "from_token", "to_token")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def annotated(current: DataFrame, counts: DataFrame, group: str) -> DataFrame:
    """The transitions of current stories with what counts says of them; unseen ones count 0."""
    out = current.join(counts, [group, "from_token", "to_token"], "left")
    p = F.coalesce("presence_pct", F.lit(0.0))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select(*current.columns, zero("occurrences"), zero("stories"), p.alias("presence_pct"), F.when(p >= 50, "COMMON").when(p > 0, "PRESENT").otherwise("NOT_SEEN").alias("status"))


def alignment(a: Column, b: Column) -> Column:
    """1 less the edit distance of two family sequences by the longer's length; 0 if either is empty."""
    letter = F.create_map(*(F.lit(x) for kv in LETTERS.items() for x in kv))
    code = lambda t: F.array_join(F.transform(t, lambda x: F.coalesce(F.element_at(letter, x), F.lit("?"))), "")
    longest = F.greatest(F.size(a), F.size(b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(1 - F.levenshtein(code(a), code(b)) / longest)


def jaccard(a: Column, b: Column) -> Column:
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, 1.0).otherwise(both / either)


def weighted_distance(a: Column, b: Column, cost: float) -> Column:
    """Edit distance of two token sequences, in which related tokens are exchanged at a lower cost: a fold over the rows of its table."""
    cheap = F.lit([f"{x}|{y}" for pair in RELATED[cost] for x, y in (pair, pair[::-1])])
    change = lambda x, y: F.when(x == y, 0.0).when(F.array_contains(cheap, F.concat(x, F.lit("|"), y)), cost).otherwise(1.0)
    size, first = F.size(b), F.transform(F.sequence(F.lit(0), F.size(b)), lambda j: j.cast("double"))

    def row(above: Column, x: Column) -> Column:
        def cell(new: Column, j: Column) -> Column:
            least = F.least(F.get(above, j) + 1, F.get(new, j - 1) + 1, F.get(above, j - 1) + change(x, F.get(b, j - 1)))
            return F.concat(new, F.array(least))

        begun = F.array(F.get(above, F.lit(0)) + 1)
        return F.when(size == 0, begun).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), begun, cell))

    return F.element_at(F.aggregate(a, first, row), -1)


#: Tokens that are compared place by place.
SIGNATURE = 16


def clipped(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def story_similarity(a: str, b: str) -> Column:
    """Weighted edits, identity by place and likeness of the places' spacing over the first tokens; 0 if either is empty."""
    a, b = F.col(a), F.col(b)
    edit = 1 - weighted_distance(a, b, 0.35) / F.greatest(F.size(a), F.size(b))
    n, m = (F.least(F.size(x), F.lit(SIGNATURE)) for x in (a, b))
    places = F.sequence(F.lit(0), F.greatest(F.least(n, m) - 1, F.lit(0)))
    mean = lambda v: F.aggregate(F.transform(places, v), F.lit(0.0), lambda t, x: t + x) / F.size(places)
    same = mean(lambda k: (F.get(a, k) == F.get(b, k)).cast("double"))
    spacing = 1 - mean(lambda k: F.abs(k / F.greatest(n - 1, F.lit(1)) - k / F.greatest(m - 1, F.lit(1))))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(clipped(0.60 * edit + 0.25 * same + 0.15 * spacing))


def family_similarity(a: str, b: str) -> Column:
    """1 less the weighted edits of two family sequences by the longer's length; 0 if either is empty."""
    a, b = F.col(a), F.col(b)
    edit = 1 - weighted_distance(a, b, 0.5) / F.greatest(F.size(a), F.size(b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(clipped(edit))


def aligned(score: Column) -> Column:
    return F.when(score >= 0.75, "HIGH_FAMILY_ALIGNMENT").when(score >= 0.50, "MODERATE_FAMILY_ALIGNMENT").otherwise("LOW_FAMILY_ALIGNMENT")


#: Distance beyond which a story leads a new archetype; shares of tokens and of transitions in it.
LEADER, TOKENS_SHARE, PAIRS_SHARE = 0.48, 0.7, 0.3


def leader_clusters(stories: DataFrame, order: str, by: str, names: list[str]) -> DataFrame:
    """stories (by, order and a token array for each of names) with the archetype whose leader each follows, and the distance.

    In order, a row follows the nearest leader so far (the first of equal ones) or leads a new archetype. The distance of two rows is
    that of their token arrays, on average over names (1 for an empty one), and of all their transitions. The order decides, so
    each group is one stream; its state is its leaders. It is meant for ranked lists of bounded length, such as the best matches.
    """
    columns = stories.columns
    schema = T.StructType([*stories.schema.fields, T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.DoubleType())])
    at, key = [columns.index(x) for x in names], columns.index(by)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, leaders = None, []
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False, name=None):
                if row[key] != group:
                    group, leaders = row[key], []
                told = [list(row[i]) if row[i] is not None else [] for i in at]
                pairs = {(i, *p) for i, t in enumerate(told) for p in zip(t, t[1:], strict=False)}
                found = [(TOKENS_SHARE * float(np.mean([_normal(x, y) for x, y in zip(told, t, strict=True)])) + PAIRS_SHARE * (1 - _jaccard(pairs, p)), i) for i, (t, p) in enumerate(leaders)]
                best = min(found, default=(2.0, -1))
                if best[0] > LEADER:
                    leaders.append((told, pairs))
                    best = (0.0, len(leaders) - 1)
                out.append((*row, best[1], best[0]))
            yield pd.DataFrame(out, columns=[f.name for f in schema])

    return stories.repartition(by).sortWithinPartitions(by, order).mapInPandas(run, schema)


def _normal(a: list[str], b: list[str]) -> float:
    if not a or not b:
        return 1.0
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1] / max(len(a), len(b))


def _jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a | b else 1.0


#: What a token's part says, in order, and what is said when none does.
SAID = [
    ("COMPRESSION", "Candle movement became tighter at one or more points."), ("EXPANSION", "Candle movement became wider at one or more points."), ("DIRECTION", "The balance between upward and downward candles changed."),
    ("REJECTION", "There were signs of rejection around tested areas."), ("HOLD", "There were periods where price stayed around an area."), ("REPEATED_TEST", "Some areas were tested repeatedly."),
]
MIXED = "The window shows mixed candle behaviour without a single dominant event."


def explained(tokens: Column) -> Column:
    """Up to three sentences on a story, by what its tokens contain."""
    has = lambda part: F.exists(tokens, lambda t: t.contains(part))
    text = F.array_join(F.slice(F.array_compact(F.array(*(F.when(has(k), v) for k, v in SAID))), 1, 3), " ")
    return F.when(text == "", MIXED).otherwise(text)


def cross_summary(now: DataFrame, order: Column) -> DataFrame:
    """For each symbol what its timeframes' current windows (direction_shift, range_shift in units of price) have in common."""
    lists = lambda where: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(where, F.struct(order.alias("o"), F.col("timeframe").alias("t"))))), lambda x: x["t"]), ", ")
    out = now.groupBy("symbol").agg(lists(F.col("direction_shift") > 0.1).alias("upward"), lists(F.col("direction_shift") < -0.1).alias("downward"), F.bool_or(F.col("range_shift") > 0.05).alias("wider"), F.bool_or(F.col("range_shift") < -0.05).alias("tighter"))
    says = lambda c, text: F.when(F.col(c) != "", F.concat(F.lit(f"More {text} behaviour is appearing on "), F.col(c), F.lit(". "))).otherwise("")
    direction = F.concat(says("upward", "upward"), says("downward", "downward"), F.when((F.col("upward") == "") & (F.col("downward") == ""), "No large direction shift is visible in these measurements.").otherwise(""))
    spread = F.concat(F.when(F.col("wider"), "Some timeframes show wider candle movement. ").otherwise(""), F.when(F.col("tighter"), "Some timeframes show tighter candle movement. ").otherwise(""))
    return out.withColumns({"direction_text": direction, "range_text": F.concat(spread, F.lit("This is a description of the measured window."))})


def archetype_name(cluster: Column) -> Column:
    return F.concat(F.lit("ARCH-"), F.lpad((cluster + 1).cast("string"), 2, "0"))


def archetype_summary(members: DataFrame, by: str, order: str) -> DataFrame:
    """Size and share of each archetype of leader_clusters, and its leader, which is its first member."""
    out = members.groupBy(by, "cluster").agg(F.count("*").alias("occurrence_count"), F.min(order).alias("representative_rank"), F.min_by("reference_timestamp", order).alias("representative_timestamp"), F.avg("distance").alias("mean_distance"))
    return out.withColumns({"archetype": archetype_name(F.col("cluster")), "occurrence_share": F.col("occurrence_count") / F.sum("occurrence_count").over(Window.partitionBy(by))}).drop("cluster")


def archetype_transitions(members: DataFrame, by: str, names: list[str]) -> DataFrame:
    """In how many of the rows each timeframe's story has a transition, which a row counts once."""
    whole = members.groupBy(by).agg(F.count("*").alias("_all"))
    rows = members.select(by, "reference_timestamp", F.explode(F.array(*(F.struct(F.lit(x).alias("timeframe"), F.col(x).alias("tokens")) for x in names))).alias("_")).select(by, "reference_timestamp", "_.*")
    pairs = transitions(rows).select(by, "reference_timestamp", "timeframe", "from_token", "to_token").distinct()
    return pairs.groupBy(by, "timeframe", "from_token", "to_token").agg(F.count("*").alias("occurrence_count")).join(whole, by).withColumn("occurrence_share", F.col("occurrence_count") / F.col("_all")).drop("_all")


def mean_phases(members: DataFrame, by: str, names: list[str]) -> DataFrame:
    """Mean number of tokens of each archetype's stories, a column for each timeframe."""
    return members.groupBy(by, archetype_name(F.col("cluster")).alias("archetype")).agg(*(F.avg(F.coalesce(F.size(x), F.lit(0))).alias(f"phases_{x}") for x in names))
