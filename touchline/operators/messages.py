"""Routes a table of free-text questions and answers them from the league table.

Routing is one pass of substring tests.  A league table of at most ``ARRAY_ROWS``
teams reaches the messages as one sorted array, so the "which team is mentioned"
test needs neither a join on text nor a shuffle.  A larger one becomes an
inverted index from the rarest three letters of each name to the names: the
different texts meet it letter group by letter group, and only names that share
theirs with a text are looked for in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.labels import one_decimal, team_display
from touchline.operators.compare import with_points_pick
from touchline.operators.league import form_band, table_top
from touchline.runtime import Lookup, checkpointed

# Words that decide what a message asks for, in the order tested.
PREDICTION_WORDS = ("who will win", "predict", "prediction", "outcome", "result")
PAIR_WORDS = ("vs", " v ", "between")
STATS_WORDS = ("stats", "statistics", "performance", "form")
TEAM_WORDS = ("arsenal", "liverpool", "chelsea", "manchester", "man city", "tottenham")
TABLE_WORDS = ("table", "points", "standings", "position")

# Team spellings looked for, in list order, and the name each stands for.
TEAM_SPELLINGS = {
    "arsenal": "Arsenal",
    "chelsea": "Chelsea",
    "liverpool": "Liverpool",
    "man city": "Manchester City",
    "manchester city": "Manchester City",
    "man united": "Manchester United",
    "manchester united": "Manchester United",
    "tottenham": "Tottenham",
    "newcastle": "Newcastle",
    "brighton": "Brighton",
    "aston villa": "Aston Villa",
    "west ham": "West Ham",
}

# Reply texts.
ASK_PREDICTION = (
    "⚽ I can help with match predictions! Try asking 'Who will win between Arsenal and Chelsea?' "
    "or specify two teams for analysis."
)
ASK_TWO_TEAMS = "⚽ Please specify two teams for prediction. Example: 'Who will win between Arsenal and Chelsea?'"
ASK_TEAM = "⚽ Please specify a team name for statistics. Available teams: "
ASK_CLUB = "⚽ I can provide information about Premier League teams. Which team would you like to know about?"
NO_TEAMS = "No team data available."
NO_TABLE = "⚽ I don't have current table data available."
HELP = (
    "⚽ I can help with match predictions, team stats, and recent form. Try asking:\n"
    "• 'Who will win between Team A and Team B?'\n"
    "• 'What are Arsenal's recent stats?'\n"
    "• 'Show me the current table'"
)
# Club -> (text after its points and wins, text without a table row), in the order tested.
CLUB_CARDS = {
    "Arsenal": (
        "Known for their attacking style and Emirates Stadium home advantage.",
        "Historic North London club known for their attacking football and strong home record at Emirates Stadium.",
    ),
    "Liverpool": (
        "Famous for their high-intensity pressing game and Anfield atmosphere.",
        "Historic club with passionate fanbase, known for high-intensity pressing and strong European pedigree.",
    ),
    "Chelsea": (
        "Known for tactical flexibility and strong defensive organization.",
        "West London club known for tactical flexibility, strong defense, and rich history of success.",
    ),
}

#: Teams that a text is tested against one by one.
ARRAY_ROWS = 500
#: Letters of an index key; a shorter name is its own key.
GRAM = 3


def _any_word(text: Column, words: tuple[str, ...]) -> Column:
    found = F.contains(text, F.lit(words[0]))
    for word in words[1:]:
        found = found | F.contains(text, F.lit(word))
    return found


def _lowered(messages: DataFrame) -> DataFrame:
    return messages.withColumn("lowered", F.lower("text"))


def _intent(lowered: Column) -> Column:
    """First matching rule wins.  "form" counts as a statistics word, so it has no rule of its own."""
    return (
        F.when(_any_word(lowered, PREDICTION_WORDS), F.when(_any_word(lowered, PAIR_WORDS), "prediction").otherwise("prediction_help"))
        .when(_any_word(lowered, STATS_WORDS), "team_stats")
        .when(_any_word(lowered, TEAM_WORDS), "team_info")
        .when(_any_word(lowered, TABLE_WORDS), "table")
        .otherwise("default")
    )


def with_intent(messages: DataFrame) -> DataFrame:
    return _lowered(messages).withColumn("intent", _intent(F.col("lowered"))).drop("lowered")


def intent_counts(messages: DataFrame) -> DataFrame:
    return with_intent(messages).groupBy("role", "intent").agg(F.count(F.lit(1)).alias("messages"))


def _found_teams(lowered: Column, spellings: dict[str, str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.contains(lowered, F.lit(s)), name) for s, name in spellings.items()]))


def with_teams(messages: DataFrame, spellings: dict[str, str] = TEAM_SPELLINGS) -> DataFrame:
    """Adds how many spellings occur and the names of the first two in list order."""
    rows = _lowered(messages).withColumn("found", _found_teams(F.col("lowered"), spellings))
    return rows.withColumns({
        "found_teams": F.size("found"),
        "team1": F.get("found", F.lit(0)),
        "team2": F.get("found", F.lit(1)),
    }).drop("lowered", "found")


def _team_row() -> Column:
    """A team of the table; the least of several is the first in table order."""
    return F.struct(
        (-F.col("Points")).alias("rank"), "Team", F.lower("Team").alias("name"),
        *[F.col(c) for c in ("Points", "Wins", "Draws", "Losses")],
        *[F.col(c).cast("bigint").alias(c) for c in ("GoalsFor", "GoalsAgainst")],
    )


def _with_mentioned(rows: DataFrame, stats: Lookup) -> DataFrame:
    """Adds ``hit``: the row of the first team, in table order, whose name occurs in ``text``; else null."""
    if stats.table.limit(ARRAY_ROWS + 1).count() > ARRAY_ROWS:
        return _mentioned_by_index(rows, stats)
    teams = stats.table.agg(F.array_sort(F.collect_list(_team_row())).alias("teams")).scalar()
    rows = rows.withColumn("__teams", teams)
    # The outer one-element array lower-cases a text once instead of once per team.
    found = F.transform(F.array(F.lower("text")), lambda text: F.filter("__teams", lambda t: F.contains(text, t["name"])))
    # A generator computes the hit once; a plain column would be copied into every filter on it.
    return rows.select("*", F.explode_outer(F.slice(found[0], 1, 1)).alias("hit")).drop("__teams")


def _grams(text: Column, size: int) -> Column:
    """The different groups of ``size`` neighbouring letters of a text."""
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    # The outer one-element array takes a text apart once instead of once per group.
    grams = F.transform(F.array(letters), lambda cs: F.transform(
        F.sequence(F.lit(0), F.size(cs) - size), lambda i: F.array_join(F.slice(cs, i + 1, size), "")))
    return F.when(F.char_length(text) >= size, F.array_distinct(grams[0])).otherwise(F.array().cast("array<string>"))


def _name_index(stats: Lookup) -> tuple[Lookup, list[int]]:
    """(gram, hit) with one row a team, its key being the group of its name that fewest names have; and the sizes of groups."""
    names = stats.table.select(_team_row().alias("hit")).where("hit.name <> ''")
    size = F.least(F.char_length("hit.name"), F.lit(GRAM))
    sizes = sorted(r["size"] for r in names.select(size.alias("size")).distinct().collect())
    by_size = F.lit(None).cast("array<string>")
    for n in sizes:
        by_size = F.when(size == n, _grams(F.col("hit.name"), n)).otherwise(by_size)
    keys = checkpointed(names.select("hit", F.explode(by_size).alias("gram")))
    common = Lookup(keys.groupBy("gram").agg(F.count(F.lit(1)).alias("names")))
    counted = common.join(keys, {"gram": "gram"}, {"names": "names"}, "inner")
    rarest = counted.groupBy("hit").agg(F.min(F.struct("names", "gram")).alias("key"))
    return Lookup(rarest.select(F.col("key.gram").alias("gram"), "hit")), sizes


def _mentioned_by_index(rows: DataFrame, stats: Lookup) -> DataFrame:
    """As ``_with_mentioned`` for any number of teams: each different text is looked up once, and found again by its digest."""
    index, sizes = _name_index(stats)
    texts = rows.select(F.lower("text").alias("lower_text")).where(F.col("lower_text").isNotNull()).distinct()
    grams = F.array().cast("array<string>")
    for n in sizes:
        grams = F.concat(grams, _grams(F.col("lower_text"), n))
    met = index.join(texts.select("lower_text", F.explode(grams).alias("gram")), {"gram": "gram"}, {"hit": "hit"}, "inner")
    found = met.where(F.contains("lower_text", F.col("hit.name"))).groupBy(F.md5("lower_text").alias("text_digest")).agg(F.min("hit").alias("hit"))
    return rows.withColumn("text_digest", F.md5(F.lower("text"))).join(found, "text_digest", "left").drop("text_digest")


def _win_rate(row: Column) -> Column:
    return F.try_divide(row["Wins"], F.greatest(row["Wins"] + row["Draws"] + row["Losses"], F.lit(1))) * 100


def _rate_text(row: Column) -> Column:
    return F.format_string("%.1f%% win rate", one_decimal(_win_rate(row)))


def _stats_card(row: Column) -> Column:
    lines = [F.concat(F.lit("⚽ **"), row["Team"], F.lit(" Statistics:**\n"))]
    shown = {"Points": "Points", "Wins": "Wins", "Draws": "Draws", "Losses": "Losses", "Goals For": "GoalsFor", "Goals Against": "GoalsAgainst"}
    lines += [F.concat(F.lit(f"• {title}: "), row[name]) for title, name in shown.items()]
    band = F.initcap(form_band(_win_rate(row), "needs improvement"))
    lines.append(F.concat(F.lit("\n**Current Form:** "), band, F.lit(" ("), _rate_text(row), F.lit(")")))
    return F.when(row.isNotNull(), F.concat_ws("\n", *lines))


def _form_card(row: Column) -> Column:
    games = row["Wins"] + row["Draws"] + row["Losses"]
    return F.concat(
        F.lit("⚽ **"), row["Team"], F.lit("'s Form:** "), F.initcap(form_band(_win_rate(row), "inconsistent")),
        F.lit(" - "), row["Wins"], F.lit(" wins in "), games, F.lit(" matches ("), _rate_text(row),
        F.lit("). Current points: "), row["Points"],
    )


def message_team_stats(messages: DataFrame, stats: Lookup) -> DataFrame:
    """Messages that mention a team of the table, with that team's stats and form cards."""
    rows = _with_mentioned(messages, stats)
    rows = rows.where(F.col("hit").isNotNull())
    return rows.select(
        *[c for c in messages.columns if c != "text"],
        F.col("hit.Team").alias("Team"),
        _stats_card(F.col("hit")).alias("stats_card"), _form_card(F.col("hit")).alias("form_card"),
    )


def _table_text(stats: Lookup) -> Column:
    """The first five places as one text; null for an empty table."""
    line = F.format_string("%d. %s: %d points (%s)\n", "Rank", "Team", "Points", "Record")
    lines = table_top(stats.table, 5).select("Rank", line.alias("line"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("Rank", "line"))), lambda r: r["line"])
    text = F.when(F.count(F.lit(1)) > 0, F.concat(
        F.lit("⚽ **Current Top 5 Teams:**\n\n"), F.array_join(ordered, ""),
        F.lit("\nWould you like detailed stats for any specific team?"),
    ))
    return lines.agg(text.alias("text")).scalar()


def _team_names_text(stats: Lookup, n: int = 5) -> Column:
    names = table_top(stats.table, n).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("Rank", "Team"))), lambda r: r["Team"]), ", ").alias("names"),
        F.count(F.lit(1)).alias("n"),
    )
    return names.select(F.when(F.col("n") > 0, F.concat(F.lit(ASK_TEAM), "names")).otherwise(NO_TEAMS).alias("text")).scalar()


def _prediction_text() -> Column:
    header = F.concat(F.lit("⚽ **Match Prediction: "), "team1", F.lit(" vs "), "team2", F.lit("**\n\n"))

    def record(side: str) -> Column:
        return F.concat(F.lit("• "), f"team{side}", F.lit(": "), f"Points_{side}", F.lit(" points, "), f"Wins_{side}", F.lit(" wins\n"))

    known = F.concat(
        header, F.lit("**Recent Performance:**\n"), record("1"), record("2"),
        F.lit("\n**Prediction:** "), "pick", F.lit(" ("), "confidence", F.lit("% confidence)\n\n"),
        F.lit("**Reasoning:** Based on current points and recent form analysis."),
    )
    unknown = F.concat(
        header, F.lit("**Prediction:** Close match expected\n\n"),
        F.lit("**Reasoning:** Both teams have competitive records. Use the AI Predictions page for detailed statistical analysis."),
    )
    return F.when(F.col("team2").isNull(), ASK_TWO_TEAMS).when(F.col("confidence").isNotNull(), known).otherwise(unknown)


def _club_text(lowered: Column) -> Column:
    reply = F.lit(ASK_CLUB)
    for club, (with_row, without_row) in reversed(CLUB_CARDS.items()):
        points, wins = F.col("__clubs")[f"{club}_Points"], F.col("__clubs")[f"{club}_Wins"]
        card = F.when(points.isNotNull(), F.concat(
            F.lit(f"⚽ **{club}:** Currently "), points, F.lit(" points with "), wins, F.lit(f" wins. {with_row}"),
        )).otherwise(f"⚽ **{club}:** {without_row}")
        reply = F.when(F.contains(lowered, F.lit(club.lower())), card).otherwise(reply)
    return reply


def answers(messages: DataFrame, stats: Lookup) -> DataFrame:
    """Every message with its intent and the reply to it.

    Team names are matched in display form on both sides, so "man city" in a
    message finds the table's "Man City".
    """
    display = Lookup(stats.table.withColumn("Team", team_display(F.col("Team"))))
    rows = with_teams(with_intent(messages))
    for side in ("1", "2"):
        rows = display.join(rows, {f"team{side}": "Team"}, {c: f"{c}_{side}" for c in ("Points", "Wins")})
    rows = with_points_pick(rows)
    cells = [F.max(F.when(F.col("Team") == club, F.col(c))).alias(f"{club}_{c}") for club in CLUB_CARDS for c in ("Points", "Wins")]
    rows = rows.withColumn("__clubs", stats.table.agg(F.struct(*cells).alias("clubs")).scalar())
    rows = _with_mentioned(_lowered(rows), stats)
    intent = F.col("intent")
    reply = (
        F.when(intent == "prediction", _prediction_text())
        .when(intent == "prediction_help", ASK_PREDICTION)
        .when(intent == "team_stats", F.coalesce(_stats_card(F.col("hit")), _team_names_text(stats)))
        .when(intent == "team_info", _club_text(F.col("lowered")))
        .when(intent == "table", F.coalesce(_table_text(stats), F.lit(NO_TABLE)))
        .otherwise(HELP)
    )
    return rows.select(*[c for c in messages.columns if c != "text"], "intent", reply.alias("reply"))
