"""Hand-made rows for the cases the generated tables do not reach."""

import json
import math
import os
import random
import subprocess
import sys
from datetime import date
from pathlib import Path

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from touchline.functions.labels import team_display
from touchline.functions.match_columns import feature_vectors, with_match_features
from touchline.functions.parsing import na_to_null, parse_date, to_number
from touchline.functions.validation import range_errors, stat_errors, with_numbers
from touchline.operators import clean, compare, envelopes, feature_stats, league, messages, metrics, scoring, splits, streaks, summary
from touchline.runtime import Lookup, scratch_path
from touchline.schema import FULL_FEATURES, MATCH_COLUMNS, MATCH_STATS, MEASURES, TEAM_STATS_SCHEMA
from touchline.sources import csv_files, tables
from touchline.streaming.live_table import LiveTable, start_live_table
from touchline.streaming.score_stream import fixture_stream

# Rows of a published league table.
GOLDEN = [
    ("Man City", 363, 243, 60, 60, 812.0, 325.0, 487.0, 789, 66.94214876033058),
    ("Man United", 363, 207, 84, 72, 647.0, 364.0, 283.0, 705, 57.02479338842975),
    ("Chelsea", 363, 207, 79, 77, 658.0, 369.0, 289.0, 700, 57.02479338842975),
    ("Liverpool", 362, 199, 86, 77, 693.0, 391.0, 302.0, 683, 54.972375690607734),
    ("Arsenal", 363, 196, 83, 84, 674.0, 418.0, 256.0, 671, 53.994490358126725),
    ("Blackpool", 38, 10, 9, 19, 55.0, 78.0, -23.0, 39, 26.31578947368421),
    ("Birmingham", 38, 8, 15, 15, 37.0, 58.0, -21.0, 39, 21.052631578947366),
]


def match(i, home, away, ftr, day=date(2001, 8, 1), **values):
    row = {c: 0.0 for c in MEASURES} | {k: float(v) for k, v in values.items()}
    row |= {"Date": day, "HomeTeam": home, "AwayTeam": away, "FTR": ftr, "HTR": "D"}
    return (str(i), *[row[c] for c in MATCH_COLUMNS])


def matches(spark, *rows):
    kinds = {c: "double" for c in MEASURES} | {"Date": "date"}
    ddl = "match_id string, " + ", ".join(f"`{c}` {kinds.get(c, 'string')}" for c in MATCH_COLUMNS)
    return spark.createDataFrame(list(rows), ddl)


@pytest.fixture(scope="module")
def golden(spark):
    return Lookup(spark.createDataFrame(GOLDEN, TEAM_STATS_SCHEMA))


def test_unknown_result_is_a_loss_and_self_match_counts_twice(spark):
    table = league.team_stats(matches(
        spark, match(1, "A", "B", "X"), match(2, "A", "A", "H", FTHG=2, FTAG=1),
    )).collect()
    rows = {r["Team"]: r for r in table}
    assert (rows["B"]["Matches"], rows["B"]["Losses"]) == (1, 1)
    assert (rows["A"]["Matches"], rows["A"]["Wins"], rows["A"]["Losses"], rows["A"]["GoalsFor"]) == (3, 1, 2, 3.0)


def test_golden_rows_keep_the_table_identities():
    for team, played, wins, draws, losses, gf, ga, gd, points, rate in GOLDEN:
        assert (points, losses, gd) == (3 * wins + draws, played - wins - draws, gf - ga), team
        assert math.isclose(rate, 100 * wins / played)


def test_parsing(spark):
    values = ["2001-02-03", "03/02/2001", "03/02/01", "n/a", "2001-13-40", None]
    got = spark.createDataFrame([(v,) for v in values], "v string").select(parse_date(F.col("v"))).collect()
    assert [r[0] for r in got] == [date(2001, 2, 3)] * 3 + [None] * 3
    numbers = spark.createDataFrame([(v,) for v in (" 7 ", "1e2", "x", "12d", "0x1p3", "")], "v string")
    assert [r[0] for r in numbers.select(to_number(F.col("v"))).collect()] == [7.0, 100.0, None, None, None, None]
    names = spark.createDataFrame([("NA",), ("Arsenal",)], "v string").select(na_to_null(F.col("v"))).collect()
    assert [r[0] for r in names] == [None, "Arsenal"]


def test_cleaning_defaults_and_missing_columns(spark):
    raw = spark.createDataFrame([("A", "B", "nan", None), ("A", None, "1", "H")], "HomeTeam string, AwayTeam string, FTHG string, FTR string")
    row, = clean.clean_matches(raw).collect()
    assert (row["FTHG"], row["FTR"], row["HTR"], row["Date"], row["AR"]) == (0.0, "D", "D", None, 0.0)


def test_training_and_scoring_features_differ_only_by_missing_date(spark):
    dated = matches(spark, match(1, "A", "B", "H", HS=10, HST=4))
    assert feature_vectors(dated, "train").collect() == feature_vectors(dated, "score").collect()
    undated = matches(spark, match(1, "A", "B", "H", day=None))
    train, score = (feature_vectors(undated, m).first() for m in ("train", "score"))
    assert [train[c] for c in ("Month", "DayOfWeek", "IsWeekend")] == [0.0, 0.0, 0.0]
    assert [score[c] for c in ("Month", "DayOfWeek", "IsWeekend")] == [9.0, 5.0, 1.0]
    assert len(FULL_FEATURES) == 34 and len(with_match_features(dated).columns) == 31


@pytest.mark.parametrize("difference, code", [
    (15.1, "H"), (15.0, "H"), (5.1, "H"), (5.0, "D"), (0.0, "D"), (-5.0, "D"), (-5.1, "A"), (-10.0, "A"), (-10.1, "A"),
])
def test_band_edges(spark, difference, code):
    row = spark.range(1).select(scoring.band(F.lit(difference)).alias("b")).first()["b"]
    assert row["prediction"] == code
    assert row["prob_H"] == {15.1: 0.65, 15.0: 0.5, -10.0: 0.25, -10.1: 0.2}.get(difference, row["prob_H"])


def test_predicted_goals_round_half_to_even_and_never_below_zero(spark):
    values = [(0.0, 5.0, 0), (1.0, 5.0, 2), (2.0, 5.0, 2), (-3.0, 0.0, 0)]
    frame = spark.createDataFrame(values, "g double, s double, want bigint")
    assert all(r["got"] == r["want"] for r in frame.withColumn("got", scoring.predicted_goals(F.col("g"), F.col("s"))).collect())


def test_one_unknown_team_gives_both_defaults(spark, golden):
    rated = scoring.rate_fixtures(matches(spark, match(1, "Man City", "Nobody", "H")), golden).first()
    assert (rated["home_Points"], rated["away_Points"], rated["strength_difference"]) == (60, 55, 10.0)


def test_validation_messages(spark):
    values = {c: "1" for c in MATCH_STATS} | {"HS": None, "AS": "x", "HST": "-1", "AST": "21", "HTHG": "11", "HTAG": None}
    row = with_numbers(spark.createDataFrame([values], ", ".join(f"`{c}` string" for c in values)))
    got = row.select(stat_errors().alias("s"), range_errors().alias("r")).first()
    assert got["s"] == ["Missing field: HS", "AS must be a number", "HST cannot be negative"]
    assert got["r"] == ["HST out of range", "AST out of range", "HTHG out of range"]


def test_accepted_and_rejects_split_the_requests(spark):
    base = {c: "1" for c in MATCH_STATS} | {"HTHG": None, "HTAG": None, "HomeTeam": "A", "AwayTeam": "B"}
    rows = [base | {"match_id": "ok"}, base | {"match_id": "same", "AwayTeam": "A"}, base | {"match_id": "blank", "HomeTeam": " "},
            base | {"match_id": "nan", "HS": "nan"}, base | {"match_id": "big", "HS": "51"}]
    requests = spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in rows[0]))
    assert {r["match_id"] for r in envelopes.rejects(requests).collect()} >= {"same", "blank", "big"}
    assert [r["match_id"] for r in envelopes.accepted(requests).collect()] == ["ok"]


def test_json_carries_no_nan_and_no_blanks(spark):
    frame = spark.createDataFrame([("1", float("nan"), "", ["", "x"])], "id string, v double, t string, l array<string>")
    assert json.loads(envelopes.pruned_json(frame, "id").first()["json"]) == {"l": ["", "x"]}


def test_comparisons_on_golden_rows(spark, golden):
    pairs = spark.createDataFrame([("Blackpool", "Birmingham"), ("Man City", "Arsenal"), ("Man City", "Nobody")], "team1 string, team2 string")
    leaders = {r["team1"]: r["leader"] for r in compare.team_comparison(pairs, golden).collect()}
    assert leaders == {"Blackpool": "Equal Points", "Man City": "Man City Leads"}
    picks = {(r["team1"], r["team2"]): (r["pick"], r["confidence"]) for r in compare.points_pick(pairs, golden).collect()}
    assert picks[("Blackpool", "Birmingham")] == ("Draw", 45)
    assert picks[("Man City", "Arsenal")] == ("Man City", 80)
    assert picks[("Man City", "Nobody")] == ("Close match expected", None)


def test_head_to_head_without_wins_is_null(spark):
    stats = Lookup(spark.createDataFrame([("A", 1, 0, 1, 0, 0.0, 0.0, 0.0, 1, 0.0), ("B", 1, 0, 1, 0, 0.0, 0.0, 0.0, 1, 0.0)], TEAM_STATS_SCHEMA))
    row = compare.head_to_head(spark.createDataFrame([("A", "B")], "team1 string, team2 string"), stats).first()
    assert (row["team1_share"], row["draw_share"], row["team2_share"]) == (None, 25, None)


def test_form_bands_and_display_names(spark, golden):
    bands = {r["Team"]: r["StatsForm"] for r in league.form_bands(golden.table).collect()}
    assert (bands["Man City"], bands["Arsenal"], bands["Blackpool"]) == ("excellent", "good", "needs improvement")
    assert spark.range(1).select(team_display(F.lit("Man City"))).first()[0] == "Manchester City"


def test_salted_lookup_equals_broadcast(spark, golden):
    salted = Lookup(golden.table, max_rows=1, salts=4)
    assert golden.small and not salted.small
    facts = spark.range(200).select("id", F.when(F.col("id") < 70, "Man City").when(F.col("id") < 100, "Arsenal").otherwise("Nobody").alias("t"))
    left, right = (sorted(x.join(facts, {"t": "Team"}, {"Points": "p"}).collect()) for x in (golden, salted))
    assert left == right and len(left) == 200


def test_histogram_edges(spark):
    rows = [match(i, "A", "B", "H", FTHG=g) for i, g in enumerate((0, 6, 7, 8))]
    bins = {(r["series"], r["bin"]): r["n"] for r in summary.goals_histogram(matches(spark, *rows)).collect()}
    assert (bins[("FTHG", 0)], bins[("FTHG", 5)], bins[("FTHG", 6)]) == (1, 0, 2)


def test_constant_column_has_no_correlation_and_no_score(spark):
    rows = matches(spark, match(1, "A", "B", "H", HS=1, AS=2), match(2, "A", "B", "A", HS=2, AS=4), match(3, "B", "A", "A", HS=3, AS=6))
    pairs = {(r["x"], r["y"]): r["r"] for r in summary.correlation_pairs(rows).collect()}
    assert pairs[("AS", "HS")] == 1.0 and pairs[("HC", "HS")] is None and len(pairs) == 120
    scores = {r["feature"]: r["score"] for r in feature_stats.feature_scores(rows, ("HS", "HC"), "FTR", 1).collect()}
    assert scores["HC"] is None and scores["HS"] is not None


def brute_streaks(rows):
    """Row-by-row count of wins after wins, in digest order within a day."""
    import hashlib

    teams = {}
    for r in rows:
        for side, (team, code) in enumerate(((r[2], "H"), (r[3], "A"))):
            key = (r[1] is None, r[1] or date.min, hashlib.md5(r[0].encode()).hexdigest(), side)
            teams.setdefault(team, []).append((key, r[9] == code))
    out = {}
    for team, seq in teams.items():
        won = [w for _, w in sorted(seq)]
        after = [b for a, b in zip(won, won[1:]) if a]
        out[team] = (len(won), len(after), sum(after))
    return out


def test_streaks_against_brute_force(spark):
    rows = [match(i, "AB"[i % 2], "C" if i % 7 else "A", "HAD"[i * i % 3], day=None if i % 11 == 0 else date(2001, 1, 1 + i % 3)) for i in range(300)]
    want = brute_streaks(rows)
    for r in streaks.streak_continuation(matches(spark, *rows)).collect():
        played, after, wins = want[r["Team"]]
        assert (r["matches"], r["after_win"]) == (played, after)
        assert r["win_rate_after_win"] == (wins / after if after else None)


def test_stratified_split_is_exact_and_keeps_copies_together(spark):
    unique = spark.range(1000).select(F.col("id").cast("string").alias("match_id"), F.when(F.col("id") % 3 == 0, "H").otherwise("A").alias("FTR"))
    counts = {r["label"]: r["test_rows"] for r in splits.split_counts(splits.with_stratified_split(unique, "FTR"), "FTR").collect()}
    assert counts == {"H": 67, "A": 134}
    copies = unique.unionByName(unique.where("match_id = '1'").select(F.explode(F.sequence(F.lit(1), F.lit(600))).alias("_"), "*").drop("_"))
    sides = splits.with_stratified_split(copies, "FTR").where("match_id = '1'").select("is_test").distinct().count()
    assert sides == 1


def test_report_with_an_unpredicted_class(spark):
    scored = spark.createDataFrame([("H", "H"), ("A", "H"), ("D", "D")], "FTR string, prediction string")
    rows = {r["class"]: r for r in metrics.classification_report(scored).collect()}
    assert (rows["A"]["precision"], rows["A"]["recall"], rows["A"]["support"]) == (0.0, 0.0, 1)
    assert round(rows["accuracy"]["f1"], 6) == 0.666667


def ask(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")


def test_replies(spark, golden):
    asked = ask(spark, "Who will win between Arsenal and Chelsea?", "Predict the cup", "Arsenal form", "stats please", "Show the table", "hello", "chelsea news")
    replies = {r["id"]: (r["intent"], r["reply"]) for r in messages.answers(asked, golden).collect()}
    assert "**Prediction:** Chelsea (80% confidence)" in replies[0][1]
    assert replies[1] == ("prediction_help", messages.ASK_PREDICTION)
    assert "• Points: 671\n" in replies[2][1] and replies[2][1].endswith("Good (54.0% win rate)")
    assert replies[3][1] == messages.ASK_TEAM + "Man City, Man United, Chelsea, Liverpool, Arsenal"
    assert "1. Man City: 789 points (243W-60D-60L)\n" in replies[4][1]
    assert replies[5] == ("default", messages.HELP)
    assert replies[6][1].startswith("⚽ **Chelsea:** Currently 700 points with 207 wins.")


def test_mentions_do_not_depend_on_the_index(spark, golden, monkeypatch):
    texts = ["stats: arsenal, man city", "form of birmingham and blackpool", "nothing", None, "", "CHELSEA!", "ar", "stats: arsenal, man city"]
    asked = ask(spark, *texts)
    one, replies = sorted(messages.message_team_stats(asked, golden).collect()), sorted(messages.answers(asked, golden).collect())
    monkeypatch.setattr(messages, "ARRAY_ROWS", 2)
    assert sorted(messages.message_team_stats(asked, golden).collect()) == one
    assert sorted(messages.answers(asked, golden).collect()) == replies
    assert [r["Team"] for r in one] == ["Man City", "Birmingham", "Chelsea", "Man City"]


def test_mentions_of_fifty_thousand_names(spark):
    rng = random.Random(5)
    parts = ["ab", "an", "bor", "da", "el", "united", "é", "ö", "st. ", "x", "-", " city", "wo", "lin", "tra", "qu"]
    names = {"q", "zz", "⚽ fc", "united"}
    while len(names) < 50_000:
        names.add("".join(rng.choice(parts) for _ in range(rng.randint(2, 6))).strip() or "q")
    names = sorted(names)
    points = {n: rng.randrange(90) for n in names}
    table = Lookup(spark.createDataFrame([(n, 3, 1, 1, 1, 5.0, 4.0, 1.0, points[n], 33.0) for n in names], TEAM_STATS_SCHEMA))
    texts = [f"how is {rng.choice(names).upper()} doing" for _ in range(60)] + ["zzz", "q", "⚽ FC", "", None, "hmm", "Ö" * 40, "".join(rng.choice(parts) for _ in range(2000))]
    got = {r["id"]: r["Team"] for r in messages.message_team_stats(ask(spark, *texts), table).collect()}
    for i, text in enumerate(texts):
        hits = [n for n in names if n in (text or "").lower()]
        assert got.get(i) == (min(hits, key=lambda n: (-points[n], n)) if hits else None), text


def test_live_table_equals_batches_in_order(spark, tmp_path):
    rng, teams = random.Random(2), "ABCDEF"
    batches = [[match(100 * b + i, rng.choice(teams[: 3 + b]), rng.choice(teams), rng.choice(["H", "D", "A", None]), FTHG=rng.randrange(4), FTAG=rng.randrange(4)) for i in range(40)] for b in range(3)]
    live, folder = LiveTable(spark, str(tmp_path / "live")), str(tmp_path / "in")
    for rows in batches:
        matches(spark, *rows).coalesce(1).write.mode("append").parquet(folder)
        stream = fixture_stream(spark, folder, matches(spark, *rows).schema)
        start_live_table(stream, live.root, str(tmp_path / "log")).awaitTermination()

    def state():
        return [sorted(live.stats(b).collect()) for b in range(3)], sorted(tuple(r.asDict().items()) for r in live.scores().collect())

    tables_, scores = state()
    for b in range(3):
        before = matches(spark, *[r for rows in batches[: b + 1] for r in rows]).where("FTR IS NOT NULL")
        assert tables_[b] == sorted(league.team_stats(before).collect())
        want = scoring.score_fixtures(matches(spark, *batches[b]).where("FTR IS NULL"), Lookup(league.team_stats(before)))
        assert [s for s in scores if dict(s)["batch"] == b] == sorted((*r.asDict().items(), ("batch", b)) for r in want.collect())
    live.take(matches(spark, *batches[2]), 2)  # as after a failure
    live.take(matches(spark, *batches[1]), 1)
    assert state() == (tables_, scores)


def test_csv_scan_skips_bad_files_and_keeps_names(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Date,HomeTeam,AwayTeam,HS,HS,Extra\n2001-01-01,A,B,5,9,z\n")
    (tmp_path / "b.csv").write_text("﻿AwayTeam,HomeTeam\nD,C\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "other.csv").write_text("x,y\n1,2\n")
    scan = csv_files.scan_season_files(spark, str(tmp_path))
    rows = {(r["HomeTeam"], r["AwayTeam"], r["HS"]) for r in scan.matches.collect()}
    assert rows == {("A", "B", "5"), ("C", "D", None)}
    assert {r["path"].rsplit("/", 1)[1] for r in scan.rejected.collect()} == {"empty.csv", "other.csv"}


def _names(scan):
    return {(r["path"].rsplit("/", 1)[1], r["record"], r["error"]) for r in scan.rejected.collect()}


def test_csv_scan_of_many_files_and_headers(spark, tmp_path):
    headers = [list(MATCH_COLUMNS), list(reversed(MATCH_COLUMNS)), [c for c in MATCH_COLUMNS if c != "HF"], ["Div", *MATCH_COLUMNS, "Referee"], ["HomeTeam", "HomeTeam", "Date"]]
    want = set()
    for i in range(300):
        names, folder = headers[i % 5], tmp_path / f"season={i % 7}"
        folder.mkdir(exist_ok=True)
        rows = [[f"{name}-{i}-{line}" if name != "Referee" else '"Smith, J"' for name in names] for line in range(3)]
        (folder / f"file {i}.csv").write_text("\n".join(",".join(r) for r in [names, *rows]) + "\n")
        want |= {tuple(r[names.index(c)] if c in names else None for c in MATCH_COLUMNS) for r in rows}
    scan = csv_files.scan_season_files(spark, str(tmp_path))
    got = [tuple(r) for r in scan.matches.collect()]
    assert len(got) == 900 and set(got) == want and _names(scan) == set()
    assert scan.matches.columns == list(MATCH_COLUMNS) and scan.files.count() == 300


def test_csv_scan_names_all_that_it_leaves_out(spark, tmp_path):
    (tmp_path / "good.csv").write_text("HomeTeam,AwayTeam,HS\n\nA,B,1\nC,D\n\"E, F\",G,2\n")
    (tmp_path / "long.csv").write_text("HomeTeam,AwayTeam\nH,I\nJ,K,L\n")
    (tmp_path / "quote.csv").write_text('HomeTeam,AwayTeam\nM,"N\nO,P\n')
    (tmp_path / "latin.csv").write_bytes("HomeTeam,AwayTeam\nMálaga,Q\n".encode("latin-1"))
    (tmp_path / "blank.csv").write_text("\n\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "other.csv").write_text("x,y\n1,2\n")
    (tmp_path / "_hidden.csv").write_text("HomeTeam\nZ\n")
    files = {
        ("latin.csv", None, "the text is not UTF-8"), ("blank.csv", None, "no header: all lines are blank"),
        ("empty.csv", None, "no header: the file is empty"), ("other.csv", None, "no known column in the header")}
    good = {("A", "B", "1"), ("C", "D", None), ("E, F", "G", "2")}

    def teams(scan):
        return {(r["HomeTeam"], r["AwayTeam"], r["HS"]) for r in scan.matches.collect()}

    scan = csv_files.scan_season_files(spark, str(tmp_path))
    assert teams(scan) == good
    assert _names(scan) == files | {("long.csv", None, "a line has 3 fields, the header 2"), ("quote.csv", None, "a quote is not closed in its line")}
    scan = csv_files.scan_season_files(spark, str(tmp_path), long_rows="row", short_rows="reject")
    assert teams(scan) == good - {("C", "D", None)} | {("H", "I", None), ("O", "P", None)}
    assert _names(scan) == files | {
        ("long.csv", "J,K,L", "3 fields instead of 2"), ("quote.csv", 'M,"N', "a quote is not closed"), ("good.csv", "C,D", "2 fields instead of 3")}


def test_csv_scan_names_a_file_that_breaks_in_mid_read(spark, tmp_path):
    lines = spark.range(40000).select(F.format_string("team %d,other,%d", "id", "id").alias("value"))
    for name in ("broken", "whole"):
        spark.createDataFrame([("HomeTeam,AwayTeam,HS",)], "value string").union(lines).coalesce(1).write.text(str(tmp_path / name))
    file = next((tmp_path / "broken").glob("part-*.txt"))
    data = bytearray(file.read_bytes())
    data[400_000:400_010] = b"~" * 10  # its checksums, written beside it, no longer fit
    file.write_bytes(bytes(data))
    scan = csv_files.scan_season_files(spark, str(tmp_path), suffix=".txt")
    assert scan.matches.count() == 40000
    (row,) = scan.rejected.collect()
    assert "broken" in row["path"] and row["error"].startswith("reading broke off after") and row["error"].endswith(f"of {len(data)} bytes")


def test_csv_scan_without_any_file(spark, tmp_path):
    (tmp_path / "notes.md").write_text("x")
    scan = csv_files.scan_season_files(spark, str(tmp_path))
    assert scan.matches.count() == 0 and scan.matches.columns == list(MATCH_COLUMNS) and scan.rejected.count() == 0


def test_first_path_else_fallback(spark, tmp_path):
    there = tables.write_table(spark.range(3), str(tmp_path / "there"))
    missing = str(tmp_path / "missing")
    assert tables.read_table(spark, missing, there).count() == 3 and tables.read_table(spark, there, missing).count() == 3
    with pytest.raises(AnalysisException):
        tables.read_table(spark, missing)


BARE_SESSION = """
from touchline.session import local_session
from touchline.runtime import Lookup, scratch_path, shared_folder, written_table
spark = local_session("bare", 2, "1g")
assert spark.conf.get("spark.checkpoint.dir", None) is None
print(written_table(spark.range(5), "x").count(), Lookup(spark.range(7)).table.count(), shared_folder(spark) == shared_folder(spark))
"""


def test_a_session_without_checkpoint_folder(tmp_path):
    root = Path(__file__).resolve().parent.parent
    env = {k: v for k, v in os.environ.items() if not k.startswith("SPARK_")} | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": str(root)}
    done = subprocess.run([sys.executable, "-c", BARE_SESSION], env=env, capture_output=True, text=True, timeout=180)
    assert done.stdout.split() == ["5", "7", "True"], done.stderr[-2000:]


NO_LIBRARY = """
import sys
sys.modules["public_tokenizers"] = None
import __spark_entry__
names = __spark_entry__.queries()
print("league_table" in names, any(name.startswith("op") for name in names))
"""


def test_queries_without_the_libraries_of_the_optional_ones():
    root = Path(__file__).resolve().parent.parent
    done = subprocess.run([sys.executable, "-c", NO_LIBRARY], env=os.environ | {"PYTHONPATH": str(root)}, capture_output=True, text=True, timeout=60)
    assert done.stdout.split() == ["True", "False"], done.stderr[-2000:]


def test_missing_team_stats_read_as_an_empty_table(spark):
    assert tables.read_team_stats(spark, scratch_path(spark, "nothing")).schema.names == TEAM_STATS_SCHEMA.names


def test_scores_do_not_depend_on_the_join_used(spark, golden):
    rows = matches(spark, *[match(i, "Man City" if i % 3 else "Nobody", "Arsenal", "H", HS=i, HTHG=i % 2) for i in range(50)])
    salted = Lookup(golden.table, max_rows=1, salts=4)
    assert sorted(scoring.score_fixtures(rows, golden).collect()) == sorted(scoring.score_fixtures(rows, salted).collect())
