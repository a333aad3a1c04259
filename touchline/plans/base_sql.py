"""SQL of the derived tables every check starts from, and small SQL builders."""

from __future__ import annotations

from touchline.functions.parsing import NA_TOKENS
from touchline.schema import MATCH_COLUMNS, MEASURES


def q(name: str) -> str:
    return f'"{name}"'


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def columns(names, prefix: str = "") -> str:
    return ", ".join(prefix + q(n) for n in names)


KEYED = f"""
base AS (
  SELECT l_orderkey AS ok, l_partkey AS pk, l_suppkey AS sk, l_linenumber::BIGINT AS ln, l_quantity::BIGINT AS q,
         c_nationkey AS hn, s_nationkey AS an, h.n_name AS "HomeTeam", a.n_name AS "AwayTeam",
         CAST(l_shipdate AS DATE) AS "Date", l_orderkey*7 + l_linenumber*13 + l_partkey*3 + l_suppkey AS k
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN supplier ON l_suppkey = s_suppkey
       JOIN nation h ON c_nationkey = h.n_nationkey JOIN nation a ON s_nationkey = a.n_nationkey
  WHERE c_nationkey <> s_nationkey),
shots AS (
  SELECT *, 6 + k%11 + hn%4 AS hs, 5 + (pk*5+ok)%10 + an%4 AS as_, (q+hn)%3 AS hthg, (pk+q)%3 AS htag FROM base),
target AS (SELECT *, least(hs, 1+q%7) AS hst, least(as_, 1+(q+pk)%6) AS ast FROM shots),
goals AS (
  SELECT *, hthg + (CASE WHEN hst>=5 THEN 1 ELSE 0 END) + k%2 AS fthg,
         htag + (CASE WHEN ast>=5 THEN 1 ELSE 0 END) + ok%2 AS ftag FROM target),
keyed AS (
  SELECT k, concat_ws('-', ok, ln, pk, sk) AS match_id, "Date", "HomeTeam", "AwayTeam",
    hthg::DOUBLE AS "HTHG", htag::DOUBLE AS "HTAG",
    CASE WHEN hthg>htag THEN 'H' WHEN hthg<htag THEN 'A' ELSE 'D' END AS "HTR",
    fthg::DOUBLE AS "FTHG", ftag::DOUBLE AS "FTAG",
    CASE WHEN fthg>ftag THEN 'H' WHEN fthg<ftag THEN 'A' ELSE 'D' END AS "FTR",
    hs::DOUBLE AS "HS", as_::DOUBLE AS "AS", hst::DOUBLE AS "HST", ast::DOUBLE AS "AST",
    (pk%11)::DOUBLE AS "HC", ((pk+sk)%10)::DOUBLE AS "AC", (6+ok%13)::DOUBLE AS "HF", (6+(ok+q)%13)::DOUBLE AS "AF",
    (ok%5)::DOUBLE AS "HY", ((pk+q)%5)::DOUBLE AS "AY",
    (CASE WHEN k%13=0 THEN 1 ELSE 0 END)::DOUBLE AS "HR", (CASE WHEN (k+q)%11=0 THEN 1 ELSE 0 END)::DOUBLE AS "AR"
  FROM goals)"""

MATCHES = KEYED + f""",
matches AS (SELECT match_id, {columns(MATCH_COLUMNS)} FROM keyed)"""


def _raw(name: str) -> str:
    special = {
        "Date": "CASE WHEN k%97=0 THEN 'n/a' WHEN year(\"Date\")%2=1 THEN strftime(\"Date\",'%d/%m/%Y') "
                "ELSE strftime(\"Date\",'%Y-%m-%d') END",
        "AwayTeam": "CASE WHEN k%41<>0 THEN \"AwayTeam\" END",
        "HS": "CASE WHEN k%23=0 THEN NULL WHEN k%29=0 THEN 'x' ELSE \"HS\"::BIGINT::VARCHAR END",
        "FTR": "CASE WHEN k%31<>0 THEN \"FTR\" END",
        "HTR": "CASE WHEN k%37=0 THEN 'NA' ELSE \"HTR\" END",
    }
    if name in special:
        return special[name]
    return f"{q(name)}::BIGINT::VARCHAR" if name in MEASURES else q(name)


RAW = KEYED + f""",
raw AS (SELECT match_id, k, {', '.join(f'{_raw(c)} AS {q(c)}' for c in MATCH_COLUMNS)} FROM keyed)"""


def _known(name: str) -> str:
    tokens = ", ".join(text(t) for t in NA_TOKENS)
    return f"(CASE WHEN trim({q(name)}) NOT IN ({tokens}) THEN {q(name)} END)"


def _clean(name: str) -> str:
    if name == "Date":
        return f"coalesce(try_strptime({_known(name)}, '%Y-%m-%d'), try_strptime({_known(name)}, '%d/%m/%Y'))::DATE"
    if name in MEASURES:
        return f"coalesce(try_cast({_known(name)} AS DOUBLE), 0.0::DOUBLE)"
    if name in ("HTR", "FTR"):
        return f"coalesce({_known(name)}, 'D')"
    return _known(name)


CLEAN_COLUMNS = ", ".join(f"{_clean(c)} AS {q(c)}" for c in MATCH_COLUMNS)

CLEAN = RAW + f""",
cleaned AS (SELECT * FROM (SELECT match_id, k, {CLEAN_COLUMNS} FROM raw)
            WHERE "HomeTeam" IS NOT NULL AND "AwayTeam" IS NOT NULL)"""


def _request(name: str) -> str:
    special = {
        "HS": "CASE WHEN k%23=0 THEN NULL WHEN k%29=0 THEN 'x' ELSE \"HS\"::BIGINT::VARCHAR END",
        "AS": "CASE WHEN k%19=0 THEN '61' ELSE \"AS\"::BIGINT::VARCHAR END",
        "HC": "CASE WHEN k%43=0 THEN '-3' ELSE \"HC\"::BIGINT::VARCHAR END",
        "HTAG": "CASE WHEN k%47=0 THEN '11' ELSE \"HTAG\"::BIGINT::VARCHAR END",
        "AR": "CASE WHEN k%53=0 THEN '' ELSE \"AR\"::BIGINT::VARCHAR END",
    }
    return special.get(name, f"{q(name)}::BIGINT::VARCHAR")


REQUEST_MEASURES = tuple(c for c in MEASURES if c not in ("FTHG", "FTAG"))

REQUESTS = KEYED + f""",
requests AS (SELECT match_id, CASE WHEN k%97<>0 THEN "Date" END AS "Date",
    CASE WHEN k%59=0 THEN ' ' ELSE "HomeTeam" END AS "HomeTeam",
    CASE WHEN k%41=0 THEN NULL WHEN k%61=0 THEN "HomeTeam" ELSE "AwayTeam" END AS "AwayTeam",
    CASE WHEN k%37=0 THEN 'X' WHEN k%31=0 THEN NULL ELSE "HTR" END AS "HTR",
    {', '.join(f'{_request(c)} AS {q(c)}' for c in REQUEST_MEASURES)}
  FROM keyed)"""


def sides(source: str, extra: dict[str, tuple[str, str]]) -> str:
    """Home and away view of ``source`` with the named pairs of columns."""
    def view(side: int) -> str:
        cols = ", ".join(f"{q(pair[side])} AS {q(name)}" for name, pair in extra.items())
        team, win = (("HomeTeam", "H"), ("AwayTeam", "A"))[side]
        return (f"SELECT {q(team)} AS \"Team\", {side} AS side, \"FTR\", ({q('FTR')}='{win}') AS won, "
                f"match_id, \"Date\"{', ' + cols if cols else ''} FROM {source}")
    return f"{view(0)} UNION ALL {view(1)}"


GOALS = {"gf": ("FTHG", "FTAG"), "ga": ("FTAG", "FTHG")}


def table_sql(view: str) -> str:
    """League table over a team view, as a SELECT."""
    return f"""
SELECT "Team", count(*) AS "Matches", (count(*) FILTER (WHERE won)) AS "Wins",
  (count(*) FILTER (WHERE "FTR"='D')) AS "Draws",
  count(*) - (count(*) FILTER (WHERE won)) - (count(*) FILTER (WHERE "FTR"='D')) AS "Losses",
  sum(gf) AS "GoalsFor", sum(ga) AS "GoalsAgainst", sum(gf)-sum(ga) AS "GoalDifference",
  3*(count(*) FILTER (WHERE won)) + (count(*) FILTER (WHERE "FTR"='D')) AS "Points",
  (count(*) FILTER (WHERE won))::DOUBLE / count(*)::DOUBLE * 100.0::DOUBLE AS "WinPercentage"
FROM ({view}) GROUP BY "Team" """


def stats_cte(source: str = "matches", name: str = "stats") -> str:
    return f"{name} AS ({table_sql(sides(source, GOALS))})"


WITH_MATCHES = f"WITH {MATCHES}\n"
WITH_STATS = f"WITH {MATCHES},\n{stats_cte()}\n"
