"""The logical inputs of ``proxies`` stated in SQL for the comparison engine."""

from __future__ import annotations

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def view(name: str, sql: str, needs: tuple[str, ...] = ()) -> None:
    VIEWS[name] = (needs, sql)


def with_views(body: str, names: tuple[str, ...] = ()) -> str:
    """``body`` behind a WITH clause holding ``names`` and what they need."""
    order: list[str] = []

    def visit(n: str) -> None:
        for d in VIEWS[n][0]:
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in order)
    body = body.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


view("ev", """
  SELECT event_id, user_id, ts, event_type,
         CASE WHEN event_id % 7 <> 0 THEN value END AS metric, value,
         date_trunc('week', ts) AS week_start
  FROM events""")

view("schedule", """
  SELECT * FROM (
    SELECT o_orderkey AS game_id, CAST(year(o_orderdate) AS INTEGER) AS season, wk AS week,
      CASE WHEN o_orderkey % 20 = 0 THEN 'POST' ELSE 'REG' END AS game_type,
      strftime(o_orderdate, '%Y-%m-%d') AS gameday,
      CASE WHEN o_orderkey % 50 <> 7 THEN lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || ':' ||
           lpad(CAST(o_orderkey * 7 % 60 AS VARCHAR), 2, '0') END AS gametime,
      o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS kickoff,
      'T' || (o_custkey // 10) AS home_team,
      'T' || ((l_suppkey * 15 + l_partkey % 15) // 10) AS away_team,
      CASE WHEN NOT (year(o_orderdate) = 2001 AND wk > 6)
           THEN CAST(CAST(floor(l_quantity) AS BIGINT) % 40 AS DOUBLE) END AS home_score,
      CASE WHEN NOT (year(o_orderdate) = 2001 AND wk > 6)
           THEN CAST(CAST(floor(l_extendedprice) AS BIGINT) % 40 AS DOUBLE) END AS away_score,
      CAST(2 + o_custkey % 22 AS DOUBLE) AS home_rest, CAST(2 + l_suppkey % 22 AS DOUBLE) AS away_rest,
      CASE WHEN o_custkey % 5 = l_suppkey % 5 THEN 1 ELSE 0 END AS div_game,
      ['dome','closed','outdoors','open','tent'][l_partkey % 5 + 1] AS roof,
      CASE WHEN l_suppkey % 30 = 3 THEN 'Neutral' ELSE 'Home' END AS location,
      'V' || (((o_custkey // 10) * 2 + CASE WHEN o_custkey % 7 = 0 THEN 1 ELSE 0 END) % 40) AS stadium_id,
      (l_partkey % 21 - 10) * 0.5::DOUBLE AS spread_line,
      CASE WHEN l_partkey % 23 <> 0 THEN CASE WHEN l_suppkey % 2 = 0
           THEN -CAST(105 + l_partkey % 300 AS DOUBLE) ELSE CAST(101 + l_partkey % 280 AS DOUBLE) END END AS home_moneyline,
      CASE WHEN l_partkey % 23 <> 0 THEN CASE WHEN l_suppkey % 2 = 0
           THEN CAST(101 + l_partkey % 280 AS DOUBLE) ELSE -CAST(105 + l_partkey % 300 AS DOUBLE) END END AS away_moneyline,
      l_suppkey AS pool, 'N' || (o_custkey % 20) AS pool_home, 'N' || (l_partkey % 20) AS pool_away
    FROM (SELECT *, CAST(1 + (dayofyear(o_orderdate) - 1) // 20 AS INTEGER) AS wk FROM orders) o
    JOIN (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey,
            l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) AS rn FROM lineitem) l
      ON l.l_orderkey = o.o_orderkey AND l.rn = 1)
  WHERE home_team <> away_team""")

view("decided_games", """
  SELECT *, CASE WHEN home_score > away_score THEN 1 ELSE 0 END AS home_win
  FROM schedule
  WHERE game_type = 'REG' AND home_score IS NOT NULL AND away_score IS NOT NULL
    AND home_score <> away_score""", ("schedule",))

view("plays", """
  SELECT game_id, season, week,
    CASE WHEN l_linenumber % 2 = 1 THEN home_team ELSE away_team END AS posteam,
    CASE WHEN l_linenumber % 2 = 1 THEN away_team ELSE home_team END AS defteam,
    CASE WHEN l_partkey % 5 < 3 THEN 1.0 ELSE 0.0 END::DOUBLE AS pass,
    CASE WHEN l_partkey % 5 = 3 THEN 1.0 ELSE 0.0 END::DOUBLE AS rush,
    CASE WHEN l_partkey % 5 < 3 THEN 1.0 ELSE 0.0 END::DOUBLE AS qb_dropback,
    CASE WHEN l_partkey % 5 < 3 AND l_suppkey % 7 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS sack,
    CASE WHEN l_partkey % 5 < 3 AND l_suppkey % 11 = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS qb_scramble,
    CASE WHEN l_partkey % 13 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS interception,
    CASE WHEN l_partkey % 29 <> 0 THEN CASE WHEN l_suppkey % 9 = 0 THEN 1.0 ELSE 0.0 END END::DOUBLE AS qb_hit,
    CASE WHEN l_partkey % 17 <> 0 THEN (l_quantity - 25.0::DOUBLE) / 10 END AS epa,
    CASE WHEN l_partkey % 17 <> 0 THEN (l_quantity - 25.0::DOUBLE) / 10 END + l_discount AS qb_epa,
    CASE WHEN l_partkey % 17 <> 0 THEN CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0.0 END END::DOUBLE AS success,
    CASE WHEN season >= 1996 THEN (l_tax - 0.04::DOUBLE) * 100 END AS cpoe,
    CAST(CAST(floor(l_quantity) AS BIGINT) % 20 AS DOUBLE) AS air_yards,
    CASE WHEN l_linenumber <> 7 THEN CAST(l_linenumber % 4 + 1 AS DOUBLE) END AS down
  FROM lineitem JOIN schedule ON l_orderkey = game_id""", ("schedule",))

view("team_log", """
  SELECT coalesce(o.game_id, d.game_id) AS game_id, coalesce(o.team, d.team) AS team, g.season, g.week,
    g.kickoff, coalesce(o.team, d.team) = g.home_team AS is_home,
    CASE WHEN coalesce(o.team, d.team) = g.home_team THEN g.away_team ELSE g.home_team END AS opponent,
    n_dropbacks, n_def_plays, qb_epa_per_db, qb_success_rate, cpoe, sack_rate, int_rate, air_yards_per_att,
    def_epa_per_play, def_success_allowed, def_pressure_rate, def_epa_early, def_epa_money
  FROM (SELECT game_id, posteam AS team, count(*) AS n_dropbacks, avg(qb_epa) AS qb_epa_per_db,
          avg(success) AS qb_success_rate, avg(sack) AS sack_rate,
          avg(cpoe) FILTER (sack <> 1 AND qb_scramble <> 1) AS cpoe,
          avg(interception) FILTER (sack <> 1 AND qb_scramble <> 1) AS int_rate,
          avg(air_yards) FILTER (sack <> 1 AND qb_scramble <> 1) AS air_yards_per_att
        FROM plays WHERE qb_dropback = 1 GROUP BY 1, 2) o
  FULL JOIN (
    SELECT a.*, b.def_pressure_rate FROM (
      SELECT game_id, defteam AS team, count(*) AS n_def_plays, avg(epa) AS def_epa_per_play,
        avg(success) AS def_success_allowed, avg(epa) FILTER (down IN (1, 2)) AS def_epa_early,
        avg(epa) FILTER (down IN (3, 4)) AS def_epa_money
      FROM plays WHERE (pass = 1 OR rush = 1) AND epa IS NOT NULL GROUP BY 1, 2) a
    LEFT JOIN (
      SELECT game_id, defteam AS team,
        sum(CASE WHEN qb_hit = 1 OR sack = 1 THEN 1 ELSE 0 END)::DOUBLE / count(*) AS def_pressure_rate
      FROM plays WHERE qb_dropback = 1 GROUP BY 1, 2) b USING (game_id, team)) d
    ON o.game_id = d.game_id AND o.team = d.team
  JOIN decided_games g ON g.game_id = coalesce(o.game_id, d.game_id)""", ("plays", "decided_games"))

view("quotes", """
  SELECT game_id, pulled_at, q.home_moneyline AS home_moneyline, q.away_moneyline AS away_moneyline FROM (
    SELECT s.game_id, strptime(s.gameday, '%Y-%m-%d') + to_hours(12) - to_days(l_linenumber - 2) AS pulled_at,
      {'home_moneyline': CASE WHEN l_partkey % 19 <> 0 THEN -CAST(105 + l_partkey % 250 AS DOUBLE) END,
       'away_moneyline': CAST(101 + l_partkey % 230 AS DOUBLE)} AS q,
      row_number() OVER (PARTITION BY s.game_id, l_linenumber ORDER BY
        CASE WHEN l_partkey % 19 <> 0 THEN -CAST(105 + l_partkey % 250 AS DOUBLE) END NULLS FIRST,
        CAST(101 + l_partkey % 230 AS DOUBLE)) AS rn
    FROM lineitem JOIN schedule s ON l_orderkey = s.game_id) WHERE rn = 1""", ("schedule",))

view("predictions", """
  SELECT season, week, game_id, kickoff, home_team, away_team, spread_line, home_moneyline, away_moneyline,
    strptime(gameday, '%Y-%m-%d') + to_hours(10) - to_days(CAST(game_id % 4 AS INTEGER)) AS predicted_from,
    model, CASE WHEN model = 'champion' THEN p ELSE 0.47 + (p - 0.5::DOUBLE) * 0.8::DOUBLE + (game_id * 31 % 7) * 0.01::DOUBLE END AS p_home,
    CASE WHEN model = 'champion' THEN 'official' ELSE 'hypothetical' END AS bet_status
  FROM (SELECT *, 0.2::DOUBLE + (game_id * 7919 % 1000) * 0.0006::DOUBLE AS p FROM schedule WHERE game_type = 'REG')
  CROSS JOIN (VALUES ('champion'), ('challenger')) m(model)""", ("schedule",))

from foretime.plans import sql_stats as S  # noqa: E402

view("logged", f"""
  SELECT *, CASE WHEN p_home > 0.5 THEN 'home' ELSE 'away' END AS pick,
    CASE WHEN side = 'none' THEN '' ELSE tag END AS bet_status, side AS paper_bet,
    CASE WHEN implied_p_home IS NULL THEN 'missing_line' WHEN side = 'none' THEN 'edge_below_threshold' ELSE '' END AS no_bet_reason,
    CASE side WHEN 'home' THEN home_moneyline WHEN 'away' THEN away_moneyline END AS bet_price,
    CASE WHEN side = 'none' THEN 0.0 ELSE 1.0 END::DOUBLE AS stake
  FROM (SELECT * EXCLUDE (bet_status), bet_status AS tag, p_home - implied_p_home AS edge_home,
      (1 - p_home) - (1 - implied_p_home) AS edge_away,
      CASE WHEN round(p_home - implied_p_home, 10) >= 0.04::DOUBLE THEN 'home'
           WHEN round((1 - p_home) - (1 - implied_p_home), 10) >= 0.04::DOUBLE THEN 'away' ELSE 'none' END AS side
    FROM (SELECT *, {S.fair_home('home_moneyline', 'away_moneyline')} AS implied_p_home FROM predictions))""",
     ("predictions",))

view("graded", f"""
  SELECT * EXCLUDE (late), CASE WHEN clv_status = 'measured' THEN late END AS p_late_home,
    CASE WHEN clv_status = 'measured' THEN CASE paper_bet WHEN 'home' THEN late - implied_p_home
      WHEN 'away' THEN (1 - late) - (1 - implied_p_home) END END AS bet_clv,
    CASE WHEN clv_status = 'measured' THEN (late - implied_p_home) * sign(p_home - implied_p_home) END AS line_move_toward_model
  FROM (SELECT *, CASE WHEN implied_p_home IS NULL THEN 'excluded: missing line at prediction'
        WHEN last_pulled IS NULL OR last_pulled <= predicted_from THEN 'excluded: no pre-kickoff snapshot after the prediction snapshot'
        WHEN epoch_us(last_pulled) - epoch_us(predicted_from) < 21600000000 THEN 'excluded: last pre-kickoff snapshot < 6 h after the prediction snapshot'
        WHEN late IS NULL THEN 'excluded: missing line in last pre-kickoff snapshot' ELSE 'measured' END AS clv_status
    FROM (SELECT b.*, q.late FROM (SELECT g.*, c.pulled_at AS last_pulled FROM (
        SELECT *, CASE WHEN result IN ('home','away') THEN (pick = result)::INT::DOUBLE END AS correct,
          {S.log_loss('home_win', 'p_home')} AS log_loss, pow(p_home - home_win, 2) AS brier, home_win AS home_correct,
          CASE WHEN vegas_fav <> 'unresolved' AND result IN ('home','away') THEN (vegas_fav = result)::INT::DOUBLE END AS vegas_correct,
          {S.log_loss('home_win', 'implied_p_home')} AS vegas_log_loss, pow(implied_p_home - home_win, 2) AS vegas_brier,
          CASE WHEN paper_bet = 'none' THEN 'none' WHEN result = 'pending' THEN 'pending' WHEN result = 'tie' THEN 'void'
            WHEN result = paper_bet THEN 'win' ELSE 'loss' END AS bet_outcome,
          CASE WHEN paper_bet = 'none' OR result = 'tie' THEN 0.0 WHEN result = 'pending' THEN NULL WHEN result <> paper_bet THEN -1.0
            WHEN bet_price > 0 THEN bet_price / 100.0::DOUBLE ELSE 100.0::DOUBLE / abs(bet_price) END::DOUBLE AS units
        FROM (SELECT l.*, s.home_score, s.away_score,
            CASE WHEN s.home_score IS NULL OR s.away_score IS NULL THEN 'pending' WHEN s.home_score = s.away_score THEN 'tie'
                 WHEN s.home_score > s.away_score THEN 'home' ELSE 'away' END AS result,
            CASE WHEN s.home_score > s.away_score THEN 1.0 WHEN s.home_score < s.away_score THEN 0.0 END::DOUBLE AS home_win,
            CASE WHEN l.spread_line > 0 THEN 'home' WHEN l.spread_line < 0 THEN 'away' WHEN l.home_moneyline < l.away_moneyline THEN 'home'
                 WHEN l.away_moneyline < l.home_moneyline THEN 'away' ELSE 'unresolved' END AS vegas_fav
          FROM logged l JOIN schedule s USING (game_id))) g
      ASOF LEFT JOIN (SELECT DISTINCT pulled_at FROM quotes) c ON g.kickoff > c.pulled_at) b
    LEFT JOIN (SELECT game_id, pulled_at, {S.fair_home('home_moneyline', 'away_moneyline')} AS late FROM quotes) q
      ON b.game_id = q.game_id AND b.last_pulled = q.pulled_at))""", ("logged", "quotes"))

view("long_eval", """
  SELECT game_id, season, model, p_home AS p, CAST(home_win AS INTEGER) AS y, vegas_fav FROM graded WHERE result IN ('home', 'away')""", ("graded",))
