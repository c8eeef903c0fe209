"""Prices, edges, stakes and settlement as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foretime.functions.scalar import col, half_open_label

# Fixed values the results depend on.
EDGE_THRESHOLD = 0.04
EDGE_DIGITS = 10
STAKE = 1.0
TIER_EDGES = (0.04, 0.11, 0.16)
TIERS = ("lean", "one_star", "two_star")
BUCKET_EDGES = (0.04, 0.06, 0.08)
BUCKETS = ("[0.04, 0.06)", "[0.06, 0.08)", "[0.08+)")
TOSS_UP_MAX = 0.55
SMALL_BUCKET = 30


def implied_prob(odds: Column | str) -> Column:
    """American odds to probability, margin included."""
    m = col(odds)
    return F.when(m < 0, -m / (-m + 100.0)).otherwise(100.0 / (m + 100.0))


def fair_home_prob(home_odds, away_odds) -> Column:
    """Home probability with the margin taken out; NULL when a price is missing."""
    h, a = implied_prob(home_odds), implied_prob(away_odds)
    return h / (h + a)


def overround(home_odds, away_odds) -> Column:
    return implied_prob(home_odds) + implied_prob(away_odds)


def win_profit(odds: Column | str) -> Column:
    """Profit of a one-unit winning bet."""
    m = col(odds)
    return F.when(m > 0, m / 100.0).otherwise(100.0 / F.abs(m))


def qualifies(edge: Column | str, threshold: float = EDGE_THRESHOLD) -> Column:
    """Edge reaches the threshold once float noise is rounded away."""
    return F.round(col(edge), EDGE_DIGITS) >= F.lit(threshold)


def place_bet(p_home, home_odds, away_odds, threshold: float = EDGE_THRESHOLD) -> Column:
    """Struct with implied probability, both edges, side, reason, price and stake."""
    fair = fair_home_prob(home_odds, away_odds)
    edge_home, edge_away = col(p_home) - fair, (1.0 - col(p_home)) - (1.0 - fair)
    priced = col(home_odds).isNotNull() & col(away_odds).isNotNull()
    side = (F.when(priced & qualifies(edge_home, threshold), "home")
            .when(priced & qualifies(edge_away, threshold), "away").otherwise("none"))
    return F.struct(
        fair.alias("implied_p_home"), edge_home.alias("edge_home"), edge_away.alias("edge_away"),
        side.alias("paper_bet"),
        F.when(~priced, "missing_line").when(side == "none", "edge_below_threshold")
        .otherwise("").alias("no_bet_reason"),
        F.when(side == "home", col(home_odds)).when(side == "away", col(away_odds)).alias("bet_price"),
        F.when(side == "none", 0.0).otherwise(STAKE).alias("stake"))


def tier(edge: Column | str) -> Column:
    return half_open_label(edge, TIER_EDGES, TIERS, EDGE_DIGITS)


def edge_bucket(edge: Column | str) -> Column:
    return half_open_label(edge, BUCKET_EDGES, BUCKETS, EDGE_DIGITS)


def toss_up(p_home: Column | str) -> Column:
    p = col(p_home)
    return F.round(F.greatest(p, 1.0 - p), EDGE_DIGITS) <= TOSS_UP_MAX


def side_value(side, home_value, away_value) -> Column:
    return F.when(col(side) == "home", col(home_value)).otherwise(col(away_value))


def side_prob(side, p_home) -> Column:
    return side_value(side, p_home, 1.0 - col(p_home))


def result(home_score, away_score) -> Column:
    h, a = col(home_score), col(away_score)
    return (F.when(h.isNull() | a.isNull(), "pending").when(h == a, "tie")
            .when(h > a, "home").otherwise("away"))


def settle(side, price, home_score, away_score) -> Column:
    """Struct (outcome, units) of a bet; ties return the stake."""
    res, s = result(home_score, away_score), col(side)
    outcome = (F.when(~s.isin("home", "away"), "none").when(res == "pending", "pending")
               .when(res == "tie", "void").when(res == s, "win").otherwise("loss"))
    units = (F.when(outcome == "win", win_profit(price)).when(outcome == "loss", -STAKE)
             .when(outcome.isin("none", "void"), 0.0))
    return F.struct(outcome.alias("bet_outcome"), units.alias("units"))


def line_value(side, p_then, p_late) -> Column:
    """Gain in implied probability of the bet side between two snapshots."""
    gain = col(p_late) - col(p_then)
    return F.when(col(side) == "home", gain).when(
        col(side) == "away", (1.0 - col(p_late)) - (1.0 - col(p_then)))


def move_toward_model(p_model, p_then, p_late) -> Column:
    return (col(p_late) - col(p_then)) * F.signum(col(p_model) - col(p_then))


def favourite(spread, home_odds, away_odds) -> Column:
    """Side the spread favours; a pick'em falls back to the shorter price."""
    s, h, a = col(spread), col(home_odds), col(away_odds)
    return (F.when(s > 0, "home").when(s < 0, "away").when(h < a, "home").when(a < h, "away")
            .otherwise("unresolved"))


def pick(p_home: Column | str) -> Column:
    """Home only when strictly above one half."""
    return F.when(col(p_home) > 0.5, "home").otherwise("away")


def log_loss(y, p, floor: float = 1e-15) -> Column:
    q = F.least(F.greatest(col(p), F.lit(floor)), F.lit(1.0 - floor))
    q = F.when(col(p).isNotNull(), q)
    return -(col(y) * F.log(q) + (1.0 - col(y)) * F.log(1.0 - q))


def brier(y, p) -> Column:
    return F.pow(col(p) - col(y), 2)


def logit(p, floor: float = 1e-6) -> Column:
    q = F.when(col(p).isNotNull(), F.least(F.greatest(col(p), F.lit(floor)), F.lit(1.0 - floor)))
    return F.log(q / (1.0 - q))


def sigmoid(x) -> Column:
    return 1.0 / (1.0 + F.exp(-col(x)))


def grade_side(side, res) -> Column:
    return (F.when(col(res) == "pending", "open").when(col(res) == "tie", "push")
            .when(col(res) == col(side), "win").otherwise("loss"))
