"""Statistics as SQL text for the comparison engine, by other routes than ``functions.stats``.

The t tail is a midpoint rule over the density itself (not Simpson on the angle
form) and binomial tails are plain sums over the engine's own lgamma.
"""

from __future__ import annotations


def wilson(k: str, n: str, prefix: str = "acc") -> str:
    z = "1.959964::DOUBLE"
    d = f"(1 + {z}*{z}/{n})"
    c = f"(({k}::DOUBLE/{n} + {z}*{z}/(2.0::DOUBLE*{n}))/{d})"
    h = f"({z}*sqrt(({k}::DOUBLE/{n})*(1-{k}::DOUBLE/{n})/{n} + {z}*{z}/(4.0::DOUBLE*{n}*{n}))/{d})"
    return (f"CASE WHEN {n} > 0 THEN round({k}::DOUBLE/{n}, 6) END AS {prefix}, "
            f"CASE WHEN {n} > 0 THEN round({c} - {h}, 6) END AS {prefix}_low, "
            f"CASE WHEN {n} > 0 THEN round({c} + {h}, 6) END AS {prefix}_high")


def t_upper(t: str, v: str, steps: int = 4000) -> str:
    """P(T > t) as one half minus the area of the density between 0 and t."""
    scale = f"exp(lgamma(({v}+1)/2.0::DOUBLE) - lgamma({v}/2.0::DOUBLE))/sqrt({v}::DOUBLE*pi())"
    body = f"pow(1 + pow(({t})*(i+0.5::DOUBLE)/{steps}, 2)/{v}::DOUBLE, -({v}+1)/2.0::DOUBLE)"
    return (f"greatest(0.0::DOUBLE, 0.5::DOUBLE - {scale}*(({t})/{steps})*"
            f"list_sum(list_transform(range(0, {steps}), lambda i: {body})))")


def t_steps(v: str, p: str) -> str:
    """Column ``{p}_t``: 97.5 % point by the normal expansion, good to 1e-8 from 60 degrees on."""
    z = 1.959963984540054
    terms = ((z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96,
             (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
             (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160)
    return " + ".join([f"{z!r}::DOUBLE", *[f"{c!r}::DOUBLE/pow({v}, {i + 1})" for i, c in enumerate(terms)]]) + f" AS {p}_t"


def interval(mean: str, std: str, n: str, p: str) -> str:
    """``{p}_low``/``{p}_high`` from the columns ``t_steps(n - 1)`` made."""
    q = f"{p}_t"
    return (f"CASE WHEN {n} >= 2 THEN round({mean} - {q}*{std}/sqrt({n}::DOUBLE), 6) END AS {p}_low, "
            f"CASE WHEN {n} >= 2 THEN round({mean} + {q}*{std}/sqrt({n}::DOUBLE), 6) END AS {p}_high")


def one_sided(mean: str, std: str, n: str, sign: str = "") -> str:
    t = f"({sign}({mean})*sqrt({n}::DOUBLE)/({std}))"
    small = t_upper(f"abs({t})", f"({n}-1)")
    return (f"CASE WHEN {n} >= 2 AND {std} > 0 THEN round(CASE WHEN {t} >= 0 THEN {small} ELSE 1 - {small} END, 6) END")


def binom_two_sided(k: str, n: str) -> str:
    lo = f"least({k}, {n}-{k})"
    tail = (f"list_sum(list_transform(range(0, {lo}+1), lambda i: exp(lgamma({n}+1.0::DOUBLE) - lgamma(i+1.0::DOUBLE)"
            f" - lgamma({n}-i+1.0::DOUBLE) - {n}*ln(2.0::DOUBLE))))")
    return f"CASE WHEN {n} = 0 OR 2*{lo} = {n} THEN 1.0::DOUBLE ELSE round(least(1.0::DOUBLE, 2*{tail}), 6) END"


def odds_prob(m: str) -> str:
    return f"(CASE WHEN {m} < 0 THEN -{m}/(-{m}+100.0::DOUBLE) ELSE 100.0::DOUBLE/({m}+100.0::DOUBLE) END)"


def fair_home(h: str, a: str) -> str:
    return f"CASE WHEN {h} IS NOT NULL AND {a} IS NOT NULL THEN {odds_prob(h)}/({odds_prob(h)}+{odds_prob(a)}) END"


def log_loss(y: str, p: str) -> str:
    q = f"least(greatest({p}, 1e-15), 1-1e-15)"
    return f"CASE WHEN {p} IS NOT NULL THEN -({y}*ln({q}) + (1-{y})*ln(1-{q})) END"


def tier(edge: str) -> str:
    return (f"CASE WHEN round({edge}, 10) >= 0.16::DOUBLE THEN 'two_star' WHEN round({edge}, 10) >= 0.11::DOUBLE THEN 'one_star' "
            f"WHEN round({edge}, 10) >= 0.04::DOUBLE THEN 'lean' END")


def bucket(edge: str) -> str:
    return (f"CASE WHEN round({edge}, 10) >= 0.08::DOUBLE THEN '[0.08+)' WHEN round({edge}, 10) >= 0.06::DOUBLE THEN '[0.06, 0.08)' "
            f"WHEN round({edge}, 10) >= 0.04::DOUBLE THEN '[0.04, 0.06)' END")
