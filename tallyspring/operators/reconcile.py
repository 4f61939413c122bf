"""Reconciliation of account forecasts: by identities, or by minimum trace.

Formulas are ``lhs = a + b * 2.0 - c``: blank-separated tokens, + - * /, no brackets. Each is checked and
becomes a SQL expression over the accounts pivoted by month, or rows of a coefficient table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class FormulaError(ValueError):
    """A formula that can't be used."""


class MissingEqualsError(FormulaError):
    pass


class BadLeftSideError(FormulaError):
    pass


class BadTokenError(FormulaError):
    pass


class BadOrderError(FormulaError):
    pass


class UnknownAccountError(FormulaError):
    pass


class NotLinearError(FormulaError):
    """Not a sum of constants times accounts."""


_NUMBER, _NAME = re.compile(r"\d+(\.\d+)?"), re.compile(r"[A-Za-z_]\w*")


@dataclass(frozen=True)
class Formula:
    lhs: str
    rhs: tuple[str, ...]

    @property
    def accounts(self) -> list[str]:
        return list(dict.fromkeys(t for t in self.rhs if _NAME.fullmatch(t)))

    def sql(self) -> str:
        """SQL's own precedence is the formula's: * and / first, from the left. A zero divisor gives null."""
        terms, out = list(self.rhs), []
        for i, t in enumerate(terms):
            word = f"`{t}`" if _NAME.fullmatch(t) else f"CAST({t} AS DOUBLE)" if _NUMBER.fullmatch(t) else t
            out.append(f"nullif({word}, 0D)" if i and terms[i - 1] == "/" else word)
        return " ".join(out)

    def coefficients(self) -> dict[str, float]:
        """Factor of each account; repeated ones add up. Raises NotLinearError where the formula is no such sum."""
        out: dict[str, float] = {}
        sign, factor, account = 1.0, 1.0, None
        op = "*"
        for t in (*self.rhs, "+"):
            if t in "+-":
                if account is None:
                    raise NotLinearError(f"{self.lhs}: a term without an account")
                out[account] = out.get(account, 0.0) + sign * factor
                sign, factor, account, op = (1.0 if t == "+" else -1.0), 1.0, None, "*"
            elif t in "*/":
                op = t
            elif _NUMBER.fullmatch(t):
                factor = factor * float(t) if op == "*" else factor / float(t)
            else:
                if account is not None or op == "/":
                    raise NotLinearError(f"{self.lhs}: accounts multiplied or divided")
                account = t
        return out


def parse_formula(text: str) -> Formula:
    left, equals, right = text.partition("=")
    if not equals or "=" in right:
        raise MissingEqualsError(f"one = is needed: {text!r}")
    lhs = left.split()
    if len(lhs) != 1 or not _NAME.fullmatch(lhs[0]):
        raise BadLeftSideError(f"one account is needed before =: {text!r}")
    tokens = right.split()
    for i, t in enumerate(tokens):
        operator = t in ("+", "-", "*", "/")
        if not (operator or _NUMBER.fullmatch(t) or _NAME.fullmatch(t)):
            raise BadTokenError(f"{t!r} in {text!r}")
        if operator != bool(i % 2):
            raise BadOrderError(f"{t!r} is out of place in {text!r}")
    if len(tokens) % 2 == 0:
        raise BadOrderError(f"{text!r} ends with an operator")
    return Formula(lhs[0], tuple(tokens))


def parse_formulas(texts: list[str], accounts: list[str]) -> list[Formula]:
    """In order; the left sides of earlier ones may be used by later ones."""
    known, out = set(accounts), []
    for f in map(parse_formula, texts):
        unknown = [a for a in f.accounts if a not in known]
        if unknown:
            raise UnknownAccountError(f"{f.lhs}: {', '.join(unknown)}")
        known.add(f.lhs)
        out.append(f)
    return out


def direct(panel: DataFrame, formulas: list[Formula], keys: list[str] | None = None) -> DataFrame:
    """account, month, value: the given accounts, with every left side (re)computed, each formula seeing those before it."""
    keys = keys or ["month"]
    names = list(dict.fromkeys([a for f in formulas for a in f.accounts] + [f.lhs for f in formulas]))
    wide = panel.where(F.col("account").isin(names)).groupBy(*keys).pivot("account", names).agg(F.sum("value"))
    for f in formulas:
        wide = wide.withColumn(f.lhs, F.expr(f.sql()))
    made = wide.unpivot(keys, [f.lhs for f in formulas], "account", "value").where("value IS NOT NULL")
    kept = panel.where(~F.col("account").isin([f.lhs for f in formulas]))
    return kept.select("account", *keys, "value").unionByName(made.select("account", *keys, "value"))


def feasible(formulas: list[Formula], forecast_accounts: list[str]) -> bool:
    """Minimum trace needs linear formulas whose left sides are forecast themselves."""
    try:
        for f in formulas:
            f.coefficients()
    except NotLinearError:
        return False
    return all(f.lhs in forecast_accounts for f in formulas)


def matrices(formulas: list[Formula], accounts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(order, S, J, U): left sides first, then base accounts; S sums base accounts, J picks them, U holds the constraints."""
    lhs = [f.lhs for f in formulas]
    base = [a for a in accounts if a not in lhs]
    solved: dict[str, dict[str, float]] = {}
    for f in formulas:
        row: dict[str, float] = {}
        for a, c in f.coefficients().items():
            for b, k in solved.get(a, {a: 1.0}).items():
                row[b] = row.get(b, 0.0) + c * k
        solved[f.lhs] = row
    top = np.array([[solved[name].get(b, 0.0) for b in base] for name in lhs]).reshape(len(lhs), len(base))
    s = np.vstack([top, np.eye(len(base))])
    j = np.hstack([np.zeros((len(base), len(lhs))), np.eye(len(base))])
    u = np.vstack([np.eye(len(lhs)), -top.T])
    return [*lhs, *base], s, j, u


def min_trace(panel: DataFrame, formulas: list[Formula], errors: DataFrame | None = None) -> DataFrame:
    """account, month, value: all accounts made coherent with the least total error variance.

    ``errors`` (account, month, value) give the covariance; without them all accounts weigh alike. The
    matrix is as large as the number of accounts in the formulas, so it is worked out here; applying it
    is a join with the coefficients and a sum.
    """
    known = [r[0] for r in panel.select("account").distinct().orderBy("account").collect()]
    used = {a for f in formulas for a in (*f.accounts, f.lhs)}
    order, s, j, u = matrices(formulas, [a for a in known if a in used])
    w = np.eye(len(order))
    if errors is not None:
        from tallyspring.operators.stats import covariances

        at = {a: i for i, a in enumerate(order)}
        for r in covariances(errors.where(F.col("account").isin(order)), "account").collect():
            w[at[r["first"]], at[r["second"]]] = w[at[r["second"]], at[r["first"]]] = r["covariance"] or 0.0
    inner = u.T @ w @ u
    if np.linalg.matrix_rank(inner) < len(inner):
        raise FormulaError("the errors leave the constraints undetermined")
    p = j - j @ w @ u @ np.linalg.solve(inner, u.T)
    m = s @ p
    spark = panel.sparkSession
    table = [(order[i], order[k], float(m[i, k])) for i in range(len(order)) for k in range(len(order)) if m[i, k]]
    # as large as the formulas
    coefficients = F.broadcast(spark.createDataFrame(table, "target string, source string, coefficient double"))
    made = panel.join(coefficients, F.col("account") == F.col("source")).groupBy(F.col("target").alias("account"), "month").agg(F.sum(F.col("coefficient") * F.col("value")).alias("value"))
    return made.unionByName(panel.where(~F.col("account").isin(order)).select("account", "month", "value"))


def reconcile(panel: DataFrame, formulas: list[Formula], method: str = "off", errors: DataFrame | None = None, fallback: bool = True) -> DataFrame:
    """off: unchanged; algebraic: direct; mint: minimum trace, or (if infeasible) direct or an error."""
    if method == "off" or not formulas:
        return panel.select("account", "month", "value")
    if method == "algebraic":
        return direct(panel, formulas)
    known = [r[0] for r in panel.select("account").distinct().collect()]
    if feasible(formulas, known):
        return min_trace(panel, formulas, errors)
    if not fallback:
        raise FormulaError("minimum trace isn't feasible for these formulas")
    return direct(panel, formulas)
