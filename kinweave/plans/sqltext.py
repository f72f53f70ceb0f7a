"""SQL text of a model, for checking plans against another engine."""

from __future__ import annotations

import math

from ..operators.compare import Comparison
from ..operators.model import Model, default_m, filled, log_odds, start_prior, trainable


def equal(rule: tuple[str, ...]) -> str:
    return " AND ".join(f"l.{c} = r.{c}" for c in rule)


def rule_pairs(source: str, key: str, cols: list[str], rules, other: str | None = None) -> str:
    """Pairs per rule, each with the first rule it meets."""
    fields = ", ".join(f"l.{c} AS {c}_l, r.{c} AS {c}_r" for c in [key, *cols])
    parts = []
    for k, rule in enumerate(rules):
        order = f"l.{key} < r.{key} AND " if other is None else ""
        skip = "".join(f" AND NOT coalesce({equal(e)}, false)" for e in rules[:k])
        parts.append(
            f"SELECT {fields}, CAST({k} AS INTEGER) AS match_key FROM {source} l JOIN {other or source} r ON {order}{equal(rule)}{skip}"
        )
    return " UNION ALL ".join(parts)


def gamma(c: Comparison) -> str:
    out, at = "CASE", 0
    for l in c.levels:
        value = -1
        if not l.is_null:
            value = c.gamma_of(at)
            at += 1
        out += f" ELSE {value}" if l.sql == "ELSE" else f" WHEN {l.sql} THEN {value}"
    return f"CAST({out} END AS INTEGER)"


def gammas(comparisons) -> str:
    return ", ".join(f"{gamma(c)} AS gamma_{c.name}" for c in comparisons)


def weight(c: Comparison) -> str:
    cases = " ".join(
        f"WHEN {c.gamma_of(i)} THEN {math.log2(l.m / l.u)!r}" for i, l in enumerate(c.scored)
    )
    return f"CASE gamma_{c.name} WHEN -1 THEN 0.0 {cases} END"


def tf_weight(c: Comparison) -> str | None:
    for i, l in enumerate(c.scored):
        if l.tf_column:
            t = l.tf_column
            return (
                f"CASE WHEN gamma_{c.name} = {c.gamma_of(i)} THEN "
                f"log2({l.u!r} / greatest(tf_{t}_l, tf_{t}_r)) ELSE 0.0 END"
            )
    return None


def scored(model: Model, source: str, key: str) -> str:
    """CTEs ``tf``-carrying records, ``pairs``, ``leveled`` and ``scored``."""
    cols = model.columns
    tfs = [
        f"(SELECT count(*) FROM {source} x WHERE x.{c} = t.{c}) / CAST((SELECT count({c}) FROM {source}) AS DOUBLE) AS tf_{c}"
        for c in model.tf_columns
    ]
    rows = f"SELECT t.* {''.join(', ' + t for t in tfs)} FROM {source} t"
    every = cols + [f"tf_{c}" for c in model.tf_columns]
    cs = [filled(c) for c in model.comparisons]
    terms = [repr(log_odds(model.prior))] + [weight(c) for c in cs] + [t for c in cs if (t := tf_weight(c))]
    return (
        f"known AS ({rows}), pairs AS ({rule_pairs('known', key, every, model.rules)}), "
        f"leveled AS (SELECT *, {gammas(cs)} FROM pairs), "
        f"scored AS (SELECT *, {' + '.join(terms)} AS match_weight FROM leveled)"
    )


def em(model: Model, rule: tuple[str, ...], source: str, key: str, rounds: int, tag: str) -> str:
    """CTEs for ``rounds`` steps of EM on the pairs of one rule; the last is ``<tag>_p<rounds>``."""
    cs = [filled(c) for c in trainable(model, rule)]
    cols = list(dict.fromkeys(c.column for c in cs))
    names = ", ".join(f"gamma_{c.name}" for c in cs)
    out = [
        f"{tag}_pairs AS ({rule_pairs(source, key, cols, [rule])})",
        f"{tag}_g AS MATERIALIZED (SELECT {names}, count(*) AS n FROM (SELECT {gammas(cs)} FROM {tag}_pairs) GROUP BY ALL)",
    ]
    start = [f"CAST({start_prior(model, rule)!r} AS DOUBLE) AS lam"]
    for c in cs:
        start += [f"CAST({m!r} AS DOUBLE) AS m_{c.name}_{c.gamma_of(i)}" for i, m in enumerate(default_m(len(c.scored)))]
    out.append(f"{tag}_p0 AS (SELECT {', '.join(start)})")
    for k in range(rounds):
        terms = ["log2(lam / (1 - lam))"]
        for c in cs:
            cases = " ".join(
                f"WHEN {c.gamma_of(i)} THEN log2(m_{c.name}_{c.gamma_of(i)} / {l.u!r})" for i, l in enumerate(c.scored)
            )
            terms.append(f"CASE gamma_{c.name} WHEN -1 THEN 0.0 {cases} END")
        out.append(f"{tag}_e{k} AS (SELECT g.*, p.*, 1 / (1 + pow(2, -({' + '.join(terms)}))) AS q FROM {tag}_g g, {tag}_p{k} p)")
        fields = ["sum(q * n) / sum(n) AS lam"]
        for c in cs:
            total = f"sum(CASE WHEN gamma_{c.name} >= 0 THEN q * n END)"
            for g in range(len(c.scored)):
                part = f"sum(CASE WHEN gamma_{c.name} = {g} THEN q * n END)"
                fields.append(f"coalesce({part} / {total}, min(m_{c.name}_{g})) AS m_{c.name}_{g}")
        out.append(f"{tag}_p{k + 1} AS (SELECT {', '.join(fields)} FROM {tag}_e{k})")
    return ", ".join(out)


def em_rows(model: Model, rule: tuple[str, ...], rounds: int, tag: str) -> str:
    """(comparison, gamma, m) rows of the levels that occur, after :func:`em`."""
    return " UNION ALL ".join(
        f"SELECT '{c.name}' AS comparison, CAST({g} AS INTEGER) AS gamma, m_{c.name}_{g} AS m FROM {tag}_p{rounds} "
        f"WHERE EXISTS (SELECT 1 FROM {tag}_g WHERE gamma_{c.name} = {g})"
        for c in trainable(model, rule)
        for g in range(len(c.scored))
    )
