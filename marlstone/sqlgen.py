"""SQL of linear models, for checks: each regressor is swept out of the others in turn, by window sums."""

from __future__ import annotations

from collections.abc import Sequence


def _sweep(name: str, source: str, cols: Sequence[str], last: int, keep: Sequence[str], by: Sequence[str]) -> list[str]:
    """CTEs that leave, of the columns v0.. and y of source, the part of v<last> and of y that no other column explains.

    The last CTE is ``name``, with columns q (of v<last>), y, and those of keep.
    """
    over = f"OVER (PARTITION BY {', '.join(by)})" if by else "OVER ()"
    kept = "".join(f", {c}" for c in keep)
    out, now, rest = [], source, [i for i in range(len(cols)) if i != last]
    for step, j in enumerate(rest):
        todo = [f"v{i}" for i in rest[step + 1 :]] + [f"v{last}", "y"]
        to = f"{name}s{step}"
        out.append(f"{to} AS (SELECT " + ", ".join(f"{c} - v{j} * (sum({c} * v{j}) {over} / sum(v{j} * v{j}) {over}) AS {c}" for c in todo) + f"{kept} FROM {now})")
        now = to
    return [*out, f"{name} AS (SELECT v{last} AS q, y{kept} FROM {now})"]


def regression(before: str, source: str, y: str, xs: Sequence[str], terms: Sequence[str], cov: str = "classical", seq: str = "", lag: str = "0", clusters: Sequence[str] = (), digits: int = 6,
               only: Sequence[str] | None = None, by: Sequence[str] = (), more: str = "") -> str:
    """Rows (by, term, beta, se, n) of a regression of y on xs (expressions over source; '1.0' for a constant).

    cov: classical, white, newey_west (ordered by ``seq``, a number without gaps; ``lag`` in SQL over n), cluster (one or two
    columns). ``before``: CTEs, without WITH, that source needs. ``more``: further columns as SQL over n, ssr and tss.
    """
    keep = [*by, *([seq] if seq else []), *clusters]
    rows = ", ".join(f"({x})::DOUBLE AS v{i}" for i, x in enumerate(xs))
    given = " AND ".join(f"({x}) IS NOT NULL" for x in [*xs, y])
    ctes = [before] if before else []
    ctes.append(f"src AS (SELECT {rows}, ({y})::DOUBLE AS y{''.join(f', {c}' for c in keep)} FROM {source} WHERE {given})")
    groups = ", ".join(by)
    lead = "".join(f"{c}, " for c in by)
    k = len(xs)
    picks = []
    join = " AND ".join([f"a.{c} = b.{c}" for c in by] or ["true"])
    for i, t in enumerate(terms):
        if only is not None and t not in only:
            continue
        ctes += _sweep(f"t{i}", "src", xs, i, keep, by)
        over = f"OVER (PARTITION BY {groups})" if by else "OVER ()"
        ctes.append(f"e{i} AS (SELECT *, sum(q * y) {over} / sum(q * q) {over} AS b, sum(q * q) {over} AS qq, count(*) {over} AS n, y - q * (sum(q * y) {over} / sum(q * q) {over}) AS e FROM t{i})")
        group = f" GROUP BY {groups}" if by else ""
        if cov == "classical":
            var = f"SELECT {lead}sum(e * e) / (max(n) - {k}) * max(qq) AS m FROM e{i}{group}"
        elif cov == "white":
            var = f"SELECT {lead}sum(e * e * q * q) AS m FROM e{i}{group}"
        elif cov == "newey_west":
            lead_a = "".join(f"a.{c}, " for c in by)
            group_a = f" GROUP BY {', '.join(f'a.{c}' for c in by)}" if by else ""
            var = (f"SELECT {lead_a}sum(a.e * a.q * b.e * b.q * (1 - abs(a.{seq} - b.{seq}) / (a.el + 1.0))) AS m "
                   f"FROM (SELECT *, ({lag}) AS el FROM e{i}) a JOIN e{i} b ON {join} AND b.{seq} BETWEEN a.{seq} - a.el AND a.{seq} + a.el{group_a}")
        else:
            sets = [[c] for c in clusters] + ([list(clusters)] if len(clusters) > 1 else [])
            parts = []
            for s in sets:
                parts.append(f"{'-' if len(s) > 1 else ''}(SELECT sum(u * u) * count(*) / (count(*) - 1.0) * (max(n) - 1.0) / (max(n) - {k}) FROM (SELECT sum(e * q) AS u, max(n) AS n FROM e{i} GROUP BY {', '.join(s)}))")
            var = "SELECT " + " + ".join(parts) + " AS m"
        ctes.append(f"m{i} AS ({var})")
        extra = f", {more}" if more else ""
        on = f"JOIN m{i} m ON " + " AND ".join(f"m.{c} = f.{c}" for c in by) if by else f"CROSS JOIN m{i} m"
        pick = f"SELECT {lead}max(b) AS b, max(qq) AS qq, max(n) AS n, sum(e * e) AS ssr FROM e{i}{group}"
        names = "".join(f"f.{c}, " for c in by)
        picks.append(f"SELECT {names}'{t}' AS term, round(f.b, {digits}) AS beta, round(sqrt(m.m) / f.qq, {digits}) AS se, f.n::BIGINT AS n{extra} FROM ({pick}) f {on}")
    return f"WITH {', '.join(ctes)} " + " UNION ALL ".join(picks)


def determinant(m: list[list[str]]) -> str:
    if len(m) == 1:
        return m[0][0]
    parts = [f"{'-' if j % 2 else '+'} {m[0][j]} * ({determinant([r[:j] + r[j + 1 :] for r in m[1:]])})" for j in range(len(m))]
    return " ".join(parts)


def inverse(k: int, name: str) -> tuple[str, dict[tuple[int, int], str]]:
    """(determinant, adjugate by cell) of the symmetric matrix with cells name<i><j>, i <= j."""
    m = [[f"{name}{min(i, j)}{max(i, j)}" for j in range(k)] for i in range(k)]
    cell = lambda i, j: [r[:j] + r[j + 1 :] for n, r in enumerate(m) if n != i]
    return determinant(m), {(i, j): f"{'-' if (i + j) % 2 else ''}({determinant(cell(i, j))})" for i in range(k) for j in range(k)}
