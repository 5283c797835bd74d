"""Derived columns against all tests on all rows, with nulls, equal columns, long groups and many columns."""

import random

import pytest

from logweave.operators import audits


def brute(groups, columns, eps=1e-6):
    close = lambda x, y: abs(x - y) <= eps * max(abs(x), abs(y), 1)
    out = set()
    for g, rows in groups.items():
        sums, totals = [0.0] * len(columns), []
        for r in rows:
            sums = [s + (v or 0) for s, v in zip(sums, r, strict=True)]
            totals.append([None if v is None else s for s, v in zip(sums, r, strict=True)])

        def fits(c, value, rows=rows, totals=totals):
            told = [close(r[c], y) for r, t in zip(rows, totals, strict=True) if r[c] is not None and (y := value(r, t)) is not None]
            return all(told) and len(told) >= 3

        plus = lambda a, b, sign: lambda r, _: None if r[a] is None or r[b] is None else r[a] + sign * r[b]
        n = range(len(columns))
        found, loose = {}, []
        for c in n:
            for a in n:
                if a != c and c not in found and fits(c, lambda _, t, a=a: t[a]):
                    found[c] = ("cumulative", a, None)
        for c in n:
            for a in n:
                for b in n:
                    if len({a, b, c}) == 3 and a < b and c not in found and fits(c, plus(a, b, 1)):
                        found[c] = ("sum", a, b)
        for c in n:
            for a in n:
                for b in n:
                    if len({a, b, c}) == 3 and not {a, b, c} & set(found) and fits(c, plus(a, b, -1)):
                        if not {a, b, c} & {x[0] for x in loose}:
                            loose.append((c, "difference", a, b))
        name = lambda i: None if i is None else columns[i]
        out |= {(g, columns[c], kind, name(a), name(b)) for c, (kind, a, b) in found.items()} | {(g, name(c), kind, name(a), name(b)) for c, kind, a, b in loose}
    return out


@pytest.mark.parametrize(("tried", "most"), [(8, 1_000_000), (3, 5), (100, 1_000_000)])
def test_against_all_tests(spark, tried, most):
    rng = random.Random(2)
    columns = [f"c{i}" for i in range(6)]
    groups = {}
    for g in range(14):
        rows, total = [], 0.0
        for i in range(rng.choice([2, 3, 5, 30])):
            a, b = rng.randint(0, 3) * (g % 3 > 0), rng.randint(-5, 9)
            total += b
            row = [float(a), float(b), float(a + b), float(total), float(a - b), float(rng.randint(0, 1))]
            if g % 4 == 1 and i == 12:
                row[2] += 1
            rows.append([None if rng.random() < 0.1 * (g % 2) else v for v in row] if g != 13 else [None] * 6)
        groups[g if g else None] = rows
    table = [(g, i, *r) for g, rows in groups.items() for i, r in enumerate(rows)]
    df = spark.createDataFrame(table, "g long, i int, " + ", ".join(f"{c} double" for c in columns)).repartition(4)
    got = audits.derived_columns(df, "g", "i", columns, tried=tried, most=most)
    assert {tuple(r) for r in got.collect()} == brute(groups, columns)


def test_many_columns(spark):
    rng = random.Random(1)
    rows = [[rng.uniform(-9, 9) for _ in range(25)] for _ in range(40)]
    for r in rows:
        r[24] = r[3] + r[17]
    columns = [f"c{i}" for i in range(25)]
    df = spark.createDataFrame([("f", i, *r) for i, r in enumerate(rows)], "g string, i int, " + ", ".join(f"{c} double" for c in columns))
    got = {tuple(r) for r in audits.derived_columns(df, "g", "i", columns).collect()}
    assert ("f", "c24", "sum", "c3", "c17") in got and got == brute({"f": rows}, columns)
