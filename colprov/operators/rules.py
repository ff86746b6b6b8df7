"""Exact-rule checks: does a derivation hold on every row of the table.

A rule that does not hold on all rows is refused, not rounded. Rules are Spark SQL
expressions; each check folds the table in one pass.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from colprov.operators.score import count_if

TOL = 1e-9
#: Eigenvalues of a correlation matrix below this belong to its null space.
NULL_EIGENVALUE = 1e-10


def holds(rule: Column) -> Column:
    """The rule as 0/1, unknown counting as broken."""
    return F.coalesce(rule, F.lit(False)).cast("double")


def check_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n, agreement, held, status) for each named rule, in one pass."""
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(holds(r)).cast("long").alias(f"k{i}") for i, r in enumerate(rules.values())],
    )
    each = F.array(
        *[F.struct(F.lit(name).alias("rule"), F.col(f"k{i}").alias("n_held")) for i, name in enumerate(rules)]
    )
    out = row.select("n", F.explode(each).alias("e")).select("e.rule", "n", "e.n_held")
    return out.withColumns(
        {
            "agreement": F.try_divide(F.col("n_held"), F.col("n")),
            "held": (F.col("n_held") == F.col("n")) & (F.col("n") > 0),
        }
    ).withColumn("status", F.when(F.col("held"), "admitted").otherwise("REFUSED"))


def threshold_rule(x: str, y: Column, k: float) -> Column:
    return (F.col(x) >= k) == (y == 1)


def sum_rule(parts: list[str], y: str, tol: float = TOL) -> Column:
    total = F.lit(0.0)
    for p in parts:
        total = total + F.col(p)
    return F.abs(total - F.col(y)) < tol


def any_flag(flags: list[str]) -> Column:
    out = F.lit(False)
    for f in flags:
        out = out | F.coalesce(F.col(f) > 0, F.lit(False))
    return out


def missing_rule(x: str, y: Column) -> Column:
    """x is filled exactly where y holds."""
    return F.col(x).isNotNull() == F.coalesce(y, F.lit(False))


def one_to_one(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Whether each level of a maps to exactly one level of b and back.

    Only the distinct (a, b) pairs travel; counting partners per level is then a
    matter of the pairs, not of the rows. Rows with a null on either side are left out.
    """
    each = F.array(
        *[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("string").alias("u"), F.col(b).cast("string").alias("v")) for a, b in pairs]
    )
    seen = df.select(F.explode(each).alias("e")).select("e.*").where("u IS NOT NULL AND v IS NOT NULL").distinct()
    left = seen.groupBy("a", "b", "u").agg(F.count(F.lit(1)).alias("k")).groupBy("a", "b").agg(
        F.max("k").alias("max_right"), F.count(F.lit(1)).alias("levels_a")
    )
    right = seen.groupBy("a", "b", "v").agg(F.count(F.lit(1)).alias("k")).groupBy("a", "b").agg(
        F.max("k").alias("max_left"), F.count(F.lit(1)).alias("levels_b")
    )
    return left.join(right, ["a", "b"]).select(
        "a", "b", "levels_a", "levels_b", ((F.col("max_right") == 1) & (F.col("max_left") == 1)).alias("one_to_one")
    )


def implications(df: DataFrame, flags: list[str], y: Column) -> DataFrame:
    """flag = 1 => y = 1 per flag; no flagged row at all counts as contradicted."""
    row = df.agg(
        *[count_if(F.coalesce(F.col(f) == 1, F.lit(False))).alias(f"n{i}") for i, f in enumerate(flags)],
        *[count_if(F.coalesce((F.col(f) == 1) & y, F.lit(False))).alias(f"h{i}") for i, f in enumerate(flags)],
    )
    each = F.array(
        *[F.struct(F.lit(f).alias("flag"), F.col(f"n{i}").alias("n_flag"), F.col(f"h{i}").alias("n_target")) for i, f in enumerate(flags)]
    )
    return row.select(F.explode(each).alias("e")).select("e.*").withColumn(
        "verdict",
        F.when((F.col("n_flag") > 0) & (F.col("n_flag") == F.col("n_target")), "CONFIRMED").otherwise("CONTRADICTED"),
    )


def crosstab_cells(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n, share of the a level) plus the agreement of a and b as text."""
    cells = df.groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    per = cells.groupBy("a").agg(F.sum("n").alias("n_a"))
    return cells.join(per, "a").select("a", "b", "n", (F.col("n") / F.col("n_a")).alias("share"))


def rate_contrast(df: DataFrame, inside: Column, y: Column, by: list[str] | None = None) -> DataFrame:
    """Rate of y inside and outside a level set."""
    i = F.coalesce(inside, F.lit(False))
    v = F.coalesce(y, F.lit(False)).cast("double")
    return df.groupBy(*(by or [])).agg(
        count_if(i).alias("n_inside"),
        F.avg(F.when(i, v)).alias("rate_inside"),
        F.avg(F.when(~i, v)).alias("rate_outside"),
    )


def mine_rules(df: DataFrame, cols: list[str], target: str, flags: list[str] | None = None, sums: bool = True) -> DataFrame:
    """Every rule of the known shapes that ties ``cols`` to ``target`` on all rows.

    identity x = y, missing x filled <=> y = 1, threshold y = (x >= k), sum
    a + b = y over the column pairs, OR of the flags that imply y, relabel x <-> y.
    All but the last come from a single fold of the table: the number of
    expressions grows with the schema, the data is read once. ``target`` is 0/1.
    ``sums`` counts every column pair; ``additive_identities`` finds sums without.
    """
    y = F.col(target)
    one, zero = y == 1, y == 0
    flags = flags or []
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(cols):
        x = F.col(c)
        aggs += [
            F.sum(holds(x.cast("double") == y)).cast("long").alias(f"id{i}"),
            F.sum(holds(x.isNotNull() == one)).cast("long").alias(f"ms{i}"),
            F.count(x).alias(f"nn{i}"),
            F.min(F.when(one, x.cast("double"))).alias(f"lo{i}"),
            F.max(F.when(zero, x.cast("double"))).alias(f"hi{i}"),
        ]
    pairs = list(combinations(range(len(cols)), 2)) if sums else []
    for i, j in pairs:
        s = F.abs(F.col(cols[i]).cast("double") + F.col(cols[j]).cast("double") - y) < TOL
        aggs.append(F.sum(holds(s)).cast("long").alias(f"s{i}_{j}"))
    row = df.agg(*aggs)

    def found(rule, names, n_held, k=None):
        return F.struct(
            F.lit(rule).alias("rule"),
            F.lit(names).alias("columns"),
            n_held.alias("n_held"),
            (F.lit(None).cast("double") if k is None else k).alias("k"),
        )

    cand = []
    for i, c in enumerate(cols):
        cut = (F.col(f"nn{i}") == F.col("n")) & (F.col(f"lo{i}") > F.col(f"hi{i}"))
        cand += [
            found("identity", c, F.col(f"id{i}")),
            found("missingness", c, F.when(F.col(f"nn{i}") < F.col("n"), F.col(f"ms{i}")).otherwise(0)),
            found("threshold", c, F.when(cut, F.col("n")).otherwise(0), F.col(f"lo{i}")),
        ]
    cand += [found("sum", f"{cols[i]}+{cols[j]}", F.col(f"s{i}_{j}")) for i, j in pairs]
    out = row.select("n", F.explode(F.array(*cand)).alias("e")).select("e.*", "n").where(
        (F.col("n_held") == F.col("n")) & (F.col("n") > 0)
    )
    out = out.select("rule", "columns", F.lit(target).alias("target"), F.when(F.col("rule") == "threshold", F.col("k")).alias("k"))
    maps = one_to_one(df, [(c, target) for c in cols]).where("one_to_one AND levels_a > 1")
    out = out.unionByName(
        maps.select(F.lit("relabel").alias("rule"), F.col("a").alias("columns"), F.lit(target).alias("target"), F.lit(None).cast("double").alias("k"))
    )
    if flags:
        out = out.unionByName(mine_or(df, flags, target))
    return out


def functional_maps(df: DataFrame, cols: list[str], targets: list[str], unique: float = 0.5) -> DataFrame:
    """(rule, columns, target, n, levels) for every column whose each value has a single target level.

    relabel where the levels also map back, map where several share one, and near-unique
    map where more than ``unique`` of the rows have a value of their own. Rows with a null
    on either side are left out, n counts the others; both sides need two levels. Each
    (column, value) is grouped once for all targets.
    """
    each = F.array(*[F.struct(F.lit(c).alias("columns"), F.col(c).cast("string").alias("u")) for c in cols])
    to = F.struct(*[F.col(t).cast("string").alias(f"y{i}") for i, t in enumerate(targets)]).alias("to")
    seen = df.select(F.explode(each).alias("e"), to).select("e.*", "to.*").where("u IS NOT NULL")
    aggs = [f(f"y{i}").alias(f"{k}{i}") for i in range(len(targets)) for f, k in ((F.min, "lo"), (F.max, "hi"), (F.count, "n"))]
    per = seen.groupBy("columns", "u").agg(*aggs)
    one = F.array(*[F.struct(F.lit(t).alias("target"), F.col(f"lo{i}").alias("lo"), F.col(f"hi{i}").alias("hi"), F.col(f"n{i}").alias("n")) for i, t in enumerate(targets)])
    maps = per.select("columns", F.explode(one).alias("e")).select("columns", "e.*").where("n > 0 AND columns <> target")
    # one row for each target level, so that the number of levels needs no distinct count
    maps = maps.groupBy("columns", "target", "lo").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("levels"), F.bool_and(F.col("lo") == F.col("hi")).alias("single"))
    maps = maps.groupBy("columns", "target").agg(F.sum("n").alias("n"), F.sum("levels").alias("levels"), F.count(F.lit(1)).alias("levels_y"), F.bool_and("single").alias("single"))
    rule = F.when(F.col("levels") == F.col("levels_y"), "relabel").when(F.col("levels") > unique * F.col("n"), "near-unique map").otherwise("map")
    return maps.where("single AND levels_y > 1").select(rule.alias("rule"), "columns", "target", "n", "levels")


def additive_identities(df: DataFrame, cols: list[str], targets: list[str] | None = None, tol: float = TOL) -> DataFrame:
    """(rule, columns, target, weights, shift, n): target = sum of weight * column + shift on every row.

    ``sum`` where two or more columns enter as they are and nothing is added, ``identity``
    for one such column, ``linear`` otherwise. One pass over the table gives the correlations
    of the numeric columns; their null vectors, as many numbers as the schema has pairs, propose
    the identities, of any length, and a second pass over all rows admits them: the difference
    of both sides may not vary by more than ``tol`` of the largest terms. For each target there is
    the identity over the columns named first, and for each column in it one that does
    without, if there is one; all others follow from these. Columns that hold a null or a
    value that is not finite, and constant ones, enter none. A term whose spread is below
    1e-5 of its target's is too small for double precision to see in a product.
    """
    cols = list(dict.fromkeys([*cols, *(targets or [])]))
    targets = targets or cols
    x = {c: F.col(c).cast("double") for c in cols}
    fine = [F.struct(F.count(F.when(F.abs(v) < float("inf"), v)).alias("n"), F.stddev_pop(v).alias("sd"), F.min(v).alias("lo"), F.max(v).alias("hi")) for v in x.values()]
    seen = df.agg(F.count(F.lit(1)).alias("n"), *[f.alias(f"s{i}") for i, f in enumerate(fine)]).first()
    use = [c for i, c in enumerate(cols) if 0 < seen["n"] == seen[f"s{i}"]["n"] and seen[f"s{i}"]["lo"] < seen[f"s{i}"]["hi"]]
    sd = {c: seen[f"s{cols.index(c)}"]["sd"] for c in use}
    found = _proposed(df.select(*[x[c].alias(f"x{i}") for i, c in enumerate(use)]), use, sd, targets) if len(use) > 1 else []
    shape = "rule string, columns string, target string, weights array<double>, shift double, n long"
    if not found:
        return df.sparkSession.createDataFrame([], shape)
    aggs = []
    for i, (t, parts) in enumerate(found):
        terms = [F.lit(w) * x[c] for c, w in parts]
        rest = reduce(lambda a, b: a - b, terms, x[t])
        size = reduce(lambda a, b: a + F.abs(b), terms, F.abs(x[t]))
        aggs += [F.min(rest).alias(f"lo{i}"), F.max(rest).alias(f"hi{i}"), F.max(size).alias(f"size{i}")]
    each = []
    for i, (t, parts) in enumerate(found):
        lo, hi, size = F.col(f"lo{i}"), F.col(f"hi{i}"), F.col(f"size{i}")
        middle = (lo + hi) / 2
        names, weights = F.lit("+".join(c for c, _ in parts)), F.array(*[F.lit(w) for _, w in parts])
        shift = F.when(F.abs(middle) <= tol * size, 0.0).otherwise(middle)
        plain = F.lit("identity" if len(parts) == 1 else "sum")
        rule = F.when((shift == 0) & F.lit(all(w == 1 for _, w in parts)), plain).otherwise("linear")
        each.append(F.struct(rule.alias("rule"), names.alias("columns"), F.lit(t).alias("target"), weights.alias("weights"), shift.alias("shift"), (hi - lo <= tol * size).alias("held")))
    row = df.agg(F.count(F.lit(1)).alias("n"), *aggs).select("n", F.explode(F.array(*each)).alias("e"))
    return row.where("e.held").select("e.rule", "e.columns", "e.target", "e.weights", "e.shift", "n")


def _proposed(df: DataFrame, use: list[str], sd: dict[str, float], targets: list[str]) -> list[tuple[str, list[tuple[str, float]]]]:
    """(target, [(column, weight)]) of the null vectors of the correlation matrix."""
    vectors = VectorAssembler(inputCols=df.columns, outputCol="v").transform(df).select("v")
    values, space = np.linalg.eigh(Correlation.corr(vectors, "v").first()[0].toArray())
    space = space[:, values < NULL_EIGENVALUE].T
    found: dict[tuple, tuple] = {}
    for t in [t for t in targets if t in use]:
        k = use.index(t)
        first = _eliminate(space, [k])
        if first is None:
            continue
        for v in [first, *[_eliminate(space, [k, p]) for p in np.flatnonzero(first) if p != k]]:
            if v is not None:
                parts = [(use[i], _near_whole(-v[i] * sd[t] / sd[use[i]])) for i in np.flatnonzero(v) if i != k]
                found.setdefault((t, tuple(c for c, _ in parts)), (t, parts))
    return list(found.values())


def _eliminate(space: np.ndarray, first: list[int]) -> np.ndarray | None:
    """The null vector with 1 at ``first[0]`` and 0 at the other pivots: the rest of ``first``, then
    columns from the last to the first. None where there is no such vector."""
    rows, target = space.copy(), first[0]
    order = first + [i for i in range(space.shape[1] - 1, -1, -1) if i not in first]
    for r, p in zip(range(len(rows)), _pivots(rows, order)):
        rows[r] /= rows[r, p]
        for other in range(len(rows)):
            if other != r:
                rows[other] -= rows[other, p] * rows[r]
        if r == 0 and p != target:
            return None
    if not len(rows):
        return None
    v = np.where(np.abs(rows[0]) < 1e-5, 0.0, rows[0])
    return None if np.any(v[first[1:]] != 0) or not np.any(np.delete(v, target)) else v


def _pivots(rows: np.ndarray, order: list[int]):
    """Next pivot column in ``order`` that a row not yet used can serve; that row is swapped up."""
    done = 0
    for p in order:
        if done == len(rows):
            return
        best = done + int(np.argmax(np.abs(rows[done:, p])))
        if abs(rows[best, p]) > 1e-5:
            rows[[done, best]] = rows[[best, done]]
            yield p
            done += 1


def _near_whole(w: float) -> float:
    whole = float(round(w))
    return whole if whole and abs(w - whole) < 1e-5 * max(1.0, abs(w)) else float(f"{w:.9g}")


def sweep_rules(df: DataFrame, cols: list[str], targets: list[str], flags: list[str] | None = None) -> DataFrame:
    """(rule, columns, target, k) of every known shape over all (column, target) pairs.

    Maps and relabels are looked for under every target, sums of any length under every numeric
    one; the other shapes of ``mine_rules`` and the negated OR (no flag is set exactly where
    y = 1) need a 0/1 target and numeric columns.
    """
    binary = df.agg(*[F.min(F.col(t).isNull() | F.coalesce(F.col(t).try_cast("double").isin(0.0, 1.0), F.lit(False))).alias(t) for t in targets]).first()
    binary = [t for t in targets if binary[t] and dict(df.dtypes)[t] not in ("string", "boolean")]
    kinds = {f.name: f.dataType for f in df.schema}
    numeric = [c for c in cols if isinstance(kinds[c], NumericType)]
    k = F.lit(None).cast("double").alias("k")
    out = functional_maps(df, cols, targets).select("rule", "columns", "target", k)
    ends = [t for t in targets if isinstance(kinds[t], NumericType)]
    if numeric and ends:
        out = out.unionByName(additive_identities(df, numeric, ends).where("rule = 'sum'").select("rule", "columns", "target", k))
    for t in binary:
        use, on = [c for c in numeric if c != t], [f for f in flags or [] if f != t]
        out = out.unionByName(mine_rules(df, use, t, on, sums=False).where("rule <> 'relabel'"))
        if on:
            out = out.unionByName(mine_or(df, on, t, True))
    return out.where("columns <> ''")


def mine_or(df: DataFrame, flags: list[str], target: str, negated: bool = False) -> DataFrame:
    """The OR of all flags that imply the target, if it equals the target everywhere; ``negated`` takes target = 0 instead."""
    one = F.col(target) == (0 if negated else 1)
    ok = [count_if(F.coalesce((F.col(f) == 1) & ~one, F.lit(False))) for f in flags]
    row = df.agg(*[k.alias(f"b{i}") for i, k in enumerate(ok)]).select(
        F.array(*[F.col(f"b{i}") == 0 for i in range(len(flags))]).alias("use")
    )
    use = row.scalar()
    hit = F.lit(False)
    for i, f in enumerate(flags):
        hit = hit | (F.col("_use")[i] & F.coalesce(F.col(f) == 1, F.lit(False)))
    agreed = df.withColumn("_use", use).agg(F.count(F.lit(1)).alias("n"), F.sum(holds(hit == one)).cast("long").alias("k"), F.first("_use").alias("_use"))
    names = F.array_join(
        F.filter(F.array(*[F.when(F.col("_use")[i], F.lit(f)) for i, f in enumerate(flags)]), lambda x: x.isNotNull()), "|"
    )
    return agreed.where("n = k AND n > 0").select(
        F.lit("not or" if negated else "or").alias("rule"), names.alias("columns"), F.lit(target).alias("target"), F.lit(None).cast("double").alias("k")
    )


def role_gate(hits: DataFrame, roles: DataFrame, keys: list[str]) -> DataFrame:
    """Status of each mined rule once the archive's column roles are looked at: a
    leak column that is itself a Target is no leak."""
    j = hits.join(roles, keys, "left")
    return j.withColumn(
        "status",
        F.when(F.col("role") == "Target", "EXCLUDED (leak column is a Target)")
        .when(F.col("held"), "admitted")
        .otherwise("REFUSED (rule fails)"),
    )


def role_detector(hits: DataFrame, roles: DataFrame, keys: list[str], record: list[str]) -> DataFrame:
    """'Refuse any column marked Target', scored as a detector over the records."""
    per = hits.join(roles, keys, "left").groupBy(*record).agg(F.bool_or(F.coalesce(F.col("role") == "Target", F.lit(False))).alias("hit"))
    return per.agg(count_if(F.col("hit")).alias("caught"), F.count(F.lit(1)).alias("n_records"))
