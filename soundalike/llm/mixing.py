"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

A source's target, divided by its size, says how often each of its documents is wanted on average: a whole
number of copies and a fraction.  Fractions are rounded by the pivotal method in its size-weighted form: two
documents with fractions ``p`` and ``q`` and sizes ``a`` and ``b`` exchange mass, at random in either
direction, until one of them is 0 or 1; ``a p + b q`` is the same before and after, and every document keeps
its expected number of copies.  Documents of one source and size class (powers of two) are folded so in groups
of about ``GROUP``; each group leaves one document with a fraction, and these meet in the next level of a
reduction tree, until one per class is left.  About ``GROUP`` documents of every class are held back for the
root: it folds what the classes have left from large to small, so that a large document settles against ever
smaller ones.  One document per source remains, as a rule a small one, and a coin with that chance decides
it: a source misses its target by less than that document.

Groups are chosen by hash, so a source with a third of all rows is many bounded groups; the root of a source
has at most some 64 classes.
Rows equal in every column are one unit with a multiplicity.  Chance comes from hashes of the rows and the
seed: reruns agree, whatever the partitioning.

Defined results: null or empty texts have size 0, take no words and get the whole-number part of their
source's factor; null sources are a source, the last one; no rows give no rows; a mix without any words takes
none.  Texts of any length are counted whole.  Extra columns are carried along unchanged.

Targets are worked out on one row per source in one task (a running sum over sources, not over documents).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from soundalike.llm.common import WORD, need, private, query, stored, table, text_of

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0
GROUP = 64
NEARLY = 1e-9


def n_words(text: str | Column) -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """(source, size) rows to (source, source_size, target).

    Sources in code point order, null last, get ``weights`` in turn.  A target is ``min(cap * size, rate *
    weight)`` with the one rate at which all targets sum to all sizes; that is where resharing ends.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)),
                          (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    most = F.col("source_size") * F.lit(float(cap))
    per = per.withColumn("weight", weight).withColumn("ratio", most / F.col("weight"))
    fill = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    onward = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rate = ((F.sum("source_size").over(every) - F.coalesce(F.sum(most).over(before), F.lit(0.0)))
            / F.sum("weight").over(onward))
    per = per.withColumn("rate", rate)
    # The first source, from the one soonest full on, that the shared rate does not fill.
    per = per.withColumn("rate", F.coalesce(
        F.first(F.when(F.col("rate") <= F.col("ratio"), F.col("rate")), ignorenulls=True).over(every),
        F.max("ratio").over(every)))
    return per.select("source", "source_size", F.least(most, F.col("rate") * F.col("weight")).alias("target"))


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _chance(seed: int, *columns: Column) -> Column:
    """Uniform in [0, 1)."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11).cast("double")
            / F.lit(float(1 << 53)))


def _with_p(item: Column, p: Column) -> Column:
    return item.withField("p", p)


def _exchange(seed: int):
    """The fold: the document still open meets the next one; one of them is settled."""
    def step(state: Column, x: Column) -> Column:
        def moved(v: Column) -> Column:
            cur, p, q, ratio = v["cur"], v["cur"]["p"], x["p"], v["cur"]["size"] / x["size"]
            up, down = F.least(1 - p, q / ratio), F.least(p, (1 - q) / ratio)

            def settle(d: Column) -> Column:
                gain = F.when(d["rise"], d["up"]).otherwise(-d["down"])
                first = F.when(d["rise"], 1 - p <= q / ratio).otherwise(p <= (1 - q) / ratio)
                mine = F.when(first, F.when(d["rise"], 1.0).otherwise(0.0)).otherwise(p + gain)
                other = F.when(first, F.least(F.lit(1.0), F.greatest(F.lit(0.0), q - gain * ratio))
                               ).otherwise(F.when(d["rise"], 0.0).otherwise(1.0))
                return F.struct(
                    F.when(first, _with_p(x, other)).otherwise(_with_p(cur, mine)).alias("cur"),
                    F.concat(v["done"], F.array(F.when(first, _with_p(cur, mine)).otherwise(
                        _with_p(x, other)))).alias("done"))
            return _let(F.struct(up.alias("up"), down.alias("down"), (
                _chance(seed, cur["u"], x["u"]) * (up + down) < down).alias("rise")), settle)
        return F.when(state["cur"].isNull(), F.struct(x.alias("cur"), state["done"].alias("done"))
                      ).otherwise(moved(state))
    return step


def _fold(open_rows: DataFrame, seed: int, *keys: str | Column) -> DataFrame:
    """Rows with ``p`` settled, and one open row per group of equal ``keys``."""
    kind = "struct<" + ",".join(f"{n}:{t}" for n, t in open_rows.dtypes) + ">"
    item = F.struct(*open_rows.columns)
    grouped = open_rows.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("items"))
    start = F.struct(F.lit(None).cast(kind).alias("cur"), F.array().cast(f"array<{kind}>").alias("done"))
    folded = grouped.select(F.aggregate("items", start, _exchange(seed)).alias("s"))
    marked = folded.select(F.explode(F.concat(
        F.transform(F.col("s.done"), lambda x: F.struct(x.alias("x"), F.lit(False).alias("open"))),
        F.array(F.struct(F.col("s.cur").alias("x"), F.lit(True).alias("open"))))).alias("e"))
    return marked.select("e.x.*", "e.open")


def plan_units(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int,
               weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """Units (equal rows) with the copies they get together: u, v, id, source, size, rows, copies, ..."""
    need(docs, id_col, text_col, source_col)
    u, v = row_hashes(docs, seed)
    narrow = docs.select(u.alias("u"), v.alias("v"), F.col(id_col).alias("id"),
                         F.col(source_col).alias("source"), n_words(text_col).alias("size"))
    units = stored(narrow.groupBy("u", "v", "id", "source", "size").agg(
        F.count(F.lit(1)).alias("rows")), "mix-units")
    targets = source_targets(units.select("source", (F.col("size") * F.col("rows")).alias("size")), weights, cap)
    units = units.withColumn("class", F.floor(F.log2(F.greatest("size", F.lit(1)))).cast("int"))
    classes = units.where("size > 0").groupBy("source", "class").agg(F.count(F.lit(1)).alias("members"))
    classes = stored(classes, "mix-classes")
    most = classes.agg(F.max("members")).first()[0] or 0
    rows = _beside(_beside(units, targets, "source"), classes, "source", "class")
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("want", F.when(F.col("size") > 0, wanted * F.col("rows")).otherwise(
        F.floor(wanted) * F.col("rows")))
    rows = rows.withColumn("whole", F.floor(F.col("want") + NEARLY)).withColumn(
        "p", F.greatest(F.lit(0.0), F.col("want") - F.col("whole"))).drop("want")
    rows = rows.withColumn("p", F.when((F.col("p") < NEARLY) | (F.col("size") == 0), 0.0).otherwise(F.col("p")))
    # The fold goes from large to small: this column comes first in the order.
    rows = stored(rows.select((-F.col("size")).alias("order"), *rows.columns), "mix-rows")
    held = F.pmod(F.xxhash64(F.lit(seed + 2), "u"), F.col("members")) < GROUP
    parts = [rows.where("p = 0")]
    open_rows, root = rows.where((F.col("p") > 0) & ~held), rows.where((F.col("p") > 0) & held)
    level = 0
    while GROUP ** level < most:
        width = F.greatest(F.lit(1), F.ceil(F.col("members") / F.lit(float(GROUP) ** (level + 1))))
        bucket = F.pmod(F.xxhash64(F.lit(seed + level), "u"), width)
        out = stored(_fold(open_rows, seed + level, "source", "class", bucket), "mix-level")
        parts.append(out.where("not open").drop("open"))
        open_rows = out.where("open").drop("open")
        level += 1
    out = stored(_fold(open_rows.unionByName(root), seed + level, "source"), "mix-root")
    coin = (_chance(seed, F.col("u"), F.lit("last")) < F.col("p")).cast("double")
    parts.append(out.withColumn("p", F.when(F.col("open"), coin).otherwise(F.col("p"))).drop("open"))
    done = parts[0]
    for part in parts[1:]:
        done = done.unionByName(part)
    return done.withColumn("copies", (F.col("whole") + F.round("p")).cast("long")).select(
        "u", "v", "id", "source", "size", "rows", "source_size", "target", "copies")


def _beside(rows: DataFrame, facts: DataFrame, *keys: str) -> DataFrame:
    """Rows with the columns of ``facts`` for their keys; null is a key like any other."""
    facts = facts.withColumnsRenamed({k: f"other_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"other_{k}"))
    return rows.join(facts, same, "left").drop(*[f"other_{k}" for k in keys])


def row_hashes(docs: DataFrame, seed: int) -> tuple[Column, Column]:
    """Two hashes of a whole row; columns that hold maps are hashed as JSON."""
    columns = [F.to_json(F.col(f"`{n}`")) if "map<" in kind else F.col(f"`{n}`") for n, kind in docs.dtypes]
    return F.xxhash64(F.lit(seed), *columns), F.xxhash64(F.lit(seed + 1), *columns)


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
              seed: int = 17, weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """One row per row of ``docs``: id, size, source_size, target, taken, source, copies."""
    units = plan_units(docs, id_col, text_col, source_col, seed, weights, cap)
    each = units.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("nth"))
    copies = F.floor(F.col("copies") / F.col("rows")) + (
        F.col("nth") <= F.pmod("copies", "rows")).cast("long")
    return each.withColumn("copies", copies).select(
        F.col("id").alias(id_col), "size", "source_size", "target",
        (F.col("copies") * F.col("size")).alias("taken"), F.col("source").alias(source_col), "copies")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        seed: int = 17, weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it is taken, columns unchanged."""
    units = plan_units(docs, id_col, text_col, source_col, seed, weights, cap)
    a, b, m, k = (private(x) for x in ("u", "v", "rows", "copies"))
    u, v = row_hashes(docs, seed)
    chosen = units.where("copies > 0").select(F.col("u").alias(a), F.col("v").alias(b),
                                              F.col("rows").alias(m), F.col("copies").alias(k))
    met = docs.withColumn(a, u).withColumn(b, v).join(chosen, [a, b])
    single = met.where(F.col(m) == 1)
    whole = private("row")
    repeated = met.where(F.col(m) > 1).groupBy(a, b).agg(
        F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias(whole), F.first(k).alias(k))
    repeated = repeated.select(f"{whole}.*", k)
    both = single.select(*[F.col(f"`{c}`") for c in docs.columns], k).unionByName(repeated)
    nth = private("nth")
    return both.withColumn(nth, F.explode(F.sequence(F.lit(1).cast("long"), F.col(k)))).drop(nth, k)


@query("op7_mixing")
def op7(spark, sf_dir):
    return decisions(table(spark, sf_dir, "documents"))
