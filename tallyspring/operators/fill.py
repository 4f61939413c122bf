"""Missing entries: which they are, and values for them from similar rows.

An entry is missing where it is null, NaN, blank, or holds something written in place of an entry.
What is written in place of entries is found in the data: a filler number lies far outside the own
range of several unrelated series; a filler word is nowhere the usual entry of a group whose rows
all carry the same one; a filler date is a month in which no series has data. Well-known marks and
numbers (a panel's ``marks`` and ``numbers``, by default a fixed list) count as such where the data alone are too few to tell.

Filling, by which entries are also found and listed, is time-ordered per series: numbers are interpolated between the observed neighbours,
categories carried within a gap limit; months without a row are made. Every filled entry has its
method and its distance (in periods) from the nearest observation.

Defined cases: zero is a real value; a row without a series or a month keeps its entries, the missing
ones marked ``none``; a series without any observed value stays unfilled (``none``); repeated rows of a
period are each filled alike; empty tables give empty results.
"""

from __future__ import annotations

import datetime
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspring.session import materialize

# Words and marks that people and programs write where an entry is missing.
MARKS = (
    "#n/a", "#na", "#null!", "#ref!", "#value!", "(blank)", "(leer)", "(null)", "*", "-", "--", "---", ".", "..", "...", "?", "??", "???", "empty", "k. a.", "k.a.",
    "keine angabe", "leer", "missing", "n. a.", "n.a.", "n.v.", "n/a", "na", "nan", "nil", "no data", "none", "not available", "not set", "null", "pending", "tba", "tbc",
    "tbd", "undefined", "unk", "unknown", "unset", "x", "xx", "xxx", "_", "/",
)
# Numbers that programs write where a number is missing.
NUMBERS = (-99.0, -999.0, -9999.0, -99999.0, 99999.0, 999999.0, 9999999.0, 99999.99, 999999.99, 1e30, -1e30, -999.25, 1e20, -1e20, -32768.0, -2147483648.0, 2147483647.0)

#: Series in which a number must lie far outside to be a filler by the data alone; and groups for a word.
SERIES, GROUPS = 3, 3
#: Minus the logarithm of the chance (Chernoff's bound for a Poisson count) below which that many series with the same far number are no coincidence.
UNLIKELY = 16.0
#: Copies of a series' quantiles.
SALTS = 8
#: Fillers that are sent to the executors as literals; more than that are joined.
LITERALS = 1_000
#: Months and words that are looked up together on the driver; more than that are looked up one by one.
TOLD = 50_000


def is_blank(c: Column) -> Column:
    """Null, empty, or nothing but white space, control and zero-width characters."""
    return c.isNull() | (F.regexp_replace(c, r"[\s\p{Z}\p{C}]", "") == "")


def plain(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"^[\s\p{Z}\p{C}]+|[\s\p{Z}\p{C}]+$", ""))


def filler_numbers(values: DataFrame, known: tuple[float, ...] = NUMBERS) -> DataFrame:
    """Of series, v (double): the numbers, as ``filler``, that stand in place of entries."""
    real = values.where(F.col("v").isNotNull() & ~F.isnan("v") & (F.col("v") != 0) & F.col("series").isNotNull())
    # per series and value first: repeated values shrink to one row before anything is shuffled far. The ranges come from
    # the same grouping, so that the tables are read and shuffled once; values within a hundredth of each other stand together,
    # which bounds what comes to one place of a series (its width is at least a fifth of its median).
    each = real.groupBy("series", "v").agg(F.count(F.lit(1)).alias("n"))
    near = each.groupBy("series", F.signum("v").alias("side"), F.floor(F.log(F.abs("v")) * 100).alias("size")).agg(F.max("v").alias("v"), F.sum("n").alias("n"))
    q = near.groupBy("series").agg(F.percentile("v", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)), F.col("n")).alias("q"))
    # a series that holds a large part of the rows meets its three numbers in many tasks
    q = q.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    each = each.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    width = F.greatest(F.col("q")[2] - F.col("q")[0], F.abs(F.col("q")[1]) * 0.2, F.lit(1e-9))
    far = (F.col("v") < F.col("q")[0] - 3 * width) | (F.col("v") > F.col("q")[2] + 3 * width)
    listed = F.col("v").isin(*known) if known else F.lit(False)
    number = each.join(q, ["series", "salt"]).groupBy("v").agg(F.count(F.lit(1)).alias("series_n"), F.count(F.when(far, 1)).alias("far_n"), F.max(listed).alias("known")).where("far_n > 0")
    # a small part of the values, written once as it is looked at twice
    number = materialize(number, "far")
    # Where many series have far values of like size and as many decimals, some coincide: what stands in more series than that is a filler.
    decimals = reduce(lambda a, d: a.when(F.round("v", d) == F.col("v"), d), range(1, 6), F.when(F.round("v", 0) == F.col("v"), 0)).otherwise(6)
    number = number.withColumns({"side": F.signum("v"), "size": F.floor(F.log2(F.abs("v"))), "decimals": decimals})
    like = number.groupBy("side", "size", "decimals").agg(F.sum("far_n").alias("like_n"))
    possible = F.greatest(F.pow(F.lit(2.0), "size") * F.pow(F.lit(10.0), "decimals"), F.lit(1.0))
    chance = F.greatest(F.col("like_n") - F.col("far_n"), F.lit(1)) / possible
    more = F.col("far_n") * F.log(F.col("far_n") / chance) - F.col("far_n") + chance
    enough = (F.col("far_n") >= SERIES) & (F.col("far_n") * 2 > F.col("series_n")) & (F.col("far_n") > chance) & (more > UNLIKELY)
    return number.join(like, ["side", "size", "decimals"]).where(enough | (F.col("known") & (F.col("far_n") >= 1))).select(F.col("v").alias("filler"))


@dataclass
class Fillers:
    """What stands in place of entries: a few values as literals, or a table of many that is joined."""

    few: list | None
    many: DataFrame | None  # of one column

    @staticmethod
    def of(found: DataFrame) -> Fillers:
        got = [r[0] for r in found.limit(LITERALS + 1).collect()]
        return Fillers(got, None) if len(got) <= LITERALS else Fillers(None, found)

    def mark(self, rows: DataFrame, c: Column, name: str) -> DataFrame:
        """``rows`` with the flag ``name``: whether ``c`` is a filler."""
        if self.many is None:
            return rows.withColumn(name, F.coalesce(c.isin(*self.few), F.lit(False)) if self.few else F.lit(False))
        side = self.many.select(F.col(self.many.columns[0]).alias(f"{name}_is")).distinct()
        return rows.join(side, c == F.col(f"{name}_is"), "left").withColumn(name, F.col(f"{name}_is").isNotNull()).drop(f"{name}_is")


def month_of(c: Column) -> Column:
    """The month that a period key (YYYY-MM-DD) names; null where it is no day of the calendar."""
    # a cast is many times cheaper than a parser with a pattern, but takes other forms, too
    whole = c.like("____-__-__") & F.right(c, F.lit(1)).between("0", "9")
    return F.trunc(F.when(whole, c.try_cast("date")), "month")


def span_of_months(months: list[tuple]) -> tuple:
    """(first, last) month that series can have, of (month, rows): of the months that lie together (gaps of up to a year), the group with the most rows."""
    groups: list[list] = []
    for m, n in sorted(months):
        k = m.year * 12 + m.month
        if not groups or k - groups[-1][3] > 12:
            groups.append([m, m, 0, k])
        groups[-1][1:] = [m, groups[-1][2] + n, k]
    best = max(groups, key=lambda g: g[2], default=[None, None])
    return best[0], best[1]


@dataclass
class Panel:
    """A monthly table: what identifies a series, its number, and the categories with what fixes them."""

    name: str
    rows: DataFrame
    row_id: str
    period: str
    value: str
    series: list[str]
    categories: dict[str, str]  # category -> column whose rows all carry the same one
    period_may_miss: bool = True
    arrived: str | None = None  # when a row was loaded, which tells the month of one that lacks it
    marks: tuple[str, ...] = MARKS  # words that are fillers whatever the data say
    numbers: tuple[float, ...] = NUMBERS  # and numbers, where one is far outside a series


def _with_series(p: Panel, rows: DataFrame) -> DataFrame:
    """``rows`` with two hashes that stand for the series, null where a part of it is: they sort and travel better than names."""
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in p.series])
    names = [F.col(c).cast("string") for c in p.series]
    return rows.withColumns({"_s": F.when(whole, F.xxhash64(*names)), "_t": F.when(whole, F.xxhash64(F.lit("second"), *names))})


def _own(p: Panel, keep: tuple[str, ...] = ()) -> DataFrame:
    """The panel's own columns, so that others can't clash with what is made here."""
    return p.rows.select(*dict.fromkeys([p.row_id, p.period, p.value, *p.series, *p.categories, *p.categories.values(), *([p.arrived] if p.arrived else []), *keep]))


@dataclass
class Profile:
    """What the tables as a whole tell about a panel."""

    numbers: Fillers
    words: dict[str, Fillers] = field(default_factory=dict)  # per category what is written where an entry is missing
    span: tuple = (None, None)
    late: int | None = None  # months from a row's month to its arrival, most often


def profiles(panels: list[Panel]) -> list[Profile]:
    """Two passes over each table: one for the numbers of all series, one for words, months and arrivals, which are few when counted."""
    # for counting, a number stands for the series: it is a fraction of the name's size in the shuffle
    whole = [reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in p.series]) for p in panels]
    values = [
        p.rows.select(F.when(w, F.xxhash64(F.lit(p.name), *[F.col(c).cast("string") for c in p.series])).alias("series"), F.col(p.value).cast("double").alias("v")) for p, w in zip(panels, whole)
    ]
    both = lambda parts: reduce(lambda a, b: a.unionByName(b), parts)
    numbers = Fillers.of(filler_numbers(both(values), tuple(dict.fromkeys(v for p in panels for v in p.numbers))))
    kinds, months, marked = [], [], F.lit(False)
    for p in panels:
        rows, m = _own(p).withColumn("_month", month_of(F.col(p.period))), F.col("_month")
        late = (F.year(p.arrived) * 12 + F.month(p.arrived) - F.year(m) * 12 - F.month(m)).cast("string") if p.arrived else F.lit(None).cast("string")
        month = F.struct(F.lit(f"{p.name}/").alias("field"), m.cast("string").alias("grp"), late.alias("raw"))
        words = [F.struct(F.lit(f"{p.name}.{c}").alias("field"), F.col(g).cast("string").alias("grp"), F.col(c).cast("string").alias("raw")) for c, g in p.categories.items()]
        kinds.append(rows.select(F.explode(F.array(month, *words)).alias("e")).select("e.*"))
        months.append(f"{p.name}/")
        if p.categories and p.marks:
            marked |= F.col("field").isin(*[f"{p.name}.{c}" for c in p.categories]) & F.col("w").isin(*p.marks)
    is_month = F.col("field").isin(*months)
    # counted as they are written first; what follows works on the few different ones
    as_written = both(kinds).where(F.when(is_month, F.col("grp").isNotNull()).otherwise(F.col("raw").isNotNull())).groupBy("field", "grp", "raw").agg(F.count(F.lit(1)).alias("n"))
    each = as_written.groupBy("field", "grp", F.when(is_month, F.col("raw")).otherwise(plain(F.col("raw"))).alias("w")).agg(F.sum("n").alias("n"), F.collect_set("raw").alias("raws"))
    # one row per group and word, so the window is as small as a group's number of different words; blanks and rows without a group tell nothing
    tells = F.col("grp").isNotNull() & ~(~is_month & is_blank(F.col("w")))
    ranked = each.withColumn("top", tells & (F.row_number().over(Window.partitionBy("field", "grp", tells).orderBy(F.desc("n"), "w")) == 1)).withColumn("tells", tells)
    told = ranked.groupBy("field", F.when(is_month, F.col("grp")).alias("month"), "w").agg(
        F.count(F.when(F.col("top"), 1)).alias("tops"), F.count(F.when(F.col("tells") & ~F.col("top"), 1)).alias("others"), F.sum("n").alias("n"), F.array_distinct(F.flatten(F.collect_list("raws"))).alias("raws")
    )
    # months stay apart; of words, those that are never a group's usual entry but stand in several groups' rows, known marks and blanks
    filler = (F.col("tops") == 0) & (F.col("others") >= GROUPS)
    told = told.where(is_month | filler | marked | is_blank(F.col("w"))).select("field", "month", "n", F.explode_outer("raws").alias("raw"))
    told = materialize(told, "told")
    # one number per month of the calendar and lateness, and usually few words, in one go
    got = told.limit(TOLD + 1).collect()
    calendar = got if len(got) <= TOLD else told.where(is_month).collect()
    calendar = [(r["field"], datetime.date.fromisoformat(r["month"]), None if r["raw"] is None else int(r["raw"]), r["n"]) for r in calendar if r["month"] is not None]

    def written(name: str) -> Fillers:
        if len(got) <= TOLD:
            mine = [r["raw"] for r in got if r["field"] == name and r["raw"] is not None]
            if len(mine) <= LITERALS:
                return Fillers(mine, None)
        return Fillers.of(told.where((F.col("field") == name) & F.col("raw").isNotNull()).select("raw"))

    out = []
    for p, name in zip(panels, months):
        mine = [r[1:] for r in calendar if r[0] == name]
        by_month: dict = {}
        for m, _, n in mine:
            by_month[m] = by_month.get(m, 0) + n
        lo, hi = span_of_months(list(by_month.items()))
        lates: dict[int, int] = {}
        for m, late, n in mine:
            if late is not None and lo <= m <= hi:
                lates[late] = lates.get(late, 0) + n
        words = {c: written(f"{p.name}.{c}") for c in p.categories}
        out.append(Profile(numbers, words, (lo, hi), min(lates, key=lambda k: (-lates[k], k), default=None)))
    return out


def flags(p: Panel, known: Profile, keep: tuple[str, ...] = ()) -> DataFrame:
    """The panel's rows with a flag ``no_<field>`` per field, and ``_m``, the month (null where missing).

    Of other columns only those in ``keep`` stay, where a panel has them.
    """
    month, (lo, hi), v = F.col("_month"), known.span, F.col(p.value).cast("double")
    # a column of its own, so that it is made once per row
    df = _own(p, tuple(c for c in keep if c in p.rows.columns)).withColumn("_month", month_of(F.col(p.period)))
    df = known.numbers.mark(df, v, "_filler")
    real_month = F.coalesce(month.between(F.lit(lo), F.lit(hi)), F.lit(False)) if lo is not None else F.lit(False)
    made = {f"no_{p.value}": v.isNull() | F.isnan(v) | F.col("_filler"), "_m": F.when(real_month, month)}
    if p.period_may_miss:
        made[f"no_{p.period}"] = ~real_month
    for c in p.categories:
        df = known.words[c].mark(df, F.col(c), f"_word_{c}")
        made[f"no_{c}"] = F.col(c).isNull() | F.col(f"_word_{c}")
    return df.withColumns(made).drop("_filler", "_month", *[f"_word_{c}" for c in p.categories])


def flagged(panels: list[Panel], keep: tuple[str, ...] = ()) -> list[DataFrame]:
    """``flags`` of each panel."""
    return [flags(p, known, keep) for p, known in zip(panels, profiles(panels))]


def missing_entries(panels: list[Panel]) -> DataFrame:
    """table_name, row_id, field_name of every entry that filling marks as not observed."""
    parts = []
    for p, known in zip(panels, profiles(panels)):
        fields = [p.value, *([p.period] if p.period_may_miss else []), *p.categories]
        marked = F.explode(F.filter(F.array(*[F.when(F.col(f"{f}_method") != "observed", F.lit(f)) for f in fields]), lambda x: x.isNotNull()))
        parts.append(filled(p, known, incomplete_only=True).select(F.lit(p.name).alias("table_name"), F.col(p.row_id).cast("long").alias("row_id"), marked.alias("field_name")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def filled(panel: Panel, known: Profile, gap_limit: int = 12, incomplete_only: bool = False, decimals: int | None = None) -> DataFrame:
    """Rows of the panel, and a row for each month without one, with every entry and per field its method and distance.

    Rows without a month get the one that rows usually arrive for at that time, if their series lacks it. One series has
    at most a few hundred months; rows of the same month are first brought to one observation, so a window over a series is
    bounded by the calendar however often rows repeat. With ``incomplete_only`` only rows that lack an entry come out;
    ``decimals`` rounds the numbers that are filled in.
    """
    p = panel
    cats = list(p.categories)
    base = _with_series(p, flags(p, known))
    guess = F.lit(None).cast("date")
    if p.arrived and p.period_may_miss and known.late is not None:
        guess = F.when(F.col("_m").isNull() & F.col("_s").isNotNull(), F.add_months(F.trunc(p.arrived, "month"), -known.late))
    base = base.withColumn("_k", F.coalesce("_m", guess))
    # only rows that are made take their series' names from elsewhere
    named = [] if incomplete_only else p.series
    # a guessed month counts only where the series has no row of it
    real = F.col("_m").isNotNull()
    observed = {"_v": (F.avg, F.when(~F.col(f"no_{p.value}"), F.col(p.value).cast("double"))), **{f"_c_{c}": (F.min, F.when(~F.col(f"no_{c}"), F.col(c))) for c in cats}}
    monthly = base.where("_k IS NOT NULL AND _s IS NOT NULL").groupBy("_s", "_t", F.col("_k").alias("_m")).agg(
        *[F.first(F.col(c).cast("string")).alias(f"_k_{c}") for c in named], F.max(real).alias("_real"), *[f(F.when(real, v)).alias(n) for n, (f, v) in observed.items()], *[f(F.when(~real, v)).alias(f"{n}_g") for n, (f, v) in observed.items()]
    )
    names = [f"_k_{c}" for c in named]
    monthly = monthly.select("_s", "_t", "_m", *names, "_real", *[F.when(F.col("_real"), F.col(n)).otherwise(F.col(f"{n}_g")).alias(n) for n in observed])
    w = Window.partitionBy("_s", "_t").orderBy("_m")
    # months up to the series' next one, the first of which is there
    gap = F.expr("sequence(0, coalesce(cast(months_between(_next, _m) as int), 1) - 1)")
    grid = monthly.withColumn("_next", F.lead("_m").over(w)).withColumn("_j", F.explode(gap)).withColumn("_there", F.when(F.col("_j") == 0, True))
    grid = grid.select("_s", "_t", *names, F.add_months("_m", F.col("_j")).alias("_m"), "_there", F.when(F.col("_there"), F.col("_real")).alias("_real"), *[F.when(F.col("_there"), F.col(n)).alias(n) for n in observed])
    i = (F.year("_m") * 12 + F.month("_m")).cast("long")
    # the last observation up to a month, and, along the months backwards, the next one from it: frames that grow row by row
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("_s", "_t").orderBy(F.desc("_m")).rowsBetween(Window.unboundedPreceding, 0)
    seen = {n: F.when(F.col(n).isNotNull(), F.struct(F.col("_i").alias("i"), F.col(n).alias("v"))) for n in observed}
    grid = grid.withColumn("_i", i)
    grid = grid.withColumns({f"_l{n}": F.last(x, True).over(back) for n, x in seen.items()}).withColumns({f"_r{n}": F.last(x, True).over(ahead) for n, x in seen.items()})
    l, r = F.col("_l_v"), F.col("_r_v")
    both = l.isNotNull() & r.isNotNull()
    line = l["v"] + (r["v"] - l["v"]) * (F.col("_i") - l["i"]) / F.greatest(r["i"] - l["i"], F.lit(1))
    made = {
        "_value": F.when(both, line).otherwise(F.coalesce(l["v"], r["v"])),
        "_method": F.when(F.col("_v").isNotNull(), "month").when(both, "interpolated").when(l.isNotNull() | r.isNotNull(), "nearest").otherwise("none"),
        "_distance": F.least(F.col("_i") - l["i"], r["i"] - F.col("_i")),
    }
    for c in cats:
        l, r = F.col(f"_l_c_{c}"), F.col(f"_r_c_{c}")
        dl, dr = F.col("_i") - l["i"], r["i"] - F.col("_i")
        near = F.when(F.coalesce(dl, F.lit(10**6)) <= F.coalesce(dr, F.lit(10**6)), l["v"]).otherwise(r["v"])
        made |= {f"_n_{c}": F.when(F.least(dl, dr) <= gap_limit, near), f"_d_{c}": F.least(dl, dr)}
    grid = grid.withColumns(made)
    got = grid.select("_s", "_t", *names, F.col("_m").alias("_month"), "_there", "_real", "_value", "_method", "_distance", *[f"_n_{c}" for c in cats], *[f"_d_{c}" for c in cats])
    # Rows keep to a left join, whose larger side AQE may split where one series holds many of them; months without a row come apart from it.
    kept = base.withColumnsRenamed({"_s": "_bs", "_t": "_bt"})
    lacking = reduce(lambda a, b: a | b, [F.col(f"no_{c}") for c in [p.value, *cats, *([p.period] if p.period_may_miss else [])]])
    kept = kept.where(lacking) if incomplete_only else kept
    at = (F.col("_bs") == F.col("_s")) & (F.col("_bt") == F.col("_t")) & (F.col("_k") == F.col("_month")) & (F.col("_m").isNotNull() | ~F.col("_real"))
    joined = kept.join(got, at, "left").withColumn("row_made", F.lit(False))
    if not incomplete_only:
        joined = joined.unionByName(got.where("_there IS NULL").withColumn("row_made", F.lit(True)), allowMissingColumns=True)
    made = F.col("row_made")
    from_series = [(F.when(made, F.col(f"_k_{c}")).otherwise(F.col(c).cast("string")) if named else F.col(c).cast("string")).alias(c) for c in p.series]
    no_value = made | F.col(f"no_{p.value}")
    cols = [F.col(p.row_id), F.date_format(F.coalesce("_m", "_month"), "yyyy-MM-dd").alias(p.period), *from_series,
            F.when(no_value, F.col("_value") if decimals is None else F.round("_value", decimals)).otherwise(F.col(p.value).cast("double")).alias(p.value),
            F.when(~no_value, "observed").otherwise(F.coalesce("_method", F.lit("none"))).alias(f"{p.value}_method"),
            F.when(~no_value, 0).otherwise(F.col("_distance")).alias(f"{p.value}_distance"), "row_made",
            F.when(made, "made").when(F.col("_m").isNotNull(), "observed").when(F.col("_month").isNotNull(), "from_arrival").otherwise("none").alias(f"{p.period}_method")]
    for c in cats:
        none = made | F.col(f"no_{c}")
        cols += [F.when(none, F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c),
                 F.when(~none, "observed").when(F.col(f"_n_{c}").isNotNull(), "carried").otherwise("none").alias(f"{c}_method"),
                 F.when(~none, 0).otherwise(F.col(f"_d_{c}")).alias(f"{c}_distance")]
    return joined.select(*cols)
