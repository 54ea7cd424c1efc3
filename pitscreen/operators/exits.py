"""Exit rules over the price path that follows each entry.

A path is an array of at most `horizon` bars, put together from the blocks of
the ticker's series that it runs through. Rule grids
run on the arrays where they are; the long form (one row per day) serves
path-level statistics and stays in the partitioning by ticker.
"""
from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.guards import holds
from .events import HOLD_BARS
from .ranking import quantile_summary
from .windows import KEY, TS, bar_index

# The exit-rule grid (name, family and parameters of each variant).
TIME_EXITS = (63, 126, 189, 252)
HARD_STOPS = (25, 30, 35, 40)
ARM_LEVELS, TRAILS = (10, 15, 20), (8, 10, 15)
HYBRID_HORIZONS, EMERGENCY = (126, 189, 252), (30, 40)
TARGETS = (20, 25, 30)
SPREAD_FLOOR = 0.08
RANDOM_MEAN = 0.223
HOLD_MEAN = 0.344


def path_arrays(entries: DataFrame, bars: DataFrame, horizon: int = HOLD_BARS, full_only: bool = True, block: int = HOLD_BARS) -> DataFrame:
    """entries(ticker, date, pos) to (ticker, entry_date, entry_price, entry_atr, entry_score, ahead[d, c, a, s]).

    `bars` may carry pos (which counts a ticker's bars without gaps), atr_14 and composite_score. A ticker's history is cut
    into blocks of `block` bars, each with the blocks after it that a path may reach, so no row holds more than
    horizon + 2 * block bars, however long the history. Blocks and the positions of the entries meet by ticker alone: over
    `clustered` bars nothing is exchanged, and a path is cut out where its block lies, never sorted or sent.
    """
    extra = lambda name: F.col(name) if name in bars.columns else F.lit(None).cast("double")
    placed = bars if "pos" in bars.columns else bars.withColumn("pos", bar_index())
    bar = F.struct(F.col(TS).alias("d"), F.col("close").alias("c"), extra("atr_14").alias("a"), extra("composite_score").alias("s"))
    blocks = placed.groupBy(KEY, F.floor(F.col("pos") / block).alias("_block")).agg(
        F.array_sort(F.collect_list(bar)).alias("_bars"), F.min("pos").cast("int").alias("_start"))
    reach = Window.partitionBy(KEY).orderBy("_block").rangeBetween(0, -(-horizon // block))
    blocks = blocks.withColumn("_bars", F.flatten(F.collect_list("_bars").over(reach)))
    entered = entries.groupBy(KEY).agg(F.collect_list(F.col("pos").cast("int")).alias("_at"))
    inside = F.filter("_at", lambda p: F.floor(p / block) == F.col("_block"))
    met = blocks.join(entered, KEY).select(KEY, "_bars", "_start", F.explode(inside).alias("_pos"))
    met = met.select(KEY, "_bars", (F.col("_pos") - F.col("_start") + 1).alias("_i"))
    met = met.where(F.size("_bars") - F.col("_i") >= (horizon if full_only else 1))
    first = F.element_at("_bars", F.col("_i"))
    cut = met.select(KEY, first["d"].alias("entry_date"), first["c"].alias("entry_price"), first["a"].alias("entry_atr"), first["s"].alias("entry_score"),
                     F.slice("_bars", F.col("_i") + 1, F.lit(horizon)).alias("ahead"))
    return cut.where(F.col("entry_price") > 0)


def long_paths(arrays: DataFrame) -> DataFrame:
    """Path arrays to rows (ticker, entry_date, entry_price, entry_atr, day, date, close, atr, ratio)."""
    out = arrays.select(KEY, "entry_date", "entry_price", "entry_atr", F.posexplode("ahead").alias("_i", "_b"))
    return out.select(KEY, "entry_date", "entry_price", "entry_atr", (F.col("_i") + 1).alias("day"),
                      F.col("_b.d").alias("date"), F.col("_b.c").alias("close"), F.col("_b.a").alias("atr"),
                      (F.col("_b.c") / F.col("entry_price")).alias("ratio"))


def forward_paths(entries: DataFrame, bars: DataFrame, horizon: int = HOLD_BARS, full_only: bool = True) -> DataFrame:
    return long_paths(path_arrays(entries, bars, horizon, full_only))


def entry_positions(bars: DataFrame, keep: Column) -> DataFrame:
    """Bars kept as entries, with their 1-based position `pos` in the ticker's history."""
    return bars.withColumn("pos", bar_index()).where(keep)


def running_extremes(paths: DataFrame) -> DataFrame:
    w = Window.partitionBy(KEY, "entry_date").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return paths.withColumns({"run_min": F.min("ratio").over(w), "run_max": F.max("ratio").over(w)})


def _running(values: Column, pick: Callable[..., Column]) -> Column:
    """Running extreme of an array. A round takes in the extreme that ends 1, 2, 4, ... places before, until all places are reached."""
    last = F.greatest(F.lit(0), F.floor(F.log2(F.size(values).cast("double")))).cast("int")
    before = lambda acc, n: F.slice(F.concat(F.array_repeat(F.lit(None).cast("double"), n), acc), F.lit(1), F.size(acc))
    return F.aggregate(F.sequence(F.lit(0), last), values, lambda acc, k: F.zip_with(
        acc, before(acc, F.pow(F.lit(2.0), k).cast("int")), lambda x, y: pick(x, y)))


def array_extremes(arrays: DataFrame) -> DataFrame:
    """`running_extremes` of path arrays, as rows (ticker, entry_date, day, run_min, run_max): found inside each array, so no
    path is sorted or grouped again."""
    rows = arrays.select(KEY, "entry_date", F.transform("ahead", lambda b: b["c"] / F.col("entry_price")).alias("_r"))
    rows = rows.select(KEY, "entry_date", F.arrays_zip(_running(F.col("_r"), F.least).alias("lo"), _running(F.col("_r"), F.greatest).alias("hi")).alias("_x"))
    # outer: of an inner one Spark derives a filter on the size of the extremes, which finds them twice, without storing the ratios between
    out = rows.select(KEY, "entry_date", F.posexplode_outer("_x").alias("_i", "_b")).where(F.col("_i").isNotNull())
    return out.select(KEY, "entry_date", (F.col("_i") + 1).alias("day"), F.col("_b.lo").alias("run_min"), F.col("_b.hi").alias("run_max"))


def _first_day(ratios: Column, at_most: float | None = None, at_least: float | None = None) -> Column:
    """1-based day of the first ratio at or beyond the level, NULL without one."""
    hits = F.transform(ratios, lambda x: x <= at_most if at_most is not None else x >= at_least)
    return F.nullif(F.array_position(hits, F.lit(True)), F.lit(0))


def _trail_day(ratios: Column, arm: float, trail: float) -> Column:
    """First day at or after arming on which the ratio is `trail` below the running maximum."""
    start = F.struct(F.lit(0).cast("bigint").alias("day"), F.lit(0.0).alias("top"), F.lit(None).cast("bigint").alias("hit"))

    def step(acc: Column, x: Column) -> Column:
        day, top = acc["day"] + 1, F.greatest(acc["top"], x)
        out = acc["hit"].isNull() & (top >= 1 + arm) & (x <= top * (1 - trail))
        return F.struct(day.alias("day"), top.alias("top"), F.when(out, day).otherwise(acc["hit"]).alias("hit"))

    return F.aggregate(ratios, start, step, lambda acc: acc["hit"])


def _grid(ratios: Column, t: int) -> tuple[dict[str, Column], list[tuple]]:
    """First-hit days shared by the rules, and the rules as (family, name, end day, [(route, hit column)], armed column)."""
    days = {f"s{n}": _first_day(ratios, at_most=1 - n / 100) for n in HARD_STOPS}
    days |= {f"g{n}": _first_day(ratios, at_least=1 + n / 100) for n in TARGETS}
    days |= {f"a{n}": _first_day(ratios, at_least=1 + n / 100) for n in ARM_LEVELS}
    days |= {f"t{a}_{b}": _trail_day(ratios, a / 100, b / 100) for a in ARM_LEVELS for b in TRAILS}
    rules = [("F1", f"Hold {h}d", h, [], None) for h in TIME_EXITS if h <= t]
    rules += [("F2", f"Stop {n}%", t, [("stop", f"s{n}")], None) for n in HARD_STOPS]
    rules += [("F3", f"Arm+{a}% Tr{b}%", t, [("trail", f"t{a}_{b}")], f"a{a}") for a in ARM_LEVELS for b in TRAILS]
    rules += [("F4", f"H{h}d E{e}%", h, [("stop", f"s{e}")], None) for h in HYBRID_HORIZONS if h <= t for e in EMERGENCY]
    rules += [("F5", f"Tgt+{g}% E{e}%", t, [("target", f"g{g}"), ("stop", f"s{e}")], None) for g in TARGETS for e in EMERGENCY]
    return days, rules


def exit_outcomes(arrays: DataFrame, horizon: int = HOLD_BARS, families: Sequence[str] | None = None) -> DataFrame:
    """(ticker, entry_date, family, variant, ret, worst, hold, route, armed, final_ret) for the whole rule grid, or for the rules of `families`.

    Input: full path arrays of `path_arrays`. The first-hit days are found once
    per entry and shared by all rules; nothing is shuffled.
    """
    ratios = F.col("_r")
    base = arrays.withColumn("_r", F.transform("ahead", lambda b: b["c"] / F.col("entry_price")))
    days, rules = _grid(ratios, horizon)
    rules = [rule for rule in rules if families is None or rule[0] in families]
    base = base.select(KEY, "entry_date", "_r", *[c.alias(n) for n, c in days.items()])
    rows = []
    for family, name, end, hits, arm in rules:
        day, route = F.lit(end).cast("bigint"), F.lit("time")
        # Taken from last to first with <=, so a tie goes to the first listed route.
        for label, hit in reversed(hits):
            first = F.col(hit) <= day
            day, route = F.when(first, F.col(hit)).otherwise(day), F.when(first, F.lit(label)).otherwise(route)
        armed = F.col(arm).isNotNull() if arm else F.lit(None).cast("boolean")
        rows.append(F.struct(F.lit(family).alias("family"), F.lit(name).alias("variant"), day.alias("hold"),
                             route.alias("route"), armed.alias("armed")))
    out = base.select(KEY, "entry_date", "_r", F.explode(F.array(*rows)).alias("_v")).select(KEY, "entry_date", "_r", "_v.*")
    hold = F.col("hold").cast("int")
    return out.select(KEY, "entry_date", (F.element_at("_r", horizon) - 1).alias("final_ret"), "family", "variant",
                      (F.element_at("_r", hold) - 1).alias("ret"), F.array_min(F.slice("_r", 1, hold)).alias("worst"),
                      "hold", "route", "armed")


def variant_metrics(outcomes: DataFrame, random_mean: float = RANDOM_MEAN, hold_mean: float = HOLD_MEAN) -> DataFrame:
    """Summary of every variant against a random baseline and buy-and-hold."""
    r, one = F.col("ret"), lambda cond: cond.cast("double")
    sums = {"n": F.lit(1).cast("long"), "_r": r, "_r2": r * r, "_pos": one(r > 0), "_hit": one(F.col("worst") <= 0.80), "_loss": one(r < 0), "_hold": F.col("hold").cast("double")}
    probs = {"p10": 0.10, "median": 0.50, "p90": 0.90}
    found = quantile_summary(outcomes, ["family", "variant"], "ret", probs, sums)
    mean = lambda name: F.col(name) / F.col("n")
    out = found.select("family", "variant", "n", mean("_r").alias("mean"), F.sqrt(F.greatest(F.lit(0.0), mean("_r2") - mean("_r") * mean("_r"))).alias("std"), mean("_pos").alias("pct_pos"),
                       mean("_hit").alias("pct_hit20"), mean("_loss").alias("pct_exit_loss"), mean("_hold").alias("avg_hold"), *probs)
    out = out.withColumns({"spread": F.col("mean") - random_mean, "capture": F.col("mean") / hold_mean})
    return out.withColumns({
        "ux": F.col("capture") * (1 - F.col("pct_hit20")) * (1 - F.col("pct_exit_loss")),
        "eligible": F.col("spread") >= SPREAD_FLOOR})


def route_means(outcomes: DataFrame) -> DataFrame:
    """Share and mean return by the way a position was left, plus armed / winner statistics per variant."""
    r, total = F.col("ret"), F.count(F.lit(1))
    by = lambda label: F.avg(F.when(F.col("route") == label, r))
    stopped = F.col("route") == "stop"
    winner = F.col("final_ret") > 0
    return outcomes.groupBy("family", "variant").agg(
        total.alias("n"), by("stop").alias("mean_stop"), by("target").alias("mean_target"),
        by("time").alias("mean_time"), by("trail").alias("mean_trail"),
        F.avg(F.when(F.col("armed") == F.lit(False), r)).alias("mean_never_armed"),
        (F.count_if(F.col("armed")) / total).alias("pct_armed"),
        (F.count_if(stopped) / total).alias("pct_stopped"),
        F.try_divide(F.count_if(stopped & winner), F.count_if(winner)).alias("pct_winners_stopped"))


def rank_variants(metrics: DataFrame, top: int = 5) -> DataFrame:
    """Ranked picks: top eligible by ux, best per family, highest mean, safest, and the ineligible by spread.
    `metrics` has one row per variant of the rule grid, so these windows are tiny by construction. Figures that agree in
    nine digits tie and go by name: variants that leave on the same days differ by rounding alone."""
    tied = lambda c: F.round(c, 9)
    ok = metrics.where("eligible")
    pick = lambda df, role, order, part=(): (
        df.withColumn("_g", F.lit(1)).withColumn("rank", F.row_number().over(
            Window.partitionBy("_g", *part).orderBy(*order, "variant")).cast("bigint"))
        .select(F.lit(role).alias("role"), "rank", "family", "variant", "mean", "ux", "spread", "pct_hit20"))
    parts = [pick(ok, "top_ux", [tied("ux").desc()]).where(F.col("rank") <= top),
             pick(ok, "best_of_family", [tied("ux").desc()], ("family",)).where(F.col("rank") == 1),
             pick(metrics, "max_return", [tied("mean").desc()]).where(F.col("rank") == 1),
             pick(ok, "safest", [tied("pct_hit20").asc()]).where(F.col("rank") == 1),
             pick(metrics.where(~F.col("eligible")), "ineligible", [tied("spread").desc()])]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def barrier_capture(paths: DataFrame, up: float = 0.10, down: float = 0.10, horizon: int = 126) -> DataFrame:
    """TRUE when the path reaches +up before -down within `horizon` bars."""
    day, r = F.col("day"), F.col("close")
    inside = day <= horizon
    hit = lambda cond: F.min(F.when(inside & cond, day))
    found = paths.groupBy(KEY, "entry_date").agg(
        hit(r >= F.col("entry_price") * (1 + up)).alias("_u"), hit(r <= F.col("entry_price") * (1 - down)).alias("_d"))
    won = F.col("_u").isNotNull() & (F.col("_d").isNull() | (F.col("_u") < F.col("_d")))
    return found.select(KEY, "entry_date", won.alias("captured"))


def atr_trailing_exit(paths: DataFrame, multiple: float = 3.0) -> DataFrame:
    """Exit below (running high - multiple x ATR); the stop moves only on new highs with a known ATR."""
    w = Window.partitionBy(KEY, "entry_date").orderBy("day")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    high = F.greatest(F.col("entry_price"), F.coalesce(F.max("close").over(before), F.col("entry_price")))
    fresh = F.col("close") > high
    level = F.when(fresh & F.col("atr").isNotNull(), F.col("close") - multiple * F.col("atr"))
    rows = paths.withColumn("_lvl", level).withColumn("_stop", F.coalesce(
        F.last("_lvl", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        F.col("entry_price") - multiple * F.col("entry_atr")))
    point = F.struct("day", "ratio")
    out = rows.groupBy(KEY, "entry_date").agg(
        F.min(F.when(F.col("close") < F.col("_stop"), point)).alias("_x"), F.max(point).alias("_end"))
    place = F.coalesce("_x", "_end")
    return out.select(KEY, "entry_date", (place["ratio"] - 1).alias("atr_ret"), place["day"].cast("bigint").alias("atr_hold"),
                      F.col("_x").isNotNull().alias("stopped"))


def exit_styles(arrays: DataFrame, long: int = HOLD_BARS, short: int = HOLD_BARS // 2, multiple: float = 3.0) -> DataFrame:
    """One row: mean return of full paths held for `long` and `short` bars, and left by the ATR trailing stop."""
    at = lambda h: F.avg(F.element_at("ahead", h)["c"] / F.col("entry_price") - 1)
    fixed = arrays.agg(at(long).alias(f"fixed_{long}"), at(short).alias(f"fixed_{short}"), F.count(F.lit(1)).alias("n"), F.avg(_atr_fold(multiple)).alias("atr_trail"))
    return fixed


def _atr_fold(multiple: float) -> Column:
    """Return of a path left at the first close below (running high - multiple x ATR), or at its end: one fold."""
    start = F.struct(F.col("entry_price").alias("top"), (F.col("entry_price") - multiple * F.col("entry_atr")).alias("stop"), F.col("entry_price").alias("x"), F.lit(False).alias("out"))

    def step(acc: Column, bar: Column) -> Column:
        close = bar["c"]
        stop = F.when((close > acc["top"]) & bar["a"].isNotNull(), close - multiple * bar["a"]).otherwise(acc["stop"])
        moved = F.struct(F.greatest(acc["top"], close).alias("top"), stop.alias("stop"), close.alias("x"), holds(close < stop).alias("out"))
        return F.when(acc["out"], acc).otherwise(moved)

    return F.aggregate("ahead", start, step, lambda acc: acc["x"]) / F.col("entry_price") - 1


def triggered_exits(paths: DataFrame, take_profit: float = 0.0, stop_loss: float = 0.0, trailing: float = 0.0,
                    hold_days: int = HOLD_BARS, score_below: float | None = None) -> DataFrame:
    """First trigger of each independent trade; on one day take-profit beats stop, trailing, time and score decay.
    Zero switches a price trigger off. Time counts weekdays since entry. A path without a trigger stays OPEN."""
    from ..functions.scalars import business_days
    rows = running_extremes(paths)
    peak = F.greatest(F.lit(1.0), F.col("run_max"))
    rules = []
    if take_profit > 0:
        rules.append(("take_profit", F.col("ratio") - 1 >= take_profit))
    if stop_loss > 0:
        rules.append(("stop_loss", F.col("ratio") - 1 <= -stop_loss))
    if trailing > 0:
        rules.append(("trailing_stop", F.col("ratio") / peak - 1 <= -trailing))
    rules.append((f"{hold_days}d", business_days(F.col("entry_date"), F.col("date")) >= hold_days))
    if score_below is not None:
        rules.append(("threshold", F.col("composite_score") < score_below))
    fired = None
    for prio, (label, cond) in enumerate(rules):
        hit = F.when(cond, F.struct(F.col("day"), F.lit(prio).alias("prio"), F.lit(label).alias("reason"), F.col("ratio")))
        fired = hit if fired is None else F.coalesce(fired, hit)
    last = F.struct(F.col("day"), F.lit(99).alias("prio"), F.lit("open").alias("reason"), F.col("ratio"))
    out = rows.groupBy(KEY, "entry_date").agg(F.min(fired).alias("_x"), F.max(last).alias("_end"))
    place = F.coalesce("_x", "_end")
    return out.select(KEY, "entry_date", place["reason"].alias("reason"), place["day"].cast("bigint").alias("day"),
                      (place["ratio"] - 1).alias("ret"))


def _prices(take_profit: float, stop_loss: float, trailing: float) -> list[tuple]:
    rules = [("take_profit", lambda x, top, held, score: x - 1 >= take_profit)] if take_profit else []
    rules += [("stop_loss", lambda x, top, held, score: x - 1 <= -stop_loss)] if stop_loss else []
    return rules + ([("trailing_stop", lambda x, top, held, score: x / top - 1 <= -trailing)] if trailing else [])


def _held(days: int, label: str) -> list[tuple]:
    return [(label, lambda x, top, held, score: held >= days)]


def _decayed(below: float) -> list[tuple]:
    return [("threshold", lambda x, top, held, score: holds(score < below))]


def exit_modes(take_profit: float = 0.30, stop_loss: float = 0.40, trailing: float = 0.50, score_below: float = 0.35) -> dict[str, list[tuple]]:
    """The rules of each mode, the first that fires on a day first: price triggers with a 252-weekday hold, the score
    falling below `score_below` or 252 weekdays, the score alone with a cap of 504 weekdays."""
    return {"price": _prices(take_profit, stop_loss, trailing) + _held(252, "252d"),
            "threshold_or_252d": _held(252, "252d") + _decayed(score_below),
            "threshold_only": _held(504, "504d_cap") + _decayed(score_below)}


def folded_exits(arrays: DataFrame, modes: Mapping[str, list[tuple]] | None = None) -> DataFrame:
    """(ticker, entry_date, mode, reason, day, ret): the first trigger of each path under each mode, `open` without one.

    One fold over the path carries the running peak and the score of the day; nothing is exploded or shuffled.
    """
    from ..functions.scalars import business_days
    start = F.struct(F.lit(0).cast("bigint").alias("day"), F.lit(1.0).alias("top"), F.lit(1.0).alias("x"), F.lit(None).cast("string").alias("why"))

    def follow(rules: list[tuple]) -> Callable[[Column, Column], Column]:
        def step(acc: Column, bar: Column) -> Column:
            x = bar["c"] / F.col("entry_price")
            top = F.greatest(acc["top"], x)
            held = business_days(F.col("entry_date"), bar["d"])
            why = F.coalesce(*[F.when(rule(x, top, held, bar["s"]), F.lit(label)) for label, rule in rules])
            moved = F.struct((acc["day"] + 1).alias("day"), top.alias("top"), x.alias("x"), why.alias("why"))
            return F.when(acc["why"].isNull(), moved).otherwise(acc)
        return step

    parts = [F.struct(F.lit(mode).alias("mode"), F.aggregate("ahead", start, follow(rules)).alias("end")) for mode, rules in (modes or exit_modes()).items()]
    out = arrays.select(KEY, "entry_date", F.explode(F.array(*parts)).alias("_m"))
    end = F.col("_m.end")
    return out.select(KEY, "entry_date", "_m.mode", F.coalesce(end["why"], F.lit("open")).alias("reason"), end["day"].alias("day"), (end["x"] - 1).alias("ret"))


def ruled_returns(arrays: DataFrame, holds: Sequence[int], emergency: float = 0.40) -> DataFrame:
    """(ticker, entry_date, entry_score, hold, rule, ret) of full paths: rule A leaves after `hold` bars, rule B also on the first
    close at or below 1 - emergency."""
    ratios = F.transform("ahead", lambda b: b["c"] / F.col("entry_price"))
    base = arrays.select(KEY, "entry_date", "entry_score", ratios.alias("_r")).withColumn("_stop", _first_day(F.col("_r"), at_most=1 - emergency))
    rules = [F.struct(F.lit(h).cast("bigint").alias("hold"), F.lit(rule).alias("rule"), day.cast("int").alias("_day")) for h in holds
             for rule, day in (("A", F.lit(h)), ("B", F.least(F.lit(h), F.coalesce("_stop", F.lit(h)))))]
    out = base.withColumn("_x", F.explode(F.array(*rules)))
    return out.select(KEY, "entry_date", "entry_score", "_x.hold", "_x.rule", (F.element_at("_r", F.col("_x._day")) - 1).alias("ret"))


def reason_shares(exits: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    counts = exits.groupBy(*by, "reason").agg(F.count(F.lit(1)).alias("n")).withColumn("_all", F.lit(1))
    total = F.sum("n").over(Window.partitionBy("_all", *by))  # one row per reason
    return counts.select(*by, "reason", "n", (F.col("n") / total).alias("share"))
