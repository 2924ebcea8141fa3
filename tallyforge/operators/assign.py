"""Which ledger row each invoice takes: the greedy rule in invoice order, decided in passes over classes.

The rule: an invoice, in its turn, takes all free rows of its number if they
add up to it, else the first of them; without any it takes the only free row
near to it in amount and date, or the only one of these that names its vendor.

Rows of equal amount, day and description are one class, and invoices of equal
amount and day one spot; near classes of a spot are joined once, with counts,
so a hot amount costs its rows plus its invoices, not their product.

A pass works out who may still take what before whom, as a bound that only
grows until it is stable:

- an invoice that has rows of its number is an owner, all others seek;
- an owner whose rows a seeker may take before it is threatened, and may come
  to seek as well;
- a seeker is idle if two rows near to it are safe (nobody takes them before its
  turn) and among those of its vendor two are safe or there are none: it finds
  several whatever happens, and takes nothing;
- the others claim rows: those of their vendor if two rows are safe, as then no
  other counts; else all.

Owners that nobody threatens take their rows by rank, copies of one number
together; idle seekers take none; seekers that come first on all they claim
decide by counts. What is left goes into the next pass with the rows that are
left, at the least one invoice fewer: the first one is never held up. Chains of
invoices that wait for each other need a pass for each link, so the last few
invoices, a bounded number with the rows they may want, go through a loop.
"""

from __future__ import annotations

import bisect
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import ratios, vendor_names
from ..functions.sums import exact_sum
from ..model import AMOUNT_TOLERANCE, DATE_WINDOW_DAYS, VENDOR_SIMILARITY
from .lineage import cut, ranked, spread

#: A turn after all others: nobody takes the row.
NEVER = (1 << 63) - 1
#: Rows are split by a hash of their number, so that the second latest of two parts bounds the second latest of all.
PARTS = 8

#: So many invoices and rows at most may be left to a plain loop after a pass; more go into the next pass.
FEW = 5000

SPOT, CLASS = ["amount", "invoice_date"], ["row_amount", "ledger_date", "text"]


def close(a: Column, b: Column) -> Column:
    return F.coalesce(F.abs(a - b) <= AMOUNT_TOLERANCE, F.lit(False))


def has_number(number: Column) -> Column:
    return F.coalesce(number != "", F.lit(False))


def dated(amount: Column, day: Column) -> Column:
    return amount.isNotNull() & ~F.isnan(amount) & day.isNotNull()


def row_class(rows: DataFrame) -> DataFrame:
    """Adds the class of each row: row_amount, ledger_date, text; a missing description is an empty one."""
    return rows.withColumns({"row_amount": F.col("amount"), "text": F.coalesce("description", F.lit(""))})


def near_classes(spots: DataFrame, classes: DataFrame) -> DataFrame:
    """`spots` (amount, invoice_date, ...) with each of `classes` (row_amount, ledger_date, ...) near in amount and date.

    Classes fall into buckets of cents and of days as wide as the window; a spot
    looks into its own and the neighbouring buckets. A pair meets in just one
    bucket, so the join is an equi join without duplicates.
    """
    # Amounts too large to have cents are near only to equal ones.
    large = lambda c: F.abs(c) >= 1e15
    cents = lambda c: F.when(large(c), F.xxhash64(c)).otherwise(F.floor(F.when(~large(c), c) * 100))
    days = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / (DATE_WINDOW_DAYS + 1))
    offsets = F.when(large(F.col("amount")), F.array(F.lit(0))).otherwise(F.array(*[F.lit(k) for k in range(-2, 3)]))
    left = spots.select("*", F.explode(offsets).alias("_dc")).select("*", (cents(F.col("amount")) + F.col("_dc")).alias("_c"), F.explode(F.array(*[F.lit(k) for k in (-1, 0, 1)])).alias("_dd"))
    left = left.withColumn("_d", days(F.col("invoice_date")) + F.col("_dd")).drop("_dc", "_dd")
    right = classes.select("*", cents(F.col("row_amount")).alias("_c"), days(F.col("ledger_date")).alias("_d"))
    near = close(F.col("row_amount"), F.col("amount")) & (F.abs(F.datediff("ledger_date", "invoice_date")) <= DATE_WINDOW_DAYS)
    return left.join(right, ["_c", "_d"]).where(near).drop("_c", "_d")


def _latest(turn: Column) -> list[Column]:
    """The latest turn in each part of the rows of a group; `turn` may refer to _part."""
    return [F.max(F.when(F.col("_part") == k, turn)).alias(f"_p{k}") for k in range(PARTS)]


def _second() -> Column:
    """A lower bound of the second latest turn: of two rows, one at least is taken in this turn or later."""
    return F.coalesce(F.sort_array(F.array(*[F.col(f"_p{k}") for k in range(PARTS)]), asc=False)[1], F.lit(-NEVER))


def _classes(rows: DataFrame, owned: DataFrame) -> DataFrame:
    """Each class with its rows' count, first one, first owner and latest owners; `owned` has (invoice_number, first)."""
    held = rows.join(owned.select(F.col("invoice_number").alias("reference"), "first"), "reference", "left")
    held = held.where(dated(F.col("row_amount"), F.col("ledger_date"))).withColumns({"_part": F.pmod(F.xxhash64("row_index"), F.lit(PARTS)), "_turn": F.coalesce("first", F.lit(NEVER))})
    return held.groupBy(*CLASS).agg(F.count(F.lit(1)).alias("n"), F.min("row_index").alias("first_row"), F.min("_turn").alias("owner"), *_latest(F.col("_turn")))


def _look(who: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Near classes of each spot of `who`, and of each spot and vendor those that name the vendor, where there are several rows."""
    near = cut(near_classes(who.select(*SPOT).distinct(), classes))
    several = near.groupBy(*SPOT).agg(F.sum("n").alias("c")).where("c > 1").select(*SPOT)
    asked = who.where(F.col("vendor").isNotNull()).select(*SPOT, "vendor").distinct().join(several, SPOT)
    names = vendor_names(F.col("vendor"), F.col("text"))
    hits = spread(asked.join(near.select(*SPOT, "text").distinct(), SPOT), *SPOT, "vendor", "text").where(names)
    return near, cut(hits.join(near, [*SPOT, "text"]))


def _counted(pairs: DataFrame, keys: list[str], claims: DataFrame | None, name: str) -> DataFrame:
    """Rows, the first one, first owner, first claim and latest turns of what is near, for each of `keys`."""
    if claims is None:
        pairs = pairs.withColumn("claim", F.lit(NEVER))
    else:
        pairs = pairs.join(claims, CLASS, "left").withColumn("claim", F.coalesce("claim", F.lit(NEVER)))
    # A row is safe in a turn that comes before its owner's and not after the first claim's.
    after = F.when(F.col("claim") == NEVER, F.lit(NEVER)).otherwise(F.col("claim") + 1)
    latest = [F.max(F.when(F.col(f"_p{k}").isNotNull(), F.least(f"_p{k}", after))).alias(f"_p{k}") for k in range(PARTS)]
    got = pairs.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("first_row").alias("row"), F.min("owner").alias("owner"), F.min("claim").alias("claim"), *latest)
    return got.select(*keys, *[F.col(c).alias(f"{name}_{c}") for c in ("n", "row", "owner", "claim")], _second().alias(f"{name}_second"))


def _standing(seekers: DataFrame, near: DataFrame, hits: DataFrame, claims: DataFrame | None) -> DataFrame:
    """`seekers` with what is near to them and what of it names their vendor, and whether they are `idle` or only hits count (`sure`)."""
    turn = F.col("inv_ord")
    out = seekers.join(_counted(near, SPOT, claims, "near"), SPOT, "left").join(_counted(hits, [*SPOT, "vendor"], claims, "hit"), [*SPOT, "vendor"], "left")
    out = out.withColumn("sure", F.coalesce(F.col("near_second") > turn, F.lit(False)))
    return out.withColumn("idle", F.col("near_n").isNull() | (F.col("sure") & (F.col("hit_n").isNull() | (F.col("hit_second") > turn))))


def _claims(active: DataFrame, near: DataFrame, hits: DataFrame) -> DataFrame:
    """The first turn in which a seeker may take a row of a class."""
    first = lambda df, keys: df.groupBy(*keys).agg(F.min("inv_ord").alias("claim"))
    some = hits.join(first(active.where("sure"), [*SPOT, "vendor"]), [*SPOT, "vendor"])
    every = near.join(first(active.where("not sure"), SPOT), SPOT)
    return some.select(*CLASS, "claim").unionByName(every.select(*CLASS, "claim")).groupBy(*CLASS).agg(F.min("claim").alias("claim"))


def _owners(open_: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(inv_ord, invoice_number, nth, n_rows, ...) of invoices that find a row of their number if nobody takes it, and (invoice_number, first)."""
    numbered = open_.where(has_number(F.col("invoice_number")))
    refs = rows.where(has_number(F.col("reference"))).groupBy(F.col("reference").alias("invoice_number")).agg(F.count(F.lit(1)).alias("n_rows"), F.min("row_index").alias("first_row"), exact_sum(F.col("amount")).alias("total"))
    groups = cut(numbered.groupBy("invoice_number").agg(F.count(F.lit(1)).alias("copies"), F.min("inv_ord").alias("first")).join(refs, "invoice_number"))
    about = numbered.select("inv_ord", "invoice_number", "vendor", "invoice_date", "amount").join(groups, "invoice_number")
    single = about.where("copies = 1").withColumn("nth", F.lit(1).cast("long"))
    several = about.where("copies > 1")
    if not groups.where("copies > 1").isEmpty():
        single = single.unionByName(ranked(several, "invoice_number", "inv_ord").withColumn("nth", F.col("nth").cast("long")).where("nth <= n_rows"))
    return cut(single), groups.select("invoice_number", "first")


def _take_own(owners: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Decisions of owners that nobody threatens, and what rows they take: the nth of a number the nth row, until the rest adds up."""
    none = F.array().cast("array<int>")
    whole = (F.col("n_rows") >= 2) & close(F.col("total"), F.col("amount"))
    first = owners.where("nth = 1").withColumn("whole", whole)
    # Numbers of one owner, or paid in parts at once, need no rank of rows.
    plain = first.where((F.col("copies") == 1) | F.col("whole"))
    rest = owners.where("copies > 1").join(plain.select("invoice_number"), "invoice_number", "left_anti")
    parts = plain.where("whole").select("invoice_number", F.col("first_row").alias("taken")).join(rows.select(F.col("reference").alias("invoice_number"), F.col("row_index").alias("r")), "invoice_number").where("r != taken")
    parts = parts.groupBy("invoice_number").agg(F.array_sort(F.collect_list("r")).alias("extra"))
    decided = plain.join(parts, "invoice_number", "left").select("inv_ord", F.col("first_row").cast("int").alias("row_index"), F.coalesce("extra", none).alias("extra"), F.when(F.col("whole"), "instalments").otherwise("match").alias("kind"))
    if rest.isEmpty():
        return decided
    theirs = rows.select("row_index", F.col("reference").alias("invoice_number"), "amount").join(rest.select("invoice_number", "n_rows").distinct(), "invoice_number")
    # From the last row on, so that the sum so far is that of a row and all after it.
    back = ranked(theirs.withColumn("back", -F.col("row_index")), "invoice_number", "back", "amount")
    back = cut(back.select("invoice_number", "row_index", (F.col("n_rows") - F.col("nth") + 1).alias("nth"), F.col("upto").alias("left")))
    turns = rest.select("inv_ord", "invoice_number", "amount", "nth", "n_rows").join(back, ["invoice_number", "nth"])
    stop = turns.where((F.col("nth") < F.col("n_rows")) & close(F.col("left"), F.col("amount"))).groupBy("invoice_number").agg(F.min("nth").alias("stop"))
    turns = cut(turns.join(stop, "invoice_number", "left").where("stop is null or nth <= stop"))
    extra = turns.where("nth = stop").select("invoice_number", "inv_ord", F.col("row_index").alias("taken")).join(back.select("invoice_number", F.col("row_index").alias("r")), "invoice_number").where("r > taken")
    extra = extra.groupBy("inv_ord").agg(F.array_sort(F.collect_list("r")).alias("extra"))
    ranked_ = turns.join(extra, "inv_ord", "left").select("inv_ord", F.col("row_index").cast("int").alias("row_index"), F.coalesce("extra", none).alias("extra"), F.when(F.col("extra").isNotNull(), "instalments").otherwise("match").alias("kind"))
    return decided.unionByName(ranked_)


def _pass(open_: DataFrame, rows: DataFrame) -> DataFrame:
    """(inv_ord, row_index, extra, kind) of those of `open_` who can decide now."""
    none = F.array().cast("array<int>")
    owners, owned = _owners(open_, rows)
    rows = row_class(rows)
    seeking = open_.join(owners.select("inv_ord"), "inv_ord", "left_anti")
    blind = seeking.where(~dated(F.col("amount"), F.col("invoice_date")))
    seekers = cut(seeking.where(dated(F.col("amount"), F.col("invoice_date"))).select("inv_ord", "vendor", *SPOT))
    decided = blind.select("inv_ord", F.lit(None).cast("int").alias("row_index"), none.alias("extra"), F.lit("none").alias("kind"))
    if seekers.isEmpty():
        return decided.unionByName(_take_own(owners, rows))
    classes = _classes(rows, owned)
    near, hits = _look(seekers, classes)

    claims = active = threatened = None
    everyone, known = seekers, (0, 0, 0)
    while True:
        standing = _standing(everyone, near, hits, claims)
        if active is not None:
            standing = standing.join(active.select("inv_ord", F.lit(True).alias("was")), "inv_ord", "left").withColumn("idle", F.col("idle") & F.col("was").isNull()).drop("was")
        active = cut(standing.where(~F.col("idle")))
        claims = cut(_claims(active, near, hits))
        first = rows.join(claims, CLASS).where(has_number(F.col("reference"))).groupBy(F.col("reference").alias("invoice_number")).agg(F.min("claim").alias("claim"))
        threatened = cut(owners.join(first, "invoice_number").where("inv_ord > claim").select("inv_ord", "vendor", *SPOT))
        held = active.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("sure")).alias("unsure")).first()
        now = (threatened.count(), held.n, held.unsure)  # each only grows
        if now == known:
            break
        if now[0] > known[0]:
            may = threatened.where(dated(F.col("amount"), F.col("invoice_date")))
            everyone = seekers.unionByName(may)
            near, hits = _look(everyone, classes)
        known = now

    free = owners.join(threatened.select("inv_ord"), "inv_ord", "left_anti") if known[0] else owners
    idle = seekers.join(active.select("inv_ord"), "inv_ord", "left_anti")
    decided = decided.unionByName(idle.select("inv_ord", F.lit(None).cast("int").alias("row_index"), none.alias("extra"), F.lit("none").alias("kind")))
    turn = F.col("inv_ord")
    # Claims may have grown since a seeker was judged, so that all decide by the last ones.
    last = _standing(active.select("inv_ord", "vendor", *SPOT).join(seekers.select("inv_ord"), "inv_ord", "left_semi"), near, hits, claims)
    from_hits = F.when(F.col("hit_n") == 1, F.col("hit_row"))
    ready = F.when(F.col("sure"), F.col("hit_n").isNull() | ((F.col("hit_claim") >= turn) & (F.col("hit_owner") > turn))).otherwise((F.col("near_claim") >= turn) & (F.col("near_owner") > turn))
    chosen = F.when(F.col("sure"), from_hits).when(F.col("near_n") == 1, F.col("near_row")).otherwise(from_hits).cast("int")
    seekers_now = last.where(ready).select("inv_ord", chosen.alias("row_index"), none.alias("extra"), F.when(chosen.isNotNull(), "match").otherwise("none").alias("kind"))
    return decided.unionByName(seekers_now).unionByName(_take_own(free, rows))


def _loop(invoices: list, rows: list) -> list[tuple]:
    """The rule itself over few invoices and rows."""
    amounts = {r.row_index: r for r in sorted(rows, key=lambda r: r.row_index)}
    near_to: dict[tuple, list] = {}
    for r in amounts.values():
        near_to.setdefault(r.reference or None, []).append(r)
    dates = sorted((r for r in amounts.values() if r.amount is not None and r.ledger_date is not None), key=lambda r: r.amount)
    keys = [r.amount for r in dates]
    out = []
    for inv in sorted(invoices, key=lambda i: i.inv_ord):
        own = [r for r in near_to.get(inv.invoice_number, []) if r.row_index in amounts] if inv.invoice_number else []
        took, kind = [], "none"
        if len(own) >= 2 and inv.amount is not None and abs(math.fsum(r.amount or 0.0 for r in own) - inv.amount) <= AMOUNT_TOLERANCE:
            took, kind = own, "instalments"
        elif own:
            took, kind = own[:1], "match"
        elif inv.amount is not None and inv.invoice_date is not None:
            some = dates[bisect.bisect_left(keys, inv.amount - 2 * AMOUNT_TOLERANCE) : bisect.bisect_right(keys, inv.amount + 2 * AMOUNT_TOLERANCE)]
            near = [r for r in some if r.row_index in amounts and abs(r.amount - inv.amount) <= AMOUNT_TOLERANCE and abs((r.ledger_date - inv.invoice_date).days) <= DATE_WINDOW_DAYS]
            if len(near) > 1 and inv.vendor:
                vendor = inv.vendor.lower()
                texts = [(r.description or "").lower() for r in near]
                like = ratios([vendor] * len(near), texts)
                near = [r for r, t, x in zip(near, texts, like, strict=True) if vendor in t or x >= VENDOR_SIMILARITY]
            if len(near) == 1:
                took, kind = near, "match"
        for r in took:
            del amounts[r.row_index]
        out.append((inv.inv_ord, took[0].row_index if took else None, [r.row_index for r in took[1:]], kind))
    return out


def decide(open_: DataFrame, rows: DataFrame, few: int = FEW) -> DataFrame:
    """(inv_ord, row_index, extra, kind) of every invoice of `open_`; kind is instalments, match or none.

    What at most `few` invoices and rows are left with after a pass goes through a plain loop.
    """
    out = None
    while True:
        done = cut(_pass(open_, rows))
        out = done if out is None else out.unionByName(done)
        open_ = cut(open_.join(done.select("inv_ord"), "inv_ord", "left_anti"))
        if open_.isEmpty():
            return out
        taken = done.select("row_index").unionByName(done.select(F.explode("extra").alias("row_index"))).where("row_index is not null")
        left = rows.join(taken, "row_index", "left_anti")
        # Only rows that somebody left may want go on.
        spots = open_.where(dated(F.col("amount"), F.col("invoice_date"))).select(*SPOT).distinct()
        places = row_class(left).where(dated(F.col("row_amount"), F.col("ledger_date"))).select("row_amount", "ledger_date").distinct()
        wanted = near_classes(spots, places).select(F.col("row_amount").alias("amount"), "ledger_date").distinct().withColumn("near", F.lit(True))
        numbers = open_.where(has_number(F.col("invoice_number"))).select(F.col("invoice_number").alias("reference"), F.lit(True).alias("own")).distinct()
        rows = cut(left.join(wanted, ["amount", "ledger_date"], "left").join(numbers, "reference", "left").where("near or own").select("row_index", "ledger_date", "description", "reference", "amount"))
        if open_.limit(few + 1).count() <= few and rows.limit(few + 1).count() <= few:
            rest = _loop(open_.collect(), rows.collect())
            return out.unionByName(open_.sparkSession.createDataFrame(rest, out.schema))
