"""The lot book: what every transaction opens, consumes, moves or splits, in exact decimals.

A folio's rows are sorted by date and run through one small state, its open lots, so a task holds the lots of one folio at
a time and not its rows. The same state serves a stream (``navloom/streaming/lots.py``). Lots are consumed in order of
acquisition, then booking, then id. A lot that closes gives all its remaining cost; charges go into cost and proceeds; the
last consumption of a closing takes what rounding left over.

Corporate actions name the scheme that they come from (``source_scheme``): a merger moves all open lots of it, with their
day of acquisition and their cost, and spreads the new units over them; a segregation gives a new lot beside every open
lot and moves the stated cost in proportion; a split without amount and price spreads its units over the open lots of its
own scheme. Without a source a merger closes and opens at its own day.

A row that can't be applied stops its book (user, folio, scheme): it is listed as a problem, as are the books that a
merger or segregation would have fed from it, and nothing after it is applied. Nothing is clamped or guessed. An opening
of neither units nor money, as rounding leaves of a tiny amount, opens no lot and stops nothing.
"""

from __future__ import annotations

import json
from bisect import insort
from collections.abc import Iterator
from datetime import date
from decimal import ROUND_HALF_UP, Context, Decimal
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from navloom.operators.ledger import BOOK, charge, drop_reversed, sequenced, with_ids
from navloom.operators.statement import GRANDFATHER_DATE, OPENING_TYPES, lot_id

# Types that close lots, what a lot's origin is called, places of units, money and prices, units that count as none.
CLOSING_TYPES = ("REDEMPTION", "SWITCH_OUT", "STP_OUT", "SWP", "MERGER_OUT")
ORIGINS = {"PURCHASE": "purchase", "SIP": "sip", "SWITCH_IN": "switch_in", "STP_IN": "stp_in", "IDCW_REINVEST": "idcw_reinvest", "MERGER_IN": "merger", "UNIT_SPLIT": "split"}
MONEY, PRICE, NOTHING = Decimal("0.0001"), Decimal("0.000001"), Decimal("0.0000005")
LONG_TERM_DAYS = {"equity": 365}
_EXACT = Context(prec=38, rounding=ROUND_HALF_UP)

ORDER = ["txn_date", "txn_seq", "txn_ref"]
ROW = [*BOOK, *ORDER, "txn_type", "units", "nav", "amount", "stamp_duty", "stt", "exit_load", "tax_class", "nav_2018", "source_scheme", "lot_id"]
_LOT = ("lot_id", "lot_ref", "origin", "acquired", "booked", "units", "left", "unit_cost", "cost", "cost_left", "nav_2018")


def money(x: Decimal) -> Decimal:
    return x.quantize(MONEY, context=_EXACT)


def price(x: Decimal, y: Decimal) -> Decimal:
    return _EXACT.divide(x, y).quantize(PRICE, context=_EXACT)


class Refused(ValueError):
    """A row that can't be applied to its book; ``short`` is how many units are missing."""

    def __init__(self, reason: str, short: Decimal | None = None) -> None:
        super().__init__(reason)
        self.short = short


class Lots:
    """The lots of a folio, by scheme in the order in which they are consumed."""

    def __init__(self, stored: str | None = None) -> None:
        said = json.loads(stored) if stored else {"lots": {}, "broken": [], "last": {}}
        self.of = {scheme: [(tuple(key), self._read(lot)) for key, lot in rows] for scheme, rows in said["lots"].items()}
        self.broken = set(said["broken"])
        self.last = {scheme: tuple(place) for scheme, place in said["last"].items()}

    @staticmethod
    def _read(lot: dict[str, Any]) -> dict[str, Any]:
        exact = {k: Decimal(lot[k]) if lot[k] is not None else None for k in ("units", "left", "unit_cost", "cost", "cost_left", "nav_2018")}
        return lot | exact

    def stored(self) -> str:
        """Open lots only: what a later transaction can still touch."""
        open_lots = {s: [(k, lot) for k, lot in rows if lot["left"] > NOTHING] for s, rows in self.of.items()}
        return json.dumps({"lots": open_lots, "broken": sorted(self.broken), "last": self.last}, default=str)

    def add(self, scheme: str, **lot: Any) -> None:
        insort(self.of.setdefault(scheme, []), ((lot["acquired"], lot["booked"], lot["lot_id"]), lot), key=lambda x: x[0])

    def open(self, scheme: str) -> list[dict[str, Any]]:
        return [lot for _, lot in self.of.get(scheme, []) if lot["left"] > NOTHING]

    def apply(self, t: Any) -> list[dict[str, Any]]:
        """Take in one row; the consumptions it makes."""
        scheme, source = str(t.scheme_id), None if pd.isna(t.source_scheme) else str(t.source_scheme)
        if scheme in self.broken or source in self.broken:
            raise Refused("after a row that was refused")
        if t.txn_type == "IDCW_PAYOUT":
            return []
        if _empty(t, source):
            return []
        if pd.isna(t.scheme_id) or pd.isna(t.units) or (t.txn_type not in CLOSING_TYPES and t.units <= 0):
            raise Refused("no units or no scheme")
        if t.txn_type == "UNIT_SPLIT" and pd.isna(t.amount) and not _known(t.nav):
            self._spread(scheme, t)
        elif t.txn_type in ("MERGER_IN", "SEGREGATION") and source is not None:
            self._move(source, scheme, t)
        elif t.txn_type in OPENING_TYPES:
            self._open(scheme, t)
        elif t.txn_type in CLOSING_TYPES:
            return self._close(scheme, t)
        else:
            raise Refused(f"unhandled type {t.txn_type}")
        return []

    def _open(self, scheme: str, t: Any) -> None:
        if pd.isna(t.amount) and not _known(t.nav):
            raise Refused("no amount and no price")
        paid = abs(t.amount) if not pd.isna(t.amount) else abs(t.units * t.nav)
        cost = money(paid + t.stamp_duty)
        day = str(t.txn_date)
        self.add(scheme, lot_id=t.lot_id, lot_ref=_plain(t.txn_ref), origin=ORIGINS[t.txn_type], acquired=day, booked=day, units=t.units, left=t.units, unit_cost=price(cost, t.units), cost=cost, cost_left=cost, nav_2018=None if pd.isna(t.nav_2018) else t.nav_2018)

    def _shares(self, scheme: str, whole: Decimal, by: str) -> list[tuple[dict[str, Any], Decimal]]:
        """``whole`` split over the open lots of a scheme in proportion; the last takes what rounding left over."""
        lots = self.open(scheme)
        total = sum((lot[by] for lot in lots), Decimal(0))
        if not total:
            raise Refused("no open lots to carry")
        parts = [_EXACT.multiply(whole, _EXACT.divide(lot[by], total)).quantize(PRICE if by == "left" else MONEY, context=_EXACT) for lot in lots]
        parts[-1] += whole - sum(parts, Decimal(0))
        return list(zip(lots, parts, strict=True))

    def _spread(self, scheme: str, t: Any) -> None:
        for lot, more in self._shares(scheme, t.units, "left"):
            lot["left"] += more
            lot["units"] += more
            lot["unit_cost"] = price(lot["cost_left"], lot["left"])

    def _move(self, source: str, scheme: str, t: Any) -> None:
        merger = t.txn_type == "MERGER_IN"
        if not merger and pd.isna(t.amount):
            raise Refused("no amount and no price")
        units = self._shares(source, t.units, "left")
        costs = [lot["cost_left"] for lot, _ in units] if merger else [c for _, c in self._shares(source, money(abs(t.amount)), "cost_left")]
        for n, ((lot, part), cost) in enumerate(zip(units, costs, strict=True)):
            if cost > lot["cost_left"]:
                raise Refused("more cost than the lots have")
            name = {"lot_id": f"{t.lot_id}-{n}", "lot_ref": lot["lot_ref"], "origin": "merger" if merger else "segregation", "nav_2018": None}
            self.add(scheme, **name, acquired=lot["acquired"], booked=str(t.txn_date), units=part, left=part, unit_cost=price(cost, part) if part else Decimal(0), cost=cost, cost_left=cost)
            lot["cost_left"] -= cost
            lot["left"] = Decimal(0) if merger else lot["left"]
            lot["unit_cost"] = lot["unit_cost"] if merger else price(lot["cost_left"], lot["left"])

    def _close(self, scheme: str, t: Any) -> list[dict[str, Any]]:
        wanted = abs(t.units)
        lots = self.open(scheme)
        held = sum((lot["left"] for lot in lots), Decimal(0))
        if wanted - held > NOTHING:
            raise Refused("more units than the book holds", wanted - held)
        if wanted <= NOTHING:
            return []
        if t.tax_class not in LONG_TERM_DAYS:
            raise Refused(f"no holding period known for {t.tax_class}")
        gross = abs(t.amount) if not pd.isna(t.amount) else Decimal(0)
        net = gross - t.exit_load - t.stt
        out: list[dict[str, Any]] = []
        each, each_gross = price(net, wanted), price(gross, wanted)
        while wanted > NOTHING:
            lot = lots[len(out)]
            used = min(lot["left"], wanted)
            actual = lot["cost_left"] if lot["left"] - used <= NOTHING else min(money(lot["unit_cost"] * used), lot["cost_left"])
            cost, basis, old = actual, "actual", lot["acquired"] < GRANDFATHER_DATE
            if old and lot["nav_2018"] is not None and not pd.isna(t.nav):
                other = money(max(lot["unit_cost"], min(lot["nav_2018"], t.nav)) * used)
                cost, basis = (other, "grandfathered") if other > actual else (actual, "actual")
            days = (t.txn_date - date.fromisoformat(lot["acquired"])).days
            out.append({
                "lot_id": lot["lot_id"], "lot_ref": lot["lot_ref"], "close_ref": t.txn_ref, "acquired": date.fromisoformat(lot["acquired"]), "sale_date": t.txn_date, "sequence": len(out), "used": used,
                "gross": money(used * each_gross), "net": money(used * each), "cost": cost, "basis": basis, "holding_days": days,
                "gain_type": "LTCG" if days > LONG_TERM_DAYS[t.tax_class] else "STCG", "confidence": "low" if old and lot["nav_2018"] is None else "high",
            })
            lot["left"] -= used
            lot["cost_left"] -= actual
            wanted -= used
        out[-1]["net"] += net - sum((c["net"] for c in out), Decimal(0))
        out[-1]["gross"] += gross - sum((c["gross"] for c in out), Decimal(0))
        for c in out:
            c["gain"] = c["net"] - c["cost"]
        return out

    def take(self, t: Any, strict: bool) -> list[dict[str, Any]]:
        """Apply a row that must come in order; a refused one breaks its book and is told as a problem."""
        scheme, place = str(t.scheme_id), (str(t.txn_date), int(t.txn_seq))
        try:
            if place < self.last.get(scheme, place):
                raise Refused("dated before a row already applied")
            self.last[scheme] = place
            return [{"kind": "consumption"} | c for c in self.apply(t)]
        except Refused as no:
            if strict:
                raise ValueError(f"transaction {t.txn_ref} of folio {t.folio}, scheme {t.scheme_id}: {no}") from no
            first = scheme not in self.broken
            self.broken.add(scheme)
            return [{"kind": "problem", "close_ref": t.txn_ref, "sale_date": t.txn_date, "reason": str(no), "used": no.short}] if first else []


def _empty(t: Any, source: str | None) -> bool:
    """Whether a row opens a lot of neither units nor money; corporate actions always name units."""
    opens = t.txn_type in OPENING_TYPES and t.txn_type != "UNIT_SPLIT" and source is None
    return opens and not (pd.isna(t.scheme_id) or pd.isna(t.units) or pd.isna(t.amount) or t.units or t.amount)


def _plain(x: Any) -> Any:
    return x.item() if hasattr(x, "item") else x


def _known(x: Any) -> bool:
    return not pd.isna(x) and bool(x)


_SPECIFIC = "lot_id string, lot_ref {ref}, origin string, close_ref {ref}, acquired date, booked date, sale_date date, sequence int, units decimal(24,6), used decimal(24,6), unit_cost decimal(24,6), gross decimal(24,4), net decimal(24,4), cost decimal(24,4), cost_left decimal(24,4), basis string, holding_days int, gain_type string, gain decimal(24,4), confidence string, reason string"


def events_schema(rows: DataFrame) -> str:
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    return ", ".join(f"{c} {kind[c]}" for c in BOOK) + ", kind string, " + _SPECIFIC.format(ref=kind["txn_ref"])


def frame(rows: list[dict[str, Any]], schema: str) -> pd.DataFrame:
    names = [f.split(" ")[0] for f in schema.split(", ")]
    return pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype=object) for n in names})


def remaining(lots: Lots) -> Iterator[dict[str, Any]]:
    """All lots, closed ones with nothing left."""
    for scheme, rows in lots.of.items():
        for _, lot in rows:
            day = date.fromisoformat
            yield {"kind": "lot", "scheme_id": scheme, "used": lot["left"], "acquired": day(lot["acquired"]), "booked": day(lot["booked"])} | {k: lot[k] for k in ("lot_id", "lot_ref", "origin", "units", "unit_cost", "cost", "cost_left")}


def prepared(txns: DataFrame, tax_class: Column | str = "equity", nav_2018: Column | None = None) -> DataFrame:
    """Rows that the book takes, as ``Lots.take`` reads them: reversals dropped, charges and ids added.

    ``txns`` has the columns of a book, txn_date, txn_ref, txn_type, units and amount; txn_seq, nav, charges, source_scheme and reverses_ref where known.
    """
    rows = drop_reversed(txns if "reverses_ref" in txns.columns else txns.withColumn("reverses_ref", F.lit(None).cast(txns.schema["txn_ref"].dataType)))
    rows = rows if "txn_seq" in rows.columns else sequenced(rows)
    exact = {"units": F.col("units").cast("decimal(20,6)"), "amount": F.col("amount").cast("decimal(20,4)")}
    rows = with_ids(rows.withColumns(exact))
    return rows.select(
        *BOOK, *ORDER, "txn_type", "units", (F.col("nav") if "nav" in rows.columns else F.lit(None)).cast("decimal(20,6)").alias("nav"), "amount",
        *(charge(rows, c).cast("decimal(20,4)").alias(c) for c in ("stamp_duty", "stt", "exit_load")), (F.lit(tax_class) if isinstance(tax_class, str) else tax_class).alias("tax_class"),
        (nav_2018 if nav_2018 is not None else F.lit(None)).cast("decimal(20,6)").alias("nav_2018"),
        (F.col("source_scheme") if "source_scheme" in rows.columns else F.lit(None)).cast("string").alias("source_scheme"), lot_id(F.col("txn_id")).alias("lot_id"),
    )


def with_sources(txns: DataFrame) -> DataFrame:
    """Mergers linked by ``switch_group_id`` as carries: the leg in learns its source and the leg out goes; unlinked ones stay as they are."""
    out = txns.filter((F.col("txn_type") == "MERGER_OUT") & F.col("switch_group_id").isNotNull()).select("user_id", "folio", "switch_group_id", F.col("scheme_id").cast("string").alias("source_scheme"))
    rows = txns.join(out.dropDuplicates(["user_id", "folio", "switch_group_id"]), ["user_id", "folio", "switch_group_id"], "left")
    ins = txns.filter((F.col("txn_type") == "MERGER_IN") & F.col("switch_group_id").isNotNull()).select("user_id", "folio", "switch_group_id").distinct().withColumn("carried", F.lit(True))
    rows = rows.join(ins, ["user_id", "folio", "switch_group_id"], "left").filter(~((F.col("txn_type") == "MERGER_OUT") & F.coalesce("carried", F.lit(False))))
    return rows.withColumn("source_scheme", F.when(F.col("txn_type") == "MERGER_IN", F.col("source_scheme"))).drop("carried")


def lot_events(rows: DataFrame, strict: bool = False) -> DataFrame:
    """Consumptions, lots and problems of ``prepared`` rows, told apart by ``kind``. With ``strict`` the first problem raises.

    Folios are dealt over tasks and sorted; a task goes through its rows once and holds the lots of one folio.
    """
    schema = events_schema(rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        folio, lots, out = None, Lots(), []

        def close() -> None:
            out.extend({"user_id": folio[0], "folio": folio[1]} | x | {"scheme_id": ids[x["scheme_id"]]} for x in remaining(lots))

        ids: dict[str, Any] = {}
        for batch in batches:
            for t in batch.itertuples(index=False):
                if (t.user_id, t.folio) != folio:
                    if folio is not None:
                        close()
                    folio, lots, ids = (t.user_id, t.folio), Lots(), {}
                ids[str(t.scheme_id)] = t.scheme_id
                out.extend({c: getattr(t, c) for c in BOOK} | e for e in lots.take(t, strict))
            yield frame(out, schema)
            out.clear()
        if folio is not None:
            close()
            yield frame(out, schema)

    return rows.select(*ROW).repartition("user_id", "folio").sortWithinPartitions("user_id", "folio", *ORDER).mapInPandas(run, schema)


def consumptions(events: DataFrame) -> DataFrame:
    return events.filter("kind = 'consumption'").select(*BOOK, "lot_id", "lot_ref", "close_ref", "acquired", "sale_date", "sequence", "used", "gross", "net", "cost", "basis", "holding_days", "gain_type", "gain", "confidence")


def all_lots(events: DataFrame) -> DataFrame:
    return events.filter("kind = 'lot'").select(*BOOK, "lot_id", "lot_ref", "origin", "acquired", "booked", "units", F.col("used").alias("units_left"), "unit_cost", "cost", "cost_left")


def problems(events: DataFrame) -> DataFrame:
    """Per stopped book: the row that was refused, why, and the units missing."""
    return events.filter("kind = 'problem'").select(*BOOK, F.col("close_ref").alias("txn_ref"), F.col("sale_date").alias("txn_date"), "reason", F.col("used").alias("short"))
