"""Synthetic fund universes with a known truth, from hash-keyed random numbers.

A firm raises its next fund only while the last one's interim multiple
reaches a threshold, so a firm is simulated in order; firms are independent and
spread over the cluster. Every number is a function
of (seed, firm, fund), so results do not depend on partitioning.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Universe:
    """What a universe is drawn from; the defaults are fixed values of the study."""

    firms: int = 220
    funds: int = 6
    life_years: int = 12
    first_vintage: int = 1995
    last_vintage: int = 2016
    gap: int = 4
    mean_log_tvpi: float = 0.55
    skill_sd: float = 0.18
    idio_sd: float = 0.34
    vintage_sd: float = 0.20
    threshold: float = 1.05
    call_rate: float = 0.28
    payout_bow: float = 2.4
    payout_floor: float = 0.02
    index_drift: float = 0.085
    index_vol: float = 0.16
    market_beta: float = 1.1
    seed: int = 20260813

    @property
    def true_beta(self) -> float:
        """Share of the variance that is skill."""
        return self.skill_sd**2 / (self.skill_sd**2 + self.idio_sd**2)

    @property
    def index_quarters(self) -> int:
        return 4 * (self.last_vintage + self.life_years - self.first_vintage + 2)


def uniform(*key) -> float:
    digest = hashlib.md5("|".join(map(str, key)).encode()).hexdigest()
    return (int(digest[:12], 16) + 0.5) / (1 << 48)


def normal(*key) -> float:
    return math.sqrt(-2 * math.log(uniform(*key, "r"))) * math.cos(2 * math.pi * uniform(*key, "a"))


def _index_shock(u: Universe, i: int) -> float:
    z = math.sqrt(-2 * math.log(uniform(u.seed, "r", i))) * math.cos(2 * math.pi * uniform(u.seed, "a", i))
    return (u.index_drift - 0.5 * u.index_vol**2) / 4 + u.index_vol / 2 * z


def market_return(u: Universe, vintage: int) -> float:
    """Log return of the index over the life of a fund of that vintage."""
    first = 4 * (vintage - u.first_vintage)
    return sum(_index_shock(u, i) for i in range(first + 1, min(first + 4 * u.life_years, u.index_quarters)))


def cash_flows(u: Universe, commitment: float, target: float, key: tuple) -> tuple[list[float], list[float], list[float]]:
    """Quarterly calls, payouts and reported values of a fund whose multiple is ``target``.

    Calls take a share of what is uncalled; payouts take the larger of a floor
    and a bowed share of the value that grows with age. Payouts and values are
    scaled to the target, then values are reported with noise.
    """
    quarters = 4 * u.life_years
    growth = 1 + (target ** (1 / u.life_years) - 1) / 4
    uncalled, value = commitment, 0.0
    calls, payouts, values = [], [], []
    for q in range(quarters):
        call = 0.0 if q >= quarters - 4 else uncalled * u.call_rate * (1.0 if q < 4 else 0.75)
        uncalled -= call
        value = value * growth + call
        share = max(u.payout_floor, ((q + 1) / quarters) ** u.payout_bow)
        payout = min(value, value * share) if q >= 6 else 0.0
        value -= payout
        calls.append(call)
        payouts.append(payout)
        values.append(value)
    scale = target * sum(calls) / (sum(payouts) + values[-1])
    return calls, [p * scale for p in payouts], [v * scale * math.exp(0.03 * normal(*key, "reported", q)) for q, v in enumerate(values)]


def quarter_ends(vintage: int, n: int) -> list:
    return [d.date() for d in pd.date_range(f"{vintage}-01-01", periods=n, freq="QE")]


def simulate(spark: SparkSession, u: Universe = Universe()) -> DataFrame:
    """(firm_id, fund_id, sequence, vintage, commitment, skill, tvpi, interim, nav, nav_date, flows).

    A firm raises its next fund, ``gap`` years later, only if what the last one
    has paid and is worth by then is ``threshold`` times what it has called.
    """
    schema = "firm_id long, fund_id string, sequence int, vintage int, commitment double, skill double, tvpi double, interim double, nav double, nav_date date, flows array<struct<date:date,amount:double>>"
    start_years = max(1, u.last_vintage - u.first_vintage + 1 - 8)

    def firm(f: int) -> list[tuple]:
        rows, skill = [], u.skill_sd * normal(u.seed, f, "skill")
        vintage = u.first_vintage + int(start_years * uniform(u.seed, f, "start"))
        commitment = math.exp(math.log(300) + 0.7 * normal(u.seed, f, "size"))
        for k in range(1, u.funds + 1):
            if vintage > u.last_vintage:
                break
            shock = u.vintage_sd * normal(u.seed, "vintage", vintage) + u.market_beta * (market_return(u, vintage) / u.life_years - u.index_drift)
            target = min(max(math.exp(u.mean_log_tvpi + skill + shock + u.idio_sd * normal(u.seed, f, k)), 0.05), 12.0)
            calls, payouts, values = cash_flows(u, commitment, target, (u.seed, f, k))
            n, dates = 4 * u.gap, quarter_ends(vintage, 4 * u.life_years)
            net = [p - c for c, p in zip(calls, payouts, strict=True)]
            interim = (sum(x for x in net[:n] if x > 0) + values[n - 1]) / -sum(x for x in net[:n] if x < 0)
            rows.append((f, f"{f}-{k}", k, vintage, commitment, skill, target, interim, values[-1], dates[-1], [(d, x) for d, x in zip(dates, net, strict=True) if x]))
            if interim < u.threshold:
                break
            vintage, commitment = vintage + u.gap, commitment * math.exp(0.25 + 0.3 * normal(u.seed, f, k, "growth"))
        return rows

    def firms(batches):
        for batch in batches:
            yield pd.DataFrame([r for f in batch["id"] for r in firm(int(f))], columns=[c.split()[0] for c in schema.replace("struct<date:date,amount:double>", "flow").split(", ")])

    return spark.range(u.firms).mapInPandas(firms, schema)


def displaced(panel: DataFrame, seed: int = 11, shifts: tuple[tuple[int, int], ...] = ((0, 25), (1, 14), (2, 4))) -> DataFrame:
    """Vintages moved by 0, 1 or 2 years with weights 25, 14 and 4 of 43, by a hash of the fund."""
    total = sum(w for _, w in shifts)
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("fund_id").cast("string"))), 1, 8), 16, 10).cast("long") % total
    move, upto = F.lit(0), 0
    for shift, weight in shifts:
        move = F.when(u >= upto, F.lit(shift)).otherwise(move)
        upto += weight
    return panel.withColumn("vintage", F.col("vintage") + move)


def vintage_panels(spark: SparkSession, betas: tuple[float, ...] = (0.0, 0.25, 0.5), replications: int = 400, families: int = 39, skill_sd: float = 0.18, idio_sd: float = 0.34, vintage_sd: float = 0.20, years: int = 4, seed: int = 20240813) -> DataFrame:
    """(true_beta, rep, labels, fund_id, firm_id, sequence, vintage, commitment, tvpi): small panels with a known slope and vintage shocks.

    Each panel is there twice: with its true vintages and with displaced ones.
    All slopes share the random numbers.
    """
    schema = "true_beta double, rep int, labels string, fund_id string, firm_id string, sequence int, vintage int, commitment double, tvpi double"
    span, upto = range(1998, 2024), (25 / 43, 39 / 43)

    def panels(batches):
        for batch in batches:
            rows = []
            for rep in batch["id"]:
                shock = {v: vintage_sd * normal(seed, rep, "vintage", v) for v in span}
                for i in range(families):
                    start = span[int((len(span) - 2 * years) * uniform(seed, rep, i, "start"))]
                    funds = 2 if uniform(seed, rep, i, "funds") < 0.75 else 3
                    skill, own = skill_sd * normal(seed, rep, i, "skill"), [idio_sd * normal(seed, rep, i, k) for k in range(funds)]
                    moved = [sum(uniform(seed, rep, i, k, "shift") >= x for x in upto) for k in range(funds)]
                    for beta in betas:
                        latent = skill
                        for k in range(funds):
                            vintage, latent = start + years * k, beta * latent + own[k]
                            firm, tvpi = f"{beta}|{rep}|{i}", math.exp(latent + shock[vintage])
                            for labels, shift in (("true", 0), ("displaced", moved[k])):
                                rows.append((beta, rep, labels, f"{labels}|{firm}|{k}", f"{labels}|{firm}", k + 1, vintage + shift, 100.0, tvpi))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return spark.range(1, replications + 1).mapInPandas(lambda b: panels(b), schema)


def index_path(spark: SparkSession, u: Universe = Universe(), base: float = 100.0) -> DataFrame:
    """(date, level): quarterly levels of a geometric Brownian motion, the one that funds' markets follow."""

    def drawn(salt: str):
        digest = F.md5(F.concat_ws("|", F.lit(str(u.seed)), F.lit(salt), F.col("id").cast("string")))
        return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))

    z = F.sqrt(-2 * F.ln(drawn("r"))) * F.cos(2 * math.pi * drawn("a"))
    start = F.to_date(F.lit(f"{u.first_vintage}-03-31"))
    steps = spark.range(u.index_quarters).select(F.last_day(F.add_months(start, (F.col("id") * 3).cast("int"))).alias("date"), ((u.index_drift - 0.5 * u.index_vol**2) / 4 + u.index_vol / 2 * z).alias("s"))
    # index_quarters rows
    return steps.select("date", (base * F.exp(F.sum("s").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)))).alias("level"))
