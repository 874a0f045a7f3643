"""A synthetic lending portfolio, made as Spark columns.

Every value is a function of a seed, a salt and a row number, so a lost task makes the same rows
again and no step passes through the driver. Shares and rates follow the settings below.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Geography, products, employment incomes, banks, ring settings.
DISTRICTS = {
    "Tamil Nadu": ["Chennai", "Coimbatore", "Madurai", "Salem", "Erode"],
    "Karnataka": ["Bengaluru", "Mysuru", "Hubballi", "Belagavi", "Shivamogga"],
    "Maharashtra": ["Pune", "Nashik", "Nagpur", "Kolhapur", "Aurangabad"],
    "Uttar Pradesh": ["Lucknow", "Kanpur", "Varanasi", "Gorakhpur", "Meerut"],
    "Bihar": ["Patna", "Gaya", "Muzaffarpur", "Bhagalpur", "Darbhanga"],
    "West Bengal": ["Kolkata", "Siliguri", "Durgapur", "Asansol", "Berhampore"],
    "Rajasthan": ["Jaipur", "Jodhpur", "Kota", "Udaipur", "Bikaner"],
    "Assam": ["Silchar", "Guwahati", "Dibrugarh", "Jorhat", "Nagaon"],
}
#: product, share, mean amount, deviation, tenures
PRODUCTS = [
    ("two_wheeler", 0.46, 85000, 25000, [12, 24, 36, 48]),
    ("three_wheeler", 0.11, 210000, 55000, [24, 36, 48]),
    ("used_car", 0.16, 340000, 90000, [24, 36, 48, 60]),
    ("consumer_durable", 0.17, 42000, 18000, [6, 9, 12, 18]),
    ("used_commercial_vehicle", 0.10, 420000, 110000, [36, 48, 60]),
]
EMPLOYMENT = [("salaried", 28000), ("self_employed", 24000), ("agriculturist", 15000), ("gig_worker", 17000), ("student_with_coapplicant", 9000)]
BANKS = ["SBI", "PNB", "BoB", "Canara", "UnionBank", "IOB", "HDFC", "ICICI", "Axis", "Kotak", "IPPB", "PPI-Wallet"]
#: typology, smallest and largest ring, shortest and longest burst, links to benign entities a member, first payment default
TYPOLOGIES = [
    ("device_farm", 4, 14, 1, 6, 0.6, 0.85),
    ("guarantor_star", 5, 16, 3, 18, 0.8, 0.78),
    ("dealer_collusion", 6, 22, 2, 14, 1.0, 0.80),
    ("disbursement_sink", 5, 15, 4, 25, 0.9, 0.88),
    ("identity_reuse", 2, 6, 1, 40, 0.4, 0.70),
]
DUPLICATES, LOCAL_BRANCH, SAVINGS, KIOSK, SHARED_PHONE, GUARANTOR, SIBLING, LOCAL_DEALER, ZIPF = 0.045, 0.72, 0.82, 0.14, 0.35, 0.55, 0.7, 0.62, 1.55
EVER_DPD, BENIGN_FPD, DPD_MEAN, SEASON = 0.22, 0.04, 18.0, 0.30

FIRST = ["Asha", "Ravi", "Meena", "Arun", "Lata", "Kiran", "Sunil", "Divya", "Imran", "Nisha", "Gopal", "Rekha"]
LAST = ["Rao", "Sharma", "Das", "Iyer", "Khan", "Gupta", "Patil", "Nair", "Singh", "Bora", "Mukherjee", "Verma"]


@dataclass(frozen=True)
class Profile:
    """Size of a portfolio; ``ring_share`` is the rings' share of all applications."""

    persons: int = 6_000
    per_person: float = 0.55
    dealers: int = 180
    ring_share: float = 0.03
    days: int = 540
    installments: int = 24
    seed: int = 20260827
    camouflage: float = 1.0
    typologies: tuple = tuple(t[0] for t in TYPOLOGIES)


FULL = Profile(persons=120_000, per_person=0.60, dealers=2_400, ring_share=0.025, days=730, installments=48)


class _Draw:
    def __init__(self, seed: int):
        self.seed = seed

    def unit(self, salt: str, *ids) -> Column:
        return F.pmod(F.xxhash64(F.lit(self.seed), F.lit(salt), *ids), F.lit(1 << 40)) / F.lit(float(1 << 40))

    def below(self, salt: str, n, *ids) -> Column:
        return F.floor(self.unit(salt, *ids) * n).cast("long")

    def normal(self, salt: str, *ids) -> Column:
        return F.sqrt(-2 * F.log(1 - self.unit(salt + "r", *ids))) * F.cos(2 * math.pi * self.unit(salt + "a", *ids))

    def one_of(self, salt: str, values, *ids) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), (self.below(salt, len(values), *ids) + 1).cast("int"))

    def poisson(self, salt: str, rate, *ids, most: int = 8) -> Column:
        u, term, at, k = self.unit(salt, *ids), F.exp(-rate), F.exp(-rate), F.lit(0)
        for i in range(1, most + 1):
            k, term = k + (u >= at).cast("int"), term * rate / i
            at = at + term
        return k


def _by(key: Column, values) -> Column:
    """The value at a position (from 0) of a short list."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key + 1).cast("int"))


def _short(*parts) -> Column:
    return F.substring(F.sha2(F.concat_ws("", *parts), 256), 1, 16)


def _id(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix + "_"), F.lpad(number.cast("string"), 10, "0"))


def _zipf(u: Column, n) -> Column:
    """A rank from 0 to n - 1 with weight about (rank + 1) ** -ZIPF, by the inverse of the power law."""
    top = F.pow(n + F.lit(1.0), F.lit(1 - ZIPF)) - 1
    return F.least(F.floor(F.pow(1 + u * top, F.lit(1 / (1 - ZIPF)))) - 1, n - F.lit(1)).cast("long")


PLACES = [(s, d) for s, ds in DISTRICTS.items() for d in ds]


def _person_columns(g: _Draw) -> list[Column]:
    n, job = F.col("n"), g.below("job", len(EMPLOYMENT), "n")
    place, base = g.below("place", len(PLACES), "n"), _by(job, [float(b) for _, b in EMPLOYMENT])
    income = F.round(F.least(F.greatest(base + base * 0.45 * g.normal("income", "n"), F.lit(5000.0)), F.lit(400000.0)), 2)
    return [
        _id("per", n).alias("person_id"), g.one_of("first", FIRST, "n").alias("name_first"), g.one_of("last", LAST, "n").alias("name_last"), _short(F.lit("pan"), n).alias("pan_hash"),
        (1965 + g.below("dob", 40, "n")).alias("dob_year"), g.one_of("sex", ["M", "F"], "n").alias("gender"), _by(place, [p[0] for p in PLACES]).alias("state"), _by(place, [p[1] for p in PLACES]).alias("district"),
        (600000 + g.below("pin", 39999, "n")).cast("string").alias("pincode"), _by(job, [e for e, _ in EMPLOYMENT]).alias("employment_type"), income.alias("monthly_income"), "household_id", _short(F.lit("mob"), n).alias("mobile_hash"),
    ]


def _households(g: _Draw, p: Profile, spark: SparkSession) -> DataFrame:
    """Persons in blocks of 15: five households of one to five, in an order that each block draws."""
    orders = ["".join(str(k) * ((r + k) % 5 + 1) for k in range(5)) for r in range(5)]
    b = spark.range(p.persons).select(F.col("id").alias("n"), F.floor(F.col("id") / 15).alias("block"), (F.col("id") % 15).cast("int").alias("at"))
    order = _by(g.below("order", 5, "block"), orders)
    b = b.withColumn("order", order).withColumn("k", F.substring("order", F.col("at") + 1, F.lit(1)))
    first = F.col("block") * 15 + F.instr("order", F.col("k")) - 1
    size = F.length("order") - F.length(F.replace("order", F.col("k")))
    size = F.least(size.cast("long"), F.lit(p.persons) - first)
    return b.select("n", (F.col("block") * 5 + F.col("k").cast("long")).alias("household_id"), first.alias("first"), size.alias("size"))


def _ring_members(g: _Draw, p: Profile, spark: SparkSession, benign: int) -> tuple[DataFrame, DataFrame]:
    kinds = [t for t in TYPOLOGIES if t[0] in p.typologies]
    if len(kinds) != len(p.typologies):
        raise ValueError(f"unknown typologies: {set(p.typologies) - {t[0] for t in TYPOLOGIES}}")
    target = benign * p.ring_share / (1 - p.ring_share)
    rings = max(1, round(target / (sum((t[1] + t[2]) / 2 * (1 + t[5] * p.camouflage / 2) for t in kinds) / len(kinds))))
    k = F.col("ring_id") % len(kinds)
    lo, hi, b0, b1 = (_by(k, [t[i] for t in kinds]) for i in (1, 2, 3, 4))
    r = spark.range(1, rings + 1).select(F.col("id").alias("ring_id"), (F.col("id") % len(kinds)).alias("k")).withColumn("typology", _by(F.col("k"), [t[0] for t in kinds]))
    r = r.withColumn("n_members", lo + g.below("size", hi - lo + 1, "ring_id")).withColumn("burst", b0 + g.below("burst", b1 - b0 + 1, "ring_id")).withColumn("start_day", g.below("start", p.days - 60, "ring_id") + 10).withColumn("hub", _zipf(g.unit("hub", "ring_id"), F.lit(p.dealers)))
    r = r.withColumn("rate", _by(F.col("k"), [t[5] * p.camouflage for t in kinds])).withColumn("fpd", _by(F.col("k"), [t[6] for t in kinds]))
    m = r.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_members") - 1))).withColumn("n", p.persons + F.col("ring_id") * 64 + F.col("i"))
    return r, m


def generate(spark: SparkSession, p: Profile = Profile()) -> dict[str, DataFrame]:
    """All tables of a portfolio by name; ``application_labels``, ``rings``, ``person_identity_truth`` and ``device_provenance`` are labels.

    Benign applications, kiosks, guarantors (siblings first, else somebody of the pincode), duplicate records, five kinds of rings,
    cover applications and a repayment schedule. No rows are collected.
    """
    g, n_apps = _Draw(p.seed), round(p.persons * p.per_person)
    house = _households(g, p, spark)
    rings, members = _ring_members(g, p, spark, n_apps)
    base = house.select("n", "household_id").unionByName(members.select("n", F.lit(-1).cast("long").alias("household_id")))
    persons = base.select("n", *_person_columns(g))
    lead = members.select("n", F.when(F.col("typology") == "identity_reuse", F.col("n") - F.col("i")).otherwise(F.col("n")).alias("h"))
    truth = house.select("n", F.col("n").alias("h")).unionByName(lead)
    alias_of = truth.where("h <> n").join(persons.withColumnRenamed("n", "h").select("h", F.col("name_first").alias("f0"), F.col("name_last").alias("l0"), F.col("dob_year").alias("d0")), "h")
    persons = persons.join(alias_of, "n", "left").withColumn("name_first", F.when(F.col("f0").isNotNull(), variant("f0")).otherwise(F.col("name_first"))).withColumn("name_last", F.coalesce("l0", "name_last")).withColumn("dob_year", F.coalesce("d0", "dob_year")).drop("h", "f0", "l0", "d0")
    twin = persons.where((F.col("n") < p.persons) & (g.unit("twin", "n") < DUPLICATES))
    twin = twin.withColumn("name_first", F.when(g.unit("t1", "n") < 0.4, variant("name_first")).otherwise(F.col("name_first"))).withColumn("pincode", F.when(g.unit("t2", "n") < 0.22, (600000 + g.below("t2p", 39999, "n")).cast("string")).otherwise(F.col("pincode"))).withColumn("mobile_hash", F.when(g.unit("t3", "n") < 0.18, _short(F.lit("new"), F.col("n"))).otherwise(F.col("mobile_hash")))
    twin = twin.withColumn("person_id", F.concat("person_id", F.lit("b")))
    truth_rows = truth.select(_id("per", F.col("n")).alias("person_id"), _id("per", F.col("h")).alias("human_id")).unionByName(twin.select("person_id", F.regexp_replace("person_id", "b$", "").alias("human_id")))

    kiosks = max(1, p.dealers // 4)
    a = spark.range(n_apps).select(F.col("id").alias("a"), g.below("who", p.persons, "id").alias("n")).join(house, "n").withColumn("ring_id", F.lit(-1).cast("long")).withColumn("fpd", F.lit(BENIGN_FPD)).withColumn("day", g.below("day", p.days, "a"))
    shared = (g.unit("share", "household_id") < SHARED_PHONE) & (F.col("size") > 1)
    device = F.when(g.unit("kiosk", "a") < KIOSK, _id("kio", g.below("which", kiosks, "a"))).when(shared, _id("dev", F.col("first"))).otherwise(_id("dev", F.col("n")))
    near = F.when(F.col("size") > 1, F.col("first") + F.pmod(F.col("n") - F.col("first") + 1 + g.below("sib", F.col("size") - 1, "a"), F.col("size")))
    a = a.select("a", "n", "ring_id", "fpd", "day", device.alias("device_id"), _id("acct", F.col("n")).alias("account_id"), F.lit(None).cast("long").alias("hub"), (g.unit("guar", "a") < GUARANTOR).alias("wants"), F.when(g.unit("sibling", "a") < SIBLING, near).alias("g"))

    t, ring = F.col("typology"), F.col("ring_id")
    pool = lambda salt, n: F.col("ring_id") * 64 + g.below(salt, n, "ring_id", "i")
    r_dev = F.when(t == "device_farm", _id("rdv", pool("rd", 3))).when(t == "dealer_collusion", _id("rdv", pool("rd", F.greatest(F.col("n_members") / 3, F.lit(1.0))))).when(t == "identity_reuse", _id("rdv", ring * 64)).otherwise(_id("dev", F.col("n")))
    r_acc = F.when(t == "disbursement_sink", _id("rac", pool("ra", 2))).when(t == "identity_reuse", _id("rac", ring * 64)).otherwise(_id("acct", F.col("n")))
    r_gua = F.when(t.isin("guarantor_star", "dealer_collusion"), g.below("rg0", p.persons - 2, "ring_id") + g.below("rg", 2, "ring_id", "i"))
    ringed = members.select((n_apps + ring * 1024 + F.col("i")).alias("a"), "n", "ring_id", "fpd", (F.col("start_day") + g.below("rday", F.col("burst") + 1, "ring_id", "i")).alias("day"), r_dev.alias("device_id"), r_acc.alias("account_id"), F.when(t.isin("device_farm", "dealer_collusion"), F.col("hub")).alias("hub"), r_gua.isNotNull().alias("wants"), r_gua.alias("g"))
    extra = members.withColumn("c", F.explode(F.expr("sequence(1, 8)"))).where(F.col("c") <= g.poisson("cover", F.col("rate"), "ring_id", "i"))
    mine = g.unit("half", "ring_id", "i", "c") < 0.5
    other = g.below("cov", p.persons, "ring_id", "i", "c")
    cover = extra.select((n_apps + ring * 1024 + 64 + F.col("i") * 8 + F.col("c")).alias("a"), F.when(mine, other).otherwise(F.col("n")).alias("n"), F.when(mine, F.lit(-1)).otherwise(ring).cast("long").alias("ring_id"), F.when(mine, F.lit(BENIGN_FPD)).otherwise(F.col("fpd")).alias("fpd"), (F.col("start_day") + g.below("cday", 40, "ring_id", "i", "c")).alias("day"), _id("dev", other).alias("device_id"), F.when(mine, _id("acct", other)).otherwise(_id("acct", F.col("n"))).alias("account_id"), F.lit(None).cast("long").alias("hub"), mine.alias("wants"), F.when(mine, F.col("n")).alias("g"))
    every = a.unionByName(ringed).unionByName(cover)

    per = persons.where("n >= 0").withColumn("next", F.coalesce(F.lead("n").over(Window.partitionBy("pincode").orderBy("n")), F.first("n").over(Window.partitionBy("pincode").orderBy("n"))))
    d = every.join(per, "n")
    place = F.array_position(F.array(*[F.lit(x[1]) for x in PLACES]), F.col("district")) - 1
    each = max(1, p.dealers // len(PLACES))
    local = F.least(place + len(PLACES) * _zipf(g.unit("dz", "a"), F.lit(each)), F.lit(p.dealers - 1))
    dealer = F.coalesce("hub", F.when(g.unit("local", "a") < LOCAL_DEALER, local).otherwise(_zipf(g.unit("any", "a"), F.lit(p.dealers))))
    u, at = g.unit("product", "a"), 0.0
    kind = F.lit(0)
    for _, share, *_x in PRODUCTS[:-1]:
        at += share
        kind = kind + (u >= at).cast("int")
    mean, sd = _by(kind, [float(x[2]) for x in PRODUCTS]), _by(kind, [float(x[3]) for x in PRODUCTS])
    product = _by(kind, [x[0] for x in PRODUCTS])
    tenures = F.element_at(F.array(*[F.array(*[F.lit(v) for v in x[4]]) for x in PRODUCTS]), kind + 1)
    tenure = F.element_at(tenures, (g.unit("tenure", "a") * F.size(tenures)).cast("int") + 1)
    amount = F.round(F.greatest(mean + sd * g.normal("amount", "a"), 0.2 * mean), 2)
    down = F.least(F.greatest(0.15 + 0.07 * g.normal("down", "a"), F.lit(0.0)), F.lit(0.5))
    guarantor = F.when(F.col("wants"), F.coalesce("g", F.when(F.col("next") != F.col("n"), F.col("next"))))
    d = d.withColumn("loan_amount", amount).withColumn("guarantor", guarantor)
    d = d.select("*", _id("app", F.col("a")).alias("application_id"), _id("dler", dealer).alias("dealer_id"), product.alias("product"), tenure.cast("long").alias("tenure_months"), F.round(down * F.col("loan_amount"), 2).alias("down_payment"))
    apps = d.select("application_id", "person_id", "dealer_id", "device_id", "account_id", "product", "loan_amount", "tenure_months", "down_payment", F.col("day").alias("applied_day"), F.col("pincode").alias("application_pincode"), F.col("district").alias("application_district"), F.col("state").alias("application_state"), "employment_type", "monthly_income", (2026 - F.col("dob_year")).alias("applicant_age_at_application"), F.col("guarantor").isNotNull().cast("long").alias("n_guarantors"))

    season = 1 + SEASON * F.sin(2 * math.pi * (F.col("day") + 30 * F.col("no")) / 365.0)
    due = d.withColumn("no", F.explode(F.expr(f"sequence(1L, least(tenure_months, floor(({p.days} - day) / 30), {p.installments}L))"))) if p.days >= 30 else d.limit(0).withColumn("no", F.lit(0).cast("long"))
    due = due.where(F.col("no") <= F.floor((F.lit(p.days) - F.col("day")) / 30)).where("no >= 1")
    ever = g.unit("ever", "a") < F.when(F.col("ring_id") > 0, 0.8).otherwise(EVER_DPD)
    missed = F.when(F.col("no") == 1, g.unit("fpd", "a") < F.col("fpd")).otherwise(ever & (g.unit("miss", "a", "no") < 0.3 * season)).cast("long")
    dpd = F.least(F.floor(-DPD_MEAN * F.log(1 - g.unit("dpd", "a", "no"))) + 1, F.lit(400))
    emi = due.select("application_id", F.col("no").alias("installment_no"), F.round((F.col("loan_amount") - F.col("down_payment")) / F.col("tenure_months"), 2).alias("emi_amount"), missed.alias("missed"), (missed * dpd).cast("long").alias("days_past_due"))

    devices = apps.select("device_id").distinct().select("device_id", g.one_of("model", ["A1", "B2", "C3", "D4", "E5", "F6"], "device_id").alias("device_model"), g.one_of("os", ["11", "12", "13", "14"], "device_id").alias("os_version"), _short(F.lit("apps"), F.col("device_id")).alias("app_install_hash"))
    acc = apps.groupBy("account_id").agg(F.min(F.struct("application_district", "application_state")).alias("x"))
    branch = F.when(g.unit("branch", "account_id") < LOCAL_BRANCH, F.col("x.application_district")).otherwise(g.one_of("away", [x[1] for x in PLACES], "account_id"))
    accounts = acc.select("account_id", g.one_of("bank", BANKS, "account_id").alias("bank"), _short(F.lit("ifsc"), branch).alias("ifsc_hash"), branch.alias("branch_district"), F.col("x.application_state").alias("branch_state"), F.when(g.unit("type", "account_id") < SAVINGS, "savings").otherwise("current").alias("account_type"))
    k = F.col("id") % len(PLACES)
    dealers = spark.range(p.dealers).select(_id("dler", F.col("id")).alias("dealer_id"), F.concat(g.one_of("dname", LAST, "id"), F.lit(" Motors")).alias("dealer_name"), _by(k, [x[0] for x in PLACES]).alias("state"), _by(k, [x[1] for x in PLACES]).alias("district"), _short(F.lit("gst"), F.col("id")).alias("gstin_hash"), (30 + g.below("onb", 2570, "id")).alias("onboarded_days_ago"))
    hub = F.col("hub") % len(PLACES)
    return {
        "persons": persons.drop("n").unionByName(twin.drop("n")),
        "devices": devices,
        "accounts": accounts,
        "dealers": dealers,
        "applications": apps,
        "guarantor_links": d.where("guarantor is not null").select("application_id", _id("per", F.col("guarantor")).alias("guarantor_person_id")),
        "emi_schedule": emi,
        "application_labels": d.select("application_id", "ring_id"),
        "rings": rings.select("ring_id", "typology", "n_members", "start_day", _id("dler", F.col("hub")).alias("hub_dealer_id"), _by(hub, [x[0] for x in PLACES]).alias("state"), _by(hub, [x[1] for x in PLACES]).alias("district")),
        "person_identity_truth": truth_rows,
        "device_provenance": devices.select("device_id", F.col("device_id").startswith("kio").alias("is_kiosk")),
    }


def variant(name: str) -> Column:
    """Another spelling of a name, one of four by its hash; short names get an h."""
    n, c = F.col(name), F.pmod(F.xxhash64(name), F.lit(4))
    return F.when(F.length(n) <= 3, F.concat(n, F.lit("h"))).when(c == 0, F.concat(n, F.lit("a"))).when(c == 1, F.regexp_replace(n, "(.)$", "$1$1")).when(c == 2, F.regexp_replace(n, "[aeiou](?=[^aeiou]*$)", "")).otherwise(F.regexp_replace(n, "^(..)", "$1h"))


LABELS = ("application_labels", "rings", "person_identity_truth", "device_provenance")


def build(spark: SparkSession, folder: str, p: Profile = Profile()) -> None:
    """Write a portfolio as Parquet: observed tables below ``raw``, labels below ``labels``."""
    for name, table in generate(spark, p).items():
        table.write.mode("overwrite").parquet(f"{folder}/{'labels' if name in LABELS else 'raw'}/{name}")
