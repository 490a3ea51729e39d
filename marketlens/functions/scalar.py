"""Column functions: text, dates, money, hashing, encodings. All stay inside code generation."""
from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def plain_letters() -> dict[str, str]:
    """Letters whose compatibility decomposition is one letter and combining marks, and that letter."""
    pairs = {}
    for code in range(0xC0, 0x2000):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(code) and chr(code).isalpha():
            pairs[chr(code)] = base
    return pairs


# fixed values: event weights, funnel steps
EVENT_WEIGHTS = {"view": 1.0, "click": 2.0, "add_to_cart": 3.0, "purchase": 5.0}
FUNNEL_STEPS = {"view": 1, "click": 2, "add_to_cart": 3, "purchase": 4}
UNKNOWN_LABEL = "Non renseigné"


def r(value: Column | str, digits: int = 6) -> Column:
    return F.round(value, digits)


def ratio(num, den) -> Column:
    """Division as double; NULL when the denominator is 0 or NULL."""
    num = F.col(num) if isinstance(num, str) else num
    den = F.col(den) if isinstance(den, str) else den
    return F.try_divide(num.cast("double"), den.cast("double"))


def strip_accents_lower(text: Column) -> Column:
    """Lower case without combining marks, written together with their letter or behind it."""
    pairs = plain_letters()
    return F.regexp_replace(F.translate(F.lower(text), "".join(pairs), "".join(pairs.values())), r"\p{M}+", "")


def is_upper_category(text: Column) -> Column:
    """Category written in capitals only (letters, blanks, ampersand, hyphen)."""
    return text.rlike(r"^[A-Z\s&\-]+$")


def zero_padded(prefix: str, number: Column, width: int = 6) -> Column:
    return F.concat(F.lit(prefix), F.lpad(number.cast("string"), width, "0"))


def assignment_id(identity: Column) -> Column:
    return F.concat(F.lit("ASG"), F.substring(F.md5(identity.cast("binary")), 1, 10))


def persistent_group(identity: Column, share: float = 0.5, seed: int = 42) -> Column:
    """Stable group of an identity: 'treatment' for the given share, else 'control'."""
    slot = F.pmod(F.xxhash64(identity, F.lit(seed)), F.lit(10000))
    return F.when(slot < int(share * 10000), "treatment").otherwise("control")


def hash_sample(key: Column, rate: float, seed: int = 42) -> Column:
    """Keeps the same keys on every run, at the same rate everywhere."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1000000)) < int(rate * 1000000)


def half_life_decay(age_days: Column, half_life: float) -> Column:
    return F.pow(F.lit(0.5), F.greatest(age_days, F.lit(0.0)) / F.lit(float(half_life)))


def map_lookup(key: Column, table: dict, default) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def horizon_bucket(h: Column) -> Column:
    return (F.when(h == 1, "J+1").when(h <= 7, "J+2-7").when(h <= 14, "J+8-14").otherwise("J+15-30"))


def cyclic(day_of_year: Column, period: float = 365.25) -> tuple[Column, Column]:
    angle = F.lit(2.0) * F.pi() * day_of_year / F.lit(period)
    return F.sin(angle), F.cos(angle)


def discount_decision(price: Column, cost: Column, pct: Column, floor: float = 0.05) -> dict[str, Column]:
    """Test price rounded to the unit; eligible when it covers cost and keeps the margin floor; else no discount."""
    test = F.round(price * (1 - pct / 100), 0)
    ok = (test >= cost) & (test > 0) & ((test - cost) >= F.lit(floor) * test)
    applied = F.when(ok, pct).otherwise(F.lit(0))
    return {"prix_test": test, "eligible": ok, "remise_appliquee": applied,
            "prix_applique": F.round(price * (1 - applied / 100), 0)}


def price_is_eligible(base: Column, cost: Column, discount: Column, floor: float = 0.05) -> Column:
    price = base * (1 - discount / 100)
    return (price >= cost) & (price > 0) & (ratio(price - cost, price) >= floor)


def parse_date_key(df: DataFrame, column: str, out: str = "ds") -> DataFrame:
    """Date from a date, yyyyMMdd or ISO text; the 8-digit form is used only if every value has it."""
    text = F.trim(F.col(column).cast("string"))
    all_digits = df.agg(F.coalesce(F.min(text.rlike(r"^\d{8}$").cast("int")), F.lit(0))).scalar()
    compact = F.to_date(F.try_to_timestamp(text, F.lit("yyyyMMdd")))
    iso = F.to_date(F.try_to_timestamp(text))
    return df.withColumn(out, F.when(all_digits == 1, compact).otherwise(iso))


def has_offset(text: Column) -> Column:
    return text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")


def require_tz_utc(text: Column) -> Column:
    """UTC instant of a text timestamp; text without Z or an offset is refused at run time."""
    ok = text.isNull() | has_offset(text)
    return F.when(ok, F.to_timestamp(text)).otherwise(
        F.raise_error(F.concat(F.lit("timestamp without time zone: "), text)).cast("timestamp"))


def local_day(ts: Column, tz: str = "Africa/Dakar") -> Column:
    return F.to_date(F.from_utc_timestamp(ts, tz))


def identity_key(client: Column, anonymous: Column) -> Column:
    return F.coalesce(client, F.concat(F.lit("ANON:"), anonymous))


def category_codes(df: DataFrame, column: str, out: str) -> DataFrame:
    """Codes 0..n-1 in sorted order of the distinct values, -1 for NULL."""
    from marketlens.operators.ordered import running_totals
    values = df.select(column).filter(F.col(column).isNotNull()).distinct()
    coded = running_totals(values, [], [F.col(column)], {"_rank": F.lit(1)})
    return (df.join(coded.select(column, (F.col("_rank") - 1).cast("int").alias("_code")), column, "left")
            .withColumn(out, F.coalesce("_code", F.lit(-1))).drop("_code"))


def coerce_decimal(df: DataFrame) -> DataFrame:
    """Decimal columns as double; every other column untouched."""
    return df.select(*[F.col(f.name).cast("double").alias(f.name) if f.dataType.typeName() == "decimal" else F.col(f.name)
                       for f in df.schema.fields])


def coerce_datetime(df: DataFrame, min_share: float = 0.99, columns: Sequence[str] | None = None) -> DataFrame:
    """Text columns become timestamps when all look ISO in a sample and nearly all non-null rows parse.

    One aggregate looks at all text columns together; the shares come back as a single row.
    """
    names = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"
             and (columns is None or f.name in columns)]
    if not names:
        return df
    looks = r"^\d{4}-\d{2}-\d{2}([ T].*)?$"
    shares = df.agg(*[F.avg(F.when(F.col(n).isNotNull(), F.try_to_timestamp(n).isNotNull().cast("int"))).alias(n)
                      for n in names],
                    *[F.min(F.when(F.col(n).isNotNull(), F.col(n).rlike(looks).cast("int"))).alias(f"{n}__iso")
                      for n in names]).first()
    good = [n for n in names if shares[n] is not None and shares[n] >= min_share and shares[f"{n}__iso"] == 1]
    return df.withColumns({n: F.try_to_timestamp(n) for n in good}) if good else df
