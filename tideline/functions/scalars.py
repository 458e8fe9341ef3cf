"""Scalar rules on labels, codes, names and flags, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stage names and what they stand for.
STAGES = {
    "awake": "awake", "wake": "awake", "w": "awake", "n1": "n1", "nrem2": "nrem2", "n2": "nrem2", "nrem3": "nrem3", "n3": "nrem3", "rem": "rem", "r": "rem",
    "unresponsive": "unresponsive", "recovery": "recovery", "pre_lor": "awake", "post_ror": "recovery",
}
#: Texts that mean no value.
MISSING = ["", "n/a", "na", "nan", "none", "null"]


def lookup(names: dict[str, str], c: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), c)


def blank_to_null(c: Column) -> Column:
    """Trimmed text, null when blank."""
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def first_known(*columns: Column) -> Column:
    """The first that isn't blank."""
    return F.coalesce(*[blank_to_null(c) for c in columns])


def stage_label(c: Column) -> Column:
    """Trimmed, lower-cased, aliases resolved; blank is null."""
    text = F.lower(blank_to_null(c))
    return F.coalesce(lookup(STAGES, text), text)


def stage_code(c: Column) -> Column:
    """Whole numbers, also written as decimals (cut towards zero), else null."""
    text = blank_to_null(c)
    number = text.try_cast("double")
    return F.coalesce(text.try_cast("int"), F.when(F.abs(number) < 2147483648.0, number.cast("int")))


def codebook(json: Column) -> Column:
    """Map code -> canonical label, from {code: label}, {label: code} or [{code|value|id, label|name|stage}]."""
    pairs = F.map_entries(F.from_json(json, "map<string,string>"))
    either = F.transform(pairs, lambda e: F.struct(F.coalesce(stage_code(e["key"]), stage_code(e["value"])).alias("code"), stage_label(F.when(stage_code(e["key"]).isNotNull(), e["value"]).otherwise(e["key"])).alias("label")))
    items = F.from_json(json, "array<struct<code:string,value:string,id:string,label:string,name:string,stage:string>>")
    listed = F.transform(items, lambda e: F.struct(stage_code(F.coalesce(e["code"], e["value"], e["id"])).alias("code"), stage_label(F.coalesce(e["label"], e["name"], e["stage"])).alias("label")))
    found = F.when(F.ltrim(json).startswith("["), listed).otherwise(either)
    return F.map_from_entries(F.filter(found, lambda e: e["code"].isNotNull() & e["label"].isNotNull()))


def stage_identity(c: Column, book: Column) -> Column:
    """C4: label of a code by the codebook, or the label itself when it isn't a code."""
    code = stage_code(c)
    return F.when(code.isNotNull(), F.try_element_at(book, code)).otherwise(stage_label(c))


def optional_float(c: Column) -> Column:
    """A number, null for texts that mean no value or aren't numbers."""
    text = F.lower(F.trim(c.cast("string")))
    number = F.when(~text.isin(MISSING), text.try_cast("double"))
    return F.when(~F.isnan(number), number)


def medication_group(group: Column, dose: Column) -> Column:
    """Controls are healthy, patients medicated when the dose is above 0."""
    g = F.lower(F.trim(group))
    return F.when(g == "control", "Healthy").when(g == "fep", F.when(optional_float(dose) > 0, "FEP medicated").otherwise("FEP unmedicated"))


def optional_bool(c: Column, default: bool | None = None) -> Column:
    """Yes and no in their usual spellings and numbers, other texts true, null the default."""
    text = F.lower(F.trim(c.cast("string")))
    number = text.try_cast("double")
    out = F.when(c.isNull(), F.lit(default).cast("boolean")).when(text.isin("true", "yes", "y", "on"), True).when(text.isin("false", "no", "n", "off", ""), False)
    return out.when(F.isnan(number), None).when(number.isNotNull(), F.abs(number) >= 1).otherwise(True)


def feature_base(name: Column) -> Column:
    """What stands before __g_."""
    return F.coalesce(F.nullif(F.regexp_extract(name, r"^(.+?)__g_(.+)$", 1), F.lit("")), name)


def feature_region(name: Column, group: Column) -> Column:
    """What stands after __g_, else the group's label."""
    return F.coalesce(F.nullif(F.regexp_extract(name, r"^(.+?)__g_(.+)$", 2), F.lit("")), blank_to_null(group))


def depth_key(name: Column, part: str) -> Column:
    """Subject (three digits), run or acq of names like 7-anest 20200101 3.2."""
    text = F.regexp_replace(F.trim(name), "-anest-", "-anest ")
    pattern = r"^(\d+)-\S*\s(?:.*\s)?(\d+)\.(\d+)$"
    get = lambda i: F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))
    ok = F.size(F.split(text, r"\s+")) >= 3
    out = {"subject": F.concat(F.lit("sub-"), F.format_string("%03d", get(1).try_cast("int"))), "acq": F.concat(F.lit("acq-"), get(2)), "run": F.concat(F.lit("run-"), get(3))}[part]
    return F.when(ok & get(1).isNotNull(), out)


def column_safe(name: Column) -> Column:
    """Runs outside letters, digits and underscore become one underscore, none at the ends; nothing left: feature."""
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(name, r"[^0-9A-Za-z_]+", "_"), F.lit("_")), F.lit("")), F.lit("feature"))


def token_safe(name: Column) -> Column:
    """Runs outside letters, digits, dot, underscore and hyphen become one hyphen; nothing left: unknown."""
    one = F.regexp_replace(F.regexp_replace(F.trim(name), r"[^A-Za-z0-9_.\-]+", "-"), r"-{2,}", "-")
    return F.coalesce(F.nullif(F.trim(one, F.lit("-")), F.lit("")), F.lit("unknown"))


def rounded(c: Column, digits: int) -> Column:
    """Binary rounding as C and SQL engines do: the product with 10^digits to the nearest whole, halves away from zero.

    Spark's own ``round`` takes the shortest decimal text, so 11.824999999999999 is 11.82 there and 11.83 here. A
    negative value that becomes zero stays -0.
    """
    scaled = c * 10.0**digits
    whole = F.round(scaled, 0)
    return F.when(F.abs(scaled) < 2.0**52, F.when((c < 0) & (whole == 0), F.lit(-0.0)).otherwise(whole / 10.0**digits)).otherwise(c)


def sum_in_order(value: Column, order: Column) -> Column:
    """Aggregate: the sum of a key's values one after the other in the order of ``order``, on any partitioning.

    Sums of doubles depend on their order, and so do ties and zeros of what follows from them. A key's values are one array.
    """
    x = F.sort_array(F.collect_list(F.when(value.isNotNull(), F.struct(order.alias("o"), value.cast("double").alias("v")))))
    return F.aggregate(x, F.lit(0.0), lambda a, r: a + r["v"])


def mean_in_order(value: Column, order: Column) -> Column:
    """Aggregate: the mean of a key's values, summed in the order of ``order``; null without values."""
    return sum_in_order(value, order) / F.nullif(F.count(value), F.lit(0))
