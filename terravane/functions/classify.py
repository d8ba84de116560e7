"""Text classification and parsing T01-T08 as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: substrings, the first group that has one wins
PSU = ["powergrid", "power grid", "pgcil", "central transmission", "ntpc", "neyveli", "damodar valley", "dvc", "north eastern electric", "neepco", "sjvn", "thdc"]
STATE = ["transco", "discom", "vidyut", "mahatransco", "ptcl", "tneb", "transmission corporation", "state electricity", "seb", "kptcl", "mpptcl", "wbsedcl", "apgenco", "tsgenco"]
PRIVATE = ["adani", "reliance", "torrent", "tata power", "sterlite", "essel infra", "jindal", "vedanta"]
# fixed values: company, pattern, in order
COMPANIES = [
    ("Amazon Web Services", r"(?i)\b(AWS|Amazon)\b"),
    ("Microsoft Azure", r"(?i)\b(Azure|Microsoft)\b"),
    ("Google Cloud", r"(?i)\b(GCP|Google)\b"),
    ("Oracle Cloud", r"(?i)\bOracle\b"),
    ("IBM Cloud", r"(?i)\bIBM\b"),
    ("Yotta Infrastructure", r"(?i)\bYotta\b"),
    ("NTT", r"(?i)\bNTT\b"),
    ("CtrlS Datacenters", r"(?i)\bCtrl[- ]?S\b"),
    ("NXTRA by Airtel", r"(?i)\b(NXTRA|Airtel)\b"),
    ("Reliance Jio", r"(?i)\b(Jio|Reliance)\b"),
    ("Tata Communications", r"(?i)\bTata\b"),
]
# fixed values: zone names
DATA_CENTER_ZONE = r"(?i)\b(data ?cent(re|er)|cloud|hyperscaler)\b"
IT_ZONE = r"(?i)\b(IT|software|tech|cyber|data|cloud|ITES|HITEC|software park)\b"
# fixed values: state names as the boundary file spells them, and their codes
STATE_CODES = {
    "Andaman and Nicobar": "AN", "AndamanandNicobar": "AN", "Andhra Pradesh": "AP", "AndhraPradesh": "AP", "Arunachal Pradesh": "AR", "ArunachalPradesh": "AR",
    "Assam": "AS", "Bihar": "BR", "Chandigarh": "CH", "Chhattisgarh": "CT", "DadraandNagarHaveli": "DH", "Dadra and Nagar Haveli and Daman and Diu": "DH",
    "DamanandDiu": "DH", "Delhi": "DL", "NCTofDelhi": "DL", "Goa": "GA", "Gujarat": "GJ", "Haryana": "HR", "Himachal Pradesh": "HP", "HimachalPradesh": "HP",
    "Jammu and Kashmir": "JK", "JammuandKashmir": "JK", "Jharkhand": "JH", "Karnataka": "KA", "Kerala": "KL", "Ladakh": "LA", "Lakshadweep": "LD",
    "Madhya Pradesh": "MP", "MadhyaPradesh": "MP", "Maharashtra": "MH", "Manipur": "MN", "Meghalaya": "ML", "Mizoram": "MZ", "Nagaland": "NL", "Odisha": "OD",
    "Puducherry": "PY", "Punjab": "PB", "Rajasthan": "RJ", "Sikkim": "SK", "Tamil Nadu": "TN", "TamilNadu": "TN", "Telangana": "TG", "Tripura": "TR",
    "Uttar Pradesh": "UP", "UttarPradesh": "UP", "Uttarakhand": "UT", "West Bengal": "WB", "WestBengal": "WB",
}


def operator_type(name: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    any_of = lambda words: low.rlike("|".join(map(re.escape, words)))
    return F.when(any_of(PSU), "psu").when(any_of(STATE), "state").when(any_of(PRIVATE), "private").otherwise("unknown")


def company(name: Column, operator: Column) -> Column:
    text = F.concat_ws(" ", name, operator)
    out = F.when(operator != "", operator)
    for label, pattern in reversed(COMPANIES):
        out = F.when(text.rlike(pattern), label).otherwise(out)
    return F.when(F.trim(text) != "", out)


def tier(name: Column, tag: Column) -> Column:
    """1 to 4 from words such as "Tier-III" or "tier 4"; the tag is asked before the name."""
    raw = F.coalesce(F.when(tag != "", tag), name, F.lit(""))
    mark = F.upper(F.regexp_extract(raw, r"(?i)\btier[- ]?(IV|I{1,3}|[1-4])\b", 1))
    return F.when(mark.isin("I", "1"), 1).when(mark.isin("II", "2"), 2).when(mark.isin("III", "3"), 3).when(mark.isin("IV", "4"), 4)


def sez_policy(name: Column) -> Column:
    return (
        F.when(F.coalesce(name, F.lit("")) == "", None)
        .when(name.rlike(DATA_CENTER_ZONE), "data_center_incentive")
        .when(name.rlike(IT_ZONE), "it_services")
        .otherwise("multi_product")
    )


def water_kind(tags: Column) -> Column:
    first = F.coalesce(*(F.when(tags[k] != "", tags[k]) for k in ("water", "natural", "waterway")), F.lit("lake"))
    return F.when(first.isin("reservoir", "pond", "lake", "river"), first).when(first == "stream", "river").otherwise("lake")


def voltage_kv(raw: Column) -> Column:
    """The largest number in the text, in kV if it was in volts (1000 or more)."""
    most = F.array_max(F.transform(F.regexp_extract_all(raw, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.try_cast("long")))
    return F.when(most >= 1000, F.floor(most / 1000)).otherwise(most).cast("int")


def state_code(name: Column) -> Column:
    """NULL for an unknown name."""
    return F.create_map(*(F.lit(x) for pair in STATE_CODES.items() for x in pair))[name]
