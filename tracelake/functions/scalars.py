"""Scalar column functions: buckets, tokens, labels, run identifiers, formatting."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelake import schema as S


def steps(value: Column, bounds: Sequence[float], inclusive: bool = False) -> Column:
    """Index of the first bound that ``value`` is below (or at, if ``inclusive``), else their number."""
    out = None
    for i, bound in enumerate(bounds):
        test = value <= bound if inclusive else value < bound
        out = F.when(test, F.lit(i)) if out is None else out.when(test, F.lit(i))
    return out.otherwise(F.lit(len(bounds)))


def bucket_index(size: Column) -> Column:
    return steps(size, S.SIZE_BUCKETS, inclusive=True)


def alloc_size(bytes_alloc: Column, bytes_req: Column) -> Column:
    """Allocated bytes; zero and null count as missing, then the requested bytes."""
    return F.when(bytes_alloc != 0, bytes_alloc).otherwise(F.coalesce(bytes_req, F.lit(0)))


def token_size_bucket(size: Column) -> Column:
    return F.when(size > 0, bucket_index(size)).otherwise(F.lit(0))


def dt_bucket(dt_ns: Column) -> Column:
    """Delta class of tokens; a null delta (first event) is the longest class."""
    return F.when(dt_ns.isNull(), F.lit(3)).otherwise(steps(dt_ns / 1000.0, S.DT_US))


def dt_field_bucket(dt_ns: Column) -> Column:
    return F.when(dt_ns.isNull(), F.lit(len(S.DT_FIELD_US))).otherwise(steps(F.greatest(dt_ns, F.lit(0)) / 1000.0, S.DT_FIELD_US))


def dt_continuous(dt_ns: Column) -> Column:
    return F.when(dt_ns.isNull(), F.lit(0.0)).otherwise(F.log1p(F.greatest(dt_ns, F.lit(0)) / 1000.0) / F.lit(math.log1p(1e9)))


def lifecycle_state(op: Column, reclaimed: Column, lifetime_ns: Column) -> Column:
    """0 new, 1 reuse; frees: 2 short, 3 medium, 4 long life, 5 unknown."""
    freed = F.when(lifetime_ns.isNull(), F.lit(5)).otherwise(steps(lifetime_ns / 1000.0, S.LIFETIME_US) + 2)
    return F.when(op == "ALLOC", F.when(reclaimed, F.lit(1)).otherwise(F.lit(0))).otherwise(freed)


def reclaim_flag(reclaimed: Column, cross_site: Column) -> Column:
    return F.when(cross_site, F.lit(2)).when(reclaimed, F.lit(1)).otherwise(F.lit(0))


def call_site_slot(call_site: Column) -> Column:
    return (F.crc32(F.coalesce(call_site, F.lit("")).cast("binary")) % S.CALL_SITE_SLOTS).cast("int")


def encode_token(*fields: Column) -> Column:
    """Mixed-radix number of (op, size, behaviour, frequency, delta, cpu, reclaim)."""
    out = F.lit(0)
    for field, radix in zip(fields, S.TOKEN_RADICES, strict=True):
        out = out * radix + field
    return out.cast("int")


def capped_ratio(a: Column, b: Column, cap: float = 100.0) -> Column:
    return F.least(a / F.greatest(b, F.lit(1)), F.lit(cap))


def sanitise(value: Column) -> Column:
    """As float: not-a-number is 0, infinities are +-1e6."""
    x = value.cast("double")
    big = F.lit(float("inf"))
    return F.when(F.isnan(x) | x.isNull(), F.lit(0.0)).when(x == big, F.lit(1e6)).when(x == -big, F.lit(-1e6)).otherwise(x).cast("float")


def window_label(start: Column, end: Column, is_attack: Column, spray_start: Column, spray_end: Column, fraction: float = S.BOUNDARY_FRACTION) -> Column:
    """1 inside the interval by half of the window or of the interval, 0 outside, -1 on the boundary or without an interval."""
    overlap = F.greatest(F.lit(0), F.least(end, spray_end) - F.greatest(start, spray_start))
    return (
        F.when(~is_attack, F.lit(0)).when(spray_start.isNull() | spray_end.isNull() | (spray_end <= spray_start), F.lit(-1)).when(overlap == 0, F.lit(0))
        .when((overlap >= (end - start) * fraction) | (overlap >= (spray_end - spray_start) * fraction), F.lit(1)).otherwise(F.lit(-1))
    )


def sequence_label(labels: Column, policy: str, boundary: str = "drop") -> Column:
    """Label of an array of window labels: endpoint or any; with ``drop`` a boundary window makes -1."""
    if policy not in ("endpoint", "any"):
        raise ValueError(f"unknown label policy: {policy}")
    own = F.element_at(labels, -1) if policy == "endpoint" else F.when(F.array_contains(labels, 1), F.lit(1)).otherwise(F.lit(0))
    return F.when(F.array_contains(labels, -1), F.lit(-1)).otherwise(own) if boundary == "drop" else own


def token_sequence_label(labels: Column) -> Column:
    return F.when(F.array_min(labels) != F.array_max(labels), F.lit(-1)).otherwise(F.array_max(labels))


def run_stratum(run_id: Column) -> Column:
    """The identifier before its last ``/run_``."""
    return F.regexp_replace(run_id, r"/run_(?!.*/run_).*$", "")


def is_baseline(run_id: Column) -> Column:
    return F.contains(F.concat(F.lit("/"), run_id), F.lit("/poc_cfh_baseline/"))


def is_churn(run_id: Column, workloads: Sequence[str] = ("msg_msg", "keyctl")) -> Column:
    test = lambda s: F.array_contains(F.array(*[F.lit(w) for w in workloads]), s) | F.coalesce(s.rlike("^(" + "|".join(workloads) + ")_"), F.lit(False))
    return F.exists(F.split(run_id, "/"), test)


def control_family(run_id: Column) -> Column:
    return F.when(is_baseline(run_id), F.lit("baseline")).when(is_churn(run_id), F.lit("churn")).otherwise(F.lit("normal"))


def group_parts(group: Column) -> Column:
    """(cve, variant) of ``class:cve/variant/...``; unknown parts are a question mark."""
    own = F.split(F.regexp_replace(group, "^[^:]*:", ""), "/")
    part = lambda i: F.coalesce(F.nullif(F.get(own, F.lit(i)), F.lit("")), F.lit("?"))
    return F.struct(part(0).alias("cve"), part(1).alias("variant"))


def run_metadata(run_id: Column) -> Column:
    """(class, cve, variant, workload) by the path of a run."""
    parts = F.split(run_id, "/")
    cve = F.get(F.filter(parts, lambda p: p.rlike(r"^CVE-\d{4}-\d+$")), F.lit(0))
    variants = F.filter(F.transform(parts, lambda p: F.regexp_extract(p, r"(poc_cfh_[a-z0-9_]+?)(?=_run_|$)", 1)), lambda v: v != "")
    variant = F.get(variants, F.lit(0))
    last, second, third = (F.try_element_at(parts, F.lit(-i)) for i in (1, 2, 3))
    inferred = F.nullif(F.regexp_extract(last, r"^([a-z0-9_]+)_run_\d+", 1), F.lit(""))
    workload = F.when(variant.isNull(), F.when(second.rlike(r"^run_\d+$"), third).otherwise(F.coalesce(inferred, F.when(last.rlike(r"^run_\d+"), second))))
    return F.struct(F.when(variant.isNotNull(), F.lit("attack")).otherwise(F.lit("normal")).alias("class"), cve.alias("cve"), variant.alias("variant"), workload.alias("workload"))


def safe_number(value: Column, digits: int = 4) -> Column:
    """Fixed decimals; null and not-a-number are empty."""
    return F.when(value.isNull() | F.isnan(value.cast("double")), F.lit("")).otherwise(F.format_string(f"%.{digits}f", value.cast("double")))


def normalised_entropy(n: Column, kinds: Column, sum_c_log_c: Column) -> Column:
    """Shannon entropy over the logarithm of the number of kinds, from grouped sums; 0 for one kind or none."""
    return F.when(kinds > 1, (F.log2(n + F.lit(0.0)) - sum_c_log_c / n) / F.log2(kinds + F.lit(0.0))).otherwise(F.lit(0.0))


def log_count(count: Column) -> Column:
    return F.log10(count + F.lit(1.0))
