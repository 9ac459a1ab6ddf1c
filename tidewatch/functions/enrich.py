"""Enrichment of activity rows: identifiers, users, durations, statuses, classification."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch import constants as K
from tidewatch.functions.basics import blank_to_null, col, first_non_empty, round_half_even, safe_timestamp, title_case

Rules = Sequence[tuple[str, Sequence[str]]]


def item_id(cols: Sequence[Column | str] = tuple(K.ITEM_ID_KEYS)) -> Column:
    return first_non_empty(cols)


def item_name(cols: Sequence[Column | str] = ("ItemName", *K.ITEM_NAME_KEYS)) -> Column:
    return first_non_empty(cols)


def item_type(cols: Sequence[Column | str] = ("ItemType", *K.ITEM_TYPE_KEYS)) -> Column:
    return first_non_empty(cols)


def normalize_user(c: Column | str) -> Column:
    """Text after the last ``|`` and before the first ``@``; a text without ``@`` that is
    empty becomes null."""
    value = F.substring_index(F.trim(col(c)), "|", -1)
    local = F.substring_index(value, "@", 1)
    return F.when(col(c) == "", None).when(value.contains("@"), local).otherwise(blank_to_null(value))


def user_from_struct(c: Column | str) -> Column:
    user = col(c)
    return normalize_user(
        first_non_empty([user["displayName"], user["userPrincipalName"], user["email"]])
    )


def duration_seconds(ms, start, created, end, completed, end_alt=None) -> Column:
    """Given milliseconds win; otherwise end minus start with fallbacks, never negative."""
    millis = col(ms).try_cast("double")
    begin = F.coalesce(safe_timestamp(start), safe_timestamp(created))
    ends = [safe_timestamp(end), safe_timestamp(completed)]
    if end_alt is not None:
        ends.append(safe_timestamp(end_alt))
    finish = F.coalesce(*ends)
    gap = F.timestamp_diff("MICROSECOND", begin, finish) / 1e6
    usable = F.when(millis != 0, round_half_even(millis / 1000, 3))
    return F.coalesce(usable, F.when(gap >= 0, round_half_even(gap, 3)))


def normalize_status(is_success: Column | str | None, status: Column | str) -> Column:
    text = F.trim(col(status))
    named = F.when(
        text.isNull() | F.lower(text).isin("", "none", "nan", "null"), F.lit("Succeeded")
    ).otherwise(title_case(text))
    if is_success is None:
        return named
    flag = col(is_success)
    return F.when(flag, "Succeeded").when(~flag, "Failed").otherwise(named)


def match_rules(name: Column | str, rules: Rules, default: str, whole_word: bool = False) -> Column:
    """First rule with a keyword inside the lower-cased name. Substrings count unless
    ``whole_word`` is set."""
    if not rules:
        return F.lit(default)
    text = F.lower(col(name))
    chain = F
    for label, words in rules:
        hit = F.lit(False)
        for word in words:
            hit = hit | (F.array_contains(F.split(text, "[^a-z0-9]+"), word) if whole_word else text.contains(word))
        chain = chain.when(hit, label)
    return chain.otherwise(default)


def infer_domain(name: Column | str, rules: Rules = K.DOMAIN_RULES, whole_word: bool = False) -> Column:
    return match_rules(name, rules, "General", whole_word)


def infer_location(region: Column | str | None, name: Column | str, rules: Rules = K.LOCATION_RULES, whole_word: bool = False) -> Column:
    by_name = match_rules(name, rules, "Global", whole_word)
    return by_name if region is None else F.coalesce(blank_to_null(region), by_name)


def infer_environment(name: Column | str, rules: Rules = K.ENVIRONMENT_RULES) -> Column:
    return match_rules(name, rules, "Unknown")


def _lookup(mapping: dict[str, str], key: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.try_element_at(table, key)


def object_url(ws: Column | str, item: Column | str, kind: Column | str, base: str = K.OBJECT_URL_BASE) -> Column:
    segment = F.coalesce(_lookup(K.OBJECT_URL_SEGMENTS, F.coalesce(col(kind), F.lit(""))), F.lit("items"))
    url = F.concat(F.lit(f"{base}/groups/"), col(ws), F.lit("/"), segment, F.lit("/"), col(item))
    return F.when((col(ws) != "") & (col(item) != ""), url)


def item_category(kind: Column | str) -> Column:
    chain = F
    for category, kinds in K.ITEM_CATEGORIES.items():
        chain = chain.when(col(kind).isin(kinds), category)
    return chain.otherwise("Other")


def platform(kind: Column | str) -> Column:
    return (
        F.when(col(kind).isin(K.NATIVE_ITEM_TYPES), "Fabric")
        .when(col(kind).isin(K.BI_ITEM_TYPES), "Power BI")
        .otherwise("Unknown")
    )


def is_native(kind: Column | str) -> Column:
    return F.coalesce(col(kind).isin(K.NATIVE_ITEM_TYPES), F.lit(False))


def user_type(upn: Column | str) -> Column:
    text = F.lower(col(upn))
    system = F.lit(False)
    for word in K.SYSTEM_USER_WORDS:
        system = system | text.contains(word)
    return (
        F.when(text.isNull() | (text == ""), "Unknown")
        .when(text.rlike(K.GUID_PATTERN), "ServicePrincipal")
        .when(system, "System")
        .otherwise("User")
    )


def upn_domain(upn: Column | str) -> Column:
    return F.when(col(upn).contains("@"), F.substring_index(col(upn), "@", -1))


def display_name(upn: Column | str) -> Column:
    return F.substring_index(col(upn), "@", 1)


def display_user(c: Column | str) -> Column:
    """Local part with dots as spaces, in title case."""
    return title_case(F.replace(F.substring_index(col(c), "@", 1), F.lit("."), F.lit(" ")))


def is_platform_activity(source="source", kind="item_type", operation="activity_type") -> Column:
    hit = col(kind).isin(K.PLATFORM_ITEM_TYPES) | col(operation).isin(K.PLATFORM_OPERATIONS)
    if source is not None:
        hit = (col(source) == "JobHistory") | hit
    return F.coalesce(hit, F.lit(False))
