"""Scalar functions as column expressions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import BACKOFF_CAP_S, BACKOFF_JITTER, ordinal

# The offset and the factor of the ordering key's hash (it multiplies, then adds).
HASH_OFFSET, HASH_FACTOR = 14695981039346656037, 1099511628211


def state_in_mask(mask: Column, state: Column) -> Column:
    """Whether the state's bit is set in a text of bits, the first state leftmost."""
    return F.coalesce(F.substr(mask, ordinal(state) + 1, F.lit(1)) == "1", F.lit(False))


def mask_text(mask: Column) -> Column:
    """A byte of state bits, lowest bit for the first state, as a text with the first state leftmost."""
    return F.reverse(F.lpad(F.bin(mask), 8, "0"))


def backoff_seconds(attempt: Column, u: Column) -> Column:
    """2^attempt seconds with up to a quarter more by u in [0, 1), a day at most."""
    base = F.pow(F.lit(2.0), attempt)
    return F.least(base + u * BACKOFF_JITTER * base, F.lit(BACKOFF_CAP_S))


def effective_priority(priority: Column, waited_s: Column, aging_s: Column) -> Column:
    """One step nearer to 1 for each aging_s waited; no aging where aging_s is not positive."""
    return F.when(aging_s > 0, F.greatest(F.lit(1), priority - F.floor(F.greatest(waited_s, F.lit(0)) / aging_s).cast("int"))).otherwise(priority)


def ordering_hash(key: Column) -> Column:
    """The 64-bit hash of an ordering key's bytes as a decimal, which doesn't overflow."""
    code = F.hex(F.encode(key, "UTF-8"))
    byte = lambda i: F.conv(F.substr(code, i * 2 + 1, F.lit(2)), 16, 10).cast("decimal(38,0)")
    wide = lambda n: F.lit(Decimal(n)).cast("decimal(20,0)")
    size = F.octet_length(key)
    places = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    # a product of 20 and 13 digits, and a byte: 34 digits, which a decimal holds
    step = lambda a, i: F.pmod((a.cast("decimal(20,0)") * F.lit(Decimal(HASH_FACTOR)).cast("decimal(13,0)")).cast("decimal(38,0)") + byte(i), wide(1 << 64)).cast("decimal(38,0)")
    return F.aggregate(places, wide(HASH_OFFSET).cast("decimal(38,0)"), step)


def shard_of(key: Column, shards: int) -> Column:
    return F.pmod(ordering_hash(key), F.lit(shards).cast("decimal(38,0)")).cast("int")


def ring_slot(generation: Column, slots: Column | int) -> Column:
    return F.pmod(generation, F.lit(slots) if isinstance(slots, int) else slots)


def lane_sequence_name(queue: Column, priority: Column, shard: Column) -> Column:
    """A short name for a lane's sequence."""
    return F.concat(F.lit("lane_"), F.substring(F.md5(F.concat_ws(":", queue, priority.cast("string"), shard.cast("string"))), 1, 16))


def sequence_next(last_value: Column, is_called: Column) -> Column:
    return F.when(is_called, last_value + 1).otherwise(last_value)


def stale_ms(interval_ms: Column) -> Column:
    return F.greatest(F.greatest(interval_ms, F.lit(1000)) * 3, F.lit(30_000))


def stale_whole_seconds(interval_ms: Column) -> Column:
    return F.greatest((F.floor(F.greatest(interval_ms, F.lit(1000)) / 1000) * 3).cast("int"), F.lit(30))


def semver_rank(version: Column) -> Column:
    """major, minor, patch as one number; a missing minor or patch is 0; null for what has no leading number."""
    part = lambda i: F.nullif(F.regexp_extract(version, r"^(\d+)(?:\.(\d+))?(?:\.(\d+))?", i), F.lit("")).cast("long")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return part(1) * 1_000_000 + zero(part(2)) * 1000 + zero(part(3))


def snake(name: Column) -> Column:
    """CamelCase to snake_case; a run of capitals is one word, whose last letter starts the next."""
    return F.lower(F.regexp_replace(F.regexp_replace(name, "([A-Z]+)([A-Z][a-z])", "$1_$2"), "([a-z0-9])([A-Z])", "$1_$2"))


def original_priority(metadata: Column, priority: Column) -> Column:
    return F.coalesce(F.get_json_object(metadata, "$.original_priority").cast("int"), priority)


def progress(percent: Column) -> Column:
    return F.least(F.greatest(percent, F.lit(0)), F.lit(100))


def http_outcome(status: Column) -> Column:
    return F.when(status.between(200, 299), "completed").when(status >= 500, "retryable").otherwise("terminal")


def callback_url(base: Column, path: Column) -> Column:
    """Base and path with one slash between."""
    return F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), F.regexp_replace(path, "^/+", ""))


TRACEPARENT = "^([0-9a-f]{2})-([0-9a-f]{32})-([0-9a-f]{16})-([0-9a-f]{2})$"


def trace_id(header: Column) -> Column:
    """The trace of a traceparent header; null if it is malformed or a part is all zeros or the version is ff."""
    part = lambda i: F.regexp_extract(header, TRACEPARENT, i)
    good = header.rlike(TRACEPARENT) & (part(1) != "ff") & ~part(2).rlike("^0+$") & ~part(3).rlike("^0+$")
    return F.when(good, part(2))


def traceparent(trace: Column, span: Column, sampled: Column) -> Column:
    return F.concat(F.lit("00-"), trace, F.lit("-"), span, F.when(sampled, "-01").otherwise("-00"))


def wait_seconds(created_at: Column, claimed_at: Column) -> Column:
    """Null if negative."""
    s = F.timestamp_diff("MICROSECOND", created_at, claimed_at) / 1e6
    return F.when(s >= 0, s)


def has_nul(text: Column) -> Column:
    """Whether a text has a NUL, raw or escaped, in a key or a value at any depth."""
    return F.contains(text, F.lit("\x00")) | F.contains(text, F.lit("\\u0000"))


def without_nul(text: Column) -> Column:
    """The text; an error where it has a NUL."""
    return F.when(has_nul(text), F.raise_error(F.lit("NUL is not allowed"))).otherwise(text)


def pg_array(items: Column) -> Column:
    """An array of texts as a literal in braces, every item quoted."""
    quoted = F.transform(items, lambda x: F.concat(F.lit('"'), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')))
    return F.concat(F.lit("{"), F.concat_ws(",", quoted), F.lit("}"))


def json_errors(text: Column) -> Column:
    """An array of error entries; null where the text isn't an array or is empty. Bad fields are null, terminal is false by default."""
    parsed = F.from_json(text, "array<struct<attempt: int, error: string, at: string, terminal: boolean>>")
    fixed = F.transform(parsed, lambda e: F.struct(e["attempt"].alias("attempt"), e["error"].alias("error"), F.try_to_timestamp(e["at"]).alias("at"), F.coalesce(e["terminal"], F.lit(False)).alias("terminal")))
    return F.when(F.ltrim(text).startswith("[") & (F.size(parsed) > 0), fixed)


def json_merge(a: Column, b: Column) -> Column:
    """Keys of b over those of a, one level deep, as JSON; values are texts."""
    kind = "map<string,string>"
    x, y = F.from_json(a, kind), F.from_json(b, kind)
    return F.to_json(F.map_concat(F.map_filter(x, lambda k, v: ~F.array_contains(F.map_keys(y), k)), y))


_MEMBERS = "map<string,variant>"


def json_keys(text: Column) -> Column:
    """Whether each member's name is there: the names of an object, in order; null for other values."""
    return F.json_object_keys(text)


def json_has(text: Column, key: Column | str) -> Column:
    """Whether an object has a member of that name, or an array of texts that text."""
    key = F.lit(key) if isinstance(key, str) else key
    items = F.when(F.ltrim(text).startswith("["), F.from_json(text, "array<string>"))
    return F.coalesce(F.array_contains(json_keys(text), key), F.array_contains(items, key), F.lit(False))


def json_member(text: Column, key: str) -> Column:
    """A member's value as JSON; null if it isn't there or is null."""
    return F.get_json_object(text, f"$.{key}")


def json_put(text: Column, key: str, value: Column) -> Column:
    """An object with one member set to a JSON value; the other members keep theirs."""
    return json_concat(text, F.concat(F.lit("{" + f'"{key}":'), value, F.lit("}")))


def json_concat(a: Column, b: Column) -> Column:
    """Members of b over those of a, one level deep, values as they are; members by name."""
    x, y = F.from_json(a, _MEMBERS), F.from_json(b, _MEMBERS)
    kept = F.map_filter(x, lambda k, v: ~F.array_contains(F.map_keys(y), k))
    return F.to_json(F.map_concat(kept, y))


def json_without(text: Column, key: str) -> Column:
    """An object without a member."""
    return F.to_json(F.map_filter(F.from_json(text, _MEMBERS), lambda k, v: k != key))


def json_each_text(text: Column) -> Column:
    """The members of an object as an array of (key, value), values as texts."""
    return F.map_entries(F.from_json(text, "map<string,string>"))


def json_typeof(text: Column) -> Column:
    """object, array, string, number, boolean or null by how the JSON value begins; null for what is none."""
    first = F.substring(F.ltrim(text), 1, 1)
    kind = F.when(first == "{", "object").when(first == "[", "array").when(first == '"', "string").when(first.isin("t", "f"), "boolean").when(first == "n", "null").when(first.rlike("[-0-9]"), "number")
    return F.when(F.try_parse_json(text).isNotNull(), kind)


def json_tags(payload: Column) -> Column:
    """The payload's tags; an empty array where they are no array."""
    raw = F.get_json_object(payload, "$.tags")
    return F.coalesce(F.when(F.ltrim(raw).startswith("["), F.from_json(raw, "array<string>")), F.array().cast("array<string>"))
