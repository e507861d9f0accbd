"""Packed identifiers: 16 bytes of organisation, milliseconds, entity kind and five random bytes, as a UUID string."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the byte of each kind of entity
ENTITY_BYTES = {
    "Org": 0x01, "User": 0x02, "OrgMembership": 0x03, "AuthToken": 0x04, "OrgInvitation": 0x05,
    "Collection": 0x10, "DataSource": 0x11, "Chunk": 0x12, "ExtractedImage": 0x13,
    "ApiKey": 0x20, "UsageLog": 0x21,
    "ChatThread": 0x30, "CanvasCard": 0x31, "CanvasEdge": 0x32, "CanvasComponent": 0x33, "SharedChat": 0x34,
    "AiUsageLog": 0x40, "Connection": 0x50, "SyncLog": 0x51,
}
UUID_PATTERN = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def _hex(value: Column, digits: int) -> Column:
    return F.lpad(F.lower(F.hex(value.cast("long"))), digits, "0")


def pack_id(org: Column, millis: Column, entity: Column, seed: Column) -> Column:
    """The id of an entity. The last five bytes come from a hash of seed, so a rerun gives the same id."""
    kind = F.lpad(F.lower(F.hex(entity.cast("long"))), 2, "0")
    digits = F.concat(_hex(org, 8), _hex(millis, 12), kind, F.substring(F.sha2(seed.cast("string"), 256), 1, 10))
    return dashed(digits)


def dashed(digits: Column) -> Column:
    return F.concat_ws("-", *(F.substring(digits, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def _number(packed: Column, at: int, digits: int) -> Column:
    return F.conv(F.substring(F.replace(packed, F.lit("-"), F.lit("")), at, digits), 16, 10).cast("long")


def org_number(packed: Column) -> Column:
    return _number(packed, 1, 8)


def entity_byte(packed: Column) -> Column:
    return _number(packed, 21, 2).cast("int")


def entity_name(packed: Column) -> Column:
    names = F.create_map(*(F.lit(x) for pair in ((v, k) for k, v in ENTITY_BYTES.items()) for x in pair))
    return F.try_element_at(names, entity_byte(packed))


def created_at(packed: Column) -> Column:
    return F.timestamp_millis(_number(packed, 9, 12))


def is_packed_id(text: Column) -> Column:
    return text.rlike(UUID_PATTERN)


def share_org(a: Column, b: Column) -> Column:
    return F.substring(a, 1, 8) == F.substring(b, 1, 8)


def belongs_to(packed: Column, org: Column) -> Column:
    return org_number(packed) == org.cast("long")


def one_org(ids: Column) -> Column:
    """Whether all ids of an array lie in one organisation; global ids (organisation 0) don't count."""
    orgs = F.filter(F.transform(ids, org_number), lambda x: x != 0)
    return F.size(F.array_distinct(orgs)) <= 1
