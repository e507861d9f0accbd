"""Roll-ups and lookups over collections, members, keys, shares, threads and connections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import org_number


def collection_rollup(collections: DataFrame, sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """Collections with how many sources and chunks each has, 0 for none.

    Each child is counted on its own before the join: joining both children first would pair every
    source of a collection with every chunk of it, only for distinct counts to undo that.
    """
    n = lambda child, name: child.where(F.col("collection_id").isNotNull()).groupBy("collection_id").agg(F.count(F.lit(1)).alias(name)).withColumnRenamed("collection_id", "id")
    out = collections.join(n(sources, "source_count"), "id", "left").join(n(chunks, "chunk_count"), "id", "left")
    return out.fillna(0, ["source_count", "chunk_count"])


def members(memberships: DataFrame, users: DataFrame) -> DataFrame:
    """Memberships with their user's name and address."""
    u = users.select(F.col("id").alias("user_id"), "email", "first_name", "last_name")
    return memberships.join(u, "user_id")


def organisations_of(memberships: DataFrame, orgs: DataFrame, user_id) -> DataFrame:
    """Every organisation that a user belongs to, with their roles there."""
    mine = memberships.where(F.col("user_id") == F.lit(user_id))
    return mine.join(orgs.select(F.col("id").alias("org_id"), F.col("name").alias("org_name")), "org_id")


def open_invitations(invitations: DataFrame, orgs: DataFrame, now: Column) -> DataFrame:
    """Invitations not expired, with the organisation's name."""
    return invitations.where(F.col("expires_at") > now).join(orgs.select(F.col("id").alias("org_id"), F.col("name").alias("org_name")), "org_id")


def with_role(memberships: DataFrame, role: str) -> DataFrame:
    return memberships.where(F.array_contains("roles", role))


def owners(memberships: DataFrame) -> DataFrame:
    """(org_id, owners); an organisation can't lose its last one."""
    return memberships.groupBy("org_id").agg(F.count_if(F.array_contains("roles", "OWNER")).alias("owners"))


def live_keys(keys: DataFrame, include_revoked: bool = False) -> DataFrame:
    out = keys if include_revoked else keys.where(F.col("revoked_at").isNull())
    return out.orderBy(F.desc_nulls_last("created_at"), "id")


def key_counts(keys: DataFrame) -> DataFrame:
    return keys.agg(F.count_if(F.col("revoked_at").isNull()).alias("active"), F.count_if(F.col("revoked_at").isNotNull()).alias("revoked"))


def last_used(uses: DataFrame) -> DataFrame:
    """(key_id, last_used_at) from single uses."""
    return uses.groupBy("key_id").agg(F.max("used_at").alias("last_used_at"))


def live_share(shares: DataFrame, token: str) -> DataFrame:
    return shares.where((F.col("share_token") == token) & ~F.col("revoked"))


def visible_shares(shares: DataFrame, memberships: DataFrame, user_id) -> DataFrame:
    """Shares that a user may read: public ones, and those of an organisation that the user belongs to.

    The organisation is read from the packed ids, so no organisation table is joined.
    """
    mine = memberships.where(F.col("user_id") == F.lit(user_id)).select(org_number(F.col("id")).alias("org")).distinct()
    own = shares.where(~F.col("is_public")).withColumn("org", org_number(F.col("id"))).join(mine, "org", "left_semi").drop("org")
    return shares.where("is_public").unionByName(own).where(~F.col("revoked"))


def live_tokens(tokens: DataFrame, kind: str, now: Column) -> DataFrame:
    return tokens.where((F.col("type") == kind) & F.col("used_at").isNull() & (F.col("expires_at") > now))


def usable_connections(connections: DataFrame, active_only: bool = False) -> DataFrame:
    return connections.where(F.col("status") == "ACTIVE") if active_only else connections.where(F.col("status") != "DISCONNECTED")


#: Fields of a connection's state that may leave the service; sync cursors and bot ids stay.
PUBLIC_FIELDS = {
    "SLACK": ("teamDomain", "selectedChannelIds"),
    "GITHUB": ("installationId", "selectedRepos"),
    "LINEAR": ("workspaceSlug",),
    "NOTION": ("workspaceId",),
}


def public_state(connections: DataFrame, state: str = "provider_data") -> DataFrame:
    """connections with only public fields in their state struct, those of other providers null."""
    inner = connections.schema[state].dataType.fieldNames()
    shown = lambda f: F.when(F.col("provider").isin([p for p, fs in PUBLIC_FIELDS.items() if f in fs]), F.col(f"{state}.{f}")).alias(f)
    return connections.withColumn(state, F.struct(*(shown(f) for f in inner if any(f in fs for fs in PUBLIC_FIELDS.values()))))


def marked_selected(resources: DataFrame, selected: DataFrame, id_col: str = "id") -> DataFrame:
    """resources with whether each is among the selected ids."""
    chosen = selected.select(F.col(id_col)).distinct().withColumn("selected", F.lit(True))
    return resources.join(chosen, id_col, "left").fillna(False, ["selected"])


def one_org_only(ids: Sequence[str], org: int) -> None:
    """Refuse a request that names a collection of another organisation."""
    wrong = [i for i in ids if int(i.replace("-", "")[:8], 16) != org]
    if wrong:
        raise PermissionError(f"not in organisation {org}: {', '.join(wrong)}")


def foreign_ids(ids: Column, org: Column) -> Column:
    """Of an array of packed ids, those of other organisations: a request that names any is refused."""
    return F.filter(ids, lambda x: org_number(x) != org.cast("long"))


# sorted and paged lists

SORTABLE = ("created_at", "updated_at", "title", "name", "total_tokens", "requests")


def sorted_rows(df: DataFrame, by: str, descending: bool = False, key: str = "id", allowed: Sequence[str] = SORTABLE) -> DataFrame:
    """Nulls last either way, text in language order, ties by key."""
    if by not in allowed:
        raise ValueError(f"cannot sort by {by}")
    c = F.collate(by, "UNICODE") if dict(df.dtypes)[by] == "string" else F.col(by)
    return df.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), F.col(key).asc_nulls_last())


def toggled(current: str | None, descending: bool, clicked: str) -> tuple[str, bool]:
    """Sort column and direction after a click on a column's head."""
    return (clicked, not descending) if clicked == current else (clicked, False)


def page(ordered: DataFrame, number: int = 1, size: int = 20) -> DataFrame:
    """One page of an ordered table; pages count from 1 and hold at most 100 rows."""
    if number < 1 or not 1 <= size <= 100:
        raise ValueError("page from 1, size from 1 to 100")
    return ordered.offset((number - 1) * size).limit(size)


def page_with_total(ordered: DataFrame, number: int = 1, size: int = 20) -> DataFrame:
    """One row (items, total, page, limit): a page's rows in order, and how many rows there are on all pages.

    Rows are numbered behind the sort and limit of the page only; the total is a count of its own that reads no column.
    """
    rows = page(ordered, number, size)
    at = F.struct(F.monotonically_increasing_id().alias("at"), F.struct(*rows.columns).alias("item"))
    items = rows.coalesce(1).select(at.alias("x")).agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["item"]).alias("items"))
    total = ordered.agg(F.count(F.lit(1)).alias("total"))
    return items.join(total, how="cross").select("items", "total", F.lit(number).alias("page"), F.lit(size).alias("limit"))


def found(df: DataFrame, org_id, key, id_col: str = "id", org_col: str = "org_id") -> DataFrame:
    """The row of an id within its tenant; another tenant's row is as good as none."""
    return df.where((F.col(org_col) == F.lit(org_id)) & (F.col(id_col) == F.lit(key))).limit(1)


def newest_first(df: DataFrame, column: str = "created_at", key: str = "id") -> DataFrame:
    return df.orderBy(F.desc_nulls_last(column), F.asc_nulls_last(key))


def history_page(messages: DataFrame, thread_id, most: int = 1000) -> DataFrame:
    """A thread's messages, oldest first, up to most."""
    return messages.where(F.col("thread_id") == F.lit(thread_id)).orderBy(F.asc_nulls_last("created_at"), "id").limit(most)
