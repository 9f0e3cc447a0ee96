"""Change feed -> current-state tables.

The monitor processes the registry feed row by row; here each state table is
a set of joins, group-bys and blocked prefix scans over the whole feed
(see :mod:`pkgsieve.operators.folds`).  Input feed schema:
``serial LONG, project STRING, version STRING, ts TIMESTAMP|LONG, action STRING``.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import actions as A
from .folds import DEFAULT_BLOCK, prefix_last, prefix_sum

REFRESH_KINDS = (A.KIND_NEW_RELEASE, A.KIND_YANK, A.KIND_UNYANK)
NEEDS_METADATA = (A.KIND_CREATE, *REFRESH_KINDS, A.KIND_FILE)


def epoch_seconds(ts: Column, dtype) -> Column:
    """Feed timestamps may be epoch seconds, instants or UTC wall-clock values
    (``TIMESTAMP_NTZ``); normalise to LONG seconds independent of the session
    time zone."""
    from pyspark.sql.types import NumericType, TimestampNTZType

    if isinstance(dtype, NumericType):
        return ts.cast("long")
    if isinstance(dtype, TimestampNTZType):
        days = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long")
        return days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    return F.unix_timestamp(ts)


def parse_feed(feed: DataFrame) -> DataFrame:
    """F4/F5/F7 on every feed row: kind, file name, owner, maintainer."""
    a = F.col("action")
    return feed.select(
        F.col("serial").cast("long").alias("serial"), "project", "version",
        epoch_seconds(F.col("ts"), feed.schema["ts"].dataType).alias("ts_s"),
        "action",
        A.action_kind(a).alias("kind"),
        A.filename_from_action(a).alias("filename"),
        A.owner_from_action(a).alias("owner"),
        A.maintainer_from_action(a).alias("maintainer"),
    )


def enrich(parsed: DataFrame, project_meta: DataFrame, release_meta: DataFrame) -> DataFrame:
    """Attach metadata availability to each event.

    ``skipped`` is the row-local "metadata missing" predicate (project level
    for ``create``, project or release for refresh and file events).  Both
    lookups are left joins on the name (semi-join shaped: metadata tables are
    reduced to key columns first).
    """
    pm = project_meta.select(F.col("name").alias("__pn")).distinct().withColumn("project_found", F.lit(True))
    rm = (release_meta.select(F.col("name").alias("__rn"), F.col("version").alias("__rv")).distinct()
                      .withColumn("release_found", F.lit(True)))
    e = (parsed.join(pm, parsed.project == pm.__pn, "left")
               .join(rm, (parsed.project == rm.__rn) & parsed.version.eqNullSafe(rm.__rv), "left")
               .drop("__pn", "__rn", "__rv")
               .fillna(False, ["project_found", "release_found"]))
    kind = F.col("kind")
    skipped = (((kind == A.KIND_CREATE) & ~F.col("project_found"))
               | (kind.isin(*REFRESH_KINDS, A.KIND_FILE) & ~(F.col("project_found") & F.col("release_found"))))
    return e.withColumn("skipped", skipped)


def refresh_triggers(enriched: DataFrame, block: int = DEFAULT_BLOCK) -> DataFrame:
    """Which events trigger a metadata refresh.

    Release / yank / unyank always; a file event only if its (project,
    version) differs, null-safely, from the previous *processed* feed row
    (global serial order; skipped rows do not update the previous row).
    """
    prev_val = F.when(~F.col("skipped"), F.struct(F.col("project").alias("p"), F.col("version").alias("v")))
    w = prefix_last(enriched, [], "serial", prev_val, "prev", block=block)
    differs = ~(F.col("prev.p").eqNullSafe(F.col("project")) & F.col("prev.v").eqNullSafe(F.col("version")))
    kind = F.col("kind")
    trig = kind.isin(*REFRESH_KINDS) | ((kind == A.KIND_FILE) & (F.col("prev").isNull() | differs))
    return w.withColumn("triggers", trig).drop("prev")


def _fold_incarnations(events: DataFrame, keys: list[str], block: int) -> DataFrame:
    """Open/close fold per key: ``etype`` 'O' opens if not live, 'C' closes
    if live.  Returns the effective opens with their closing serial."""
    oc = events.where(F.col("etype").isNotNull())
    t = prefix_last(oc, keys, "serial", F.col("etype"), "prev_type", block=block)
    t = t.withColumn("eff_open", (F.col("etype") == "O") & (F.col("prev_type").isNull() | (F.col("prev_type") == "C")))
    t = t.withColumn("eff_close", (F.col("etype") == "C") & (F.col("prev_type") == "O"))
    t = prefix_sum(t, keys, "serial", F.col("eff_open").cast("int"), "inc", block=block)
    opens = t.where("eff_open").select(*keys, "inc", F.col("serial").alias("open_serial"),
                                       F.col("ts_s").alias("open_ts"), F.col("kind").alias("opened_by"))
    closes = t.where("eff_close").select(*keys, "inc", F.col("serial").alias("close_serial"),
                                         F.col("ts_s").alias("close_ts"), F.col("kind").alias("closed_by"))
    return opens.join(closes, [*keys, "inc"], "left")


def with_refresh(enriched: DataFrame, block: int = DEFAULT_BLOCK) -> DataFrame:
    return refresh_triggers(enriched, block).withColumn(
        "refresh", F.col("triggers") & F.col("kind").isin(*REFRESH_KINDS, A.KIND_FILE))


def project_incarnations(events: DataFrame, block: int = DEFAULT_BLOCK) -> DataFrame:
    """Each ``remove project`` closes the live project row, a later create
    opens a new one; a create while live is ignored (first write wins).  A
    refresh of a project with no live row also opens one (the monitor's
    insert-or-update path).  ``events`` = output of :func:`with_refresh`.
    """
    kind = F.col("kind")
    etype = (F.when((kind == A.KIND_CREATE) & F.col("project_found"), F.lit("O"))
              .when(F.col("refresh") & F.col("project_found"), F.lit("O"))
              .when(kind == A.KIND_REMOVE_PROJECT, F.lit("C")))
    inc = _fold_incarnations(events.withColumn("etype", etype), ["project"], block)
    return inc.select(
        "project", F.col("inc").alias("incarnation"), "open_serial", "opened_by", "open_ts",
        "close_serial", "close_ts", (F.col("close_serial").isNull()).alias("live"),
    )


def release_state(events: DataFrame, block: int = DEFAULT_BLOCK) -> DataFrame:
    """Release rows per (project, version).  A processed refresh opens the
    release (insert-ignore while live); ``remove release`` closes it;
    ``remove project`` closes every live release of the project.

    Project removals are looked up along the project's feed order (the last
    one before and the first one after each release event), so they are never
    multiplied by the project's versions.
    """
    kind = F.col("kind")
    etype = F.when(F.col("refresh") & ~F.col("skipped"), F.lit("O")).when(kind == A.KIND_REMOVE_RELEASE, F.lit("C"))
    ev = events.withColumn("etype", etype).where(F.col("etype").isNotNull() | (kind == A.KIND_REMOVE_PROJECT))
    ev = ev.select("project", "version", "serial", "kind", "etype").withColumn("back", -F.col("serial"))
    removal = F.when(F.col("kind") == A.KIND_REMOVE_PROJECT, F.struct(F.col("serial").alias("s"), F.col("kind").alias("k")))
    ev = prefix_last(ev, ["project"], "serial", removal, "gone", block=block)
    ev = prefix_last(ev, ["project"], "back", removal, "goes", block=block).where(F.col("etype").isNotNull())
    keys = ["project", "version"]
    this = F.struct(F.col("serial").alias("s"), F.col("etype").alias("e"))
    ev = prefix_last(ev, keys, "serial", this, "prev", block=block)
    close = F.when(F.col("etype") == "C", F.struct(F.col("serial").alias("s"), F.col("kind").alias("k")))
    ev = prefix_last(ev, keys, "back", close, "shut", block=block)
    was_live = F.coalesce((F.col("prev.e") == "O") & (F.col("gone").isNull() | (F.col("gone.s") < F.col("prev.s"))), F.lit(False))
    ev = ev.withColumn("opens", (F.col("etype") == "O") & ~was_live)
    ev = prefix_sum(ev, keys, "serial", F.col("opens").cast("int"), "inc", block=block)
    first = F.least(F.col("shut"), F.col("goes"))  # by serial; null means none
    return ev.where("opens").select(
        *keys, F.col("inc").alias("release_incarnation"), F.col("serial").alias("open_serial"), F.col("kind").alias("opened_by"),
        first["s"].alias("close_serial"), first["k"].alias("closed_by"), first.isNull().alias("live"))


MEMBER_KEY = ["project", "incarnation", "role", "user"]


def role_moves(events: DataFrame, incarnations: DataFrame, block: int = DEFAULT_BLOCK) -> DataFrame:
    """Pushes (sign 1) and pulls (-1) of members in live incarnations:
    (project, incarnation, serial, role, user, sign).

    add / accepted push, invite is a no-op, remove pulls every copy, change
    moves between roles (a move pushes even if the user was not in the old
    role).  Events with no live incarnation are dropped.
    """
    kind = F.col("kind")
    own, mnt = F.col("owner"), F.col("maintainer")

    def op(role: str, user: Column, sign: int) -> Column:
        return F.struct(F.lit(role).alias("role"), user.alias("user"), F.lit(sign).alias("sign"))

    ops = (F.when(kind.isin("add_owner", "accepted_owner"), F.array(op("owners", own, 1)))
            .when(kind == "remove_owner", F.array(op("owners", own, -1)))
            .when(kind == "change_owner", F.array(op("owners", own, -1), op("maintainers", own, 1)))
            .when(kind.isin("add_maintainer", "accepted_maintainer"), F.array(op("maintainers", mnt, 1)))
            .when(kind == "remove_maintainer", F.array(op("maintainers", mnt, -1)))
            .when(kind == "change_maintainer", F.array(op("maintainers", mnt, -1), op("owners", mnt, 1))))
    role_ev = events.where(ops.isNotNull()).select("project", "serial", F.explode(ops).alias("o"), F.lit(None).cast("long").alias("marker"))
    # live-incarnation markers: +inc at its opening serial, -1 at its closing serial
    markers = (incarnations.select("project", F.col("open_serial").alias("serial"), F.col("incarnation").alias("marker"))
               .unionByName(incarnations.where(F.col("close_serial").isNotNull())
                            .select("project", F.col("close_serial").alias("serial"), F.lit(-1).cast("long").alias("marker"))))
    markers = markers.withColumn("o", F.lit(None).cast(role_ev.schema["o"].dataType))
    u = role_ev.unionByName(markers)
    u = prefix_last(u, ["project"], "serial", F.col("marker").cast("long"), "live_inc", block=block)
    return (u.where(F.col("o").isNotNull() & (F.col("live_inc") > 0))
             .select("project", F.col("live_inc").alias("incarnation"), "serial", "o.role", "o.user", "o.sign"))


def members(moves: DataFrame) -> DataFrame:
    """Membership: the pushes after the last pull of (incarnation, role, user):
    two group-bys and a join, so a hot project or user is partial-aggregated,
    never one task."""
    last_pull = moves.groupBy(*MEMBER_KEY).agg(F.max(F.when(F.col("sign") < 0, F.col("serial"))).alias("last_pull"))
    j = moves.where(F.col("sign") > 0).join(last_pull, MEMBER_KEY)
    return j.where(F.col("last_pull").isNull() | (F.col("serial") > F.col("last_pull"))).select(*MEMBER_KEY).distinct()


def project_roles(events: DataFrame, incarnations: DataFrame, block: int = DEFAULT_BLOCK) -> DataFrame:
    """Owner / maintainer membership per project incarnation."""
    return members(role_moves(events, incarnations, block))


def project_merge(target: DataFrame, incoming: DataFrame) -> DataFrame:
    """Partial update of the live project row by the latest
    metadata per project.

    ``target``: ``name, info_version, last_serial, analyzed, remove``;
    ``incoming``: ``name, info_version, last_serial, serial``.  The latest
    incoming row per name wins (max_by serial, a partial aggregate).  Live
    rows get new info / last_serial and ``analyzed`` resets to false when the
    version changed; removed rows are untouched; names without a live row get
    a new live row.
    """
    latest = incoming.groupBy("name").agg(
        F.max_by(F.struct("info_version", "last_serial"), F.col("serial")).alias("new"))
    live = target.where(~F.col("remove"))
    removed = target.where(F.col("remove"))
    m = live.join(latest, "name", "full_outer")
    merged = m.select(
        "name",
        F.coalesce(F.col("new.info_version"), F.col("info_version")).alias("info_version"),
        F.coalesce(F.col("new.last_serial"), F.col("last_serial")).alias("last_serial"),
        F.when(F.col("new").isNull(), F.col("analyzed"))
         .when(F.col("remove").isNull(), F.lit(False))
         .otherwise(F.col("analyzed") & F.col("info_version").eqNullSafe(F.col("new.info_version")))
         .alias("analyzed"),
        F.lit(False).alias("remove"),
    )
    return merged.unionByName(removed.select("name", "info_version", "last_serial", "analyzed", "remove"))
