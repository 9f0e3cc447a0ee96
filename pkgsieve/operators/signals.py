"""Poisoning signals for new project names (J1-J6) and the suspicion roll-up (A1).

Plan shape (for millions of new names against a bounded popular list):

* the popular list is the top-N download list; its blocking keys are ~15 rows
  per name.  Whether they are broadcast is left to the adaptive planner, which
  goes by their size;
* each name is exploded into its deletion keys or, for more than one edit,
  its substrings at a segment's places (J2), or its sorted-character key (J3) and joined with those of the popular names: no cross join; matches
  are verified with the exact predicate;
* alias / removed / private lookups are semi or equi joins on the name,
  pre-aggregated per name before the join so a hot name costs one row;
* all signal rows plus one zero row per name are unioned and grouped once by
  the name id: the only shuffle over the whole input.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import deletion_keys, mismatches, probe_keys, segment_keys, sorted_chars, within_distance

# Signal scores and message templates must equal the
# reference's text exactly.
SCORE_POPULAR = 4
SCORE_TYPOSQUAT = 7
SCORE_IMPORT_HIJACK = 10
SCORE_NAME_REUSE = 10
SCORE_DEP_CONFUSION = 10
MSG_POPULAR = "Popular Project: popular project {p} downloaded {n} times"
MSG_TYPOSQUAT = "Typosquatting: suspected to be typosquatting of project {q}"
MSG_IMPORT_HIJACK = "Import-Name Hijacking: project name is same as the import name of popular project {q}"
MSG_NAME_REUSE = (
    "Project Use-After-Free: creating project with name {p}, "
    "a project with the same name was removed before"
)
MSG_DEP_CONFUSION = "Dependency Confusion: a project with the same name exists in private sources"

# Signal groups in the order their messages are listed (A1).
GRP_POPULAR_LOOP, GRP_IMPORT, GRP_REUSE, GRP_PRIVATE = 0, 1, 2, 3
# Within the popular loop: exact, Levenshtein, swap (per popular row).
SUB_EXACT, SUB_LEVENSHTEIN, SUB_SWAP = 0, 1, 2


def _template(tmpl: str, **cols: Column) -> Column:
    """Fill ``{x}`` slots of a fixed template with column values."""
    parts: list[Column] = []
    rest = tmpl
    while "{" in rest:
        pre, rest = rest.split("{", 1)
        key, rest = rest.split("}", 1)
        parts += [F.lit(pre), cols[key].cast("string")]
    parts.append(F.lit(rest))
    return F.concat(*parts)


def _signal(df: DataFrame, grp: int, dc: Column, pname: Column, sub: int, score: int, msg: Column) -> DataFrame:
    return df.select(
        "nid",
        "name",
        F.struct(
            F.lit(grp).alias("grp"),
            (-dc).cast("long").alias("neg_dc"),
            pname.alias("pname"),
            F.lit(sub).alias("sub"),
            msg.alias("msg"),
        ).alias("sig"),
        F.lit(score).alias("score"),
    )


def popular_exact(names: DataFrame, popular: DataFrame) -> DataFrame:
    """The name is itself a popular project (exact ``==``)."""
    j = names.join(popular, names.name == popular.pname)
    return _signal(j, GRP_POPULAR_LOOP, F.col("download_count"), F.col("pname"), SUB_EXACT, SCORE_POPULAR,
                   _template(MSG_POPULAR, p=F.col("name"), n=F.col("download_count")))


def levenshtein_pairs(names: DataFrame, popular: DataFrame, distance: int = 1, dedupe: bool = True) -> DataFrame:
    """J2 candidate pairs ``0 < lev(name, pname) <= distance`` without a cross join.

    One edit: both sides are joined on their deletion neighbourhoods.  More:
    the popular names' distance + 1 segments are joined with the substrings of
    the names that may be one, so the keys per name do not grow with its
    length.  Both are complete; the pairs are verified.
    """
    ours, theirs = (deletion_keys, deletion_keys) if distance == 1 else (probe_keys, segment_keys)
    nk = names.select("nid", "name", F.explode(ours("name", distance)).alias("k"))
    pk = popular.select("pname", "download_count", F.explode(theirs("pname", distance)).alias("k"))
    j = nk.join(pk, "k")
    pairs = j.where(within_distance("name", "pname", distance)).select("nid", "name", "pname", "download_count")
    # several shared keys can produce the same pair; the roll-up de-duplicates
    # with collect_set, stand-alone callers get distinct pairs here
    return pairs.dropDuplicates(["nid", "pname"]) if dedupe else pairs


def typosquat_levenshtein(names: DataFrame, popular: DataFrame, distance: int = 1) -> DataFrame:
    j = levenshtein_pairs(names, popular, distance, dedupe=False)
    return _signal(j, GRP_POPULAR_LOOP, F.col("download_count"), F.col("pname"), SUB_LEVENSHTEIN, SCORE_TYPOSQUAT,
                   _template(MSG_TYPOSQUAT, q=F.col("pname")))


def swap_pairs(names: DataFrame, popular: DataFrame) -> DataFrame:
    """J3 pairs: equi-join on (length, sorted characters), then exactly two
    mismatching positions."""
    nk = names.select("nid", "name", F.length("name").alias("len"), sorted_chars("name").alias("sk"))
    pk = popular.select("pname", "download_count", F.length("pname").alias("len"), sorted_chars("pname").alias("sk"))
    j = nk.join(pk, ["len", "sk"])
    return j.where(mismatches("name", "pname") == 2).select("nid", "name", "pname", "download_count")


def typosquat_swap(names: DataFrame, popular: DataFrame) -> DataFrame:
    j = swap_pairs(names, popular)
    return _signal(j, GRP_POPULAR_LOOP, F.col("download_count"), F.col("pname"), SUB_SWAP, SCORE_TYPOSQUAT,
                   _template(MSG_TYPOSQUAT, q=F.col("pname")))


def import_hijack(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """The name equals the import name of another project.  One message
    per name, naming the (smallest) owning project."""
    owners = (aliases.where(F.col("import_name") != F.col("name"))
                     .groupBy(F.col("import_name").alias("iname"))
                     .agg(F.min("name").alias("owner")))
    j = names.join(owners, names.name == owners.iname)
    return _signal(j, GRP_IMPORT, F.lit(0), F.lit(""), 0, SCORE_IMPORT_HIJACK,
                   _template(MSG_IMPORT_HIJACK, q=F.col("owner")))


def name_reuse(names: DataFrame, removed: DataFrame) -> DataFrame:
    """A removed incarnation with the same name exists (semi join)."""
    gone = removed.select(F.col("name").alias("rname")).distinct()
    j = names.join(gone, names.name == gone.rname, "left_semi")
    return _signal(j, GRP_REUSE, F.lit(0), F.lit(""), 0, SCORE_NAME_REUSE,
                   _template(MSG_NAME_REUSE, p=F.col("name")))


def dependency_confusion(names: DataFrame, private: DataFrame) -> DataFrame:
    """The name exists in the private package list (semi join)."""
    priv = private.select(F.col("name").alias("prname")).distinct()
    j = names.join(priv, names.name == priv.prname, "left_semi")
    return _signal(j, GRP_PRIVATE, F.lit(0), F.lit(""), 0, SCORE_DEP_CONFUSION, F.lit(MSG_DEP_CONFUSION))


def popular_loop_signals(names: DataFrame, popular: DataFrame, distance: int = 1) -> DataFrame:
    """J1 + J2 + J3 in one probe of the broadcast popular keys.

    Both sides are exploded into tagged blocking keys: ``d:`` deletion keys
    (they include the name itself, so exact matches meet too) and ``s:`` the
    (length, sorted characters) swap key.  One map-side join yields every
    candidate pair; each pair then emits the signals whose exact predicate
    holds.  Duplicate pairs (several shared keys) are removed by the
    ``collect_set`` of the roll-up.
    """

    def keyed(name: str) -> Column:
        dk = F.transform(deletion_keys(name, min(distance, 2)), lambda k: F.concat(F.lit("d:"), k))
        sk = F.concat(F.lit("s:"), F.length(name).cast("string"), F.lit(":"), sorted_chars(name))
        return F.array_union(dk, F.array(sk))

    nk = names.select("nid", "name", F.explode(keyed("name")).alias("k"))
    pk = popular.select("pname", "download_count", F.explode(keyed("pname")).alias("k"))
    pairs = nk.join(pk, "k").drop("k")
    if distance > 2:
        pairs = pairs.unionByName(levenshtein_pairs(names, popular, distance, dedupe=False))
    name, pname, dc = F.col("name"), F.col("pname"), F.col("download_count")

    def sig(sub: int, score: int, msg: Column) -> Column:
        return F.struct(
            F.struct(F.lit(GRP_POPULAR_LOOP).alias("grp"), (-dc).cast("long").alias("neg_dc"), pname.alias("pname"),
                     F.lit(sub).alias("sub"), msg.alias("msg")).alias("sig"),
            F.lit(score).alias("score"),
        )

    fired = F.filter(
        F.array(
            F.when(name == pname, sig(SUB_EXACT, SCORE_POPULAR, _template(MSG_POPULAR, p=name, n=dc))),
            F.when(within_distance(name, pname, distance),
                   sig(SUB_LEVENSHTEIN, SCORE_TYPOSQUAT, _template(MSG_TYPOSQUAT, q=pname))),
            F.when((F.length(name) == F.length(pname)) & (mismatches(name, pname) == 2)
                   & (sorted_chars(name) == sorted_chars(pname)),
                   sig(SUB_SWAP, SCORE_TYPOSQUAT, _template(MSG_TYPOSQUAT, q=pname))),
        ),
        lambda x: x.isNotNull(),
    )
    return pairs.select("nid", "name", F.explode(fired).alias("f")).select("nid", "name", "f.sig", "f.score")


def lookup_signals(names: DataFrame, aliases: DataFrame | None, removed: DataFrame | None,
                   private: DataFrame | None) -> DataFrame:
    """J4 + J5 + J6 as one equi-join on the name.

    The three lookup tables are reduced to at most one row per (name, signal)
    before the join (map-side partial aggregation), so a name that appears
    in millions of alias rows still contributes one row; a hot name on the
    probe side is split by AQE's skew-join handling.
    """
    facts = []
    if aliases is not None:
        facts.append(aliases.where(F.col("import_name") != F.col("name"))
                            .select(F.col("import_name").alias("lname"), F.lit(GRP_IMPORT).alias("grp"),
                                    F.col("name").alias("owner")))
    if removed is not None:
        facts.append(removed.select(F.col("name").alias("lname"), F.lit(GRP_REUSE).alias("grp"),
                                    F.lit(None).cast("string").alias("owner")))
    if private is not None:
        facts.append(private.select(F.col("name").alias("lname"), F.lit(GRP_PRIVATE).alias("grp"),
                                    F.lit(None).cast("string").alias("owner")))
    if not facts:
        return None
    u = facts[0]
    for f in facts[1:]:
        u = u.unionByName(f)
    u = u.groupBy("lname", "grp").agg(F.min("owner").alias("owner"))
    j = names.join(u, names.name == u.lname)
    grp = F.col("grp")
    msg = (F.when(grp == GRP_IMPORT, _template(MSG_IMPORT_HIJACK, q=F.col("owner")))
            .when(grp == GRP_REUSE, _template(MSG_NAME_REUSE, p=F.col("name")))
            .otherwise(F.lit(MSG_DEP_CONFUSION)))
    score = (F.when(grp == GRP_IMPORT, F.lit(SCORE_IMPORT_HIJACK))
              .when(grp == GRP_REUSE, F.lit(SCORE_NAME_REUSE))
              .otherwise(F.lit(SCORE_DEP_CONFUSION)))
    return j.select(
        "nid", "name",
        F.struct(grp.alias("grp"), F.lit(0).cast("long").alias("neg_dc"), F.lit("").alias("pname"),
                 F.lit(0).alias("sub"), msg.alias("msg")).alias("sig"),
        score.alias("score"),
    )


def project_suspicion(
    names: DataFrame,
    popular: DataFrame,
    aliases: DataFrame | None = None,
    removed: DataFrame | None = None,
    private: DataFrame | None = None,
    distance: int = 1,
    id_col: str = "c_custkey",
    name_col: str = "project",
) -> DataFrame:
    """A1: suspicion = max fired score (0 if none) and the ordered messages.

    Returns ``id_col, name_col, suspicion, n_signals, suspicion_info`` where
    ``suspicion_info`` is an ``ARRAY<STRING>`` in signal order (popular-list
    order within the exact / Levenshtein / swap signals, then import-name,
    name-reuse and private-name signals).
    """
    n = names.select(F.col(id_col).alias("nid"), F.col(name_col).alias("name"))
    pop = popular.select(F.col("project").alias("pname"), F.col("download_count").cast("long").alias("download_count"))
    sigs = popular_loop_signals(n, pop, distance)
    looked = lookup_signals(n, aliases, removed, private)
    if looked is not None:
        sigs = sigs.unionByName(looked)
    # one zero row per name so names without signals survive the single group-by
    zero = n.select("nid", "name", F.lit(None).cast(sigs.schema["sig"].dataType).alias("sig"), F.lit(0).alias("score"))
    agg = (sigs.unionByName(zero)
               .groupBy("nid", "name")
               .agg(F.max("score").alias("suspicion"),
                    F.sort_array(F.collect_set("sig")).alias("sigs")))
    return agg.select(
        F.col("nid").alias(id_col),
        F.col("name").alias(name_col),
        F.col("suspicion"),
        F.size("sigs").cast("long").alias("n_signals"),
        F.transform("sigs", lambda s: s["msg"]).alias("suspicion_info"),
    )
