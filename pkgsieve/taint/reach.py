"""Taint marking, reach and issues.

A taint arrives at a record at the visit number of the read that brought it,
and only reads after that carry it on, so arrival times grow along every path.
The reads that lead from one record to another are edges with a time; every
record's earliest arrivals come from the edges in the order of time, block by
block (``arrivals``).
"""
from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.common import checkpoint_cut
from . import arrivals
from .engine import PLACE, Facts, taint_struct
from .sweep import record_id, scoped_lookup

NODE_KEY = ["file_id", "seq", "t"]


def _cut(df: DataFrame) -> DataFrame:
    return checkpoint_cut(df, bucket="file_id")


def brings_taint() -> Column:
    """Nodes at which a taint may begin or be read: only their stations are asked for."""
    return F.col("ntype").isin("Call", "Constant") | F.col("ctx").eqNullSafe("Load")


def _guarded(t: Column) -> Column:
    return F.coalesce(t["position"] != "ret", F.lit(True)) | t["keyword"].isNotNull()


def _stations(up: Column, line: Column, guarded: Column) -> Column:
    """The stations that a taint passes: all, or for a guarded taint those
    before the first node on the taint's own line."""
    stop = F.array_position(F.transform(up, lambda x: F.array_contains(x["lines"], line)), True).cast("int")
    return F.when(guarded & (stop > 0), F.slice(up, 1, stop - 1)).otherwise(up)


def _named(rows: DataFrame) -> DataFrame:
    """Rows with a taint ``t`` plus its number and what guards it."""
    t = F.col("t")
    return rows.select("*", F.xxhash64("t").alias("tid"), t["lineno"].alias("line"), _guarded(t).alias("guarded"))


def spread(origins: DataFrame) -> DataFrame:
    """X13 + X15: a taint on a node reaches its same-scope ancestors (below
    the module).  A guarded taint (argument position or keyword) does not
    leave a node on its own line.  ``origins``: file_id, seq, tid, line,
    guarded, at and the node's stations ``up`` (null: none)."""
    up = F.explode(_stations(F.col("up"), F.col("line"), F.col("guarded"))).alias("u")
    above = origins.select("file_id", up, "tid", "at").select("file_id", F.col("u.seq").alias("seq"), "tid", "at")
    return origins.select("file_id", "seq", "tid", "at").unionByName(above)


def _record_id() -> Column:
    return record_id("rec_ns", "name", "rec_seq")


def reach(fx: Facts, name_info: DataFrame, attr_names: DataFrame, aloads: DataFrame, cm: DataFrame,
          attr_seeds: DataFrame, argt: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(reached, named)``: (file_id, seq, tid, at) of the nodes each
    taint reached, and the taints by number (file_id, tid, t)."""
    nodes = fx.nodes
    ups = nodes.where(brings_taint()).where(F.size("up") > 0).select("file_id", "seq", "up")
    ret_seeds = cm.where(F.col("position") == "ret").select("file_id", "seq", "t", F.col("seq").alias("at"))
    # The variable / dotted name / constant passed
    to_name = argt.where(F.col("arg_type") == "Name").join(
        name_info.select("file_id", F.col("seq").alias("arg_seq"), "rec_ns", F.col("name").alias("rname"),
                         "rec_seq"), ["file_id", "arg_seq"]).where(F.col("rec_seq").isNotNull())
    rec_seed = to_name.select("file_id", "rec_ns", F.col("rname").alias("name"), "rec_seq", "t",
                              F.col("seq").alias("at"))
    # dotted-name records (attribute assignment targets) and their readers
    attr_tg = _cut(fx.assigns.where(F.col("tkind") == "attr").join(
        attr_names.select("file_id", F.col("seq").alias("tattr_seq"), F.col("rname").alias("name")),
        ["file_id", "tattr_seq"]).select("file_id", "seq", F.col("ns").alias("rec_ns"), "name", F.col("seq").alias("rec_seq")))
    alook = scoped_lookup(aloads.select("file_id", F.col("seq").alias("useq"), "ns", F.col("rname").alias("name")),
                          attr_tg.select("file_id", F.col("rec_ns").alias("ns"), "name", F.col("seq").alias("dseq")))
    # readers of records: Name loads and dotted Attribute loads, with the stations above them
    readers = name_info.where(F.col("rec_seq").isNotNull()).select(
        "file_id", "seq", _record_id().alias("rid"), "rec_ns", "name", "rec_seq").unionByName(
        alook.select("file_id", F.col("useq").alias("seq"), _record_id().alias("rid"), "rec_ns", "name", "rec_seq"))
    readers = _cut(readers.join(ups, ["file_id", "seq"], "left"))
    to_attr = argt.where(F.col("arg_type") == "Attribute").join(
        readers.select("file_id", F.col("seq").alias("arg_seq"), "rec_ns", "name", "rec_seq"), ["file_id", "arg_seq"])
    rec_seed = rec_seed.unionByName(to_attr.select("file_id", "rec_ns", "name", "rec_seq", "t", F.col("seq").alias("at")))
    # X11: constants equal to a tainted one, visited after it
    const_taint = argt.where(F.col("arg_type") == "Constant").join(
        fx.consts.select("file_id", F.col("seq").alias("arg_seq"), "cval"), ["file_id", "arg_seq"]).select(
        "file_id", "cval", "t", F.col("seq").alias("at"))
    const_nodes = fx.consts.select("file_id", F.col("seq").alias("rseq"), "cval")
    const_origins = const_taint.join(const_nodes, ["file_id", "cval"]).where(F.col("rseq") > F.col("at")).select(
        "file_id", F.col("rseq").alias("seq"), "t", F.col("rseq").alias("at"))
    # Parameters are records tainted type=input
    par = fx.params.select("file_id", F.col("ns").alias("rec_ns"), "name", F.col("seq").alias("rec_seq"),
                           taint_struct("0000", "type", "input", None, None, None, None, -1, -1, -1, -1).alias("t"),
                           F.col("seq").alias("at"))
    rec_seed = rec_seed.unionByName(par)

    # targets fed by a reached node: assignment targets and `with ... as` names
    name_tg = fx.assigns.where(F.col("tkind") == "name").select(
        "file_id", "seq", F.col("ns").alias("rec_ns"), F.col("tname").alias("name"), F.col("seq").alias("rec_seq"))
    with_tg = fx.withs.select("file_id", "seq", F.col("ns").alias("rec_ns"), "name", F.col("seq").alias("rec_seq"))
    feeds = _cut(name_tg.unionByName(attr_tg).unionByName(with_tg).select(
        "file_id", "seq", _record_id().alias("rid")).distinct())

    origins = _named(ret_seeds.unionByName(attr_seeds).unionByName(const_origins))
    origins = _cut(origins.join(ups, ["file_id", "seq"], "left"))
    from_origins = _cut(spread(origins))
    # taints put on records: by a marked node below an assignment, by argument, by parameter
    rec_seed = _cut(_named(rec_seed.select("file_id", _record_id().alias("rid"), "t", "at")))
    taints = origins.select("file_id", "tid", "line", "guarded", "t").unionByName(
        rec_seed.select("file_id", "tid", "line", "guarded", "t"))
    taints = _cut(taints.dropDuplicates(["file_id", "tid"]))
    how = taints.select("file_id", "tid", "line", "guarded")
    fed = from_origins.join(feeds, ["file_id", "seq"]).select("file_id", "rid", "tid", "at")
    seeds = fed.unionByName(rec_seed.select("file_id", "rid", "tid", "at")).groupBy("file_id", "rid", "tid").agg(F.min("at").alias("at"))
    seeds = seeds.join(how, ["file_id", "tid"])
    # edges: a read, the stations above it, the records these feed
    steps = readers.where("up is not null").select(
        "file_id", F.col("seq").alias("r"), F.col("rid").alias("a"), "up", F.posexplode("up").alias("k", "u"))
    steps = steps.select("file_id", "r", "a", F.col("u.seq").alias("seq"), F.array_distinct(F.flatten(
        F.transform(F.slice("up", 1, F.col("k") + 1), lambda x: x["lines"]))).alias("lines"))
    edges = steps.join(feeds.withColumnRenamed("rid", "b"), ["file_id", "seq"]).drop("seq")
    # The reads after a taint's arrival carry it
    long_files = nodes.where(F.col("seq") >= arrivals.BLOCK).select("file_id").distinct()
    carried = arrivals.earliest(edges, seeds, long_files).join(readers.select("file_id", "rid", "seq", "up"), ["file_id", "rid"])
    carried = carried.where(F.col("seq") > F.col("at")).select("file_id", "seq", "tid", "up", F.col("seq").alias("at"))
    reached = from_origins.unionByName(spread(carried.join(how, ["file_id", "tid"])))
    reached = _cut(reached.groupBy("file_id", "seq", "tid").agg(F.min("at").alias("at")))
    named = taints.select("file_id", "tid", "t")
    return reached, named


class Scan:
    """The analysis of a corpus; a step runs when its result, or one that
    follows from it, is first asked for."""

    def __init__(self, fx: Facts, name_info: DataFrame, attr_names: DataFrame, call_names: DataFrame,
                 specs: DataFrame, pairs: DataFrame, file_paths: DataFrame):
        self.fx, self.name_info, self.attr_names, self.call_names = fx, name_info, attr_names, call_names
        self.pairs, self.file_paths = pairs, file_paths
        # Call x function-taint rules
        ft = specs.where((F.col("role") == "taint") & (F.col("accordance") == "function"))
        cm = call_names.join(F.broadcast(ft), call_names.func == ft.target)
        ct = taint_struct(F.col("rule_id"), "function", F.col("rule_type"), F.col("target"), None, F.col("position"),
                          F.col("keyword"), F.col("lineno"), F.col("col"), F.col("end_lineno"), F.col("end_col"))
        self._calls = cm.withColumn("t", ct)
        # Attribute reads x attribute-taint rules (position ret only)
        at_rules = specs.where((F.col("role") == "taint") & (F.col("accordance") == "attribute")
                               & (F.col("position") == "ret"))
        self._loads = attr_names.where(F.col("ctx") == "Load")
        am = self._loads.join(F.broadcast(at_rules), F.col("rname") == at_rules.target)
        self._attr_seeds = am.select("file_id", "seq", taint_struct(
            F.col("rule_id"), "attribute", F.col("rule_type"), None, F.col("target"), "ret", None,
            F.col("lineno"), F.col("col"), F.col("end_lineno"), F.col("end_col")).alias("t"), F.col("seq").alias("at"))
        # Sinks on calls
        st = specs.where((F.col("role") == "sink") & (F.col("accordance") == "function"))
        sm = call_names.join(F.broadcast(st), call_names.func == st.target)
        sm = sm.withColumn("s", F.struct(
            F.col("rule_id").alias("id"), F.lit("function").alias("accordance"), F.col("target").alias("function"),
            F.col("rule_type").alias("type"), F.col("position").cast("int").alias("position"),
            F.col("keyword").alias("keyword"), F.col("lineno").cast("int").alias("lineno"),
            F.col("col").cast("int").alias("col_offset"), F.col("end_lineno").cast("int").alias("end_lineno"),
            F.col("end_col").cast("int").alias("end_col_offset")))
        self._sinks = sm.select("file_id", "seq", "s", "n_args")

    @property
    def taint_sources(self) -> DataFrame:
        """(file_id, seq, t) marked by rules, plus behaviour type."""
        return self._calls.select("file_id", "seq", "t").unionByName(self._attr_seeds.select("file_id", "seq", "t"))

    @property
    def sinks(self) -> DataFrame:
        """(file_id, seq, s)."""
        return self._sinks.select("file_id", "seq", "s")

    @cached_property
    def _sink_args(self) -> DataFrame:
        return _cut(pick_arg(self._sinks, self.fx.args, F.col("s.position"), F.col("s.keyword")).drop("n_args"))

    @property
    def sink_args(self) -> DataFrame:
        """The argument each sink spec inspects."""
        return self._sink_args.select("file_id", "seq", "s", "arg_seq", "arg_type")

    @cached_property
    def _argt(self) -> DataFrame:
        """Argument-position taints and the argument passed (J11 picks it)."""
        argt = self._calls.where(F.col("position") != "ret")
        return checkpoint_cut(pick_arg(argt, self.fx.args, F.col("position").cast("int"), F.col("keyword")).select(
            "file_id", "seq", "t", "arg_seq", "arg_type"), bucket="file_id")

    @cached_property
    def arg_taints(self) -> DataFrame:
        """Argument-position taints and where they landed."""
        landed = self._argt.join(self.name_info.select("file_id", F.col("seq").alias("arg_seq"), F.col("name").alias("n_name")),
                                 ["file_id", "arg_seq"], "left") \
            .join(self.attr_names.select("file_id", F.col("seq").alias("arg_seq"), F.col("rname").alias("a_name")),
                  ["file_id", "arg_seq"], "left") \
            .join(self.fx.consts.select("file_id", F.col("seq").alias("arg_seq"), F.col("cstr").alias("c_val")),
                  ["file_id", "arg_seq"], "left")
        return checkpoint_cut(landed.select("file_id", "seq", "t", "arg_seq", "arg_type",
                                            F.coalesce("n_name", "a_name", "c_val").alias("target")), bucket="file_id")

    @cached_property
    def _reached(self) -> tuple[DataFrame, DataFrame]:
        return reach(self.fx, self.name_info, self.attr_names, self._loads, self._calls, self._attr_seeds, self._argt)

    @property
    def node_taints(self) -> DataFrame:
        """(file_id, seq, t, at) every read and station a taint reached, and when first."""
        reached, named = self._reached
        return reached.join(named, ["file_id", "tid"]).select(*NODE_KEY, "at")

    @cached_property
    def issues(self) -> DataFrame:
        """X18."""
        return _cut(find_issues(self._sink_args, *self._reached, self.pairs, self.file_paths))


def pick_arg(calls: DataFrame, args: DataFrame, position: Column, keyword: Column) -> DataFrame:
    """``calls`` with the argument (``arg_*``) at ``position`` if enough
    positional arguments exist, else the one named ``keyword``; no row if neither."""
    c = calls.withColumn("__p", position).withColumn("__k", keyword)
    a = args.withColumnsRenamed({"call_seq": "seq", "pos": "__pos", "keyword": "__keyword"})
    by_place = F.coalesce(F.col("n_args") > F.col("__p"), F.lit(False))
    wanted = F.when(by_place, F.col("__pos") == F.col("__p")).otherwise(F.col("__keyword") == F.col("__k"))
    return c.join(a, ["file_id", "seq"]).where(wanted & F.col("arg_seq").isNotNull()).drop("__p", "__k", "__pos", "__keyword")


def _field(st: Column, acc: Column) -> Column:
    return (F.when(acc == "id", st["id"]).when(acc == "type", st["type"]).when(acc == "function", st["function"])
             .when(acc == "attribute", st["attribute"]))


def _keys(st: Column, prefix: str, *fields: str) -> Column:
    """One row per way a detection rule can name a taint or sink: (accordance, key)."""
    return F.explode(F.array(*[F.struct(F.lit(f).alias(f"{prefix}_accordance"), st[f].alias(f"{prefix}_key")) for f in fields]))


def find_issues(sink_args: DataFrame, reached: DataFrame, named: DataFrame, pairs: DataFrame, file_paths: DataFrame) -> DataFrame:
    """J10 + X16 + F10 + F11 + A6: sink argument x its taints x detection rules."""
    sp = sink_args.select("file_id", "arg_seq", "s", _keys(F.col("s"), "s", "id", "type", "function").alias("k")).select("*", "k.*").drop("k")
    sp = sp.join(F.broadcast(pairs), ["s_accordance", "s_key"])
    # taints on the argument node, plus its own '*' taint (never materialised elsewhere)
    place = [F.coalesce(f"arg_{c}", F.lit(-1)) for c in PLACE]
    star = taint_struct("0000", "type", "*", None, None, None, None, *place).alias("t")
    asked = sink_args.select("file_id", "arg_seq", star).distinct()
    nt = reached.withColumnRenamed("seq", "arg_seq").join(asked.select("file_id", "arg_seq"), ["file_id", "arg_seq"], "left_semi")
    taints = nt.join(named, ["file_id", "tid"]).select("file_id", "arg_seq", "t").unionByName(asked)
    taints = taints.select("*", _keys(F.col("t"), "t", "id", "type", "function", "attribute").alias("k")).select("*", "k.*").drop("k")
    j = sp.join(taints, ["file_id", "arg_seq", "t_accordance", "t_key"])
    t = F.col("t")
    tfill = _field(t, t["accordance"])
    msg = F.replace(F.replace(F.col("template"), F.lit("{SINK}"), F.col("s.function")), F.lit("{TAINT}"),
                    F.coalesce(tfill, F.lit("None")))
    out = j.join(file_paths, "file_id").select(
        "file_id", F.col("rule_id").alias("id"), "name", F.col("t").alias("taint"), F.col("s").alias("sink"),
        F.greatest("t_severity", "s_severity").alias("severity"),
        F.greatest("t_confidence", "s_confidence").alias("confidence"), msg.alias("msg"), "file_path")
    return out.dropDuplicates()
