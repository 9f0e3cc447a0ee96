"""Taint-to-sink data flow as joins over fact tables.

Every step is keyed by ``file_id`` so work spreads over files; scoped name
lookups are one ordered sweep per name (``sweep``).  A record's value or dotted name comes from the one record its right
side reads, which stands before it in the file, so chains of copies of any
length are followed in one ordered pass over a file's records.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.common import buckets, checkpoint_cut, joined_in_place, without_gc
from . import sweep as W

IMPORT_FUNCS = ("__import__", "importlib.__import__")
IMPORT_MODULE = "importlib.import_module"

TAINT_FIELDS = ["id", "accordance", "type", "function", "attribute", "position", "keyword",
                "lineno", "col_offset", "end_lineno", "end_col_offset"]


def taint_struct(id_, acc, typ, function, attribute, position, keyword, lineno, col, end_lineno, end_col) -> Column:
    vals = [id_, acc, typ, function, attribute, position, keyword, lineno, col, end_lineno, end_col]
    types = ["string"] * 7 + ["int"] * 4
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).cast(t).alias(n)
                      for v, t, n in zip(vals, types, TAINT_FIELDS)])


PLACE = ["lineno", "col", "end_lineno", "end_col"]


@dataclass
class Facts:
    nodes: DataFrame
    names: DataFrame
    attrs: DataFrame
    calls: DataFrame
    args: DataFrame
    consts: DataFrame
    assigns: DataFrame
    imports: DataFrame
    params: DataFrame
    withs: DataFrame
    dels: DataFrame
    errors: DataFrame


def split_facts(facts: DataFrame) -> Facts:
    k = F.col("kind")
    f = facts
    return Facts(
        nodes=f.where(k == "node").select("file_id", "seq", "parent", "ntype", "ns", "lineno", "col", "end_lineno",
                                          "end_col", "end_seq", "ctx", "up"),
        names=f.where(k == "name").select("file_id", "seq", "ns", "name", "ctx"),
        attrs=f.where(k == "attr").select("file_id", "seq", "ns", "ctx", "path", *PLACE,
                                          F.col("ref_seq").alias("base_seq"), F.col("ref_type").alias("base_type")),
        calls=f.where(k == "call").select("file_id", "seq", "ns", *PLACE, F.col("ref_seq").alias("func_seq"),
                                          F.col("ref_type").alias("func_type"), "n_args"),
        args=f.where(k == "arg").select("file_id", F.col("seq").alias("call_seq"), "pos", "keyword",
                                        F.col("ref_seq").alias("arg_seq"), F.col("ref_type").alias("arg_type"),
                                        *[F.col(c).alias(f"arg_{c}") for c in PLACE]),
        consts=f.where(k == "const").select("file_id", "seq", "cval", "cstr"),
        assigns=f.where(k == "assign").select("file_id", "seq", "ns", F.col("name").alias("tname"),
                                              F.col("keyword").alias("tkind"), F.col("pos").alias("tattr_seq"),
                                              F.col("ref_seq").alias("value_seq"),
                                              F.col("ref_type").alias("value_type")),
        imports=f.where(k == "import").select("file_id", "seq", F.col("name").alias("alias"), "target"),
        params=f.where(k == "param").select("file_id", "seq", "ns", "name", "pos", "keyword"),
        withs=f.where(k == "with").select("file_id", "seq", "ns", "name"),
        dels=f.where(k == "del").select("file_id", "seq", "ns", "name"),
        errors=f.where(k == "error").select("file_id", F.col("name").alias("error"), F.col("target").alias("detail")),
    )


def name_events(fx: Facts) -> DataFrame:
    """What the sweep over plain names sees: assignment targets, parameters,
    ``with`` targets, ``del``s, import aliases, imported modules, reads."""
    parts = [
        W.events(fx.assigns.where(F.col("tkind") == "name"), W.DEF, "seq", "tname", "ns"),
        W.events(fx.params, W.DEF, "seq", "name", "ns"), W.events(fx.withs, W.DEF, "seq", "name", "ns"),
        W.events(fx.dels, W.DEL, "seq", "name", "ns"),
        W.events(fx.imports.where(F.col("alias").isNotNull()), W.ALIAS, "seq", "alias", target="target"),
        W.events(fx.imports.where(F.col("alias").isNull()), W.MODULE, "seq", "target"),
        W.events(fx.names.where(F.col("ctx") == "Load"), W.READ, "seq", "name", "ns")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --------------------------------------------------------------------------
# callee resolution fix-point
# --------------------------------------------------------------------------

def names_read(fx: Facts) -> DataFrame:
    """Per Load Name node its visible record and import state."""
    return checkpoint_cut(W.sweep(name_events(fx)), bucket="file_id")


def resolve(fx: Facts, name_info: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Returns ``(records, attr_names, call_names)``.

    ``records``: per definition its constant ``value`` / dotted ``variable``;
    ``attr_names``: resolved dotted name per Attribute node;
    ``call_names``: resolved callee per Call node (``func``).
    """
    consts = fx.consts.select("file_id", F.col("seq").alias("node_seq"), F.col("cstr").alias("const_value"))
    recs0 = (fx.assigns.where(F.col("tkind") == "name")
             .select("file_id", F.col("ns").alias("rec_ns"), F.col("tname").alias("name"), F.col("seq").alias("rec_seq"),
                     "value_seq", "value_type").dropDuplicates(["file_id", "rec_ns", "name", "rec_seq"]))
    dyn = None  # call seq -> dynamically imported module name
    recs = _follow(_links(recs0, consts, name_info, fx, dyn))
    attrs, calls, args = _read_by(fx, consts, _names_with(name_info, recs))
    while True:
        # attribute chains
        a = _with_dynamic(attrs, dyn, "base_seq")
        tail = F.array_join("path", ".")
        rn = (F.when(F.col("base_type") == "Name", F.concat_ws(".", "basen", tail))
               .when((F.col("base_type") == "Call") & F.col("dyn").isNotNull(), F.concat_ws(".", "dyn", tail))
               .otherwise(tail))
        attr_names = a.select("file_id", "seq", "ns", "ctx", *PLACE, rn.alias("rname"))
        # callees
        c = calls.join(attr_names.select("file_id", F.col("seq").alias("func_seq"), F.col("rname").alias("aname")),
                   ["file_id", "func_seq"], "left")
        func = (F.when(F.col("func_type") == "Name", F.col("bare"))
                 .when(F.col("func_type") == "Attribute", F.col("aname")).otherwise(F.lit("")))
        call_names = c.select("file_id", "seq", "ns", *PLACE, "n_args", func.alias("func"))
        # dynamic imports, by the values of their arguments
        imp_calls = call_names.where(F.col("func").isin(*IMPORT_FUNCS, IMPORT_MODULE))
        pv = imp_calls.join(args, ["file_id", "seq"], "left")
        pv = pv.groupBy("file_id", "seq", "func", "n_args").agg(
            F.max(F.when(F.col("pos") == 0, F.struct(F.lit(1).alias("h"), F.col("aval").alias("v")))).alias("p0"),
            F.max(F.when(F.col("pos") == 1, F.struct(F.lit(1).alias("h"), F.col("aval").alias("v")))).alias("p1"),
            F.max(F.when(F.col("keyword") == "name", F.col("aval"))).alias("kname"),
            F.max(F.when(F.col("keyword") == "package", F.col("aval"))).alias("kpkg"))
        pname = F.when(F.col("n_args") > 0, F.col("p0.v")).otherwise(F.col("kname"))
        ppkg = F.when(F.col("n_args") > 1, F.col("p1.v")).otherwise(F.col("kpkg"))
        dyn_new = pv.select("file_id", "seq", F.when(F.col("func").isin(*IMPORT_FUNCS), pname)
                            .otherwise(F.when(ppkg.isNotNull(), F.concat(ppkg, pname)).otherwise(pname)).alias("dyn"))
        dyn_new = checkpoint_cut(dyn_new.where(F.col("dyn").isNotNull()), bucket="file_id")
        # an import through an imported function shows one level per round
        if _same(dyn, dyn_new):
            break
        dyn = dyn_new
        named = fx.attrs.join(dyn.select("file_id", F.col("seq").alias("base_seq")), ["file_id", "base_seq"], "left_semi")
        with joined_in_place(fx.nodes.sparkSession):
            copied = fx.assigns.where((F.col("tkind") == "name") & (F.col("value_type") == "Attribute"))
            again = copied.join(named.select("file_id", F.col("seq").alias("value_seq")), ["file_id", "value_seq"], "left_semi")
            again = not again.isEmpty()
        if again:
            recs = _follow(_links(recs0, consts, name_info, fx, dyn))
            attrs, calls, args = _read_by(fx, consts, _names_with(name_info, recs))
    # read by every later step: write them once
    return recs, checkpoint_cut(attr_names, bucket="file_id"), checkpoint_cut(call_names, bucket="file_id")


def _names_with(name_info: DataFrame, recs: DataFrame) -> DataFrame:
    """The names read with the constant ``value`` of the record they see, what
    they mean alone (``bare``) and at the base of a dotted name (``basen``)."""
    ni = name_info.join(
        recs.select("file_id", F.col("name").alias("rname"), "rec_ns", "rec_seq", "value", "variable"),
        (name_info.file_id == recs.file_id) & (name_info.rec_ns == recs.rec_ns)
        & (name_info.name == F.col("rname")) & (name_info.rec_seq == recs.rec_seq), "left"
    ).select(name_info["*"], "value", "variable")
    return checkpoint_cut(ni.select(  # read by several steps
        "file_id", "seq", "name", "value",
        F.when(F.col("rec_seq").isNotNull(), F.coalesce("variable", "name"))
         .otherwise(F.coalesce("alias_target", "name")).alias("bare"),
        F.coalesce("variable", "alias_target", "name").alias("basen")), bucket="file_id")


def _read_by(fx: Facts, consts: DataFrame, ni: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Attributes, calls and arguments with what the name (or, for an argument,
    the constant) that they read means; written once, since every round reads them."""
    attrs = fx.attrs.join(ni.select("file_id", F.col("seq").alias("base_seq"), "basen"), ["file_id", "base_seq"], "left")
    calls = fx.calls.join(ni.select("file_id", F.col("seq").alias("func_seq"), "bare"), ["file_id", "func_seq"], "left")
    args = fx.args.withColumnRenamed("call_seq", "seq").join(consts.withColumnRenamed("node_seq", "arg_seq"), ["file_id", "arg_seq"], "left").join(
        ni.select("file_id", F.col("seq").alias("arg_seq"), F.col("value").alias("name_value")), ["file_id", "arg_seq"], "left")
    args = args.select("file_id", "seq", "pos", "keyword",
                       F.when(F.col("arg_type") == "Constant", F.col("const_value"))
                        .when(F.col("arg_type") == "Name", F.col("name_value")).alias("aval"))
    return checkpoint_cut(attrs, bucket="file_id"), checkpoint_cut(calls, bucket="file_id"), checkpoint_cut(args, bucket="file_id")


def _same(old: DataFrame | None, new: DataFrame) -> bool:
    if old is None:
        return new.isEmpty()
    return new.exceptAll(old).isEmpty() and old.exceptAll(new).isEmpty()


def _with_dynamic(attrs: DataFrame, dyn: DataFrame | None, base: str) -> DataFrame:
    if dyn is None:
        return attrs.withColumn("dyn", F.lit(None).cast("string"))
    return attrs.join(dyn.select("file_id", F.col("seq").alias(base), "dyn"), ["file_id", base], "left")


REC = ["file_id", "rec_ns", "name", "rec_seq"]


def _links(recs0: DataFrame, consts: DataFrame, name_info: DataFrame, fx: Facts, dyn: DataFrame | None) -> DataFrame:
    """Each record with what its right side says: a constant ``value``, a
    dotted ``variable``, or the record it reads (``p_*``) -- copied as it is,
    or, for an attribute, named by it (or else by ``fallback``) plus ``tail``."""
    src = name_info.select("file_id", F.col("seq").alias("base_seq"), F.col("rec_ns").alias("p_ns"),
                           F.when(F.col("rec_seq").isNotNull(), F.col("name")).alias("p_name"), F.col("rec_seq").alias("p_seq"),
                           "alias_target", "in_imports", F.col("name").alias("s_name"))
    attrs = _with_dynamic(fx.attrs.select("file_id", F.col("seq").alias("value_seq"), "base_seq", "base_type",
                                          F.array_join("path", ".").alias("dotted")), dyn, "base_seq")
    r = recs0.join(consts.withColumnRenamed("node_seq", "value_seq"), ["file_id", "value_seq"], "left") \
             .join(attrs.withColumnRenamed("base_seq", "attr_base"), ["file_id", "value_seq"], "left")
    vt, is_attr = F.col("value_type"), F.col("value_type") == "Attribute"
    r = r.withColumn("base_seq", F.when(vt == "Name", F.col("value_seq")).when(
        is_attr & (F.col("base_type") == "Name"), F.col("attr_base"))).join(src, ["file_id", "base_seq"], "left")
    # a name that this same statement binds reads as not yet known
    own = (F.col("p_seq") == F.col("rec_seq"))
    linked = F.col("p_seq").isNotNull() & ~own
    named = F.coalesce("alias_target", "s_name")
    variable = (F.when(is_attr & (F.col("base_type") == "Name"), F.concat_ws(".", named, "dotted"))
                 .when(is_attr & (F.col("base_type") == "Call") & F.col("dyn").isNotNull(), F.concat_ws(".", "dyn", "dotted"))
                 .when(is_attr, F.col("dotted"))
                 .when((vt == "Name") & F.col("p_seq").isNull(),
                       F.coalesce("alias_target", F.when(F.col("in_imports"), F.col("s_name")))))
    return r.select(*REC, "value_seq", "value_type",
                    F.when(vt == "Constant", F.col("const_value")).alias("value"),
                    F.when(~linked, variable).alias("variable"),
                    *[F.when(linked, F.col(c)).alias(c) for c in ("p_ns", "p_name", "p_seq")],
                    F.when(is_attr & linked, F.col("dotted")).alias("tail"),
                    F.when(is_attr & linked, named).alias("fallback"))


def _follow(links: DataFrame) -> DataFrame:
    """The records with ``value`` and ``variable`` at the end of their chains.
    A record reads records of statements before its own, so one pass over a
    file's records in visit order meets every record after the one it points
    at.  A task holds the results of one file's records."""
    rows = links.repartition(buckets(links.sparkSession), "file_id").sortWithinPartitions("file_id", "rec_seq")
    return checkpoint_cut(rows.mapInArrow(_ends, RECORDS), bucket="file_id", dealt=True)


RECORDS = "file_id long, rec_ns string, name string, rec_seq int, value_seq int, value_type string, value string, variable string"


@without_gc
def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    file, found = None, {}
    for batch in batches:
        values, variables = [], []
        col = [batch.column(c).to_pylist() for c in (*REC, "value", "variable", "p_ns", "p_name", "p_seq", "tail", "fallback")]
        for f, ns, name, seq, value, variable, p_ns, p_name, p_seq, tail, fallback in zip(*col):
            if f != file:
                file, found = f, {}
            if p_seq is not None:
                value, variable = found.get((p_ns, p_name, p_seq), (None, None))
                if tail is not None:
                    base = fallback if variable is None else variable
                    value, variable = None, tail if base is None else f"{base}.{tail}"
            if value is not None or variable is not None:
                found[ns, name, seq] = value, variable
            values.append(value)
            variables.append(variable)
        kept = [batch.column(c) for c in (*REC, "value_seq", "value_type")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(values, pa.string()), pa.array(variables, pa.string())],
                                         names=[*REC, "value_seq", "value_type", "value", "variable"])
