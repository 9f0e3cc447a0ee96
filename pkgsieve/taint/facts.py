"""Python source -> fact rows (the ingest step).

The only per-row Python in the scanner: each file is parsed once with the
standard-library parser inside ``mapInArrow`` (Arrow batches, one task per
partition of files) and flattened into fact rows.  Every analysis step after
this is a Spark join / aggregation over these facts keyed by ``file_id``.

Visit order mirrors a pre-order walk over ``ast.iter_fields``: ``seq`` is the
visit number (parent before child), ``ns`` the dot-joined scope (``""`` at
module level; ``class`` and ``def`` names are pushed for their children,
``async def`` and ``lambda`` are not).  The walk keeps its own stack, so a
file may nest as deep as the parser accepts.

``up`` lists the stations a taint passes on its way through the parents in the
same scope, below the module: assignments, ``with`` items and call arguments,
the only nodes whose taints are ever read.  A station holds the line numbers
of the nodes passed since the one before (the node itself at first).
"""
from __future__ import annotations

import ast

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators.common import without_gc

_PLACE = ["lineno", "col", "end_lineno", "end_col"]
_UP = T.ArrayType(T.StructType([T.StructField("seq", T.IntegerType()),
                                T.StructField("lines", T.ArrayType(T.IntegerType()))]))

FACT_SCHEMA = T.StructType([
    T.StructField("file_id", T.LongType()),
    T.StructField("kind", T.StringType()),          # node name attr call arg const assign import param with del error
    T.StructField("seq", T.IntegerType()),
    T.StructField("parent", T.IntegerType()),
    T.StructField("ntype", T.StringType()),
    T.StructField("ns", T.StringType()),
    T.StructField("lineno", T.IntegerType()),
    T.StructField("col", T.IntegerType()),
    T.StructField("end_lineno", T.IntegerType()),
    T.StructField("end_col", T.IntegerType()),
    T.StructField("end_seq", T.IntegerType()),
    T.StructField("ctx", T.StringType()),
    T.StructField("name", T.StringType()),          # Name id / attr / import alias / param / target name
    T.StructField("target", T.StringType()),        # import target
    T.StructField("ref_seq", T.IntegerType()),      # attr base / call func / arg node / assign value / target attr
    T.StructField("ref_type", T.StringType()),      # node type of ref_seq
    T.StructField("path", T.ArrayType(T.StringType())),  # attribute names from the chain base outward
    T.StructField("pos", T.IntegerType()),          # arg / param position
    T.StructField("keyword", T.StringType()),
    T.StructField("n_args", T.IntegerType()),
    T.StructField("cval", T.StringType()),          # constant: typed key "type:repr"
    T.StructField("cstr", T.StringType()),          # constant formatted like an f-string slot
    T.StructField("up", _UP),
])

# The columns that each kind of fact fills, in the order its rows are built;
# the last ones (``_LATER``) are known when the whole file has been visited.
_KINDS = {
    "node": ["seq", "parent", "ntype", "ns", *_PLACE, "ctx", "up", "end_seq"],
    "name": ["seq", "ns", "name", "ctx"],
    "attr": ["seq", "ns", "name", "ctx", "path", "ref_type", *_PLACE, "ref_seq"],
    "call": ["seq", "ns", "ref_type", "n_args", *_PLACE, "ref_seq"],
    "arg": ["seq", "pos", "keyword", "ref_type", *_PLACE, "ref_seq"],
    "const": ["seq", "ns", "cval", "cstr"],
    "assign": ["seq", "ns", "name", "keyword", "ref_type", "ref_seq", "pos"],
    "import": ["seq", "name", "target"],
    "param": ["seq", "ns", "name", "pos", "keyword"],
    "with": ["seq", "ns", "name"],
    "del": ["seq", "ns", "name"],
    "error": ["name", "target"],
}
_LATER = {"attr": 1, "call": 1, "arg": 1, "assign": 2}  # so many of the last columns hold a node until the file is done

_ARROW_SCHEMA = to_arrow_schema(FACT_SCHEMA)
ROWS_PER_BATCH = 20_000


def const_key(v) -> str:
    return f"{type(v).__name__}:{v!r}"


# fields that hold no nodes, by class; those of a name, a constant or an attribute are known
_PLAIN = {"id", "attr", "kind", "lineno", "asname", "module", "level", "type_comment", "arg", "is_async", "simple", "conversion", "rest"}
_FIELDS: dict[type, list[str]] = {}


def _children(node) -> list:
    """The child nodes in visit order."""
    kind = node.__class__
    if kind is ast.Name:
        return [node.ctx]
    if kind is ast.Constant:
        return []
    if kind is ast.Attribute:
        return [node.value, node.ctx]
    fields = _FIELDS.get(kind)
    if fields is None:
        fields = _FIELDS[kind] = [f for f in node._fields if f not in _PLAIN]
    out = []
    for field in fields:
        value = getattr(node, field, None)
        if value.__class__ is list:
            out += [x for x in value if isinstance(x, ast.AST)]
        elif isinstance(value, ast.AST):
            out.append(value)
    return out


def _place(node) -> tuple:
    return node.lineno, node.col_offset, node.end_lineno, node.end_col_offset


def _targets(t) -> list:
    """The names (strings) and attribute nodes that an assignment target binds."""
    if not isinstance(getattr(t, "ctx", None), ast.Store):
        return []
    if isinstance(t, ast.Name):
        return [t.id]
    if isinstance(t, (ast.Tuple, ast.List)):
        return [x for e in t.elts for x in _targets(e)]
    return [t] if isinstance(t, ast.Attribute) else []


def _above(up: list, line: int | None) -> list:
    """``up`` when it passes a node on ``line``."""
    if not up or line is None or line in up[0][1]:
        return up
    return [(up[0][0], [line, *up[0][1]]), *up[1:]]


class _Walker:
    """The fact rows of files, a list of tuples per kind, each led by the file's id."""

    def __init__(self):
        self.rows: dict[str, list[tuple]] = {k: [] for k in _KINDS}

    def add(self, file_id: int, content: str | bytes) -> None:
        """The rows of one more file; bytes are decoded as their coding line says."""
        try:
            tree = ast.parse(content)
        except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
            # what the parser refuses (MemoryError: nested beyond its own stack) becomes an error row
            self.rows["error"].append((file_id, type(e).__name__, str(e)))
            return
        self.fid = file_id
        self.arguments: set[int] = set()  # ids of the argument nodes of calls
        begun = {k: len(self.rows[k]) for k in _LATER}
        seqs = self.walk(tree)
        for kind, n in _LATER.items():
            rows = self.rows[kind]
            for i in range(begun[kind], len(rows)):
                rows[i] = rows[i][:-n] + tuple([None if x is None else seqs.get(id(x)) for x in rows[i][-n:]])

    def walk(self, tree: ast.Module) -> dict[int, int]:
        """Emit a file's nodes and their facts; the visit number of each node that has fields."""
        fid, nodes, enter, arguments = self.fid, self.rows["node"], self.facts, self.arguments
        seq, seqs, scopes = 0, {id(tree): 0}, [""]
        nodes.append((fid, 0, None, "Module", "", None, None, None, None, None, []))
        # children to come, the node's row, visit number, scope (None: no taint goes there), stations, whether it is one, whether a scope
        stack = [(iter(_children(tree)), len(nodes) - 1, 0, None, [], False, False)]
        while stack:
            children, row, parent, parent_ns, above, station, scope = stack[-1]
            ns = scopes[-1]
            for node in children:
                seq += 1
                kind = node.__class__
                line = getattr(node, "lineno", None)
                if parent_ns != ns:
                    up = []
                elif station:
                    up = [(parent, [] if line is None else [line]), *above]
                else:
                    up = _above(above, line)
                if not node._fields:  # contexts, operators, pass, break, continue
                    place = (None, None, None, None) if line is None else _place(node)
                    nodes.append((fid, seq, parent, kind.__name__, ns, *place, None, up, seq))
                    continue
                seqs[id(node)] = seq
                if kind is ast.Name:  # its one child, the context, follows at once
                    ctx = node.ctx.__class__.__name__
                    nodes.append((fid, seq, parent, "Name", ns, *_place(node), ctx, up, seq + 1))
                    enter(node, kind, seq, ns, ns)
                    nodes.append((fid, seq + 1, seq, ctx, ns, None, None, None, None, None,
                                  [(seq, []), *up] if id(node) in arguments else up, seq + 1))
                    seq += 1
                    continue
                if kind is ast.Constant:  # no children
                    nodes.append((fid, seq, parent, "Constant", ns, *_place(node), None, up, seq))
                    enter(node, kind, seq, ns, ns)
                    continue
                ctx = getattr(node, "ctx", None)
                nodes.append((fid, seq, parent, kind.__name__, ns, line, getattr(node, "col_offset", None), getattr(node, "end_lineno", None),
                              getattr(node, "end_col_offset", None), None if ctx is None else ctx.__class__.__name__, up))
                new = kind is ast.ClassDef or kind is ast.FunctionDef
                if new:
                    scopes.append(f"{ns}.{node.name}")
                enter(node, kind, seq, ns, scopes[-1])
                stack.append((iter(_children(node)), len(nodes) - 1, seq, ns, up,
                              kind is ast.Assign or kind is ast.withitem or id(node) in arguments, new))
                break
            else:
                stack.pop()
                nodes[row] += (seq,)
                if scope:
                    scopes.pop()
        return seqs

    def facts(self, node, kind: type, s: int, ns: str, inner: str) -> None:
        fid, rows = self.fid, self.rows
        if kind is ast.Name:
            rows["name"].append((fid, s, ns, node.id, node.ctx.__class__.__name__))
            if isinstance(node.ctx, ast.Del):
                rows["del"].append((fid, s, ns, node.id))
        elif kind is ast.Constant:
            rows["const"].append((fid, s, ns, const_key(node.value), str(node.value)))
        elif kind is ast.Attribute:
            path, base = [node.attr], node.value
            while isinstance(base, ast.Attribute):
                path.append(base.attr)
                base = base.value
            path.reverse()
            rows["attr"].append((fid, s, ns, node.attr, node.ctx.__class__.__name__, path, type(base).__name__, *_place(node), base))
        elif kind is ast.Call:
            rows["call"].append((fid, s, ns, type(node.func).__name__, len(node.args), *_place(node), node.func))
            self.arguments.update(map(id, [*node.args, *(kw.value for kw in node.keywords)]))
            for i, arg in enumerate(node.args):
                rows["arg"].append((fid, s, i, None, type(arg).__name__, *_place(arg), arg))
            for kw in node.keywords:
                if kw.arg is not None:
                    rows["arg"].append((fid, s, None, kw.arg, type(kw.value).__name__, *_place(kw.value), kw.value))
        elif kind is ast.Assign:
            value = type(node.value).__name__
            for t in node.targets:
                for x in _targets(t):
                    name, attr = (x, None) if isinstance(x, str) else (None, x)
                    rows["assign"].append((fid, s, ns, name, "name" if attr is None else "attr", value, node.value, attr))
        elif kind is ast.Import or (kind is ast.ImportFrom and node.module is None):
            for al in node.names:
                if al.asname is not None:
                    rows["import"].append((fid, s, al.asname, al.name))
                rows["import"].append((fid, s, None, al.name))
        elif kind is ast.ImportFrom:
            for al in node.names:
                member = node.module + "." + al.name
                rows["import"].append((fid, s, al.asname or al.name, member))
                rows["import"].append((fid, s, None, member))
        elif kind is ast.FunctionDef:
            a = node.args
            for pos, arg in enumerate([*a.posonlyargs, *a.args]):
                rows["param"].append((fid, s, inner, arg.arg, pos, arg.arg if pos >= len(a.posonlyargs) else None))
            for arg in a.kwonlyargs:
                rows["param"].append((fid, s, inner, arg.arg, None, arg.arg))
        elif kind is ast.withitem:
            if isinstance(node.optional_vars, ast.Name) and isinstance(node.optional_vars.ctx, ast.Store):
                rows["with"].append((fid, s, ns, node.optional_vars.id))

    def batches(self):
        """The rows so far as record batches of bounded size, kind by kind."""
        for kind, columns in _KINDS.items():
            rows, self.rows[kind] = self.rows[kind], []
            for at in range(0, len(rows), ROWS_PER_BATCH):
                part = rows[at:at + ROWS_PER_BATCH]
                given = dict(zip(["file_id", *columns], zip(*part)), kind=[kind] * len(part))
                yield pa.RecordBatch.from_arrays([
                    pa.nulls(len(part), f.type) if f.name not in given else _ups(given["up"], f.type) if f.name == "up" else pa.array(given[f.name], f.type)
                    for f in _ARROW_SCHEMA], schema=_ARROW_SCHEMA)


def _ups(ups: tuple, kind: pa.DataType) -> pa.Array:
    ends, seqs, line_ends, lines = [0], [], [0], []
    for up in ups:
        for seq, on in up:
            seqs.append(seq)
            lines += on
            line_ends.append(len(lines))
        ends.append(len(seqs))
    held = kind.value_type.field("lines").type
    passed = pa.ListArray.from_arrays(pa.array(line_ends, pa.int32()), pa.array(lines, pa.int32()), type=held)
    stations = pa.StructArray.from_arrays([pa.array(seqs, pa.int32()), passed], fields=[kind.value_type.field(i) for i in range(2)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), stations, type=kind)


@without_gc
def _extract_batches(batches):
    """Arrow record batches of files in, bounded record batches of facts out:
    small files share a batch, a large one fills several."""
    w = _Walker()
    for b in batches:
        for fid, content in zip(b.column("file_id"), b.column("content")):
            w.add(int(fid.as_py()), content.as_py() if content.is_valid else "")
            if sum(map(len, w.rows.values())) >= ROWS_PER_BATCH:
                yield from w.batches()
    yield from w.batches()


def extract_facts(corpus: DataFrame) -> DataFrame:
    """``corpus(file_id, content)`` -> fact rows (see ``FACT_SCHEMA``)."""
    return corpus.select("file_id", "content").mapInArrow(_extract_batches, FACT_SCHEMA)
