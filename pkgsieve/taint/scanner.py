"""Scanner pipeline: corpus -> facts -> resolution -> reach -> issues -> metrics.

``code_corpus(file_id, package, path, content)`` is any table of Python
sources (from archives via :mod:`pkgsieve.sources.archives`, or derived).
"""
from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import RANK_HIGH, RANK_LOW, RANK_MEDIUM
from ..operators.common import buckets, checkpoint_cut
from ..operators.files import effective_lines
from ..session import ship_code
from ..sources.rules import RULES_DIR, rule_tables
from .engine import Facts, names_read, resolve, split_facts
from .facts import extract_facts
from .reach import Scan, brings_taint

# Fixed Python templates (our own texts).  The derived corpus gives each
# document the template ``doc_id % len(TEMPLATES)`` followed by the document's
# whole text as comment lines, so parsing work grows with it.
CHAIN = 200  # copies in the two chain templates
TEMPLATES = [
    'import os\nprint(os.getcwd())',
    'exec("x")',
    'import base64\na = base64.b64decode("eA==")\nexec(a)',
    'import requests\nr = requests.get("u")\nb = r.text\neval(b)',
    'from os import system as s\nt = s\nt(command="x")',
    'm = "os"\n__import__(m).system("x")',
    'import base64\na = base64.b64decode("eA==")\na = "x"\nexec(a)',
    'import os\nfrom urllib import request\nf = "p.sh"\nrequest.urlretrieve("u", f)\nos.system(f)',
    'import base64, requests\nd = base64.b64encode(b"k")\nrequests.post("u", data=d)',
    'import base64\ndef g(c, *, k="z"):\n    d = base64.b64decode(c)\n    eval(d)\n    eval(k)\ng("x")',
    'import os\nx = os.environ\nexec(x)',
    'import base64\nwith base64.b64decode("q") as h:\n    exec(h)',
    'import base64, os\nos.k = base64.b64decode("q")\nexec(os.k)',
    'from urllib import request\nrequest.urlretrieve("u", "p.sh")\nimport os\nos.system("p.sh")',
    'import importlib\nm = "os"\nimportlib.import_module(m).system("x")\nimportlib.import_module(".path", "os").exists("x")',
    'from urllib import request\nimport os\nf = "p"\nrequest.urlretrieve("u", f); os.system(f + "x")\nos.system(f + "x")',
    'import base64, os\nbase64.b64decode(os.getcwd())\nos.getcwd()',
    'import base64\na = base64.b64decode("q")\ndef f():\n    del a\nexec(a)',
    'import base64\nv0 = base64.b64decode("q")\n' + "".join(f"v{i} = v{i - 1}\n" for i in range(1, CHAIN + 1)) + f"exec(v{CHAIN})",
    'from os import system\ne0 = system\n' + "".join(f"e{i} = e{i - 1}\n" for i in range(1, CHAIN + 1)) + f'e{CHAIN}("x")',
]


def code_corpus(documents: DataFrame) -> DataFrame:
    """One Python file per document: its template + the whole
    document text as ``#`` comment lines (null bytes dropped)."""
    tmpl = F.element_at(F.array(*[F.lit(t) for t in TEMPLATES]), (F.col("doc_id") % len(TEMPLATES) + 1).cast("int"))
    body = F.regexp_replace(F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), "\u0000", ""),
                            r"\r\n|\r|\n", "\n# ")
    return documents.select(
        F.col("doc_id").alias("file_id"),
        F.concat(F.lit("pkg"), (F.col("doc_id") % 50).cast("string")).alias("package"),
        F.concat(F.lit("/pkg"), (F.col("doc_id") % 50).cast("string"), F.lit("/mod"),
                 F.col("doc_id").cast("string"), F.lit(".py")).alias("path"),
        F.concat(tmpl, F.lit("\n# "), body).alias("content"),
    )


@dataclass
class ScanResult:
    """The scan of a corpus; a step runs when its result, or one that follows
    from it, is first asked for."""
    facts: Facts
    files: DataFrame
    specs: DataFrame
    pairs: DataFrame

    @cached_property
    def name_info(self) -> DataFrame:
        return names_read(self.facts)

    @cached_property
    def _resolved(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return resolve(self.facts, self.name_info)

    @property
    def records(self) -> DataFrame:
        return self._resolved[0]

    @property
    def attr_names(self) -> DataFrame:
        return self._resolved[1]

    @property
    def call_names(self) -> DataFrame:
        return self._resolved[2]

    @cached_property
    def scan(self) -> Scan:
        return Scan(self.facts, self.name_info, self.attr_names, self.call_names, self.specs, self.pairs,
                    self.files.select("file_id", "file_path"))


def scan_corpus(corpus: DataFrame, rules_path: str | None = None, rules: dict[str, dict] | None = None) -> ScanResult:
    """Run the whole taint analysis over a corpus, with the rules given, else
    those at ``rules_path``, else the library's own.

    The facts are extracted once and written in a folder per kind; every later
    step reads the kinds it needs and joins on ``file_id`` (plus node ids).
    All tables of a scan are dealt into the same buckets of files.
    """
    spark = corpus.sparkSession
    ship_code(spark)
    # parse in parallel whatever the layout of the corpus (few large files arrive in few partitions)
    facts = extract_facts(corpus.repartition(buckets(spark), "file_id")).withColumn("up", F.when(brings_taint(), F.col("up")))
    facts = checkpoint_cut(facts, by="kind", bucket="file_id", dealt=True)
    # merge joins here too: small on disk, the files' names may be more than the driver can broadcast
    files = corpus.select("file_id", "package", F.col("path").alias("file_path"), "content").hint("merge")
    return ScanResult(split_facts(facts), files, *rule_tables(spark, rules_path or RULES_DIR, rules))


def file_metrics(res: ScanResult) -> DataFrame:
    """A2 + A5: per scanned file: files, effective lines, issue count and the
    severity histogram.  Files that do not parse are quarantined (D7)."""
    sev = F.col("severity")
    per = res.scan.issues.groupBy("file_id").agg(
        F.count("*").alias("cnt"),
        F.count(F.when(sev >= RANK_HIGH, 1)).alias("high"),
        F.count(F.when((sev >= RANK_MEDIUM) & (sev < RANK_HIGH), 1)).alias("medium"),
        F.count(F.when((sev >= RANK_LOW) & (sev < RANK_MEDIUM), 1)).alias("low"))
    # lines are counted where the texts are read: the joins take no text along
    m = res.files.select("file_id", "package", "file_path", F.lit(1).cast("long").alias("files"),
                         effective_lines(F.col("content").cast("string")).alias("lines"))
    m = m.join(res.facts.errors.select("file_id"), "file_id", "left_anti").join(per, "file_id", "left")
    return m.fillna(0, ["cnt", "high", "medium", "low"])


def package_metrics(metrics: DataFrame) -> DataFrame:
    """A3: per-package rollup plus the overall total (``package`` null)."""
    return metrics.rollup("package").agg(*[F.sum(c).cast("long").alias(c)
                                          for c in ("files", "lines", "cnt", "low", "medium", "high")])


def behaviour_order(res: ScanResult) -> DataFrame:
    """First-occurrence order (0-based) of sensitive behaviour types per
    file, from function-taint rule matches only."""
    src = res.scan.taint_sources.where(F.col("t.accordance") == "function").where(F.col("t.type") != "")
    first = src.groupBy("file_id", F.col("t.type").alias("behaviour")).agg(F.min("seq").alias("first_seq"))
    from pyspark.sql import Window

    w = Window.partitionBy("file_id").orderBy("first_seq", "behaviour")
    return first.select("file_id", "behaviour", (F.row_number().over(w) - 1).alias("ord"))
