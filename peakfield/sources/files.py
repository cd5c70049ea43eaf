"""Sources and sinks: CSV landscapes, FASTA, Newick, portable bundles and XGMML."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import tempfile
import zipfile
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.layers import mean, replicates
from ..functions.sequences import symbols

VERSION = 1


def read_csv(spark: SparkSession, path: str, *, sequence: str = "sequence", numeric: tuple[str, ...] = (), categorical: tuple[str, ...] = (), replicate_prefixes: dict[str, str] | None = None, probabilities: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """(row_id, sequence, symbols, one column per layer). Every column is read as text, so that
    000 keeps its zeroes; columns of a replicate prefix become one list without missing values, and
    probabilities (layer -> column -> category) one list in the order given."""
    raw = spark.read.csv(path, header=True, inferSchema=False)
    spread = {layer: [c for c in raw.columns if c.startswith(prefix)] for layer, prefix in (replicate_prefixes or {}).items()}
    wanted = [sequence, *numeric, *categorical, *(c for cs in spread.values() for c in cs), *(c for m in (probabilities or {}).values() for c in m)]
    if lacking := [c for c in wanted if c not in raw.columns] + [k for k, cs in spread.items() if not cs]:
        raise ValueError(f"no such columns: {lacking}")
    number = lambda c: F.expr(f"try_cast(`{c}` as double)")
    columns = [F.col(sequence).alias("sequence"), symbols(F.col(sequence)).alias("symbols")]
    columns += [F.array(number(c)).alias(c) for c in numeric] + [F.col(c).cast("string").alias(c) for c in categorical]
    columns += [replicates(F.filter(F.array(*map(number, cs)), lambda x: x.isNotNull() & ~F.isnan(x))).alias(k) for k, cs in spread.items()]
    columns += [F.array(*map(number, m)).alias(k) for k, m in (probabilities or {}).items()]
    return raw.select(F.monotonically_increasing_id().alias("row_id"), *columns)


def write_csv(rows: DataFrame, path: str) -> None:
    """The sequence and one column per layer: replicates by their mean."""
    kinds = {f.name: f.dataType for f in rows.schema.fields if f.name not in ("row_id", "symbols")}
    rows.select(*(mean(F.col(c)).alias(c) if isinstance(k, T.ArrayType) else F.col(c) for c, k in kinds.items())).write.mode("error").csv(path, header=True)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, sequence, symbols), a row per record. Records are split by Spark at each header, so
    a file of any size is read in parallel."""
    parts = spark.read.option("lineSep", "\n>").text(path).where("trim(value) != ''")
    head, body = F.regexp_replace(F.substring_index("value", "\n", 1), "^>", ""), F.regexp_extract("value", r"(?s)^[^\n]*\n(.*)$", 1)
    clean = F.regexp_replace(body, r"\s", "")
    return parts.select(F.trim(F.substring_index(head, " ", 1)).alias("name"), clean.alias("sequence")).withColumn("symbols", symbols(F.col("sequence")))


def sanitize(alignment: DataFrame, *, legal: str = "ACDEFGHIKLMNPQRSTVWY", gap: str = "-", strict: bool = False) -> DataFrame:
    """Upper-case sequences in which '.' and whatever is not legal is a gap (strict: raises)."""
    up = F.upper(F.translate("sequence", ".", gap))
    if strict:
        bad = up.rlike(f"[^{legal}{gap}]")
        up = F.when(bad, F.raise_error(F.lit("residue outside the alphabet"))).otherwise(up)
    fixed = F.regexp_replace(up, f"[^{legal}{gap}]", gap)
    return alignment.select(F.translate("name", " ", "_").alias("name"), fixed.alias("sequence")).withColumn("symbols", symbols(F.col("sequence")))


def drop_gap_columns(alignment: DataFrame, gap: str = "-") -> DataFrame:
    """The alignment without any place at which a sequence has a gap."""
    gaps = alignment.select(F.posexplode("symbols").alias("p", "s")).where(F.col("s") == gap).agg(F.collect_set("p").alias("gaps"))  # bounded by the length
    kept = alignment.crossJoin(F.broadcast(gaps)).withColumn("symbols", F.filter("symbols", lambda s, i: ~F.array_contains("gaps", i)))
    return kept.drop("gaps").withColumn("sequence", F.array_join("symbols", ""))


def _digest(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(1 << 20):
            h.update(part)
    return h.hexdigest()


def save_bundle(tables: dict[str, DataFrame], path: str, *, metadata: dict | None = None, overwrite: bool = False) -> None:
    """A directory of Parquet tables and a manifest with the size and SHA-256 of every file. It is
    written beside its place and moved there at the end."""
    if os.path.exists(path) and not overwrite:
        raise FileExistsError(path)
    new = tempfile.mkdtemp(dir=os.path.dirname(os.path.abspath(path)))
    for name, df in tables.items():
        df.write.parquet(f"{new}/{name}")
    files = {}
    for root, _, names in os.walk(new):
        for n in sorted(names):
            if n.startswith((".", "_")):
                os.remove(f"{root}/{n}")
            else:
                full = f"{root}/{n}"
                files[os.path.relpath(full, new)] = {"size": os.path.getsize(full), "sha256": _digest(full)}
    with open(f"{new}/manifest.json", "w", encoding="utf-8") as f:
        json.dump({"version": VERSION, "tables": sorted(tables), "metadata": metadata or {}, "files": files}, f, indent=1, sort_keys=True)
    if os.path.exists(path):
        shutil.rmtree(path)
    os.replace(new, path)


def load_bundle(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    """The tables and metadata of a bundle whose every file is as the manifest says."""
    with open(f"{path}/manifest.json", encoding="utf-8") as f:
        manifest = json.load(f)
    if manifest.get("version") != VERSION:
        raise ValueError("a bundle of another version")
    for name, want in manifest["files"].items():
        full = os.path.normpath(f"{path}/{name}")
        if not full.startswith(os.path.normpath(path) + os.sep) or not os.path.exists(full):
            raise ValueError(f"missing file: {name}")
        if os.path.getsize(full) != want["size"] or _digest(full) != want["sha256"]:
            raise ValueError(f"changed file: {name}")
    return {t: spark.read.parquet(f"{path}/{t}") for t in manifest["tables"]}, manifest["metadata"]


def export_archive(bundle: str, path: str) -> None:
    """A zip of a bundle that is the same for the same files."""
    with zipfile.ZipFile(path, "x", zipfile.ZIP_DEFLATED) as z:
        for name in sorted(os.path.relpath(f"{r}/{n}", bundle) for r, _, ns in os.walk(bundle) for n in ns):
            with open(f"{bundle}/{name}", "rb") as f:
                z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), f.read())


def load_archive(spark: SparkSession, path: str, into: str) -> tuple[dict[str, DataFrame], dict]:
    with zipfile.ZipFile(path) as z:
        for n in z.namelist():
            if os.path.isabs(n) or ".." in n.split("/"):
                raise ValueError(f"unsafe name: {n}")
        z.extractall(into)
    return load_bundle(spark, into)


def _xgmml_type(kind: T.DataType) -> str:
    return "boolean" if isinstance(kind, T.BooleanType) else "integer" if isinstance(kind, T.IntegralType) else "real" if isinstance(kind, T.NumericType) else "string"


def xgmml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(line) of an XGMML graph's nodes and edges with typed attributes, made by Spark."""

    def attributes(df: DataFrame, skip: tuple[str, ...]) -> list:
        return [F.when(F.col(f.name).isNotNull(), F.concat(F.lit(f"<att name={quoteattr(f.name)} type=\"{_xgmml_type(f.dataType)}\" value=\""), _safe(F.col(f.name)), F.lit('"/>'))).otherwise("") for f in df.schema.fields if f.name not in skip]

    n = nodes.select(F.concat(F.lit('<node id="'), _safe(F.col("node")), F.lit('">'), *attributes(nodes, ("node",)), F.lit("</node>")).alias("line"))
    e = edges.select(F.concat(F.lit('<edge source="'), _safe(F.col("u")), F.lit('" target="'), _safe(F.col("v")), F.lit('">'), *attributes(edges, ("u", "v")), F.lit("</edge>")).alias("line"))
    return n.union(e)


def _safe(c):
    out = c.cast("string")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def write_xgmml(nodes: DataFrame, edges: DataFrame, path: str, label: str = "landscape") -> None:
    """One XGMML file, streamed row by row through the driver, which is where a local file lies."""
    with open(path, "w", encoding="utf-8") as f:
        f.write(f'<?xml version="1.0"?>\n<graph label="{escape(label)}" directed="0" xmlns="http://www.cs.rpi.edu/XGMML">\n')
        for r in xgmml_lines(nodes, edges).toLocalIterator():
            f.write(r["line"] + "\n")
        f.write("</graph>\n")
