"""Command line: FASTA in, landscape bundle out.

    python -m peakfield knn sequences.fasta out --k 5
    python -m peakfield diffusion sequences.fasta out --k 5 --t 2
    python -m peakfield phylo alignment.fasta out
"""

from __future__ import annotations

import argparse

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.sequences import AMINO_ACIDS, composition
from .operators.diffusion import kernel, rbf_edges
from .operators.edges import knn_edges
from .operators.graph import cut
from .operators.phylo import rate_matrix
from .operators.tree_graphs import tree_landscape
from .plans.landscape import Landscape
from .sources.files import drop_gap_columns, read_fasta, sanitize


def main(argv: list[str] | None = None) -> None:
    top = argparse.ArgumentParser(prog="peakfield")
    kinds = top.add_subparsers(dest="kind", required=True)
    for name in ("knn", "diffusion", "phylo"):
        p = kinds.add_parser(name)
        p.add_argument("fasta")
        p.add_argument("output")
        p.add_argument("--overwrite", action="store_true")
        p.add_argument("--strict", action="store_true", help="fail on residues outside the alphabet")
        if name != "phylo":
            p.add_argument("--k", type=int, default=5)
        if name == "diffusion":
            p.add_argument("--t", type=float, default=0, help="steps of the walk; 0: its limit")
            p.add_argument("--threshold", type=float, default=0.0)
    args = top.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    rows = cut(sanitize(read_fasta(spark, args.fasta), strict=args.strict))
    if args.kind == "phylo":
        uniform = np.full(len(AMINO_ACIDS), 1 / len(AMINO_ACIDS))
        q = rate_matrix(np.ones((len(AMINO_ACIDS),) * 2), uniform)
        nodes, edges = tree_landscape(drop_gap_columns(rows), q, "".join(AMINO_ACIDS))
    else:
        nodes = rows.select(F.col("name").alias("node"), "symbols")
        vectors = cut(nodes.select("node", composition(F.col("symbols")).alias("vector")))
        if args.kind == "knn":
            edges = knn_edges(vectors, args.k)
        else:
            edges = kernel(vectors, cut(rbf_edges(vectors, args.k)), args.t, threshold=args.threshold)
    Landscape(nodes, edges).save(args.output, overwrite=args.overwrite)


if __name__ == "__main__":
    main()
