"""The command line, and kernels of scored alignments."""

import numpy as np
import pytest

from peakfield.__main__ import main
from peakfield.operators import diffusion as D
from peakfield.plans.landscape import Landscape


def test_commands(spark, tmp_path):
    rng = np.random.default_rng(0)
    fasta = tmp_path / "x.fasta"
    fasta.write_text("".join(f">s{i}\n{''.join(rng.choice(list('ACDEFGHIKL'), 30))}\n" for i in range(12)))
    main(["knn", str(fasta), str(tmp_path / "knn"), "--k", "3"])
    land = Landscape.load(spark, str(tmp_path / "knn"))
    assert land.sequences.count() == 12 and land.edges.count() >= 18
    main(["diffusion", str(fasta), str(tmp_path / "diffusion"), "--k", "3", "--t", "2"])
    assert Landscape.load(spark, str(tmp_path / "diffusion")).edges.count() > 18
    main(["phylo", str(fasta), str(tmp_path / "phylo")])
    assert Landscape.load(spark, str(tmp_path / "phylo")).edges.count() == 21
    with pytest.raises(FileExistsError):
        main(["phylo", str(fasta), str(tmp_path / "phylo")])


def test_scored_kernel(spark):
    hard = np.eye(3)
    rows = spark.createDataFrame([(i, [hard[c].tolist() for c in s]) for i, s in enumerate([(0, 0), (0, 1), (1, 1)])], "node long, posterior array<array<double>>")
    vectors = spark.createDataFrame([(0, [0.0]), (1, [1.0]), (2, [2.0])], "node long, vector array<double>")
    pairs = spark.createDataFrame([(0, 1), (0, 2)], "u long, v long")
    scored = D.aligned_scores(pairs, rows, np.eye(2))
    assert {(r.u, r.v): r.score for r in scored.collect()} == {(0, 1): 0.5, (0, 2): 0.0}
    assert {(r.u, r.v): round(r.weight, 6) for r in D.score_affinity(scored, 0.5).collect()} == {(0, 1): 1.0, (0, 2): round(np.exp(-1), 6)}
    assert D.evolutionary_kernel(vectors, rows, np.eye(2), k=1, tau=1.0, t=1).count() >= 2
    with pytest.raises(ValueError, match="tau"):
        D.score_affinity(scored, 0)
