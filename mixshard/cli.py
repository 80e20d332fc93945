"""Command line: fit a DP mixture to a text file of points.

    python -m mixshard.cli --path data.txt --dim 2 --E 1 --S 100 --shards 4 \\
        --rounds 3 --k-init 5 [--labelled] [--out DIR]

Input lines are ``x_1 .. x_dim [label]``, whitespace separated. Prints one line per
round (clusters, gamma, ARI when labelled, residual sum, seconds) and, with
``--out``, writes ``assignments`` (``point_id cluster_id`` lines), ``model`` and
``report`` under that folder.
"""

from __future__ import annotations

import argparse

from mixshard.params import DPMParams
from mixshard.plans.fit import fit
from mixshard.session import get_session, prepare_session
from mixshard.sources.points import read_text_points
from mixshard.sources.sinks import write_assignments_text, write_model_text


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="mixshard", description=__doc__.split("\n\n")[0])
    ap.add_argument("--path", required=True, help="text file or folder of point lines")
    ap.add_argument("--dim", type=int, required=True, help="number of coordinates per line")
    ap.add_argument("--E", type=float, required=True, help="variance inside a cluster")
    ap.add_argument("--S", type=float, required=True, help="variance between centres")
    ap.add_argument("--shards", type=int, default=None, help="minimum number of shards (workers)")
    ap.add_argument("--rounds", type=int, default=3, help="sweep + merge rounds (distributions)")
    ap.add_argument("--k-init", type=int, required=True, help="K-means centres to start from")
    ap.add_argument("--labelled", action="store_true", help="lines end with an integer label")
    ap.add_argument("--seed", type=int, default=0)
    ap.add_argument("--assign", choices=["argmax", "sample"], default="argmax")
    ap.add_argument("--concentration", choices=["rate", "scale"], default="rate")
    ap.add_argument("--on-error", choices=["fail", "drop"], default="fail", help="malformed lines")
    ap.add_argument("--out", default=None, help="folder for assignments, model and report")
    ap.add_argument("--master", default=None, help="Spark master for a local run, e.g. local[8]")
    a = ap.parse_args(argv)

    if a.master:
        spark = get_session(cores=a.master.removeprefix("local[").rstrip("]"))
    else:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("mixshard").getOrCreate()
        prepare_session(spark)
    pts = read_text_points(spark, a.path, a.dim, a.labelled, on_error=a.on_error)
    params = DPMParams(E=a.E, S=a.S, seed=a.seed, assign=a.assign, concentration=a.concentration)
    res = fit(pts, params, k_init=a.k_init, rounds=a.rounds, shards=a.shards)
    for r in res.report.orderBy("round").collect():
        ari = "n/a" if r.ari is None else f"{r.ari:.6f}"
        print(f"round {r.round}: clusters {r.n_clusters}, gamma {r.gamma:.4f}, ARI {ari}, "
              f"RSS {r.rss:.4f}, {r.seconds:.1f} s")
    if a.out:
        write_assignments_text(res.assignments, f"{a.out}/assignments")
        write_model_text(res.model, f"{a.out}/model")
        res.report.write.mode("overwrite").parquet(f"{a.out}/report")


if __name__ == "__main__":
    main()
