"""python -m gridweave MATRIX.mtx ...: orders each matrix on both sides with windows of one column and prints the time.

python -m gridweave features MATRIX.mtx [--out FOLDER] [--seed N] [--with-betweenness] [--max-nodes-exact N]: its fingerprint.
python -m gridweave features --merge FOLDER --out FOLDER: all fingerprints of a folder as one table.
"""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession

from . import api
from .operators import features


def order(spark: SparkSession, paths: list[str]) -> int:
    failed = 0
    for path in paths:
        began = time.time()
        try:
            rows, _ = api.two_sided(spark, path, W=1, max_iters=64)
            print(f"{path}: {rows.count()} rows in {time.time() - began:.2f} s")
        except (OSError, ValueError) as e:
            failed += 1
            print(f"{path}: {e}", file=sys.stderr)
    return int(failed > 0)


def fingerprints(spark: SparkSession, words: list[str]) -> int:
    p = argparse.ArgumentParser(prog="gridweave features")
    p.add_argument("matrix", nargs="?")
    p.add_argument("--out")
    p.add_argument("--merge")
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--with-betweenness", action="store_true")
    p.add_argument("--max-nodes-exact", type=int, default=50_000)
    a = p.parse_args(words)
    if a.merge:
        if not a.out:
            p.error("--merge needs --out")
        print(f"{features.merge_fingerprints(spark, a.merge, a.out).count()} fingerprints")
        return 0
    if not a.matrix:
        p.error("a matrix or --merge FOLDER --out FOLDER")
    row = features.extract(spark, a.matrix, a.seed, a.with_betweenness, a.max_nodes_exact)
    if a.out:
        features.write_fingerprint(row, a.out)
    else:
        r = row.first()
        print(",".join(features.COLUMNS))
        print(",".join("" if v is None else str(v) for v in r))
    return 0


def main(words: list[str]) -> int:
    spark = SparkSession.builder.appName("gridweave").getOrCreate()
    return fingerprints(spark, words[1:]) if words[:1] == ["features"] else order(spark, words)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
