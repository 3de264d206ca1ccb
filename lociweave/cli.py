"""Command line: python -m lociweave.cli COMMAND ..."""

from __future__ import annotations

import argparse
import logging
import sys
import time

from pyspark.sql import functions as F

from .operators import dynamic_cut, stats, windows
from .operators.shared import materialised
from .plans import commands as C
from .session import get_session
from .sources.matrix import matrix_lines, write_lines
from .sources.vcf import kept_lines

VERSION = "1.0.0"
log = logging.getLogger("lociweave")


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lociweave", description="Population-genomics analytics on Spark.")
    top.add_argument("--version", action="version", version=VERSION)
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *, threads: bool = True, help_letter: bool = True) -> argparse.ArgumentParser:
        p = sub.add_parser(name, add_help=help_letter)
        if not help_letter:
            p.add_argument("--help", action="help")
        p.add_argument("paths", nargs="*")
        p.add_argument("-i", "--input", nargs="+", default=[])
        p.add_argument("-o", "--output")
        p.add_argument("-v", "--verbose", action="store_true")
        if threads:
            p.add_argument("-t", "--threads", "--numberOfThreads", type=int, default=1, help="local threads; a cluster's master decides by itself")
        return p

    for name in ("VCF2DIST", "VCF2TREE"):
        p = command(name)
        p.add_argument("-e", "--embeddings")
        p.add_argument("--embeddings-format")
        p.add_argument("--variant-key", default="CHROM_POS_REF_ALT")
        p.add_argument("--window-bp", type=int)
        p.add_argument("--window-variants", type=int)
        p.add_argument("--step", type=int)
        p.add_argument("--min-variants", type=int, default=1)
        if name == "VCF2DIST":
            p.add_argument("--long", action="store_true")
        else:
            p.add_argument("-b", "--bootstrap", type=int, default=0)
        p.add_argument("--seed", type=int, default=1)
    command("VCF2ISTATS", threads=False)
    for name in ("FASTA2DIST", "FASTA2TREE"):
        p = command(name)
        p.add_argument("-q", "--isFastq", action="store_true")
        p.add_argument("-k", "--kmerSize", type=int, default=4)
        p.add_argument("-n", "--normalize", action="store_true")
    for name in ("DIST2TREE", "DIST2Clusters", "DIST2Hist"):
        p = command(name, threads=False)
        if name == "DIST2Clusters":
            p.add_argument("-c", "--cutHeight", type=float)
            p.add_argument("-m", "--minClusterSize", type=int, default=1)
            p.add_argument("-e", "--extra", action="store_true", help="branches that meet below the cut height stay together")
            p.add_argument("--method", choices=("dynamic", "height"), default="dynamic")
        if name == "DIST2Hist":
            p.add_argument("-s", "--bins", type=lambda x: int(x.split(",")[0]), default=100, help="number of bins; sizes of a picture may follow")
    for name, height in (("VCFNonrelated", 0.5), ("VCFRemoveClones", 0.075)):
        p = command(name, help_letter=False)
        p.add_argument("-c", "--cutHeight", type=float, default=height)
        p.add_argument("-g", "--ignoreHets", action="store_true", help="heterozygous genotypes count as missing")
        p.add_argument("-h", "--onlyHets", action="store_true", help="all but heterozygous genotypes count as missing in the distances")
        p.add_argument("-e", "--extra", action="store_true", help="clusters by the shape of the tree; branches that meet below the cut height stay together")
    p = command("VCFKeepSamples", threads=False)
    p.add_argument("-s", "--samples", required=True)
    p.add_argument("--ignoreHets", action="store_true")
    return top


def policy_of(args) -> windows.WindowPolicy | None:
    if args.window_bp is not None and args.window_variants is not None:
        raise SystemExit("--window-bp and --window-variants exclude each other")
    if args.window_bp is None and args.window_variants is None:
        return None
    if args.embeddings or getattr(args, "bootstrap", 0):
        raise SystemExit("windows can't be combined with embeddings or a bootstrap")
    mode, size = ("bp", args.window_bp) if args.window_bp is not None else ("variants", args.window_variants)
    return windows.WindowPolicy(mode, size, args.step, args.min_variants)


def local_threads(threads: int) -> dict[str, str]:
    """The master of a run that nothing else gives one: so many local threads."""
    from pyspark import SparkConf

    return {} if SparkConf().contains("spark.master") else {"spark_master": f"local[{max(1, threads)}]"}


def emit(lines, order: list[str], output: str | None) -> None:
    """Text rows to a folder of files, or to standard output one partition at a time."""
    if output:
        write_lines(lines, output, order)
    else:
        for r in lines.orderBy(*order).select("value").toLocalIterator():
            print(r["value"])


def run(argv: list[str] | None = None, spark=None) -> int:
    args = _parser().parse_args(argv)
    logging.basicConfig(stream=sys.stderr, level=logging.INFO if args.verbose else logging.WARNING)
    spark = spark or get_session(f"lociweave {args.command}", **local_threads(getattr(args, "threads", 1)))
    paths = [*args.paths, *args.input]
    if not paths:
        raise SystemExit("no input")
    one = (args.input or paths)[0]
    text = lambda values: spark.createDataFrame([(k, v) for k, v in enumerate(values)], "line_no int, value string")
    if args.command in ("VCF2DIST", "VCF2TREE"):
        vcf = C.read_vcf(spark, paths)
        n, policy, grow = len(vcf.samples), policy_of(args), args.command == "VCF2TREE"
        if grow and n < 2:
            raise SystemExit("a tree needs two samples at least")
        by = ["chrom", "start", "end", "line_no"]
        if policy:
            dist = C.windowed_distances(vcf, policy)
            if grow:
                emit(C.windowed_tree_lines(dist, n), by, args.output)
            elif args.long:
                rows = C.long_lines(dist)
                body = rows.select("chrom", "start", "end", F.lit(1).alias("line_no"), F.concat_ws("\t", *rows.columns).alias("value"))
                emit(text(["\t".join(rows.columns)]).select(F.lit("").alias("chrom"), F.lit(-1).alias("start"), F.lit(-1).alias("end"), F.lit(0).alias("line_no"), "value").unionByName(body), by, args.output)
            else:
                emit(C.windowed_matrix_lines(dist, n), by, args.output)
            return 0
        reps = getattr(args, "bootstrap", 0)
        if args.embeddings:
            dist, count = C.embedding_distances(vcf, C.read_embeddings(spark, args.embeddings, args.embeddings_format), C.VariantKey.parse(args.variant_key), reps, args.seed)
            used = count["used"]
        else:
            dist, used = C.vcf_distances(vcf, reps, args.seed), vcf.variants.count()
        if grow:
            grown = C.supported_tree(dist, reps, n) if reps else C.one_tree(dist.where("rep = 0"), n)
            emit(grown.select(F.lit(0).alias("line_no"), F.col("newick").alias("value")), ["line_no"], args.output)
        else:
            emit(matrix_lines(dist.select("i", "j", "name_i", "name_j", "dist"), f"'{n}\t{used}'"), ["line_no"], args.output)
    elif args.command in ("FASTA2DIST", "FASTA2TREE"):
        seqs = materialised(C.read_sequence_lines(spark, paths))
        dist, n = C.sequence_distances(seqs, args.kmerSize, args.normalize), seqs.where("at = 0").count()
        if args.command == "FASTA2TREE":
            emit(C.one_tree(dist, n).select(F.lit(0).alias("line_no"), F.col("newick").alias("value")), ["line_no"], args.output)
        else:
            emit(matrix_lines(dist, f"'{n}'"), ["line_no"], args.output)
    elif args.command == "VCF2ISTATS":
        found, samples = C.individual_stats(spark, one)
        names = text(["INDIV\tN_SITES\tN_HET\tN_ALT\tN_REF\tN_MISS\tP_HET\tP_ALT\tP_REF\tP_MISS"])
        order = spark.createDataFrame([(k + 1, s) for k, s in enumerate(samples)], "line_no int, indiv string")
        emit(names.unionByName(C.stats_lines(found).join(order, "indiv").select("line_no", "value")), ["line_no"], args.output)
    elif args.command in ("VCFKeepSamples", "VCFNonrelated", "VCFRemoveClones"):
        if args.command == "VCFKeepSamples":
            keep = [r[0] for r in stats.keep_list(spark.read.text(args.samples)).collect()]  # a list of samples
        else:
            keep = C.representatives(C.read_vcf(spark, paths), args.cutHeight, args.ignoreHets, args.onlyHets, args.extra)
        emit(kept_lines(spark, paths, keep, args.ignoreHets), ["kind", "ord"], args.output)
    elif args.command == "DIST2TREE":
        dist = C.matrix_groups(spark, one)
        grown = C.one_tree(dist, dist.where("i = j").count())
        emit(grown.select(F.lit(0).alias("line_no"), F.col("newick").alias("value")), ["line_no"], args.output)
    elif args.command == "DIST2Clusters":
        dist = C.matrix_groups(spark, one)
        if args.method == "height":
            got = C.height_clusters(dist, dist.where("i = j").count(), 0.5 if args.cutHeight is None else args.cutHeight, args.minClusterSize)
        else:
            got = dynamic_cut.dynamic_clusters(dist, ["rep"], args.cutHeight, args.minClusterSize, min_split=(args.cutHeight or 0.0) if args.extra else 0.0)
        got = materialised(got)
        rows = got.select(F.col("cluster_id").alias("line_no"), "name", F.concat_ws("\t", "name", F.col("cluster_id").cast("string"), F.col("size").cast("string")).alias("value"))
        n = got.select("cluster_id").distinct().count()
        tops = spark.createDataFrame([(-2, "", f"{time.strftime('%Y-%m-%d %H:%M:%S')} Clusters={n}"), (-1, "", "")], "line_no int, name string, value string")
        emit(tops.unionByName(rows), ["line_no", "name"], args.output)
    else:
        from .sources.matrix import read_matrix

        bins = stats.histogram(read_matrix(spark, one).where("i <= j"), args.bins)
        emit(bins.select("bin", F.concat_ws("\t", *[F.col(c).cast("string") for c in ("bin", "low", "high", "n")]).alias("value")), ["bin"], args.output)
    return 0


if __name__ == "__main__":
    sys.exit(run())
