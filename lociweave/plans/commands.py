"""The toolkit's commands as DataFrame plans; `cli` gives them options and writes their text forms."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..functions.genotype import VariantKey, hets_only
from ..functions.numbers import stats_text
from ..operators import agglomerate, distance, dynamic_cut, kmers, stats, tree, windows
from ..operators import embedding_projection as emb
from ..operators.shared import materialised, written
from ..sources.embeddings import read_embeddings  # noqa: F401
from ..sources.fasta import read_fasta, read_sequence_lines  # noqa: F401
from ..sources.matrix import matrix_lines, matrix_pairs, read_matrix
from ..sources.text import expand, read_lines
from ..sources.vcf import Vcf, parse, read_head, read_vcf  # noqa: F401


def vcf_distances(vcf: Vcf, replicates: int = 0, seed: int = 1) -> DataFrame:
    """(grp 0, rep, i, j, name_i, name_j, dist) over the whole file."""
    counts = distance.block_counts(vcf.variants, len(vcf.samples), vcf.ploidy, vcf.max_alleles, replicates=replicates, seed=seed)
    return distance.block_distances(counts, vcf.samples)


def windowed_distances(vcf: Vcf, policy: windows.WindowPolicy) -> DataFrame:
    """(chrom, start, end, n, i, j, name_i, name_j, dist) of each window with enough lines."""
    # the file is read twice: for its positions, from which windows follow, and for its genotypes
    positions = written(vcf.variants.select("ord", "chrom", "pos"))
    found = windows.bounds(windows.assign(positions, policy), policy)
    assigned = windows.assign(vcf.variants.select("ord", "chrom", "pos", "gts"), policy, positions=positions)
    counts = distance.block_counts(assigned, len(vcf.samples), vcf.ploidy, vcf.max_alleles, group="win_id")
    dist = distance.block_distances(counts, vcf.samples)
    return found.withColumnRenamed("win_id", "grp").join(dist, "grp").select("chrom", "start", "end", "n", "i", "j", "name_i", "name_j", "dist")


def embedding_distances(vcf: Vcf, embeddings: DataFrame, kind: VariantKey = VariantKey.CHROM_POS_REF_ALT, replicates: int = 0, seed: int = 1) -> tuple[DataFrame, dict[str, int]]:
    """(rep, i, j, name_i, name_j, dist) of the samples' projected vectors, and the counters."""
    matched = emb.with_embeddings(vcf.variants, embeddings, kind)
    first = embeddings.select(F.size("vec")).first()
    vectors = emb.project(matched, len(vcf.samples), first[0] if first else 0, replicates, seed)
    names = F.array(*[F.lit(s) for s in vcf.samples])
    dist = emb.vector_distances(vectors, ["rep"])
    return dist.select("rep", "i", "j", F.get(names, F.col("i")).alias("name_i"), F.get(names, F.col("j")).alias("name_j"), "dist"), emb.counters(vcf.variants, matched)


def sequence_distances(seqs: DataFrame, k: int = 4, normalise: bool = False, statistic: str = "d2s") -> DataFrame:
    """(i, j, name_i, name_j, dist), 0-based in order of the records; of records or of lines of sequences."""
    text = ["seq"] if "seq" in seqs.columns else ["at", "value"]
    profiles = kmers.probabilities(materialised(kmers.count_both(seqs.select("seq_id", *text), S.check_k(k))), normalise=normalise)
    dist = (kmers.d2s if statistic == "d2s" else kmers.d2star)(profiles)
    names = seqs.select("seq_id", "short_name") if "seq" in seqs.columns else seqs.where("at = 0").select("seq_id", "short_name")
    for side in ("i", "j"):
        own = names.select(F.col("seq_id").alias(side), F.col("short_name").alias(f"name_{side}"))
        dist = dist.join(own, side)
    return dist.select((F.col("i") - 1).alias("i"), (F.col("j") - 1).alias("j"), "name_i", "name_j", "dist")


def long_lines(dist: DataFrame) -> DataFrame:
    """chrom start end sample_i sample_j dist of windowed distances, i < j."""
    from ..functions.numbers import distance_text

    return dist.where("i < j").select("chrom", "start", "end", F.col("name_i").alias("sample_i"), F.col("name_j").alias("sample_j"), distance_text(F.col("dist")).alias("dist"))


def window_head(samples: int) -> str:
    return f"concat('# window chrom=', chrom, ' start=', start, ' end=', end, ' nvariants=', n, ' nsamples={samples}')"


def windowed_matrix_lines(dist: DataFrame, samples: int) -> DataFrame:
    """Text rows of all windows: a window line, a size line and the matrix."""
    by = ["chrom", "start", "end", "n"]
    body = matrix_lines(dist, by=by).withColumn("line_no", F.col("line_no") + 1)
    tops = dist.select(*by).distinct()
    first = tops.select(*by, F.lit(0).alias("line_no"), F.expr(window_head(samples)).alias("value"))
    second = tops.select(*by, F.lit(1).alias("line_no"), F.concat_ws("\t", F.lit(str(samples)), F.col("n").cast("string")).alias("value"))
    return first.unionByName(second).unionByName(body)


def windowed_tree_lines(dist: DataFrame, samples: int, linkage: str = "complete") -> DataFrame:
    by = ["chrom", "start", "end", "n"]
    grown = tree.trees(dist, by, linkage)
    return grown.select(*by, F.lit(0).alias("line_no"), F.expr(window_head(samples)).alias("value")).unionByName(grown.select(*by, F.lit(1).alias("line_no"), F.col("newick").alias("value")))


def individual_stats(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """Statistics of each individual of a VCF; lines of under ten columns are passed over."""
    files = expand(spark, [path])
    lines, samples = read_lines(spark, files), read_head(spark, files).samples
    wide = lines.where(F.size(F.split("value", "\t")) >= 10)
    return stats.individual_counts(stats.genotype_calls(parse(wide, samples), samples)), samples


def stats_lines(found: DataFrame) -> DataFrame:
    ratios = [stats_text(F.col(c)) for c in ("p_het", "p_alt", "p_ref", "p_miss")]
    return found.select("indiv", F.concat_ws("\t", "indiv", *[F.col(c).cast("string") for c in ("n_sites", "n_het", "n_alt", "n_ref", "n_miss")], *ratios).alias("value"))


def representatives(vcf: Vcf, height: float, ignore_hets: bool = False, only_hets: bool = False, extra: bool = False) -> list[str]:
    """Samples that stay if of each cluster below a height only the one with least missing genotypes does.

    Heights near 0.5 leave unrelated samples, heights near 0.075 one of each clone.  Distances may leave out the
    heterozygous genotypes, or all others.  `extra` cuts the tree by the shape of its branches, of which those that meet below the
    height stay together.
    """
    if ignore_hets and only_hets:
        raise ValueError("heterozygous genotypes can't be ignored and be the only ones")
    used = replace(vcf, variants=vcf.variants.withColumn("gts", hets_only(F.col("gts"), only_hets))) if ignore_hets or only_hets else vcf
    dist = vcf_distances(used)
    found = dynamic_cut.dynamic_clusters(dist, ["rep"], height, 1, min_split=height) if extra else height_clusters(dist, len(vcf.samples), height)
    missing = stats.individual_counts(stats.genotype_calls(vcf.variants, vcf.samples)).select(F.col("indiv").alias("name"), F.col("p_miss").alias("miss"))
    kept = {r["name"] for r in stats.least_missing(found.select("cluster_id", "name").join(missing, "name")).collect()}  # sample names
    return [s for s in vcf.samples if s in kept]


def matrix_groups(spark: SparkSession, path: str) -> DataFrame:
    """(rep 0, i, j, name_i, name_j, dist) of a matrix file."""
    return matrix_pairs(read_matrix(spark, path)).select(F.lit(0).alias("rep"), "*")


def one_tree(dist: DataFrame, samples: int) -> DataFrame:
    """(newick) of one matrix: in one task if it is small, else in rounds."""
    if samples > tree.GROUP_SAMPLES:
        return agglomerate.large_tree(dist)
    return tree.trees(dist.select(F.lit(0).alias("rep"), "i", "j", "name_i", "name_j", "dist"), ["rep"]).select("newick")


def supported_tree(dist: DataFrame, replicates: int, samples: int) -> DataFrame:
    """(newick) of rep 0 with support of the other replicates: a task a matrix if they are small, else in rounds."""
    if samples > tree.GROUP_SAMPLES:
        return agglomerate.large_supported_tree(dist, replicates)
    return tree.supported_tree(dist, replicates).select("newick")


def height_clusters(dist: DataFrame, samples: int, height: float, min_size: int = 1) -> DataFrame:
    """(cluster_id, name, size) of one matrix's tree, cut at a height: in one task if it is small, else in rounds."""
    if samples > tree.GROUP_SAMPLES:
        return agglomerate.large_clusters(dist, height, min_size)
    return tree.clusters(dist, ["rep"], height, min_size).select("cluster_id", "name", "size")
