"""Registered queries that go through files: tables are written as variant, sequence, embedding and matrix
files to the shared folder and read by the real readers; their SQL starts from the tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import kmers, windows
from ..operators.shared import remove_folder, shared_folder
from ..sources.embeddings import read_embeddings
from ..sources.bgzf import opened, read_splits, write_bgzf
from ..sources.fasta import odd_qualities, read_fasta, read_sequence_lines
from ..sources.matrix import matrix_lines, matrix_pairs, read_matrix, write_lines
from ..sources.text import expand
from ..sources.vcf import Vcf, kept_lines, read_head, read_vcf
from . import commands as C
from .queries import _AS_BASES, _LETTERS, _SQL_G, SAMPLES, TILE, K, _genotypes, _names, _sql_d2, _sql_kmers, _t, _wide
from .tree_sql import _number


def _size(uri: str) -> int:
    found, path = opened(uri)
    return found.get_file_info(path).size


def _file(spark: SparkSession, lines: DataFrame, order: list[str], together: int | None = None) -> str:
    """A folder of text files of the lines, in the shared folder."""
    path = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    write_lines(lines, path, order, together)
    return path


# ---- variant files ----------------------------------------------------------

# Variants of three contigs in order; every seventh has no GT, the even ones nothing but GT.
_COMMENTS = ["##fileformat=VCFv4.2", "##source=tables"]


def _vcf_path(spark: SparkSession, sf_dir: str) -> str:
    return _file(spark, _vcf_lines(spark, sf_dir), ["contig", "pos"])


def _vcf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _wide(_genotypes(spark, sf_dir))
    v = F.col("pos")
    fmt = F.when(v % 7 == 3, "DP").when(v % 2 == 0, "GT").otherwise("DP:GT:XX")
    sample = lambda x: F.when(v % 7 == 3, "9").when(v % 2 == 0, F.coalesce(x, F.lit("./."))).otherwise(F.concat(F.lit("9:"), F.coalesce(x, F.lit("./.")), F.lit(":x")))
    fixed = [F.concat(F.lit("chr"), (v % 3).cast("string")), v.cast("string"), F.when(v % 2 == 0, ".").otherwise(F.concat(F.lit("rs"), v.cast("string"))), F.lit("A"), F.lit("T"), F.lit("."), F.lit("PASS"), F.concat(F.lit("V="), v.cast("string")), fmt]
    body = g.select((v % 3).cast("int").alias("contig"), v.cast("int").alias("pos"), F.concat_ws("\t", *fixed, F.concat_ws("\t", F.transform("gts", sample))).alias("value"))
    head = [*_COMMENTS, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *_names()])]
    tops = spark.createDataFrame([(-1, k, x) for k, x in enumerate(head)], "contig int, pos int, value string")
    return tops.unionByName(body)


def _vcf(spark, sf_dir) -> Vcf:
    return read_vcf(spark, _vcf_path(spark, sf_dir))


#: calls that count: those of variants with GT, with alleles under the number inferred from the first line
_SQL_FILE = f"""{_SQL_G},
o AS (SELECT v FROM g ORDER BY v % 3, v LIMIT 1),
m AS (SELECT max(greatest(a0, a1)) + 1 AS m FROM g WHERE v = (SELECT v FROM o) AND s < 8),
k AS (SELECT v, v % 3 AS w, s, hap, allele FROM c, m WHERE v % 7 <> 3 AND allele < m),
x AS (SELECT DISTINCT v FROM g), i AS (SELECT DISTINCT s FROM g)"""


_SQL_DIST = "CASE WHEN coalesce(p.norm, 0) = 0 OR coalesce(q.norm, 0) = 0 THEN CASE WHEN f.i = f.j THEN 0 ELSE 1 END ELSE greatest(0, 1 - coalesce(dot, 0) / (sqrt(p.norm) * sqrt(q.norm))) END"
_SQL_MATRIX = f"""WITH {_SQL_FILE},
d AS (SELECT a.s AS i, b.s AS j, count(*) AS dot FROM k a JOIN k b USING (v, hap, allele) GROUP BY 1, 2),
n AS (SELECT s, count(*) AS norm FROM k GROUP BY 1),
f AS (SELECT a.s AS i, b.s AS j FROM i a, i b),
t AS (SELECT f.i, f.j, CAST({_SQL_DIST} AS DOUBLE) AS dist FROM f LEFT JOIN d ON f.i = d.i AND f.j = d.j LEFT JOIN n p ON p.s = f.i LEFT JOIN n q ON q.s = f.j)"""


def vcf_genotypes(spark, sf_dir):
    """Every genotype of the file with its sample's name."""
    vcf = _vcf(spark, sf_dir)
    names = F.array(*[F.lit(s) for s in vcf.samples])
    return vcf.variants.select("chrom", "pos", "id", "info", F.posexplode("gts").alias("k", "gt")).select("chrom", "pos", "id", "info", F.get(names, F.col("k")).alias("sample"), "gt")


def vcf_block_gzip(spark, sf_dir):
    """The lines of block-gzipped files that are read by splits of 4 KB."""
    path = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    write_bgzf(_vcf_lines(spark, sf_dir), path, ["contig", "pos"])
    files = [(k, f, _size(f)) for k, f in enumerate(expand(spark, [path]))]
    lines = read_splits(spark, files, 4096)
    before = F.struct("file", "block", "line")
    body = lines.where("not startswith(value, '#')").select(before.alias("ord"), F.substring_index("value", "\t", 2).alias("at"), F.md5("value").alias("digest"))
    policy = windows.WindowPolicy("variants", 64)
    numbered = windows.assign(body.select("ord", F.split("at", "\t")[0].alias("chrom"), F.split("at", "\t")[1].cast("int").alias("pos"), "digest"), policy)
    return numbered.groupBy("chrom", "win_id").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.count(F.lit(1)).alias("n"), F.md5(F.array_join(F.sort_array(F.collect_list("digest")), "")).alias("digest")).drop("win_id")


def vcf_shape(spark, sf_dir):
    """What the head of the file says, and how many data lines follow."""
    path = _vcf_path(spark, sf_dir)
    vcf, head = read_vcf(spark, path), read_head(spark, expand(spark, [path]))
    row = (len(head.comments), " ".join(vcf.samples), vcf.ploidy, vcf.max_alleles, vcf.variants.count())
    return spark.createDataFrame([row], "comments int, samples string, ploidy int, max_alleles int, n long")


def vcf_distance_text(spark, sf_dir):
    """The lines of the command that writes the distances of all samples."""
    vcf = _vcf(spark, sf_dir)
    dist = C.vcf_distances(vcf).select("i", "j", "name_i", "name_j", "dist")
    return matrix_lines(dist, f"'{len(vcf.samples)}\t{vcf.variants.count()}'").select("line_no", "value")


def vcf_window_text(spark, sf_dir):
    """The lines of the command that writes a matrix for each window."""
    vcf = _vcf(spark, sf_dir)
    return C.windowed_matrix_lines(C.windowed_distances(vcf, windows.WindowPolicy("bp", TILE)), len(vcf.samples)).select("chrom", "start", "line_no", "value")


def vcf_window_long(spark, sf_dir):
    """The rows of the long form of the windows' distances."""
    return C.long_lines(C.windowed_distances(_vcf(spark, sf_dir), windows.WindowPolicy("bp", TILE)))


def vcf_variant_windows(spark, sf_dir):
    """Windows of 50 lines each, those without GT counted too."""
    policy = windows.WindowPolicy("variants", 50)
    return windows.bounds(windows.assign(_vcf(spark, sf_dir).variants, policy), policy).select("chrom", "start", "end", "n")


def vcf_individual_text(spark, sf_dir):
    """The lines of the command that counts each individual's genotypes."""
    found, _ = C.individual_stats(spark, _vcf_path(spark, sf_dir))
    return C.stats_lines(found).select("indiv", "value")


def vcf_filtered_text(spark, sf_dir):
    """The lines of a file with three samples only, heterozygous genotypes masked."""
    kept = kept_lines(spark, _vcf_path(spark, sf_dir), ["s1", "s3", "s8"], ignore_hets=True)
    return kept.select("kind", "value")


def vcf_embedding_distances(spark, sf_dir):
    """Distances of the samples' vectors by a variant file and a file of embeddings."""
    e = _t(spark, sf_dir, "embeddings")
    key = F.concat_ws(":", F.concat(F.lit("chr"), (F.col("vec_id") % 3).cast("string")), F.col("vec_id").cast("string"), F.lit("A"), F.lit("T"))
    numbers = F.transform("embedding", lambda x: x.cast("double").cast("string"))
    path = _file(spark, e.select("vec_id", F.concat_ws("\t", key, F.concat_ws("\t", numbers)).alias("value")), ["vec_id"])
    dist, _ = C.embedding_distances(_vcf(spark, sf_dir), read_embeddings(spark, path))
    return dist.select(F.col("name_i").alias("sample_i"), F.col("name_j").alias("sample_j"), F.round("dist", 6).alias("dist"))


def matrix_cells(spark, sf_dir):
    """A matrix file's cells by row and column."""
    lines = vcf_distance_text(spark, sf_dir)
    cells = read_matrix(spark, _file(spark, lines, ["line_no"]))
    pairs = matrix_pairs(cells)
    return pairs.select("i", "j", "name_i", "name_j", F.round("dist", 7).alias("dist"))


# ---- files of embeddings ------------------------------------------------------


def _embedding_rows(read: DataFrame) -> DataFrame:
    return read.select("key", F.size("vec").alias("width"), F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


def embedding_tsv(spark, sf_dir):
    """A tab-separated file with comments, blank lines, bad rows and repeated keys, of which the last row stays."""
    e = _t(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double").cast("string")).alias("x"))
    line = lambda turn, value: F.struct(F.lit(turn).alias("turn"), value.alias("value"))
    key = F.concat(F.lit("k"), F.col("vec_id").cast("string"))
    good = F.concat_ws("\t", key, F.concat_ws("\t", "x"))
    lines = e.select("vec_id", F.explode(F.array(
        line(0, F.concat_ws("\t", key, F.concat_ws("\t", F.transform("x", lambda _: F.lit("0.5"))))),
        line(1, F.when(F.col("vec_id") % 5 == 0, F.concat(F.lit("# "), good)).when(F.col("vec_id") % 5 == 1, F.concat(good, F.lit("\t1"))).when(F.col("vec_id") % 5 == 2, F.concat(good, F.lit("x"))).otherwise(good)),
        line(2, F.lit("")),
    )).alias("l"))
    return _embedding_rows(read_embeddings(spark, _file(spark, lines.select("vec_id", "l.turn", "l.value"), ["vec_id", "turn"])))


def _json_path(e: DataFrame, content) -> str:
    """One JSON text for each hundred vectors."""
    spark = e.sparkSession
    path = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    texts = e.groupBy(F.floor(F.col("vec_id") / 100).alias("part")).agg(content.alias("value"))
    texts.write.partitionBy("part").text(path)
    return path


def embedding_json(spark, sf_dir):
    """A list of variants as JSON; of two entries of a key the last stays."""
    e = _t(spark, sf_dir, "embeddings").select("vec_id", F.concat(F.lit("k"), F.col("vec_id").cast("string")).alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    first = F.collect_list(F.struct("id", F.array(F.lit(1.5)).alias("embedding")))
    content = F.to_json(F.struct(F.concat(first, F.collect_list(F.struct("id", "embedding"))).alias("variants")))
    return _embedding_rows(read_embeddings(spark, _json_path(e, content), "HUGGINGFACE"))


def embedding_json_flat(spark, sf_dir):
    """Keys with their vectors as JSON."""
    e = _t(spark, sf_dir, "embeddings").select("vec_id", F.concat(F.lit("k"), F.col("vec_id").cast("string")).alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    content = F.to_json(F.map_from_entries(F.collect_list(F.struct("id", "embedding"))))
    return _embedding_rows(read_embeddings(spark, _json_path(e, content), "HUGGINGFACE"))


# ---- files of sequences --------------------------------------------------------


def _bases(text) -> F.Column:
    return F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), _LETTERS, _AS_BASES), "[^ACGT]", "")


_SQL_BASES = f"regexp_replace(translate(coalesce(text, ''), '{_LETTERS}', '{_AS_BASES}'), '[^ACGT]', '', 'g')"
_SQL_HEADER = "'doc-' || doc_id || ' ' || coalesce(lang, '') || '; (' || coalesce(source, '') || ')'"
_SQL_NAME = f"trim(regexp_replace(regexp_replace({_SQL_HEADER}, '[^A-Za-z0-9_.+=|-]', ' ', 'g'), ' +', ' ', 'g'))"


def _records(spark, sf_dir, marker: str) -> DataFrame:
    header = F.concat(F.lit(f"{marker}doc-"), F.col("doc_id").cast("string"), F.lit(" "), F.coalesce("lang", F.lit("")), F.lit("; ("), F.coalesce("source", F.lit("")), F.lit(")"))
    return _t(spark, sf_dir, "documents").select("doc_id", header.alias("header"), _bases(F.col("text")).alias("seq"))


def _written(spark, records: DataFrame, lines) -> str:
    """Files of records; each is in one file, as a reader ends a record where its file ends."""
    return _file(spark, records.select("doc_id", F.posexplode(lines).alias("at", "value")), ["doc_id", "at"], together=1)


def _read(spark, path: str, reader, **options) -> DataFrame:
    """What the reader finds; it has then put all lines into tables of its own, so the files go: they are as large as those."""
    found = reader(spark, path, **options)
    remove_folder(spark, path)
    return found


def fasta_records(spark, sf_dir):
    """Documents as records of lines of 60 letters; empty ones have a header only."""
    lines = F.concat(F.array("header"), F.regexp_extract_all("seq", F.lit(".{1,60}"), F.lit(0)))
    found = _read(spark, _written(spark, _records(spark, sf_dir, ">"), lines), read_fasta)
    return found.select("seq_id", "short_name", "name", F.length("seq").alias("bases"), F.md5("seq").alias("digest"))


def fastq_records(spark, sf_dir):
    """Documents as records with qualities, many of which begin with a sign of a header."""
    records = _records(spark, sf_dir, "@").where("seq <> ''")
    first = F.element_at(F.array(F.lit("@"), F.lit(">"), F.lit("+")), (F.col("doc_id") % 3 + 1).cast("int"))
    qual = F.concat(first, F.repeat(F.lit("I"), (F.length("seq") - 1).cast("int")))
    found = _read(spark, _written(spark, records, F.array("header", "seq", F.lit("+"), qual)), read_fasta, keep_quality=True)
    return found.select("seq_id", "short_name", F.md5("seq").alias("digest"), F.substring("qual", 1, 1).alias("sign"), F.length("qual").alias("qualities"))


def _wrapped(spark, sf_dir) -> DataFrame:
    """Records of lines of 50 letters, all qualities as long as their sequence but those of each eleventh record, which end early."""
    records = _records(spark, sf_dir, "@").where("seq <> ''")
    wrap = lambda c: F.regexp_extract_all(c, F.lit(".{1,50}"), F.lit(0))
    early = (F.col("doc_id") % 11 == 0) & (F.length("seq") > 50)
    qual = F.transform(wrap("seq"), lambda x, i: F.concat(F.element_at(F.array(F.lit("@"), F.lit(">"), F.lit("+"), F.lit("I")), ((F.col("doc_id") + i) % 4 + 1).cast("int")), F.repeat(F.lit("J"), F.length(x) - 1)))
    return records.select("doc_id", "header", "seq", wrap("seq").alias("lines"), F.when(early, F.array(F.lit("IJ"))).otherwise(qual).alias("qual"))


def fastq_wrapped(spark, sf_dir):
    """Qualities of many lines, many of which look like headers, and some that are cut short."""
    path = _written(spark, _wrapped(spark, sf_dir), F.concat(F.array("header"), "lines", F.array(F.lit("+")), "qual"))
    found = _read(spark, path, read_fasta, keep_quality=True)
    return found.select("seq_id", "short_name", F.md5("seq").alias("digest"), F.md5("qual").alias("qualities"))


def fastq_odd_qualities(spark, sf_dir):
    """Of the same file the records whose quality has another length than the sequence."""
    return _read(spark, _written(spark, _wrapped(spark, sf_dir), F.concat(F.array("header"), "lines", F.array(F.lit("+")), "qual")), odd_qualities)


def fasta_line_kmers(spark, sf_dir):
    """k-mers of all documents as records of lines of 60 letters; no sequence is put together."""
    lines = F.concat(F.array("header"), F.regexp_extract_all("seq", F.lit(".{1,60}"), F.lit(0)))
    found = kmers.count_forward(_read(spark, _written(spark, _records(spark, sf_dir, ">"), lines), read_sequence_lines), K, "short_name")
    return found.groupBy("kmer").agg(F.sum("cnt").alias("cnt"), F.count(F.lit(1)).alias("records"))


def fasta_distance_text(spark, sf_dir):
    """The lines of the command that writes D2S distances, over the items of the benchmark."""
    items = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.concat(F.lit(">item"), F.col("item_id").cast("string")).alias("header"), F.translate("text", _LETTERS, _AS_BASES).alias("seq"))
    one_line = F.array("header", F.regexp_replace("seq", r"[\x00-\x20@>+]", "N"))
    dist = C.sequence_distances(_read(spark, _written(spark, items, one_line), read_fasta), K)
    return dist.select("name_i", "name_j", F.round("dist", 6).alias("dist"))


_QUERIES = (vcf_genotypes, vcf_block_gzip, vcf_shape, vcf_distance_text, vcf_window_text, vcf_window_long, vcf_variant_windows, vcf_individual_text, vcf_filtered_text, vcf_embedding_distances, matrix_cells, embedding_tsv, embedding_json, embedding_json_flat, fasta_records, fastq_records, fastq_wrapped, fastq_odd_qualities, fasta_line_kmers, fasta_distance_text)


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


_SQL_GT = "coalesce(CAST(a0 AS VARCHAR) || '/' || CAST(a1 AS VARCHAR), './.')"
_SQL_WINDOWS = f"""WITH {_SQL_FILE},
z AS (SELECT *, v // {TILE} AS t FROM k), y AS (SELECT v % 3 AS w, v // {TILE} AS t, count(*) AS n FROM x GROUP BY 1, 2),
d AS (SELECT a.w, a.t, a.s AS i, b.s AS j, count(*) AS dot FROM z a JOIN z b USING (w, t, v, hap, allele) GROUP BY 1, 2, 3, 4),
n AS (SELECT w, t, s, count(*) AS norm FROM z GROUP BY 1, 2, 3),
f AS (SELECT y.w, y.t, y.n, a.s AS i, b.s AS j FROM y, i a, i b),
r AS (SELECT f.w, f.t, f.n, f.i, f.j, CAST({_SQL_DIST} AS DOUBLE) AS dist FROM f LEFT JOIN d ON (f.w, f.t, f.i, f.j) = (d.w, d.t, d.i, d.j) LEFT JOIN n p ON (p.w, p.t, p.s) = (f.w, f.t, f.i) LEFT JOIN n q ON (q.w, q.t, q.s) = (f.w, f.t, f.j))"""
_SQL_FIELD = f"CASE WHEN v % 7 = 3 OR a0 IS NULL OR a0 <> a1 THEN './.' WHEN v % 2 = 0 THEN {_SQL_GT} ELSE '9:' || {_SQL_GT} || ':x' END"
_SQL_RAW = f"CASE WHEN v % 7 = 3 THEN '9' WHEN v % 2 = 0 THEN {_SQL_GT} ELSE '9:' || {_SQL_GT} || ':x' END"
_SQL_LINE = "'chr' || v % 3 || chr(9) || v || chr(9) || CASE WHEN v % 2 = 0 THEN '.' ELSE 'rs' || v END || chr(9) || 'A' || chr(9) || 'T' || chr(9) || '.' || chr(9) || 'PASS' || chr(9) || 'V=' || v || chr(9) || CASE WHEN v % 7 = 3 THEN 'DP' WHEN v % 2 = 0 THEN 'GT' ELSE 'DP:GT:XX' END"
_SQL_WRAPPED = f"""WITH r AS (SELECT doc_id, {_SQL_BASES} AS seq FROM documents),
w AS (SELECT doc_id, seq, CASE WHEN doc_id % 11 = 0 AND length(seq) > 50 THEN 'IJ' ELSE array_to_string(list_transform(range((length(seq) + 49) // 50), lambda i: ['@', '>', '+', 'I'][(doc_id + i) % 4 + 1] || repeat('J', least(50, length(seq) - 50 * i) - 1)), '') END AS qual FROM r WHERE seq <> '')"""


def _share(a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN 'NaN' ELSE printf('%.4f', {a} / {b}) END"


ORACLE_SQL = {
    "vcf_genotypes": f"WITH {_SQL_FILE} SELECT 'chr' || x.v % 3 AS chrom, x.v AS pos, CASE WHEN x.v % 2 = 0 THEN '.' ELSE 'rs' || x.v END AS id, 'V=' || x.v AS info, 's' || i.s AS sample, {_SQL_GT} AS gt FROM x CROSS JOIN i LEFT JOIN g ON g.v = x.v AND g.s = i.s WHERE x.v % 7 <> 3",
    "vcf_block_gzip": f"""WITH {_SQL_FILE},
a AS (SELECT x.v, i.s, a0, a1 FROM x CROSS JOIN i LEFT JOIN g ON g.v = x.v AND g.s = i.s),
l AS (SELECT v, {_SQL_LINE} || chr(9) || string_agg({_SQL_RAW}, chr(9) ORDER BY s) AS value FROM a GROUP BY v),
w AS (SELECT 'chr' || v % 3 AS chrom, v, md5(value) AS digest, (row_number() OVER (PARTITION BY v % 3 ORDER BY v) - 1) // 64 AS k FROM l)
SELECT chrom, CAST(min(v) AS INT) AS first, CAST(max(v) AS INT) AS last, count(*) AS n, md5(string_agg(digest, '' ORDER BY digest)) AS digest FROM w GROUP BY chrom, k""",
    "vcf_shape": f"WITH {_SQL_FILE} SELECT 2 AS comments, '{' '.join(f's{k}' for k in range(SAMPLES))}' AS samples, 2 AS ploidy, m AS max_alleles, (SELECT count(*) FROM x) AS n FROM m",
    "vcf_distance_text": f"""{_SQL_MATRIX}
SELECT CAST(i + 1 AS INT) AS line_no, 's' || i || chr(9) || string_agg({_number('dist')}, chr(9) ORDER BY j) AS value FROM t GROUP BY i
UNION ALL SELECT 0, '{SAMPLES}' || chr(9) || (SELECT count(*) FROM x)""",
    "vcf_window_text": f"""{_SQL_WINDOWS}
SELECT 'chr' || w AS chrom, CAST(t * {TILE} AS INT) AS start, CAST(i + 2 AS INT) AS line_no, 's' || i || chr(9) || string_agg({_number('dist')}, chr(9) ORDER BY j) AS value FROM r GROUP BY w, t, i
UNION ALL SELECT 'chr' || w, CAST(t * {TILE} AS INT), 0, '# window chrom=chr' || w || ' start=' || t * {TILE} || ' end=' || (t + 1) * {TILE} || ' nvariants=' || n || ' nsamples={SAMPLES}' FROM y
UNION ALL SELECT 'chr' || w, CAST(t * {TILE} AS INT), 1, '{SAMPLES}' || chr(9) || n FROM y""",
    "vcf_window_long": f"{_SQL_WINDOWS} SELECT 'chr' || w AS chrom, CAST(t * {TILE} AS INT) AS start, CAST((t + 1) * {TILE} AS INT) AS \"end\", 's' || i AS sample_i, 's' || j AS sample_j, {_number('dist')} AS dist FROM r WHERE i < j",
    "vcf_variant_windows": f"""WITH {_SQL_FILE}, r AS (SELECT v, v % 3 AS w, (row_number() OVER (PARTITION BY v % 3 ORDER BY v) - 1) // 50 AS k FROM x)
SELECT 'chr' || w AS chrom, min(v) AS start, max(v) + 1 AS "end", count(*) AS n FROM r GROUP BY w, k""",
    "vcf_individual_text": f"""WITH {_SQL_FILE},
a AS (SELECT i.s, x.v, CASE WHEN x.v % 7 <> 3 THEN a0 END AS a0, CASE WHEN x.v % 7 <> 3 THEN a1 END AS a1 FROM x CROSS JOIN i LEFT JOIN g ON g.v = x.v AND g.s = i.s),
b AS (SELECT s, count(*) AS n, count(*) FILTER (WHERE a0 <> a1) AS h, count(*) FILTER (WHERE a0 = a1 AND a0 > 0) AS a, count(*) FILTER (WHERE a0 = 0 AND a1 = 0) AS r, count(*) FILTER (WHERE a0 IS NULL) AS m FROM a GROUP BY s)
SELECT 's' || s AS indiv, concat_ws(chr(9), 's' || s, n, h, a, r, m, {_share('h', '(h + a + r)')}, {_share('a', '(h + a + r)')}, {_share('r', '(h + a + r)')}, {_share('m', 'n')}) AS value FROM b""",
    "vcf_filtered_text": f"""WITH {_SQL_FILE},
a AS (SELECT x.v, i.s, a0, a1 FROM x CROSS JOIN i LEFT JOIN g ON g.v = x.v AND g.s = i.s WHERE i.s IN (1, 3, 8))
SELECT 2 AS kind, {_SQL_LINE} || chr(9) || string_agg({_SQL_FIELD}, chr(9) ORDER BY s) AS value FROM a GROUP BY v
UNION ALL SELECT 1, concat_ws(chr(9), '#CHROM', 'POS', 'ID', 'REF', 'ALT', 'QUAL', 'FILTER', 'INFO', 'FORMAT', 's1', 's3', 's8')
UNION ALL SELECT 0, unnest(['{_COMMENTS[0]}', '{_COMMENTS[1]}'])""",
    "vcf_embedding_distances": f"""WITH {_SQL_FILE},
e AS (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS p FROM embeddings WHERE vec_id % 7 <> 3),
d AS (SELECT s, v, (a0 > 0)::INT + (a1 > 0)::INT AS dosage FROM g),
h AS (SELECT s, p, sum(dosage * CAST(embedding[p] AS DOUBLE)) AS x FROM d JOIN e ON v = vec_id GROUP BY 1, 2),
l AS (SELECT s, sum(x * x) AS n FROM h GROUP BY 1),
q AS (SELECT a.s AS i, b.s AS j, sum(a.x * b.x) AS dot FROM h a JOIN h b USING (p) WHERE a.s <= b.s GROUP BY 1, 2)
SELECT 's' || i AS sample_i, 's' || j AS sample_j, round(least(2, greatest(0, 1 - dot / (sqrt(a.n) * sqrt(b.n)))), 6) AS dist FROM q JOIN l a ON a.s = i JOIN l b ON b.s = j""",
    "matrix_cells": f"{_SQL_MATRIX} SELECT i, j, 's' || i AS name_i, 's' || j AS name_j, CAST({_number('dist')} AS DOUBLE) AS dist FROM t WHERE i <= j",
    "embedding_tsv": """WITH e AS (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS p FROM embeddings)
SELECT 'k' || vec_id AS key, CAST(count(*) AS INT) AS width, round(sum(CASE WHEN vec_id % 5 < 3 THEN 0.5 ELSE CAST(embedding[p] AS DOUBLE) END), 4) AS total FROM e GROUP BY vec_id""",
    "fasta_records": f"""WITH r AS (SELECT doc_id, {_SQL_NAME} AS name, {_SQL_BASES} AS seq FROM documents)
SELECT CAST(row_number() OVER (ORDER BY doc_id) AS INT) AS seq_id, 'doc-' || doc_id AS short_name, name, CAST(length(seq) AS INT) AS bases, md5(seq) AS digest FROM r WHERE seq <> ''""",
    "fastq_records": f"""WITH r AS (SELECT doc_id, {_SQL_BASES} AS seq FROM documents)
SELECT CAST(row_number() OVER (ORDER BY doc_id) AS INT) AS seq_id, 'doc-' || doc_id AS short_name, md5(seq) AS digest, ['@', '>', '+'][doc_id % 3 + 1] AS sign, CAST(length(seq) AS INT) AS qualities FROM r WHERE seq <> ''""",
    "fastq_wrapped": f"{_SQL_WRAPPED} SELECT CAST(row_number() OVER (ORDER BY doc_id) AS INT) AS seq_id, 'doc-' || doc_id AS short_name, md5(seq) AS digest, md5(qual) AS qualities FROM w",
    "fastq_odd_qualities": f"{_SQL_WRAPPED}, n AS (SELECT *, CAST(row_number() OVER (ORDER BY doc_id) AS INT) AS seq_id FROM w) SELECT seq_id, length(seq) AS bases, length(qual) AS qualities FROM n WHERE length(seq) <> length(qual)",
    "fasta_line_kmers": f"""WITH r AS (SELECT doc_id, {_SQL_BASES} AS seq FROM documents), p AS (SELECT doc_id, seq, unnest(range(1, length(seq) - {K - 2})) AS i FROM r WHERE length(seq) >= {K}),
c AS (SELECT doc_id, substr(seq, i, {K}) AS kmer, count(*) AS cnt FROM p GROUP BY ALL) SELECT kmer, CAST(sum(cnt) AS BIGINT) AS cnt, count(*) AS records FROM c GROUP BY kmer""",
    "fasta_distance_text": "SELECT 'item' || i AS name_i, 'item' || j AS name_j, dist FROM (" + _sql_d2(False).replace(_sql_kmers("source"), _sql_kmers("item_id").replace("FROM documents", "FROM benchmark")) + ")",
}
for _name in ("embedding_json", "embedding_json_flat"):
    ORACLE_SQL[_name] = ORACLE_SQL["embedding_tsv"].replace("CASE WHEN vec_id % 5 < 3 THEN 0.5 ELSE CAST(embedding[p] AS DOUBLE) END", "CAST(embedding[p] AS DOUBLE)")
