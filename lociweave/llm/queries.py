"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversation_repair, conversation_trie, embedding_dedup, exact_dedup, language_id, licenses, line_dedup, packing, quality, simhash, substring_dedup, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one that is stored in fewer splits than there are cores is dealt out to all of them."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _fold(n: int):
    """crc32 of doc_id as text modulo n; null for a null doc_id."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    prototypes = language_id.learn(docs.where(_fold(5) != 0))
    held_out = F.coalesce(_fold(5) == 0, F.lit(False)).alias("held_out")
    return language_id.language_id(docs, prototypes).select("doc_id", held_out, "lang_pred", "score")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def quality_base_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics and base rule of op3, which SQL can express, without a classifier."""
    docs = _table(spark, sf_dir, "documents")
    out = quality.quality_rules(docs, spark.createDataFrame([], "doc_id long, quality int"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(_table(spark, sf_dir, "documents"))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.substring_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(_fold(3) != 1))
    held_out = F.coalesce(_fold(3) == 1, F.lit(False)).alias("held_out")
    return toxicity.toxicity(docs, model).select("doc_id", held_out, "score", "predicted")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_table(spark, sf_dir, "documents"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.trie(conversation_trie.rebuilt(conversation_trie.sequences(_table(spark, sf_dir, "conversations"))))


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.digests(conversation_repair.repair(conversation_repair.damage(_table(spark, sf_dir, "conversations"))))


def queries() -> dict:
    return {f.__name__: f for f in (op1_language_id, op2_exact_dedup, op3_quality_rules, op4_best_fit_packing, op5_bpe, op6_substring_dedup, op7_line_dedup, op8_simhash, op9_toxicity, op10_license_scan, op11_conversation_trie, op12_embedding_dedup, op13_conversation_repair, quality_base_columns)}


_SPACES = r"[\x20\x09-\x0D]+"

#: crc32 of a text of ASCII characters, by the table that a common table expression `crcs` holds
_CRC_TABLE = "crcs AS (SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY n) AS tab FROM range(256) AS r(n))"
_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT)), lambda x, y: xor(x >> 8, tab[1 + (xor(x, y) & 255)])))"


def _edit(after: str, letter: str, cost: str, turn: str = "") -> str:
    """A way on from a state: nine digits of cost and the audit as e, the repaired turns as r."""
    return f"{{'e': printf('%09d', substr({after}.e, 1, 9)::INT + {cost}) || '{letter}' || substr({after}.e, 10), 'r': " + (f"list_prepend({turn}, {after}.r)" if turn else f"{after}.r") + "}"


def _repair_step() -> str:
    """The four states before a row from those after it, as SQL."""
    base, next_state, role = {}, (2, 2, 3, 2), {2: "user", 3: "assistant"}
    before = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    worst = "{'e': '900000000', 'r': []::VARCHAR[]}"
    for s in range(4):
        ways = [_edit(f"x{s}", "D", "2"), f"CASE WHEN NOT kill THEN {_edit(f'x{next_state[s]}', 'R', '1 + extra', f"'{role[next_state[s]]}:' || text")} ELSE {worst} END"]
        ways += [f"CASE WHEN NOT kill AND initial = '{i}' THEN {_edit(f'x{t}', 'K', 'extra', "role || ':' || text")} ELSE {worst} END" for i, t in before[s].items()]
        base[s] = f"list_sort([{', '.join(ways)}])[1]"
    steps = "SELECT conv_id, i, " + ", ".join(f"{base[s]} AS b{s}" for s in range(4)) + " FROM joined"
    inserted = f"SELECT conv_id, i, b0, b1, list_sort([b2, {_edit('b3', 'I', '5', "'assistant:'")}])[1] AS c2, list_sort([b3, {_edit('b2', 'I', '5', "'user:'")}])[1] AS c3 FROM ({steps})"
    return f"SELECT conv_id, i, list_sort([b0, {_edit('c2', 'I', '5', "'user:'")}])[1] AS x0, list_sort([b1, {_edit('c2', 'I', '5', "'user:'")}])[1] AS x1, c2 AS x2, c3 AS x3 FROM ({inserted})"


ORACLE_SQL = {
    "op2_exact_dedup": rf"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{_SPACES}', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.norm) AS text_sha256 FROM n JOIN g USING (norm)""",
    "quality_base_columns": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, [x FOR x IN regexp_split_to_array(coalesce(text, ''), '{_SPACES}') IF x <> ''] AS w FROM documents),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
k AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM k),
c AS (SELECT doc_id, count(DISTINCT i + step) AS n FROM r, range(3) AS s(step) WHERE r.n > 1 GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(c.n, 0) > 50 * len(w) AS base_failed
FROM d JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)""",
    "op6_substring_dedup": rf"""
WITH d AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(coalesce(text, ''), '{_SPACES}') IF x <> ''] AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
k AS (SELECT doc_id, i, w[i] AS word, CASE WHEN i + 34 <= len(w) THEN array_to_string(w[i:i + 34], ' ') END AS window_words FROM p),
r AS (SELECT doc_id, i, word, window_words IS NOT NULL AND count(*) OVER (PARTITION BY window_words) > 1 AS hit FROM k),
c AS (SELECT doc_id, i, word, coalesce(bool_or(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), false) AS gone FROM r),
s AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone), '') AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s USING (doc_id)""",
    "op7_line_dedup": r"""
WITH p AS (SELECT doc_id, coalesce(source, '') AS site, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents),
k AS (SELECT doc_id, site, i, l[i] AS line FROM p),
b AS (SELECT line FROM k WHERE trim(translate(line, chr(9) || chr(13), '  ')) <> '' GROUP BY line HAVING count(DISTINCT site) >= 5),
s AS (SELECT doc_id, count(*) AS n_lines, count(b.line) AS n_removed, coalesce(string_agg(k.line, chr(10) ORDER BY i) FILTER (WHERE b.line IS NULL), '') AS kept FROM k LEFT JOIN b USING (line) GROUP BY doc_id)
SELECT documents.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN s USING (doc_id)""",
    "op11_conversation_trie": rf"""
WITH {_CRC_TABLE},
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT conv_id, turn, substr(sha256(length(role) || ':' || role || text), 1, 32) AS id, length(text) AS chars FROM t),
c AS (SELECT conv_id, list({{'id': id, 'chars': chars}} ORDER BY turn NULLS FIRST, id) AS turns FROM k GROUP BY conv_id),
h AS (SELECT c.*, {_CRC.format("conv_id::VARCHAR")} % 6 AS h FROM c, crcs),
r AS (SELECT h.conv_id, list_concat(b.turns[1:h.h], h.turns[h.h + 1:]) AS seq FROM h LEFT JOIN c b ON b.conv_id = h.conv_id - h.conv_id % 100),
p AS (SELECT conv_id, d, len(seq) AS n, seq[d].chars AS chars, array_to_string(list_transform(seq[1:d], lambda x: x.id), '') AS k, array_to_string(list_transform(seq[1:d - 1], lambda x: x.id), '') AS up FROM (SELECT *, unnest(range(len(seq) + 1)) AS d FROM r)),
n AS (SELECT d, k, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends_sha256 FROM p GROUP BY d, k),
u AS (SELECT d - 1 AS d, up AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
s AS (SELECT a.d, a.k, count(*) FILTER (WHERE u.n_children IS NULL) AS n_leaves, sum((n.n_convs - 1) * coalesce(n.chars, 0)) AS saved FROM n LEFT JOIN u USING (d, k) JOIN p a ON a.conv_id = n.conv_id AND a.d <= n.d GROUP BY a.d, a.k)
SELECT n.conv_id, n.d::BIGINT AS depth, CASE WHEN n.d > 0 THEN a.conv_id END AS parent_conv_id, n.n_convs, coalesce(u.n_children, 0)::BIGINT AS n_children, s.n_leaves, s.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM n JOIN s USING (d, k) LEFT JOIN u USING (d, k) LEFT JOIN n a ON a.d = n.d - 1 AND a.k = n.up""",
    "op12_embedding_dedup": """
WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95),
r AS (SELECT vec_id AS id, vec_id AS root FROM e UNION SELECT l.b, r.root FROM r JOIN l ON r.id = l.a AND r.root < l.b),
c AS (SELECT id, min(root) AS component_id FROM r GROUP BY id),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT c.id AS vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, id = component_id AS kept FROM c LEFT JOIN n ON c.id = n.a""",
    "op13_conversation_repair": rf"""
WITH RECURSIVE {_CRC_TABLE},
o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
q AS (SELECT o.*, {_CRC.format("k")} % 20 AS kind FROM o, crcs),
g AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM q WHERE kind <> 0),
d AS (SELECT *, row_number() OVER w AS i, regexp_matches(text, '[^\x20\x09-\x0D]') AS filled, regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS ended, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again FROM g WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
f AS (SELECT conv_id, turn, role, text, i, substr(role, 1, 1) AS initial, NOT filled AS blank, filled AND again AS duplicate, filled AND NOT again AND NOT ended AS truncated, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) || substr(role, 1, 1) AS pair FROM d),
rows_of AS (SELECT *, blank OR duplicate AS kill, CASE WHEN truncated THEN 5 ELSE 0 END AS extra FROM f),
steps AS (
SELECT conv_id, max(i) + 1 AS i, {{'e': '000000000', 'r': []::VARCHAR[]}} AS x0, {{'e': '000000010II', 'r': ['user:', 'assistant:']}} AS x1, {{'e': '000000005I', 'r': ['assistant:']}} AS x2, {{'e': '000000000', 'r': []::VARCHAR[]}} AS x3 FROM rows_of GROUP BY conv_id
UNION ALL (WITH joined AS (SELECT steps.x0, steps.x1, steps.x2, steps.x3, rows_of.* FROM steps JOIN rows_of ON rows_of.conv_id IS NOT DISTINCT FROM steps.conv_id AND rows_of.i = steps.i - 1) {_repair_step()})),
best AS (SELECT conv_id, x0 FROM steps WHERE i = 1),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE duplicate) AS duplicate, count(*) FILTER (WHERE truncated) AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(substr(x0.e, 1, 9)::BIGINT, 0) AS cost, coalesce(substr(x0.e, 10), '') AS audit, sha256(coalesce(array_to_string(x0.r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id""",
}
