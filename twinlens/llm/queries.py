"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from twinlens.llm import alignment, decontaminate, jaccard, licences, mixing, packing, pitman_yor, quality_knn, quality_rules, repair, secrets, toxicity, vector_codes
from twinlens.session import new_folder

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(documents(spark, sf_dir))


def tokenizer(name: str) -> str:
    """A public vocabulary file; installed on every machine of the cluster."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(documents(spark, sf_dir))


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(documents(spark, sf_dir))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "tokens")
    repair.write_token_files(documents(spark, sf_dir), folder, tokenizer("byte_bpe_50k.json"))
    return repair.read_documents(spark, folder)


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score(documents(spark, sf_dir))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir))


def op9_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_knn.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).taken()


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


QUERIES: dict[str, Query] = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_decontamination": op2_decontamination,
    "op3_secrets": op3_secrets,
    "op4_licences": op4_licences,
    "op5_token_files": op5_token_files,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_packing": op7_packing,
    "op8_quality_rules": op8_quality_rules,
    "op9_quality_knn": op9_quality_knn,
    "op10_toxicity": op10_toxicity,
    "op11_vector_codes": op11_vector_codes,
    "op12_mixing": op12_mixing,
    "op13_alignment": op13_alignment,
}

# Lower-case A-Z only, then split at the white space of the word definition.
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS_SQL = f"regexp_extract_all({_LOWERED}, '[^\\x20\\x09-\\x0D]+')"

JACCARD_CTES = f"""
w AS (SELECT doc_id, {WORDS_SQL} AS w FROM {{source}}),
sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: w[i:i+4])
                                      WHEN len(w) > 0 THEN [w] ELSE [] END) AS s FROM w),
n AS (SELECT w.doc_id, count(s) AS n FROM w LEFT JOIN sh USING (doc_id) GROUP BY w.doc_id),
ids AS (SELECT doc_id, dense_rank() OVER (ORDER BY s) AS s FROM sh),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM ids a JOIN ids b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a)
"""

def _decontamination_sql() -> str:
    """Seeds as lists of words; the best run is the largest rise of the running score on a diagonal."""
    d = decontaminate
    seeds = []
    for number, mask in enumerate(d.MASKS):
        picked = ", ".join(f"w[i + {k}]" for k, one in enumerate(mask) if one == "1")
        seeds.append(
            f"SELECT id, {number} AS m, i, [{picked}] AS s FROM "
            f"(SELECT id, w, unnest(range(1, len(w) - {len(mask) - 2})) AS i FROM {{0}} WHERE len(w) >= {len(mask)})"
        )
    longest = max(map(len, d.MASKS))
    whole = [
        f"SELECT id, {100 + n} AS m, i, w[i:i + {n - 1}] AS s FROM "
        f"(SELECT id, w, unnest(range(1, len(w) - {n - 2})) AS i FROM {{0}} WHERE len(w) >= {n})"
        for n in range(d.LEAST_WORDS, longest)
    ]
    both = " UNION ALL ".join([*seeds, *whole])
    # whole seeds come from items of that length alone
    items = " UNION ALL ".join([*seeds, *(x.replace(">=", "=") for x in whole)]).replace("{0}", "item")
    return f"""
WITH doc AS (SELECT doc_id AS id, {WORDS_SQL} AS w FROM documents),
item AS (SELECT DISTINCT item_id AS id, {WORDS_SQL} AS w FROM benchmark WHERE len({WORDS_SQL}) >= {d.LEAST_WORDS}),
a AS ({both.replace("{0}", "doc")}), b AS ({items}),
line AS (SELECT DISTINCT a.id AS doc_id, b.id AS item_id, a.i - b.i AS d FROM a JOIN b ON a.m = b.m AND a.s = b.s),
pos AS (SELECT doc_id, item_id, d, doc.w AS said, item.w AS asked,
  unnest(range(greatest(1, 1 - d), least(len(item.w), len(doc.w) - d) + 1)) AS j
  FROM line JOIN doc ON doc.id = doc_id JOIN item ON item.id = item_id),
step AS (SELECT doc_id, item_id, d, len(asked) AS n, j, said[j + d] = asked[j] AS same,
  sum(CASE WHEN said[j + d] = asked[j] THEN 1 ELSE -{d.PENALTY} END) OVER (PARTITION BY doc_id, item_id, d ORDER BY j) AS p FROM pos),
low AS (SELECT *, least(0, coalesce(min(p) OVER (PARTITION BY doc_id, item_id, d ORDER BY j ROWS UNBOUNDED PRECEDING), 0)) AS q FROM step),
best AS (SELECT doc_id, item_id, max(p - q) AS score FROM low GROUP BY doc_id, item_id, d, n HAVING max(p - q) >= least({d.ENOUGH}, n) OR 100 * count_if(same) >= {d.SHARE} * n),
hit AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, max(score) AS score FROM best GROUP BY doc_id)
SELECT doc_id, n_items IS NOT NULL AS contaminated, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(score, 0)::INT AS score
FROM documents LEFT JOIN hit USING (doc_id)
"""


_RAW_WORDS = "regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')"
_QUALITY_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, {_RAW_WORDS} AS w, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS l FROM t),
tri AS (SELECT doc_id, i, w[i:i + 2] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
twice AS (SELECT doc_id, s FROM tri GROUP BY doc_id, s HAVING count(*) > 1),
inside AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM tri JOIN twice USING (doc_id, s), (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
c AS (SELECT w.doc_id, t, w, l, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
  coalesce(inside.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN inside USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols * 4 > n_words OR (n_dup_lines >= 3 AND n_dup_lines * 10 > len(l) * 3) OR word_chars > 15 * n_words OR word_chars * 2 < 3 * n_words
    OR length(regexp_replace(t, '[^A-Z]', '', 'g')) * 10 > word_chars * 4 OR length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) * 10 < word_chars * 6
    OR (len(list_distinct(w)) * 20 < n_words AND len(list_distinct(w)) * len(list_distinct(w)) < 2 * n_words)) AS kept
FROM f
"""

# The line of each source is read from its start until the quota is full, whole passes first.
_MIXING_SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
s AS (SELECT doc_id, source, len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || '|' || md5(t)) AS o FROM d),
n AS (SELECT source, sum(size)::BIGINT AS source_size, 1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS w FROM s GROUP BY source),
r AS (SELECT *, {mixing.PASSES} * source_size AS most, {mixing.PASSES} * source_size / w AS ratio, sum(source_size) OVER ()::BIGINT AS total FROM n),
q AS (SELECT *, (sum(most) OVER () - sum(most) OVER (ORDER BY ratio DESC))::BIGINT AS full_, sum(w) OVER (ORDER BY ratio DESC)::BIGINT AS open_ FROM r),
f AS (SELECT full_, open_, total FROM q WHERE (total - full_) / open_ <= ratio ORDER BY ratio LIMIT 1),
g AS (SELECT source, source_size, least(most::DOUBLE, ((f.total - f.full_) * w)::DOUBLE / f.open_) AS target FROM r, f),
k AS (SELECT *, floor(target + 0.5)::BIGINT AS quota FROM g),
p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY o, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM s)
SELECT p.doc_id, p.size, source_size, target,
  CASE WHEN size = 0 THEN 0 ELSE (quota // source_size) * size + greatest(0, least(size, quota % source_size - start)) END::BIGINT AS taken
FROM p JOIN k ON p.source IS NOT DISTINCT FROM k.source
"""

def _vector_codes_sql() -> str:
    """Every assignment by a full scan of the codebook; one pair of tables per round."""
    v = vector_codes
    square = "list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = [
        f"i AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * {v.SCALE})::BIGINT) AS e FROM embeddings "
        "WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"p AS MATERIALIZED (SELECT vec_id, q, e[q * len(e) // {v.PARTS} + 1:(q + 1) * len(e) // {v.PARTS}] AS x FROM i, (SELECT unnest(range({v.PARTS})) AS q))",
        f"b0 AS MATERIALIZED (SELECT q, row_number() OVER (PARTITION BY q ORDER BY vec_id) - 1 AS j, x FROM p QUALIFY j < {v.ENTRIES})",
    ]
    for r in range(v.ROUNDS + 1):
        steps.append(
            f"a{r} AS MATERIALIZED (SELECT vec_id, p.q, arg_min(j, d * {v.ENTRIES} + j) AS j, min(d) AS d FROM "
            f"(SELECT vec_id, p.q, b.j, {square} AS d FROM p JOIN b{r} b ON p.q = b.q) p GROUP BY vec_id, p.q)"
        )
        if r < v.ROUNDS:
            steps += [
                f"m{r} AS MATERIALIZED (SELECT q, j, list(m ORDER BY k) AS x FROM (SELECT q, j, k, floor(sum(x) / count(*))::BIGINT AS m FROM "
                f"(SELECT a.q, a.j, unnest(p.x) AS x, unnest(range(len(p.x))) AS k FROM a{r} a JOIN p USING (vec_id, q)) GROUP BY q, j, k) GROUP BY q, j)",
                f"b{r + 1} AS MATERIALIZED (SELECT b.q, b.j, coalesce(m.x, b.x) AS x FROM b{r} b LEFT JOIN m{r} m USING (q, j))",
            ]
    last = v.ROUNDS
    return f"""
WITH {", ".join(steps)},
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY q, j)) AS codebooks_sha256 FROM b{last}),
c AS (SELECT vec_id, string_agg(printf('%02x', j), '' ORDER BY q) AS code, sum(d)::BIGINT AS error FROM a{last} GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM c JOIN i USING (vec_id), h
"""


SQL: dict[str, str] = {
    "op1_jaccard_join": f"""
WITH RECURSIVE {JACCARD_CTES.format(source="documents")}
SELECT n.doc_id, n.n AS n_shingles, (SELECT min(b) FROM reach WHERE reach.a = n.doc_id) AS component_id FROM n
""",
    "op2_decontamination": _decontamination_sql(),
    "op8_quality_rules": _QUALITY_SQL,
    "op11_vector_codes": _vector_codes_sql(),
    "op12_mixing": _MIXING_SQL,
}
