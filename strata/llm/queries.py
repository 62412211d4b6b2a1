"""The queries of this subpackage, and the SQL of those that SQL can express.

The results of operators 1 to 10 are beyond SQL (hash functions, iteration, learned models). The
parts of two that are not have queries of their own: the base columns of operator 10 and the
targets of operator 3.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .collocations import op11_phrase_collocations
from .gam import op9_quality_gam
from .hilbert import op1_hilbert_shards
from .html_crf import op8_crf_extraction
from .interactions import op12_filter_interactions
from .kneser_ney import op5_kneser_ney, op5_kneser_ney_trigram
from .line_runs import CAPITALS, op13_line_runs
from .mih import op2_multi_index_hashing
from .mixing import op3_entropy_mix, with_targets, word_count
from .ngram_join import op4_adaptive_ngram_join
from .packing import op7_complement_packing
from .rules import BASE, add_statistics, base_failed, op10_quality_rules
from .toxicity import op6_toxicity_lexicon


def rules_base_columns(spark, sf_dir: str):
    """The statistics of all documents that operator 10 tests, and the base rule."""
    featured = add_statistics(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    q = F.col("_q")
    return featured.select("doc_id", *(q[c].alias(c) for c in BASE), base_failed(q).alias("base_failed"))


def mix_targets(spark, sf_dir: str):
    """The size and the target (to a thousandth of a word) of each source in operator 3's mix."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", word_count(F.col("text")).alias("size"))
    sources = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    return with_targets(sources).select("source", "source_size", F.round("target", 3).alias("target"))


_LOWER = f"'{CAPITALS}', '{CAPITALS.lower()}'"
_WORDS = r"[^\x20\x09-\x0D]+"

QUERIES = {
    "op1_hilbert_shards": op1_hilbert_shards,
    "op2_multi_index_hashing": op2_multi_index_hashing,
    "op3_entropy_mix": op3_entropy_mix,
    "op4_adaptive_ngram_join": op4_adaptive_ngram_join,
    "op5_kneser_ney": op5_kneser_ney,
    "op5_kneser_ney_trigram": op5_kneser_ney_trigram,
    "op6_toxicity_lexicon": op6_toxicity_lexicon,
    "op7_complement_packing": op7_complement_packing,
    "op8_crf_extraction": op8_crf_extraction,
    "op9_quality_gam": op9_quality_gam,
    "op10_quality_rules": op10_quality_rules,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_filter_interactions": op12_filter_interactions,
    "op13_line_runs": op13_line_runs,
    "rules_base_columns": rules_base_columns,
    "mix_targets": mix_targets,
}

ORACLES: dict[str, str] = {
    "rules_base_columns": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORDS}')) AS lines FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
p AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, range(0, 8) x(k) GROUP BY doc_id),
s AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM d LEFT JOIN p USING (doc_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s""",
    # The sources before a point, in the order of twice their size by weight, are full; the level of the others follows.
    "mix_targets": rf"""
WITH s AS (SELECT source, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '{_WORDS}'))) AS BIGINT) AS source_size FROM documents GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight FROM s),
a AS (SELECT x.source AS at, 2.0 * any_value(x.source_size) / any_value(x.weight) AS level, (1.5 * (SELECT sum(source_size) FROM s) - sum(CASE WHEN y.source_size / y.weight < x.source_size / x.weight THEN 2.0 * y.source_size ELSE 0 END)) / sum(CASE WHEN y.source_size / y.weight < x.source_size / x.weight THEN 0 ELSE y.weight END) AS open_level FROM w x, w y GROUP BY x.source),
l AS (SELECT min(open_level) AS final FROM (SELECT open_level FROM a WHERE level > open_level ORDER BY level LIMIT 1))
SELECT source, source_size, round(greatest(0, least(2.0 * source_size, coalesce(final * weight, 2.0 * source_size))), 3) AS target FROM w, l""",
    "op11_phrase_collocations": rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), {_LOWER}), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k AS size, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 6) x(k) WHERE len(w) >= k)),
t AS (SELECT lang, count(*) AS n FROM g WHERE size = 1 GROUP BY lang),
f AS (SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, size, phrase, f AS a, k, array_to_string(w[:k], ' ') AS first, array_to_string(w[k + 1:], ' ') AS rest FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, size)) AS k FROM f)),
s AS (SELECT c.lang, c.size, c.phrase, a, k, x.f AS l, y.f AS r, n, CAST(1000 * CAST(a AS HUGEINT) * n // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score FROM c JOIN f x ON x.lang = c.lang AND x.phrase = first JOIN f y ON y.lang = c.lang AND y.phrase = rest JOIN t ON t.lang = c.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
e AS (SELECT lang, array_to_string(CASE WHEN d = 0 THEN w[:size - 1] ELSE w[2:] END, ' ') AS phrase, max(f) AS longer FROM (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size > 2), range(0, 2) y(d) GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM b WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.lang = b.lang AND e.phrase = b.phrase AND 100 * longer >= 100 * a) QUALIFY rank <= 2000""",
    # A document's failures are a word over ABCDE; '_' keeps a class of characters from being empty.
    "op12_filter_interactions": rf"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
m AS (SELECT t, min(doc_id) AS first FROM t GROUP BY t),
f AS (SELECT part, len(w) < 200 AS A, 100 * len(list_distinct(w)) < 50 * len(w) AS B, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS C, regexp_matches(t, '[#$%&*|]') AS D, coalesce(doc_id > first, false) AS E,
 doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic FROM t JOIN m USING (t)),
s AS (SELECT part, (CASE WHEN A THEN 'A' ELSE '' END) || (CASE WHEN B THEN 'B' ELSE '' END) || (CASE WHEN C THEN 'C' ELSE '' END) || (CASE WHEN D THEN 'D' ELSE '' END) || (CASE WHEN E THEN 'E' ELSE '' END) AS failed, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
p AS (SELECT filter_order, step, filter_order[step] AS filter, filter_order[:step - 1] AS before FROM o, range(1, 6) r(step)),
r AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, filter,
 sum(n) FILTER (NOT regexp_matches(failed, '[' || before || filter || ']')) AS kept,
 sum(n) FILTER (contains(failed, filter) AND (before = '' OR NOT regexp_matches(failed, '[' || before || '_]'))) AS removed,
 sum(n) FILTER (contains(failed, filter)) AS fails, sum(n) FILTER (failed = filter) AS alone,
 sum(good) FILTER (contains(failed, filter) AND NOT regexp_matches(failed, '[' || before || '_]')) AS good,
 sum(toxic) FILTER (contains(failed, filter) AND NOT regexp_matches(failed, '[' || before || '_]')) AS toxic FROM s, p GROUP BY ALL)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(fails, 0) - coalesce(removed, 0) AS BIGINT) AS redundant, CAST(coalesce(alone, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic, 0) AS BIGINT) AS toxic_lost, CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM r""",
    "op13_line_runs": rf"""
WITH l AS (SELECT doc_id, unnest(range(1, len(x) + 1)) AS pos, unnest(x) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
k AS (SELECT doc_id, pos, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), {_LOWER}) AS key FROM l),
c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (c.key IS NOT NULL AND doc_id <> keeper) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (c.key IS NULL OR doc_id = keeper), '')) AS kept_sha256
FROM k LEFT JOIN c USING (key) GROUP BY doc_id""",
}
