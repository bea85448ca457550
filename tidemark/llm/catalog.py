"""The queries of this subpackage: one opN_<name> per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import dual_tree, heap_codes, licenses, line_dedup, mixing, ngram_join, packing, ppm, quality, rules, suffix_dedup, topk, toxicity
from tidemark.llm.common import table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.packed_digests(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))[0]


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.dedup(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply_rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance2")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dual_tree.cluster(table(spark, sf_dir, "embeddings"))[0]


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heap_codes.reported(table(spark, sf_dir, "embeddings"))


def op13_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.lm_scores(table(spark, sf_dir, "documents"))


QUERIES = (
    op1_best_fit_packing, op2_exact_topk, op3_toxicity, op4_ngram_join, op5_line_dedup, op6_quality_classifier, op7_suffix_dedup, op8_mixing, op9_license_scan, op10_quality_rules,
    op11_centroid_clustering, op12_vector_codes, op13_lm_scores,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


OP2_SQL = """
with sound as (
    select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) v from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
scored as (
    select q.vec_id query_id, c.vec_id, cast(list_inner_product(cast(q.v as double[]), cast(c.v as double[])) as bigint) score
    from sound q join sound c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 50 = 0
)
select query_id, cast(rank as integer) rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) rank from scored) where rank <= 5
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical_sql(text: str) -> str:
    out = f"regexp_replace(regexp_replace(lower({text}), {_quoted(licenses.COPYRIGHT)}, ' ', 'g'), {_quoted(licenses.BULLET)}, ' ', 'g')"
    for a, b in licenses.SPELLINGS:
        out = f"replace({out}, {_quoted(a)}, {_quoted(b)})"
    out = f"trim(regexp_replace({out}, {_quoted(licenses.PUNCTUATION)}, ' ', 'g'))"
    for a, b in licenses.HOLDERS:
        out = f"regexp_replace({out}, {_quoted(a)}, {_quoted(b)}, 'g')"
    return out


def op9_sql() -> str:
    """No filter by trigger words. Paragraphs are runs of lines of one kind, counted by a window over the lines, and runs of them as long as the text is."""
    values = ", ".join(f"({_quoted(k)}, {_quoted(t)})" for k, t in licenses.notices())
    runs = " union ".join(f"select rid, doc_id, array_to_string(list_slice(parts, i, i + {n - 1}), ' ') unit from (select rid, doc_id, parts, unnest(range(1, len(parts) - {n - 2})) i from parts)" for n in (1, *licenses.LENGTHS))
    smaller = " union ".join(f"select rid, doc_id, {_canonical_sql('unit')} unit from (select rid, doc_id, unnest(regexp_split_to_array(text, {_quoted(sep)})) unit from base)" for sep in licenses.UNITS)
    return f"""
with known as (
    select md5({_canonical_sql("text")}) digest, min(license) license from (values {values}) v(license, text) group by 1
),
base as materialized (select row_number() over () rid, doc_id, replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)) text from documents),
lines as (select rid, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) i from base),
kinds as (select *, case when starts_with(line, '#!') or not regexp_matches(line, '[\\p{{L}}\\p{{N}}]') then 0 when regexp_matches(line, {_quoted("^" + licenses.MARK)}) then 2 else 1 end kind from lines),
turns as (select *, case when kind is distinct from lag(kind) over (partition by rid order by i) then 1 else 0 end turn from kinds),
places as (select *, sum(turn) over (partition by rid order by i) place from turns),
paragraphs as (select rid, place, string_agg(line, chr(10) order by i) unit from places where kind > 0 group by rid, place),
parts as materialized (
    select rid, doc_id, regexp_matches(text, {_quoted(licenses.TRIGGER)}) near, coalesce(parts, []) parts
    from base left join (select rid, list_filter(list({_canonical_sql("unit")} order by place), lambda p: p <> '') parts from paragraphs group by rid) using (rid)
),
whole as (select rid, doc_id, near, md5(array_to_string(parts, ' ')) text_digest, md5(array_to_string(list_slice(parts, 2, len(parts)), ' ')) body from parts),
units as (select rid, doc_id, text_digest digest from whole union select rid, doc_id, body from whole union select rid, doc_id, md5(unit) from ({runs} union {smaller})),
hits as (select u.rid, u.doc_id, u.digest, k.license from units u join known k using (digest))
select w.doc_id, case when w.near then w.text_digest end text_digest,
    coalesce(min(case when h.digest = w.text_digest then h.license end), min(case when h.digest = w.body then h.license end)) whole_license,
    coalesce(string_agg(distinct h.license, ',' order by h.license), '') licenses, count(h.license) n_units
from whole w left join hits h using (rid) group by w.rid, w.doc_id, w.near, w.text_digest
"""


WHOLE_SQL = """whole as materialized (
    select row_number() over () rid, vec_id, label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) p from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
)"""
#: The floor of an exact quotient of two whole numbers of which n is positive.
FLOORED = "(sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*)"
#: A squared distance of two lists of whole numbers.
SQUARED = "cast(list_inner_product(cast({a} as double[]), cast({a} as double[])) - 2 * list_inner_product(cast({a} as double[]), cast({b} as double[])) + list_inner_product(cast({b} as double[]), cast({b} as double[])) as bigint)"


def op11_sql(k: int = dual_tree.CLUSTERS, rounds: int = dual_tree.ROUNDS, dim: int = dual_tree.DIM, seed: int = dual_tree.SEED) -> str:
    """Lloyd's rounds one after the other: all distances, then the floored means."""
    steps = []
    for i in range(rounds + 1):
        away = SQUARED.format(a="v.p", b="c.p")
        steps.append(f"a{i} as materialized (select rid, k, d from (select rid, k, d, row_number() over (partition by rid order by d, k) r from (select rid, k, {away} d from kept v cross join c{i} c)) where r = 1)")
        if i < rounds:
            steps.append(f"c{i + 1} as materialized (select k, list(x order by place) p from (select k, place, {FLOORED} x from long join a{i} using (rid) group by k, place) group by k union all select k, p from c{i} where k not in (select k from a{i}))")
    return f"""
with {WHOLE_SQL},
kept as materialized (select * from whole where len(p) = {dim}),
long as materialized (select rid, unnest(p) x, generate_subscripts(p, 1) place from kept),
c0 as materialized (select k, p from (select p, row_number() over (order by sha256('{seed}:' || vec_id), p) - 1 k from kept where vec_id is not null) where k < {k}),
{", ".join(steps)}
select vec_id, cast(a.k as integer) as cluster, d distance, cast(sum(d) over (partition by a.k) as bigint) cluster_inertia, cast(sum(d) over () as bigint) inertia, sha256(array_to_string(c.p, ',')) centroid_sha256
from a{rounds} a join kept using (rid) join c{rounds} c on a.k = c.k
"""


def op12_sql(parts: int = heap_codes.PARTS, entries: int = heap_codes.ENTRIES, rounds: int = heap_codes.ROUNDS) -> str:
    steps = []
    for i in range(rounds + 1):
        away = SQUARED.format(a="v.p", b="b.p")
        steps.append(f"a{i} as materialized (select rid, part, j, d from (select rid, part, j, d, row_number() over (partition by rid, part order by d, j) r from (select rid, part, j, {away} d from cut v join b{i} b using (part))) where r = 1)")
        if i < rounds:
            steps.append(f"b{i + 1} as materialized (select part, j, list(x order by place) p from (select part, j, place, {FLOORED} x from long join a{i} using (rid, part) group by part, j, place) group by part, j union all select part, j, p from b{i} where (part, j) not in (select part, j from a{i}))")
    return f"""
with {WHOLE_SQL},
cut as materialized (select rid, vec_id, label, part, list_slice(p, part * (len(p) // {parts}) + 1, (part + 1) * (len(p) // {parts})) p from whole cross join range({parts}) r(part)),
long as materialized (select rid, part, unnest(p) x, generate_subscripts(p, 1) place from cut),
b0 as materialized (select part, j, p from (select part, p, row_number() over (partition by part order by vec_id, p) - 1 j from cut where vec_id is not null) where j < {entries}),
{", ".join(steps)},
books as (select sha256(string_agg(array_to_string(p, ','), ',' order by part, j)) digest from b{rounds}),
coded as (select rid, string_agg(lpad(lower(to_hex(j)), 2, '0'), '' order by part) code, cast(sum(d) as bigint) error from a{rounds} group by rid)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) label_error, digest codebooks_sha256
from coded join whole using (rid) cross join books
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_topk": OP2_SQL, "op9_license_scan": op9_sql(), "op11_centroid_clustering": op11_sql(), "op12_vector_codes": op12_sql()}
