"""Registered queries for the relational operators, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuskit.functions import text as T
from corpuskit.operators import dedup, evalmetrics, htmltext, index, instructions, pysource, quality, reports, setsim, sft, splits, tokens, windows
from corpuskit.plans import corpus
from corpuskit.runtime import cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(*tables: str, sql: str | None = None):
    """Registers a function of the named tables' DataFrames under its own name."""

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(*[spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables])

        QUERIES[fn.__name__] = run
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


# Fragments of SQL that several queries share.
_NORM = r"regexp_replace(regexp_replace(regexp_replace({}, '\r\n?', chr(10), 'g'), '\x00+$', ''), '[\x00-\x08\x0B-\x1F]', '', 'g')"
_NORM_TEXT = _NORM.format("text")
_LOOSE = r"trim(regexp_replace(lower(regexp_replace({}, '#[^\n]*', '', 'g')), '[\s\x0B\x{{1c}}-\x{{1f}}\x85\p{{Z}}]+', ' ', 'g'))"
_LICENSE = (
    "case regexp_replace(lower(license), '[^a-z0-9]+', '', 'g') "
    + " ".join(f"when '{k}' then '{v}'" for k, v in T.LICENSE_ALIASES.items())
    + " end"
)
_SUFFIX = r"lower(regexp_extract(regexp_extract(replace(path, '\', '/'), '([^/]*)$', 1), '[^.](\.[^.]+)$', 1))"
_MINIFIED = (
    "(list_max(list_transform(string_split(regexp_replace({0}, '\\n$', ''), chr(10)), lambda x: length(x))) > 5000 or "
    "(len(string_split(regexp_replace({0}, '\\n$', ''), chr(10))) <= 3 and "
    "list_avg(list_transform(string_split(regexp_replace({0}, '\\n$', ''), chr(10)), lambda x: length(x))) > 1000))"
)


_TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+(?:''[\p{L}\p{M}\p{N}]+)*|[^\s\x0B\x{1c}-\x{1f}\p{Z}\x{85}\p{L}\p{M}\p{N}]')"
_VOCABULARY = f"""t as (select unnest({_TOKENS}) as token from documents), n as (select token, count(*) as frequency from t group by 1 having count(*) >= 2),
    v as (select token, row_number() over (order by frequency desc, token) + 4 as token_id from n qualify row_number() over (order by frequency desc, token) <= 1995)"""
_IDS = f"""{_VOCABULARY}, w as (select doc_id, {_TOKENS} as a from documents where text is not null),
    p as (select doc_id, unnest(a) as token, generate_subscripts(a, 1) as pos from w), e as (select doc_id, list(coalesce(token_id, 1)::int order by pos) as ids from p left join v using (token) group by 1)"""


def _contains(c: str, needles) -> str:
    return "(" + " or ".join(f"contains({c}, '{n}')" for n in needles) + ")"


# Projections


@query("code_records", sql=f"select record_id, sha256({_NORM_TEXT}) as h, length({_NORM_TEXT}) as n from code_records where text is not null")
def normalize_source(r):
    t = T.normalize_source(F.col("text"))
    return r.filter("text is not null").select("record_id", F.sha2(t, 256).alias("h"), F.length(t).cast("bigint").alias("n"))


@query(
    "code_records",
    sql=f"""select record_id, {_LICENSE} as license_id, {_SUFFIX} as suffix,
        case when {_SUFFIX} = '.py' then 'python_code' else 'technical_text' end as content_type
        from code_records where path is not null""",
)
def path_and_license_columns(r):
    p = F.col("path")
    return r.filter("path is not null").select(
        "record_id", T.normalize_license(F.col("license")).alias("license_id"), T.suffix(p).alias("suffix"), T.content_type(p).alias("content_type")
    )


@query(
    "documents",
    sql=r"""select doc_id, len(list_filter(regexp_split_to_array(replace(text, '_', ' '), '[\s\x0B\x{1c}-\x{1f}\x85\p{Z}]+'),
        lambda x: regexp_matches(x, '[\p{L}\p{N}]'))) as words from documents where text is not null""",
)
def word_counts(d):
    return d.filter("text is not null").select("doc_id", T.word_count(F.col("text")).cast("bigint").alias("words"))


@query("repositories", sql=r"""select source_id, trim(regexp_replace(lower(regexp_replace(repo_name, '([a-z0-9])([A-Z])', '\1_\2', 'g')), '[^a-z0-9]+', ' ', 'g')) as words from repositories""")
def identifier_words(r):
    return r.select("source_id", T.split_identifier(F.col("repo_name")).alias("words"))


@query("documents")
def documentation_text(d):
    return d.select("doc_id", htmltext.documentation_text(F.col("text")).alias("cleaned"))


@query("eval_items", sql="select item_id, sha256(concat(prompt, chr(0), coalesce(answer, ''))) as h, length(prompt) as n from eval_items")
def composite_hash(e):
    return e.select("item_id", T.text_hash(F.col("prompt"), F.coalesce("answer", F.lit(""))).alias("h"), F.length("prompt").cast("bigint").alias("n"))


# Filters


#: The cleaner's verdict over columns t (normalized) and path.
_CLEAN = f"""case
        when octet_length(encode(t)) < 80 then 'too_short' when octet_length(encode(t)) > 2000000 then 'too_large'
        when {_contains('lower(path)', quality.GENERATED_NAMES)} then 'generated_file' when t is null then 'invalid_utf8'
        when trim(regexp_replace(t, '\\s+', '', 'g')) = '' then 'empty_file'
        when {_contains("lower(array_to_string(string_split(t, chr(10))[1:10], chr(10)))", quality.GENERATED_MARKERS)} then 'generated_file'
        when {_MINIFIED.format('t')} then 'minified_file' else 'accepted' end"""


@query("code_records", sql=f"with t as (select record_id, coalesce(path, '') as path, {_NORM_TEXT} as t from code_records) select record_id, {_CLEAN} as reason from t")
def clean_reasons(r):
    t = T.normalize_source(F.col("text"))
    return r.select("record_id", t.alias("t"), "path").select("record_id", quality.clean_reason(F.col("t"), F.col("path")).alias("reason"))


@query(
    "code_records",
    sql=f"""with t as (select record_id, coalesce(replace(path, '\\', '/'), '') as p, path, {_LICENSE} as lic, {_NORM_TEXT} as t from code_records),
    v as (select record_id, lic, t, case when t is null then 'missing_content'
        when regexp_replace(t, '\\s+', '', 'g') = '' then 'empty_content'
        when octet_length(encode(t)) < 200 then 'too_small' when octet_length(encode(t)) > 250000 then 'too_large'
        when not (regexp_matches(lower(p), '[^/.]\\.py$') or (starts_with(t, '#!') and contains(lower(string_split(t, chr(10))[1]), 'python'))) then 'not_python'
        when list_has_any(string_split(lower(p), '/'), {list(quality.REJECTED_PARTS)!r})
            or {_contains('lower(p)', ['generated', 'minified', '.min.py', 'bundle.py'])} then 'rejected_path'
        when {_contains("lower(substr(t, 1, 2000))", quality.GENERATED_MARKERS[1:])} then 'autogenerated'
        when contains(t, chr(65533)) then 'binary_like'
        when {_MINIFIED.format('t')} then 'minified'
        when not {_contains('t', quality.PYTHON_SIGNS)} then 'low_python_signal'
        when lic is null then 'unknown_license' else 'accepted' end as reason from t)
    select record_id, reason, lic as license, sha256(t) as content_hash, octet_length(encode(t)) as byte_count,
        case when ('0x' || substr(sha256(t), 1, 8))::bigint % 10000 < 200 then 'validation' else 'train' end as split from v""",
)
def code_record_filter(r):
    return quality.filtered_code_records(r)


@query(
    "documents",
    sql=r"""with t as (select doc_id, text from documents where text is not null)
    select doc_id,
      round(list_sum(list_append(list_transform(regexp_extract_all(text, '\b[A-Za-z0-9+/]{80,}={0,2}\b'), lambda x: length(x)), 0)) / greatest(1, length(text)), 6) as base64,
      round(list_sum(list_append(list_transform(regexp_extract_all(text, '\b(?:[0-9a-fA-F]{2}\s*){40,}\b'), lambda x: length(x)), 0)) / greatest(1, length(text)), 6) as hex
    from t""",
)
def encoded_shares(d):
    t = F.col("text")
    return d.filter("text is not null").select("doc_id", F.round(quality.base64_share(t), 6).alias("base64"), F.round(quality.hex_share(t), 6).alias("hex"))


@query(
    "documents",
    sql="""with c as (select doc_id, unnest(string_split(text, '')) as c from documents where text is not null and text <> ''),
    n as (select doc_id, c, count(*) as k from c group by 1, 2),
    e as (select doc_id, sum(k) as s, sum(k * log2(k)) as x from n group by 1)
    select d.doc_id, round(coalesce(log2(s) - x / s, 0), 6) as entropy from documents d left join e using (doc_id) where text is not null""",
)
def character_entropy(d):
    return quality.entropy(d, "doc_id", "text").select("doc_id", F.round("entropy", 6).alias("entropy"))


@query(
    "documents",
    sql=r"""with l as (select doc_id, regexp_replace(unnest(string_split(text, chr(10))), '^[\s\x0B\x{1c}-\x{1f}\x85\p{Z}]+|[\s\x0B\x{1c}-\x{1f}\x85\p{Z}]+$', '', 'g') as line from documents where text is not null),
    n as (select doc_id, line, count(*) as n from l where line <> '' group by 1, 2),
    s as (select doc_id, sum(case when n > 3 then n else 0 end) / sum(n) as r from n group by 1)
    select d.doc_id, round(coalesce(r, 0.0), 6) as repeated_share from documents d left join s using (doc_id) where text is not null""",
)
def repeated_lines(d):
    return quality.repeated_lines(d, "doc_id", "text").select("doc_id", F.round("repeated_share", 6).alias("repeated_share"))


_SCORE = (
    " + ".join(f"regexp_matches(lower(text), '\\b{t}\\b')::int" for t in quality.TECHNICAL_TERMS)
    + r""" + least(3, len(regexp_extract_all(text, '(?m)`[^`]+`|```|::|^\s{4,}\S'))) + least(3, len(regexp_extract_all(text, '\b[a-zA-Z_][a-zA-Z0-9_]*\(')))"""
)


@query("documents", sql=f"select doc_id, {_SCORE} as score from documents where text is not null")
def technical_scores(d):
    return d.filter("text is not null").select("doc_id", quality.technical_score(F.col("text")).alias("score"))


_MEASURES = f"""e as ({SQL['character_entropy']}), b as ({SQL['encoded_shares']}), l as ({SQL['repeated_lines']}), s as ({SQL['technical_scores']})"""


@query(
    "documents",
    sql=f"""with {_MEASURES} select case when entropy < 2.5 then 'low_entropy' when base64 > 0.35 then 'base64_blob' when hex > 0.35 then 'hex_dump'
        when repeated_share > 0.35 then 'repeated_sequences' when score < 2 then 'low_technical_content' else 'accepted' end as reason, count(*) as documents
        from e join b using (doc_id) join l using (doc_id) join s using (doc_id) group by 1""",
)
def quality_report(d):
    m = quality.measures(d, "doc_id", "text")
    reason = quality.quality_reason({c: F.col(c) for c in ("entropy", "base64", "hex", "repeated", "score")}, F.lit("technical_text"))
    return m.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("documents"))


@query("documents", sql="select doc_id, md5(case when length(text) > 400 then left(text, 200) || chr(10) || right(text, 200) else text end) as h from documents where text is not null")
def quality_samples(d):
    return d.filter("text is not null").select("doc_id", F.md5(quality.quality_sample(F.col("text"), 400)).alias("h"))


# Deduplication


@query(
    "documents",
    sql=f"""with k as (select doc_id, sha256(text) as e, sha256({_LOOSE.format('text')}) as l from documents),
    f as (select l, min(doc_id) as first, arg_min(e, doc_id) as fe from k where l is not null group by 1)
    select doc_id, case when first < doc_id then case when fe = e then 'exact_duplicate' else 'normalized_duplicate' end end as reason,
        case when first < doc_id then first end as duplicate_of from k left join f using (l)""",
)
def two_level_duplicates(d):
    return dedup.two_level(d, "doc_id", F.sha2("text", 256), F.sha2(T.normalize_for_dedup(F.col("text")), 256))


@query(
    "documents",
    sql="""select sha256(text) as h, min(doc_id) as canonical, count(*) as rows, count(*) - 1 as excess from documents
        where text is not null group by 1 having count(*) > 1""",
)
def duplicate_groups(d):
    return dedup.groups(d.select("doc_id", F.sha2("text", 256).alias("h")), "h", "doc_id")


@query(
    "source_manifest",
    sql="""select record_id, stored_path, content_sha256, source.id as source_id, count(*) as deliveries,
        min(collection_timestamp) as first_seen from source_manifest group by all""",
)
def manifest_deliveries(m):
    return m.groupBy("record_id", "stored_path", "content_sha256", F.col("source.id").alias("source_id")).agg(
        F.count(F.lit(1)).alias("deliveries"), F.min("collection_timestamp").alias("first_seen")
    )


@query(
    "code_records",
    sql="""with k as (select record_id, lower(trim(repo_name)) as repo, replace(path, '\\', '/') as path, ingested_at from code_records
        where repo_name is not null and path is not null)
    select repo, path, arg_max(record_id, (ingested_at, record_id)) as latest, count(*) as versions from k group by 1, 2""",
)
def latest_versions(r):
    k = r.filter("repo_name is not null and path is not null").select(
        F.lower(F.trim("repo_name")).alias("repo"), F.regexp_replace("path", r"\\", "/").alias("path"), "record_id", "ingested_at"
    )
    return k.groupBy("repo", "path").agg(F.max(F.struct("ingested_at", "record_id"))["record_id"].alias("latest"), F.count(F.lit(1)).alias("versions"))


@query("documents")
def near_duplicate_survivors(d):
    links, members = setsim.similar_pairs(d, "doc_id", "text")
    reps = members.select(F.col("rep").alias("id")).distinct()
    kept = dedup.greedy_survivors(links, reps)
    return members.join(kept.withColumnRenamed("id", "rep"), "rep").select(
        F.col("id").alias("doc_id"),
        ((F.col("id") == F.col("rep")) & F.col("accepted")).alias("accepted"),
        F.when(F.col("id") != F.col("rep"), F.coalesce("duplicate_of", "rep")).otherwise(F.col("duplicate_of")).alias("duplicate_of"),
    )


def _python(r):
    return r.filter(pysource.is_python(F.col("path"), F.col("text")))


@query("code_records")
def simhash_links(r):
    """Links of an equal 16-bit band and at most three differing bits, between distinct texts; one row per text in place of copies."""
    h = pysource.source_hashes(_python(r), ["record_id"])
    first = h.groupBy("sha256").agg(F.min("record_id").alias("id"), F.first("simhash").alias("simhash"))
    return pysource.simhash_links(cut(first), "id")


@query("code_records")
def python_index_duplicates(r):
    return pysource.index_duplicates(pysource.source_hashes(_python(r), ["record_id"]), "record_id")


@query("code_records")
def global_duplicates(r):
    py = r.filter(pysource.is_python(F.col("path"), F.col("text")))
    return pysource.global_duplicates(pysource.fingerprints(py, ["record_id"]), "record_id")


# Joins and set operations


@query(
    "code_records",
    "repositories",
    sql="""select r.record_id, p.source_id, p.approval from code_records r left join repositories p on lower(trim(r.repo_name)) = p.repo_name""",
)
def enriched_records(r, p):
    return r.select("record_id", F.lower(F.trim("repo_name")).alias("repo_name")).join(p, "repo_name", "left").select("record_id", "source_id", "approval")


@query("code_records", "source_manifest", sql="select record_id, path from code_records where record_id not in (select record_id from source_manifest where record_id is not null)")
def records_without_provenance(r, m):
    return r.join(m, "record_id", "left_anti").select("record_id", "path")


@query(
    "source_manifest",
    "repositories",
    sql="""select source_id, repo_name from repositories where source_id in (select source.id from source_manifest where source.type = 'git')""",
)
def repositories_with_git_sources(m, p):
    return p.join(m.filter("source.type = 'git'").select(F.col("source.id").alias("source_id")), "source_id", "left_semi").select("source_id", "repo_name")


@query(
    "documents",
    "mix_targets",
    sql="""select coalesce(d.source, t.source) as source, n, target_share from
        (select source, count(*) as n from documents where source is not null group by 1) d full join mix_targets t using (source)""",
)
def sources_and_targets(d, t):
    n = d.filter("source is not null").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return n.join(t.select("source", "target_share"), "source", "full")


@query(
    "customer",
    "orders",
    "lineitem",
    "nation",
    sql="""select n_name, o_orderpriority, count(*) as lines, sum(cast(l_extendedprice * (1 - l_discount) as decimal(18, 4)))::double as revenue
        from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
        where l_shipdate >= timestamp '1995-01-01' group by 1, 2""",
)
def star_revenue(c, o, li, n):
    revenue = F.sum((F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")).cast("double")
    return (
        li.filter(F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp_ntz"))
        .join(o, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(c, F.col("o_custkey") == F.col("c_custkey"))
        .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("n_name", "o_orderpriority")
        .agg(F.count(F.lit(1)).alias("lines"), revenue.alias("revenue"))
    )


# Aggregations


@query(
    "code_records",
    sql="""select coalesce(nullif(trim(license), ''), '<unspecified>') as license, count(*) as n,
        round(count(*) / (select count(*) from code_records), 9) as share from code_records group by 1""",
)
def license_distribution(r):
    key = F.coalesce(F.nullif(F.trim("license"), F.lit("")), F.lit("<unspecified>"))
    return reports.share_by(r, key, "license").withColumn("share", F.round("share", 9))


@query(
    "source_manifest",
    sql="""select source.id as source_id, count(distinct stored_path) as files, count(*) as rows, sum(size_bytes)::bigint as bytes,
        count(distinct source.package) as packages, count(distinct source.repository_url) as repositories from source_manifest group by 1""",
)
def source_report(m):
    return reports.source_report(m).drop("first_collected", "last_collected")


@query(
    "code_records",
    sql=f"""with t as (select record_id, octet_length(encode(text)) as n, case when {_SUFFIX} = '.py' then 'python_code' else 'technical_text' end as kind
        from code_records where text is not null)
    select count(*) as documents, sum(n)::bigint as tokens, round(avg(n), 6) as mean_tokens, floor(median(n))::bigint as median_tokens,
        arg_min(record_id, (n, record_id)) as smallest, arg_max(record_id, (n, record_id)) as largest,
        count(*) filter (n < 128) as under_128, count(*) filter (n >= 128 and n < 512) as under_512, count(*) filter (n >= 512 and n < 2048) as under_2048,
        count(*) filter (n >= 2048 and n < 8192) as under_8192, count(*) filter (n >= 8192) as from_8192, count(distinct kind) as kinds from t""",
)
def corpus_statistics(r):
    t = r.filter("text is not null").select("record_id", F.octet_length("text").alias("n"), T.content_type(F.col("path")).alias("kind"))
    return reports.corpus_statistics(t, "record_id", "n", "kind").withColumn("mean_tokens", F.round("mean_tokens", 6))


@query(
    "code_records",
    sql=f"""with t as (select record_id, octet_length(encode(text)) as n, case when {_SUFFIX} = '.py' then 'python_code' else 'technical_text' end as kind,
        record_id > min(record_id) over (partition by sha256(text)) as dup from code_records where text is not null),
    a as (select sum(n)::bigint as tokens, sum(case when kind = 'python_code' then n else 0 end) / sum(n) as p, sum(case when kind = 'technical_text' then n else 0 end) / sum(n) as x,
        avg(dup::double) as d from t)
    select tokens, round(p, 9) as python_ratio, round(x, 9) as text_ratio, round(d, 9) as duplicate_rate,
        array_to_string(list_filter([case when tokens < 200000 then 'token_target' end, case when p not between 0.45 and 0.75 then 'python_ratio' end,
            case when x not between 0.2 and 0.55 then 'technical_text_ratio' end, case when d > 0.15 then 'duplicate_rate' end], lambda x: x is not null), ',') as failures,
        not (tokens < 200000 or p not between 0.45 and 0.75 or x not between 0.2 and 0.55 or d > 0.15) as passed from a""",
)
def readiness(r):
    t = r.filter("text is not null").select("record_id", F.sha2("text", 256).alias("h"), F.octet_length("text").alias("n"), T.content_type(F.col("path")).alias("kind"))
    t = dedup.duplicates_by(t, "h", "record_id").withColumn("dup", F.col("duplicate_of").isNotNull().cast("int"))
    out = reports.readiness(t, F.col("kind"), "n", "dup")
    return out.select("tokens", *[F.round(c, 9).alias(c) for c in ("python_ratio", "text_ratio", "duplicate_rate")], "failures", "passed")


@query(
    "documents",
    sql="""with t as (select doc_id, length(text) as n from documents where text is not null), r as (select n, row_number() over (order by n) - 1 as k, count(*) over () as c from t)
    select count(*) as documents, sum(n)::bigint as total, round(avg(n), 6) as mean, floor(median(n))::bigint as median, min(n) as least, max(n) as most,
        (select min(n) from r where k = round_even((c - 1) * 0.95, 0)) as p95 from t""",
)
def length_statistics(d):
    t = d.filter("text is not null").select(F.length("text").cast("bigint").alias("n"))
    return tokens.token_statistics(t, "n").withColumn("mean", F.round("mean", 6))


@query(
    "documents",
    sql="""select source, lang, grouping_id(source, lang) as level, count(*) as n, sum(length(text))::bigint as chars from documents group by rollup(source, lang)""",
)
def source_language_rollup(d):
    return d.rollup("source", "lang").agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


# Windows, order, limits


@query(
    "code_records",
    sql="""with t as (select record_id, octet_length(encode(text)) + 1 as n from code_records where text is not null),
    o as (select record_id, n, coalesce(sum(n) over (order by record_id rows between unbounded preceding and 1 preceding), 0)::bigint as pos from t),
    s as (select record_id, n, pos, unnest(range(pos // 1025, (pos + n - 1) // 1025 + 1)) as sequence from o)
    select sequence, record_id, greatest(pos, sequence * 1025) - sequence * 1025 as "start", least(pos + n, (sequence + 1) * 1025) - sequence * 1025 as "end",
        greatest(pos, sequence * 1025) - pos as from_token from s""",
)
def packed_spans(r):
    t = r.filter("text is not null").select("record_id", (F.octet_length("text") + 1).cast("bigint").alias("n"))
    return windows.sequence_spans(t, "record_id", "record_id", "n", 1025)


@query(
    "documents",
    sql="""with t as (select doc_id, length(text) as n from documents where text is not null)
    select doc_id, n, coalesce(sum(n) over (order by doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as "offset" from t""",
)
def running_offsets(d):
    t = d.filter("text is not null").select("doc_id", F.length("text").cast("bigint").alias("n"))
    return windows.running_offsets(t, "doc_id", "n")


@query(
    "documents",
    sql="""with t as (select doc_id, length(text) as n from documents where text is not null),
    o as (select doc_id, n, coalesce(sum(n) over (order by doc_id rows between unbounded preceding and 1 preceding), 0) as b from t)
    select doc_id, n from o where b < 500000""",
)
def until_byte_target(d):
    t = d.filter("text is not null").select("doc_id", F.length("text").cast("bigint").alias("n"))
    return windows.until_target(t, "doc_id", "n", 500_000)


@query("documents", sql="select source, doc_id, n_chars from documents where source is not null qualify row_number() over (partition by source order by n_chars desc nulls last, doc_id) <= 3")
def longest_per_source(d):
    w = Window.partitionBy("source").orderBy(F.desc_nulls_last("n_chars"), "doc_id")
    return d.filter("source is not null").withColumn("_k", F.row_number().over(w)).filter("_k <= 3").select("source", "doc_id", "n_chars")


@query("code_records", sql="select record_id, octet_length(encode(text)) as n from code_records where text is not null order by n desc, record_id limit 10")
def largest_records(r):
    return r.filter("text is not null").select("record_id", F.octet_length("text").cast("bigint").alias("n")).orderBy(F.desc("n"), "record_id").limit(10)


@query(
    "code_records",
    sql="""with recursive t as (select record_id, octet_length(encode(text)) as n, row_number() over (order by record_id) as k from code_records where text is not null),
    f as (select k, record_id, n, 0::bigint as shard, 0::bigint as "offset" from t where k = 1 union all
        select t.k, t.record_id, t.n, case when f."offset" + f.n + t.n > 20000 then f.shard + 1 else f.shard end,
            case when f."offset" + f.n + t.n > 20000 then 0 else f."offset" + f.n end from f join t on t.k = f.k + 1)
    select record_id, n, shard, "offset" from f""",
)
def next_fit_shards(r):
    t = r.filter("text is not null").select("record_id", F.octet_length("text").cast("bigint").alias("n"))
    return windows.next_fit_shards(t, "record_id", "n", 20_000)


def _encoded(d):
    return tokens.encode(d, tokens.vocabulary(d, "doc_id", "text", 2000), "doc_id", "text")


_WINDOW_IDS = """s as (select doc_id, ids, unnest(case when len(ids) > 128 then range(0, len(ids) - 128, 128) when len(ids) > 1 then [0] else [] end) as "start" from e)"""


@query(
    "documents",
    sql=f"""with {_IDS}, {_WINDOW_IDS}
    select doc_id, "start", least(128, len(ids) - 1 - "start") as tokens, md5(array_to_string(ids["start" + 1:least("start" + 128, len(ids) - 1)], ' ')) as inputs,
        md5(array_to_string(ids["start" + 2:"start" + 129], ' ')) as targets from s""",
)
def sliding_windows(d):
    """Windows of 128 ids and their targets; short texts as one window, of which the own ids are compared."""
    w = windows.sliding_windows(_encoded(d), "ids", 128, 128, "pad")
    part = lambda c: F.md5(F.array_join(F.slice(c, 1, F.col("tokens")), " "))
    return w.select("doc_id", "start", F.col("tokens").cast("bigint").alias("tokens"), part("inputs").alias("inputs"), part("targets").alias("targets"))


@query(
    "documents",
    sql=f"""with {_IDS}, x as (select doc_id, unnest(list_concat(ids, [3])) as i, generate_subscripts(list_concat(ids, [3]), 1) as pos from e),
    o as (select doc_id, i, pos, row_number() over (order by doc_id, pos) - 1 as k from x)
    select k // 1025 as sequence, count(*) as tokens, count(distinct doc_id) as documents, md5(string_agg(i::varchar, ' ' order by k) || repeat(' 0', (1025 - count(*))::int)) as ids from o group by 1""",
)
def packed_sequences(d):
    """All texts with an end token as sequences of 1,025 ids, the last one padded."""
    e = _encoded(d).select("doc_id", tokens.bounded(F.col("ids"), False, True).alias("ids"))
    s = windows.packed_sequences(e, "doc_id", "doc_id", "ids", 1025, pad_final=True)
    return s.select("sequence", F.col("tokens").cast("bigint").alias("tokens"), F.size(F.array_distinct("documents.id")).cast("bigint").alias("documents"), F.md5(F.array_join("ids", " ")).alias("ids"))


@query(
    "code_records",
    sql="""with t as (select sum(octet_length(encode(text)) + 1)::bigint as n from code_records where text is not null), s as (select unnest(range(0, n // 1025)) as sequence from t)
    select sequence // 9 as shard, count(*) as sequences, count(*) * 1025 as tokens, count(*) * 2050 as bytes, min(sequence) as first_sequence from s group by 1""",
)
def packed_shard_index(r):
    """Shards of at most 10,000 bytes' tokens over the whole sequences of all texts."""
    t = r.filter("text is not null").select("record_id", (F.octet_length("text") + 1).cast("bigint").alias("n"))
    spans = windows.sequence_spans(t, "record_id", "record_id", "n", 1025).groupBy("sequence").agg(F.max("end").alias("n")).filter("n = 1025")
    return windows.shard_index(windows.in_shards(spans, 1025, 10_000), 1025)


# Splits


@query("documents", sql="select doc_id, case when ('0x' || substr(sha256(text), 1, 8))::bigint % 10000 < 500 then 'validation' else 'train' end as split from documents where text is not null")
def hash_split(d):
    return d.filter("text is not null").select("doc_id", T.hash_split(F.sha2("text", 256), 5).alias("split"))


_GROUPS = """with g as (select distinct coalesce(lower(trim(repo_name)), '') as g from code_records), r as (select g, row_number() over (order by sha256('42' || chr(0) || g), g) - 1 as k from g),
    n as (select count(*) as n from g), x as (select * from (values ('train', 0.9::double, 1), ('validation', 0.05::double, 2), ('test', 0.05::double, 3)) t(s, ratio, i)),
    b as (select s, ratio, i, n, n * ratio as exact, floor(n * ratio)::bigint as c from x, n),
    a0 as (select s, i, n, c + case when row_number() over (order by exact - c desc, ratio desc, i) <= n - sum(c) over () then 1 else 0 end as c from b),
    a as (select s, i, case when n < 3 then c when c = 0 then 1 when i = 1 then c - count(*) filter (c = 0) over () else c end as c from a0),
    e as (select s, i, coalesce(sum(c) over (order by i rows between unbounded preceding and 1 preceding), 0) as low, sum(c) over (order by i) as high from a)"""


@query("code_records", sql=f"{_GROUPS} select record_id, lower(trim(repo_name)) as repo, s as split from code_records join r on coalesce(lower(trim(repo_name)), '') = g join e on k >= low and k < high")
def group_split(r):
    r = r.withColumn("repo", F.lower(F.trim("repo_name")))
    return splits.group_split(r, "repo", {"train": 0.9, "validation": 0.05, "test": 0.05}).select("record_id", "repo", F.col("assigned").alias("split"))


@query(
    "code_records",
    sql="""select lower(trim(repo_name)) as repo, count(distinct lower(trim(split))) as splits, count(*) as rows from code_records
        where repo_name is not null and split is not null group by 1 having count(distinct lower(trim(split))) > 1""",
)
def split_leakage(r):
    return splits.leakage(r.withColumn("repo", F.lower(F.trim("repo_name"))), "repo", F.lower(F.trim("split")))


# Tokens


@query("documents", sql=f"select doc_id, len({_TOKENS}) as n, len(list_distinct({_TOKENS})) as distinct_tokens from documents where text is not null")
def token_counts(d):
    t = T.tokens(F.lower("text"))
    return d.filter("text is not null").select("doc_id", F.size(t).cast("bigint").alias("n"), F.size(F.array_distinct(t)).cast("bigint").alias("distinct_tokens"))


@query(
    "documents",
    sql=f"""with t as (select unnest({_TOKENS}) as token from documents), n as (select token, count(*) as frequency from t group by 1 having count(*) >= 2),
    k as (select token, frequency, row_number() over (order by frequency desc, token) as r from n)
    select r + 4 as token_id, token, frequency from k where r <= 1995""",
)
def vocabulary(d):
    return tokens.vocabulary(d, "doc_id", "text", 2000)


@query(
    "documents",
    sql=f"""with {_VOCABULARY}, w as (select doc_id, {_TOKENS} as a from documents where text is not null),
    p as (select doc_id, unnest(a) as token, generate_subscripts(a, 1) as pos from w)
    select doc_id, md5(string_agg(coalesce(token_id, 1)::varchar, ' ' order by pos)) as ids, count(*) as n from p left join v using (token) group by 1""",
)
def encoded(d):
    e = tokens.encode(d, tokens.vocabulary(d, "doc_id", "text", 2000), "doc_id", "text")
    return e.select("doc_id", F.md5(F.array_join("ids", " ")).alias("ids"), F.size("ids").cast("bigint").alias("n"))


@query("documents", sql=f"with w as (select doc_id, {_TOKENS} as a from documents where text is not null) select doc_id, md5(array_to_string(a, ' ')) as tokens from w where len(a) > 0")
def round_trip(d):
    """Texts encoded with the full vocabulary, of any size, and decoded again."""
    v = tokens.full_vocabulary(d, "doc_id", "text")
    back = tokens.decode(tokens.encode(d, v, "doc_id", "text"), v, "doc_id", "ids")
    return back.select("doc_id", F.md5(F.array_join("tokens", " ")).alias("tokens"))


@query(
    "eval_items",
    sql=r"""with c as (select item_id, list_filter(string_split(regexp_replace(regexp_replace(prompt, '^\s+', ''), '[\r\n]+', chr(10), 'g'), ''),
        lambda x: x <> '' and (x = chr(10) or not regexp_matches(x, '^[\s\x0B\x85\p{Z}\x{1c}-\x{1f}]$'))) as c from eval_items where prompt is not null)
    select item_id, len(c) as n, len(list_filter(c, lambda x: x = chr(10))) as newlines from c""",
)
def character_tokens(e):
    c = e.filter("prompt is not null").select("item_id", tokens.characters(F.col("prompt")).alias("c"))
    return c.select("item_id", F.size("c").cast("bigint").alias("n"), F.size(F.filter("c", lambda x: x == "<NL>")).cast("bigint").alias("newlines"))


_MASKED = f"""t as (select unnest(regexp_extract_all(lower(prompt), {_TOKENS.split(', ', 1)[1][:-1]})) as token from eval_items), n as (select token, count(*) as frequency from t group by 1 having count(*) >= 2),
    v as (select token, row_number() over (order by frequency desc, token) + 4 as token_id from n qualify row_number() over (order by frequency desc, token) <= 1995),
    w as (select item_id, c, regexp_extract_all(lower(coalesce(x, '')), {_TOKENS.split(', ', 1)[1][:-1]}) as a from (select item_id, 'p' as c, prompt as x from eval_items union all select item_id, 'a', answer from eval_items)),
    u as (select item_id, c, unnest(a) as token, generate_subscripts(a, 1) as pos from w), e as (select item_id, c, list(coalesce(token_id, 1)::int order by pos) as ids from u left join v using (token) group by 1, 2),
    b as (select item_id, coalesce(max(ids) filter (c = 'p'), []) as p, coalesce(max(ids) filter (c = 'a'), []) as a from eval_items left join e using (item_id) group by 1),
    f as (select item_id, len(p) as m, list_concat([2], p, a, [3]) as h from b), g as (select item_id, case when len(h) > 257 then list_concat(h[1:256], [3]) else h end as h, m from f),
    k as (select item_id, h[1:len(h) - 1] as i, list_concat(list_transform(range(least(m, len(h) - 1)), lambda z: -100), h[least(m, len(h) - 1) + 2:257]) as l from g)"""


@query(
    "eval_items",
    sql=f"""with {_MASKED} select item_id, md5(array_to_string(list_concat(i, list_transform(range(256 - len(i)), lambda z: 0)), ' ')) as inputs,
        md5(array_to_string(list_concat(l, list_transform(range(256 - len(l)), lambda z: -100)), ' ')) as labels from k""",
)
def masked_examples(e):
    """Prompt and answer as ids of the prompts' vocabulary, with the prompt's labels ignored."""
    v = cut(tokens.vocabulary(e, "item_id", "prompt", 2000))
    of = lambda c, name: tokens.encode(e, v, "item_id", c).withColumnRenamed("ids", name)
    j = e.select("item_id").join(of("prompt", "p"), "item_id", "left").join(of("answer", "a"), "item_id", "left")
    none = F.array().cast("array<int>")
    inputs, labels = tokens.masked_example(F.coalesce("p", none), F.coalesce("a", none), 256)
    return j.select("item_id", F.md5(F.array_join(inputs, " ")).alias("inputs"), F.md5(F.array_join(labels, " ")).alias("labels"))


# Evaluation


_CHECKS = """with t as (select item_id, lower(regexp_replace(coalesce(answer, ''), '\\s+', ' ', 'g')) as a,
        coalesce(check_rules.required_terms, []) as terms, coalesce(check_rules.required_any, []) as anys from eval_items),
    v as (select item_id, len(list_filter(terms, lambda k: not contains(a, lower(k)))) = 0 as terms_ok,
        len(list_filter(anys, lambda g: len(list_filter(g, lambda k: contains(a, lower(k)))) = 0)) = 0 as any_ok from t)
    select item_id, terms_ok, any_ok, terms_ok and any_ok as passed from v"""


@query("eval_items", sql=_CHECKS)
def answer_checks(e):
    return evalmetrics.answer_checks(e, syntax=False).select("item_id", "terms_ok", "any_ok", "passed")


@query(
    "documents",
    sql=f"""with t as (select doc_id, {_TOKENS} as a from documents where text is not null)
    select doc_id, round(case when len(a) > 0 then 1 - len(list_distinct(a)) / len(a) else 0.0 end, 9) as repetition,
        round(case when len(a) > 1 then len(list_distinct(list_transform(range(1, len(a)), lambda i: a[i] || chr(0) || a[i + 1]))) / (len(a) - 1) else 0.0 end, 9) as coherence from t""",
)
def repetition_and_coherence(d):
    d = d.filter("text is not null").select("doc_id", T.tokens(F.lower("text")).alias("a"))
    a = F.col("a")
    return d.select("doc_id", F.round(evalmetrics.repetition_rate(a), 9).alias("repetition"), F.round(evalmetrics.coherence(a), 9).alias("coherence"))


@query(
    "events",
    sql="""with t as (select event_type, user_id, value from events) select event_type, sum(user_id)::bigint as weight, round(sum(value * user_id) / sum(user_id), 9) as loss,
        round(exp(least(20, sum(value * user_id) / sum(user_id))), 3) as perplexity from t group by 1""",
)
def weighted_loss(e):
    return evalmetrics.weighted_loss(e, ["event_type"], "value", "user_id").select(
        "event_type", "weight", F.round("loss", 9).alias("loss"), F.round("perplexity", 3).alias("perplexity")
    )


@query(
    "events",
    sql="""with b as (select event_type, avg(value) filter (user_id % 2 = 0) as base, avg(value) filter (user_id % 2 = 1) as candidate from events group by 1)
    select event_type, round(base, 9) as base, round(candidate, 9) as candidate, round(case when base = 0 then 0 else (candidate - base) / abs(base) end, 9) as relative_change from b""",
)
def variant_comparison(e):
    c = evalmetrics.comparison(e, "event_type", F.when(F.col("user_id") % 2 == 0, "a").otherwise("b"), "a", "b", "value")
    return c.select("event_type", *[F.round(x, 9).alias(x) for x in ("base", "candidate", "relative_change")])


@query(
    "events",
    sql="""select date_trunc('hour', ts) as hour, event_type, count(*) as n, round(sum(value), 4) as value from events where ts is not null group by 1, 2""",
)
def hourly_events(e):
    w = F.window("ts", "1 hour")
    return e.filter("ts is not null").groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value")).select(
        F.col("window.start").alias("hour"), "event_type", "n", "value"
    )


@query(
    "embeddings",
    sql="""with x as (select label, unnest(embedding)::double as x, sqrt(list_sum(list_transform(embedding, lambda v: v::double * v::double))) as norm from embeddings)
    select label, count(*) as components, round(min(x), 6) as least, round(max(x), 6) as most, round(avg(x), 6) as mean, round(stddev_pop(x), 6) as deviation, round(avg(norm), 6) as mean_norm,
        round(sqrt(sum(x * x)), 6) as l2, count(*) // 64 as vectors, count(*) filter (norm = 0) // 64 as zero_vectors from x group by 1""",
)
def embedding_statistics(e):
    s = evalmetrics.embedding_statistics(e, "embedding", "label")
    return s.select("label", "components", "vectors", "zero_vectors", *[F.round(c, 6).alias(c) for c in ("least", "most", "mean", "deviation", "mean_norm", "l2")])


@query(
    "embeddings",
    sql="""with c as (select label, list(m order by i) as c from (select label, i, avg(embedding[i])::double as m from embeddings, range(1, 65) t(i) group by 1, 2) group by 1)
    select vec_id, round(list_cosine_similarity(embedding::double[], c), 6) as similarity from embeddings join c using (label)""",
)
def cosine_to_centroid(e):
    parts = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centroids = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
    return e.join(centroids, "label").select("vec_id", F.round(evalmetrics.cosine(F.col("embedding"), F.col("c")), 6).alias("similarity"))


# Instruction records


@query(
    "eval_items",
    sql=r"""select item_id, concat('### Instruction:', chr(10), prompt, chr(10), chr(10), '### Input:', chr(10), chr(10), chr(10), '### Response:', chr(10), coalesce(answer, '')) as record from eval_items""",
)
def rendered_records(e):
    return e.select("item_id", sft.render(sft.TEMPLATE, {"instruction": F.col("prompt"), "input": F.lit(""), "output": F.col("answer")}).alias("record"))


@query("eval_items", sql="select prompt, count(*) as n from eval_items where prompt is not null group by 1 having count(*) > 1")
def duplicate_prompts(e):
    return sft.value_counts(e, F.col("prompt"), "prompt")


@query(
    "eval_items",
    sql="""select suite, count(*) as records, round(avg(length(prompt)), 6) as prompt_mean, median(length(prompt)) as prompt_median, min(length(prompt)) as prompt_least, max(length(prompt)) as prompt_most from eval_items group by 1""",
)
def prompt_lengths(e):
    return sft.length_statistics(e, ["suite"], ["prompt"]).withColumn("prompt_mean", F.round("prompt_mean", 6))


@query("code_records")
def instruction_pairs(r):
    py = r.filter(pysource.is_python(F.col("path"), F.col("text")))
    p = instructions.instruction_pairs(py, ["record_id"])
    p = p.withColumn("pair", sft.pair_hash(F.col("instruction"), F.col("input"), F.col("output")))
    return p.groupBy("pair").agg(F.min(F.struct("record_id", "symbol", "category")).alias("kept"), F.count(F.lit(1)).alias("n")).select("pair", "kept.*", "n")


# Source index


@query("code_records")
def symbol_index(r):
    py = r.filter(pysource.is_python(F.col("path"), F.col("text")))
    return pysource.duplicate_symbols(pysource.definitions(py, ["record_id"]), "record_id")


@query("code_records")
def category_counts(r):
    """Files per category, the most common first, and of how many it is the primary one."""
    c = pysource.file_categories(_python(r).select("record_id", "path", "text"), ["record_id"])
    return c.groupBy("category").agg(F.count(F.lit(1)).alias("files"), F.count_if("is_primary").alias("primary_files")).orderBy(F.desc("files"), "category")


@query("code_records")
def capped_instruction_pairs(r):
    """At most sixteen pairs a file, the best ranked of each category first; pairs per category."""
    p = instructions.instruction_pairs(_python(r), ["record_id"], most=16)
    return p.groupBy("category").agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("record_id").alias("files"))


@query("code_records")
def undefined_name_counts(r):
    py = r.filter(pysource.is_python(F.col("path"), F.col("text")))
    return pysource.undefined_names(py, ["record_id"]).select("record_id", F.size("names").alias("undefined"))


@query(
    "code_records",
    sql="""select record_id, path, repo_name from code_records where lower(coalesce(path, '')) like '%parser%' or lower(coalesce(repo_name, '')) like '%parser%'""",
)
def path_search(r):
    hit = lambda c: F.coalesce(F.lower(c), F.lit("")).like("%parser%")
    return r.filter(hit("path") | hit("repo_name")).select("record_id", "path", "repo_name")


@query("code_records")
def index_search(r):
    py = r.filter(pysource.is_python(F.col("path"), F.col("text")))
    found = index.search(
        r.select("record_id", "path", "repo_name"), pysource.definitions(py, ["record_id"]), pysource.file_categories(py, ["record_id"]), "parse", "OOP"
    )
    return found.select("record_id", "path", F.array_join("categories", ",").alias("categories"), F.array_join("symbols", ",").alias("symbols"))


@query(
    "source_manifest",
    "code_records",
    sql="""with m as (select record_id, min(content_sha256) as o from source_manifest where record_id is not null group by 1),
    c as (select record_id, sha256(text) as n from code_records)
    select coalesce(m.record_id, c.record_id) as record_id, case when m.record_id is null then 'new' when c.record_id is null then 'gone'
        when o is not distinct from n then 'unchanged' else 'changed' end as state from m full join c on m.record_id = c.record_id""",
)
def manifest_states(m, r):
    old = m.filter("record_id is not null").groupBy("record_id").agg(F.min("content_sha256").alias("h"))
    return index.incremental(old, r.select("record_id", F.sha2("text", 256).alias("h")), "record_id", "h")


@query(
    "repositories",
    sql="""select source_id, approval from repositories where source_id not in (select source_id from repositories where approval is null)
        union all select source_id, 'pending' from repositories where approval is null""",
)
def repository_upsert(p):
    pending = p.filter("approval is null").select("source_id", F.lit("pending").alias("approval"))
    return index.upsert(p.select("source_id", "approval"), pending, "source_id")


# The build as a whole


_BUILD = f"""c as ({SQL['clean_reasons']}), n as (select record_id, {_NORM_TEXT} as t from code_records),
    k as (select record_id, sha256(t) as e, sha256({_LOOSE.format('t')}) as l from n join c using (record_id) where reason = 'accepted'),
    f as (select l, min(record_id) as first, arg_min(e, record_id) as fe from k group by 1),
    d as (select record_id, case when first < record_id then case when fe = e then 'exact_duplicate' else 'normalized_duplicate' end end as dup,
        case when first < record_id then first end as duplicate_of from k join f using (l)),
    b as (select c.record_id, coalesce(case when reason <> 'accepted' then reason end, dup, 'accepted') as reason, duplicate_of, octet_length(encode(t)) as n_tokens
        from c join n using (record_id) left join d using (record_id))"""


@query("code_records", sql=f"with {_BUILD} select * from b")
def corpus_build(r):
    """Without the near-duplicate step, as its SQL has it."""
    return corpus.build(r, 1025, near=False)[0]


@query("code_records")
def corpus_build_near(r):
    """The build with all its steps."""
    return corpus.build(r, 1025)[0]


@query("code_records")
def corpus_sequences(r):
    return corpus.build(r, 1025)[1]


@query(
    "code_records",
    sql=f"""with {_BUILD}, t as (select record_id, n_tokens + 1 as n from b where reason = 'accepted'),
    o as (select record_id, n, coalesce(sum(n) over (order by record_id rows between unbounded preceding and 1 preceding), 0)::bigint as pos from t),
    s as (select record_id, n, pos, unnest(range(pos // 1025, (pos + n - 1) // 1025 + 1)) as sequence from o)
    select sequence, record_id, greatest(pos, sequence * 1025) - sequence * 1025 as "start", least(pos + n, (sequence + 1) * 1025) - sequence * 1025 as "end", greatest(pos, sequence * 1025) - pos as from_token from s""",
)
def build_sequences(r):
    """Sequences of the build without the near-duplicate step."""
    return corpus.build(r, 1025, near=False)[1]


#: The flagship: reasons of the corpus build and their counts, without the near-duplicate step as its SQL has it.
@query("code_records", sql=f"with {_BUILD} select reason, count(*) as records, sum(n_tokens)::bigint as tokens from b group by 1")
def build_report(r):
    stages, _ = corpus.build(r, 1025, near=False)
    return stages.groupBy("reason").agg(F.count(F.lit(1)).alias("records"), F.sum("n_tokens").alias("tokens"))
