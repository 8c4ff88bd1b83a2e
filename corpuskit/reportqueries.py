"""Registered queries of validators, reports, order and sampling, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpuskit import catalog
from corpuskit.catalog import _BUILD, _CHECKS, _CLEAN, _IDS, _NORM, _SUFFIX, _TOKENS, _contains, query
from corpuskit.functions import text as T
from corpuskit.operators import bpe, dedup, evalmetrics, index, lines, pysource, quality, reports, sft, splits, tokens, validate, windows
from corpuskit.plans import corpus, instructions, merged
from corpuskit.sources import readers

_PY = f"{_SUFFIX} = '.py'"
_B = "octet_length(encode(text))"
_SPACE = r"[\s\x0B\x{1c}-\x{1f}\x85\p{Z}]"
_BUILDER = rf"(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[\t\x0B\x0C \x{{1c}}-\x{{1f}}\x85\p{{Z}}]+(\n|$)', '\1', 'g'), '^{_SPACE}+|{_SPACE}+$', '', 'g') || chr(10))".replace("{{", "{").replace("}}", "}")
_UNSAFE = r"(regexp_matches(replace(stored_path, '\', '/'), '^(/|[A-Za-z]:)') or regexp_matches(replace(stored_path, '\', '/'), '(^|/)\.\.(/|$)'))"
_KIND = f"case when {_PY} then 'python_code' else 'technical_text' end"


# Validators


@query(
    "source_manifest",
    "code_records",
    sql=rf"""with m as (select distinct record_id, stored_path, content_sha256 from source_manifest), j as (select m.record_id, stored_path, content_sha256, text, {_NORM.format('text')} as t,
            coalesce(lower(regexp_extract(regexp_extract(replace(stored_path, '\', '/'), '([^/]*)$', 1), '[^.](\.[^.]+)$', 1)), '') = '.py' as py, stored_path as path
            from m left join code_records using (record_id)),
    s as (select *, len(list_filter(regexp_split_to_array(replace(text, '_', ' '), '{_SPACE}+'), lambda x: regexp_matches(x, '\p{{L}}'))) >= 8
            and len(regexp_extract_all(text, '[\p{{C}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]')) - len(regexp_extract_all(text, '[\n\t]')) <= 0.05 * length(text) as signal, {_CLEAN} as clean from j)
    select record_id, stored_path, case when record_id is null or stored_path is null or not coalesce(regexp_matches(content_sha256, '(?i)^[0-9a-f]{{64}}$'), false) then 'invalid_metadata'
        when {_UNSAFE} then 'unsafe_path' when text is null then 'missing_file' when {_B} < 80 then 'too_small' when {_B} > 2000000 then 'too_large'
        when lower(content_sha256) <> sha256(text) then 'hash_mismatch' when regexp_replace(text, '{_SPACE}+', '', 'g') = '' then 'empty_file'
        when clean <> 'accepted' then 'cleaner_' || clean when not py and not signal then 'low_text_signal' else 'accepted' end as reason from s""",
)
def manifest_verdicts(m, r):
    """The merge's checks but for syntax, which SQL can't say."""
    return validate.manifest_verdicts(m, r, "record_id", syntax=False)


@query("source_manifest", "code_records")
def manifest_validation(m, r):
    """The merge's checks with syntax: counts per reason."""
    return validate.manifest_verdicts(m, r, "record_id").groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "source_manifest",
    "code_records",
    sql=rf"""with m as (select distinct record_id, stored_path, content_sha256, source.id as source from source_manifest),
    o as (select m.record_id, stored_path, sha256(text) as h, case when source is null or m.record_id is null or stored_path is null then 'invalid_provenance' when {_UNSAFE} then 'unsafe_stored_path'
        when text is null then 'missing_file' when not coalesce(lower(content_sha256) = sha256(text), false) then 'hash_mismatch' when {_B} not between 1 and 2000000 then 'size_out_of_bounds' end as own
        from m left join code_records using (record_id)),
    p as (select *, row_number() over (partition by stored_path order by record_id) as k from o where own is null),
    c as (select *, case when k = 1 then row_number() over (partition by h, k = 1 order by stored_path, record_id) end as n from p)
    select record_id, stored_path, own as reason from o where own is not null
    union all select record_id, stored_path, case when k > 1 then 'duplicate_stored_path' when n > 1 then 'duplicate_content' else 'accepted' end from c""",
)
def index_candidates(m, r):
    return validate.index_candidates(m, r, "record_id", syntax=False)


@query(
    "documents",
    sql=f"""with t as (select doc_id, text, {_BUILDER} as c from documents), o as (select doc_id, sha256(c) as h, case when text is null then 'invalid_utf8' when {_B} = 0 then 'empty_file'
        when {_B} < 1 then 'too_small' when {_B} > 2000000 then 'too_large' when c = chr(10) then 'empty_after_cleaning' when octet_length(encode(c)) < 60 then 'too_small_after_cleaning' end as own from t),
    f as (select h, min(doc_id) as first from o where own is null group by 1)
    select doc_id, coalesce(own, case when first < doc_id then 'duplicate' else 'accepted' end) as reason, case when own is null and first < doc_id then first end as duplicate_of from o left join f using (h)""",
)
def document_reasons(d):
    return validate.document_reasons(d, "doc_id", F.col("text"), least_after=60)


@query(
    "code_records",
    sql=f"""select record_id, case when not coalesce({_SUFFIX} in ('.py', '.md', '.txt', '.toml'), false) then 'unsupported_extension' when {_contains('lower(path)', quality.GENERATED_NAMES)} then 'generated_file'
        when {_B} < 16 then 'too_small' when {_B} > 1000000 then 'too_large' when text is null then 'invalid_utf8'
        when {_contains("lower(array_to_string(string_split(text, chr(10))[1:8], chr(10)))", quality.GENERATED_MARKERS)} then 'generated_file' else 'accepted' end as reason from code_records""",
)
def collection_reasons(r):
    return validate.collection_reasons(r, "record_id", "path", "text", (".py", ".md", ".txt", ".toml"), syntax=False)


@query("code_records")
def corpus_verdicts(r):
    """The validator's verdicts with syntax and quality: counts per reason."""
    return validate.corpus_verdicts(r, "record_id", "path", "text").groupBy("reason").agg(F.count(F.lit(1)).alias("records"))


@query("code_records")
def instruction_sources(r):
    py = r.filter(pysource.is_python(F.col("path"), F.col("text")))
    return validate.instruction_sources(py, ["record_id"]).groupBy("reason").agg(F.count(F.lit(1)).alias("records"))


_CATEGORIES = ("code", "facts", "reasoning")


@query(
    "eval_items",
    sql=rf"""with t as (select item_id, trim(coalesce(prompt, ''), ' ') as i, coalesce(answer, '') as o, suite, sha256(concat(
            regexp_replace(regexp_replace(coalesce(prompt, ''), '[ \t]+(\n|$)', '\1', 'g'), '^\s+|\s+$', '', 'g'), chr(0), chr(0),
            regexp_replace(regexp_replace({_NORM.format("coalesce(answer, '')")}, '[ \t]+(\n|$)', '\1', 'g'), '^\s+|\s+$', '', 'g'))) as pair from eval_items),
    f as (select pair, min(item_id) as first from t group by 1), n as (select item_id, count(*) as times from t group by 1)
    select item_id, array_to_string(list_sort(list_filter([case when not coalesce(suite in {_CATEGORIES}, false) then 'invalid_category' end, case when length(i) < 3 then 'instruction_too_short' end,
        case when length(i) > 100000 then 'instruction_too_long' end, case when trim(o, ' ') = '' then 'output_too_short' end, case when length(o) > 100000 then 'output_too_large' end,
        case when contains(i || o, chr(0)) then 'null_character' end, case when times > 1 then 'duplicate_record_id' end, case when first < item_id then 'duplicate_instruction_pair' end], lambda x: x is not null)), ',') as problems
    from t join f using (pair) join n using (item_id)""",
)
def instruction_problems(e):
    p = validate.instruction_problems(e.withColumn("given", F.lit("")), "item_id", "prompt", "given", "answer", F.col("suite"), _CATEGORIES)
    return p.select("item_id", F.array_join("problems", ",").alias("problems"))


@query(
    "code_records",
    sql=f"""with t as (select {_B} as n, {_KIND} as kind from code_records where text is not null), a as (select sum(n)::bigint as tokens, count(*) as files,
        sum(case when kind = 'python_code' then n else 0 end) / sum(n) as p, sum(case when kind = 'technical_text' then n else 0 end) / sum(n) as x from t),
    b as (select *, tokens >= 200000 as met, tokens > 500000000 as over, p between 0.45 and 0.75 and x between 0.2 and 0.55 as even from a)
    select tokens, files, round(p, 9) as python_fraction, round(x, 9) as text_fraction, met as target_met, over as target_exceeded, even as balance_met, met and not over and even as ready from b""",
)
def corpus_balance(r):
    t = r.filter("text is not null").select(F.octet_length("text").cast("bigint").alias("n"), T.content_type(F.col("path")).alias("kind"))
    b = validate.balance(t, F.coalesce("kind", F.lit("technical_text")), "n", 200_000, 500_000_000)
    return b.withColumns({c: F.round(c, 9) for c in ("python_fraction", "text_fraction")})


@query(
    "code_records",
    sql=f"with {_BUILD}, m as (select record_id, case when reason = 'accepted' and n_tokens < 900 then 'too_few_tokens' else reason end as reason from b) select reason, count(*) as records from m group by 1",
)
def build_with_minimum(r):
    """The build with a least number of tokens, which comes after the duplicates: a first of its kind may still be too short."""
    return corpus.staged(r, near=False, minimum=900).groupBy("reason").agg(F.count(F.lit(1)).alias("records"))


# Text


@query("documents", sql=f"select doc_id, sha256({_BUILDER}) as h from documents where text is not null")
def builder_texts(d):
    return d.filter("text is not null").select("doc_id", F.sha2(T.builder_text(F.col("text")), 256).alias("h"))


@query("documents")
def final_texts(d):
    suffix = T.suffix(F.coalesce("stored_path", F.lit("x.txt")))
    return d.select("doc_id", F.sha2(lines.final_texts(F.col("text"), suffix), 256).alias("h"))


@query(
    "eval_items",
    sql=r"""select item_id, md5(translate(translate(translate(prompt, '‘’‚‛′', repeat('''', 5)), '“”„‟″', repeat('"', 5)), '‐‑‒–—―−', repeat('-', 7))) as h from eval_items where prompt is not null""",
)
def plain_signs(e):
    return e.filter("prompt is not null").select("item_id", F.md5(T.plain_signs(F.col("prompt"))).alias("h"))


@query(
    "eval_items",
    sql=r"""select item_id, regexp_replace(regexp_replace(prompt, '[ \t]+(\n|$)', '\1', 'g'), '^\s+|\s+$', '', 'g') as response from eval_items where prompt is not null""",
)
def assistant_responses(e):
    """The prompt as the last assistant turn of a made-up conversation, with what comes around it taken off again."""
    t = F.concat(F.lit("<|system|> s <|assistant|> old <|user|> q <|assistant|> "), F.col("prompt"), F.lit(" \n\n<|user|> next <|end|>"))
    return e.filter("prompt is not null").select("item_id", T.assistant_response(t, ("<|end|>",)).alias("response"))


@query("repositories", sql=r"""select source_id, trim(regexp_replace(lower(regexp_replace(repo_name, '(\p{Ll})(\p{Lu})', '\1_\2', 'g')), '[^\p{L}\p{N}]+', '_', 'g'), '_') as name from repositories""")
def category_names(p):
    return p.select("source_id", T.category_name(F.col("repo_name")).alias("name"))


@query("repositories", sql="""select source_id, sha256('{' || case when repo_name is not null then '"repo_name":"' || repo_name || '",' else '' end || '"source_id":"' || source_id || '"}') as h from repositories""")
def fingerprints(p):
    return p.select("source_id", T.fingerprint("source_id", "repo_name").alias("h"))


@query("documents")
def cleaned_lines(d):
    """Lines of the line cleaner per reason."""
    return lines.cleaned_lines(d, ["doc_id"], least=3, most=2_000).groupBy("skipped").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).alias("chars"))


@query("code_records")
def corpus_texts(r):
    """The corpus' own normal form of each text, as its hash."""
    return r.filter("text is not null").select("record_id", F.sha2(lines.corpus_texts(F.col("text")), 256).alias("h"))


@query("documents", sql=f"with {_IDS} select count(*) as tokens, count(distinct i) as used, round(count(distinct i) / 2000, 9) as utilization from (select unnest(ids) as i from e)")
def vocabulary_use(d):
    return tokens.vocabulary_use(catalog._encoded(d), "ids", 2000).withColumn("utilization", F.round("utilization", 9))


# Reports


@query(
    "code_records",
    sql=f"""with t as (select {_KIND} as kind, {_B} as b, len(regexp_extract_all(text, '\\n')) + case when ends_with(text, chr(10)) or text = '' then 0 else 1 end as l from code_records where text is not null)
    select kind, count(*) as files, sum(b)::bigint as bytes, min(b) as least_bytes, round(avg(b), 6) as mean_bytes, max(b) as most_bytes, sum(l)::bigint as lines, min(l) as least_lines, round(avg(l), 6) as mean_lines, max(l) as most_lines from t group by 1""",
)
def size_report(r):
    s = reports.size_report(r, F.coalesce(T.content_type(F.col("path")), F.lit("technical_text")), "kind", "text")
    return s.withColumns({c: F.round(c, 6) for c in ("mean_bytes", "mean_lines")})


@query(
    "documents",
    sql=f"""with d as ({catalog.SQL['two_level_duplicates']}), n as (select reason, count(*) as n from d group by 1)
    select coalesce(sum(n) filter (reason is null), 0)::bigint as accepted, coalesce(sum(n) filter (reason is not null), 0)::bigint as duplicates,
        array_to_string(list_sort(list(reason || '=' || n) filter (reason is not null)), ',') as reasons,
        round(coalesce(sum(n) filter (reason is not null), 0) / sum(n), 6) as duplicate_share from n""",
)
def dedup_report(d):
    two = dedup.two_level(d, "doc_id", F.sha2("text", 256), F.sha2(T.normalize_for_dedup(F.col("text")), 256))
    r = reports.dedup_report(two, "reason")
    said = F.array_join(F.array_sort(F.transform(F.map_entries("reasons"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), ",")
    return r.withColumn("reasons", said)


@query("code_records", sql=f"""select coalesce({_SUFFIX}, '') as suffix, count(*) as files, sum({_B})::bigint as bytes from code_records group by 1""")
def extension_report(r):
    return r.groupBy(F.coalesce(T.suffix(F.col("path")), F.lit("")).alias("suffix")).agg(F.count(F.lit(1)).alias("files"), F.sum(F.octet_length("text")).alias("bytes"))


@query("documents", "mix_targets", sql="""with n as (select source, sum(length(text))::double as chars, (select sum(length(text)) from documents) as everything from documents group by 1)
    select source, round(case when coalesce(target_share, 0) <= 0 then case when coalesce(chars, 0) > 0 then 1.0 else 0.0 end when coalesce(chars, 0) > 0 then target_share * (select sum(length(text)) from documents) / chars else 0.0 end, 6) as epochs
    from mix_targets left join n using (source)""")
def source_epochs(d, t):
    """How often each source's characters must be read to have its share of all."""
    n = d.groupBy("source").agg(F.sum(F.length("text")).cast("double").alias("chars"))
    every = d.agg(F.sum(F.length("text")).alias("everything"))
    j = t.join(n, "source", "left").join(F.broadcast(every))  # one row
    return j.select("source", F.round(reports.estimated_epochs(F.coalesce("chars", F.lit(0.0)), F.col("target_share") * F.col("everything")), 6).alias("epochs"))


@query(
    "eval_items",
    sql="""with t as (select suite, trim(coalesce(prompt, ''), ' ') = '' as i, trim(coalesce(answer, ''), ' ') = '' as o, length(coalesce(answer, '')) as n from eval_items)
    select suite, count(*) as records, count(*) filter (i) as empty_instructions, count(*) filter (o) as empty_outputs, count(*) filter (not i and not o) as usable,
        round(avg(n), 6) as output_mean, median(n) as output_median, min(n) as output_least, max(n) as output_most from t group by 1""",
)
def record_report(e):
    return reports.record_report(e, "prompt", "answer", "suite").withColumn("output_mean", F.round("output_mean", 6))


@query(
    "documents",
    sql=f"""with t as (select unnest({_TOKENS}) as token from documents) select count(*) as tokens, count(*) filter (regexp_matches(token, '^[\\p{{L}}\\p{{M}}\\p{{N}}]')) as words,
        count(*) filter (regexp_matches(token, '^\\p{{P}}$')) as punctuation, count(*) filter (not regexp_matches(token, '^[\\p{{L}}\\p{{M}}\\p{{N}}]|^\\p{{P}}$')) as other, count(distinct token) as unique_tokens from t""",
)
def tokenization_report(d):
    return reports.tokenization_report(tokens.token_rows(d, "doc_id", "text"), "token")


@query(
    "documents",
    sql=f"""with t as (select len({_TOKENS}) as t, length(text) as c, {_B} as b from documents where text is not null)
    select count(*) as documents, sum(t)::bigint as tokens, round(sum(t) / count(*), 6) as tokens_per_document, round(sum(c) / sum(t), 6) as chars_per_token, round(sum(t) / sum(b), 6) as tokens_per_byte from t""",
)
def document_index_report(d):
    r = reports.document_index_report(d, "text", F.size(T.tokens(F.lower("text"))).cast("bigint"))
    return r.withColumns({c: F.round(c, 6) for c in ("tokens_per_document", "chars_per_token", "tokens_per_byte")})


_LANGUAGES = "case {0} when '.py' then 'Python' when '.md' then 'Markdown' when '.rst' then 'reStructuredText' when '.txt' then 'Text' when '.js' then 'JavaScript' when '.json' then 'JSON' when '.toml' then 'TOML' else 'Other' end"


@query(
    "code_records",
    sql=f"""with t as (select {_LANGUAGES.format(_SUFFIX)} as language, {_B} as n from code_records where text is not null)
    select language, sum(n)::bigint as n, round(sum(n) / (select sum(n) from t), 9) as share from t group by 1""",
)
def language_mix(r):
    t = r.filter("text is not null").select(T.language_of_suffix(F.col("path")).alias("language"), F.octet_length("text").cast("bigint").alias("b"))
    return reports.share_by(t, F.col("language"), "language", F.col("b")).withColumn("share", F.round("share", 9))


@query("code_records")
def comment_mix(r):
    """Characters of comments and docstrings against code, over all Python files."""
    py = r.filter(pysource.is_python(F.col("path"), F.col("text")))
    m = lines.character_mixes(py, ["record_id"]).agg(F.sum("said").alias("said"), F.sum("code").alias("code"))
    return m.withColumn("said_share", F.try_divide(F.col("said"), F.col("said") + F.col("code")))


@query("eval_items", sql=f"""with c as ({_CHECKS}) select suite, count(*) as items, count(*) filter (passed) as passed, round(count(*) filter (passed) / count(*), 9) as rate from c join eval_items using (item_id) group by 1""")
def category_pass_rates(e):
    c = evalmetrics.answer_checks(e, syntax=False).join(e.select("item_id", "suite"), "item_id")
    return evalmetrics.pass_rates(c, "suite", F.col("passed")).withColumn("rate", F.round("rate", 9))


@query("eval_items")
def answer_checks_with_syntax(e):
    """All rules, syntax too, and what failed."""
    return evalmetrics.answer_checks(e)


@query(
    "eval_items",
    sql=f"""with t as (select suite, coalesce(answer, '') as a, coalesce(check_rules.required_terms, []) as terms from eval_items)
    select suite, count(*) as answers, round(avg(case when len(terms) > 0 then len(list_filter(terms, lambda k: contains(lower(a), lower(k)))) / len(terms) else 1.0 end), 9) as following,
        round(avg({_contains('a', evalmetrics.MARKDOWN_SIGNS)}::int), 9) as markdown_rate, round(avg(contains(a, '```')::int), 9) as fence_rate, round(avg(length(a)), 6) as mean_chars from t group by 1""",
)
def generation_scores(e):
    g = evalmetrics.generation_scores(e, "suite", "answer", F.coalesce(F.col("check_rules.required_terms"), F.array().cast("array<string>")))
    return g.withColumns({c: F.round(c, 9) for c in ("following", "markdown_rate", "fence_rate")} | {"mean_chars": F.round("mean_chars", 6)})


@query("eval_items")
def response_issues(e):
    return evalmetrics.response_issues(e, "item_id", "prompt", "answer").select("item_id", F.array_join("issues", ",").alias("issues"))


@query("documents")
def repetition_loops(d):
    return evalmetrics.repetition_loops(d, "doc_id", "text")


@query(
    "events",
    sql="""select event_type, count(*) as runs, round(avg(value), 6) as mean_seconds, min(value) as least_seconds, max(value) as most_seconds, round(sum(user_id) / sum(value), 6) as tokens_per_second from events group by 1""",
)
def latency_summary(e):
    s = evalmetrics.latency_summary(e, "event_type", "value", "user_id")
    return s.withColumns({c: F.round(c, 6) for c in ("mean_seconds", "tokens_per_second")})


@query(
    "events",
    sql="""with b as (select event_type, avg(value) filter (user_id % 2 = 0) as base, avg(value) filter (user_id % 2 = 1) as candidate from events group by 1),
    i as (select event_type, case when base = 0 then 0 else (candidate - base) / abs(base) end * case when event_type = 'click' then -1 else 1 end as improvement from b)
    select event_type, round(improvement, 9) as improvement, round(avg(improvement) over (), 9) as overall from i""",
)
def overall_improvement(e):
    c = evalmetrics.comparison(e, "event_type", F.when(F.col("user_id") % 2 == 0, "a").otherwise("b"), "a", "b", "value")
    o = evalmetrics.overall_improvement(c, "event_type", ("click",))
    return o.select("event_type", F.round("improvement", 9).alias("improvement"), F.round("overall", 9).alias("overall"))


@query(
    "events",
    sql="""select user_id as step, event_type, arg_max(value, (ts, value)) as value from events group by 1, 2""",
)
def loss_history(e):
    return evalmetrics.loss_history(e.select(F.col("user_id").alias("step"), "event_type", "ts", "value"), "step", "event_type", "ts").select("step", "event_type", "value")


# Order, limits, sampling


@query("embeddings", sql="""with x as (select vec_id, unnest(embedding)::double as logit, generate_subscripts(embedding, 1) as token from embeddings) select vec_id, token, logit from x qualify rank() over (partition by vec_id order by logit desc) <= 5""")
def top_k_tokens(e):
    x = e.select("vec_id", F.posexplode("embedding").alias("i", "x")).select("vec_id", (F.col("i") + 1).cast("bigint").alias("token"), F.col("x").cast("double").alias("logit"))
    return evalmetrics.top_k(x, "vec_id", "logit", 5)


@query(
    "embeddings",
    sql="""with x as (select vec_id, unnest(embedding)::double as logit, generate_subscripts(embedding, 1) as token from embeddings),
    y as (select vec_id, token, case when token % 7 = 0 then case when logit > 0 then logit / 1.2 else logit * 1.2 end else logit end as logit from x),
    z as (select vec_id, token, exp((logit - max(logit) over (partition by vec_id)) / 0.7) as e from y), p as (select vec_id, token, e / sum(e) over (partition by vec_id) as p from z),
    c as (select vec_id, token, coalesce(sum(p) over (partition by vec_id order by p desc, token rows between unbounded preceding and 1 preceding), 0) as before from p)
    select vec_id, count(*) as kept, sum(token)::bigint as tokens from c where before < 0.8 group by 1""",
)
def nucleus(e):
    """Tokens kept by nucleus sampling at 0.8, after a penalty on every seventh and a temperature of 0.7."""
    x = e.select("vec_id", F.posexplode("embedding").alias("i", "x")).select("vec_id", (F.col("i") + 1).cast("bigint").alias("token"), F.col("x").cast("double").alias("logit"))
    x = x.withColumn("logit", evalmetrics.penalized(F.col("logit"), F.col("token") % 7 == 0, 1.2))
    kept = evalmetrics.top_p(evalmetrics.softmax(x, "vec_id", "logit", 0.7), "vec_id", "probability", "token", 0.8)
    return kept.groupBy("vec_id").agg(F.count(F.lit(1)).alias("kept"), F.sum("token").alias("tokens"))


@query("documents", sql="""select doc_id, lang, row_number() over (partition by lang order by sha256('42' || chr(0) || doc_id::varchar), doc_id) - 1 as place from documents""")
def shuffled_documents(d):
    return splits.shuffled(d.select("doc_id", "lang"), F.col("lang"), "doc_id", 42)


@query(
    "documents",
    sql="""with p as (select doc_id, row_number() over (order by sha256('45' || chr(0) || doc_id::varchar), doc_id) - 1 as k from documents)
    select doc_id, k // 4 as place from p where k % 4 = 1 and k // 4 >= 10""",
)
def epoch_sample(d):
    """What worker 1 of 4 reads in epoch 3, from its tenth document on."""
    return splits.epoch_sample(d, "doc_id", 42, 3, 1, 4, 10)


@query(
    "source_manifest",
    sql="""with m as (select distinct coalesce(source.type, '') as t, coalesce(source.id, '') as s, coalesce(stored_path, '') as p from source_manifest)
    select t, s, p, row_number() over (order by t, s, p) - 1 as position from m""",
)
def ordered_manifest(m):
    """Global order by source type, source and path, nulls first as empty texts."""
    empty = lambda c, n: F.coalesce(F.col(c), F.lit("")).alias(n)
    rows = m.select(empty("source.type", "t"), empty("source.id", "s"), empty("stored_path", "p")).distinct()
    keyed = rows.withColumns({"_k": F.struct("t", "s", "p"), "_1": F.lit(1)})
    return windows.running_offsets(keyed, "_k", "_1", "position").drop("_k", "_1")


@query(
    "code_records",
    sql="""with n as (select lower(trim(repo_name)) as repo, count(*) as records from code_records where repo_name is not null group by 1) select repo, records from n order by records desc, repo limit 10""",
)
def largest_repositories(r):
    n = r.filter("repo_name is not null").groupBy(F.lower(F.trim("repo_name")).alias("repo")).agg(F.count(F.lit(1)).alias("records"))
    return n.orderBy(F.desc("records"), "repo").limit(10)


@query(
    "repositories",
    "code_records",
    sql=r"""with u as (select regexp_replace(lower(repo_name), '[-_.]+', '-', 'g') as name, 0 as priority, repo_name as given from repositories
        union all select distinct regexp_replace(lower(trim(repo_name)), '[-_.]+', '-', 'g'), 1, trim(repo_name) from code_records where repo_name is not null)
    select name, priority, given from u qualify row_number() over (partition by name order by priority, given) = 1""",
)
def prioritized_names(p, r):
    """Canonical names from two selections; a registered name comes before one that was only seen."""
    name = lambda c: F.regexp_replace(F.lower(c), r"[-_.]+", "-")
    one = p.select(name(F.col("repo_name")).alias("name"), F.lit(0).alias("priority"), F.col("repo_name").alias("given"))
    two = r.filter("repo_name is not null").select(name(F.trim("repo_name")).alias("name"), F.lit(1).alias("priority"), F.trim("repo_name").alias("given")).distinct()
    least = F.min(F.struct("priority", "given")).alias("k")
    return one.unionByName(two).groupBy("name").agg(least).select("name", "k.priority", "k.given")


@query("events", sql="""select user_id, event_type, ts, row_number() over (partition by user_id order by ts, event_id) as n, date_sub('second', lag(ts) over (partition by user_id order by ts, event_id), ts) as gap from events""")
def event_gaps(e):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select("user_id", "event_type", "ts", F.row_number().over(w).alias("n"), F.timestamp_diff("SECOND", F.lag("ts").over(w), F.col("ts")).alias("gap"))


# Tokens of a public vocabulary, the source index

#: Public vocabularies of the machine; another folder can be set before the queries run.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@query("documents", sql="select doc_id, sha256(nfc_normalize(text)) as h from documents where text is not null")
def bpe_round_trip(d):
    """Texts encoded by the public BPE and decoded again."""
    return bpe.decode(bpe.encode(d, "doc_id", "text", VOCABULARY), "doc_id", "ids", VOCABULARY).select("doc_id", F.sha2("text", 256).alias("h"))


@query("source_manifest", sql=r"""with p as (select distinct stored_path, string_split(ltrim(replace(stored_path, '\', '/'), '/'), '/') as a from source_manifest)
    select stored_path, case when len(a) > 1 then a[1] end as section, case when len(a) > 2 and a[1] = 'github' then a[2] end as repository from p""")
def path_sections(m):
    return readers.with_sections(m.select("stored_path").distinct(), "stored_path")


@query("code_records", "source_manifest", sql=r"""select record_id, path as stored_path, 'manual_raw' as source_id from code_records where path is null or path not in (select stored_path from source_manifest where stored_path is not null)""")
def manual_files(r, m):
    return readers.manual_files(r.select("record_id", F.col("path").alias("stored_path")), m)


@query("documents", sql="""with t as (select doc_id, octet_length(encode(text)) as n, coalesce(sum(octet_length(encode(text))) over (order by doc_id rows between unbounded preceding and 1 preceding), 0) as b from documents where text is not null)
    select doc_id, n from t where b + n <= 300000""")
def within_bytes(d):
    """Texts in order that lie wholly within a budget of 300,000 bytes (the cut one is left out of the comparison)."""
    n = F.octet_length("text").cast("bigint")
    w = readers.within_bytes(d.select("doc_id", "text", n.alias("n")), "doc_id", "text", 300_000)
    return w.filter(F.octet_length("text") == F.col("n")).select("doc_id", "n")


@query("source_manifest", "code_records")
def index_population(m, r):
    return index.population_report(index.build_index(m, r)[0])


@query("source_manifest", "code_records")
def index_reload(m, r):
    files, categories, _ = index.build_index(m, r)
    return index.reloaded(files, categories).select("stored_path", F.array_join("categories", ",").alias("categories"), "primary")


@query(
    "source_manifest",
    "code_records",
    sql=f"""with recursive v as ({catalog.SQL['manifest_verdicts']}), a as (select record_id, min(stored_path) as stored_path from v where reason = 'accepted' group by 1),
    t as (select record_id, {_B} + 1 as n, row_number() over (order by record_id) as k from a join code_records using (record_id)),
    f as (select k, record_id, n, 0::bigint as shard, 0::bigint as "offset" from t where k = 1 union all
        select t.k, t.record_id, t.n, case when f."offset" + f.n + t.n > 50000 then f.shard + 1 else f.shard end, case when f."offset" + f.n + t.n > 50000 then 0 else f."offset" + f.n end from f join t on t.k = f.k + 1)
    select record_id, n, shard, "offset" from f""",
)
def manifest_token_shards(m, r):
    """Accepted manifest rows' texts in bytes and an end token, in shards of 50,000 tokens by next fit, never split."""
    v = validate.manifest_verdicts(m, r, "record_id", syntax=False).filter("reason = 'accepted'").select("record_id").distinct()
    t = r.select("record_id", (F.octet_length("text") + 1).cast("bigint").alias("n")).join(v, "record_id", "left_semi")
    return windows.next_fit_shards(t, "record_id", "n", 50_000)


# The two other builds


@query("source_manifest", "code_records")
def merged_build(m, r):
    """The merged corpus with syntax, over all sources: rows per reason."""
    return merged.staged(m, r).groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


@query("source_manifest", "code_records")
def merged_shards(m, r):
    """Shards of 100,000 tokens of the merged corpus in a public vocabulary: sequences, tokens and bytes."""
    return windows.shard_index(merged.build(m, r, VOCABULARY, most_tokens=100_000)[2], 1025)


@query("code_records")
def instruction_dataset(r):
    """Records of the instruction dataset per split and category; those with problems have no split."""
    py = r.filter(pysource.is_python(F.col("path"), F.col("text"))).withColumn("repo", F.lower(F.trim("repo_name")))
    return instructions.build(py, group="repo")[1].rollup("split", "category").agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("records"))


@query("eval_items", sql=r"""select min(item_id) as item_id, i as instruction, o as output from (select item_id, regexp_replace(coalesce(prompt, ''), '^\s+|\s+$', '', 'g') as i, regexp_replace(coalesce(answer, ''), '^\s+|\s+$', '', 'g') as o from eval_items) where i <> '' and o <> '' group by 2, 3""")
def converted_records(e):
    return sft.converted(e.withColumn("given", F.lit("")), "item_id", "prompt", "given", "answer").drop("input")
