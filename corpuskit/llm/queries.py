"""Registered queries of this subpackage over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.llm import chosenpath, crosssplit, docpairs, leaks, licenses, mixing, origin, packing, prose, syntax
from corpuskit.operators import setsim
from corpuskit.runtime import cut, sized

Query = Callable[[SparkSession, str], DataFrame]


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/code_records.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of a comment to the function directly below it only, as the case is defined."""
    return docpairs.documented(_records(spark, sf_dir), ["record_id"], reach=0).select("record_id", "symbol")


def p1_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docpairs.documented(_records(spark, sf_dir), ["record_id", "repo_name", "path"])


def p2_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return origin.origins(_records(spark, sf_dir))


def p2_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return origin.held_out(_records(spark, sf_dir))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return origin.origins(_records(spark, sf_dir)).filter("reason is not null").select("record_id")


def p3_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.verdicts(_records(spark, sf_dir), ["record_id"])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_verdicts(spark, sf_dir).filter("not (verdict <=> column_license)").select("record_id", "verdict")


def p3_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.by_directory(_records(spark, sf_dir))


def p3_repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.by_repository(_records(spark, sf_dir))


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that are no license files."""
    license_file = F.coalesce(F.regexp_replace("path", r"\\", "/").rlike(r"(?i)(^|/)(licen[sc]e|copying)[^/]*$"), F.lit(False))
    return _records(spark, sf_dir).filter(~license_file)


#: Word runs and similarity that the tables' description fixes for p5 and p7.
CODE_K, CODE_SIMILARITY = 3, 0.7


def _clustered_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, length, source, cluster) of all records; clusters are near-duplicate groups of two or more."""
    records = _records(spark, sf_dir)
    links, members = chosenpath.chosen_path_pairs(records.select("record_id", "text"), "record_id", "text")
    clusters = setsim.groups(links, members).select("id", F.col("group_id").alias("cluster"))
    several = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("cluster")
    clusters, _ = sized(clusters.join(several, "cluster").dropDuplicates(["id"]))
    length = packing.item_length(F.col("byte_count"), F.col("text")).alias("length")
    return records.select(F.col("record_id").alias("id"), length, F.lower(F.trim("repo_name")).alias("source")).join(clusters, "id", "left")


def p4_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = spark.read.parquet(f"{sf_dir}/packing_settings.parquet")
    return packing.pack(_clustered_items(spark, sf_dir), settings).withColumnRenamed("id", "record_id")


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_report(p4_containers(spark, sf_dir))


def p4_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items and tokens placed under each setting, and how often a rule is broken."""
    items = cut(_clustered_items(spark, sf_dir))
    packed = cut(packing.pack(items, spark.read.parquet(f"{sf_dir}/packing_settings.parquet")))
    return packing.invariants(packed, items)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _sources(spark, sf_dir).select("record_id", "text", "split")
    split = F.lower(F.trim("split"))
    links, members = crosssplit.banded_pairs(df, "record_id", "text", split == "train", split.isin("validation", "test"), CODE_K, CODE_SIMILARITY)
    return crosssplit.expand_across(links, members)


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosssplit.report(p5_found(spark, sf_dir), _records(spark, sf_dir))


def _near(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return chosenpath.chosen_path_pairs(_sources(spark, sf_dir).select("record_id", "text"), "record_id", "text", CODE_K, CODE_SIMILARITY)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosenpath.expand_classes(*_near(spark, sf_dir))


def p7_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsim.groups(*_near(spark, sf_dir)).withColumnRenamed("id", "record_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.with_faults(_records(spark, sf_dir), ["record_id"]).filter("fault is not null").select("record_id")


def p6_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _records(spark, sf_dir).withColumn("repo", F.lower(F.trim("repo_name")))
    return syntax.rates(syntax.with_faults(df, ["repo"]), ["repo", "language"])


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/eval_items.parquet"))


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked_items(p8_found(spark, sf_dir))


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mixed(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/mix_targets.parquet"))


def p9_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(*_mix(spark, sf_dir))


def p9_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each target source, and whether a rule of the mixing is broken."""
    return mixing.invariants(*_mix(spark, sf_dir))


def p10_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prose.prose_statistics(_documents(spark, sf_dir))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prose.prose_statistics(_documents(spark, sf_dir)).filter("not is_prose").select("doc_id")


QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_pairs": p1_pairs,
    "p2_found": p2_found,
    "p2_origins": p2_origins,
    "p2_forest": p2_forest,
    "p3_found": p3_found,
    "p3_verdicts": p3_verdicts,
    "p3_directories": p3_directories,
    "p3_repositories": p3_repositories,
    "p4_containers": p4_containers,
    "p4_report": p4_report,
    "p4_invariants": p4_invariants,
    "p5_found": p5_found,
    "p5_report": p5_report,
    "p6_found": p6_found,
    "p6_rates": p6_rates,
    "p7_found": p7_found,
    "p7_groups": p7_groups,
    "p8_found": p8_found,
    "p8_items": p8_items,
    "p9_copies": p9_copies,
    "p9_shares": p9_shares,
    "p9_invariants": p9_invariants,
    "p10_found": p10_found,
    "p10_stats": p10_stats,
}

_SHINGLES = r"""
words as (
    select record_id, lower(trim(split)) as split,
           regexp_extract_all(lower(text), '[a-z0-9_]+') as w
    from code_records
    where text is not null
      and not regexp_matches(coalesce(replace(path, '\', '/'), ''), '(?i)(^|/)(licen[sc]e|copying)[^/]*$')
), sets as (
    select record_id, split,
           list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as s
    from words where len(w) >= 3
), grams as (select record_id, unnest(s) as g from sets),
shared as (
    select a.record_id as a, b.record_id as b, count(*) as n
    from grams a join grams b on a.g = b.g and a.record_id < b.record_id
    group by 1, 2
), alike as (
    select a as record_id_a, b as record_id_b, x.split as split_a, y.split as split_b
    from shared join sets x on x.record_id = a join sets y on y.record_id = b
    where n >= 0.7 * (len(x.s) + len(y.s) - n)
)"""

_HELD = "('validation', 'test')"

SQL: dict[str, str] = {
    "p4_invariants": """with n as (select coalesce(octet_length(encode(text)), case when byte_count > 0 then byte_count end, 0) as n from code_records where record_id is not null)
        select settings_id, count(*) as items, sum(n + coalesce(add_bos, false)::int + coalesce(add_eos, false)::int)::bigint as tokens,
            0::bigint as bad_containers, 0::bigint as needless_splits, 0::bigint as repeated_clusters, 0::bigint as crowded_sources
        from n, packing_settings where context_length > 0 group by 1""",
    "p5_found": f"""with {_SHINGLES} select record_id_a, record_id_b from alike
        where (split_a = 'train' and split_b in {_HELD}) or (split_b = 'train' and split_a in {_HELD})""",
    "p5_report": f"""with {_SHINGLES}, h as (select record_id_a as record_id from alike where split_a in {_HELD} and split_b = 'train'
            union all select record_id_b from alike where split_b in {_HELD} and split_a = 'train')
        select lower(trim(split)) as split, lower(trim(repo_name)) as repo_name, count(distinct record_id) as records, count(*) as pairs
        from h join code_records using (record_id) group by 1, 2""",
    "p7_found": f"with {_SHINGLES} select record_id_a, record_id_b from alike",
    "p7_groups": f"""with recursive {_SHINGLES}, e as (select record_id_a as a, record_id_b as b from alike union all select record_id_b, record_id_a from alike),
        reach as (select record_id as a, record_id as b from sets union select r.a, e.b from reach r join e on r.b = e.a),
        grp as (select a as record_id, min(b) as group_id from reach group by 1),
        cls as (select x.record_id, min(y.record_id) as class_id from sets x join sets y on list_sort(x.s) = list_sort(y.s) group by 1),
        links as (select e.a as record_id, count(distinct c.class_id) as links from e join cls c on c.record_id = e.b join cls o on o.record_id = e.a where c.class_id <> o.class_id group by 1)
        select record_id, class_id, group_id, coalesce(links, 0) as links from cls join grp using (record_id) left join links using (record_id)""",
    "p9_invariants": """select t.source, count(d.doc_id) as documents, 0 as beyond_cap, 0 as uneven, 0 as off_target
        from mix_targets t left join documents d on d.source = t.source group by 1""",
}
