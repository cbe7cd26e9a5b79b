"""Queries of this subpackage over the tables, and their oracle text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldstone.functions import normalise as N
from foldstone.llm.leakage import Leaks
from foldstone.llm.mixing import mix
from foldstone.llm.seen import Seen, seen_before
from foldstone.llm.spam import spam_pages, spam_scores
from foldstone.sources.tables import table


def _seen(spark: SparkSession, d: str) -> Seen:
    wal, blobs = table(spark, d, "wal_entries"), table(spark, d, "blob_locations")
    volume = N.volume("volume_id").alias("scope")
    records = wal.select(F.lit("wal_entries").alias("src"), volume, N.decoded_key("key").alias("key"), F.col("entry_id").alias("id")).unionByName(
        blobs.select(F.lit("blob_locations").alias("src"), volume, N.digest("blake3").alias("key"), F.col("location_id").alias("id"))
    )
    return seen_before(records)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _seen(spark, d).rows.select(F.col("src").alias("src_table"), F.col("id").alias("row_id"))


def p2_rate(spark: SparkSession, d: str) -> DataFrame:
    """Wrong answers of the fingerprints among the probes for keys that were new."""
    new = F.col("probes") - F.col("yes") + F.col("wrong")
    return _seen(spark, d).answers.select(F.col("src").alias("src_table"), "batch", "probes", "yes", "wrong", F.when(new > 0, F.col("wrong") / new).otherwise(0.0).alias("wrong_rate"))


def p2_answers(spark: SparkSession, d: str) -> DataFrame:
    """Distinct keys that each batch asked for, and those among them that an earlier batch had."""
    return _seen(spark, d).answers.select(F.col("src").alias("src_table"), "batch", "probes", (F.col("yes") - F.col("wrong")).alias("seen"))


def _leaks(spark: SparkSession, d: str) -> Leaks:
    return Leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).exact(12).select("doc_id", "item_id")


def p7_near(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).near(12, 16, 2)


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Which test items leaked, and into how many documents."""
    return _leaks(spark, d).exact(12).groupBy("item_id").agg(F.count("*").alias("documents"), F.max("words").alias("longest"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix(table(spark, d, "documents"), table(spark, d, "mix_targets")).chosen


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix(table(spark, d, "documents"), table(spark, d, "mix_targets")).shares


def p8_held(spark: SparkSession, d: str) -> DataFrame:
    """What a mix promises, by target: whether documents can fill it, its share kept within two texts of each pattern it draws on, and no document used too often."""
    m = mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))
    largest = m.chosen.groupBy("source").agg(F.max("tokens").alias("largest"))
    drawn: dict[str, int] = {}
    for _, source in m.plan.route:
        drawn[source] = drawn.get(source, 0) + 1
    patterns = spark.createDataFrame(list(drawn.items()) or [("", 0)], "source string, patterns bigint")
    slack = 2 * F.coalesce("largest", F.lit(0)) * F.coalesce("patterns", F.lit(0))
    held = m.shares.join(largest, "source", "left").join(patterns, "source", "left")
    return held.select("source", (F.col("actual_tokens") > 0).alias("filled"), (F.abs(F.col("actual_tokens") - F.col("quota_tokens")) <= slack).alias("within_quota"), (F.col("most_uses") <= F.col("max_repeats")).alias("within_repeats"))


def p8_sources(spark: SparkSession, d: str) -> DataFrame:
    """Every chosen document once, by its own source and text: none of another source, none without text."""
    m = mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))
    docs = table(spark, d, "documents").select("doc_id", N.word("source").alias("own"), F.length("text").alias("n"))
    kept = m.chosen.join(docs, "doc_id")
    return kept.groupBy("source").agg((F.count("*") == F.count_distinct("doc_id")).alias("once"), F.count_if((F.col("own") != F.col("source")) | (F.col("n") == 0)).alias("astray"))


def _reviews(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", N.word("item").alias("item"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return spam_pages(_reviews(spark, d), "item")


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    return spam_scores(_reviews(spark, d), "item")


QUERIES = {
    "p2_found": p2_found,
    "p2_rate": p2_rate,
    "p2_answers": p2_answers,
    "p7_found": p7_found,
    "p7_near": p7_near,
    "p7_items": p7_items,
    "p8_mix": p8_mix,
    "p8_shares": p8_shares,
    "p8_held": p8_held,
    "p8_sources": p8_sources,
    "p9_found": p9_found,
    "p9_scores": p9_scores,
}

_RECORDS = f"""
with r as (
  select 'wal_entries' as src_table, entry_id as row_id, {N.sql_word("volume_id")} as scope, {N.sql_key("key")} as key from wal_entries
  union all select 'blob_locations', location_id, {N.sql_word("volume_id")}, {N.sql_digest("blake3")} from blob_locations where blake3 is not null),
"""

_FILLED = f"""with t as (select distinct {N.sql_word("source")} as source from mix_targets), h as (select distinct {N.sql_word("source")} as source from documents where text <> '')
"""

# fixed values: entities that the SQL side decodes; a text with another one would differ there
_ENTITIES = {"&nbsp;": " ", "&#32;": " ", "&#x27;": "''", "&#39;": "''", "&quot;": '"', "&apos;": "''", "&lt;": "<", "&gt;": ">", "&eacute;": "é", "&egrave;": "è", "&agrave;": "à", "&ccedil;": "ç", "&uuml;": "ü", "&ouml;": "ö", "&auml;": "ä", "&szlig;": "ß", "&ntilde;": "ñ", "&amp;": "&"}


def _sql_words(text: str) -> str:
    """The words of a text as an independent SQL expression: invisible characters, markup, entities, width, case and accents off."""
    wide = "".join(chr(0xFF01 + i) for i in range(94)).replace("'", "''")
    plain = "".join(chr(0x21 + i) for i in range(94)).replace("'", "''")
    hidden = r"[\p{Cf}\x{34F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{3164}\x{FFA0}\x{180B}-\x{180F}\x{FE00}-\x{FE0F}]"
    x = f"regexp_replace({text}, '{hidden}', '', 'g')"
    x = f"regexp_replace({x}, '(?s)<!--.*?-->|</?[A-Za-z][^<>]*>|<![A-Za-z][^<>]*>', ' ', 'g')"
    for entity, shown in _ENTITIES.items():
        x = f"replace({x}, '{entity}', '{shown}')"
    return f"regexp_extract_all(replace(strip_accents(lower(translate({x}, '{wide}', '{plain}'))), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}]+')"


_GRAMS = f"""with d as (select doc_id as id, {_sql_words("text")} as w from documents where text is not null), i as (select item_id as id, {_sql_words("text")} as w from eval_items where text is not null),
dg as (select id, k, array_to_string(w[k : k + 11], ' ') as g from (select id, w, unnest(range(1, greatest(1, len(w) - 10))) as k from d)),
ig as (select id, k, array_to_string(w[k : k + 11], ' ') as g from (select id, w, unnest(range(1, greatest(1, len(w) - 10))) as k from i))
"""

ORACLES = {
    "p7_found": _GRAMS + "select distinct dg.id as doc_id, ig.id as item_id from dg join ig using (g)",
    "p7_items": _GRAMS + """, m as (select dg.id as d, ig.id as i, dg.k - ig.k as shift, dg.k as k from dg join ig using (g)),
r as (select d, i, shift, k - row_number() over (partition by d, i, shift order by k) as run from m),
l as (select d, i, count(*) + 11 as words from r group by d, i, shift, run)
select i as item_id, count(distinct d) as documents, max(words) as longest from l group by i""",
    "p8_held": _FILLED + "select source, h.source is not null as filled, true as within_quota, true as within_repeats from t left join h using (source)",
    "p8_sources": _FILLED + "select source, true as once, 0 as astray from t join h using (source)",
    "p2_found": f"""{_RECORDS}f as (select *, min(row_id) over (partition by src_table, scope, key) as first from r)
select src_table, row_id from f where row_id > first""",
    "p2_answers": f"""{_RECORDS}s as (select src_table, min(row_id) as a, max(row_id) as b from r group by all),
k as (select distinct src_table, scope, key, cast((row_id - a) // greatest(1, (b - a + 6) // 6) as integer) as batch from r join s using (src_table)),
f as (select *, min(batch) over (partition by src_table, scope, key) as first from k)
select src_table, batch, count(*) as probes, count(*) filter (where batch > first) as seen from f group by all""",
}
