"""One query per operator over its whole table, with production parameters,
and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import contextmix, decontaminate, jaccard, langid, lines, mixing, ordinal, spelling, suffixes, tokens, toxicity, urlrules, vectorcodes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.best_leak(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(tokens.TOKENIZER_FILE))


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.judge_lines(table(spark, sf_dir, "documents")).drop("kept_text")


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup_digest(table(spark, sf_dir, "documents"))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge_urls(table(spark, sf_dir, "pages"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordinal.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contextmix.mixing_scores(table(spark, sf_dir, "documents"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(table(spark, sf_dir, "documents"))


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.compress(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard": op1_jaccard,
    "op2_mix": op2_mix,
    "op3_language": op3_language,
    "op4_decontaminate": op4_decontaminate,
    "op5_toxicity": op5_toxicity,
    "op6_tokens": op6_tokens,
    "op7_lines": op7_lines,
    "op8_suffixes": op8_suffixes,
    "op9_urls": op9_urls,
    "op10_quality": op10_quality,
    "op11_mixing": op11_mixing,
    "op12_spelling": op12_spelling,
    "op13_codes": op13_codes,
    "pipeline": corpus_pipeline.run,
}

MIX_SQL = r"""
with s as (select doc_id, source, md5(coalesce(cast(doc_id as varchar), '')) as shuffle,
    cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size from documents),
src as (select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) - 1 as place from s group by source),
due as (select *, case place % 3 when 0 then 5 when 1 then 2 else 1 end as weight, 3 * source_size as cap from src),
sorted as (select *, row_number() over (order by cast(cap as double) / weight, place) as k from due),
-- the level when the k - 1 sources of smallest cap / weight are capped
levels as (select k, cast(cap as double) / weight as ratio,
    cast((select sum(source_size) from due) - (sum(cap) over (order by k) - cap) as double)
        / cast(sum(weight) over () - (sum(weight) over (order by k) - weight) as double) as level from sorted),
lv as (select level from levels where ratio >= level order by k limit 1),
t as (select source, source_size, least(cast(cap as double), coalesce((select level from lv), 0.0) * weight) as target from due),
placed as (select s.doc_id, s.size, s.source, s.shuffle, t.source_size, t.target,
    cast(sum(s.size) over (partition by s.source order by s.shuffle, s.doc_id, s.size rows unbounded preceding) as bigint) as upto
    from s join t on s.source is not distinct from t.source),
copies as (select *, cast(e * source_size + upto as double) / target as finish
    from placed, (select unnest([0, 1, 2]) as e) where size > 0 and target > 0),
run as (select *, sum(size) over (order by finish, source nulls last, shuffle, doc_id rows unbounded preceding) as used from copies where finish <= 1.0),
taken as (select source, upto, count(*) as copies from run where used <= (select cast(round(sum(target)) as bigint) from t) group by 1, 2)
select p.doc_id, p.size, p.source, p.source_size, p.target, coalesce(x.copies, 0) as copies, cast(coalesce(x.copies, 0) * p.size as bigint) as taken
from placed p left join taken x on p.source is not distinct from x.source and p.upto = x.upto and p.size > 0"""

LINES_SQL = r"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d),
win as (select r, i, array_to_string(words[i:i+4], ' ') as g from (select r, words, unnest(range(1, len(words) - 3)) as i from w where len(words) >= 5)),
again as (select r, i from (select r, i, count(*) over (partition by r, g) as n from win) where n > 1),
rep as (select r, count(distinct i + k) as n from again, (select unnest([0, 1, 2, 3, 4]) as k) group by r),
g as (select w.*, coalesce(rep.n, 0) as n_repeat_words, list_filter(lines, lambda x:
        regexp_matches(x, '[.!?:;,"'')\]}»”’…][\x20\x09-\x0D]*$')
        and (length(x) - length(translate(x, '#*$%&|<>', ''))) * 10 <= length(translate(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))
        and length(x) - length(translate(x, '|>›→·•', '')) + case when contains(x, '«') then 0 else length(x) - length(translate(x, '»', '')) end < 2
        and len(regexp_extract_all(x, '(?i)https?://|www[.]|[]][(]')) <= 1
        and not (length(translate(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) >= 20 and regexp_matches(x, '[A-Z]') and not regexp_matches(x, '[a-zß-öø-ÿ]'))
        and not (length(x) < 200 and len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) >= 4 and
            len(regexp_extract_all(x, '(^|[\x20\x09-\x0D])[A-ZÀ-ÖØ-Þ]')) * 100 >= len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) * 80)
        and not (length(x) < 200 and regexp_matches(x, '(?i)(cookie|privacy policy|terms of (use|service)|all rights reserved|subscribe|newsletter|sign (up|in)|log ?in|click here|read more|javascript|lorem ipsum|tous droits r.serv|mentions l.gales|politique de confidentialit|se connecter|lire la suite|plan du site|alle rechte vorbehalten|datenschutz|impressum|nutzungsbedingungen|weiterlesen|jetzt anmelden|todos los derechos reservados|pol.tica de privacidad|aviso legal|iniciar sesi.n|leer m.s|mapa del sitio)'))) as good
    from w left join rep on w.r = rep.r),
f as (select doc_id, cast(len(words) as bigint) as n_words,
    cast(length(translate(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) as bigint) as word_chars,
    cast(length(text) - length(translate(text, '#*$%&|<>', '')) as bigint) as n_symbols,
    cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words,
    len(words) < 10 or n_repeat_words * 100 > len(words) * 20 as base_failed, cast(len(lines) - len(good) as bigint) as n_bad_lines,
    cast(length(translate(array_to_string(good, chr(10)), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) as bigint) as kept_chars from g)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    not base_failed and not ((word_chars - kept_chars) * 100 > word_chars * 50) as kept, n_bad_lines, kept_chars from f"""

CODES_START = """
with kept as (select vec_id, label, list_transform(embedding, lambda x: cast(floor(cast(x as double) * 1024) as bigint)) as v from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
parts as (select vec_id, label, part, v[part * (len(v) // 4) + 1:(part + 1) * (len(v) // 4)] as x from kept, (select unnest(range(4)) as part)),
b0 as (select part, entry, x as e from (select part, row_number() over (partition by part order by vec_id) - 1 as entry, x from parts) where entry < 256)"""

CODES_NEAREST = """
a{k} as (select p.vec_id, p.part, any_value(p.label) as label, any_value(p.x) as x,
    min(cast(list_sum(list_transform(list_zip(p.x, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as bigint) * 256 + b.entry) as best
    from parts p join b{k} b on p.part = b.part group by p.vec_id, p.part)"""

CODES_ROUND = """
m{k} as (select part, entry, i, cast(floor(cast(sum(c) as double) / count(*)) as bigint) as c
    from (select part, best % 256 as entry, unnest(x) as c, unnest(range(len(x))) as i from a{k}) group by part, entry, i),
b{n} as (select b.part, b.entry, coalesce(m.e, b.e) as e from b{k} b
    left join (select part, entry, list(c order by i) as e from m{k} group by part, entry) m on b.part = m.part and b.entry = m.entry)"""

CODES_END = """
codes as (select vec_id, any_value(label) as label, string_agg(printf('%02x', best % 256), '' order by part) as code,
    cast(sum(best // 256) as bigint) as error from a4 group by vec_id),
sums as (select label, cast(sum(error) as bigint) as label_error from codes group by label),
books as (select sha256(string_agg(array_to_string(e, ','), ',' order by part, entry)) as codebooks_sha256 from b4)
select c.vec_id, c.code, c.error, c.label, s.label_error, books.codebooks_sha256
from codes c join sums s on c.label is not distinct from s.label, books"""

CODES_SQL = ",".join([CODES_START, *[x.format(k=k, n=k + 1) for k in range(4) for x in (CODES_NEAREST, CODES_ROUND)],
                      CODES_NEAREST.format(k=4), CODES_END])

ORACLES: dict[str, str] = {"op2_mix": MIX_SQL, "op7_lines": LINES_SQL, "op13_codes": CODES_SQL}
